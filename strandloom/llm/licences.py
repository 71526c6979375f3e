"""Licence scans: a positional index of the templates' rare words, looked up in every file.

A template is a licence's notice or the words by which its text is known. Its words with the highest inverse document
frequency over all files are its index; a file's words that are in the index are looked up there, and each hit says where
in the file the template would begin. A template is found where enough of its different index words say the same
place and all its key phrases stand at theirs. Beside it, base phrases are counted wherever their words follow each other.
DataFrame operations only.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.urls import LOWER, UPPER
from strandloom.session import cut

#: What divides words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: (phrase, label): counted wherever the words follow each other.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


@dataclass(frozen=True)
class Template:
    """label: what a file is called that has it; keys: phrases of the text that must stand at their places."""

    label: str
    text: str
    keys: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()


# Words of public licences and of the notices that name them.
TEMPLATES = (
    Template("agpl", "terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template("apache", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", ("apache license", "terms and conditions for use reproduction and distribution")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license", "apache org licenses license 2 0")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("bsl-1.0", "boost software license version 1 0", ("boost software license",)),
    Template("cc-by", "creative commons attribution 4 0 international public license", ("creative commons attribution 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    Template("epl", "terms of the eclipse public license", ("eclipse public license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software you can redistribute it", "gnu general public license as published by the free software foundation")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("lgpl", "terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "software and associated documentation files")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    Template("wtfpl", "do what the fuck you want to public license", ("do what the fuck you want to public license",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty", "damages arising from the use of this software")),
)


def _literal(value: object, kind: str) -> Column:
    """A constant column of any type."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def places(words: Column, joined: Column, phrase: str) -> Column:
    """Where the phrase's words follow each other, from 0. ``joined``: the words, a space before, between and after."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        ok = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            ok &= F.get(words, i + k) == p
        return ok

    found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
    return F.when(joined.contains(f" {phrase} "), found).otherwise(F.array().cast("array<int>"))


def document_frequencies(texts: DataFrame, templates: Sequence[Template]) -> tuple[int, dict[str, int]]:
    """(files, files with the word) for the templates' words; what comes to the driver is a number for each of these."""
    known = sorted({w for t in templates for w in t.words})
    some = texts.select(F.array_intersect("words", _literal(known, "array<string>")).alias("w"))
    rows = some.select(F.explode(F.concat("w", F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    count = {r["w"]: r["n"] for r in rows}
    return count.pop("", 0), count


def rare_index(templates: Sequence[Template], files: int, count: dict[str, int], rare: int) -> list[tuple[str, int, int]]:
    """(word, template, place) of each place of a template's ``rare`` words in the fewest files; of equal ones the smallest."""
    out = []
    for t, template in enumerate(templates):
        known = sorted(set(template.words), key=lambda w: (count.get(w, 0), w))[:rare]
        out += [(w, t, at) for at, w in enumerate(template.words) if w in known]
    return out


def _at(words: list[str], phrase: str) -> int:
    n = len(phrase.split())
    return next(i for i in range(len(words)) if words[i : i + n] == phrase.split())


def hits(words: Column, templates: Sequence[Template], index: list[tuple[str, int, int]]) -> Column:
    """(t, begin, word) for each index word of a file whose template's key phrases stand where it puts them."""
    known = sorted({w for w, *_ in index})
    keys = [[{"at": _at(t.words, k), "words": k.split()} for k in t.keys] for t in templates]
    postings = _literal({w: [{"t": t, "at": at, "keys": keys[t]} for v, t, at in index if v == w] for w in known}, "map<string,array<struct<t:int,at:int,keys:array<struct<at:int,words:array<string>>>>>>")

    def looked_up(i: Column) -> Column:
        fits = lambda p: (i >= p["at"]) & F.forall(p["keys"], lambda k: F.slice(words, F.greatest(i - p["at"], F.lit(0)) + k["at"] + 1, F.size(k["words"])) == k["words"])
        return F.transform(F.filter(F.element_at(postings, F.get(words, i)), fits), lambda p: F.struct(p["t"].alias("t"), (i - p["at"]).alias("begin"), F.get(words, i).alias("word")))

    found = F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(known)), looked_up))
    none = F.array().cast("array<struct<t:int,begin:int,word:string>>")
    return F.when(F.arrays_overlap(words, _literal(known, "array<string>")), found).otherwise(none)


#: A text that very many rows have is dealt over so many keys.
SALTS = 16


def licence_labels(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, rare: int = 6, agree: int = 2) -> DataFrame:
    """Labels every text with the licences that it names or holds.

    Returns doc_id, n_words, n_base (places of all phrases), first_word, last_word (the smallest and largest of these
    places, from 0; null without any), base_labels, labels (those and the templates'; both distinct, sorted, joined by
    commas, empty without any), score: the largest share of a found template's index that agrees, by inverse document frequency;
    0.5 at least where a phrase stands, 0 without any label.

    A template is found where ``agree`` of its ``rare`` index words (or all, if it has fewer) put it at one place and each key
    phrase stands where it belongs. Null and empty texts: no words, no labels. Repeated rows and null ids: each row
    by itself, equal texts alike. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("words", words_of(F.col("text")))
    files, count = document_frequencies(texts, templates)
    index = rare_index(templates, files, count, rare)
    words = F.col("words")
    rows = texts.select("doc_id", "text", "words", F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).alias("joined"))
    rows = rows.select("doc_id", "text", F.size(words).cast("long").alias("n_words"), F.array(*(places(words, F.col("joined"), p) for p, _ in phrases)).alias("at"), hits(words, templates, index).alias("hits"))
    names = F.array_distinct(F.array_compact(F.array(*(F.when(F.size(F.col("at")[k]) > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)))))
    every = F.flatten("at")
    # no texts from here on: what has hits is known by its hash
    base = cut(rows.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), names.alias("names"),
        F.when(F.size("hits") > 0, F.sha2("text", 256)).alias("file"), "hits",
    ))
    found = _found(base.filter("file is not null"), templates, index, {w: math.log((files + 1) / (count.get(w, 0) + 0.5)) for w, *_ in index}, agree)
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = base.drop("hits").withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(found, ["file", "salt"], "left")
    text = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    more = F.coalesce("found", F.array().cast("array<string>"))
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", text(F.col("names")).alias("base_labels"), text(F.concat("names", more)).alias("labels"), F.round(score, 6).alias("score"))


def _found(files: DataFrame, templates: Sequence[Template], index: list[tuple[str, int, int]], weight: dict[str, float], agree: int) -> DataFrame:
    """(file, found, share): the labels of the templates that each different text holds."""
    own = {t: {w for w, x, _ in index if x == t} for t in range(len(templates))}
    votes = files.select("file", F.explode("hits").alias("x")).select("file", "x.t", "x.begin", "x.word").distinct()
    by = lambda values, kind, key: F.element_at(_literal(values, f"map<string,{kind}>"), key)
    t = F.col("t").cast("string")
    each = votes.groupBy("file", "t", "begin").agg(F.count("*").alias("n"), F.sum(by(weight, "double", F.col("word"))).alias("w"))
    each = each.filter(F.col("n") >= by({t: min(agree, len(v)) for t, v in own.items()}, "int", t))
    share = F.col("w") / by({t: sum(weight[v] for v in sorted(x)) for t, x in own.items()}, "double", t)
    label = by({t: x.label for t, x in enumerate(templates)}, "string", t)
    return each.groupBy("file").agg(F.collect_set(label).alias("found"), F.max(share).alias("share"))
