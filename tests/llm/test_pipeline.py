import re

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small).cache()
        if name != "encoding":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        have = texts(docs)
        if name == "language":
            assert len(texts(out)) >= 0.97 * len(have)
        elif name == "near_dedup":
            assert set(texts(out)) == {i for i, (_, _, kept) in brute.near_duplicates(list(have.items()), percent=80).items() if kept}
        elif name == "substring_dedup":
            want = {i: " ".join(k) if g else have[i] for i, (n, g, k) in brute.substring_dedup(list(have.items())).items() if n > g}
            assert texts(out) == want
        elif name == "decontamination":
            items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            left = texts(out)
            assert len(left) > 0.8 * len(have)
            assert not any(b in re.sub(r"\s+", " ", t.lower()) for t in left.values() for b in items)
        else:
            rows = out.collect()
            assert {r["doc_id"] for r in rows} == set(have) and all(r["round_trip"] and r["parity"] for r in rows)
        docs = out


def test_stages_on_odd_rows(spark, small):
    """Nulls, empty and repeated rows, rows of one id and different texts, columns of clashing names, empty tables."""
    some = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").filter("length(text) > 300 and lang = 'en'").orderBy("doc_id").limit(4).collect()]
    item = spark.read.parquet(f"{small}/benchmark.parquet").first()["text"]
    rows = [(1, some[0]), (2, some[0]), (2, some[1]), (2, some[1]), (3, None), (4, ""), (None, some[2]), (None, some[0]), (5, some[3]), (5, some[3] + " " + item), (6, "\u6f22\u5b57" * 40)]
    docs = spark.createDataFrame([(i, t, None if i == 6 else "en", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("_id", "_h", "_row", "h", "kept", "component_id", "item_id", "score", "class", "pos", "size", "kind"):
        docs = docs.withColumn(c, F.lit("x"))
    stages = dict(corpus_pipeline.STAGES)
    took = lambda name, d=docs: sorted(((r["doc_id"] or 0, r["text"]) for r in stages[name](spark, d, small).collect()), key=str)
    order = lambda x: sorted(x, key=str)
    assert took("near_dedup") == order([(1, some[0]), (2, some[1]), (2, some[1]), (3, None), (4, ""), (0, some[2]), (5, some[3]), (5, some[3] + " " + item), (6, "\u6f22\u5b57" * 40)])
    assert took("decontamination") == order((i or 0, t) for i, t in rows if not (t or "").endswith(item))
    cut = dict(took("substring_dedup"))
    assert cut[1] == some[0] and 3 not in cut and 4 not in cut
    assert {i for i, _ in took("language")} <= {0, 1, 2, 5}  # not the nulls, the empty text, or what no language learned
    assert sorted(r["doc_id"] or 0 for r in stages["encoding"](spark, docs, small).collect()) == sorted(i or 0 for i, _ in rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0, name


def test_whole(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 100
