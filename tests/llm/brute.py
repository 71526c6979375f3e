"""Plain Python versions of the operators, for small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = {i: i + 32 for i in range(65, 91)}


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(UP))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def near_duplicates(rows, k=5, percent=85):
    """rows: (doc_id, text) -> {doc_id: (n_shingles, component_id, kept)}"""
    sets = {i: shingles(t, k) for i, t in rows}
    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    count = defaultdict(int)
    for ids in by.values():
        ids = sorted(ids)
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                count[a, b] += 1
    for (a, b), n in count.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def substring_dedup(rows, n=13):
    """rows: (doc_id, text) -> {doc_id: (n_words, n_removed, kept words)}"""
    first = {}
    words = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(words):
        w = words[i]
        for p in range(len(w) - n + 1):
            first.setdefault(tuple(w[p : p + n]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < i:
                gone[p : p + n] = [True] * n
        out[i] = (len(w), sum(gone), [x for x, g in zip(w, gone) if not g])
    return out


def spelling(rows, least=7, times=2, drop=31):
    """word: (form, root, n, n_near, form_n)."""
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(UP)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                count[run] += 1
    count = {w: n for w, n in count.items() if n >= times}
    near = {w: set() for w in count}
    holes = defaultdict(set)
    for w in count:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].add(w)
            if (v := w[:k] + w[k + 1 :]) in count:
                near[w].add(v)
                near[v].add(w)
    for g in holes.values():
        for a in g:
            near[a] |= g - {a}
    form = {w: min(near[w], key=lambda x: (-count[x], x), default=None) for w in count}
    form = {w: f if f and count[f] >= 10 * count[w] else None for w, f in form.items()}
    out = {}
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), count[form[w]] if form[w] else None)
    return out


def vector_codes(rows, parts=16, size=64, rounds=2):
    """rows: (vec_id, vector or None, label) -> sorted (vec_id, code, error, label_error), and the codebooks."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((i, v) for i, v, _ in kept if i is not None)[:size]
    if not first:
        return [], []
    kept = [r for r in kept if len(r[1]) == len(first[0][1])]
    width = len(first[0][1]) // parts
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[near(part(v, p), book)[1]].append(part(v, p))
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(book)]
    coded = [(i, label, [near(part(v, p), book) for p, book in enumerate(books)]) for i, v, label in kept]
    by = Counter()
    for _, label, found in coded:
        by[label] += sum(d for d, _ in found)
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by[label]) for i, label, f in coded), key=str), books


def phrase_places(text, phrases):
    """(words, places of all phrases, labels)."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))
    at = [(i, label) for phrase, label in phrases for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return words, sorted(i for i, _ in at), {label for _, label in at}
