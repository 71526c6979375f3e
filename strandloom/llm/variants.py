"""Spelling variants: words one edit apart, found in a trie of frequency vectors.

A word's vector counts its letters by groups, one level of the trie a group. An insertion, a deletion or a replacement
changes it by one letter more and one fewer at most, so a depth-first search for a word's neighbours spends a deficit and a
surplus of one each, and leaves a subtree where neither is left. Of two words the one with the larger vector searches,
so its first difference on the way down is a deficit. Leaf words are verified letter by letter.

The trie is cut into shards: a node with more than ``most`` words is divided by its next level. A word travels to each shard
that its budget reaches; a shard with more searching words is dealt into groups, as are the words of a leaf that no level
divides. No group holds more than about ``most`` words and ``asking`` searching ones, whatever the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import words as W
from strandloom.session import cut, ship

#: Letters of each level, the common ones first; the last level counts all letters that are in none.
GROUPS = (*"eainrstoludcmgph", "bf", "vw", "ky", "jqxz")
LEVELS = len(GROUPS) + 1
#: A level counts no further: two counts beyond it are taken as equal, which only lets more through to the verification.
TOP = 9
#: Nodes with fewer words are leaves; pairs of a leaf beyond this go by the hashes of words with one letter left out.
LEAF, DENSE = 32, 1 << 16
#: Words up to here are verified as rows of a matrix.
WIDE = 48
#: Rows that are broadcast at most.
FEW = 100_000


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_WIDE = 0xC3  # the first byte of À to ÿ, which are two bytes each


def _crc_table() -> np.ndarray:
    """What the checksum becomes for each last byte, bit by bit from its polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def _checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The crc32 of each span after a text whose crc32 is ``before``, all spans byte by byte together."""
    table, state = _crc_table(), ~before
    order = np.argsort(start - end, kind="stable")
    size, at, state = (end - start)[order], start[order], state[order]
    for k in range(int(size[0]) if len(size) else 0):
        n = np.searchsorted(-size, -k, "left")
        state[:n] = table[(state[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def runs(data: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, letters) of each maximal run of at least ``least`` letters that stays inside one text."""
    wide = data == _WIDE
    letter = _LETTER[data] | wide
    letter[1:] |= wide[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.concatenate([[False], letter[:-1]]) & ~edge[:-1]
    after = np.concatenate([letter[1:], [False]]) & ~edge[1:]
    start, end = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    n = np.concatenate([[0], np.cumsum(wide)])
    size = end - start - (n[end] - n[start])
    keep = size >= least
    return start[keep], end[keep], size[keep]


def _words_of(ids: list, data: np.ndarray, offs: np.ndarray, least: int, drop: int) -> pa.StructArray:
    """The different words of some texts with their counts."""
    data = W.LOWER[data]
    start, end, size = runs(data, offs, least)
    first = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = _checksums(data, start, end, first[np.searchsorted(offs, start, "right") - 1])
    hit = h % drop == 0
    less = []
    for a, b, c, n in zip(start[hit], end[hit], h[hit], size[hit], strict=True):
        word, k = data[a:b].tobytes().decode(), int(c) % int(n)
        if n > least:
            less.append(word[:k] + word[k + 1 :])
    flat, ends = W.slices(data, start[~hit], (end - start)[~hit])
    whole = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat)))
    return pc.value_counts(pa.chunked_array([whole, pa.array(less, pa.large_string())]))


def vocabulary(docs: DataFrame, least: int = 7, times: int = 2, drop: int = 31, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of at least ``least`` letters with at least ``times`` occurrences in all texts.

    Words come from maximal runs of letters (A-Z, a-z, À to ÿ), A-Z lower-cased; where ``drop`` divides h, the crc32 of
    ``<key>:<run>``, the run's letter h % length goes.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "text", 8 << 20):
            data, offs = W.text_arrays(b.column(1))
            found = _words_of(b.column(0).to_pylist(), data, offs, least, drop)
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"])

    each = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


_LEVEL = np.full(256, LEVELS - 1, np.int64)
for _i, _g in enumerate(GROUPS):
    _LEVEL[[ord(c) for c in _g]] = _i


def with_vectors(words: DataFrame) -> DataFrame:
    """Adds vec, the counts of each level, a digit each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = W.text_arrays(b.column(0))
            data = np.frombuffer(data.tobytes().decode().encode("latin-1"), np.uint8)  # a byte a letter
            size = pc.utf8_length(b.column(0)).to_numpy(zero_copy_only=False)
            cell = np.repeat(np.arange(len(size)), size) * LEVELS + _LEVEL[data]
            count = np.minimum(np.bincount(cell, minlength=len(size) * LEVELS), TOP).astype(np.uint8) + 48
            ends = pa.py_buffer((np.arange(len(size) + 1) * LEVELS).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StringArray.from_buffers(len(size), ends, pa.py_buffer(count))], ["word", "n", "vec"])

    return words.select("word", "n").mapInArrow(add, "word string, n long, vec string")


def _bounded(df: DataFrame) -> DataFrame:
    """Marked for a broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def routed(words: DataFrame, most: int) -> DataFrame:
    """(word, n, vec, node, state): each word at each node of the trie's cut that it can reach, by what it spent on the way
    (0 nothing: its own node, 1 the deficit, 2 both)."""
    heavy, deep = [], words.count() > most
    while deep and len(heavy) < LEVELS:
        if heavy:
            node = F.substring("vec", 1, len(heavy))
            found = cut(words.groupBy(node.alias("node")).agg(F.count("*").alias("c")).filter(F.col("c") > most).select("node", F.lit(True).alias("deep")))
            if found.isEmpty():
                break
            heavy.append(_bounded(found))
        else:
            heavy.append(None)
    at = words.withColumns({"node": F.lit(""), "state": F.lit(0)})
    for level, nodes in enumerate(heavy):
        at = at.withColumn("deep", F.lit(True)) if nodes is None else at.join(nodes, "node", "left")
        c = F.substring("vec", level + 1, 1).cast("int")
        child = lambda count, state: F.struct(F.concat("node", count.cast("string")).alias("node"), F.lit(state).alias("state"))
        kids = F.array(
            F.when(F.col("state") == 0, child(c, 0)), F.when((F.col("state") == 0) & (c > 0), child(c - 1, 1)),
            F.when(F.col("state") == 1, child(c, 1)), F.when((F.col("state") == 1) & (c < TOP), child(c + 1, 2)), F.when(F.col("state") == 2, child(c, 2)),
        )
        here = F.array(F.struct("node", "state"))
        at = at.withColumn("to", F.explode(F.when(F.col("deep"), kids).otherwise(here))).filter("to is not null")
        at = at.select("word", "n", "vec", "to.node", "to.state")
    return at


def _groups(at: DataFrame, most: int, asking: int) -> DataFrame:
    """(node, part, block, stored, word, n, vec): the words that a group holds, and those that search in it."""
    size = at.groupBy("node").agg(F.sum((F.col("state") == 0).cast("long")).alias("held"), F.count("*").alias("all")).filter("held > 0")
    size = cut(size.select("node", F.ceil(F.col("held") / most).cast("int").alias("parts"), F.ceil(F.col("all") / asking).cast("int").alias("blocks")))
    rows = at.join(_bounded(size), "node").withColumn("h", F.xxhash64("word"))
    part, block = F.pmod("h", F.col("parts")).cast("int"), F.pmod(F.shiftright("h", 20), F.col("blocks")).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), n - 1)
    ask = F.transform(all_of(F.col("parts")), lambda p: F.struct(p.alias("part"), block.alias("block"), F.lit(False).alias("stored")))
    hold = F.transform(all_of(F.col("blocks")), lambda b: F.struct(part.alias("part"), b.alias("block"), F.lit(True).alias("stored")))
    to = F.when(F.col("state") == 0, F.concat(ask, hold)).otherwise(ask)
    return rows.withColumn("to", F.explode(to)).select("node", "to.part", "to.block", "to.stored", "word", "n", "vec")


class Letters:
    """Words as rows of letters, from the left and from the right; every letter is one byte."""

    def __init__(self, words: list[str], wide: int):
        self.raw = [w.encode("latin-1") for w in words]
        self.size = np.array([len(w) for w in self.raw], np.int64)
        self.wide = wide
        self.left, self.right = (np.array(x, f"S{wide}").view(np.uint8).reshape(len(words), wide) for x in ([w[:wide] for w in self.raw], [w[: -wide - 1 : -1] for w in self.raw]))


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced letter makes b of a."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    n, p, s = min(len(a), len(b)), 0, 0
    while p < n and a[p] == b[p]:
        p += 1
    while s < n - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return p + s >= max(len(a), len(b)) - 1


def _verified(q: Letters, w: Letters, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that are one edit apart."""
    keep = np.abs(q.size[i] - w.size[j]) <= 1
    i, j = i[keep], j[keep]
    out = np.zeros(len(i), bool)
    longest = np.maximum(q.size[i], w.size[j])
    wide = q.wide
    for at in range(0, len(i), 1 << 16):
        a, b, n = i[at : at + (1 << 16)], j[at : at + (1 << 16)], longest[at : at + (1 << 16)]
        p, s = (np.where((d := x[a] != y[b]).any(1), d.argmax(1), wide) for x, y in ((q.left, w.left), (q.right, w.right)))
        out[at : at + (1 << 16)] = (p + s >= n - 1) & (p < n)
    for k in np.flatnonzero(longest > wide):
        out[k] = one_edit(q.raw[i[k]], w.raw[j[k]])
    return i[out], j[out]


def _left_out(x: Letters, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, hash without the letter there) for each letter, and each word's own hash."""
    size = x.size[rows]
    flat = np.frombuffer(b"".join(x.raw[r] for r in rows), np.uint8).astype(np.uint64) + np.uint64(1)
    own = np.repeat(np.arange(len(rows)), size)
    start = np.cumsum(size) - size
    place = np.arange(len(flat)) - np.repeat(start, size)
    base = np.full(int(size.max(initial=1)) + 1, 0x9E3779B97F4A7C15, np.uint64)
    base[0] = 1
    power = np.multiply.accumulate(base)
    down = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    part = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * power[place], dtype=np.uint64)])
    whole = part[start + size] - part[start]
    before, upto = part[start[own] + place] - part[start[own]], part[start[own] + place + 1] - part[start[own]]
    return own, place, before + (whole[own] - upto) * down, whole


def _met(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a and b with equal numbers."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = hi - lo
    return np.repeat(np.arange(len(a)), n), order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _by_left_out(q: Letters, w: Letters, rows: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of a large leaf: those that are equal without one letter. Their number follows the true pairs."""
    qo, qp, qh, q_all = _left_out(q, rows)
    wo, wp, wh, w_all = _left_out(w, held)
    odd = np.uint64(0xBF58476D1CE4E5B9)
    a, b = _met(qh ^ ((qp + 1).astype(np.uint64) * odd), wh ^ ((wp + 1).astype(np.uint64) * odd))  # replaced
    c, d = _met(qh, w_all)  # q has one letter more
    e, f = _met(q_all, wh)  # or one fewer
    i, j = np.concatenate([qo[a], qo[c], e]), np.concatenate([wo[b], d, wo[f]])
    both = np.unique(np.stack([i, j]), axis=1) if len(i) else np.zeros((2, 0), np.int64)
    return rows[both[0]], held[both[1]]


def search(words: list[str], vecs: np.ndarray, asking: list[str], ask_vecs: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``asking``, row of ``words``) of each pair that is one edit apart, the asking word's (vector, word) the larger.

    Vectors are rows of small counts; all words agree on the first ``known`` levels.
    """
    order = np.lexsort(vecs.T[::-1]) if len(words) else np.zeros(0, np.int64)
    wv, qv = vecs[order].astype(np.int8), ask_vecs.astype(np.int8)
    wide = min(max(map(len, [*words, *asking]), default=1), WIDE)
    w, q = Letters([words[k] for k in order], wide), Letters(asking, wide)
    both = np.ascontiguousarray(np.concatenate([wv, qv]))
    rank = np.unique(both.view(f"S{both.shape[1]}").reshape(-1), return_inverse=True)[1] if both.size else np.zeros(len(both), np.int64)
    w_rank, q_rank = rank[: len(wv)], rank[len(wv) :]
    if not len(words) or not len(asking):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    levels, maybe = wv.shape[1], []
    spent = qv[:, :known] - wv[:1, :known]
    spent = np.maximum(spent, 0).sum(1) + np.maximum(-spent, 0).sum(1)
    stack = [(0, len(words), known, np.flatnonzero(spent <= 2), spent[spent <= 2].astype(np.int8))]
    while stack:
        lo, hi, level, rows, state = stack.pop()
        if not len(rows):
            continue
        if hi - lo > LEAF and level < levels:
            col, ask = wv[lo:hi, level], qv[rows, level]
            edge = [lo, *(lo + 1 + np.flatnonzero(np.diff(col))), hi]
            for a, b in zip(edge, edge[1:], strict=False):
                d = ask - wv[a, level]
                go = (d == 0) | (d == 1) & (state == 0) | (d == -1) & (state == 1)
                stack.append((a, b, level + 1, rows[go], state[go] + np.abs(d[go])))
            continue
        if level == levels and len(rows) * (hi - lo) > DENSE:
            i, j = _by_left_out(q, w, rows, np.arange(lo, hi))
            maybe.append((i, j))
            continue
        step = max(1, (1 << 18) // (hi - lo))
        for at in range(0, len(rows), step):
            r, s = rows[at : at + step], state[at : at + step, None]
            fewer, more = (np.repeat((s >= k).astype(np.int8), hi - lo, 1) for k in (1, 2))
            for k in range(level, levels):
                d = qv[r, k, None] - wv[None, lo:hi, k]
                fewer += np.maximum(d, 0)
                more += np.maximum(-d, 0)
            i, j = np.nonzero((fewer <= 1) & (more <= 1) & (q_rank[r, None] >= w_rank[None, lo:hi]))
            maybe.append((r[i], lo + j))
    i, j = (np.concatenate(x) for x in zip(*maybe, strict=True)) if maybe else (np.zeros(0, np.int64),) * 2
    i, j = _verified(q, w, i, j)
    same = np.flatnonzero(q_rank[i] == w_rank[j])
    keep = np.ones(len(i), bool)
    keep[same] = [q.raw[i[k]] > w.raw[j[k]] for k in same]
    return i[keep], order[j[keep]]


def _digits(col: pa.ChunkedArray) -> np.ndarray:
    texts = col.to_pylist()
    return np.frombuffer("".join(texts).encode(), np.uint8).reshape(len(texts), LEVELS).astype(np.int8) - 48 if texts else np.zeros((0, LEVELS), np.int8)


def links(words: DataFrame, most: int = 1 << 15, asking: int = 1 << 17) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words one edit apart, once. ``words``: (word, n, vec)."""
    ship(words.sparkSession)

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        held, ask = group.filter(group["stored"]), group.filter(pc.invert(group["stored"]))
        i, j = search(held["word"].to_pylist(), _digits(held["vec"]), ask["word"].to_pylist(), _digits(ask["vec"]), len(key[0].as_py()))
        a, b = ask.take(pa.array(i)), held.take(pa.array(j))
        return pa.table({"a": a["word"], "n_a": a["n"], "b": b["word"], "n_b": b["n"]})

    return _groups(routed(words, most), most, asking).groupBy("node", "part", "block").applyInArrow(run, "a string, n_a long, b string, n_b long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where each word's chain of forms ends. ``forms``: (word, form), the form null at the end; no circles."""
    at = cut(forms.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if new.filter("moved").isEmpty():
            return new.select("word", "root")
        at = new.select("word", "root")


def spelling_variants(docs: DataFrame, times: int = 10, most: int = 1 << 15, asking: int = 1 << 17, **words) -> DataFrame:
    """Groups the words of all texts by spelling; returns word, form, root, n, n_near, form_n.

    Words are as ``vocabulary`` gives them. Near words differ by exactly one inserted, deleted or replaced letter; n_near is
    their number. A word's form is its near word of the largest n (of equal ones the smallest in code-point order) if
    that is at least ``times`` the word's own n, else null; root is where the chain of forms ends, the word itself without one.

    Null and empty texts have no words. A null doc_id counts as an empty one before the colon. Repeated rows count each.
    Empty table: no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    base = cut(with_vectors(vocabulary(docs, **words)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    pairs = links(base, most, asking)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    near = pairs.select(F.explode(ends).alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    fits = -F.col("best.m") >= times * F.col("n")
    rows = base.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n"))
    rows = cut(rows)
    return rows.join(roots(rows), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
