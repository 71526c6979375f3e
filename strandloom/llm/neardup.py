"""Near-duplicates by MinHash: a multi-index Hamming join of b-bit signatures, confirmed on full shingle sets.

A document's signature has ``SLOTS`` minima of its shingle hashes, 16 bits of each. Two sets with likeness 0.85
differ in 15 % of the slots; a pair is a candidate if its signatures differ in at most ``far`` of them. All candidates
are found by pigeonhole: the whole signature is cut into chunks, so many that ``far`` differences leave one chunk with at
most one; every chunk is indexed once for each of its slots, without that slot, so that chunks with at most one error
have an equal key and meet. ``far`` and the number of chunks follow from the asked likeness (``index_for``): 22 and
twelve for 0.85. A pair of exactly that likeness has a chance of 5e-5 at most to differ in more slots, and be missed;
no other is lost. A likeness for which the slots don't suffice is refused.

Equal sets are one class (by 128 bits), and only classes are compared. A key's members are first compared with its
smallest one and united; then the members of each key that still holds several components are dealt into blocks. Those
of its largest component and the others have blocks of their own, and every two blocks that may have a new link (and
each of the others with itself) are a group, in which members of different components are compared by signature, each
pair in the first key that it shares; near ones are confirmed there with their sets, and only links leave a group. No
task holds more than a group, no pair within a component is made, and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import bloom
from strandloom.llm import words as W
from strandloom.llm.graph import components
from strandloom.session import cut, ship

SLOTS = 64
#: The most that a pair of exactly the asked likeness may have of a chance to differ in more than ``far`` slots.
LOSS = 5e-5
#: The fewest slots of a chunk: one is left out of each key.
NARROW = 3
#: Members in a block of a key, on average; at most two blocks are compared at once.
BLOCK = 512
#: Near pairs that a task keeps before it gives them out.
PAIRS = 1 << 17
_rng = np.random.default_rng(20240607)
_TIMES = _rng.integers(1 << 62, size=SLOTS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(1 << 62, size=SLOTS, dtype=np.int64).astype(np.uint64)


class Index(NamedTuple):
    """Slots in which a candidate's signatures may differ, and the chunks that are indexed."""

    far: int
    chunks: int


@cache
def index_for(percent: int) -> Index:
    """The index for a likeness of ``percent`` hundredths; ValueError if the slots can't hold it."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be over 0 and at most 100, not {percent}")
    same = percent / 100
    off = [comb(SLOTS, i) * (1 - same) ** i * same ** (SLOTS - i) for i in range(SLOTS + 1)]
    far = next(f for f in range(SLOTS + 1) if sum(off[f + 1 :]) <= LOSS)
    # 2 * chunks - 1 differences leave a chunk with one at most
    chunks = far // 2 + 1
    if chunks * NARROW > SLOTS:
        raise ValueError(f"{SLOTS} slots are too few to find pairs of likeness {same}")
    return Index(far, chunks)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its distinct shingles' hashes, sorted; a text with fewer than k words has one, of all its words."""
    data = W.LOWER[data]
    start, end, ptr = W.word_spans(data, offs)
    h = W.span_hashes(data, start, end)
    at, s = W.run_hashes(h, ptr, k)
    lo = np.searchsorted(at, ptr)
    out = []
    for i in range(len(ptr) - 1):
        n = ptr[i + 1] - ptr[i]
        if n >= k:
            out.append(np.unique(s[lo[i] : lo[i + 1]]))
        elif n:
            whole = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in h[ptr[i] : ptr[i + 1]]:
                    whole = whole * np.uint64(W._ODD) + x
            out.append(W.mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SLOTS uint16 for each set; sets are not empty."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), SLOTS), np.uint16)
    for j in range(SLOTS):
        low = np.minimum.reduceat(flat * _TIMES[j] + _PLUS[j], at)
        out[:, j] = W.mix(low) >> np.uint64(48)
    return out


def chunk_keys(sig: np.ndarray, chunks: int) -> np.ndarray:
    """SLOTS keys for each signature: each chunk without each of its slots."""
    each = W.mix(sig.astype(np.uint64) + np.arange(SLOTS, dtype=np.uint64) * np.uint64(1 << 16))
    out = np.empty((len(sig), SLOTS), np.uint64)
    for part in np.array_split(np.arange(SLOTS), chunks):
        own = each[:, part]
        # a slot's part is taken from the chunk's sum, and the slot's number keeps keys of different kinds apart
        out[:, part] = W.mix(own.sum(1, dtype=np.uint64)[:, None] - own + W.mix(part.astype(np.uint64) + np.uint64(SLOTS << 16))[None])
    return out


def close_pairs(sig: np.ndarray, comp: np.ndarray, side: np.ndarray, far: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of different components and sides whose signatures differ in far slots at most; within side 2 as well."""
    left, right = [], []
    for i in range(0, len(sig), block):
        for j in range(i, len(sig), block):
            a, b = sig[i : i + block], sig[j : j + block]
            p, q = side[i : i + block, None], side[None, j : j + block]
            other = (comp[i : i + block, None] != comp[None, j : j + block]) & ((p != q) | (p == 2))
            if not other.any():
                continue
            near = other & ((a[:, None, :] != b[None, :, :]).sum(-1, dtype=np.uint8) <= far)
            x, y = np.nonzero(near)
            keep = x + i < y + j
            left.append(x[keep] + i)
            right.append(y[keep] + j)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _binary(col: pa.Array, dtype, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` items, as a matrix."""
    col = col.cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    return np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(dtype).reshape(-1, width) if len(col) else np.zeros((0, width), dtype)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "text"):
            sets = shingle_sets(*W.text_arrays(b.column(1)), k)
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            klass, sig = np.zeros((len(sets), 2), np.uint64), np.zeros((len(sets), SLOTS), np.uint16)
            if len(full):
                own = [sets[i] for i in full]
                sig[full] = signatures(own)
                # two sums of differently mixed hashes
                flat, at = np.concatenate(own), np.concatenate([[0], np.cumsum(n[full])[:-1]])
                for j in range(2):
                    klass[full, j] = W.mix(np.add.reduceat(W.mix(flat + np.uint64(j + 1)), at) + n[full].astype(np.uint64))
            body = W.blobs(sig.reshape(-1), np.arange(len(sets) + 1) * SLOTS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), W.int64(n), W.blobs(klass.reshape(-1), 2 * np.arange(len(sets) + 1)), body], ["doc_id", "h", "n_shingles", "class", "sig"])

    return run


def _keyed(chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = chunk_keys(_binary(b.column(1), np.uint16, SLOTS), chunks)
            rep = np.repeat(b.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([W.int64(keys.reshape(-1)), W.int64(rep)], ["key", "rep"])

    return run


def _near(far: int):
    """(a, b, sig_a, sig_b) to the pairs (a, b) whose signatures are near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off = (_binary(b.column(2), np.uint16, SLOTS) != _binary(b.column(3), np.uint16, SLOTS)).sum(1)
            yield b.select(["a", "b"]).filter(pa.array(off <= far))

    return run


def grouped(where: DataFrame, sig: DataFrame) -> DataFrame:
    """(key, rep, comp) to (grp, key, rep, comp, side, sig): a key's members in each of the groups that their block is in.

    Blocks have BLOCK members or so, by the hash of the member. Members of the key's largest component have blocks of their
    own, which are not held against each other. side: 0 or 1, the blocks of the group; 2, a block with itself. Keys whose
    members all have one component are left out.
    """
    by = where.groupBy("key", "comp").agg(F.count("*").alias("n"))
    many = by.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("x"), F.sum("n").alias("n"), F.count("*").alias("comps")).filter("comps > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    many = many.select("key", F.col("x.comp").alias("big"), blocks(F.col("x.n")).alias("m_big"), blocks(F.col("n") - F.col("x.n")).alias("m_rest"))
    rows = where.join(many, "key").withColumn("is_big", F.col("comp") == F.col("big"))
    # blocks from 0: the largest component's, then the others'
    h = F.xxhash64("rep")
    rows = rows.withColumn("own", F.when(F.col("is_big"), F.pmod(h, "m_big")).otherwise(F.col("m_big") + F.pmod(h, "m_rest")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(F.col("is_big"), F.col("m_big")).otherwise(0), F.col("m_big") + F.col("m_rest") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    grp = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(grp.alias("grp"), "key", "rep", "comp", side.alias("side")).join(sig, "rep").select("grp", "key", "rep", "comp", "side", "sig")


def _within_groups(index: Index):
    """(grp, key, rep, comp, side, sig), all rows of a group together, to (grp, rep, partners): near ones in different components.

    A row is a member of a group with its partners in it; the partners have rows without partners there.
    """

    def pairs(grp: int, key: int, rep: np.ndarray, comp: np.ndarray, side: np.ndarray, sig: np.ndarray) -> tuple[list[tuple[int, int, bytes]], int]:
        i, j = close_pairs(sig, comp, side, index.far)
        if not len(i):
            return [], 0
        # each pair belongs to the first key that its members share
        keys = chunk_keys(sig, index.chunks)
        own = np.zeros(len(i), bool)
        for s in range(0, len(i), PAIRS):
            a, b = i[s : s + PAIRS], j[s : s + PAIRS]
            own[s : s + PAIRS] = keys[a, (keys[a] == keys[b]).argmax(1)].view(np.int64) == key
        i, j = i[own], j[own]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        edge = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]])) if len(i) else [0]
        out = [(grp, int(rep[i[x]]), rep[j[x:y]].astype(np.int64).tobytes()) for x, y in zip(edge[:-1], edge[1:], strict=True)]
        return out + [(grp, int(m), b"") for m in np.unique(rep[j])], len(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows: list[tuple[int, int, bytes]] = []
        n = 0

        def given() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["grp", "rep", "partners"])

        def all_pairs(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal n
            t = pa.Table.from_batches(parts).combine_chunks()
            if not t.num_rows:
                return
            b = t.to_batches()[0]
            grp, key, rep, comp, side = (b.column(i).to_numpy() for i in range(5))
            sig = _binary(b.column(5), np.uint16, SLOTS)
            edge = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (key[1:] != key[:-1]), [True]]))
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                new, more = pairs(int(grp[s]), int(key[s]), rep[s:e], comp[s:e], side[s:e], sig[s:e])
                rows.extend(new)
                n += more
                if n >= PAIRS:
                    yield given()
                    n = 0

        last = None
        for b in batches:
            grp = b.column(0).to_numpy()
            if not len(grp):
                continue
            cuts = np.flatnonzero(np.concatenate([[last is not None and grp[0] != last], grp[1:] != grp[:-1]]))
            if len(cuts):  # all groups before the last one in this batch are whole
                whole = cuts[-1]
                yield from all_pairs([*held, b.slice(0, whole)])
                held = [b.slice(whole)]
            else:
                held.append(b)
            last = grp[-1]
        if held:
            yield from all_pairs(held)
        yield given()

    return run


def _sets_of(k: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = np.frombuffer(wanted.value, np.uint64)
        for b in batches:
            b = b.filter(pa.array(bloom.passes(filt, bloom.id_hash(b.column(0).to_numpy(zero_copy_only=False)))))
            for p in W.pieces(iter([b]), "text"):
                sets = shingle_sets(*W.text_arrays(p.column(1)), k)
                ptr = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                yield pa.RecordBatch.from_arrays([p.column(0), W.blobs(np.concatenate(sets), ptr)], ["doc_id", "body"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirm_blocks(percent: int):
    """(grp, rep, partners, body), all rows of a group together, to links (a, b) that unite all that are linked in it."""

    def links(rows: list) -> pa.RecordBatch:
        sets = {rep: body for rep, _, body in rows}
        root = {rep: rep for rep in sets}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for rep, partners, body in rows:
            for other in np.frombuffer(partners, np.int64).tolist():
                x, y = find(rep), find(other)
                if x != y and _linked(body, sets[other], percent):
                    root[x] = y
                    out.append((min(rep, other), max(rep, other)))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for b in batches:
            for g, rep, partners, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if g != group:
                    found = links(rows)
                    if found.num_rows:
                        yield found
                    group, rows = g, []
                rows.append((rep, partners, np.frombuffer(body, np.uint64)))
        yield links(rows)

    return run


def _sets_for(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, body): the sets of the documents in ``ids`` (doc_id, distinct); others are not made, but for a few that a filter lets through."""

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([W.int64(bloom.id_hash(b.column(0).to_numpy()))], ["h"])

    wanted = bloom.build(ids.mapInArrow(hashed, "h long"), F.col("h"), 1 << 24)
    sets = docs.filter("doc_id is not null").mapInArrow(_sets_of(k, wanted), "doc_id long, body binary")
    return cut(sets.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def _checked(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that their full sets confirm."""
    sets = _sets_for(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), k)
    x = sets.select(F.col("doc_id").alias("a"), F.col("body").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("body").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, key: str = "doc_id", text: str = "text", give_hash: bool = False) -> DataFrame:
    """Links documents with 100 * intersection >= percent * union of their k-word shingle sets.

    Returns doc_id, n_shingles, component_id, kept for each row, and with ``give_hash`` h, xxhash64 of its text. Words are runs without ASCII white space, A-Z
    lower-cased. Null, empty and wordless texts have no shingle and are linked with nothing. A row without a doc_id is
    never kept, and its component is its own null or that of an equal text. Rows with the same doc_id are judged each by
    its own text; equal ones are all kept or none. Empty table: no rows. Other columns are ignored. A ``percent`` for
    which the signatures are too short is refused (ValueError).
    """
    index = index_for(percent)
    ship(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    rows = cut(docs.mapInArrow(_sketch(k), "doc_id long, h long, n_shingles long, class binary, sig binary"))
    docs = docs.drop("h")
    classes = cut(rows.filter("n_shingles > 0 and doc_id is not null").groupBy("class").agg(F.min(F.struct("doc_id", "sig")).alias("r")).select("class", F.col("r.doc_id").alias("rep"), F.col("r.sig").alias("sig")))
    sig = classes.select("rep", "sig")
    keys = sig.mapInArrow(_keyed(index.chunks), "key long, rep long")
    shared = keys.groupBy("key").agg(F.min("rep").alias("center"), F.count("*").alias("n")).filter("n > 1")
    met = cut(keys.join(shared.select("key", "center"), "key"))
    star = met.filter("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    tried = cut(_with_signatures(star, sig).mapInArrow(_near(index.far), "a long, b long"))
    links = cut(_checked(docs, tried, k, percent))
    label = components(links)
    # keys whose members are not all united yet
    where = met.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("comp"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = cut(grouped(where, sig).repartition(n, "grp").sortWithinPartitions("grp", "key", "side").mapInArrow(_within_groups(index), "grp long, rep long, partners binary"))
    bodies = _sets_for(docs, blocks.select(F.col("rep").alias("doc_id")).distinct(), k).withColumnRenamed("doc_id", "rep")
    more = blocks.join(bodies, "rep").select("grp", "rep", "partners", "body").repartition(n, "grp").sortWithinPartitions("grp").mapInArrow(_confirm_blocks(percent), "a long, b long")
    links = links.unionByName(more).distinct()
    label = components(links)
    found = rows.join(classes.select("class", "rep"), "class", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("label", "rep", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), *(["h"] if give_hash else [])).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _with_signatures(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    a = sig.select(F.col("rep").alias("a"), F.col("sig").alias("x"))
    b = sig.select(F.col("rep").alias("b"), F.col("sig").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y")
