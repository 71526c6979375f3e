"""Histogram sort: shards of near equal bytes, found by counting and filled by one exchange.

Rows are ordered by (h1, h2), two 64-bit hashes of the text and of the key, so equal texts are neighbours. The
boundaries between shards come from exact counts: every round counts bytes and rows below 64 probes inside each
interval that still holds a boundary, and narrows the interval, until the boundary is within its tolerance. A hot
group of equal texts has one h1; inside it the probes go on over h2. Then the rows move once.

Everything is DataFrame operations; what reaches the driver is at most 64 counts for each open boundary.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import cut

FIRST_BITS, STEP_BITS = 12, 6


@dataclass
class _Node:
    """An interval of keys that holds boundaries: ``h1`` prefix at depth ``bits``, or one whole h1 and a prefix of h2."""

    h1: int
    h2: int | None
    bits: int
    below: tuple[int, int]
    targets: list[tuple[str, int]] = field(default_factory=list)


def sort_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, h1, h2) per row. Size: UTF-8 bytes of the text (null: none) plus 8."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("h1"),
        F.xxhash64(F.col(key), F.lit(7)).alias("h2"),
    )


def _digits(df: DataFrame, col: str, bits: int, wide: int, *by) -> DataFrame:
    """Bytes, rows and the span of h1 for each value of the next ``wide`` bits of ``col``."""
    digit = F.shiftrightunsigned(F.col(col), 64 - bits - wide).bitwiseAND((1 << wide) - 1).alias("digit")
    return df.groupBy(*by, digit).agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("h1").alias("lo"), F.max("h1").alias("hi")
    )


def _prefix(value: int, bits: int) -> int:
    return ((value & (1 << 64) - 1) >> (64 - bits)) if bits else 0


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def splitters(keys: DataFrame, shards: int, runs: int, tolerance: float = 1e-3) -> tuple[list, dict]:
    """The boundaries, in key order, each (h1, h2, bytes below, rows below, kind), where kind is "shard" or "run".

    A key belongs behind a boundary if (h1, h2) >= it, unsigned. ``shards - 1`` boundaries divide the bytes, and
    ``runs - 1`` divide the rows, so that no task of the exchange holds more than its part of the rows. ``tolerance``
    is the share of a shard (a run) by which a boundary may miss; an interval of a single key can't be divided.
    """
    top = {r["digit"]: r for r in _digits(keys, "h1", 0, FIRST_BITS).collect()}
    total = (sum(r["bytes"] for r in top.values()), sum(r["rows"] for r in top.values()))
    slack = {"shard": tolerance * total[0] / shards, "run": 0.25 * total[1] / runs}
    want = [("shard", i * total[0] // shards) for i in range(1, shards)] + [("run", i * total[1] // runs) for i in range(1, runs)]
    done: list[tuple[int, int, int, int, str]] = []

    def settle(node: _Node, counts: dict, wide: int) -> list[_Node]:
        """Gives each target of the node a digit's edge if that is near enough, or else an inner node."""
        inner: dict[int, _Node] = {}
        level, prefix = ("h2", node.h2) if node.h2 is not None else ("h1", node.h1)
        edges, below = [], node.below
        for d in sorted(counts):
            c = counts[d]
            edges.append((d, below, (below[0] + c["bytes"], below[1] + c["rows"]), c))
            below = edges[-1][2]
        for kind, goal in node.targets:
            axis = 0 if kind == "shard" else 1
            hit = next((e for e in edges if e[2][axis] > goal), edges[-1])
            d, lo, hi, c = hit
            bits = node.bits + wide
            at_lo, at_hi = abs(goal - lo[axis]), abs(hi[axis] - goal)
            single = c["rows"] == 1 or bits >= 64 and (level == "h2")
            if min(at_lo, at_hi) <= slack[kind] or single:
                start = (prefix << wide | d) if at_lo <= at_hi else (prefix << wide | d) + 1
                value, base = start << (64 - bits), lo if at_lo <= at_hi else hi
                done.append((value, 0, *base, kind) if level == "h1" else _inner(node.h1, value, *base, kind))
            elif level == "h1" and c["lo"] == c["hi"]:
                inner.setdefault(d, _Node(c["lo"] & (1 << 64) - 1, 0, 0, lo)).targets.append((kind, goal))
            else:
                nxt = _Node(prefix << wide | d, None, bits, lo) if level == "h1" else _Node(node.h1, prefix << wide | d, bits, lo)
                inner.setdefault(d, nxt).targets.append((kind, goal))
        return list(inner.values())

    if not total[1]:
        return [], {"bytes": 0, "rows": 0, "rounds": 0}
    open_nodes, rounds = settle(_Node(0, None, 0, (0, 0), want), top, FIRST_BITS), 1
    spark = keys.sparkSession
    while open_nodes:
        rounds += 1
        nodes, open_nodes = open_nodes, []
        groups = defaultdict(dict)
        for n in nodes:
            groups["h1" if n.h2 is None else "h2", n.bits][(n.h1, n.h2 or 0)] = n
        for (level, bits), own in groups.items():
            wide = min(STEP_BITS, 64 - bits)
            if level == "h1":
                ids = spark.createDataFrame([(p,) for p, _ in own], "p long")
                part = keys.withColumn("p", F.shiftrightunsigned("h1", 64 - bits)).join(F.broadcast(ids), "p")
                rows = _digits(part, "h1", bits, wide, "p").collect()
            else:
                ids = spark.createDataFrame([(_signed(h), p) for h, p in own], "h1 long, p long")
                part = keys.withColumn("p", F.shiftrightunsigned("h2", 64 - bits) if bits else F.lit(0).cast("long")).join(F.broadcast(ids), ["h1", "p"])
                rows = _digits(part, "h2", bits, wide, "h1", "p").collect()
            counts: dict = defaultdict(dict)
            for r in rows:
                counts[(r["p"], 0) if level == "h1" else (r["h1"] & (1 << 64) - 1, r["p"])][r["digit"]] = r
            for k, n in own.items():
                open_nodes += settle(n, counts[k], wide)
    done.sort()
    return done, {"bytes": total[0], "rows": total[1], "rounds": rounds}


def _inner(h1: int, h2: int, below_bytes: int, below_rows: int, kind: str) -> tuple:
    """A boundary inside one h1; past the last h2 it is the start of the next h1."""
    return (h1, h2, below_bytes, below_rows, kind) if h2 < 1 << 64 else (h1 + 1, 0, below_bytes, below_rows, kind)


def histogram_sort(docs: DataFrame, shards: int = 24, runs: int = 960, tolerance: float = 1e-3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Puts every row into shards 0 to ``shards - 1`` of near equal bytes; slots count each shard's rows from 0 in key order.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law).
    Null text: size 8 and the crc of no bytes. Null and repeated keys: ordinary rows. Equal rows: any order, each its own slot.
    Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    keys = cut(sort_keys(docs, key, text))
    found, total = splitters(keys, shards, runs, tolerance)
    places, shard, first = [], 0, 0
    for h1, h2, _, rows, kind in found:
        if kind == "shard":
            shard, first = shard + 1, rows
        if h1 < 1 << 64:
            places.append((h1, h2, shard, rows - first))
    # the boundaries by the top bits of h1: a row looks only at those of its own prefix, and starts from the last one before
    by: dict[int, list] = defaultdict(list)
    for x in places:
        by[_prefix(x[0], FIRST_BITS)].append(x)
    # flipping the top bit makes a signed comparison order unsigned values
    flip = lambda v: _signed(v ^ 1 << 63)
    rows, last, run = [], (0, 0, 0), 0
    for p in range(1 << FIRST_BITS):
        inside = []
        for h1, h2, s, slot in by.get(p, ()):
            run += 1
            inside.append((flip(h1), flip(h2), run, s, slot))
        rows.append((p, (-(1 << 63), -(1 << 63), *last), inside))
        if inside:
            last = inside[-1][2:]
    cell = "struct<a:long,b:long,run:int,shard:int,base:long>"
    table = spark.createDataFrame(rows, f"p long, before {cell}, inside array<{cell}>")
    a, b = (F.col(c).bitwiseXOR(F.lit(-(1 << 63)).cast("long")) for c in ("h1", "h2"))
    placed = (
        keys.withColumns({"a": a, "b": b, "p": F.shiftrightunsigned("h1", 64 - FIRST_BITS)})
        .join(F.broadcast(table), "p")
        .withColumn("at", F.coalesce(F.try_element_at(F.filter("inside", lambda x: (x["a"] < F.col("a")) | ((x["a"] == F.col("a")) & (x["b"] <= F.col("b")))), F.lit(-1)), F.col("before")))
        .select("doc_id", "size", "text_crc32", "a", "b", F.col("at.run").alias("run"), F.col("at.shard").alias("shard"), F.col("at.base").alias("base"))
    )
    order = Window.partitionBy("run").orderBy("a", "b", "doc_id")
    return placed.withColumn("slot", F.col("base") + F.row_number().over(order) - 1).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
