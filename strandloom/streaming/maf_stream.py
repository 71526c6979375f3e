"""Alignment blocks as a stream: files that arrive are parsed and filtered block by block, and adjacent blocks are joined as
soon as nothing more can join them."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandloom.session import ship
from strandloom.sources import maf


def stream_blocks(spark: SparkSession, path: str, minlength: int = 1, minscore: float = float("-inf"), files_a_trigger: int = 16) -> DataFrame:
    """A streaming DataFrame of parsed blocks without reference gaps."""
    text = spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(path, lineSep="\na")
    return maf.without_reference_gaps(maf.parse(maf.blocks_of(text), minlength, minscore))


def _islands(blocks: list[tuple]) -> Iterator[list[tuple]]:
    """Runs of blocks (position, block_id, n, species as text) that each begin where the one before ends; blocks in order."""
    run: list[tuple] = []
    for b in blocks:
        if run and run[-1][0] + run[-1][2] != b[0]:
            yield run
            run = []
        run.append(b)
    if run:
        yield run


def joined(run: Sequence[tuple], order: Sequence[str]) -> list[dict]:
    """The species of a run's blocks one after another, in ``order``; gaps where a block lacks one."""
    parts = [(n, {s["name"]: s for s in json.loads(text)}) for _, _, n, text in run]
    out = []
    for name in order:
        own = [p[name] for _, p in parts if name in p]
        if own:
            out.append({**own[0], "seq": "".join(p[name]["seq"] if name in p else "-" * n for n, p in parts)})
    return out


def stream_merged(blocks: DataFrame, order: Sequence[str], minspecies: int = 2, minlength: int = 18, slack: int = 1 << 20, quiet_ms: int = 60_000) -> DataFrame:
    """What ``maf.merge_adjacent`` gives, of a streaming DataFrame of blocks: (block_id, chr, position, species), append mode.

    For each chromosome the state holds the blocks that others may still join: a run is given out once a block has come that begins
    ``slack`` bases or more behind its end, or when the chromosome has been quiet for ``quiet_ms``. Blocks may come in any order
    within that; one that comes later is joined with what is still held, and no row is dropped. A block that comes twice while
    it is held counts once. The state is as large as the runs that are open, so a bound follows from ``slack`` where blocks have holes.
    """
    ship(blocks.sparkSession)
    ref = F.col("species")[0]
    rows = blocks.filter(F.size("species") >= minspecies).select(ref["chr"].alias("chr"), ref["position"].alias("position"), "block_id", F.length(ref["seq"]).cast("long").alias("n"), F.to_json("species").alias("species"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
        high = state.get[1] if state.exists else -(1 << 62)
        if state.hasTimedOut:
            done, left = list(_islands(held)), []
            state.remove()
        else:
            new = [b for f in frames for b in zip(f["position"].tolist(), f["block_id"].tolist(), f["n"].tolist(), f["species"].tolist(), strict=True)]
            high = max([high, *(b[0] for b in new)])
            seen = {b[1]: b for b in [*new, *held]}
            done, left = [], []
            for run in _islands(sorted(seen.values())):
                if run[-1][0] + run[-1][2] + slack <= high:
                    done.append(run)
                else:
                    left += run
            state.update((json.dumps(left), int(high)))
            state.setTimeoutDuration(quiet_ms)
        made = [(key[0], run[0][0], joined(run, order)) for run in done]
        made = [(c, p, json.dumps(s)) for c, p, s in made if s and len(s[0]["seq"]) > minlength]
        yield pd.DataFrame(made, columns=["chr", "position", "species"])

    out = rows.groupBy("chr").applyInPandasWithState(step, "chr string, position long, species string", "held string, high long", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return out.select(F.xxhash64("chr", "position").alias("block_id"), "chr", "position", F.from_json("species", f"array<{maf.SPECIES}>").alias("species"))
