"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Spark's bound on the bytes of an Arrow batch.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_PACKAGE = Path(__file__).resolve().parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per context, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_strandloom_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="strandloom-"), "strandloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_PACKAGE.rglob("*")):
            if p.suffix in (".py", ".json") and p.is_file():
                z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(target)
    sc._strandloom_shipped = True
    # long texts: batches to Python are bounded by bytes, not by rows alone, unless the session says otherwise
    if not any(k == BATCH_BYTES for k, _ in sc.getConf().getAll()):
        spark.conf.set(BATCH_BYTES, "4194304")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset in a local session."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(sc, "_strandloom_shared", None) or tempfile.mkdtemp(prefix="strandloom-shared-")
        sc._strandloom_shared = root
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, so that later jobs reread files and do not recompute."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet under the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
