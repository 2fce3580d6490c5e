"""Tables written to the cluster's shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that may be broadcast.
BROADCAST_BYTES = 32 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset, a folder of our own, but only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='strandloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/strandloom-{uuid.uuid4().hex}/{label}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where the measured bytes of all rows stay within ``limit``; otherwise Spark joins by a shuffle.

    ``df`` should be a written or small source table, so that measuring is cheap. A row has 16 bytes and 8 for each
    column, and the bytes of its texts; columns of arrays and structs count by their JSON.
    """
    texts = [F.octet_length(F.col(f"`{f.name}`")) if f.dataType.simpleString() in ("string", "binary") else F.octet_length(F.to_json(F.col(f"`{f.name}`"))) for f in df.schema if f.dataType.simpleString() in ("string", "binary") or f.dataType.simpleString().startswith(("array", "struct", "map"))]
    total = F.sum(sum((F.coalesce(x, F.lit(0)) for x in texts), F.lit(0)).cast("long"))
    n, chars = df.agg(F.count("*"), total).first()
    return F.broadcast(df) if n * (16 + 8 * len(df.columns)) + (chars or 0) <= limit else df
