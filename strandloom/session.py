"""Spark sessions with the settings the operators are laid out for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


#: Arrow batches end at so many bytes; by rows alone, long texts would fill the memory of Python workers.
ARROW, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)


def session(name: str = "strandloom", master: str | None = None, **conf) -> SparkSession:
    """Adaptive execution with skew joins; shuffle partitions are many and coalesced at run time."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {ARROW: ARROW_BYTES, "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": os.environ.get("SPARK_UI", "false")}
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make a session fit for the operators that run Python: Arrow batches are bounded by bytes (for all queries of the session from then
    on, unless it has a bound of its own), and the package is importable by the session's workers (sent once as a zip file unless the environment's PYTHONPATH already leads to it)."""
    import tempfile
    import zipfile
    from pathlib import Path

    if spark.conf.get(ARROW, None) in (None, "-1", f"{64 << 20}b"):  # Spark's own
        spark.conf.set(ARROW, ARROW_BYTES)
    package = Path(__file__).resolve().parent
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if package.parent in known or context.applicationId in _SHIPPED:
        return spark
    archive = Path(tempfile.mkdtemp(prefix="strandloom-")) / "strandloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
    return spark
