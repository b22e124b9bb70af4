"""Session defaults for local runs; a cluster brings its own session and settings."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, **conf: str) -> SparkSession:
    """The active session, or a new local one with adaptive execution on."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = (
        SparkSession.builder.master(master or f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .appName("cosmolake")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name; Spark's reader resolves the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once per context, where their path doesn't have it yet."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    to = Path(tempfile.mkdtemp(prefix="cosmolake-")) / "cosmolake.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted((root / "cosmolake").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(to))


_SHIPPED: set[str] = set()
