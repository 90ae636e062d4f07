"""Sessions, and this package's code on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent
BATCH_BYTES = 8 * 1024 * 1024
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package, wherever they run; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="tracewell-code-")
    name = os.path.join(folder, "tracewell.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    context.addPyFile(name)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one made
    here for a session on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        atexit.register(shutil.rmtree, found[len("file://") :], True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small(df: DataFrame, most: int) -> DataFrame:
    """df, to be sent to all tasks if it has at most so many rows; else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of BATCH_BYTES, or of one longer row, where the session has Spark's default of 64 MB,
    of which a worker holds several copies."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64m", "64MB", "67108864", "67108864b"):
        spark.conf.set(key, str(BATCH_BYTES))


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark
