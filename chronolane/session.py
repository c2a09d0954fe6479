"""The session that the queries and tests run in, and how the package reaches the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(cores: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session: UTC, AQE on, shuffle partitions for the machine at hand."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chronolane")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once for each application, so that functions in it can be unpickled there."""
    context = spark.sparkContext
    if not getattr(context, "_chronolane_shipped", False):
        root = Path(__file__).parent
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "chronolane.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        context.addPyFile(path)
        context._chronolane_shipped = True
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir, or our own where that is unset and Spark is local (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared


#: Rows that a task sorts or groups at once.
TASK_ROWS = 250_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for ``rows``, so that a task's memory stays the same however many there are; AQE doesn't join such parts."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what follows doesn't work it out again, and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
