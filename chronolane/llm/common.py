"""What the training-data operators share: table access, the shared scratch folder, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast below this many bytes, its counted rows times what a row takes; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20
#: Rows and bytes of an Arrow batch of whole texts.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: The setting by which Spark removes a query's shuffle files when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir, or our own where that is unset and Spark is local (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared


#: Paths that write_cut wrote and that drop_cuts has not removed.
_CUTS: list[str] = []


def cuts() -> int:
    """How many tables write_cut has left so far: a mark for drop_cuts."""
    return len(_CUTS)


def drop_cuts(spark: SparkSession, since: int) -> None:
    """Remove what write_cut wrote since a mark, but for the last. What still reads the removed tables fails from then on."""
    remove_cuts(spark, _CUTS[since:-1])


def cuts_since(mark: int) -> list[str]:
    """Paths that write_cut wrote since a mark."""
    return _CUTS[mark:]


def remove_cuts(spark: SparkSession, paths: list[str]) -> None:
    """Remove some of these paths; what is gone already is no error."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        if path in _CUTS:
            _CUTS.remove(path)


def unread(paths: list[str], *read: DataFrame) -> list[str]:
    """Those of these paths that none of the tables ``read`` comes from."""
    folders = {file.rpartition("/")[0].rpartition("/")[2] for df in read for file in df.inputFiles()}
    return [path for path in paths if path.rpartition("/")[2] not in folders]


def drop_unread(spark: SparkSession, since: int, *read: DataFrame) -> None:
    """Remove what write_cut wrote since a mark, but for what ``read`` comes from."""
    remove_cuts(spark, unread(_CUTS[since:], *read))


def write_cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors.

    The shuffle files of this write go with its end; else they would stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    _CUTS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """Let texts go to Python a few MB at a time, so that a task's memory doesn't follow its rows. Sets the session's Arrow limits."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(BATCH_ROWS, int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return df


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """Hint a broadcast if the counted rows stay under BROADCAST_BYTES, else leave the join to shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
