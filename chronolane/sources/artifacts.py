"""Versioned JSON lines, journals and frozen artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_versioned(spark: SparkSession, path: str, schema: T.StructType, kind: str, version: int) -> DataFrame:
    """Rows of a JSONL file whose header line names ``kind`` and ``version``; else none. Lines that aren't JSON are skipped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    header = F.from_json("value", "kind string, version int")
    good = lines.filter((header["kind"] == kind) & (header["version"] == version)).select("file").distinct()
    rows = lines.join(F.broadcast(good), "file", "left_semi").filter(header["kind"].isNull())
    whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return rows.select(F.from_json("value", whole, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).filter("r._corrupt IS NULL").select(*[f"r.{f.name}" for f in schema.fields])


def read_keyed(spark: SparkSession, path: str, schema: T.StructType, key: str, seq: str, version: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): the last row of each key among lines of the right version, and the lines that aren't."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).select("value", F.from_json("value", whole, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    good = F.coalesce(F.col("r._corrupt").isNull() & version, F.lit(False))
    rows = lines.filter(good).select(*[f"r.{f.name}" for f in schema.fields])
    return latest(rows, [key], seq), lines.filter(~good).select("value")


def latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The latest row of each key, by a pre-aggregated maximum rather than a sort of each key's history."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), seq).alias("r")).select("r.*")


def read_journal(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """Latest record of each key in an append-only JSONL file, or in several whose names tell their order.

    A last line without its newline is left out; a complete line that isn't JSON is an error when read. A file is read by
    splits: a line's place is its split's start and its number there, and the bytes of all lines, a newline each, tell
    whether the last one has its own.
    """
    meta = [F.col(f"_metadata.{m}").alias(n) for m, n in (("file_path", "file"), ("file_size", "_size"), ("file_block_start", "_block"))]
    lines = spark.read.text(path, lineSep="\n").select(F.col("value").alias("line"), *meta).withColumn("line_no", F.struct("_block", F.monotonically_increasing_id().alias("_row")))
    ends = lines.groupBy("file").agg(F.max("line_no").alias("_last"), (F.sum(F.octet_length("line") + 1) > F.max("_size")).alias("_open"))
    torn = ends.filter("_open").select(F.col("file").alias("_file"), "_last")
    complete = lines.filter("line <> ''").join(torn, (F.col("file") == F.col("_file")) & (F.col("line_no") == F.col("_last")), "left")
    whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = complete.withColumn("r", F.from_json("line", whole, {"columnNameOfCorruptRecord": "_corrupt"}))
    # One expression that reads both sides of the join, so that no torn line is parsed in earnest.
    ok = F.when(F.col("_file").isNotNull(), F.lit(False)).when(F.col("r._corrupt").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a record: "), F.col("line"))).cast("boolean"))
    rows = parsed.filter(ok).select(*[f"r.{f.name}" for f in schema.fields], F.struct("file", "line_no").alias("_seq"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[f.name for f in schema.fields]), "_seq").alias("x")).select("x.*")


def write_once(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def freeze(df: DataFrame, path: str) -> DataFrame:
    """Write if nothing is there; what is there must be equal, as a multiset of rows."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path)
    except Exception as error:  # the reader says so in several ways
        if "PATH_NOT_FOUND" not in str(error):
            raise
        write_once(df, path)
        return spark.read.parquet(path)
    if sorted(there.dtypes) != sorted(df.dtypes) or not there.exceptAll(df.select(*there.columns)).isEmpty() or not df.select(*there.columns).exceptAll(there).isEmpty():
        raise ValueError(f"{path} holds something else")
    return there


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", "true").csv(path)


def append_absent(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and those fresh ones whose key is new."""
    return stored.unionByName(fresh.join(stored.select(*keys), keys, "left_anti"))


def merge_by_key(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows, and stored ones that none replaces."""
    return fresh.unionByName(stored.join(fresh.select(*keys), keys, "left_anti"))


def canonical_digest(df: DataFrame, order: list[str]) -> DataFrame:
    """(digest, n): of the rows as JSON, whatever their order; rows are summed as 60-bit parts of their hashes."""
    row = F.sha2(F.to_json(F.struct(*order), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)")).cast("string") for at in (1, 16, 31, 46)]
    return df.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *parts), 256).alias("digest"), F.count("*").alias("n"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def next_sequence(journal: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Add a number to each record of a key, in order."""
    return journal.withColumn("attempt", F.row_number().over(Window.partitionBy(*keys).orderBy(seq)))
