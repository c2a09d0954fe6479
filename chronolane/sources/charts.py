"""Chart text files: sections, key values, timing points and notes, parsed line by line in the JVM.

Lines that can't be parsed are kept with a reason, so a caller decides whether a chart is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolane.functions.scalars import lane_of_x


def read_corpus(spark: SparkSession, root: str, suffix: str = ".osu") -> DataFrame:
    """(relpath, size, value): every chart below ``root`` as one text."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").text(root, wholetext=True)
    base = root.rstrip("/").split("://")[-1] + "/"
    path = F.url_decode(F.regexp_replace("_metadata.file_path", r"^[a-z0-9]+:/+", "/"))
    return files.select(F.substring_index(path, base, -1).alias("relpath"), F.col("_metadata.file_size").alias("size"), "value")


#: Ends a chart in a packed corpus; no chart may hold it.
RECORD = "\x1e"


def pack_corpus(files: DataFrame, path: str) -> None:
    """Write (relpath, value) as text with many charts in a file, each its path, a newline, its text and RECORD.

    A file for each chart costs a listing, a commit and a task's overhead each, which the driver pays for; here files
    follow the partitions, and readers split them between records.
    """
    clear = lambda c: F.when(F.instr(c, RECORD) > 0, F.raise_error(F.concat(F.lit("a record mark in "), F.col("relpath"))).cast("string")).otherwise(F.col(c))
    name = F.when(F.instr("relpath", "\n") > 0, F.raise_error(F.concat(F.lit("a newline in "), F.col("relpath"))).cast("string")).otherwise(clear("relpath"))
    files.select(F.concat(name, F.lit("\n"), clear("value"))).write.option("lineSep", RECORD).text(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(relpath, size, value): every chart of a packed corpus as one text, size in bytes."""
    at = F.instr("value", "\n")
    charts = spark.read.option("lineSep", RECORD).text(path).select(F.substr("value", F.lit(1), at - 1).alias("relpath"), F.substr("value", at + 1).alias("value"))
    return charts.select("relpath", F.octet_length("value").cast("long").alias("size"), "value")


def sections(files: DataFrame) -> DataFrame:
    """(relpath, section, line_no, line): trimmed lines below the last [header]; blanks and // comments are left out."""
    lines = files.select("relpath", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    header = F.when(F.col("line").rlike(r"^\[.*\]$"), F.regexp_extract("line", r"^\[(.*)\]$", 1))
    order = Window.partitionBy("relpath").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("section", F.last(header, ignorenulls=True).over(order))
    return placed.filter((F.col("line") != "") & ~F.col("line").startswith("//") & header.isNull() & F.col("section").isNotNull()).select("relpath", "section", "line_no", "line")


def key_values(parsed: DataFrame, section: str) -> DataFrame:
    """(relpath, key, value): split at the first colon; the last line of a key wins."""
    at = F.instr("line", ":")
    rows = parsed.filter((F.col("section") == section) & (at > 0)).select("relpath", "line_no", F.trim(F.substr("line", F.lit(1), at - 1)).alias("key"), F.trim(F.substr("line", at + 1)).alias("value"))
    return rows.groupBy("relpath", "key").agg(F.max_by("value", "line_no").alias("value"))


def mode_and_keys(parsed: DataFrame, mode: int = 3, keys: float = 4.0) -> DataFrame:
    """(relpath) of charts of a mode and lane count; bad or missing values are no match."""
    general = key_values(parsed, "General").filter("key = 'Mode'").select("relpath", F.expr("try_cast(value AS INT)").alias("mode"))
    size = key_values(parsed, "Difficulty").filter("key = 'CircleSize'").select("relpath", F.expr("try_cast(value AS DOUBLE)").alias("keys"))
    return general.join(size, "relpath").filter((F.col("mode") == mode) & (F.abs(F.col("keys") - keys) < 1e-6)).select("relpath")


def _field(i: int, kind: str) -> Column:
    return F.expr(f"try_cast(get(f, {i}) AS {kind})")


def timing_points(parsed: DataFrame) -> DataFrame:
    """(relpath, seq, offset_ms, beat_length_ms, meter, uninherited, reject): offsets cut to whole ms; eight fields are needed."""
    rows = parsed.filter("section = 'TimingPoints'").withColumn("f", F.split("line", ",")).withColumn("seq", F.row_number().over(Window.partitionBy("relpath").orderBy("line_no")) - 1)
    reject = F.when(F.size("f") < 8, "too few fields").when(_field(0, "DOUBLE").isNull() | _field(1, "DOUBLE").isNull() | _field(2, "INT").isNull(), "not a number")
    return rows.select("relpath", "seq", _field(0, "DOUBLE").cast("long").alias("offset_ms"), _field(1, "DOUBLE").alias("beat_length_ms"), _field(2, "INT").alias("meter"), (_field(6, "INT") == 1).alias("uninherited"), reject.alias("reject"))


def redlines(parsed: DataFrame) -> DataFrame:
    """(relpath, section, offset_ms, beat_length_ms, meter, reject): uninherited points in order of time; optional fields default."""
    rows = parsed.filter("section = 'TimingPoints'").withColumn("f", F.split("line", ","))
    red = rows.filter(F.coalesce(_field(6, "INT"), F.lit(1)) == 1)
    offset, length, meter = _field(0, "DOUBLE"), _field(1, "DOUBLE"), F.coalesce(_field(2, "INT"), F.lit(4))
    bad = F.when(offset.isNull() | F.isnan(offset) | (F.abs(offset) == float("inf")), "offset").when(length.isNull() | F.isnan(length) | (length <= 0) | (length == float("inf")), "beat length").when(meter < 1, "meter")
    out = red.select("relpath", "line_no", offset.alias("offset_ms"), length.alias("beat_length_ms"), meter.alias("meter"), bad.alias("reject"))
    order = Window.partitionBy("relpath", F.col("reject").isNull()).orderBy("offset_ms", "line_no")
    return out.withColumn("section", F.when(F.col("reject").isNull(), F.row_number().over(order) - 1)).select("relpath", "section", "offset_ms", "beat_length_ms", "meter", "reject")


def notes(parsed: DataFrame) -> DataFrame:
    """(relpath, note_id, time_ms, col, note_type, end_time_ms, reject): type bit 1 is a tap, bit 128 a hold with its end before the first colon of the sixth field."""
    rows = parsed.filter("section = 'HitObjects'").withColumn("f", F.split("line", ","))
    kind = _field(3, "INT")
    end = F.expr("try_cast(split_part(get(f, 5), ':', 1) AS DOUBLE)").cast("long")
    hold = kind.bitwiseAND(128) > 0
    reject = (
        F.when(F.size("f") < 5, "too few fields").when(_field(0, "DOUBLE").isNull() | _field(2, "DOUBLE").isNull() | kind.isNull(), "not a number")
        .when(~hold & (kind.bitwiseAND(1) == 0), "not a note").when(hold & (end.isNull() | (end <= _field(2, "DOUBLE"))), "hold end")
    )
    return rows.select(
        "relpath", F.col("line_no").alias("note_id"), _field(2, "DOUBLE").cast("long").alias("time_ms"), lane_of_x(_field(0, "DOUBLE")).alias("col"),
        F.when(hold, "hold").otherwise("tap").alias("note_type"), F.when(hold, end).alias("end_time_ms"), reject.alias("reject"),
    )


def dedupe_notes(rows: DataFrame) -> DataFrame:
    """The first line of each (time, lane, type)."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("relpath", "time_ms", "col", "note_type").orderBy("note_id"))).filter("_r = 1").drop("_r")


def endpoints(rows: DataFrame) -> DataFrame:
    """(relpath, t, col, kind, hold_id): a tap is one endpoint, a hold its start and end."""
    tap = F.array(F.struct(F.col("time_ms").alias("t"), F.lit("tap").alias("kind"), F.lit(None).cast("int").alias("hold_id")))
    hold = F.array(F.struct(F.col("time_ms").alias("t"), F.lit("start").alias("kind"), F.col("note_id").alias("hold_id")), F.struct(F.col("end_time_ms").alias("t"), F.lit("end").alias("kind"), F.col("note_id").alias("hold_id")))
    return rows.select("relpath", "col", F.inline(F.when(F.col("note_type") == "hold", hold).otherwise(tap)))


def exportable(rows: DataFrame) -> DataFrame:
    """Notes that can be written: not before 0, holds that last."""
    return rows.filter((F.col("time_ms") >= 0) & ((F.col("note_type") == "tap") | (F.col("end_time_ms") > F.col("time_ms"))))


def hit_lines(rows: DataFrame) -> DataFrame:
    """(relpath, time_ms, col, line): text lines of notes."""
    x = F.floor((F.col("col") + 0.5) * 128).cast("string")
    t = F.col("time_ms").cast("string")
    tap = F.concat_ws(",", x, F.lit("192"), t, F.lit("1"), F.lit("0"), F.lit("0:0:0:0:"))
    hold = F.concat_ws(",", x, F.lit("192"), t, F.lit("128"), F.lit("0"), F.concat(F.col("end_time_ms").cast("string"), F.lit(":0:0:0:0:")))
    return rows.select("relpath", "time_ms", "col", F.when(F.col("note_type") == "hold", hold).otherwise(tap).alias("line"))


def write_hit_lines(rows: DataFrame, path: str) -> None:
    """A folder of lines for each chart, in order of time and lane."""
    hit_lines(exportable(rows)).repartition("relpath").sortWithinPartitions("relpath", "time_ms", "col").select("relpath", "line").write.partitionBy("relpath").text(path)
