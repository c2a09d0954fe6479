"""Motifs: n-grams of symbols and gaps, frequent ones level by level, and how two corpora's frequencies differ."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolane.session import cut

from .ranks import average_ranks
from .vocabulary import count_motifs, motif_length

#: Motifs of a level that are sent to every task.
FRONTIER = 200_000


def steps(events: DataFrame, seq: list[str], order: list[str], symbol: str, gap: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(seq..., i, symbol, gap, keep...): position, symbol and gap to the next event (null at the end)."""
    w = Window.partitionBy(*seq).orderBy(*order)
    out = events.withColumn("i", F.row_number().over(w) - 1)
    distance = F.lead(gap).over(w) - F.col(gap) if gap else F.lit(None).cast("long")
    return out.withColumn("gap", distance).select(*seq, "i", F.col(symbol).alias("symbol"), "gap", *keep)


def scope_steps(events: DataFrame, seq: list[str], order: list[str], lane: str, symbol: str, gap: str, lanes: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """steps() in three scopes at once: each lane, each hand with the right one mirrored onto the left, and the whole row."""
    half = lanes // 2
    hand = F.when(F.col(lane) < half, F.col(lane)).otherwise(lanes - 1 - F.col(lane))
    each = F.array(
        F.struct(F.lit("lane").alias("scope"), F.col(lane).cast("string").alias("part"), F.col(symbol).alias("s")),
        F.struct(F.lit("hand").alias("scope"), F.when(F.col(lane) < half, "left").otherwise("right").alias("part"), F.concat(F.col(symbol), hand.cast("string")).alias("s")),
        F.struct(F.lit("row").alias("scope"), F.lit("all").alias("part"), F.concat(F.col(symbol), F.col(lane).cast("string")).alias("s")),
    )
    rows = events.select(*seq, *[F.col(o) for o in order if o not in seq], *([F.col(gap)] if gap not in [*seq, *order] else []), *keep, F.inline(each))
    return steps(rows, [*seq, "scope", "part"], order, "s", gap, keep)


def motif_keys(stepped: DataFrame, seq: list[str], length: int) -> DataFrame:
    """(seq..., i, motif): overlapping n-grams as symbol/gap/symbol... text."""
    w = Window.partitionBy(*seq).orderBy("i")
    parts = [F.col("symbol")]
    for k in range(1, length):
        parts += [(F.lead("gap", k - 1).over(w) if k > 1 else F.col("gap")).cast("string"), F.lead("symbol", k).over(w)]
    rows = stepped.withColumn("_last", F.lead("symbol", length - 1).over(w) if length > 1 else F.col("symbol")).withColumn("motif", F.concat_ws("/", *parts))
    return rows.filter("_last IS NOT NULL").select(*seq, "i", "motif")


def motif_topk(stepped: DataFrame, seq: list[str], by: list[str], top: int, written: bool = False) -> DataFrame:
    """(by..., motif, length, n): the ``top`` most frequent motifs of any length in each scope; ties by text.

    Level by level: a motif is extended only while it is inside the current top, as no longer one can be more frequent
    than its beginning. The steps are worked out once and written, unless they are ``written`` already; levels read them,
    and end when nothing is left to extend. The frontier has at most ``top`` rows a scope; it is hinted for broadcast
    below FRONTIER rows.
    """
    spark = stepped.sparkSession
    stepped = stepped if written else cut(stepped, "steps")
    head, frontier, alive = None, None, []
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "motif"))
    for length in count(1):
        keys = motif_keys(stepped, seq, length)
        if frontier is not None:
            # Drop the last gap and symbol to find the beginning; it must have been in the top.
            keys = keys.withColumn("_begin", F.regexp_replace("motif", "/[^/]*/[^/]*$", "")).join(F.broadcast(frontier) if len(alive) <= FRONTIER else frontier, [*by, "_begin"], "left_semi").drop("_begin")
        counts = keys.groupBy(*by, "motif").agg(F.count("*").alias("n")).withColumn("length", F.lit(length))
        both = counts if head is None else head.unionByName(counts)
        rows = both.withColumn("_r", rank).filter(F.col("_r") <= top).drop("_r").collect()
        head = spark.createDataFrame(rows, both.schema)
        alive = [r for r in rows if r["length"] == length]
        if not alive:
            break
        frontier = spark.createDataFrame(alive, both.schema).select(*by, F.col("motif").alias("_begin"))
    return head


def vocabulary_counts(stepped: DataFrame, seq: list[str], vocabulary: DataFrame, lengths: list[int]) -> DataFrame:
    """(motif, n) for the motifs of a frozen list that have one of ``lengths``, zeros kept for all; one pass over the steps."""
    listed = vocabulary.select(F.lit("all").alias("scope"), "motif").filter(motif_length("motif").isin(lengths))
    counts = count_motifs(stepped.withColumns({"scope": F.lit("all"), "part": F.lit("all")}), seq, listed).select("motif", "n")
    return vocabulary.join(counts, "motif", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def length_profile(stepped: DataFrame, seq: list[str], by: list[str], longest: int) -> DataFrame:
    """(by..., length, spans): number of spans of each length, from sequence sizes alone."""
    sizes = stepped.groupBy(*dict.fromkeys([*by, *seq])).agg(F.count("*").alias("size"))
    each = sizes.select(*by, "size", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("length"))
    return each.groupBy(*by, "length").agg(F.sum(F.greatest(F.lit(0), F.col("size") - F.col("length") + 1)).alias("spans"))


def frequency_distance(left: DataFrame, right: DataFrame, key: str, n: str) -> DataFrame:
    """size, mae, rmse, spearman and the largest gap between two vocabularies' frequencies; null if either has no observation.

    Ranks are dealt by value; the whole report is vocabulary.distance_report.
    """
    both = left.select(key, F.col(n).alias("a")).join(right.select(key, F.col(n).alias("b")), key, "full").fillna(0, ["a", "b"])
    both = cut(both, "frequencies")  # sums, ranks and gaps read it
    a, b = both.agg(F.sum("a"), F.sum("b")).first()
    shares = both.withColumn("x", F.try_divide("a", F.lit(a or 0))).withColumn("y", F.try_divide("b", F.lit(b or 0)))
    d = F.col("y") - F.col("x")
    ranked = average_ranks(shares, [], {"rx": "x", "ry": "y"})
    spearman = F.when((F.var_pop("rx") > 0) & (F.var_pop("ry") > 0), F.corr("rx", "ry"))
    gap = F.min_by(key, F.when(d.isNotNull(), F.struct(-F.round(F.abs(d), 12), F.col(key))))
    return ranked.agg(F.count("*").alias("size"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.when(F.count(d) > 0, spearman).alias("spearman"), gap.alias("largest_gap"))


def window_audit(stepped: DataFrame, seq: list[str], section: str, lengths: list[int]) -> DataFrame:
    """(length, spans, crossing): spans of each length and those that cross a section."""
    w = Window.partitionBy(*seq).orderBy("i")
    out = None
    for length in lengths:
        last = F.lead(section, length - 1).over(w) if length > 1 else F.col(section)
        rows = stepped.withColumn("_l", last).filter("_l IS NOT NULL").agg(F.count("*").alias("spans"), F.count_if(F.col("_l") != F.col(section)).alias("crossing")).select(F.lit(length).alias("length"), "spans", "crossing")
        out = rows if out is None else out.unionByName(rows)
    return out
