"""Gates: which charts, endpoints and records may go on, and why not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolane.functions.scalars import first_reason


def eligibility_reason(segments: Column, one_tempo: Column, one_meter: Column, meter: Column, notes: Column, on_grid: Column) -> Column:
    """The first rule of the simple gate that a chart fails; null for one that passes."""
    return first_reason(
        ("no_timing", segments == 0), ("variable_bpm", ~one_tempo), ("variable_meter", ~one_meter), ("meter_not_4", meter != 4), ("no_notes", notes == 0), ("invalid_grid", ~on_grid),
    )


def gate_reason(parse: Column, notes: Column, redline: Column, has_audio: Column, spliced: Column, decodes: Column, structure: Column) -> Column:
    """The first reason of the full gate, in the order of cost: text, notes, tempo lines, audio there, spliced, decodable, structure.

    ``parse``, ``redline`` and ``structure`` are reasons themselves, or null. Structure is told only of decodable audio.
    """
    return F.coalesce(parse, F.when(notes == 0, "no_notes"), redline, F.when(~has_audio, "missing_audio"), F.when(spliced, "spliced_timeline"), F.when(~decodes, "decode_failed"), structure)


def outside_audio(endpoints: DataFrame, lengths: DataFrame, chart: str, t: str, length: str) -> DataFrame:
    """(chart, outside): endpoints before 0 or not before the audio's end, of charts that have any."""
    rows = endpoints.select(chart, t).join(lengths.select(chart, length), chart)
    return rows.groupBy(chart).agg(F.count_if((F.col(t) < 0) | (F.col(t) >= F.col(length))).alias("outside")).filter("outside > 0")


def hold_checks(endpoints: DataFrame, by: list[str], lane: str, cell: str, kind: str, hold: str) -> DataFrame:
    """(by..., reason, n): holds without both ends, tails not on a later cell than their head, and lanes hit twice in a cell.

    ``kind`` is tap, start or end; ``hold`` numbers a hold inside ``by``.
    """
    held = endpoints.filter(F.col(hold).isNotNull()).groupBy(*by, hold).agg(F.min(F.when(F.col(kind) == "start", F.col(cell))).alias("head"), F.max(F.when(F.col(kind) == "end", F.col(cell))).alias("tail"))
    reason = F.when(F.col("head").isNull() | F.col("tail").isNull(), "incomplete_hold").when(F.col("tail") <= F.col("head"), "hold_not_after_head")
    late = held.withColumn("reason", reason)
    twice = endpoints.filter(F.col(kind).isin("tap", "start")).groupBy(*by, lane, cell).agg(F.count("*").alias("hits")).filter("hits > 1").withColumn("reason", F.lit("duplicate_endpoint"))
    return late.filter("reason IS NOT NULL").select(*by, "reason").unionByName(twice.select(*by, "reason")).groupBy(*by, "reason").agg(F.count("*").alias("n"))


def set_id_mismatch(charts: DataFrame, folder: str, declared: str) -> DataFrame:
    """Charts whose declared set id isn't the number that their folder's name begins with; ids below 1 declare nothing."""
    found = F.expr(f"try_cast(regexp_extract({folder}, '^([0-9]+)', 1) AS BIGINT)")
    return charts.withColumn("folder_id", found).filter((F.col(declared) > 0) & found.isNotNull() & (found != F.col(declared)))


def shared_work(charts: DataFrame, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Join what ``work`` makes of the distinct keys back to every chart, so charts of one audio are worked on once."""
    return charts.join(work(charts.select(key).filter(F.col(key).isNotNull()).distinct()), key, "left")


def isolated(fields: list[str], field: str, value: Column) -> list[Column]:
    """Columns of a condition with one field set and all others null."""
    if field not in fields:
        raise ValueError(f"no such field: {field}")
    return [(value if f == field else F.lit(None)).cast("double").alias(f) for f in fields]


def enters_metrics(mode: Column, validity: Column) -> Column:
    """Whether a record is scored: constrained and valid ones are; a mode that isn't known is an error when read."""
    known = F.when(mode == "constrained", F.coalesce(validity == "valid", F.lit(False))).when(mode == "unconstrained", F.lit(False))
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown mode: "), F.coalesce(mode, F.lit("null")))).cast("boolean"))


def scenario_pairs(records: DataFrame, chart: str, scenario: str, names: tuple[str, str], donor: str, values: list[str]) -> DataFrame:
    """(chart, v_a, v_b..., self_draw): the two scenarios of a chart side by side, where both are there."""
    rows = records.filter(F.col(scenario).isin(*names))
    side = lambda name, v: F.max(F.when(F.col(scenario) == name, F.col(v)))
    both = rows.groupBy(chart).agg(F.count_distinct(scenario).alias("_n"), side(names[1], donor).alias("_donor"), *[side(n, v).alias(f"{v}_{s}") for v in values for n, s in zip(names, "ab", strict=True)])
    return both.filter("_n = 2").withColumn("self_draw", F.col("_donor") == F.col(chart)).drop("_n", "_donor")


def next_reference(cursors: DataFrame, references: DataFrame, trace: str, beat: str, position: str, order: str) -> DataFrame:
    """Add next_position and skipped to each cursor: the first reference of its beat at or behind it that no later cursor has
    passed over, and how many references lie between it and the cursor before.

    Cursors move forward inside a beat, so what earlier ones covered lies before the one at hand. A reference at a cursor's
    own place is ahead of it, not skipped.
    """
    ahead = Window.partitionBy(trace, beat).orderBy(F.col("_p").desc(), F.col("_ref").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(trace, beat).orderBy("_p", F.col("_ref").asc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = cursors.select(trace, beat, F.col(position).alias("_p"), F.col(order).alias(order), F.lit(False).alias("_ref")).unionByName(
        references.select(trace, beat, F.col(position).alias("_p"), F.lit(None).cast(dict(cursors.dtypes)[order]).alias(order), F.lit(True).alias("_ref")).distinct()
    )
    rows = rows.withColumn("_next", F.last(F.when(F.col("_ref"), F.col("_p")), ignorenulls=True).over(ahead)).withColumn("_seen", F.count_if("_ref").over(before))
    last = F.lag("_seen", 1, 0).over(Window.partitionBy(trace, beat).orderBy("_p", order))
    only = rows.filter(~F.col("_ref"))
    return only.select(trace, beat, F.col("_p").alias(position), order, F.col("_next").alias("next_position"), (F.col("_seen") - last).alias("skipped"))
