"""Row patterns: what each row does against the one before, core recognisers and clusters by tempo."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolane.session import cut


def row_primitives(rows: DataFrame, chart: str, t: str, row: str, lanes: int = 4) -> DataFrame:
    """(chart, t, delta, notes, jacks, direction, roll, raw, heads, bodies, tails and the lanes of each), from a chart's second row on.

    jacks: lanes shared with the last row that had notes. delta is four times the gap. The previous row with notes is
    looked up by a window, so one sort of the chart serves all columns.
    """
    digits = F.split(row, "")
    at = lambda codes: F.filter(F.sequence(F.lit(0), F.lit(lanes - 1)), lambda k: F.element_at(digits, k + 1).isin(*codes))
    each = rows.withColumn("raw", at(("1", "2"))).withColumn("heads", F.size(at(("2",)))).withColumn("bodies", F.size(at(("3",)))).withColumn("tails", F.size(at(("4",))))
    each = each.filter((F.size("raw") > 0) | (F.col("bodies") > 0) | (F.col("tails") > 0))
    order = Window.partitionBy(chart).orderBy(t)
    prev = F.last(F.when(F.size("raw") > 0, F.col("raw")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("_n", F.row_number().over(order)).withColumn("_prev", prev).withColumn("delta", (F.col(t) - F.lag(t).over(order)) * 4.0)
    left, right = F.array_min("raw") - F.array_min("_prev"), F.array_max("raw") - F.array_max("_prev")
    direction = (
        F.when((left > 0) & (right > 0), "right").when(left > 0, "inwards").when((left < 0) & (right < 0), "left").when(left < 0, "outwards")
        .when(right < 0, "inwards").when(right > 0, "outwards").otherwise("none")
    )
    has = (F.size("raw") > 0) & F.col("_prev").isNotNull()
    return each.filter("_n > 1").select(
        chart, t, "delta", F.size("raw").alias("notes"), F.when(has, F.size(F.array_intersect("raw", "_prev"))).otherwise(0).alias("jacks"),
        F.when(has, direction).otherwise("none").alias("direction"),
        F.coalesce(has & ((F.array_min("_prev") > F.array_max("raw")) | (F.array_max("_prev") < F.array_min("raw"))), F.lit(False)).alias("roll"),
        "raw", "heads", "bodies", "tails", *[at((code,)).alias(f"{name}_lanes") for code, name in (("1", "tap"), ("2", "head"), ("3", "body"), ("4", "tail"))],
    )


def core_patterns(primitives: DataFrame, chart: str, t: str) -> DataFrame:
    """(chart, t, pattern, length): every core pattern that starts at a row; recognisers look ahead by lead."""
    w = Window.partitionBy(chart).orderBy(t)
    ahead = lambda c, k: F.lead(c, k).over(w) if k else F.col(c)
    all_of = lambda tests: reduce(lambda a, b: a & b, tests)
    single = all_of([(ahead("notes", k) == 1) & (ahead("jacks", k) == 0) for k in range(5)])
    no_jacks = all_of([ahead("jacks", k) == 0 for k in range(4)])
    long_note = (F.col("heads") > 0) | (F.col("bodies") > 0) | (F.col("tails") > 0)
    tests = {
        "stream": (single & (F.col("raw")[0] != ahead("raw", 4)[0]), 5),
        "jacks": ((F.col("jacks") > 1) & (F.col("delta") < 2000), 1),
        "chordstream": ((F.col("notes") > 1) & no_jacks & ((ahead("notes", 1) > 1) | (ahead("notes", 2) > 1) | (ahead("notes", 3) > 1)), 4),
        "coordination": (long_note, 1),
        "density": (F.col("heads") > 0, 1),
        "wildcard": (F.col("heads") > 0, 1),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("pattern"), F.lit(n).alias("length"))) for name, (test, n) in tests.items()]), lambda x: x.isNotNull())
    return primitives.withColumn("_f", found).select(chart, t, F.inline("_f"))


def found_patterns(primitives: DataFrame, chart: str, t: str, stable: float = 5.0, specific: DataFrame | None = None) -> DataFrame:
    """(chart, pattern, name, start, end, ms_per_beat, mixed): core patterns with their span, mean delta and whether it varies.

    ``specific`` has the sub-patterns (chart, t, core, name, length); a core pattern counts once for each of its own at a
    row, over the longer of both lengths, and once without a name where it has none. Jacks last half their delta at
    least; an inverse has no tempo.
    """
    w = Window.partitionBy(chart).orderBy(t)
    rows = primitives.withColumn("_deltas", F.collect_list("delta").over(w.rowsBetween(0, 4))).withColumn("_times", F.collect_list(t).over(w.rowsBetween(0, 5)))
    labels = core_patterns(primitives, chart, t)
    if specific is None:
        labels = labels.withColumn("name", F.lit(None).cast("string"))
    else:
        own = specific.select(chart, t, F.col("core").alias("pattern"), "name", F.col("length").alias("_own"))
        labels = labels.join(own, [chart, t, "pattern"], "left").withColumn("length", F.greatest("length", F.coalesce("_own", F.lit(0)))).drop("_own")
    joined = labels.join(rows.select(chart, t, "delta", "_deltas", "_times"), [chart, t])
    deltas = F.slice("_deltas", 1, F.col("length"))
    mean = F.aggregate(deltas, F.lit(0.0), lambda a, x: a + x) / F.size(deltas)
    end = F.coalesce(F.get("_times", F.col("length")), F.element_at("_times", -1)).cast("double")
    end = F.when(F.col("pattern") == "jacks", F.greatest(F.col(t) + F.col("delta") * 0.5, end)).otherwise(end)
    tempo = F.when(F.coalesce(F.col("name") == "Inverse", F.lit(False)), 0.0).otherwise(F.col("mean"))
    return joined.withColumn("mean", mean).select(chart, "pattern", "name", F.col(t).cast("double").alias("start"), end.alias("end"), tempo.alias("ms_per_beat"), (~F.forall(deltas, lambda d: F.abs(d - F.col("mean")) < stable)).alias("mixed"))


def tempo_clusters(found: DataFrame, chart: str, threshold: float = 5.0) -> DataFrame:
    """Add bpm: patterns join the first cluster within ``threshold`` of its founder; mixed ones cluster by pattern.

    Which cluster comes first depends on order, so a chart's patterns are folded in order of start and pattern. The fold
    reads sorted batches and holds the founders alone, which tempos bound; a cluster's mean is an aggregate of its own.
    """
    order = [c for c in ("start", "pattern", "end", "ms_per_beat", "name") if c in found.columns]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, founders = object(), []
        for batch in batches:
            own = []
            for c, pattern, beat, mixed in zip(*(batch.column(x).to_pylist() for x in (chart, "pattern", "ms_per_beat", "mixed")), strict=True):
                if c != at:
                    at, founders = c, []
                if mixed:
                    own.append(pattern)
                    continue
                k = next((i for i, f in enumerate(founders) if abs(f - beat) < threshold), len(founders))
                founders += [beat] if k == len(founders) else []
                own.append(str(k))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.string())], [*batch.schema.names, "_cluster"])

    dealt = found.repartition(chart).sortWithinPartitions(chart, *[F.asc_nulls_last(c) for c in order])
    rows = dealt.mapInArrow(number, T.StructType([*found.schema.fields, T.StructField("_cluster", T.StringType())]))
    mean = F.avg("ms_per_beat").over(Window.partitionBy(chart, "_cluster"))
    return rows.withColumn("_mean", mean).withColumn("bpm", F.when(F.col("_mean") > 0, F.rint(F.try_divide(F.lit(60000.0), "_mean"))).otherwise(0).cast("long")).drop("_cluster", "_mean")


#: How much a core pattern weighs, what its sub-patterns weigh by mode where that differs from the core's,
#: and the factors of cores that are foreign to a mode.
CORE_WEIGHT = {"stream": 1 / 3, "chordstream": 0.65, "jacks": 0.9, "coordination": 0.75, "density": 0.9, "wildcard": 1.0}
NAME_WEIGHT = {
    "RC": {"Column Lock": 1.5, "Release": 0.73, "Shield": 0.8, "JS Density": 1.0, "HS Density": 1.0, "DS Density": 1.0, "LCS Density": 1.0, "DCS Density": 1.0, "Inverse": 1.3, "Jacky WC": 0.55, "Speedy WC": 0.8},
    "LN": {"Column Lock": 1.5, "Release": 1.0, "Shield": 0.8, "Inverse": 1.5, "Jacky WC": 0.55, "Speedy WC": 0.8},
    "HB": {"Column Lock": 1.5, "Release": 0.3, "Shield": 0.8, "Inverse": 0.0, "Jacky WC": 0.65, "Speedy WC": 0.45},
    "Mix": {"Column Lock": 1.5, "Release": 0.3, "Shield": 0.8, "Inverse": 0.0, "Jacky WC": 0.45, "Speedy WC": 0.45},
}
HELD_CORES, RC_IN_LN, LN_IN_RC, RELEASE_BESIDE = ("coordination", "density", "wildcard"), 0.3, 0.0, 0.8


def rating(pattern: Column, name: Column, mode: Column) -> Column:
    """Weight of a core pattern with its commonest sub-pattern in a chart of a mode."""
    core = F.element_at(F.create_map(*[F.lit(x) for kv in CORE_WEIGHT.items() for x in kv]), pattern)
    own = core
    for m, weights in NAME_WEIGHT.items():
        for n, weight in weights.items():
            own = F.when((mode == m) & (name == n), weight).otherwise(own)
    return F.when((mode == "RC") & pattern.isin(*HELD_CORES), own * LN_IN_RC).when((mode == "LN") & ~pattern.isin(*HELD_CORES), own * RC_IN_LN).otherwise(own)


def cluster_summary(clustered: DataFrame, chart: str, modes: DataFrame, top: int = 3) -> DataFrame:
    """(chart, pattern, mixed, bpm, amount, names, importance): the clusters that describe a chart.

    ``modes`` has (chart, mode). Charts of mode RC have no clusters of holds; slow ones (up to 25 bpm, but 0) go, and
    those with a faster one of their pattern more than twice as long. Of each pattern the ``top`` longest stay.
    importance is amount times rating times bpm; names are shares of the sub-patterns, the commonest first.
    """
    from .timeline import interval_amount

    keys = [chart, "pattern", "mixed", "bpm"]
    # Written once: amounts, totals and names read them, and each would fold the clusters anew.
    rows = cut(clustered.join(modes, chart).filter((F.col("mode") != "RC") | ~F.col("pattern").isin(*HELD_CORES)), "clusters")
    amounts = interval_amount(rows, keys, "start", "end", "end")
    total = rows.groupBy(*keys, "mode").agg(F.count("*").alias("_n"))
    named = rows.filter("name IS NOT NULL").groupBy(*keys, "name").agg(F.count("*").alias("_k")).join(total, keys)
    share = F.struct((-F.col("_k") / F.col("_n")).alias("s"), "name")
    names = named.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(share)), lambda x: F.struct(x["name"].alias("name"), (-x["s"]).alias("share"))).alias("names"))
    none = F.array().cast("array<struct<name:string,share:double>>")
    out = amounts.join(total.drop("_n"), keys).join(names, keys, "left").withColumn("names", F.coalesce("names", none)).filter("bpm > 25 OR bpm = 0")
    beside = F.max(F.col("pattern").isin("density", "wildcard").cast("int")).over(Window.partitionBy(chart)) > 0
    weight = rating(F.col("pattern"), F.get("names", F.lit(0))["name"], F.col("mode"))
    weight = F.when(beside & F.exists("names", lambda x: x["name"] == "Release"), weight * RELEASE_BESIDE).otherwise(weight)
    faster = F.max("amount").over(Window.partitionBy(chart, "pattern").orderBy("bpm").rangeBetween(1, Window.unboundedFollowing))
    kept = out.withColumn("importance", F.col("amount") * weight * F.col("bpm")).withColumn("_faster", faster).filter("_faster IS NULL OR _faster * 0.5 <= amount")
    rank = F.row_number().over(Window.partitionBy(chart, "pattern").orderBy(F.desc("amount"), "bpm", "mixed"))
    return kept.withColumn("_r", rank).filter(F.col("_r") <= top).drop("_r", "_faster", "mode")


def categorise(summary: DataFrame, chart: str, least: float = 0.05, second: float = 0.4, charts: DataFrame | None = None) -> DataFrame:
    """(chart, category): named after the most important cluster, by its commonest sub-pattern or its pattern, with Tech if mixed.

    Where no sub-pattern has more than ``least``, a cluster of jumpstreams, then handstreams, is named after both if the
    second is more than ``second`` of the first. ``charts`` names the charts to report: one without clusters is Uncategorised.
    """
    first = F.max_by(F.struct("pattern", "names", "mixed"), F.struct("importance", "amount", "pattern", F.col("bpm")))
    top = F.get(F.col("_lead.names"), F.lit(0))
    after = F.get(F.col("_lead.names"), F.lit(1))
    both = (top["name"] == "Jumpstream") & (after["name"] == "Handstream") & (F.try_divide(after["share"], top["share"]) > second)
    name = F.when(F.coalesce(top["share"] > least, F.lit(False)), top["name"]).when(F.coalesce(both, F.lit(False)), "Jumpstream/Handstream").otherwise(F.initcap("_lead.pattern"))
    named = summary.groupBy(chart).agg(first.alias("_lead")).select(chart, F.concat(name, F.when(F.col("_lead.mixed"), " Tech").otherwise("")).alias("category"))
    return named if charts is None else charts.select(chart).distinct().join(named, chart, "left").withColumn("category", F.coalesce("category", F.lit("Uncategorised")))


def cluster_card(summary: DataFrame, chart: str, durations: DataFrame, duration: str, rows: int = 6, least: float = 8.0) -> DataFrame:
    """(chart, place, label, width, amount_share, names): a card of a chart's first clusters, widths against the largest."""
    place = F.row_number().over(Window.partitionBy(chart).orderBy(F.desc("importance"), F.desc("amount"), "pattern", "bpm", "mixed"))
    shown = summary.withColumn("place", place).filter(F.col("place") <= rows).join(durations, chart)
    largest = F.max("amount").over(Window.partitionBy(chart))
    name = F.coalesce(F.get("names", F.lit(0))["name"], F.initcap("pattern"))
    label = F.when(F.col("mixed"), F.concat(F.lit("~"), F.col("bpm").cast("string"), F.lit("BPM Mixed "), name)).otherwise(F.concat(F.col("bpm").cast("string"), F.lit("BPM "), name))
    of = lambda whole: F.when(whole > 0, F.col("amount") / whole * 100).otherwise(F.col("amount") * 100)
    two = F.array_join(F.transform(F.slice("names", 1, 2), lambda x: F.format_string("%s (%.1f%%)", x["name"], x["share"] * 100)), ", ")
    return shown.select(chart, "place", label.alias("label"), F.greatest(F.lit(least), of(largest)).alias("width"), F.greatest(F.lit(0.0), of(F.col(duration))).alias("amount_share"), F.when(F.size("names") > 0, two).otherwise("-").alias("names"))


def speed_time(changes: DataFrame, tempos: DataFrame, spans: DataFrame, chart: str, t: str, value: str, length: str, eps: float = 0.05, amount: float = 2000.0) -> DataFrame:
    """(chart, speed_time): ms of a chart (first, last) at another scroll speed than 1; beyond ``amount`` where tempo jumps.

    Tempo jumps below 30 or above 350 beats a minute, or by a factor of 3 from one segment to the next; a segment of no
    length is a jump in itself.
    """
    order = Window.partitionBy(chart).orderBy(t)
    rows = changes.join(spans, chart).withColumn("_to", F.coalesce(F.lead(t).over(order), F.col("last")))
    off = F.isnan(value) | (F.abs(F.col(value) - 1) > eps)
    total = rows.groupBy(chart).agg(F.sum(F.when(off, F.col("_to") - F.col(t)).otherwise(0.0)).alias("_time"))
    bpm, before = F.try_divide(F.lit(60000.0), length), F.lag(length).over(order)
    jump = (F.col(length) <= 0) | F.coalesce((bpm <= 30) | (bpm >= 350), F.lit(False)) | F.coalesce(F.greatest(F.try_divide(before, length), F.try_divide(F.col(length), before)) >= 3, F.lit(False))
    jumps = tempos.withColumn("_jump", F.coalesce(jump, F.lit(False))).groupBy(chart).agg(F.bool_or("_jump").alias("_jump"))
    time = F.coalesce("_time", F.lit(0.0))
    return spans.join(total, chart, "left").join(jumps, chart, "left").select(chart, F.when(F.coalesce("_jump", F.lit(False)), F.greatest(time, F.lit(amount + 1))).otherwise(time).alias("speed_time"))


def clean_steps(series: DataFrame, chart: str, t: str, value: str, seq: str, eps: float = 0.005) -> DataFrame:
    """(chart, t, value): the last value of each time, without steps of at most eps from the last one kept; the first is held against 1.

    What is kept depends on what was kept before, so a chart's distinct times are folded in order, over sorted batches:
    a task holds the last kept value, however long a chart is.
    """
    last = series.groupBy(chart, t).agg(F.max_by(value, seq).cast("double").alias(value))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before = object(), 1.0
        for batch in batches:
            kept = []
            for c, v in zip(batch.column(chart).to_pylist(), batch.column(value).to_pylist(), strict=True):
                if c != at:
                    at, before = c, 1.0
                kept.append(v is not None and abs(v - before) > eps)
                before = v if kept[-1] else before
            yield batch.filter(pa.array(kept, pa.bool_()))

    return last.repartition(chart).sortWithinPartitions(chart, t).mapInArrow(keep, last.schema)


def core_distribution(summary: DataFrame, chart: str, charts: DataFrame | None = None) -> DataFrame:
    """(chart, pattern, importance, share): importance over the chart's total for each of the core patterns, 0 for absent ones.

    ``charts`` names the charts to report, as one without clusters has six zeros; without it those of ``summary``.
    """
    names = F.explode(F.array(*map(F.lit, CORE_WEIGHT))).alias("pattern")
    every = (summary if charts is None else charts).select(chart).distinct().select(chart, names)
    sums = every.join(summary.groupBy(chart, "pattern").agg(F.sum("importance").alias("importance")), [chart, "pattern"], "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))
    total = F.sum("importance").over(Window.partitionBy(chart))
    return sums.withColumn("share", F.when(total > 0, F.col("importance") / total).otherwise(0.0))


def hold_ratios(rows: DataFrame, chart: str, row: str) -> DataFrame:
    """(chart, ln_ratio, hybrid_ratio, mode): share of holds among notes, of rows with both kinds, and RC, LN, HB or Mix."""
    taps, holds = F.regexp_count(row, F.lit("1")), F.regexp_count(row, F.lit("2"))
    notes = F.sum(taps + holds)
    out = rows.groupBy(chart).agg(F.when(notes > 0, F.sum(holds) / notes).otherwise(0.0).alias("ln_ratio"), F.avg(((taps > 0) & (holds > 0)).cast("double")).alias("hybrid_ratio"))
    return out.withColumn("mode", F.when(F.col("ln_ratio") <= 0.1, "RC").when(F.col("ln_ratio") >= 0.9, "LN").when(F.col("hybrid_ratio") >= 0.1, "HB").otherwise("Mix"))


class Ahead:
    """The rows from a row on, as columns: ``w.notes(k)`` is k rows later."""

    def __init__(self, chart: str, t: str) -> None:
        self.window = Window.partitionBy(chart).orderBy(t)

    def __getattr__(self, name: str):
        return lambda k=0: F.lead(name, k).over(self.window) if k else F.col(name)

    def every(self, name: str, value: object, *rows: int):
        return reduce(lambda a, b: a & b, [getattr(self, name)(k) == value for k in rows])

    def shared(self, *rows: int):
        """Lanes that all these rows play."""
        return reduce(F.array_intersect, [self.raw(k) for k in rows])


#: Sub-patterns of four lanes: core pattern, name, rows that they span, and the test on the rows ahead.
SPECIFIC = (
    ("stream", "Rolls", 3, lambda w: w.every("notes", 1, 0, 1, 2) & (w.every("direction", "left", 0, 1, 2) | w.every("direction", "right", 0, 1, 2))),
    ("stream", "Trills", 4, lambda w: w.every("jacks", 0, 1, 2, 3) & (w.raw(0) == w.raw(2)) & (w.raw(1) == w.raw(3))),
    ("stream", "Minitrills", 4, lambda w: w.every("jacks", 0, 1, 2) & (w.raw(0) == w.raw(2)) & (w.raw(1) != w.raw(3))),
    ("chordstream", "Handstream", 4, lambda w: (w.notes() == 3) & w.every("jacks", 0, 0, 1, 2, 3)),
    ("chordstream", "Split Trill", 3, lambda w: w.every("notes", 2, 0, 1, 2) & w.every("jacks", 0, 1, 2) & w.every("roll", False, 1, 2)),
    ("chordstream", "Jumptrill", 4, lambda w: w.every("notes", 2, 0, 1, 2, 3) & w.every("roll", True, 1, 2, 3)),
    ("chordstream", "Jumpstream", 4, lambda w: (w.notes() == 2) & (w.notes(1) == 1) & (w.notes(2) < 3) & (w.notes(3) < 3) & w.every("jacks", 0, 0, 1, 2, 3)),
    ("jacks", "Longjacks", 5, lambda w: reduce(lambda a, b: a & b, [w.jacks(k) > 0 for k in range(5)]) & (F.size(w.shared(0, 1, 2, 3, 4)) > 0)),
    ("jacks", "Quadstream", 4, lambda w: (w.notes() == 4) & w.every("jacks", 0, 2, 3)),
    ("jacks", "Gluts", 3, lambda w: w.every("jacks", 1, 1, 2) & (F.size(w.shared(0, 1, 2)) == 0)),
    ("jacks", "Chordjacks", 2, lambda w: (w.notes() > 2) & (w.notes(1) > 1) & (w.jacks(1) >= 1) & ((w.notes(1) < w.notes()) | (w.jacks(1) < w.notes(1)))),
    ("jacks", "Minijacks", 2, lambda w: (w.jacks() > 0) & (w.jacks(1) == 0)),
)


#: Sub-patterns of seven lanes, and of other counts.
_CHORDS = (
    ("chordstream", "Double Stream", 2, lambda w: w.every("notes", 2, 0, 1) & (w.jacks(1) == 0) & ~w.roll(1)),
    ("chordstream", "Dense Chordstream", 2, lambda w: (w.notes() > 1) & (w.notes(1) > 1) & (w.jacks(1) == 0)),
    ("chordstream", "Light Chordstream", 2, lambda w: (w.notes() > 1) & (w.notes(1) == 1) & (w.jacks(1) == 0)),
)
_JACKS = tuple(rule for rule in SPECIFIC if rule[1] in ("Longjacks", "Chordjacks", "Minijacks"))
SEVEN = (("chordstream", "Brackets", 3, lambda w: (w.notes() > 2) & (w.notes(1) > 2) & (w.notes(2) > 2) & w.every("roll", False, 1, 2) & w.every("jacks", 0, 1, 2) & (w.notes() + w.notes(1) + w.notes(2) > 9)), *_CHORDS, *_JACKS)
OTHER = (("chordstream", "Chord Rolls", 3, lambda w: (w.notes() > 1) & (w.notes(1) > 1) & (w.notes(2) > 1) & w.every("roll", True, 1, 2) & (w.every("direction", "left", 1, 2) | w.every("direction", "right", 1, 2))), *_CHORDS, *_JACKS)


def specific_patterns(primitives: DataFrame, chart: str, t: str, rules: tuple = SPECIFIC) -> DataFrame:
    """(chart, t, core, name, length): every sub-pattern that starts at a row. Rules are data; a caller may pass more."""
    w = Ahead(chart, t)
    found = [F.when(F.coalesce(test(w), F.lit(False)), F.struct(F.lit(core).alias("core"), F.lit(name).alias("name"), F.lit(n).alias("length"))) for core, name, n, test in rules]
    return primitives.withColumn("_f", F.filter(F.array(*found), lambda x: x.isNotNull())).select(chart, t, F.inline("_f"))
