"""Time grids: tempo segments, beats, as-of look-ups, intervals and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolane.functions.scalars import EPS

#: Fixed value: distances within this are equal.
TIE = 1e-12
#: The largest double below 1: a phase never reaches the next beat.
BELOW_ONE = 0.9999999999999999


def with_bounds(segments: DataFrame, chart: str, offset: str) -> DataFrame:
    """Add section, from_ms and to_ms: where a segment is in force; the first one also before its start."""
    order = Window.partitionBy(chart).orderBy(offset)
    section = F.row_number().over(order) - 1
    return segments.withColumn("section", section).withColumn("from_ms", F.when(F.col("section") == 0, float("-inf")).otherwise(F.col(offset).cast("double"))).withColumn("to_ms", F.coalesce(F.lead(offset).over(order).cast("double"), F.lit(float("inf"))))


def asof(points: DataFrame, states: DataFrame, chart: str, t: str, at: str, values: list[str], before_first: bool = True) -> DataFrame:
    """Add to each point the values of the last state at or before it; before the first state, that one.

    Both sides go through one sorted window, which costs one shuffle on the chart and never multiplies rows. A point
    at a state's time sees that state; of states at one time the last in column order.
    """
    kinds = dict(states.dtypes)
    marked = F.struct(F.col(at).cast("double").alias("_at"), *[F.col(v).alias(v) for v in values])
    a = points.withColumn("_t", F.col(t).cast("double")).withColumn("_side", F.lit(1)).withColumn("_state", F.lit(None).cast("struct<_at:double," + ",".join(f"{v}:{kinds[v]}" for v in values) + ">"))
    b = states.select(F.col(chart), F.col(at).cast("double").alias("_t"), F.lit(0).alias("_side"), marked.alias("_state"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(chart).orderBy("_t", "_side", "_state")
    last = F.last("_state", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("_state", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = F.coalesce(last, first) if before_first else last
    return both.withColumn("_found", found).filter("_side = 1").select(*points.columns, *[F.col("_found")[v].alias(v) for v in values])


def segment_durations(segments: DataFrame, chart: str, offset: str, start: Column, end: Column) -> DataFrame:
    """Add duration: how long a segment is in force inside [start, end]."""
    rows = with_bounds(segments, chart, offset)
    return rows.withColumn("duration", F.greatest(F.lit(0.0), F.least(F.col("to_ms"), end.cast("double")) - F.greatest(F.col("from_ms"), start.cast("double"))))


def dominant(segments: DataFrame, chart: str, value: str, duration: str, seq: str) -> DataFrame:
    """(chart, value, duration): the value in force longest; the first seen wins ties."""
    sums = segments.groupBy(chart, value).agg(F.sum(duration).alias("duration"), F.min(seq).alias("_seq"))
    best = F.min_by(F.struct(F.col(value), F.col("duration")), F.struct(-F.col("duration"), F.col("_seq")))
    return sums.groupBy(chart).agg(best.alias("b")).select(chart, F.col(f"b.{value}").alias(value), "b.duration")


def timing_summary(segments: DataFrame, chart: str, seq: str, bpm: str, meter: str) -> DataFrame:
    """Per chart: counts, whether tempo and meter are constant, and their distinct values in first-seen order."""

    def ordered(value: Column) -> Column:
        return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), value.alias("v")))), lambda x: x["v"]))

    out = segments.groupBy(chart).agg(F.count("*").alias("segments"), ordered(F.round(bpm, 2)).alias("bpms"), ordered(F.col(meter)).alias("meters"))
    return out.withColumn("constant_bpm", F.size("bpms") == 1).withColumn("constant_meter", F.size("meters") == 1)


def near_duplicates(segments: DataFrame, chart: str, offset: str, eps: float = EPS) -> DataFrame:
    """Add problem: duplicate (equal offsets) or near (closer than eps), else null."""
    gap = F.lead(offset).over(Window.partitionBy(chart).orderBy(offset)) - F.col(offset)
    return segments.withColumn("problem", F.when(gap == 0, "duplicate").when(gap < eps, "near"))


def beat_grid(segments: DataFrame, chart: str, offset: str, length: str, end: Column, eps: float = EPS) -> DataFrame:
    """(chart, section, k, beat, start, nominal, actual, residual): beats of every segment up to ``end``.

    The first segment reaches back to time 0. A beat cut short by the next segment is residual; a segment whose end
    falls within eps of a beat has no residual; a segment that begins at the next one's start is empty.
    """
    rows = with_bounds(segments, chart, offset).withColumn("_end", F.least(F.col("to_ms"), end.cast("double")))
    n = F.col(length).cast("double")
    first = F.when(F.col("section") == 0, -F.ceil((F.col(offset) - eps) / n)).otherwise(0).cast("long")
    beats = (F.col("_end") - F.col(offset)) / n
    whole = F.when(F.abs(beats - F.rint(beats)) * n <= eps, F.rint(beats)).otherwise(F.ceil(beats))
    last = whole.cast("long") - 1
    spans = rows.withColumn("_first", first).withColumn("_last", last).filter(F.col("_last") >= F.col("_first"))
    each = spans.withColumn("k", F.explode(F.sequence("_first", "_last"))).withColumn("start", F.col(offset) + F.col("k") * n)
    actual = F.least(n, F.col("_end") - F.col("start"))
    order = Window.partitionBy(chart).orderBy("section", "k")
    return each.select(chart, "section", "k", (F.row_number().over(order) - 1).alias("beat"), "start", n.alias("nominal"), actual.alias("actual"), (n - actual > eps).alias("residual"))


def phase(points: DataFrame, beats: DataFrame, chart: str, t: str) -> DataFrame:
    """Add beat and phase in [0, 1) of each point: clamped before the first beat and inside each."""
    at = asof(points, beats, chart, t, "start", ["beat", "start", "nominal"])
    p = (F.col(t) - F.col("start")) / F.col("nominal")
    return at.withColumn("phase", F.greatest(F.lit(0.0), F.least(F.lit(BELOW_ONE), p))).drop("start", "nominal")


def grid_cells(denominators: tuple[int, ...]) -> list[tuple[int, int]]:
    """Reduced fractions n/d in [0, 1) of the denominators, in order."""
    from math import gcd

    return sorted({(n, d) for d in denominators for n in range(d) if gcd(n, d) == 1}, key=lambda c: c[0] / c[1])


def grid_points(beats: DataFrame, chart: str, cells: list[tuple[int, int]], end: Column, eps: float = EPS) -> DataFrame:
    """(chart, section, k, beat, cell, numer, denom, t): the places of every beat that lie in [0, end).

    ``beats`` is what beat_grid gives. A residual beat has none from the next segment's start, less eps, on. Cells are a
    literal array, numbered in their order.
    """
    literal = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(n).alias("numer"), F.lit(d).alias("denom")) for i, (n, d) in enumerate(cells)])
    each = beats.withColumn("_end", end.cast("double")).select(chart, "section", "k", "beat", "start", "nominal", "actual", "residual", "_end", F.inline(literal))
    rows = each.withColumn("t", F.col("start") + F.col("numer") / F.col("denom") * F.col("nominal"))
    cut = F.col("residual") & (F.col("t") >= F.col("start") + F.col("actual") - eps)
    return rows.filter((F.col("t") >= 0) & (F.col("t") < F.col("_end")) & ~cut).select(chart, "section", "k", "beat", "cell", "numer", "denom", "t")


def label_grid(points: DataFrame, t: str, start: str, nominal: str, cells: list[tuple[int, int]], window: float = 1.0, eps: float = EPS) -> DataFrame:
    """Add cell: of the cells in (t - eps, t + window + eps) the smallest denominator, then the nearest, then the
    smallest numerator; else the nearest of all, by a running comparison in the order of ``cells``: one closer by more
    than TIE replaces what is held, and so does one as close with a smaller denominator, then numerator. Cells are a
    literal array, so rows don't multiply."""
    literal = F.array(*[F.struct(F.lit(n).alias("numer"), F.lit(d).alias("denom")) for n, d in cells])
    placed = F.transform(literal, lambda c: F.struct(c["denom"].alias("denom"), F.abs(F.col(start) + c["numer"] * F.col(nominal) / c["denom"] - F.col(t)).alias("distance"), c["numer"].alias("numer"), (F.col(start) + c["numer"] * F.col(nominal) / c["denom"] - F.col(t)).alias("off")))
    inside = F.array_min(F.filter(placed, lambda c: (c["off"] > -eps) & (c["off"] < window + eps)))
    plain = F.transform(placed, lambda c: F.struct(c["distance"].alias("distance"), c["denom"].alias("denom"), c["numer"].alias("numer")))

    def keep(held: Column, c: Column) -> Column:
        simpler = (c["denom"] < held["denom"]) | ((c["denom"] == held["denom"]) & (c["numer"] < held["numer"]))
        return F.when((c["distance"] + TIE < held["distance"]) | ((c["distance"] <= held["distance"] + TIE) & simpler), c).otherwise(held)

    nearest = F.aggregate(F.slice(plain, 2, max(1, len(cells))), F.get(plain, F.lit(0)), keep)
    return points.withColumn("_in", inside).withColumn("_near", nearest).withColumn("numer", F.coalesce("_in.numer", "_near.numer")).withColumn("denom", F.coalesce("_in.denom", "_near.denom")).withColumn("in_window", F.col("_in").isNotNull()).drop("_in", "_near")


def density(events: DataFrame, marks: DataFrame, chart: str, t: str, before: int = 500, after: int = 499) -> DataFrame:
    """Marks with n, the events in [mark - before, mark + after] ms; marks ride along in the events' window."""
    both = events.select(chart, F.col(t).cast("long").alias("t"), F.lit(0).alias("mark")).unionByName(marks.select(chart, F.col(t).cast("long").alias("t"), F.lit(1).alias("mark")))
    near = Window.partitionBy(chart).orderBy("t").rangeBetween(-before, after)
    return both.withColumn("n", F.sum(1 - F.col("mark")).over(near)).filter("mark = 1").select(chart, F.col("t").alias(t), "n")


def resample(series: DataFrame, marks: DataFrame, chart: str, t: str, value: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Value at each mark by linear interpolation, clamped at the ends; the marks' columns ``carry`` go along."""
    placed = marks.select(chart, F.col(t).cast("double").alias("t"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("mark"), *carry)
    both = series.select(chart, F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v"), F.lit(0).alias("mark")).unionByName(placed, allowMissingColumns=True)
    return interpolate(both, chart, t, value, carry)


def interpolate(both: DataFrame, chart: str, t: str, value: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The marks among (chart, t, v, mark, carry...) with their value; mark is 0 for the series' points, whose value is v."""
    point = F.when(F.col("mark") == 0, F.struct("t", "v"))
    # Both run from one end of the chart: a frame that reaches ahead would be summed anew for every row.
    upward, downward = Window.partitionBy(chart).orderBy("t", "mark"), Window.partitionBy(chart).orderBy(F.desc("t"), F.desc("mark"))
    prev = F.last(point, ignorenulls=True).over(upward.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.last(point, ignorenulls=True).over(downward.rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("p", prev).withColumn("q", nxt).filter("mark = 1")
    share = (F.col("t") - F.col("p.t")) / (F.col("q.t") - F.col("p.t"))
    blended = F.when(F.col("p").isNull(), F.col("q.v")).when(F.col("q").isNull() | (F.col("q.t") == F.col("p.t")), F.col("p.v")).otherwise(F.col("p.v") + share * (F.col("q.v") - F.col("p.v")))
    return rows.select(chart, F.col("t").alias(t), blended.alias(value), *carry)


def step_integral(steps: DataFrame, marks: DataFrame, chart: str, t: str, value: str, half: float) -> DataFrame:
    """Mean of a step function over [mark - half, mark + half]: cumulative areas at both ends by as-of look-ups."""
    order = Window.partitionBy(chart).orderBy("t")
    rows = steps.select(chart, F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v")).withColumn("next", F.lead("t").over(order))
    rows = rows.withColumn("area", F.coalesce(F.sum(F.col("v") * (F.col("next") - F.col("t"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumnRenamed("t", "at").select(chart, "at", "v", "area")
    ends = marks.select(chart, F.col(t).cast("double").alias("mark"), F.explode(F.array(F.struct(F.lit(-1).alias("s"), (F.col(t) - half).cast("double").alias("x")), F.struct(F.lit(1).alias("s"), (F.col(t) + half).cast("double").alias("x")))).alias("e")).select(chart, "mark", "e.s", "e.x")
    # Before the first step the function is taken as 0.
    found = asof(ends, rows.withColumn("start", F.col("at")), chart, "x", "at", ["v", "area", "start"], before_first=False)
    area = F.coalesce(F.col("area") + F.col("v") * (F.col("x") - F.col("start")), F.lit(0.0))
    return found.groupBy(chart, "mark").agg((F.sum(F.col("s") * area) / (2 * half)).alias("mean")).withColumnRenamed("mark", t)


def isolated_anchors(events: DataFrame, chart: str, t: str, gap: float, most: int) -> DataFrame:
    """Events at least ``gap`` from both neighbours, thinned evenly to ``most`` per chart."""
    order = Window.partitionBy(chart).orderBy(t)
    alone = (F.coalesce(F.col(t) - F.lag(t).over(order), F.lit(gap)) >= gap) & (F.coalesce(F.lead(t).over(order) - F.col(t), F.lit(gap)) >= gap)
    kept = events.withColumn("_alone", alone).filter("_alone").withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(chart)))
    # Index j of the thinned list stands at floor(j * (n - 1) / (most - 1)): i is kept if some j lands on it.
    j = F.ceil(F.col("_i") * (most - 1) / (F.col("_n") - 1) - 1e-12)
    hit = F.floor(j * (F.col("_n") - 1) / (most - 1) + 1e-12) == F.col("_i")
    return kept.filter((F.col("_n") <= most) | (hit & (j <= most - 1))).drop("_alone", "_i", "_n")


def interval_union(intervals: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """(by..., length): length of the union; empty and non-finite intervals are dropped."""
    ok = intervals.filter((F.col(end) > F.col(start)) & (F.abs(F.col(start)) < float("inf")) & (F.abs(F.col(end)) < float("inf")))
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = ok.withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(order))
    return islands.groupBy(*by, "_island").agg((F.max(end) - F.min(start)).alias("l")).groupBy(*by).agg(F.sum("l").alias("length"))


def interval_amount(intervals: DataFrame, by: list[str], start: str, end: str, order: str) -> DataFrame:
    """(by..., amount): sum of the lengths of intervals that end later than all before them; overlaps count again."""
    sorted_ = Window.partitionBy(*by).orderBy(start, order)
    reach = F.max(end).over(sorted_.rowsBetween(Window.unboundedPreceding, -1))
    return intervals.withColumn("_reach", reach).filter(F.col("_reach").isNull() | (F.col(end) > F.col("_reach"))).groupBy(*by).agg(F.sum(F.col(end) - F.col(start)).alias("amount"))


def pattern_share(intervals: DataFrame, chart: str, kind: str, start: str, end: str, durations: DataFrame, duration: str, kinds: list[str]) -> DataFrame:
    """(chart, kind, share) for each chart of ``durations`` and each of ``kinds``: union over duration, at most 1.

    A kind without intervals has 0; all are null where the duration isn't positive.
    """
    union = interval_union(intervals, [chart, kind], start, end)
    every = durations.select(chart, duration, F.explode(F.array(*map(F.lit, kinds))).alias(kind))
    share = F.least(F.lit(1.0), F.try_divide(F.coalesce("length", F.lit(0)), F.col(duration)))
    return every.join(union, [chart, kind], "left").select(chart, kind, F.when(F.col(duration) > 0, share).alias("share"))


def object_end(events: DataFrame, chart: str, t: str, end: str) -> DataFrame:
    return events.groupBy(chart).agg(F.coalesce(F.max(F.greatest(F.col(t), F.coalesce(F.col(end), F.col(t)))), F.lit(0)).alias("object_end"))


def tick_notes(notes: DataFrame, timing: DataFrame, chart: str, t: str, end: str, offset: str, bpm: str) -> DataFrame:
    """Add tick and end_tick: a note's times on the lattice of its chart's first tempo; end_tick is null for a tap.

    ``timing`` has a row for each chart, (chart, offset, bpm); notes of a chart without one are left out.
    """
    from chronolane.functions.scalars import ms_to_tick

    placed = notes.join(timing.select(chart, F.col(offset).alias("_offset"), F.col(bpm).alias("_bpm")), chart)
    return placed.withColumns({"tick": ms_to_tick(F.col(t), F.col("_offset"), F.col("_bpm")), "end_tick": ms_to_tick(F.col(end), F.col("_offset"), F.col("_bpm"))}).drop("_offset", "_bpm")


def bar_range(events: DataFrame, chart: str, tick: str, ticks_per_bar: int) -> DataFrame:
    """(chart, first_bar, end_bar): bar-aligned span of the events, end exclusive."""
    return events.groupBy(chart).agg(F.floor(F.min(tick) / ticks_per_bar).alias("first_bar"), (F.floor(F.max(tick) / ticks_per_bar) + 1).alias("end_bar"))


def quantization(rows: DataFrame, band: Column, position: Column, error: Column, exact: Column, bins: list[float]) -> DataFrame:
    """Mergeable sums per band and in total (band null): n, error moments, exact hits, snap counts and a histogram.

    One aggregation by rollup; everything in it adds up, so it pre-aggregates where the rows are.
    """
    size = F.abs(error)
    hits = [F.count_if(F.pmod(position * n, F.lit(48)) == 0).alias(f"snap_{n}") for n in range(1, 25)]
    edges = [*bins, float("inf")]
    hist = [F.count_if((size >= low) & (size < high)).alias(f"bin_{i}") for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False))]
    out = rows.withColumn("band", band).rollup("band").agg(F.grouping("band").alias("total"), F.count("*").alias("n"), F.avg(error).alias("mean"), F.avg(error * error).alias("_sq"), F.avg(size).alias("mean_abs"), F.count_if(exact).alias("n_exact"), *hits, *hist)
    return out.withColumn("std", F.sqrt(F.greatest(F.lit(0.0), F.col("_sq") - F.col("mean") * F.col("mean")))).drop("_sq")


def scale_clock(segments: DataFrame, rate: float, times: list[str]) -> DataFrame:
    """Segments or beats at another rate: offsets, lengths and times divided, all else as it is."""
    return segments.withColumns({c: F.col(c) / rate for c in times})


def chart_shape(beats: DataFrame, rows: DataFrame, chart: str, start: str, length: str) -> DataFrame:
    """(chart, frames, tokens): frames between the first beat's start and the last one's end, and 2 + beats + 2 * rows tokens."""
    from chronolane.functions.scalars import frame_index

    spans = beats.groupBy(chart).agg(F.min(start).alias("_from"), F.max(F.col(start) + F.col(length)).alias("_to"), F.count("*").alias("_beats"))
    counts = rows.groupBy(chart).agg(F.count("*").alias("_rows"))
    tokens = 2 + F.col("_beats") + 2 * F.coalesce("_rows", F.lit(0))
    return spans.join(counts, chart, "left").select(chart, (frame_index(F.col("_to")) - frame_index(F.col("_from"))).alias("frames"), tokens.alias("tokens"))
