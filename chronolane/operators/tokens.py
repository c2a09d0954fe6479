"""Lane states, row tokens and holds: events on ticks to token sequences and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a lane.
EMPTY, TAP, START, ACTIVE, END = range(5)
#: State of an event's kind.
KINDS = {"tap": TAP, "start": START, "end": END}


def event_rows(events: DataFrame, chart: str, tick: str, lane: str, kind: str, lanes: int = 4) -> DataFrame:
    """(chart, tick, row, conflict, illegal): a digit a lane. What no event touches is active inside a hold, else empty.

    conflict: several events in one cell. illegal: a start or tap inside a hold, or an end outside one. Lanes are
    columns of one pre-aggregated row, so a chart is sorted once.
    """
    code = reduce(lambda out, k: out.when(F.col(kind) == k, KINDS[k]), KINDS, F.when(F.lit(False), 0))
    cells = [F.max(F.when(F.col(lane) == i, code)).alias(f"c{i}") for i in range(lanes)]
    counts = [F.count_if(F.col(lane) == i).alias(f"n{i}") for i in range(lanes)]
    rows = events.groupBy(chart, tick).agg(*cells, *counts)
    before = Window.partitionBy(chart).orderBy(tick).rowsBetween(Window.unboundedPreceding, -1)
    for i in range(lanes):
        change = F.when(F.col(f"c{i}") == START, 1).when(F.col(f"c{i}") == END, -1).otherwise(0)
        rows = rows.withColumn(f"open{i}", F.coalesce(F.sum(change).over(before), F.lit(0)) > 0)
    digits = [F.coalesce(F.col(f"c{i}"), F.when(F.col(f"open{i}"), ACTIVE).otherwise(EMPTY)).cast("string") for i in range(lanes)]
    conflict = reduce(lambda a, b: a | b, [F.col(f"n{i}") > 1 for i in range(lanes)])
    wrong = [F.coalesce(F.when(F.col(f"open{i}"), F.col(f"c{i}").isin(TAP, START)).otherwise(F.col(f"c{i}") == END), F.lit(False)) for i in range(lanes)]
    return rows.select(chart, tick, F.concat(*digits).alias("row"), conflict.alias("conflict"), reduce(lambda a, b: a | b, wrong).alias("illegal"))


def active_at(events: DataFrame, marks: DataFrame, chart: str, tick: str, lane: str, kind: str, lanes: int = 4) -> DataFrame:
    """(chart, tick, row): at each mark, 3 for lanes held across it, else 0."""
    change = F.when(F.col(kind) == "start", 1).when(F.col(kind) == "end", -1).otherwise(0)
    both = events.select(chart, F.col(tick).alias("t"), F.lit(1).alias("side"), F.col(lane).alias("lane"), change.alias("x")).unionByName(marks.select(chart, F.col(tick).alias("t"), F.lit(0).alias("side"), F.lit(None).cast(dict(events.dtypes)[lane]).alias("lane"), F.lit(0).alias("x")).distinct())
    before = Window.partitionBy(chart).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    held = [F.sum(F.when(F.col("lane") == i, F.col("x")).otherwise(0)).over(before) > 0 for i in range(lanes)]
    row = F.concat(*[F.when(h, str(ACTIVE)).otherwise(str(EMPTY)) for h in held])
    return both.withColumn("row", row).filter("side = 0").select(chart, F.col("t").alias(tick), "row")


def pair_holds(events: DataFrame, by: list[str], t: str, kind: str, seq: str) -> DataFrame:
    """(by..., start, end, state): each head with the tail that follows it in its lane.

    A head without one ends where it starts (unclosed), a tail without a head has no start (orphan).
    """
    order = Window.partitionBy(*by).orderBy(t, seq)
    rows = events.filter(F.col(kind).isin("start", "end")).withColumn("_next", F.lead(kind).over(order)).withColumn("_end", F.lead(t).over(order)).withColumn("_prev", F.lag(kind).over(order))
    head = F.when(F.col("_next") == "end", F.struct(F.col(t).alias("start"), F.col("_end").alias("end"), F.lit("paired").alias("state"))).otherwise(F.struct(F.col(t).alias("start"), F.col(t).alias("end"), F.lit("unclosed").alias("state")))
    tail = F.when(F.coalesce(F.col("_prev") != "start", F.lit(True)), F.struct(F.lit(None).cast(dict(events.dtypes)[t]).alias("start"), F.col(t).alias("end"), F.lit("orphan").alias("state")))
    return rows.withColumn("_hold", F.when(F.col(kind) == "start", head).otherwise(tail)).filter("_hold IS NOT NULL").select(*by, "_hold.*")


def encode_tokens(rows: DataFrame, chart: str, bar: str, pos: str, row: str) -> DataFrame:
    """(chart, tokens): BAR for every bar of the span, empty ones too, then POS and ROW of each row in order."""
    spans = rows.groupBy(chart).agg(F.min(bar).alias("a"), F.max(bar).alias("b"))
    markers = spans.select(chart, F.explode(F.sequence("a", "b")).alias("bar")).select(chart, F.struct(F.col("bar"), F.lit(-1).cast("long").alias("pos"), F.array(F.lit("BAR")).alias("out")).alias("t"))
    placed = rows.select(chart, F.struct(F.col(bar).alias("bar"), F.col(pos).cast("long").alias("pos"), F.array(F.concat(F.lit("POS_"), F.col(pos).cast("string")), F.concat(F.lit("ROW_"), F.col(row))).alias("out")).alias("t"))
    return markers.unionByName(placed).groupBy(chart).agg(F.flatten(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["out"])).alias("tokens"))


def exploded(sequences: DataFrame, chart: str, tokens: str) -> DataFrame:
    """(chart, i, token, bar, pos): each token with the bar and position in force at it."""
    order = Window.partitionBy(chart).orderBy("i")
    rows = sequences.select(chart, F.posexplode(tokens).alias("i", "token"))
    bar = F.sum((F.col("token") == "BAR").cast("int")).over(order) - 1
    rows = rows.withColumn("bar", bar)
    at = F.when(F.col("token").startswith("POS_"), F.substr("token", F.lit(5)).cast("long"))
    return rows.withColumn("pos", F.last(at, ignorenulls=True).over(Window.partitionBy(chart, "bar").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))


def decode_tokens(sequences: DataFrame, chart: str, tokens: str) -> DataFrame:
    """(chart, bar, pos, row), bars counted from the sequence's first."""
    return exploded(sequences, chart, tokens).filter(F.col("token").startswith("ROW_")).select(chart, "bar", "pos", F.substr("token", F.lit(5)).alias("row"))


def cursor_times(sequences: DataFrame, chart: str, tokens: str) -> DataFrame:
    """(chart, i, bar, pos): where the cursor stands before each token; null before the first bar."""
    order = Window.partitionBy(chart).orderBy("i")
    rows = exploded(sequences, chart, tokens)
    return rows.select(chart, "i", F.lag("bar").over(order).alias("bar"), F.lag("pos").over(order).alias("pos"))


def first_illegal(sequences: DataFrame, chart: str, tokens: str, lanes: int = 4) -> DataFrame:
    """(chart, i, reason): the first token that breaks the grammar, for charts that have one.

    A row follows a position, positions rise inside a bar, nothing stands before the first bar, and each lane's digit
    fits whether it is held.
    """
    order = Window.partitionBy(chart).orderBy("i")
    rows = exploded(sequences, chart, tokens).withColumn("prev", F.lag("token").over(order)).withColumn("before", F.lag("pos").over(Window.partitionBy(chart, "bar").orderBy("i")))
    is_row = F.col("token").startswith("ROW_")
    tests = [("outside a bar", F.col("bar") < 0), ("row without a position", is_row & ~F.coalesce(F.col("prev").startswith("POS_"), F.lit(False))), ("position doesn't rise", F.col("token").startswith("POS_") & (F.col("pos") <= F.col("before")))]
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    bad = F.lit(False)
    for k in range(lanes):
        digit = F.when(is_row, F.substr("token", F.lit(5 + k), F.lit(1)))
        held = F.coalesce(F.sum(F.when(digit == str(START), 1).when(digit == str(END), -1).otherwise(0)).over(past), F.lit(0)) > 0
        bad = bad | F.coalesce(F.when(held, ~digit.isin(str(ACTIVE), str(END))).otherwise(digit.isin(str(ACTIVE), str(END))), F.lit(False))
    tests.append(("lane state", is_row & bad))
    reason = F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in tests])
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy(chart).agg(F.min(F.struct("i", "reason")).alias("x")).select(chart, "x.i", "x.reason")


def loss_mask(tokens: Column) -> Column:
    """0 for the frame's beginning and initial row, 1 for all else."""
    return F.transform(tokens, lambda t, i: F.when((t == "<BOS>") | (i == 1), 0).otherwise(1))


def frame_tokens(tokens: Column, initial: Column) -> Column:
    return F.concat(F.array(F.lit("<BOS>"), F.concat(F.lit("ROW_"), initial)), tokens, F.array(F.lit("<EOS>")))


def unframe_tokens(tokens: Column) -> Column:
    """The inner tokens; null for what isn't framed."""
    n = F.size(tokens)
    return F.when((n >= 3) & (F.element_at(tokens, 1) == "<BOS>") & (F.element_at(tokens, -1) == "<EOS>"), F.slice(tokens, 3, n - 3))


def pad_sequences(df: DataFrame, batch: str, tokens: str, pad: str = "<PAD>") -> DataFrame:
    """Add padded (to the batch's longest) and mask, false on the padding alone."""
    longest = F.max(F.size(tokens)).over(Window.partitionBy(batch))
    padded = F.concat(F.col(tokens), F.array_repeat(F.lit(pad), longest - F.size(tokens)))
    return df.withColumn("padded", padded).withColumn("mask", F.transform("padded", lambda t, i: i < F.size(tokens)))


def plausibility(notes: DataFrame, by: list[str], t: str, end: str) -> DataFrame:
    """Add gap to the next note in the lane and the flags concurrent (gap <= 2), almost (|gap| < 10), duplicate start, nonpositive hold."""
    order = Window.partitionBy(*by).orderBy(t, end)
    nxt = F.lead(t).over(order)
    gap = nxt - F.coalesce(F.col(end), F.col(t))
    return notes.withColumn("gap", gap).withColumn("concurrent", F.coalesce(gap <= 2, F.lit(False))).withColumn("almost", F.coalesce(F.abs(gap) < 10, F.lit(False))).withColumn("duplicate_start", F.coalesce(nxt == F.col(t), F.lit(False))).withColumn("nonpositive_hold", F.coalesce(F.col(end) <= F.col(t), F.lit(False)))


def adjacent_warnings(flagged: DataFrame, by: list[str], t: str) -> DataFrame:
    """(by..., t, warning) of plausibility's rows: same start, overlap, or a gap under 10 ms."""
    text = F.when(F.col("duplicate_start"), "same start").when(F.col("gap") < 0, "overlap").when(F.col("gap") < 10, F.concat(F.lit("gap "), F.col("gap").cast("string")))
    return flagged.withColumn("warning", text).filter("warning IS NOT NULL").select(*by, t, "warning")
