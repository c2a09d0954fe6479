"""Overlapping windows of tokens: made from rows, cut into bars, stitched into one chart, with lane states replayed.

A window is a row (key, window, start, end, keep_start, keep_end, tokens); tokens are <BOS>, the row of lane states at the
start, then BAR and pairs of POS_p and ROW_r of each bar, then <EOS>. A chart is what each window gives for the bars that
it keeps. States compose: a lane's state at a bar is what the last bar before it that changed the lane left, so one
window over bars gives the state at every start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolane.operators.tokens import ACTIVE, EMPTY, END, START, active_at, frame_tokens

BAR, EOS = "BAR", "<EOS>"


def encode_windows(rows: DataFrame, windows: DataFrame, initial: DataFrame, key: str, window: str, bar: str, pos: str, row: str) -> DataFrame:
    """Windows with their framed tokens: a marker for every bar from start to end, and the rows inside.

    ``initial`` has (key, start, row): the lane states at each start. A window's tokens are as many as its bars hold.
    """
    spans = windows.select(key, window, "start", "end")
    markers = spans.select(key, window, F.explode(F.sequence("start", F.col("end") - 1)).alias("bar")).select(key, window, F.struct("bar", F.lit(-1).cast("long").alias("pos"), F.array(F.lit(BAR)).alias("out")).alias("t"))
    # A row is in few windows; each window names its bars, so the join is on equal bars.
    inside = spans.select(key, window, F.explode(F.sequence("start", F.col("end") - 1)).alias("bar")).join(rows.select(key, F.col(bar).alias("bar"), F.col(pos).cast("long").alias("pos"), F.col(row).alias("row")), [key, "bar"])
    placed = inside.select(key, window, F.struct("bar", "pos", F.array(F.concat(F.lit("POS_"), F.col("pos").cast("string")), F.concat(F.lit("ROW_"), F.col("row"))).alias("out")).alias("t"))
    body = markers.unionByName(placed).groupBy(key, window).agg(F.flatten(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["out"])).alias("_body"))
    first = initial.select(key, "start", F.col("row").alias("_first"))
    return windows.join(body, [key, window]).join(first, [key, "start"]).withColumn("tokens", frame_tokens(F.col("_body"), F.col("_first"))).drop("_body", "_first")


def initial_rows(events: DataFrame, windows: DataFrame, key: str, tick: str, lane: str, kind: str, ticks_per_bar: int, lanes: int = 4) -> DataFrame:
    """(key, start, row): lane states at the windows' starts, from events."""
    marks = windows.select(key, "start").distinct()
    states = active_at(events, marks.select(key, (F.col("start") * ticks_per_bar).alias(tick)), key, tick, lane, kind, lanes)
    return states.select(key, F.expr(f"{tick} DIV {ticks_per_bar}").alias("start"), "row")


def _complete(body: Column) -> Column:
    """A bar's marker and its pairs up to the first that isn't one: a trailing position falls away."""
    paired = lambda i: F.coalesce(F.get(body, i).startswith("POS_") & F.get(body, i + 1).startswith("ROW_"), F.lit(False))
    odd = F.when(F.size(body) > 1, F.sequence(F.lit(1), F.size(body) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.slice(body, F.lit(1), F.coalesce(F.get(F.filter(odd, lambda i: ~paired(i)), F.lit(0)), F.size(body)))


def window_bars(windows: DataFrame, key: str, window: str, tokens: str = "tokens") -> DataFrame:
    """(key, window, start, keep_start, keep_end, bar, body): every bar that a window gives, up to <EOS>; no row moves."""
    size = F.size(tokens)
    rows = windows.withColumn("_end", F.coalesce(F.nullif(F.array_position(tokens, EOS), F.lit(0)) - 1, size).cast("int"))
    at = F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.coalesce(F.get(tokens, i) == BAR, F.lit(False)) & (i < F.col("_end")))
    rows = rows.withColumn("_at", at).select(key, window, "start", "keep_start", "keep_end", tokens, "_end", "_at", F.posexplode("_at").alias("_i", "_from"))
    until = F.coalesce(F.get("_at", F.col("_i") + 1), F.col("_end"))
    rows = rows.withColumn("_body", F.slice(tokens, F.col("_from") + 1, until - F.col("_from")))
    return rows.select(key, window, "start", "keep_start", "keep_end", (F.col("start") + F.col("_i")).alias("bar"), _complete(F.col("_body")).alias("body"))


def kept_bars(windows: DataFrame, key: str, window: str, tokens: str = "tokens") -> DataFrame:
    """(key, bar, body): each bar from the window that keeps it."""
    return window_bars(windows, key, window, tokens).filter("bar >= keep_start AND bar < keep_end").select(key, "bar", "body")


def missing_keeps(windows: DataFrame, key: str, window: str, tokens: str = "tokens") -> DataFrame:
    """(key, window, bar): bars that a window keeps and doesn't give; a caller that can't accept empty bars fails on any."""
    given = F.size(F.filter(F.slice(tokens, F.lit(1), F.coalesce(F.nullif(F.array_position(tokens, EOS), F.lit(0)), F.size(tokens)).cast("int")), lambda t: t == BAR))
    wanted = F.sequence("keep_start", F.col("keep_end") - 1)
    lacking = F.filter(wanted, lambda b: (b < F.col("start")) | (b >= F.col("start") + F.col("_given")))
    return windows.withColumn("_given", given).filter("keep_end > keep_start").select(key, window, F.explode(lacking).alias("bar"))


def whole_charts(kept: DataFrame, spans: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """(key, bar, body) of every bar of [low, high): bars that no window gave are an empty marker."""
    every = spans.select(key, F.explode(F.sequence(F.col(low), F.col(high) - 1)).alias("bar"))
    return every.join(kept, [key, "bar"], "left").withColumn("body", F.coalesce("body", F.array(F.lit(BAR))))


def chart_tokens(bars: DataFrame, key: str) -> DataFrame:
    """(key, tokens): the bars of a chart in order."""
    return bars.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("bar", "body"))), lambda b: b["body"])).alias("tokens"))


def states_at_bars(bars: DataFrame, key: str, lanes: int = 4) -> DataFrame:
    """(key, bar, row): lane states when each bar begins, replayed from the bars before it.

    A bar is reduced to what it does to each lane, the last start or end in it, before bars are scanned.
    """
    rows = F.filter("body", lambda t: t.startswith("ROW_"))
    before = Window.partitionBy(key).orderBy("bar").rowsBetween(Window.unboundedPreceding, -1)

    changes = lambda k: F.filter(F.transform(rows, lambda t: F.substring(t, 5 + k, 1)), lambda d: d.isin(str(START), str(END)))
    done = bars.select(key, "bar", *[F.try_element_at(changes(k), F.lit(-1)).alias(f"_d{k}") for k in range(lanes)])
    held = [F.when(F.last(f"_d{k}", ignorenulls=True).over(before) == str(START), str(ACTIVE)).otherwise(str(EMPTY)) for k in range(lanes)]
    return done.select(key, "bar", F.concat(*held).alias("row"))


def context_prompts(bars: DataFrame, windows: DataFrame, key: str, window: str, lanes: int = 4) -> DataFrame:
    """(key, window, prompt): <BOS>, the replayed row and the kept tokens of [start, keep_start); null without such bars."""
    states = states_at_bars(bars, key, lanes).select(key, F.col("bar").alias("start"), F.col("row").alias("_row"))
    wanted = windows.select(key, window, "start", F.explode_outer(F.when(F.col("keep_start") > F.col("start"), F.sequence("start", F.col("keep_start") - 1))).alias("bar"))
    found = wanted.join(bars, [key, "bar"], "left").withColumn("body", F.when(F.col("bar").isNotNull(), F.coalesce("body", F.array(F.lit(BAR)))))
    joined = found.groupBy(key, window, "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("bar").isNotNull(), F.struct("bar", "body")))), lambda b: b["body"])).alias("_context"))
    row = F.concat(F.lit("ROW_"), F.coalesce("_row", F.lit(str(EMPTY) * lanes)))
    return joined.join(states, [key, "start"], "left").select(key, window, F.when(F.size("_context") > 0, F.concat(F.array(F.lit("<BOS>"), row), F.col("_context"))).alias("prompt"))
