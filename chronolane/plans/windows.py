"""Windows over bars, batches of lengths, and stitching overlapping windows together."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolane.functions.hashing import hash_int


#: Rows of a length window that are packed one after the other.
PACKED = 1 << 20


def bar_windows(spans: DataFrame, key: str, low: str, high: str, size: int = 16) -> DataFrame:
    """(key, start, end): every window of ``size`` bars inside [low, high); none where the span is shorter."""
    return spans.filter(F.col(high) - F.col(low) >= size).select(key, F.explode(F.sequence(F.col(low), F.col(high) - size)).alias("start")).withColumn("end", F.col("start") + size)


def overlap_windows(spans: DataFrame, key: str, low: str, high: str, size: int = 16, context: int = 8, keep: int = 4) -> DataFrame:
    """(key, n, start, end, keep_start, keep_end): windows whose kept bars partition [low, high).

    The first keeps ``context`` bars, each next one ``keep`` after as many of context, and the last is moved back to
    end with the span. A closed form of the window's number, so rows come from a sequence.
    """
    length = F.col(high) - F.col(low)
    rows = spans.filter(length > 0)
    # Window i >= 1 keeps from low + context + (i - 1) * keep; the first whose end would pass the span is the last.
    last = F.when(length <= size, 0).otherwise(F.floor((length - size) / keep).cast("int") + 2)
    each = rows.withColumn("_len", length).withColumn("_last", last).withColumn("n", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    keep_start = F.when(F.col("n") == 0, F.col(low)).otherwise(F.col(low) + context + (F.col("n") - 1) * keep)
    ideal = keep_start - context
    over = ideal + size > F.col(high)
    start = F.when(F.col("n") == 0, F.col(low)).when(over, F.col(high) - size).otherwise(ideal)
    keep_end = F.when(F.col("_last") == 0, F.col(high)).when(F.col("n") == 0, F.col(low) + context).when(over, F.col(high)).otherwise(keep_start + keep)
    return each.select(key, "n", start.alias("start"), (start + size).alias("end"), keep_start.alias("keep_start"), keep_end.alias("keep_end"))


def window_tokens(events: DataFrame, windows: DataFrame, key: str, bar: str, framing: int = 3) -> DataFrame:
    """(key, start, tokens): two tokens a row, one a bar, and the frame; counted by running sums at both ends."""
    counts = events.groupBy(key, bar).agg(F.count("*").alias("n")).select(key, F.col(bar).alias("b"), F.lit(None).cast("long").alias("start"), F.lit(0).alias("side"), "n")
    # Rows before a bar: a mark at the window's start counts negatively, one at its end positively.
    marks = windows.select(key, "start", "end").distinct()
    ends = [marks.select(key, F.col(c).alias("b"), "start", F.lit(s).alias("side"), F.lit(0).cast("long").alias("n")) for c, s in (("start", -1), ("end", 1))]
    order = Window.partitionBy(key).orderBy("b", F.abs("side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.unionByName(ends[0]).unionByName(ends[1]).withColumn("before", F.sum("n").over(order)).filter("side <> 0")
    rows = summed.groupBy(key, "start").agg(F.sum(F.col("side") * F.col("before")).alias("rows"))
    return marks.join(rows, [key, "start"]).select(key, "start", (2 * F.col("rows") + (F.col("end") - F.col("start")) + framing).alias("tokens"))


def window_samples(spans: DataFrame, key: str, low: str, high: str, samples: int, seed: int, size: int = 16) -> DataFrame:
    """(key, sample, start): hashed window starts, so many a chart."""
    room = F.col(high) - F.col(low) - size + 1
    drawn = spans.filter(room > 0).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return drawn.select(key, "sample", (F.col(low) + F.pmod(hash_int(seed, F.col(key), F.col("sample")), room)).alias("start"))


def kept_samples(events: DataFrame, spans: DataFrame, key: str, bar: str, low: str, high: str, samples: int, seed: int, limit: int, size: int = 16, framing: int = 3) -> DataFrame:
    """(key, sample, start, tokens): window_samples without those of more than ``limit`` tokens.

    A sample draws one start; an over-long one is skipped, not drawn again. Tokens come from running counts at both ends.
    """
    drawn = window_samples(spans, key, low, high, samples, seed, size)
    costs = window_tokens(events, drawn.select(key, "start", (F.col("start") + size).alias("end")).distinct(), key, bar, framing)
    return drawn.join(costs, [key, "start"]).filter(F.col("tokens") <= limit).select(key, "sample", "start", "tokens")


def length_windows(df: DataFrame, key: str, length: str, share: float = 0.1) -> DataFrame:
    """Add window: lengths sorted, each window from its first length f up to f * (1 + share). Non-positive ones have none.

    The forward cut depends on where the window before ended, so it runs over the distinct lengths alone, in one
    stream; there are as many as there are different lengths, not rows.
    """
    distinct = df.filter(F.col(length) > 0).select(F.col(length).cast("long").alias("n")).distinct().repartition(1).sortWithinPartitions("n")

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, number = None, -1
        for part in parts:
            out = []
            for n in part["n"]:
                if first is None or n > first * (1 + share):
                    first, number = n, number + 1
                out.append(number)
            yield part.assign(window=out)

    windows = distinct.mapInPandas(cut, "n long, window long").withColumnRenamed("n", "_n")
    return df.join(windows, F.col(length) == F.col("_n"), "left").drop("_n")


def pack_batches(df: DataFrame, key: str, length: str, budget: int, epoch: int, seed: int, share: float = 0.1) -> DataFrame:
    """Add window and batch: inside a length window, in hashed order, greedily while n * longest stays in the budget.

    Packing starts anew in each window, so windows pack side by side. A window of more than PACKED rows is packed in
    parts by hash, which costs a batch that isn't full for each; batches of a later part are numbered from part << 32.
    Non-positive lengths are batches of their own (batch null).
    """
    placed = length_windows(df, key, length, share)
    parts_of = placed.groupBy(F.col("window").alias("_window")).agg(F.ceil(F.count("*") / PACKED).alias("_parts"))
    rows = placed.join(parts_of, F.col("window").eqNullSafe(F.col("_window"))).drop("_window").withColumn("_h", hash_int(seed, epoch, F.col(key)))
    rows = rows.withColumn("_part", F.floor(F.col("_h") * F.col("_parts") / (1 << 32)).cast("long"))

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, batch, n, widest = None, 0, 0, 0
        for part in parts:
            out = []
            for window, piece, size in zip(part["window"], part["_part"], part["_len"], strict=True):
                if (window, piece) != at:
                    at, batch, n, widest = (window, piece), int(piece) << 32, 0, 0
                if n and (n + 1) * max(widest, size) > budget:
                    batch, n, widest = batch + 1, 0, 0
                n, widest = n + 1, max(widest, size)
                out.append(batch)
            yield part[["key", "window"]].assign(batch=out)

    kind = dict(df.dtypes)[key]
    order = rows.filter("window IS NOT NULL").select(F.col(key).alias("key"), "window", F.col(length).cast("long").alias("_len"), "_h", "_part").repartition("window", "_part").sortWithinPartitions("window", "_part", "_h", "key")
    packed = order.mapInPandas(pack, f"key {kind}, window long, batch long").withColumnsRenamed({"key": key})
    alone = rows.filter("window IS NULL").select(key, "window", F.lit(None).cast("long").alias("batch"))
    return packed.unionByName(alone)


def batch_rules(batches: DataFrame, by: list[str], length: str, budget: int, hard: int) -> DataFrame:
    """Per batch: rows, longest, padded size, whether it keeps the budget, share by its p90, and whether a row passes the hard limit."""
    n, top = F.count("*"), F.max(length)
    return batches.groupBy(*by).agg(n.alias("rows"), top.alias("longest"), (n * top).alias("padded"), ((n * top <= budget) | (n == 1)).alias("fits"), F.floor(budget / F.percentile(length, 0.9)).alias("share_by_p90"), (top > hard).alias("too_long"))


def stitch_windows(rows: DataFrame, windows: DataFrame, key: str, window: str, bar: str) -> DataFrame:
    """Rows of overlapping windows, each bar from the window that keeps it."""
    return rows.join(windows.select(key, window, "keep_start", "keep_end"), [key, window]).filter((F.col(bar) >= F.col("keep_start")) & (F.col(bar) < F.col("keep_end"))).drop("keep_start", "keep_end")


def missing_bars(windows: DataFrame, spans: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """(key, bar): bars of the span that no window keeps."""
    want = spans.select(key, F.explode(F.sequence(F.col(low), F.col(high) - 1)).alias("bar"))
    have = windows.select(key, F.explode(F.sequence("keep_start", F.col("keep_end") - 1)).alias("bar"))
    return want.join(have, [key, "bar"], "left_anti")


def tail_events(events: DataFrame, ends: DataFrame, key: str, bar: str, end: str) -> DataFrame:
    """(key, first_bar, last_bar, after): first and last event bar, and events from the reference end on."""
    return events.join(ends, key).groupBy(key).agg(F.min(bar).alias("first_bar"), F.max(bar).alias("last_bar"), F.count_if(F.col(bar) >= F.col(end)).alias("after"))


def length_summary(df: DataFrame, columns: list[str], error: Column) -> DataFrame:
    """n, failed, and p50, p90 and max of columns over the valid rows."""
    ok = ~error
    stats = [x for c in columns for x in (F.percentile(F.when(ok & (F.col(c) > 0), F.col(c)), 0.5).alias(f"{c}_p50"), F.percentile(F.when(ok & (F.col(c) > 0), F.col(c)), 0.9).alias(f"{c}_p90"), F.max(F.when(ok & (F.col(c) > 0), F.col(c))).alias(f"{c}_max"))]
    return df.agg(F.count("*").alias("n"), F.count_if(error).alias("failed"), *stats)


def slice_bars(features: DataFrame, windows: DataFrame, key: str, tick: str, value: str, ticks_per_bar: int) -> DataFrame:
    """(key, start, offset, value): feature values on every tick of a window, zero where there is none."""
    every = windows.select(key, "start", F.explode(F.sequence(F.col("start") * ticks_per_bar, F.col("end") * ticks_per_bar - 1)).alias(tick))
    return every.join(features.select(key, tick, value), [key, tick], "left").select(key, "start", (F.col(tick) - F.col("start") * ticks_per_bar).alias("offset"), F.coalesce(value, F.lit(0.0)).alias(value))
