"""Sub-patterns of rows with holds, and those of other lane counts: tests on an array of the rows from a row on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows looked at ahead, ms of the slowest repeated note, of the slowest fast row with jacks, without, and
#: without on other lane counts, ms that gaps of an inverse may differ by, lanes that it fills, share of a beat.
AHEAD, SLOW_REPEAT, FAST_JACKS, FAST_ROW, FAST_ROW_OTHER, GAP_SPREAD, FILLED, SHIELD_BEAT = 8, 15000.0 / 90.0, 185.0, 180.0, 170.0, 5.0, 3, 0.25

Rows = Column
Rule = Callable[[Rows, Column, int], Column]


def with_ahead(primitives: DataFrame, chart: str, t: str) -> DataFrame:
    """Add ahead: the row and up to seven that follow, as an array of structs."""
    row = F.struct(F.col(t).cast("double").alias("t"), "delta", "notes", "jacks", "tap_lanes", "head_lanes", "body_lanes", "tail_lanes")
    return primitives.withColumn("ahead", F.collect_list(row).over(Window.partitionBy(chart).orderBy(t).rowsBetween(0, AHEAD - 1)))


def _has_hold(r: Column) -> Column:
    return (F.size(r["head_lanes"]) > 0) | (F.size(r["body_lanes"]) > 0) | (F.size(r["tail_lanes"]) > 0)


def shield(a: Rows, beat: Column, lanes: int) -> Column:
    """A tap and then a hold's head in its lane, or a tail and then a tap, within a quarter beat."""
    one, two = a[0], F.get(a, F.lit(1))
    near = (two["t"] >= one["t"]) & (two["t"] - one["t"] <= beat * SHIELD_BEAT)
    return near & (F.arrays_overlap(one["tap_lanes"], two["head_lanes"]) | F.arrays_overlap(one["tail_lanes"], two["tap_lanes"]))


def inverse(a: Rows, beat: Column, lanes: int) -> Column:
    """Five rows of holds alone, that fill lanes, with even gaps from tails to the next row's heads."""
    five = F.slice(a, 1, 5)
    pairs = F.zip_with(F.slice(five, 1, 4), F.slice(five, 2, 4), lambda x, y: F.when((F.size(x["tail_lanes"]) > 0) & (F.size(y["head_lanes"]) > 0), y["t"] - x["t"]))
    gaps = F.filter(pairs, lambda g: g.isNotNull())
    filled = F.array_max(F.transform(five, lambda r: F.size(r["body_lanes"])))
    return (F.size(five) == 5) & F.forall(five, lambda r: F.size(r["tap_lanes"]) == 0) & (filled >= FILLED) & (F.size(gaps) >= 2) & (F.array_max(gaps) - F.array_min(gaps) <= GAP_SPREAD)


def column_lock(a: Rows, beat: Column, lanes: int) -> Column:
    """Three taps or more, two of them close, beside a hold that goes on, in a lane of the same hand."""
    held = a[0]["head_lanes"][0]

    def beside(step: int) -> Column:
        lane = held + step
        hits = F.transform(F.filter(a, lambda r: F.array_contains(r["body_lanes"], held) & F.array_contains(r["tap_lanes"], lane)), lambda r: r["t"])
        close = F.exists(F.zip_with(F.slice(hits, 1, F.greatest(F.size(hits) - 1, F.lit(0))), F.slice(hits, 2, F.size(hits)), lambda x, y: y - x <= SLOW_REPEAT), lambda c: c)
        same_hand = (held < lanes // 2) == (lane < lanes // 2)
        return lane.between(0, lanes - 1) & same_hand & (F.size(hits) >= 3) & close

    return (F.size(a) >= 3) & (F.size(a[0]["head_lanes"]) > 0) & (beside(-1) | beside(1))


def jacky(a: Rows, beat: Column, lanes: int) -> Column:
    """Repeated lanes near holds: a chord jack or a mini jack, or two rows with jacks that have a chord or are fast."""
    six = F.slice(a, 1, 6)
    rows = F.filter(six, lambda r: r["notes"] > 0)
    one, two = F.get(rows, F.lit(0)), F.get(rows, F.lit(1))
    chord = (one["notes"] > 2) & (two["notes"] > 1) & (two["jacks"] >= 1) & ((two["notes"] < one["notes"]) | (two["jacks"] < two["notes"]))
    mini = (one["jacks"] > 0) & (two["jacks"] == 0)
    four = F.slice(rows, 1, 4)
    repeated = F.size(F.filter(four, lambda r: r["jacks"] > 0)) >= 2
    dense = F.exists(four, lambda r: r["notes"] >= 2) | (F.array_min(F.transform(four, lambda r: r["delta"])) <= FAST_JACKS)
    return F.exists(six, _has_hold) & (F.size(rows) >= 2) & (chord | mini | (repeated & dense))


def release(a: Rows, beat: Column, lanes: int) -> Column:
    """Four rows that each let one hold go, the second and third in different lanes; no shield, inverse or jacks."""
    four = F.slice(a, 1, 4)
    two, three = F.get(a, F.lit(1)), F.get(a, F.lit(2))
    each = (F.size(four) == 4) & F.forall(four, lambda r: F.size(r["tail_lanes"]) == 1)
    rolls = (two["tail_lanes"][0] != three["tail_lanes"][0]) & (three["t"] > two["t"])
    none = ~F.coalesce(shield(a, beat, lanes), F.lit(False)) & ~F.coalesce(inverse(a, beat, lanes), F.lit(False)) & ~F.coalesce(jacky(a, beat, lanes), F.lit(False))
    return each & rolls & none


def _heads(a: Rows, k: int) -> Column:
    return F.get(a, F.lit(k))["head_lanes"]


def _before(a: Rows, k: int) -> Column:
    """The heads of the last row before row ``k`` that has any."""
    out = _heads(a, 0)
    for i in range(1, k):
        out = F.when(F.size(_heads(a, i)) > 0, _heads(a, i)).otherwise(out)
    return out


def _apart(a: Rows, *rows: int) -> Column:
    """No head of these rows repeats a lane of the heads before."""
    out = F.lit(True)
    for k in rows:
        out = out & ~F.arrays_overlap(_heads(a, k), _before(a, k))
    return out


def _rolls(x: Column, y: Column) -> Column:
    return (F.array_min(x) > F.array_max(y)) | (F.array_max(x) < F.array_min(y))


def jump_density(a: Rows, beat: Column, lanes: int) -> Column:
    return (F.size(a) >= 4) & (F.size(_heads(a, 0)) == 2) & (F.size(_heads(a, 1)) == 1) & (F.size(_heads(a, 2)) < 3) & (F.size(_heads(a, 3)) < 3) & _apart(a, 1, 2, 3)


def hand_density(a: Rows, beat: Column, lanes: int) -> Column:
    return (F.size(a) >= 4) & (F.size(_heads(a, 0)) == 3) & _apart(a, 1, 2, 3)


def double_density(a: Rows, beat: Column, lanes: int) -> Column:
    return (F.size(_heads(a, 0)) == 2) & (F.size(_heads(a, 1)) == 2) & _apart(a, 1) & ~_rolls(_heads(a, 0), _heads(a, 1))


def dense_density(a: Rows, beat: Column, lanes: int) -> Column:
    return (F.size(_heads(a, 0)) > 1) & (F.size(_heads(a, 1)) > 1) & _apart(a, 1)


def light_density(a: Rows, beat: Column, lanes: int) -> Column:
    return (F.size(_heads(a, 0)) > 1) & (F.size(_heads(a, 1)) == 1) & _apart(a, 1)


def speedy(a: Rows, beat: Column, lanes: int) -> Column:
    """A fast row near holds; on other lane counts also heads of chords that roll one way."""
    near = (F.size(a) >= 2) & F.exists(F.slice(a, 1, 4), _has_hold)
    fast = a[0]["delta"] <= (FAST_ROW if lanes == 4 else FAST_ROW_OTHER)
    if lanes == 4:
        return near & fast
    x, y, z = (_heads(a, k) for k in range(3))
    chords = (F.size(x) > 1) & (F.size(y) > 1) & (F.size(z) > 1)
    right = (F.array_min(y) > F.array_max(x)) & (F.array_min(z) > F.array_max(y))
    left = (F.array_max(y) < F.array_min(x)) & (F.array_max(z) < F.array_min(y))
    return near & (fast | (chords & (right | left)))


_HELD = (("coordination", "Column Lock", 3, column_lock), ("coordination", "Release", 4, release), ("coordination", "Shield", 2, shield), ("wildcard", "Jacky WC", 4, jacky), ("wildcard", "Speedy WC", 3, speedy), ("density", "Inverse", 5, inverse))
#: Core pattern, name, rows that it spans and test, for four lanes and for other counts.
FOUR = (*_HELD, ("density", "JS Density", 4, jump_density), ("density", "HS Density", 4, hand_density))
OTHER = (*_HELD, ("density", "DS Density", 2, double_density), ("density", "DCS Density", 2, dense_density), ("density", "LCS Density", 2, light_density))


def held_patterns(primitives: DataFrame, chart: str, t: str, beat: Column, lanes: int = 4) -> DataFrame:
    """(chart, t, core, name, length): every sub-pattern of rows with holds that starts at a row; ``beat`` is a beat in the units of ``t``."""
    rules = FOUR if lanes == 4 else OTHER
    rows = with_ahead(primitives, chart, t)
    found = F.array(*[F.when(F.coalesce(test(F.col("ahead"), beat, lanes), F.lit(False)), F.struct(F.lit(core).alias("core"), F.lit(name).alias("name"), F.lit(n).alias("length"))) for core, name, n, test in rules])
    return rows.select(chart, t, F.inline(F.filter(found, lambda x: x.isNotNull())))
