"""Token sequences back to notes: what breaks the grammar or a lane is rejected, what a window clips is an issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolane.operators.tokens import ACTIVE, EMPTY, END, START, TAP
from chronolane.session import cut, parts_for


def _inner(sequences: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    """(keys..., i, token): the tokens between the frame's first two and its last; i counts from the first of these."""
    framed = F.coalesce(F.get(tokens, F.lit(0)) == "<BOS>", F.lit(False))
    end = F.size(tokens) - F.when(framed & (F.element_at(tokens, -1) == "<EOS>"), 1).otherwise(0)
    cut = F.when(framed, F.slice(tokens, F.lit(3), F.greatest(end - 2, F.lit(0)))).otherwise(F.col(tokens))
    return sequences.select(*keys, F.posexplode(cut).alias("i", "token"))


def _parts(sequences: DataFrame, tokens: str) -> int:
    """Tasks to deal sequences to: their tokens are rows, and half of them rows of four lanes."""
    return parts_for(sequences.sparkSession, 2 * (sequences.agg(F.sum(F.size(tokens))).first()[0] or 0))


def cells(sequences: DataFrame, keys: list[str], tokens: str, start: str, initial: str, ticks_per_bar: int, lanes: int = 4) -> tuple[DataFrame, DataFrame]:
    """Lane cells of every row token, and the first reason to reject of each sequence that has one.

    (keys..., i, tick, lane, digit, held) and (keys..., i, reason). Sequences are framed or bare; ``start`` is the first
    bar, ``initial`` the digits of lane states there, EMPTY or ACTIVE alone. Reasons, in order at one token: unexpected
    token, position before a bar, position without a row, repeated position, row without a position, lane state; a bad
    initial row stands at -1 and a position at the very end at the number of tokens.
    """
    order = Window.partitionBy(*keys).orderBy("i")
    parts = _parts(sequences, tokens)
    rows = _inner(sequences.repartition(parts, *keys), keys, tokens)  # whole sequences move, not their tokens
    is_bar, is_pos, is_row = F.col("token") == "BAR", F.col("token").rlike("^POS_[0-9]+$"), F.col("token").rlike(f"^ROW_[0-4]{{{lanes}}}$")
    rows = rows.withColumn("kind", F.when(is_bar, "bar").when(is_pos, "pos").when(is_row, "row").otherwise("other"))
    rows = rows.withColumn("bar", F.sum((F.col("kind") == "bar").cast("int")).over(order) - 1).withColumn("pos", F.when(F.col("kind") == "pos", F.substr("token", F.lit(5)).cast("long")))
    rows = rows.withColumn("prev", F.lag("kind").over(order)).withColumn("at", F.lag("pos").over(order)).withColumn("next", F.lead("kind").over(order))
    rows = rows.withColumn("again", (F.col("kind") == "pos") & (F.row_number().over(Window.partitionBy(*keys, "bar", "pos").orderBy("i")) > 1))
    open_before = F.coalesce(F.col("prev") == "pos", F.lit(False))
    tests = {
        "unexpected token": F.col("kind") == "other",
        "position before a bar": (F.col("kind") == "pos") & (F.col("bar") < 0),
        "position without a row": open_before & F.col("kind").isin("pos", "bar"),
        "repeated position": F.col("again"),
        "row without a position": (F.col("kind") == "row") & ~open_before,
    }
    broken = rows.withColumn("reason", F.coalesce(*[F.when(test, name) for name, test in tests.items()]))
    ends = broken.filter("next IS NULL AND kind = 'pos'").select(*keys, (F.col("i") + 1).alias("i"), F.lit("position without a row").alias("reason"))
    syntax = broken.filter("reason IS NOT NULL").select(*keys, "i", "reason").unionByName(ends)
    states = sequences.select(*keys, F.col(start).alias("_start"), F.col(initial).alias("_initial"))
    bad = states.filter(~F.col("_initial").rlike(f"^[{EMPTY}{ACTIVE}]{{{lanes}}}$")).select(*keys, F.lit(-1).alias("i"), F.lit("initial row").alias("reason"))
    placed = rows.filter((F.col("kind") == "row") & open_before).join(states, keys)
    each = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    out = placed.select(*keys, "i", ((F.col("_start") + F.col("bar")) * ticks_per_bar + F.col("at")).alias("tick"), "token", "_initial", each)
    out = out.withColumn("digit", F.substr("token", F.col("lane") + 5, F.lit(1)).cast("int"))
    lane = Window.partitionBy(*keys, "lane").orderBy("i")
    change = F.when(F.col("digit").isin(START, END), F.col("digit"))
    last = F.last(change, ignorenulls=True).over(lane.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("held", F.coalesce(last == START, F.substr("_initial", F.col("lane") + 1, F.lit(1)) == str(ACTIVE)))
    wrong = F.when(F.col("held"), F.col("digit").isin(EMPTY, TAP, START)).otherwise(F.col("digit").isin(ACTIVE, END))
    lane_bad = out.filter(wrong).select(*keys, "i", F.lit("lane state").alias("reason"))
    first = syntax.unionByName(bad).unionByName(lane_bad).groupBy(*keys).agg(F.min(F.struct("i", "reason")).alias("x")).select(*keys, F.col("x.i").alias("i"), F.col("x.reason").alias("reason"))
    return out.select(*keys, "i", "tick", "lane", "digit", "held"), first


def decode_notes(sequences: DataFrame, keys: list[str], tokens: str, start: str, initial: str, ticks_per_bar: int, lanes: int = 4) -> DataFrame:
    """(keys..., tick, lane, kind, end, issue): notes of the sequences that nothing rejects.

    kind is tap or hold; end is the hold's. A hold that was active at the start begins there (issue missing_hold_head);
    one still open after the last bar ends with that bar (missing_hold_tail), or both. A hold of no length gives no note,
    but for its issue, kind null.
    """
    found, rejected = cells(sequences, keys, tokens, start, initial, ticks_per_bar, lanes)
    rejected = cut(rejected, "rejected")  # read for sequences and for their events
    good = sequences.join(rejected, keys, "left_anti")
    bars = F.size(F.filter(tokens, lambda t: t == "BAR"))
    spans = good.select(*keys, (F.col(start) * ticks_per_bar).alias("_from"), ((F.col(start) + bars) * ticks_per_bar).alias("_to"), F.col(initial).alias("_initial"))
    events = found.filter(F.col("digit").isin(TAP, START, END)).join(rejected, keys, "left_anti").select(*keys, "i", "tick", "lane", "digit")
    # A lane that is active at the start begins with a head there, before every token.
    each = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    heads = spans.select(*keys, F.col("_from"), "_initial", each).filter(F.substr("_initial", F.col("lane") + 1, F.lit(1)) == str(ACTIVE))
    heads = heads.select(*keys, F.lit(-1).alias("i"), F.col("_from").alias("tick"), "lane", F.lit(START).alias("digit"))
    holds = events.filter(F.col("digit") != TAP).unionByName(heads)
    order = Window.partitionBy(*keys, "lane").orderBy("i")
    holds = holds.repartition(_parts(sequences, tokens), *keys)
    holds = holds.withColumn("end", F.lead("tick").over(order)).filter(F.col("digit") == START).join(spans.select(*keys, "_to"), keys)
    issue = F.concat_ws(",", F.when(F.col("i") < 0, "missing_hold_head"), F.when(F.col("end").isNull(), "missing_hold_tail"))
    holds = holds.withColumn("issue", F.nullif(issue, F.lit(""))).withColumn("end", F.coalesce("end", "_to"))
    length: Column = F.col("end") > F.col("tick")
    holds = holds.filter(length | F.col("issue").isNotNull()).select(*keys, "tick", "lane", F.when(length, "hold").alias("kind"), F.when(length, F.col("end")).alias("end"), "issue")
    taps = events.filter(F.col("digit") == TAP).select(*keys, "tick", "lane", F.lit("tap").alias("kind"), F.lit(None).cast(dict(holds.dtypes)["end"]).alias("end"), F.lit(None).cast("string").alias("issue"))
    return taps.unionByName(holds)
