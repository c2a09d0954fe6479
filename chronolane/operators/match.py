"""Multiset matching: two sides of counted identities become true and false positives."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.functions.scalars import ratio


def f1_columns() -> list[Column]:
    """precision, recall and f1 from tp, fp and fn; 0 where a denominator is empty."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def multiset_match(predicted: DataFrame, expected: DataFrame, identity: list[str], by: list[str]) -> DataFrame:
    """(by..., tp, fp, fn): per identity tp is the smaller count.

    Both sides go through one aggregation with a side flag, so null parts of an identity meet and there is no join.
    Counting is pre-aggregated before the shuffle.
    """
    sides = predicted.select(*by, *identity, F.lit(1).alias("p"), F.lit(0).alias("e")).unionByName(expected.select(*by, *identity, F.lit(0).alias("p"), F.lit(1).alias("e")))
    keys = list(dict.fromkeys([*by, *identity]))
    counts = sides.select(*keys, "p", "e").groupBy(*keys).agg(F.sum("p").alias("p"), F.sum("e").alias("e"))
    tp = F.sum(F.least("p", "e"))
    return counts.groupBy(*by).agg(tp.alias("tp"), (F.sum("p") - tp).alias("fp"), (F.sum("e") - tp).alias("fn"))


def match_views(predicted: DataFrame, expected: DataFrame, views: dict[str, tuple[list[str], Column | None]], by: list[str]) -> DataFrame:
    """multiset_match for several views at once: name to (identity columns, filter). One pass: rows are exploded by view."""
    columns = list(dict.fromkeys(c for cols, _ in views.values() for c in cols))

    def seen(df: DataFrame) -> DataFrame:
        each = [F.when(test if test is not None else F.lit(True), F.struct(F.lit(name).alias("view"), *[(F.col(c) if c in cols else F.lit(None).cast(dict(df.dtypes)[c])).alias(c) for c in columns])) for name, (cols, test) in views.items()]
        kept = F.filter(F.array(*each), lambda v: v.isNotNull())
        return df.select(*[F.col(c).alias(f"by_{c}") for c in by], F.inline(kept)).withColumnsRenamed({f"by_{c}": f"group_{c}" for c in by})

    out = multiset_match(seen(predicted), seen(expected), columns, [*[f"group_{c}" for c in by], "view"])
    return out.withColumnsRenamed({f"group_{c}": c for c in by})


def exact_views(predicted: DataFrame, expected: DataFrame, by: list[str], beat: str, numer: str, denom: str, lane: str, kind: str, order: str) -> DataFrame:
    """(by..., view, tp, fp, fn) of endpoints whose place on the grid is a fraction of a beat.

    Fractions are in lowest terms, so places meet whatever grid they were read off. Views: event (place, lane and kind),
    kind, lane, and note: taps, and holds by both their ends, each head with the tail that follows it in its lane; what
    has no partner is in no note. ``kind`` is tap, start or end.
    """
    from chronolane.functions.scalars import reduced
    from chronolane.operators.tokens import pair_holds

    def placed(df: DataFrame) -> DataFrame:
        exact = reduced(F.col(numer), F.col(denom))
        rows = df.select(*by, F.col(lane).alias("lane"), F.col(kind).alias("kind"), F.col(order).alias("_seq"), F.struct(F.col(beat).cast("long").alias("beat"), (F.col(numer) / F.col(denom)).alias("at"), exact["numer"].alias("numer"), exact["denom"].alias("denom")).alias("place"))
        holds = pair_holds(rows, [*by, "lane"], "place", "kind", "_seq").filter("state = 'paired'")
        none = F.lit(None).cast(dict(rows.dtypes)["place"])
        notes = rows.filter("kind = 'tap'").select(*by, "lane", F.col("place").alias("start"), none.alias("stop")).unionByName(holds.select(*by, "lane", "start", F.col("end").alias("stop")))
        view = lambda df, name, start, stop, lane, kind: df.select(*by, F.lit(name).alias("view"), start.alias("start"), stop.alias("stop"), lane.alias("lane"), kind.alias("kind"))
        no_lane, no_kind = F.lit(None).cast(dict(rows.dtypes)["lane"]), F.lit(None).cast("string")
        each = [view(rows, n, F.col("place"), none, F.col("lane") if n != "kind" else no_lane, F.col("kind") if n != "lane" else no_kind) for n in ("event", "kind", "lane")]
        out = view(notes, "note", F.col("start"), F.col("stop"), F.col("lane"), no_kind)
        for e in each:
            out = out.unionByName(e)
        exactly = lambda c: F.when(F.col(c).isNotNull(), F.struct(f"{c}.beat", f"{c}.numer", f"{c}.denom"))
        return out.withColumns({"start": exactly("start"), "stop": exactly("stop")})

    return multiset_match(placed(predicted), placed(expected), ["start", "stop", "lane", "kind"], [*by, "view"])


def micro(matches: DataFrame, by: list[str]) -> DataFrame:
    """Sum of tp, fp, fn with precision, recall and f1."""
    sums = matches.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return sums.select(*by, "tp", "fp", "fn", *f1_columns())


def macro(matches: DataFrame, chart: str, by: list[str]) -> DataFrame:
    """Mean f1 over samples and over charts (means of their samples), with support and charts that have a reference."""
    scored = matches.select(*by, chart, "tp", "fp", "fn", *f1_columns())
    charts = scored.groupBy(*by, chart).agg(F.avg("f1").alias("f1"), F.count("*").alias("n"), F.sum("f1").alias("total"), F.max((F.col("tp") + F.col("fn") > 0).cast("int")).alias("has"), F.sum(F.col("tp") + F.col("fn")).alias("support"))
    return charts.groupBy(*by).agg(
        (F.sum("total") / F.sum("n")).alias("sample_f1"),
        F.avg("f1").alias("chart_f1"),
        F.sum("support").alias("support"),
        F.sum("has").cast("long").alias("charts_with_reference"),
    )


def seed_pairs(samples: DataFrame, chart: str, seed: str, identity: list[str]) -> DataFrame:
    """(chart, seed_a, seed_b, tp, fp, fn, identical) for every pair of samples of a chart.

    Counts per identity are compared between seeds that share the identity; what a pair has besides follows from the
    seeds' totals, so identities that don't meet are never paired.
    """
    counts = samples.groupBy(chart, seed, *identity).agg(F.count("*").alias("n"))
    totals = samples.groupBy(chart, seed).agg(F.count("*").alias("total"))
    a, b = counts.alias("a"), counts.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [chart, *identity]])
    shared = a.join(b, same & (F.col(f"a.{seed}") < F.col(f"b.{seed}"))).groupBy(F.col(f"a.{chart}").alias(chart), F.col(f"a.{seed}").alias("seed_a"), F.col(f"b.{seed}").alias("seed_b")).agg(F.sum(F.least("a.n", "b.n")).alias("tp"))
    left = totals.select(chart, F.col(seed).alias("seed_a"), F.col("total").alias("na"))
    right = totals.select(chart, F.col(seed).alias("seed_b"), F.col("total").alias("nb"))
    pairs = left.join(right, chart).filter("seed_a < seed_b").join(shared, [chart, "seed_a", "seed_b"], "left")
    tp = F.coalesce("tp", F.lit(0).cast("long"))
    return pairs.select(chart, "seed_a", "seed_b", tp.alias("tp"), (F.col("na") - tp).alias("fp"), (F.col("nb") - tp).alias("fn"), ((F.col("na") == tp) & (F.col("nb") == tp)).alias("identical"))


def multiset_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n_max, n_sum): counts of the union as a maximum and as a sum."""
    sides = a.select(*keys, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*keys, F.lit(0).alias("x"), F.lit(1).alias("y")))
    return sides.groupBy(*keys).agg(F.sum("x").alias("x"), F.sum("y").alias("y")).select(*keys, F.greatest("x", "y").alias("n_max"), (F.col("x") + F.col("y")).alias("n_sum"))


def within_tolerance(points: DataFrame, key: str, side: str, t: str, tolerances: list[float]) -> DataFrame:
    """(key, tolerance, tp, fp, fn): largest one-to-one matching of sides "p" and "e" within a tolerance, ends included.

    Points stream in order of time. What waits for a partner is of one side and not older than the tolerance; a point
    of the other side takes the earliest, which is best for intervals of one length. Nothing else is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "tolerance", "tp", "fp", "fn"]
        kind = None

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names)

        at, waits, counts = None, [], None
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for key_, side_, t_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if counts is None or key_ != at:
                    if counts is not None:
                        out += [(at, x, n["tp"], n["p"] - n["tp"], n["e"] - n["tp"]) for x, n in zip(tolerances, counts, strict=True)]
                    at, waits, counts = key_, [deque() for _ in tolerances], [{"tp": 0, "p": 0, "e": 0} for _ in tolerances]
                for x, wait, n in zip(tolerances, waits, counts, strict=True):
                    n[side_] += 1
                    while wait and wait[0][0] < t_ - x:
                        wait.popleft()
                    if wait and wait[0][1] != side_:
                        wait.popleft()
                        n["tp"] += 1
                    else:
                        wait.append((t_, side_))
            yield packed(out)
        if counts is not None:
            yield packed([(at, x, n["tp"], n["p"] - n["tp"], n["e"] - n["tp"]) for x, n in zip(tolerances, counts, strict=True)])

    kind = dict(points.dtypes)[key]
    dealt = points.filter(F.col(side).isin("p", "e") & F.col(t).isNotNull()).select(F.col(key).alias("key"), F.col(side).alias("side"), F.col(t).cast("double").alias("t")).repartition("key").sortWithinPartitions("key", "t", "side")
    return dealt.mapInArrow(run, f"key {kind}, tolerance double, tp long, fp long, fn long").withColumnRenamed("key", key)
