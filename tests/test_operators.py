import datetime
import random

import pytest
from pyspark.sql import functions as F

from chronolane.catalog import QUERIES
from chronolane.functions import scalars
from chronolane.functions.hashing import split_position
from chronolane.operators import logits, match, motif, patterns, splits, stats, timeline, tokens
from chronolane.plans import windows


def test_match_of_disjoint_lanes_and_null_identities(spark):
    p = spark.createDataFrame([("c", 0, 0, None), ("c", 0, 1, None), ("c", 5, 0, 7)], "chart string, tick int, lane int, fin int")
    e = spark.createDataFrame([("c", 0, 2, None), ("c", 0, 3, None), ("c", 5, 0, 7)], "chart string, tick int, lane int, fin int")
    with_lane = match.micro(match.multiset_match(p, e, ["tick", "lane", "fin"], ["chart"]), ["chart"]).first()
    without = match.micro(match.multiset_match(p, e, ["tick", "fin"], ["chart"]), ["chart"]).first()
    assert (with_lane.tp, with_lane.fp, with_lane.fn) == (1, 2, 2) and without.f1 == 1.0
    none = match.micro(match.multiset_match(p.limit(0), e.limit(0), ["tick"], ["chart"]), []).first()
    assert none.f1 == 0.0


def greedy(p, e, tol):
    p, e, tp, i, j = sorted(p), sorted(e), 0, 0, 0
    while i < len(p) and j < len(e):
        if abs(p[i] - e[j]) <= tol:
            tp, i, j = tp + 1, i + 1, j + 1
        elif p[i] < e[j]:
            i += 1
        else:
            j += 1
    return tp


def longest(p, e, tol):
    """Largest matching by trying everything."""
    if not p:
        return 0
    best = longest(p[1:], e, tol)
    for k, x in enumerate(e):
        if abs(p[0] - x) <= tol:
            best = max(best, 1 + longest(p[1:], e[:k] + e[k + 1 :], tol))
    return best


def test_tolerance_matching_is_the_largest(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for key in range(60):
        p, e = ([float(rng.randint(0, 14)) for _ in range(rng.randint(0, 5))] for _ in range(2))
        rows += [(key, "p", x) for x in p] + [(key, "e", x) for x in e]
        for tol in (1.0, 3.0):
            tp = longest(p, e, tol)
            assert tp == greedy(p, e, tol)
            if p or e:
                want[key, tol] = (tp, len(p) - tp, len(e) - tp)
    df = spark.createDataFrame(rows, "key int, side string, t double")
    for parts in (1, 5):
        out = {(r.key, r.tolerance): (r.tp, r.fp, r.fn) for r in match.within_tolerance(df.repartition(parts), "key", "side", "t", [1.0, 3.0]).collect()}
        assert out == want


def test_chart_mean_then_description(spark):
    df = spark.createDataFrame([("a", 0.2)] * 5 + [("b", 0.8), ("c", float("nan")), ("c", None)], "chart string, score double")
    out = stats.describe_values(stats.chart_values(df, "chart", F.col("score")), "value", []).first()
    assert out["count"] == 2 and out["mean"] == pytest.approx(0.5) and out["p50"] == pytest.approx(0.5)
    assert stats.describe_values(df.filter("chart = 'c'"), "score", []).first()["mean"] is None


def test_interval_of_one_chart_has_no_bounds(spark):
    out = stats.mean_interval(spark.createDataFrame([("a", 1.0)], "chart string, v double"), "chart", "v", [], draws=20).first()
    assert (out.n, out.mean, out.low, out.high) == (1, 1.0, None, None)


def test_condition_response_counts_unchanged_and_missing(spark):
    rows = [(0.0, 1.0, 0.0, 0.5), (0.0, 0.0, 0.0, 0.3), (None, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "target_a_f double, target_b_f double, made_a_f double, made_b_f double")
    out = stats.condition_response(df, ["f"]).first()
    assert (out.pairs, out.missing, out.unchanged, out.slope, out.direction_matches) == (1, 1, 1, 0.5, 1)


def test_split_position_is_sha256_of_seed_and_group(spark):
    import hashlib

    rows = spark.range(50).select("id", split_position(3, F.col("id")).alias("p")).collect()
    for r in rows:
        assert r.p == int(hashlib.sha256(f"3:{r.id}".encode()).hexdigest()[:16], 16) / 2**64


def test_donors_and_digest_dont_depend_on_order(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    a, b = (sorted(tuple(r) for r in splits.donor_map(d, "k", 5).collect()) for d in (df.repartition(1), df.orderBy(F.desc("k")).repartition(9)))
    assert a == b and len(a) == 200 and {d for _, d in a} <= set(range(200))
    assert splits.universe_digest(df.repartition(3), "k").first() == splits.universe_digest(df.orderBy(F.desc("k")), "k").first()
    assert splits.universe_digest(df.filter("k < 199"), "k").first() != splits.universe_digest(df, "k").first()


def test_guards_name_what_is_wrong(spark):
    pool = spark.range(3).withColumnRenamed("id", "k")
    with pytest.raises(Exception, match="not in the pool: 9"):
        splits.require_subset(spark.createDataFrame([(1,), (9,)], "k long"), pool, "k").collect()
    with pytest.raises(ValueError):
        scalars.check_ratios({"train": 0.9, "val": 0.2, "test": 0.1})
    with pytest.raises(ValueError):
        scalars.within_ranges({"x": (0, 1)}, {"y"})


def test_scalar_rules(spark):
    df = spark.createDataFrame([(64,), (192,), (320,), (448,), (0,), (128,), (256,), (384,), (358,), (51,), (96,), (480,)], "x int")
    assert [r[0] for r in df.select(scalars.lane_of_x(F.col("x"))).collect()] == [0, 1, 2, 3, 0, 1, 2, 3, 2, 0, 0, 3]
    bpm = spark.createDataFrame([(60.0,), (120.0,), (239.9,), (240.0,), (500.0,)], "b double").select(scalars.canonical_bpm(F.col("b")).alias("c")).collect()
    assert [(r.c.bpm, r.c.exponent) for r in bpm] == [(120.0, 1), (120.0, 0), (239.9, 0), (120.0, -1), (125.0, -2)]
    snap = spark.range(48).select(scalars.snap_denominator(F.col("id")).alias("n")).collect()
    from math import gcd

    assert [r.n for r in snap] == [48 // gcd(48, k) for k in range(48)]
    half = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "t double").select(scalars.ms_to_tick(F.col("t"), F.lit(0.0), F.lit(60000.0 / 48)).alias("n")).collect()
    assert [r.n for r in half] == [0, 2, 2]


def test_masks_are_never_none_or_all(spark):
    fields = ["a", "b", "c"]
    present = {"a": F.lit(True), "b": F.col("id") % 2 == 0, "c": F.lit(True)}
    for r in spark.range(300).select("id", scalars.bernoulli_mask(fields, present, 0.5, 1, F.col("id")).alias("m")).collect():
        n = 2 + (r.id % 2 == 0)
        assert 0 < sum(r.m) < n and (r.id % 2 == 0 or r.m[1] == 0)


def brute_union(intervals):
    total, reach = 0, None
    for a, b in sorted(i for i in intervals if i[1] > i[0]):
        if reach is None or a > reach:
            total, reach = total + b - a, b
        elif b > reach:
            total, reach = total + b - reach, b
    return total


def test_interval_union_and_amount(spark):
    rng = random.Random(3)
    rows = [(k, (a := rng.randint(0, 60)), a + rng.randint(-2, 15), n) for k in range(30) for n in range(rng.randint(1, 8))]
    df = spark.createDataFrame(rows, "k int, a int, b int, n int")
    union = {r.k: r.length for r in timeline.interval_union(df, ["k"], "a", "b").collect()}
    for k in range(30):
        assert union.get(k, 0) == brute_union([(a, b) for x, a, b, _ in rows if x == k])
    amount = {r.k: r.amount for r in timeline.interval_amount(df, ["k"], "a", "b", "n").collect()}
    for k in range(30):
        total, reach = 0, None
        for _, a, b, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[3])):
            if reach is None or b > reach:
                total += b - a
            reach = b if reach is None else max(reach, b)
        assert amount[k] == total


def test_grid_labels_prefer_small_denominators_in_the_window(spark):
    cells = timeline.grid_cells((1, 2, 3, 4))
    assert cells == [(0, 1), (1, 4), (1, 3), (1, 2), (2, 3), (3, 4)]
    df = spark.createDataFrame([(249.5,), (333.0,), (0.0,), (120.0,)], "t double").withColumn("s", F.lit(0.0)).withColumn("n", F.lit(1000.0))
    out = [(r.numer, r.denom, r.in_window) for r in timeline.label_grid(df, "t", "s", "n", cells).collect()]
    assert out == [(1, 4, True), (1, 3, True), (0, 1, True), (0, 1, False)]


def test_tokens_round_trip_and_grammar(spark):
    events = spark.createDataFrame([("c", 0, 0, "start"), ("c", 3, 1, "tap"), ("c", 30, 0, "end"), ("c", 30, 2, "tap")], "chart string, tick int, lane int, kind string")
    rows = tokens.event_rows(events, "chart", "tick", "lane", "kind")
    assert sorted((r.tick, r.row) for r in rows.collect()) == [(0, "2000"), (3, "3100"), (30, "4010")]
    placed = rows.withColumn("bar", F.floor(F.col("tick") / 10)).withColumn("pos", F.pmod("tick", F.lit(10)))
    seq = tokens.encode_tokens(placed, "chart", "bar", "pos", "row")
    assert seq.first().tokens == ["BAR", "POS_0", "ROW_2000", "POS_3", "ROW_3100", "BAR", "BAR", "BAR", "POS_0", "ROW_4010"]
    assert sorted((r.bar, r.pos, r.row) for r in tokens.decode_tokens(seq, "chart", "tokens").collect()) == [(0, 0, "2000"), (0, 3, "3100"), (3, 0, "4010")]
    assert tokens.first_illegal(seq, "chart", "tokens").count() == 0
    bad = spark.createDataFrame([("a", ["BAR", "ROW_0000"]), ("b", ["BAR", "POS_2", "ROW_1000", "POS_1", "ROW_1000"]), ("d", ["BAR", "POS_1", "ROW_3000"]), ("e", ["POS_1"])], "chart string, tokens array<string>")
    assert {r.chart: (r.i, r.reason) for r in tokens.first_illegal(bad, "chart", "tokens").collect()} == {"a": (1, "row without a position"), "b": (3, "position doesn't rise"), "d": (2, "lane state"), "e": (0, "outside a bar")}
    framed = seq.select(tokens.frame_tokens(F.col("tokens"), F.lit("0000")).alias("f"), "tokens")
    r = framed.select("tokens", "f", tokens.unframe_tokens(F.col("f")).alias("u"), tokens.loss_mask(F.col("f")).alias("m")).first()
    assert r.u == r.tokens and r.m == [0, 0] + [1] * (len(r.tokens) + 1)


def test_plausibility_of_known_notes(spark):
    notes = [(0, 0, 100), (102, 0, None), (111, 0, None), (121, 0, None), (5, 1, 5), (5, 1, None), (0, 2, 1000), (200, 2, None)]
    df = spark.createDataFrame(notes, "t int, lane int, fin int")
    out = tokens.plausibility(df, ["lane"], "t", "fin")
    assert tuple(out.agg(*[F.count_if(c) for c in ("concurrent", "almost", "duplicate_start", "nonpositive_hold")]).first()) == (3, 3, 1, 1)


def brute_motifs(sequences, top, longest):
    from collections import Counter

    counts = Counter()
    for s in sequences:
        for n in range(1, longest + 1):
            for i in range(len(s) - n + 1):
                text = s[i][0] + "".join(f"/{s[k + 1][1] - s[k][1]}/{s[k + 1][0]}" for k in range(i, i + n - 1))
                counts[text] += 1
    return sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:top]


def test_level_wise_motifs_equal_all_ngrams(spark):
    rng = random.Random(4)
    sequences = [[(rng.choice("AB"), t) for t in sorted(rng.sample(range(40), rng.randint(2, 9)))] for _ in range(25)]
    df = spark.createDataFrame([(k, t, s) for k, seq in enumerate(sequences) for s, t in seq], "seq int, t int, symbol string").withColumn("scope", F.lit("x"))
    stepped = motif.steps(df, ["scope", "seq"], ["t"], "symbol", "t")
    for top in (5, 30):
        out = motif.motif_topk(stepped, ["scope", "seq"], ["scope"], top)
        assert sorted(((r.motif, r.n) for r in out.collect()), key=lambda kv: (-kv[1], kv[0])) == brute_motifs(sequences, top, 9)


def test_row_primitives_against_rules(spark):
    rows = spark.createDataFrame([("c", 0, "1000"), ("c", 1, "0100"), ("c", 2, "0110"), ("c", 3, "0000"), ("c", 4, "0003"), ("c", 5, "1001")], "chart string, t int, row string")
    out = {r.t: (r.notes, r.jacks, r.direction, r.roll, r.delta) for r in patterns.row_primitives(rows, "chart", "t", "row").collect()}
    assert out == {1: (1, 0, "right", True, 4.0), 2: (2, 1, "outwards", False, 4.0), 4: (0, 0, "none", False, 8.0), 5: (2, 0, "outwards", False, 4.0)}


def test_tempo_clusters_join_the_first_founder(spark):
    df = spark.createDataFrame([("c", "stream", i, i + 1, ms, False) for i, ms in enumerate([100.0, 104.0, 108.0, 96.0])], "chart string, pattern string, start int, end int, ms_per_beat double, mixed boolean")
    out = [r.bpm for r in patterns.tempo_clusters(df, "chart").orderBy("start").collect()]
    assert out == [600, 600, 556, 600]


def overlap_by_hand(low, high, size=16, context=8, keep=4):
    if low >= high:
        return []
    if high - low <= size:
        return [(low, low + size, low, high)]
    out, at = [], low
    while at < high:
        if at == low:
            start, end = low, low + context
        else:
            start, end = at - context, at + keep
            if start + size > high:
                start, end = high - size, high
        out.append((start, start + size, at, end))
        at = end
    return out


def test_overlap_windows_partition_every_span(spark):
    spans = [(low, low + n) for low in (-3, 0, 5) for n in range(0, 60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "k int, a int, b int")
    out = {}
    for r in windows.overlap_windows(df, "k", "a", "b").orderBy("k", "n").collect():
        out.setdefault(r.k, []).append((r.start, r.end, r.keep_start, r.keep_end))
    for i, (a, b) in enumerate(spans):
        assert out.get(i, []) == overlap_by_hand(a, b)


def test_batches_keep_the_budget_and_every_row(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(i, rng.choice([0, 5, 50, 52, 300, 301, 900])) for i in range(200)], "k int, n int")
    packed = windows.pack_batches(df, "k", "n", 1000, 0, 1).join(df, "k")
    assert packed.count() == 200 and packed.filter("n <= 0 AND batch IS NOT NULL").count() == 0
    rules = windows.batch_rules(packed.filter("batch IS NOT NULL"), ["window", "batch"], "n", 1000, 800)
    assert rules.filter("NOT fits").count() == 0
    spread = packed.filter("window IS NOT NULL").groupBy("window").agg((F.max("n") <= F.min("n") * 1.1).alias("ok"))
    assert spread.filter("NOT ok").count() == 0


def test_logits_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist(), int(rng.integers(0, 6)), sorted(rng.choice(6, 3, replace=False).tolist())) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, x array<double>, gold int, allowed array<int>")
    for r in df.select("*", logits.nll(F.col("x"), F.col("gold")).alias("nll"), logits.legal(F.col("x"), F.col("allowed")).alias("legal"), logits.decision(F.col("x"), F.col("allowed"), F.col("gold"), 0.7).alias("d")).collect():
        x = np.array(r.x)
        p = np.exp(x) / np.exp(x).sum()
        assert r.nll == pytest.approx(-np.log(p[r.gold])) and r.legal.mass == pytest.approx(p[r.allowed].sum())
        q = p[r.allowed] / p[r.allowed].sum()
        assert r.d.raw_rank == 1 + (x > x[r.gold]).sum() and r.d.entropy == pytest.approx(-(q * np.log(q)).sum())


def test_early_stop_counts_since_the_best(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([3.0, 2.0, 2.0, 2.5, 1.0, 1.5])], "step int, loss double").withColumn("run", F.lit("r"))
    out = [(r.best, r.stalled, r.stop) for r in stats.early_stop(df, ["run"], "step", "loss", 2).orderBy("step").collect()]
    assert out == [(3.0, 0, False), (2.0, 0, False), (2.0, 1, False), (2.0, 2, True), (1.0, 0, False), (1.0, 1, False)]


def test_motif_query_has_no_longest_motif(spark, tmp_path):
    """A user who repeats one event within a day: motifs of five and more symbols are in the top."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, 1, "click", 1.0, start + datetime.timedelta(minutes=i)) for i in range(60)] + [(100 + i, 2, "view" if i % 2 else "error", 1.0, start + datetime.timedelta(days=i)) for i in range(9)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    out = [(r.motif, r.n) for r in QUERIES["motif_topk"](spark, str(tmp_path)).collect()]
    want = brute_motifs([[("click", 0)] * 60, [("view" if i % 2 else "error", i) for i in range(9)]], 25, 60)
    assert sorted(out, key=lambda kv: (-kv[1], kv[0])) == want and max(m.count("click") for m, _ in out) == 25
