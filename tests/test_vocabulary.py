"""Motif lists, ranks and distances against plain loops."""

import math
import os
import random
from collections import Counter

import pytest

from chronolane.operators import ranks, stats
from chronolane.operators.vocabulary import BUCKETS, count_motifs, distance_report, distance_to, length_shares, motif_report, window_coverage
from chronolane.plans import reports


def sequences(seed, lengths):
    rng = random.Random(seed)
    return {(c, scope, part): [(rng.choice("ab"), rng.choice([0, 0, 1, 7])) for _ in range(n)] for c, n in enumerate(lengths) for scope, part in (("lane", "0"), ("lane", "1"), ("row", "all"))}


def steps_of(spark, seqs, sections=None):
    rows = [(c, scope, part, i, s, g if i + 1 < len(x) else None, (i // 5)) for (c, scope, part), x in seqs.items() for i, (s, g) in enumerate(x)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "chart int, scope string, part string, i long, symbol string, gap long, section long")


def text(x, i, length):
    return "/".join([x[i][0]] + [f"{x[i + k - 1][1]}/{x[i + k][0]}" for k in range(1, length)])


def loop(seqs, listed):
    out = Counter()
    for (_, scope, part), x in seqs.items():
        for length in range(1, 9):
            for i in range(len(x) - length + 1):
                if (scope, text(x, i, length)) in listed:
                    out[scope, part, text(x, i, length)] += 1
    return out


@pytest.mark.parametrize("chunk", [1 << 16, 16])
def test_counts_in_one_pass(spark, chunk):
    seqs = sequences(4, [1, 2, 40, 90, 200, 0])
    rng = random.Random(9)
    long = [(k, x) for k, x in seqs.items() if len(x) > 20]
    listed = {(k[1], text(x, rng.randrange(len(x) - 8), rng.randint(1, 7))) for k, x in long for _ in range(15)} | {("lane", "a"), ("row", "a"), ("row", "zz/3/a"), ("lane", "a/0/a"), ("other", "a")}
    vocabulary = spark.createDataFrame(sorted(listed), "scope string, motif string")
    got = {(r.scope, r.part, r.motif): r.n for r in count_motifs(steps_of(spark, seqs).repartition(5), ["chart"], vocabulary, chunk).collect()}
    want = loop(seqs, listed)
    assert got == dict(want) and max(want.values()) > 50
    report = motif_report(steps_of(spark, seqs), ["chart"], vocabulary, chunk).collect()
    charts = len({k[0] for k, x in seqs.items() if x})
    assert len(report) == 3 * sum(s == "lane" for s, _ in listed) + sum(s == "row" for s, _ in listed)
    for r in report:
        parts = ["0", "1"] if (r.scope, r.part) == ("lane", "all") else [r.part]
        assert r.n == sum(want[r.scope, p, r.motif] for p in parts) and math.isclose(r.average, r.n / charts)
        assert r.observations == sum(len(x) for k, x in seqs.items() if k[1] == r.scope and k[2] in parts)


def test_one_scan_whatever_the_lengths(spark, tmp_path):
    steps_of(spark, sequences(4, [30])).write.parquet(f"{tmp_path}/s")
    stepped = spark.read.parquet(f"{tmp_path}/s")
    vocabulary = spark.createDataFrame([("lane", "a"), ("lane", "a/0/b"), ("lane", "a/0/b/1/a/1/b")], "scope string, motif string")
    plan = count_motifs(stepped, ["chart"], vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Window" not in plan


def test_coverage(spark):
    seqs = sequences(6, [3, 30, 55])
    listed = {("lane", "a"), ("lane", "b/0/a"), ("row", "a/0/a/0/a")}
    stepped = steps_of(spark, seqs)
    counts = count_motifs(stepped, ["chart"], spark.createDataFrame(sorted(listed), "scope string, motif string"))
    got = {(r.scope, r.length): (r.windows, r.crossing, r.hits, r.coverage) for r in window_coverage(stepped, ["chart"], "section", counts, [1, 2, 6]).collect()}
    found = loop(seqs, listed)
    for scope in ("lane", "row"):
        for length in (1, 2, 6):
            spans = [(i // 5, (i + length - 1) // 5) for (_, s, _), x in seqs.items() if s == scope for i in range(len(x) - length + 1)]
            hits = sum(n for (s, _, m), n in found.items() if s == scope and (m.count("/") + 2) // 2 == length)
            assert got[scope, length] == (len(spans), sum(a != b for a, b in spans), hits, hits / len(spans))


def test_empty_list_and_empty_steps(spark):
    none = spark.createDataFrame([], "scope string, motif string")
    stepped = steps_of(spark, sequences(1, [9]))
    assert count_motifs(stepped, ["chart"], none).count() == 0
    some = spark.createDataFrame([("lane", "a")], "scope string, motif string")
    assert count_motifs(stepped.limit(0), ["chart"], some).count() == 0 and motif_report(stepped.limit(0), ["chart"], some).count() == 0


def test_undefined_and_defined_distances(spark):
    left = [("lane", "a", 6, 10), ("lane", "b", 0, 10), ("lane", "a/1/b", 3, 10), ("row", "a", 0, 0), ("row", "b", 0, 0)]
    right = [("lane", "a", 1, 20), ("lane", "b", 8, 20), ("lane", "a/1/b", 6, 20), ("row", "a", 4, 9), ("row", "b", 1, 9)]
    frames = [spark.createDataFrame(x, "scope string, motif string, n long, observations long") for x in (left, right)]
    rows = distance_report(*frames, ["scope"], 2).collect()
    undefined = {(r.section, r.name): r.value for r in rows if r.scope == "row"}
    assert undefined == {("summary", "vocabulary"): 2.0, ("summary", "mae"): None, ("summary", "rmse"): None, ("summary", "spearman"): None} | {("bucket", n): None for n, _, _ in BUCKETS}
    got = {(r.section, r.name): (r.rank, r.length, r.f_left, r.f_right, r.value) for r in rows if r.scope == "lane"}
    value = lambda *k: got[k][-1]
    assert math.isclose(value("summary", "mae"), (0.55 + 0.4 + 0.0) / 3) and math.isclose(value("summary", "rmse"), math.sqrt((0.55**2 + 0.4**2) / 3))
    assert got["largest", "a"][:2] == (1, 1) and math.isclose(value("excess", "a"), 0.55) and set(k for k in got if k[0] == "gap") == {("gap", "a"), ("gap", "b")}
    assert math.isclose(value("bucket", "1"), 0.475) and value("bucket", "3") is None and math.isclose(value("contribution", "1"), 0.95 / 3) and value("contribution", "17+") == 0
    assert got["length", "2"][:2] == (1, 2) and math.isclose(value("summary", "spearman"), -1.0)


def loop_ranks(values):
    known = [v for v in values if v is not None]
    return [None if v is None else sum(w < v for w in known) + (sum(w == v for w in known) + 1) / 2 for v in values]


def test_ranks_and_percentiles(spark):
    rng = random.Random(2)
    groups = {"ties": [rng.choice([0.0, 0.0, 1.5, -3.0]) for _ in range(300)], "spread": [rng.gauss(0, 1e6) for _ in range(700)], "one": [4.0], "nulls": [None, None], None: [3.0, None, 2.0, 2.0]}
    rows = [(g, i, v) for g, x in groups.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = {(r.g, r.i): r.rank for r in ranks.average_ranks(df, ["g"], {"rank": "v"}).collect()}
    assert got == {(g, i): r for g, x in groups.items() for i, r in enumerate(loop_ranks(x))}
    import numpy as np

    points = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p995": 0.995, "p100": 1.0}
    for r in ranks.exact_percentiles(df, "v", ["g"], points).collect():
        known = [v for v in groups[r.g] if v is not None]
        assert np.allclose([r[n] for n in points], [np.quantile(known, p) for p in points.values()])
    whole = stats.describe_values(df, "v", []).first()
    known = [v for x in groups.values() for v in x if v is not None]
    assert whole["count"] == len(known) and np.allclose([whole.p10, whole.p50, whole.p90], np.quantile(known, [0.1, 0.5, 0.9]))
    assert stats.describe_values(df.limit(0), "v", []).first()["count"] == 0
    assert ranks.exact_percentiles(df.limit(0), "v", ["g"], points).count() == 0


def test_no_task_gets_all_rows(spark):
    """In ranks of one group the only exchange to a single task carries a row for each cell."""
    df = spark.range(5000).selectExpr("id * id % 977 / 7.0 AS v").cache()
    plan = ranks.running_counts(df, [], "v")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" in plan
    counted = ranks.running_counts(df, [], "v").selectExpr("floor(before / 200) AS part").groupBy("part").count()
    assert counted.count() > 10
    single = [line for line in plan.splitlines() if "SinglePartition" in line]
    below = plan.splitlines()[plan.splitlines().index(single[0]) + 1]
    assert "HashAggregate" in below and "_cell" in below


def test_counts_kept_apart(spark):
    """Counts by corpus equal those of each corpus alone; a corpus without any motif of the list keeps its zeros."""
    sides = {0: sequences(4, [30, 3]), 1: sequences(5, [25]), None: sequences(6, [12])}
    listed = spark.createDataFrame([("lane", "a"), ("lane", "a/0/b"), ("row", "b/1/a"), ("row", "zz")], "scope string, motif string")
    both = None
    for side, seqs in sides.items():
        rows = steps_of(spark, seqs).selectExpr(f"CAST({'NULL' if side is None else side} AS INT) AS side", "*")
        both = rows if both is None else both.unionByName(rows)
    counted = count_motifs(both.repartition(3), ["side", "chart"], listed, 16, by=["side"])
    assert counted.columns == ["side", "scope", "part", "motif", "n"]
    keys = {(r.scope, r.motif) for r in listed.collect()}
    assert {(r.side, r.scope, r.part, r.motif): r.n for r in counted.collect()} == {(side, *k): n for side, seqs in sides.items() for k, n in loop(seqs, keys).items()}
    report = motif_report(both, ["side", "chart"], listed, by=["side"]).collect()
    for side in (0, 1):
        alone = motif_report(steps_of(spark, sides[side]), ["chart"], listed).collect()
        assert sorted(tuple(r)[1:] for r in report if r.side == side) == sorted(map(tuple, alone))
    assert {r.n for r in report if r.motif == "zz"} == {0}


def test_distances_to_one_corpus(spark):
    """Each corpus against the same other one, a figure at a time; stored figures are confirmed or named."""
    listed = spark.createDataFrame([("lane", "a"), ("lane", "b"), ("lane", "a/0/b"), ("row", "a")], "scope string, motif string")
    sides = {0: sequences(4, [30]), 1: sequences(5, [25])}
    human = motif_report(steps_of(spark, sequences(9, [80])), ["chart"], listed)
    made = None
    for side, seqs in sides.items():
        rows = steps_of(spark, seqs).selectExpr(f"{side} AS side", "*")
        made = rows if made is None else made.unionByName(rows)
    made = motif_report(made, ["side", "chart"], listed, by=["side"])
    got = distance_to(made, human, ["side"])
    for side, seqs in sides.items():
        alone = motif_report(steps_of(spark, seqs), ["chart"], listed).filter("part = 'all'")
        want = distance_report(alone, human.filter("part = 'all'"), ["scope"])
        assert sorted(map(str, want.collect())) == sorted(map(str, got.filter(f"side = {side}").drop("side").collect()))
    shares = length_shares(got, ["side", "scope"]).collect()
    total = {(r.side, r.scope): r.value for r in got.filter("section = 'summary' AND name = 'mae'").collect()}
    for key, mae in total.items():
        own = [r for r in shares if (r.side, r.scope) == key]
        assert math.isclose(sum(r.contribution for r in own), mae) and math.isclose(sum(r.share for r in own), 1.0 if mae else 0.0)
    stored = got.filter("section = 'summary'").select("side", "scope", "name", "value")
    odd = reports.recheck_distances(stored, made, human, ["side"]).collect()
    assert {(r.side, r.scope, r.name) for r in odd} == {(s, "row", "spearman") for s in sides}  # a list of one has no rank correlation
    changed = stored.selectExpr("side", "scope", "name", "value + IF(side = 1 AND name = 'mae', 1e-6, 1e-10) AS value").filter("NOT (side = 0 AND name = 'rmse')")
    odd = {(r.side, r.scope, r.name) for r in reports.recheck_distances(changed, made, human, ["side"]).collect()}
    assert odd == {(s, "row", "spearman") for s in sides} | {(1, sc, "mae") for sc in ("lane", "row")} | {(0, sc, "rmse") for sc in ("lane", "row")}


def test_issues_and_missing_charts(spark):
    samples = spark.createDataFrame([(s, c, 0, "tap", 1) for s in (0, 1) for c in (7, 8)], "seed int, chart int, lane int, kind string, pos int")
    issues = spark.createDataFrame([(0, 7, "tail"), (0, 7, "tail"), (0, 8, "tail"), (1, 8, "head")], "seed int, chart int, issue string")
    got = {(r.seed, r.issue): (r.charts_with, r.instances, r.charts) for r in reports.issue_totals(issues, samples, ["seed"], "chart", "issue", ["head", "tail"]).collect()}
    assert got == {(0, "tail"): (2, 3, 2), (0, "head"): (0, 0, 2), (1, "tail"): (0, 0, 2), (1, "head"): (1, 1, 2)}
    requested = spark.createDataFrame([(7,), (8,), (8,), (None,)], "chart int")
    assert reports.seed_scores(requested, samples, "chart", "seed", ["lane"], "pos").count() == 4
    with pytest.raises(ValueError):
        reports.seed_scores(requested, samples.filter("NOT (seed = 1 AND chart = 8)"), "chart", "seed", ["lane"], "pos")
    with pytest.raises(ValueError):
        reports.seed_scores(requested, samples.withColumn("chart", samples.chart + 5), "chart", "seed", ["lane"], "pos")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the supplied tables")
def test_halves_read_the_events_once(spark, monkeypatch):
    """Steps are written once, and distances read written counts."""
    from chronolane.operators import motif
    from chronolane.queries import vocabulary as queries

    written = []
    keep = lambda real: lambda df, name: written.append((name, any("events.parquet" in f for f in df.inputFiles()))) or real(df, name)
    for module in (queries, motif):
        monkeypatch.setattr(module, "cut", keep(module.cut))
    for counts in queries._halves(spark, "/root/testdata/sf0.001"):
        assert not any("events.parquet" in f for f in counts.inputFiles())
    assert written == [("steps", True), ("made", False), ("human", False)]
