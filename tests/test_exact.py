"""Zero weights and lengths, folds over long charts, ledgers in any order and exact places, against plain loops."""

import random

import pytest

from chronolane.functions.scalars import reduced
from chronolane.operators import match, patterns, splits, stats, timeline
from chronolane.sources import artifacts
from chronolane.streaming import ledger


def test_zero_weights_are_null(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 2.0, 0.0), ("b", 3.0, 2.0), ("b", None, 5.0)], "g string, v double, w double")
    got = {r.g: (r.v_mean, r.v_weighted, r.v_perplexity) for r in stats.weighted_means(df, ["g"], ["v"], "w").collect()}
    assert got["a"] == (1.5, None, None) and got["b"][1] == 3.0
    rows = [("m", 10, 0.5, 4, 0, 1, 2), ("m", 30, 1.0, 0, 0, None, None)]
    charts = spark.createDataFrame(rows, "mode string, tokens int, loss double, taps int, ends int, right int, total int")
    out = {(r.section, r.name): r.value for r in stats.teacher_summary(charts, ["mode"], ["loss"], ["loss"], "tokens", "loss", {"tap": {"tokens": "taps", "nll": "loss"}, "end": {"tokens": "ends", "nll": "loss"}}, {"lane": ("right", "total")}).collect()}
    assert out["chart", "charts"] == 2 and out["chart", "loss"] == 0.75 and out["token", "loss"] == 0.875 and out["tap", "nll"] == 0.5
    assert out["end", "tokens"] == 0 and out["end", "nll"] is None and out["end", "perplexity"] is None
    assert (out["rows", "available"], out["rows", "lane_correct"], out["rows", "lane_total"], out["rows", "lane_rate"]) == (1, 1, 2, 0.5)


def test_segments_of_no_length(spark):
    changes = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.0, 1.0)], "c long, t double, v double")
    tempos = spark.createDataFrame([(1, 0.0, 0.0), (1, 5.0, 500.0), (2, 0.0, 500.0)], "c long, t double, len double")
    spans = spark.createDataFrame([(1, 0.0, 10.0), (2, 0.0, 10.0)], "c long, first double, last double")
    assert {r.c: r.speed_time for r in patterns.speed_time(changes, tempos, spans, "c", "t", "v", "len").collect()} == {1: 2001.0, 2: 0.0}


def test_shares_of_every_kind(spark):
    intervals = spark.createDataFrame([(1, "a", 0, 4), (1, "a", 2, 6), (3, "a", 0, 9)], "c long, kind string, s long, e long")
    charts = spark.createDataFrame([(1, 12), (2, 5), (3, 0)], "c long, d long")
    got = {(r.c, r.kind): r.share for r in timeline.pattern_share(intervals, "c", "kind", "s", "e", charts, "d", ["a", "b"]).collect()}
    assert got == {(1, "a"): 0.5, (1, "b"): 0.0, (2, "a"): 0.0, (2, "b"): 0.0, (3, "a"): None, (3, "b"): None}
    summary = spark.createDataFrame([(1, "jacks", 3.0), (1, "jacks", 1.0), (1, "stream", 4.0)], "c long, pattern string, importance double")
    cores = {(r.c, r.pattern): r.share for r in patterns.core_distribution(summary, "c", charts).collect()}
    assert len(cores) == 18 and cores[1, "jacks"] == cores[1, "stream"] == 0.5 and cores[1, "density"] == 0 and cores[2, "jacks"] == 0


def test_categories(spark):
    names = "array<struct<name:string,share:double>>"
    rows = [
        (1, "chordstream", [("Jumpstream", 0.04), ("Handstream", 0.03)], False, 9.0),
        (2, "chordstream", [("Jumpstream", 0.04), ("Handstream", 0.01)], True, 9.0),
        (3, "chordstream", [("Handstream", 0.04), ("Jumpstream", 0.03)], False, 9.0),
        (4, "jacks", [("Gluts", 0.5)], True, 9.0),
        (4, "stream", [], False, 1.0),
    ]
    summary = spark.createDataFrame([(*r, 1.0, 100) for r in rows], f"c int, pattern string, names {names}, mixed boolean, importance double, amount double, bpm long")
    charts = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "c int")
    assert {r.c: r.category for r in patterns.categorise(summary, "c", charts=charts).collect()} == {1: "Jumpstream/Handstream", 2: "Chordstream Tech", 3: "Chordstream", 4: "Gluts Tech", 5: "Uncategorised"}


def test_clusters_of_a_long_chart(spark):
    rng = random.Random(8)
    rows = [(c, rng.choice(["jacks", "stream"]), rng.choice([None, "Gluts"]), float(rng.randrange(4000)), 0.0, rng.choice([0.0, 100.0, 103.0, 106.0, 120.0, 250.0, 252.5]), rng.random() < 0.2) for c in ("x", "y", None) for _ in range(3000)]
    df = spark.createDataFrame(rows, "chart string, pattern string, name string, start double, end double, ms_per_beat double, mixed boolean")
    want = []
    for chart in ("x", "y", None):
        mine = sorted((r for r in rows if r[0] == chart), key=lambda r: (r[3], r[1], r[4], r[5], r[2] is None, r[2] or ""))
        founders, members = [], {}
        for r in mine:
            k = r[1] if r[6] else next((i for i, f in enumerate(founders) if abs(f - r[5]) < 5), len(founders))
            founders += [r[5]] if k == len(founders) else []
            members.setdefault(k, []).append(r)
        for group in members.values():
            mean = sum(r[5] for r in group) / len(group)
            want += [(*r, round(60000 / mean) if mean > 0 else 0) for r in group]
    got = [tuple(r) for r in patterns.tempo_clusters(df.repartition(7), "chart").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_late_rows_of_older_sequences_lose(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(12), rng.choice(["failed", "failed", "failed", "pending", "completed"]) if i % 5 else "pending", rng.choice([None, "e1", "e2"]), i) for i in range(120)]
    rng.shuffle(rows)
    schema = "key long, status string, error string, seq long"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = {}

    def put(batch, epoch):
        seen.update({r.key: (r.status, r.error) for r in batch.collect()})

    try:
        for part in range(4):  # two runs: the second restarts from the checkpoint
            spark.createDataFrame(rows[part * 30 : part * 30 + 30], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            if part % 2:
                ledger.status_stream(source.json(str(tmp_path / "in"))).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert seen == {r.key: (r.status, r.error) for r in ledger.status_of(spark.createDataFrame(rows, schema), "key", "status", "seq", "error").collect()}


def test_files_are_worked_out_once_a_fingerprint(spark, tmp_path):
    schema, done = "key long, size long, seq long", []

    def compute(df):
        done.append(sorted((r.key, r["size"]) for r in df.collect()))
        return df.selectExpr("key", "size", "size * 2 AS made")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        ledger.incremental(spark.readStream.schema(schema).json(str(tmp_path / "in")), "key", "size", "seq", compute, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return {r.key: r.made for r in ledger.cached(spark, str(tmp_path / "out"), "key").collect()}

    assert ledger.cached(spark, str(tmp_path / "out"), "key") is None
    assert run([(1, 10, 1), (2, 20, 1), (2, 21, 2)]) == {1: 20, 2: 42}
    assert run([(1, 10, 3), (2, 22, 4), (3, 30, 4)]) == {1: 20, 2: 44, 3: 60}
    assert [x for x in done if x] == [[(1, 10), (2, 21)], [(2, 22), (3, 30)]]


def test_torn_ends_of_several_files(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("k string, v long")
    (tmp_path / "a.jsonl").write_text('{"k":"a","v":1}\n\n{"k":"é","v":5}\n{"k":"a","v":9')
    (tmp_path / "b.jsonl").write_text('{"k":"b","v":2}\n{"k":"b","v":3}\n')
    (tmp_path / "c.jsonl").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("16", before):  # a file in several splits
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert sorted((r.k, r.v) for r in artifacts.read_journal(spark, str(tmp_path), schema, ["k"]).collect()) == [("a", 1), ("b", 3), ("é", 5)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_places_meet_in_lowest_terms(spark):
    df = spark.createDataFrame([(1, 3), (2, 6), (0, 7), (48, 96), (5, 0), (1, 200)], "n int, d int")
    assert [tuple(r.x) if r.x else None for r in df.select(reduced(df.n, df.d).alias("x")).collect()] == [(1, 3), (1, 3), (0, 1), (1, 2), None, None]
    schema = "chart int, beat long, numer int, denom int, lane int, kind string, seq int"
    left = spark.createDataFrame([(1, 0, 1, 3, 0, "tap", 1), (1, 1, 2, 4, 1, "start", 2), (1, 2, 0, 5, 1, "end", 3), (1, 3, 1, 7, 2, "start", 4)], schema)
    right = spark.createDataFrame([(1, 0, 2, 6, 0, "tap", 1), (1, 1, 1, 2, 1, "start", 2), (1, 2, 1, 5, 1, "end", 3)], schema)
    got = {r.view: (r.tp, r.fp, r.fn) for r in match.exact_views(left, right, ["chart"], "beat", "numer", "denom", "lane", "kind", "seq").collect()}
    assert got == {"event": (2, 2, 1), "kind": (2, 2, 1), "lane": (2, 2, 1), "note": (1, 1, 1)}


def test_digest_and_donors_of_any_size(spark, monkeypatch):
    df = spark.range(3000).withColumnRenamed("id", "k")
    digest = splits.universe_digest(df, "k").first()
    assert digest == splits.universe_digest(df.union(df).repartition(9), "k").first() and digest.n == 3000 and len(digest.digest) == 64
    assert splits.universe_digest(df.limit(0), "k").first().n == 0
    monkeypatch.setattr(splits, "BUCKET", 10)
    donors = splits.donor_map(df, "k", 5).collect()
    assert len(donors) == 3000 and {r.target for r in donors} == set(range(3000)) and {r.donor for r in donors} <= set(range(3000))


def test_unassigned_groups_are_left_out(spark):
    charts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z")], "chart int, g string")
    groups = spark.createDataFrame([("a", "train", 1), ("b", "test", 2)], "g string, split string, n int")
    assert sorted((r.chart, r.split) for r in splits.assign_splits(charts, groups, "g").collect()) == [(1, "train"), (2, "test")]


@pytest.mark.parametrize("limit", [19, 200])
def test_over_long_windows_are_skipped(spark, limit):
    from chronolane.plans import windows

    rng = random.Random(4)
    bars = [(c, rng.randrange(30)) for c in (1, 2, 3) for _ in range(20 * c)]
    events = spark.createDataFrame(bars, "c long, bar long")
    spans = spark.createDataFrame([(1, 0, 30), (2, 0, 30), (3, 0, 30), (4, 0, 15)], "c long, low long, high long")
    drawn = windows.window_samples(spans, "c", "low", "high", 8, 3).collect()
    want = {(r.c, r["sample"], r.start, 19 + 2 * sum(c == r.c and r.start <= b < r.start + 16 for c, b in bars)) for r in drawn}
    got = {(r.c, r["sample"], r.start, r.tokens) for r in windows.kept_samples(events, spans, "c", "bar", "low", "high", 8, 3, limit).collect()}
    assert got == {w for w in want if w[3] <= limit} and len(want) == 24


def test_nearest_cell_by_a_running_tie(spark):
    """Distances a little apart chain: what is held decides, not the smallest of all."""
    cells = [(0, 1), (1, 4), (1, 3), (1, 2), (2, 3), (3, 4)]
    rng = random.Random(7)
    points = [rng.uniform(-300, 1500) for _ in range(200)] + [125.0, 125.0 + 4e-13, 125.0 - 4e-13, 291.6666666666667, 416.6666666666667, 583.3333333333334, -50.0]
    df = spark.createDataFrame([(i, t, 0.0, 500.0) for i, t in enumerate(points)], "i int, t double, start double, nominal double")
    got = {r.i: (r.numer, r.denom, r.in_window) for r in timeline.label_grid(df, "t", "start", "nominal", cells).collect()}
    for i, t in enumerate(points):
        at = [(n, d, 0.0 + n * 500.0 / d - t) for n, d in cells]
        inside = [(d, abs(off), n) for n, d, off in at if -1e-6 < off < 1.0 + 1e-6]
        held = None
        for n, d, off in at:
            x = abs(off)
            if held is None or x + 1e-12 < held[0] or (x <= held[0] + 1e-12 and (d, n) < held[1:]):
                held = (x, d, n)
        want = (min(inside)[2], min(inside)[0], True) if inside else (held[2], held[1], False)
        assert got[i] == want, (t, got[i], want)


def test_places_of_beats(spark):
    segments = spark.createDataFrame([(1, 0.0, 400.0), (1, 1000.0, 300.0)], "c int, t double, length double")
    from pyspark.sql import functions as F

    beats = timeline.beat_grid(segments, "c", "t", "length", F.lit(1700.0))
    points = [(r.beat, r.numer, r.denom, r.t) for r in timeline.grid_points(beats, "c", [(0, 1), (1, 4), (1, 2), (3, 4)], F.lit(1700.0)).orderBy("t").collect()]
    want = [(b, n, d, s + n / d * 400) for b, s in enumerate((0.0, 400.0, 800.0)) for n, d in ((0, 1), (1, 4), (1, 2), (3, 4)) if s + n / d * 400 < 1000]
    want += [(3 + k, n, d, 1000 + 300 * k + n / d * 300) for k in range(3) for n, d in ((0, 1), (1, 4), (1, 2), (3, 4)) if 1000 + 300 * k + n / d * 300 < 1700 - 1e-6]
    assert points == want


def test_conditions_of_scenarios_and_masks_of_a_plan(spark):
    from chronolane.plans import reports

    meta = spark.createDataFrame([(1, 5.0, "a"), (2, None, "b"), (3, 7.0, None)], "k int, x double, y string")
    donors = spark.createDataFrame([(1, 2), (2, 3), (3, 3)], "target int, donor int")
    got = {(r.target, r.scenario): (r.donor, r["mask"], r.x, r.y) for r in reports.scenario_conditions(donors, meta, "k", ["x", "y"], 1).collect()}
    assert len(got) == 15 and got[1, "matched"] == (None, "11", 5.0, "a") and got[1, "random"] == (2, "01", None, "b") and got[3, "none"] == (None, "00", None, None)
    assert got[1, "matched_partial"][1] in ("01", "10") and got[2, "matched_partial"][1] in ("00", "01")
    with pytest.raises(Exception, match="donor without a row"):
        reports.scenario_conditions(spark.createDataFrame([(1, 9)], "target int, donor int"), meta, "k", ["x"], 1).collect()
    charts = spark.createDataFrame([(i, i % 30, 100 + i, None, f"s{i}" if i % 3 else None) for i in range(300)], "k long, g long, n long, reason string, source string")
    plan = reports.train_plan(charts, "g", "k", "n", {"train": 0.8, "val": 0.1, "test": 0.1}, "reason", 2000, 1, 3, ["source", "n"]).collect()
    assert len(plan) == reports.train_plan(charts, "g", "k", "n", {"train": 0.8, "val": 0.1, "test": 0.1}, "reason", 2000, 1, 3).count() > 100
    for r in plan:
        assert (r.source is not None) == (r["mask"][0] == "1") and (r.n is not None) == (r["mask"][1] == "1") and (r.k % 3 or r["mask"][0] == "0")
    assert {"00", "11", "01"} <= {r["mask"] for r in plan}
