"""Ties that decide a result, and steps whose files or tasks must not grow with the number of charts or rows."""

import glob

import pytest

from chronolane import session
from chronolane.catalog import QUERIES
from chronolane.operators import decoding, gates, lags, splits
from chronolane.queries import records
from chronolane.session import scratch_dir
from chronolane.sources import charts


def test_reference_at_a_cursors_own_place_is_next_and_not_skipped(spark):
    cursors = spark.createDataFrame([("u", 0, 5, 1), ("u", 0, 9, 2)], "user string, beat int, at long, id long")
    references = spark.createDataFrame([("u", 0, 3, 7), ("u", 0, 5, 8), ("u", 0, 9, 9)], "user string, beat int, at long, id long")
    rows = gates.next_reference(cursors, references, "user", "beat", "at", "id").orderBy("id").collect()
    assert [(r.at, r.next_position, r.skipped) for r in rows] == [(5, 5, 1), (9, 9, 1)]


def test_packed_corpus_reads_back_and_its_files_follow_partitions(spark, tmp_path):
    texts = [(f"set {i}/ä {i}.osu", "[General]\r\nMode: 3\r\n" + "é" * i + ("" if i % 2 else "\n")) for i in range(300)] + [("empty", "")]
    path = f"file://{tmp_path}/packed"
    charts.pack_corpus(spark.createDataFrame(texts, "relpath string, value string").repartition(3), path)
    assert len(list((tmp_path / "packed").glob("part-*"))) == 3
    read = charts.read_packed(spark, path).collect()
    assert sorted((r.relpath, r.value) for r in read) == sorted(texts)
    assert all(r.size == len(r.value.encode()) for r in read)
    for bad in (("a", "x\x1ey"), ("a\nb", "x")):
        with pytest.raises(Exception, match="a record mark in|a newline in"):
            charts.pack_corpus(spark.createDataFrame([bad], "relpath string, value string"), f"{path}-{len(bad[0])}")


def test_chart_queries_write_no_file_for_each_chart(spark):
    folder = lambda: set(glob.glob(scratch_dir(spark).removeprefix("file:") + "/charts-*/**/*.txt", recursive=True))
    before = folder()
    assert QUERIES["chart_files"](spark, "/root/testdata/sf0.01").count() == 150
    assert len(folder() - before) <= 8


def test_segments_stand_in_order_and_no_task_writes_them_all(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    rows = spark.range(1000).selectExpr("999 - id AS place", "cast(999 - id AS string) AS line")
    path = records._segments(spark, rows, "segments").removeprefix("file:")
    lines = [[int(x) for x in open(f)] for f in sorted(glob.glob(f"{path}/part-*"))]
    assert len(lines) > 10 and max(map(len, lines)) < 200
    assert [x for part in lines for x in part] == list(range(1000))


def test_coverage_is_dealt_to_tasks_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    out = splits.coverage(spark.range(0, 900), spark.range(100, 1000), ["id"])
    assert out.rdd.getNumPartitions() == 36
    assert sorted((r.id, r.problem) for r in out.collect()) == [(i, "missing") for i in range(100)] + [(i, "unexpected") for i in range(900, 1000)]


def test_lag_profiles_are_dealt_to_tasks_by_their_marks(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    series = spark.range(100).selectExpr("id % 5 AS chart", "cast(id AS double) AS t", "1.0 AS v")
    out = lags.lag_profile(series, series.select("chart", "t"), "chart", "t", "v", [-1.0, 0.0, 1.0])
    assert out.rdd.getNumPartitions() == 8
    assert sum(r.n for r in out.collect()) == 300


def test_decoded_tokens_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    rows = spark.range(100).selectExpr("id", "array('BAR', 'POS_3', 'ROW_1000') AS tokens", "0 AS start", "'0000' AS initial")
    found, rejected = decoding.cells(rows, ["id"], "tokens", "start", "initial", 24)
    assert found.rdd.getNumPartitions() == 12 and found.count() == 400 and rejected.count() == 0


def test_clusters_are_folded_once(spark):
    plan = QUERIES["pattern_category"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "clusters-" in plan
