import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolane.sources import artifacts, charts
from chronolane.streaming import ledger

CHART = """osu file format v14

[General]
Mode: 3
// a comment
[Metadata]
Title:a: b
Title:last
BeatmapID:7
[Difficulty]
CircleSize:4
[TimingPoints]
0,500,4,2,0,50,1,0
1000.7,-100,4,2,0,50,0,0
2000,250,3,2,0,50,1,0
3000,400
[HitObjects]
64,192,0,1,0,0:0:0:0:
192,192,500,128,0,750:0:0:0:0:
320,192,600,128,0,600:0:0:0:0:
64,192,0,1,0,0:0:0:0:
448,192,x,1,0,0:0:0:0:
"""


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    (root / "pack a").mkdir()
    (root / "pack a" / "one.osu").write_text(CHART)
    (root / "pack a" / "two.osu").write_text(CHART.replace("Mode: 3", "Mode: x"))
    (root / "other.txt").write_text("no")
    return charts.read_corpus(spark, str(root))


def test_corpus_and_sections(corpus):
    assert sorted(r.relpath for r in corpus.collect()) == ["pack a/one.osu", "pack a/two.osu"]
    parsed = charts.sections(corpus)
    assert parsed.filter("section = 'General' AND relpath LIKE '%one%'").first().line == "Mode: 3"
    meta = {r.key: r.value for r in charts.key_values(parsed.filter("relpath LIKE '%one%'"), "Metadata").collect()}
    assert meta == {"Title": "last", "BeatmapID": "7"}
    assert [r.relpath for r in charts.mode_and_keys(parsed).collect()] == ["pack a/one.osu"]


def test_timing_and_notes(corpus):
    parsed = charts.sections(corpus).filter("relpath LIKE '%one%'")
    points = charts.timing_points(parsed).orderBy("seq").collect()
    assert [(p.offset_ms, p.uninherited, p.reject) for p in points] == [(0, True, None), (1000, False, None), (2000, True, None), (3000, None, "too few fields")]
    red = charts.redlines(parsed).orderBy("offset_ms").collect()
    assert [(r.section, r.beat_length_ms, r.meter) for r in red] == [(0, 500.0, 4), (1, 250.0, 3), (2, 400.0, 4)]
    notes = charts.notes(parsed)
    assert sorted((n.reject or "", n.time_ms or -1) for n in notes.collect()) == [("", -1), ("", -1), ("", 500), ("hold end", 600), ("not a number", -1)]
    kept = charts.dedupe_notes(notes.filter("reject IS NULL"))
    assert kept.count() == 2
    ends = sorted((e.t, e.kind) for e in charts.endpoints(kept).collect())
    assert ends == [(0, "tap"), (500, "start"), (750, "end")]
    lines = [r.line for r in charts.hit_lines(charts.exportable(kept)).orderBy("time_ms").collect()]
    assert lines == ["64,192,0,1,0,0:0:0:0:", "192,192,500,128,0,750:0:0:0:0:"]


def test_written_lines_read_back(spark, corpus, tmp_path):
    kept = charts.dedupe_notes(charts.notes(charts.sections(corpus)).filter("reject IS NULL"))
    charts.write_hit_lines(kept, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4


SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


def test_journal_takes_the_latest_complete_line(spark, tmp_path):
    file = tmp_path / "j.jsonl"
    file.write_text('{"k":"a","v":1}\n{"k":"b","v":2}\n{"k":"a","v":3}\n{"k":"b","v":')
    assert sorted((r.k, r.v) for r in artifacts.read_journal(spark, str(file), SCHEMA, ["k"]).collect()) == [("a", 3), ("b", 2)]
    file.write_text('{"k":"a","v":1}\nbroken\n')
    with pytest.raises(Exception, match="not a record"):
        artifacts.read_journal(spark, str(file), SCHEMA, ["k"]).collect()


def test_versioned_lines(spark, tmp_path):
    file = tmp_path / "v.jsonl"
    file.write_text('{"kind":"gate","version":2}\n{"k":"a","v":1}\nbroken\n{"k":"b","v":2}\n')
    assert artifacts.read_versioned(spark, str(file), SCHEMA, "gate", 2).count() == 2
    assert artifacts.read_versioned(spark, str(file), SCHEMA, "gate", 1).count() == 0


def test_frozen_artifacts(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 1)], SCHEMA)
    path = str(tmp_path / "frozen")
    artifacts.freeze(df, path)
    assert artifacts.freeze(df.repartition(3), path).count() == 2
    with pytest.raises(ValueError):
        artifacts.freeze(df.limit(1), path)
    with pytest.raises(Exception, match="already exists"):
        artifacts.write_once(df, path)
    a, b = (artifacts.canonical_digest(d, ["k", "v"]).first() for d in (df, df.orderBy("v")))
    assert a == b


def test_stream_of_journal_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"k": f"k{i % 7}", "v": i} for i in range(60)]
    for n in range(3):
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, rows[n * 20 : n * 20 + 20])) + "\n")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    ledger.journal_batches(stream, ["k"], "v", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = artifacts.latest(spark.read.parquet(str(tmp_path / "out")).select("k", "v"), ["k"], "v")
    want = artifacts.latest(spark.createDataFrame([(r["k"], r["v"]) for r in rows], SCHEMA), ["k"], "v")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_ledger_keeps_final_statuses(spark):
    rows = [(1, "failed", "x", 1), (1, "completed", None, 2), (1, "failed", "y", 3), (2, "failed", None, 1), (3, "failed", "a", 1), (3, "failed", "b", 2), (4, "skipped", None, 1)]
    df = spark.createDataFrame(rows, "key long, status string, error string, seq long")
    out = {r.key: (r.status, r.error) for r in ledger.status_of(df, "key", "status", "seq", "error").collect()}
    assert out == {1: ("completed", None), 3: ("failed", "b"), 4: ("skipped", None)}


def test_candidates_and_recompute(spark):
    rows = spark.createDataFrame([(1, 8, 4), (2, 8, None), (3, 8, 7), (4, 1, 4), (5, 8, 4)], "id int, modes int, keys int")
    known = spark.createDataFrame([(5,)], "id int")
    assert sorted(r.id for r in ledger.candidates(rows, known, "id", "modes", 8, "keys", 4).collect()) == [1, 2]
    assert sorted(r.id for r in ledger.recompute(rows.select("id", F.col("modes").alias("size")), spark.createDataFrame([(1, 8), (2, 9)], "id int, size int"), "id", "size").collect()) == [2, 3, 4, 5]
