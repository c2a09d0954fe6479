"""Histogram selection against sorting every score."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolane.llm import topk
from chronolane.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, every):
    fine = [(i, v, [math.floor(256 * float(x)) for x in e]) for i, (v, e) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, e in fine:
        if v is not None and v % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(e, f, strict=False)), w is None, w or 0, j) for j, w, f in fine if j != i)
            out += [(v, r, None if none else w, -s) for r, (s, none, w, _) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, k=5, every=5, schema=SCHEMA, bins=512):
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS q", "2 AS score", "3 AS row")
    return sorted((tuple(r) for r in top_k(df, F.col("vec_id") % every == 0, k, bins=bins).collect()), key=str)


def vectors(n, d=6, seed=1):
    return [[float(x) for x in v.astype(np.float32)] for v in np.random.default_rng(seed).normal(size=(n, d))]


@pytest.mark.parametrize("bins", [4, 512])
def test_random_vectors(spark, bins):
    rows = list(enumerate(vectors(200)))
    assert found(spark, rows, bins=bins) == brute(rows, 5, 5)


def test_blocks(monkeypatch):
    """What tasks count and keep doesn't depend on how rows and queries are blocked."""
    v = np.random.default_rng(2).integers(-300, 300, (90, 4)).astype(float)
    batch = pa.RecordBatch.from_pydict({"row": np.arange(90), "vec_id": np.arange(90), "v": v.tolist()})
    wave = topk.Queries(np.arange(0, 90, 4), np.arange(0, 90, 4), v[::4], np.full(23, -400_000), np.full(23, 400_000), np.full(23, 5), 16)
    seen = []
    for block in (1024, 7):
        monkeypatch.setattr(topk, "BLOCK", block)
        seen.append((pa.Table.from_batches(wave.best(iter([batch]), 5)).to_pydict(), sorted(zip(*pa.Table.from_batches(wave.histogram(iter([batch]))).to_pydict().values(), strict=True))))
    assert seen[0] == seen[1] and all(sum(n for q, _, n in seen[0][1] if q == i) >= 5 for i in range(23))


def test_waves_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "WAVE", 7)
    rows = list(enumerate(vectors(120)))
    assert found(spark, rows, 3) == brute(rows, 3, 5)


def test_ties_copies_and_repeated_ids(spark):
    one, two = vectors(2)
    rows = [(i, one) for i in range(60, 0, -1)] + [(5, two), (5, two), (None, one), (None, two), (10, [0.0] * 6)]
    assert found(spark, rows) == brute(rows, 5, 5)


def test_bad_rows(spark):
    rows = [(0, [1.0, 2.0]), (5, [1.0, 2.0, 3.0]), (10, []), (15, None), (20, [1.0, None]), (25, [1.0, float("nan")]), (30, [float("inf"), 1.0]), (1, [-1.0]), (2, [0.25, -0.25, 8.0])]
    assert found(spark, rows) == brute(rows, 5, 5)
    assert found(spark, []) == [] and found(spark, [(0, [1.0])]) == [] and found(spark, [(1, [1.0]), (2, [2.0])]) == []


def test_large_values(spark):
    rows = [(i, [1e4 * (i + 1), 3e5, -7.7]) for i in range(40)]
    assert found(spark, rows, schema="vec_id long, embedding array<double>") == brute(rows, 5, 5)
    with pytest.raises(ValueError, match="64 bits"):
        found(spark, [(0, [1e12]), (1, [2e12])], schema="vec_id long, embedding array<double>")
