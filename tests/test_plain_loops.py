"""Operators that SQL can't express against plain loops on small fixtures."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolane.functions import resampling
from chronolane.operators import stats, timeline
from chronolane.plans import reports, windows
from chronolane.streaming import ledger


def md5_number(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def packed_by_hand(rows, budget, epoch, seed, packed=None):
    """{key: batch} of (key, window, length), window by window in hashed order."""
    out, by_window = {}, defaultdict(list)
    for key, window, length in rows:
        if window is not None:
            by_window[window].append((md5_number(seed, epoch, key), key, length))
    for members in by_window.values():
        parts = -(-len(members) // packed) if packed else 1
        for part in range(parts):
            batch, n, widest = part << 32, 0, 0
            for _, key, length in sorted(m for m in members if m[0] * parts // (1 << 32) == part):
                if n and (n + 1) * max(widest, length) > budget:
                    batch, n, widest = batch + 1, 0, 0
                n, widest = n + 1, max(widest, length)
                out[key] = batch
    return out


@pytest.mark.parametrize("packed", [None, 16])
def test_batches(spark, monkeypatch, packed):
    if packed:
        monkeypatch.setattr(windows, "PACKED", packed)
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 90, 95, 98, 100, 101, 200, 900])) for i in range(160)]
    out = {r.key: (r.window, r.batch) for r in windows.pack_batches(spark.createDataFrame(rows, "key long, n long"), "key", "n", 1000, 2, 5).collect()}
    want = packed_by_hand([(k, out[k][0], n) for k, n in rows], 1000, 2, 5, packed)
    assert {k: b for k, (_, b) in out.items() if b is not None} == want and len(out) == len(rows)


def test_train_plan_and_eval_pool(spark):
    rng = random.Random(4)
    rows = [(i, i % 40, rng.randint(50, 400), "long" if i % 9 == 0 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, g long, n long, reason string")
    ratios = {"train": 0.5, "val": 0.2, "test": 0.3}
    place = lambda g: int(hashlib.sha256(f"3:{g}".encode()).hexdigest()[:16], 16) / 2**64
    split = {g: "train" if place(g) < 0.5 else "val" if place(g) < 0.7 else "test" for g in range(40)}
    plan = {r.k: r for r in reports.train_plan(df, "g", "k", "n", ratios, "reason", 2000, 1, 3).collect()}
    kept = {k: n for k, g, n, reason in rows if split[g] == "train" and reason is None}
    assert plan.keys() == kept.keys()
    assert {k: r.batch for k, r in plan.items()} == packed_by_hand([(k, plan[k].window, n) for k, n in kept.items()], 2000, 1, 3)
    unit = lambda k, what: md5_number(3, 1, k, what) / 2**32
    for k, r in plan.items():
        assert r.mirror == (unit(k, "mirror") < 0.5) and r.rate == pytest.approx(1 + 0.5 * unit(k, "rate") if unit(k, "change") < 0.2 else 1.0)
    pool = sorted((hashlib.md5(f"3|{k}".encode()).hexdigest(), k) for k, g, _, reason in rows if split[g] == "test" and reason is None)[:30]
    out = {r.target: r.donor for r in reports.eval_pool(df, "g", "k", ratios, "reason", 30, 3).collect()}
    assert set(out) == {k for _, k in pool} and set(out.values()) <= set(out)


def test_resampled_sums(spark):
    rows = [(k % 3, f"k{k}", float(k)) for k in range(50)]
    out = {(r.g, r.draw): (r.s, r.w) for r in resampling.resampled_sums(spark.createDataFrame(rows, "g long, k string, v double").repartition(4), ["g"], "k", "v", 30, 9).collect()}
    want = defaultdict(lambda: [0.0, 0.0])
    for g, k, v in rows:
        digest = hashlib.md5(f"9|{k}".encode()).hexdigest()
        high, low = int(digest[:8], 16), int(digest[8:16], 16)
        for draw in range(30):
            x = (low + draw * 0x9E3779B9) % 2**32
            for turn in (0, 1):
                for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
                    x = (x ^ x >> shift) * factor % 2**32
                x ^= x >> 16
                x ^= high if turn == 0 else 0
            u, p, n, total = x / 2**32, np.exp(-1.0), 0, np.exp(-1.0)
            while u >= total and n < 8:
                n += 1
                p /= n
                total += p
            want[g, draw][0] += n * v
            want[g, draw][1] += n
    assert out.keys() == want.keys() and all(out[k] == pytest.approx(tuple(v)) for k, v in want.items())


def test_weights_have_the_mean_and_spread_of_counts():
    rng = np.random.default_rng(1)
    counts = resampling.poisson_counts(rng.integers(0, 1 << 32, 500), rng.integers(0, 1 << 32, 500), 400).astype(float)
    assert abs(counts.mean() - 1) < 0.02 and abs(counts.var() - 1) < 0.03
    assert abs(np.corrcoef(counts[:, 0], counts[:, 1])[0, 1]) < 0.15 and abs(np.corrcoef(counts[0], counts[1])[0, 1]) < 0.15


def test_interval_covers_the_mean(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(x)) for i, x in enumerate(rng.normal(5, 2, 400))]
    r = stats.mean_interval(spark.createDataFrame(rows, "k long, v double"), "k", "v", []).first()
    se = np.std([v for _, v in rows]) / 20
    assert r.low == pytest.approx(r.mean - 1.96 * se, abs=0.2 * se) and r.high == pytest.approx(r.mean + 1.96 * se, abs=0.2 * se)


def test_status_stream_agrees_with_the_batch_form(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(12), rng.choice(["failed", "failed", "completed", "skipped", "pending"]), rng.choice([None, "e1", "e2"]), i) for i in range(120)]
    schema = "key long, status string, error string, seq long"
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = ledger.status_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")))
        query = stream.writeStream.format("memory").queryName("ledger").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.key: r.status for r in spark.table("ledger").collect()}
    want = {r.key: r.status for r in ledger.status_of(spark.createDataFrame(rows, schema), "key", "status", "seq", "error").collect()}
    assert got.keys() == want.keys(), [r for r in rows if r[0] in set(want) - set(got)]
    assert sum(got[k] == want[k] for k in want) == len(want)
