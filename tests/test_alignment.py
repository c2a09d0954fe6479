"""Lag verdicts on series whose lag is known, and against a plain loop."""

from dataclasses import replace
from hashlib import md5

import numpy as np
import pytest

from chronolane.operators.lags import LagRules, lag_verdict

LAGS = [float(x) for x in range(-80, 81, 4)]
RULES = LagRules(draws=100)


def series_of(heads, lags, seed=0):
    """A bump after each head, its lag away, on a noisy floor."""
    rng = np.random.default_rng(seed)
    t = np.arange(0, heads[-1] + 500, 2.0)
    v = rng.uniform(0, 0.05, len(t))
    for head, lag in zip(heads, np.broadcast_to(lags, heads.shape), strict=True):
        v += np.exp(-(((t - head - lag) / 6) ** 2))
    return t, v


def heads_of(n=120, seed=10):
    return 500.0 + np.cumsum(np.random.default_rng(seed).uniform(300, 550, n))


def loop(t, v, anchors, rules):
    """The verdict of one chart, one step after the other."""
    if len(anchors) < rules.anchors:
        return "too_few_anchors", None, len(anchors)
    at = np.array(LAGS)
    profiles = np.array([[np.interp(a + x, t, v) for x in at] for a in anchors])
    heard = profiles.max(axis=1) > rules.floor
    profiles, anchors = profiles[heard] / profiles[heard].max(axis=1, keepdims=True), anchors[heard]
    if len(anchors) < rules.anchors:
        return "too_few_audible_anchors", None, len(anchors)
    block = np.minimum((anchors - anchors[0]) / (anchors[-1] - anchors[0]) * rules.blocks, rules.blocks - 1).astype(int)
    curves = [profiles[block == b].mean(axis=0) for b in range(rules.blocks) if (block == b).sum() >= rules.block_anchors]
    if len(curves) < rules.least_blocks:
        return "too_few_time_blocks", None, len(anchors)
    curve = np.round(np.mean(curves, axis=0), 9)
    lag = at[curve.argmax()]
    boot = []
    for d in range(rules.draws):
        picks = [int(int(md5(f"{rules.seed}|{d}|{j}".encode()).hexdigest()[:8], 16) / 2**32 * len(curves)) for j in range(len(curves))]
        boot.append(at[np.round(np.mean([curves[i] for i in picks], axis=0), 9).argmax()])
    low, high = np.quantile(boot, [0.025, 0.975])
    contrast, prominence = curve.max() - np.median(curve), curve.max() - curve[np.abs(at - lag) > rules.exclusion].max()
    tests = {"search_edge": abs(lag) >= at[-1] - rules.edge, "weak_alignment": contrast < rules.contrast, "competing_peak": prominence < rules.prominence, "unstable_time_blocks": high - low > rules.width}
    reasons = [name for name, bad in tests.items() if bad]
    return "unresolved" if reasons else "resolved", reasons, len(anchors), lag, low, high, contrast, prominence


@pytest.fixture(scope="module")
def charts():
    heads = heads_of()
    made = {f"lag{x}": (*series_of(heads, x), heads) for x in (-20.0, 0.0, 20.0, 40.0)}
    made["mixed"] = (*series_of(heads, np.repeat([-25.0, 25.0], 60)), heads)
    made["edge"] = (*series_of(heads, 76.0), heads)
    t, v = series_of(heads, 0.0)
    made["silent"] = (t, v * 0, heads)
    made["noise"] = (t, np.random.default_rng(3).uniform(0.9, 1, len(t)), heads)
    made["few"] = (t, v, heads[:50])
    made["bunched"] = (t, v, np.r_[heads[:1], heads[1] + np.arange(110) * 1e-3, heads[-1]])
    made["half"] = (t, np.where(t < heads[100], v, 0.0), heads)
    return made


@pytest.fixture(scope="module")
def verdicts(spark, charts):
    series = spark.createDataFrame([(c, float(a), float(b)) for c, (t, v, _) in charts.items() for a, b in zip(t, v, strict=True)], "chart string, t double, v double")
    anchors = spark.createDataFrame([(c, float(a)) for c, (_, _, heads) in charts.items() for a in [*heads, heads[0]]] + [("unheard", float(a)) for a in heads_of()], "chart string, t double")
    return {r.chart: r for r in lag_verdict(series, anchors, "chart", "t", "v", LAGS, RULES).collect()}


def test_signed_lag(verdicts):
    for x in (-20.0, 0.0, 20.0, 40.0):
        assert verdicts[f"lag{x}"].status == "resolved" and verdicts[f"lag{x}"].lag == x and verdicts[f"lag{x}"].reasons == []


def test_what_is_not_resolved(verdicts):
    assert "unstable_time_blocks" in verdicts["mixed"].reasons and verdicts["mixed"].status == "unresolved"
    assert "search_edge" in verdicts["edge"].reasons and "weak_alignment" in verdicts["noise"].reasons
    assert [verdicts[c].status for c in ("silent", "few", "bunched", "unheard")] == ["too_few_audible_anchors", "too_few_anchors", "too_few_time_blocks", "too_few_audible_anchors"]
    assert verdicts["silent"].lag is None and verdicts["silent"].reasons is None and verdicts["silent"].anchors == 0 and verdicts["few"].anchors == 50


def test_equals_the_loop(charts, verdicts):
    for name, (t, v, heads) in charts.items():
        want, got = loop(t, v, np.unique(heads), RULES), verdicts[name]
        assert (got.status, got.reasons, got.anchors) == want[:3], name
        if want[1] is not None:
            assert np.allclose([got.lag, got.low, got.high, got.contrast, got.prominence], want[3:], atol=1e-6), name


def test_two_blocks_that_disagree_need_every_block(spark, charts):
    """With fewer blocks asked for than there are, the mean of both halves has two peaks."""
    t, v, heads = charts["mixed"]
    series = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(t, v, strict=True)], "chart string, t double, v double")
    anchors = spark.createDataFrame([("m", float(a)) for a in heads], "chart string, t double")
    rules = replace(RULES, blocks=2, least_blocks=2)
    row = lag_verdict(series, anchors, "chart", "t", "v", LAGS, rules).first()
    assert (row.status, row.reasons, row.lag) == loop(t, v, heads, rules)[:2] + (loop(t, v, heads, rules)[3],)
