import random

import pytest

from chronolane.llm.mixing import mix

SCHEMA = "doc_id long, text string, source string, size int, target string"


def water_fill(sizes, weights, most=3.0):
    targets = {}
    total, open_ = sum(sizes.values()), dict(weights)
    while True:
        level = (total - sum(targets.values())) / sum(open_.values()) if open_ else 0
        over = [s for s in open_ if level * open_[s] > most * sizes[s]]
        if not over:
            return targets | {s: level * w for s, w in open_.items()}
        for s in over:
            targets[s] = most * sizes[s]
            del open_[s]


def rows_of(seed, n=900):
    rng = random.Random(seed)
    sources = ["a", "B", "é", None, "hot", "tiny"]
    out = [(i, " ".join(["w"] * rng.choice([1, 3, 10, 50, 200])), rng.choice(sources[:4] + ["hot"] * 4), 1, "x") for i in range(n)]
    return out + [(n, "one", "tiny", 1, "x"), (n + 1, None, "none", 1, "x"), (n + 2, "", "hot", 1, "x"), (None, "w w", "hot", 1, "x")]


@pytest.mark.parametrize("block", [16, 4096])
def test_targets_words_and_limits(spark, block):
    rows = rows_of(block)
    out = mix(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    assert len(out) == len(rows)
    sizes, largest = {}, {}
    by_id = {r[0]: (len((r[1] or "").split()), r[2]) for r in rows}
    for i, (size, source) in by_id.items():
        sizes[source] = sizes.get(source, 0) + size
        largest[source] = max(largest.get(source, 0), size)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = water_fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        size, source = by_id[r.doc_id]
        assert (r.size, r.source_size) == (size, sizes[source])
        assert r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 3 * size and (size == 0 or r.taken % size == 0)
        taken[source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1


def test_reruns_and_other_partitions_agree(spark):
    df = spark.createDataFrame(rows_of(9), SCHEMA)
    runs = [sorted(((r.doc_id or -1), r.taken) for r in mix(d, block=32).collect()) for d in (df.repartition(1), df.repartition(7))]
    assert runs[0] == runs[1]


def test_expectation_is_kept():
    import numpy as np

    from chronolane.llm.mixing import _pivot

    size = np.array([5.0, 9.0, 3.0, 8.0, 2.0, 7.0])
    start = 0.4 * size
    total = np.zeros(6)
    rng = np.random.default_rng(0)
    for _ in range(4000):
        mass = start.copy()
        left = _pivot(mass, size, rng.random(6))
        assert mass.sum() == pytest.approx(start.sum())
        assert sum(0 < m < s for m, s in zip(mass, size, strict=True)) <= 1 and (left < 0 or 0 < mass[left] < size[left])
        total += mass
    assert np.abs(total / 4000 - start).max() < 0.25


def test_copies_of_one_id_spread_over_blocks(spark, monkeypatch):
    """One id in half of the rows, and rows without one: no block gets much more than its share."""
    from chronolane.llm import mixing

    most, rounded = [], mixing._rounded

    def watched(df, keys, *rest):
        most.append(df.groupBy(*keys).count().agg({"count": "max"}).first()[0])
        return rounded(df, keys, *rest)

    monkeypatch.setattr(mixing, "_rounded", watched)
    rows = [(7 if i % 4 < 2 else i if i % 4 == 2 else None, "w w w" if i % 2 else "w w w w", "hot") for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(((r.doc_id or -1), r.size, r.taken) for r in mix(d, block=128).collect()) for d in (df, df.repartition(5))]
    assert runs[0] == runs[1] and len(runs[0]) == 8000 and max(most) < 400
    assert sum(r[2] for r in runs[0]) == pytest.approx(28000, abs=3) and sum(r[0] == 7 for r in runs[0]) == 4000


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
