"""Row patterns against plain loops over the rows of random charts."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronolane.operators import hold_patterns, patterns

BEAT = 120.0


def charts(lanes, seed, n=4, size=160):
    rng = random.Random(seed)
    rows = []
    for chart in range(n):
        t, open_ = 0, [False] * lanes
        for _ in range(size):
            t += rng.choice([20, 30, 40, 90, 90, 90, 160, 500])
            row = ""
            busy = rng.random() < 0.6
            for lane in range(lanes):
                code = rng.choice("34" if open_[lane] else "0012" if busy else "001")
                open_[lane] = code in "23"
                row += code
            rows.append((chart, t, row))
    return rows


def primitives(spark, rows, lanes):
    df = patterns.row_primitives(spark.createDataFrame(rows, "chart long, t long, row string"), "chart", "t", "row", lanes)
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.chart, r.t)):
        out[r.chart].append(r)
    return df, out


def held(rows, lanes):
    """Names that hold for a list of rows from one row on."""
    get = lambda k: rows[k] if k < len(rows) else None
    near = lambda r: r.head_lanes or r.body_lanes or r.tail_lanes
    names = set()
    a, b, c, d = (get(k) for k in range(4))
    shield = b is not None and 0 <= b.t - a.t <= BEAT / 4 and (set(a.tap_lanes) & set(b.head_lanes) or set(a.tail_lanes) & set(b.tap_lanes))
    five = rows[:5]
    gaps = [y.t - x.t for x, y in zip(five, five[1:]) if x.tail_lanes and y.head_lanes]
    inverse = len(five) == 5 and not any(r.tap_lanes for r in five) and max(len(r.body_lanes) for r in five) >= 3 and len(gaps) >= 2 and max(gaps) - min(gaps) <= 5
    jacky = False
    played = [r for r in rows[:6] if r.notes]
    if any(near(r) for r in rows[:6]) and len(played) >= 2:
        x, y = played[:2]
        four = played[:4]
        again = sum(r.jacks > 0 for r in four) >= 2
        jacky = (x.notes > 2 and y.notes > 1 and y.jacks and (y.notes < x.notes or y.jacks < y.notes)) or (x.jacks and not y.jacks) or (again and (any(r.notes >= 2 for r in four) or min(r.delta for r in four) <= 185))
    if shield:
        names.add("Shield")
    if inverse:
        names.add("Inverse")
    if jacky:
        names.add("Jacky WC")
    if d is not None and all(len(r.tail_lanes) == 1 for r in (a, b, c, d)) and b.tail_lanes != c.tail_lanes and not (shield or inverse or jacky):
        names.add("Release")
    if a.head_lanes and len(rows) >= 3:
        lane = a.head_lanes[0]
        for other in (lane - 1, lane + 1):
            if 0 <= other < lanes and (other < lanes // 2) == (lane < lanes // 2):
                hits = [r.t for r in rows[:8] if lane in r.body_lanes and other in r.tap_lanes]
                if len(hits) >= 3 and max(15000 / (y - x) for x, y in zip(hits, hits[1:])) >= 90:
                    names.add("Column Lock")
    heads = [set(r.head_lanes) for r in rows[:4]]

    def apart(n):
        before = heads[0]
        for h in heads[1:n]:
            if h & before:
                return False
            before = h or before
        return True

    if lanes == 4:
        if len(heads) == 4 and apart(4):
            if len(heads[0]) == 2 and len(heads[1]) == 1 and len(heads[2]) < 3 and len(heads[3]) < 3:
                names.add("JS Density")
            if len(heads[0]) == 3:
                names.add("HS Density")
    elif len(heads) > 1 and apart(2):
        x, y = heads[:2]
        if len(x) == len(y) == 2 and not (min(x) > max(y) or max(x) < min(y)):
            names.add("DS Density")
        if len(x) > 1 and len(y) > 1:
            names.add("DCS Density")
        if len(x) > 1 and len(y) == 1:
            names.add("LCS Density")
    if len(rows) >= 2 and any(near(r) for r in rows[:4]):
        rolls = len(heads) > 2 and all(len(h) > 1 for h in heads[:3]) and (max(heads[0]) < min(heads[1]) and max(heads[1]) < min(heads[2]) or min(heads[0]) > max(heads[1]) and min(heads[1]) > max(heads[2]))
        if a.delta <= (180 if lanes == 4 else 170) or (lanes != 4 and rolls):
            names.add("Speedy WC")
    return names


@pytest.mark.parametrize("lanes", [4, 7])
def test_patterns_of_holds(spark, lanes):
    df, by_chart = primitives(spark, charts(lanes, 5 + lanes), lanes)
    got = {(r.chart, r.t, r.name) for r in hold_patterns.held_patterns(df, "chart", "t", F.lit(BEAT), lanes).collect()}
    want = {(chart, rows[k].t, name) for chart, rows in by_chart.items() for k in range(len(rows)) for name in held(rows[k:], lanes)}
    assert got == want
    assert len({name for *_, name in got}) >= 5


@pytest.mark.parametrize("rules", ["SEVEN", "OTHER"])
def test_patterns_of_other_lane_counts(spark, rules):
    df, by_chart = primitives(spark, [(c, t, row.replace("2", "1").replace("3", "0").replace("4", "1")) for c, t, row in charts(7, 3)], 7)
    got = {(r.chart, r.t, r.name) for r in patterns.specific_patterns(df, "chart", "t", getattr(patterns, rules)).collect()}
    want = set()
    for chart, rows in by_chart.items():
        for k in range(len(rows) - 1):
            a, b, c = rows[k], rows[k + 1], rows[k + 2] if k + 2 < len(rows) else None
            names = {"Double Stream": a.notes == b.notes == 2 and not b.jacks and not b.roll, "Dense Chordstream": a.notes > 1 and b.notes > 1 and not b.jacks, "Light Chordstream": a.notes > 1 and b.notes == 1 and not b.jacks}
            names["Minijacks"] = a.jacks > 0 and b.jacks == 0
            names["Chordjacks"] = a.notes > 2 and b.notes > 1 and b.jacks > 0 and (b.notes < a.notes or b.jacks < b.notes)
            if c is not None and rules == "SEVEN":
                names["Brackets"] = min(a.notes, b.notes, c.notes) > 2 and not (b.roll or c.roll or b.jacks or c.jacks) and a.notes + b.notes + c.notes > 9
            if c is not None and rules == "OTHER":
                names["Chord Rolls"] = min(a.notes, b.notes, c.notes) > 1 and b.roll and c.roll and b.direction == c.direction and b.direction in ("left", "right")
            want |= {(chart, a.t, name) for name, holds in names.items() if holds}
            five = rows[k : k + 5]
            if len(five) == 5 and all(r.jacks for r in five) and set.intersection(*(set(r.raw) for r in five)):
                want.add((chart, a.t, "Longjacks"))
    assert got == want


def covered(spans):
    """Lengths of the spans that reach further than all before them, overlaps and all."""
    total, at = 0.0, float("-inf")
    for start, end in sorted(spans):
        if end > at:
            total, at = total + end - start, end
    return total


def test_clusters_categories_and_cards(spark):
    df, by_chart = primitives(spark, charts(4, 11), 4)
    names = patterns.specific_patterns(df, "chart", "t").unionByName(hold_patterns.held_patterns(df, "chart", "t", F.lit(BEAT)))
    own, core = defaultdict(list), defaultdict(list)
    for r in names.collect():
        own[r.chart, r.t, r.core].append((r.name, r.length))
    for r in patterns.core_patterns(df, "chart", "t").collect():
        core[r.chart, r.t].append((r.pattern, r.length))
    found = []
    for chart, rows in by_chart.items():
        for k, r in enumerate(rows):
            for pattern, length in core[chart, r.t]:
                for name, n in own[chart, r.t, pattern] or [(None, 0)]:
                    span = rows[k : k + max(length, n)]
                    mean = sum(x.delta for x in span) / len(span)
                    end = float(rows[min(k + max(length, n), len(rows) - 1)].t)
                    if pattern == "jacks":
                        end = max(r.t + r.delta / 2, end)
                    found.append((chart, pattern, name, float(r.t), end, 0.0 if name == "Inverse" else mean, not all(abs(x.delta - mean) < 5 for x in span)))
    rounded = lambda rows: Counter((*r[:5], round(r[5], 6), r[6]) for r in rows)
    spotted = patterns.found_patterns(df, "chart", "t", specific=names)
    assert rounded(tuple(r) for r in spotted.collect()) == rounded(found)

    modes = {0: "RC", 1: "LN", 2: "HB", 3: "Mix"}
    clustered = patterns.tempo_clusters(spotted, "chart")
    groups = defaultdict(list)
    for r in clustered.collect():
        if modes[r.chart] != "RC" or r.pattern not in patterns.HELD_CORES:
            groups[r.chart, r.pattern, r.mixed, r.bpm].append(r)
    want = {}
    for key, rows in groups.items():
        count = Counter(r.name for r in rows if r.name)
        shares = sorted(((n, k / len(rows)) for n, k in count.items()), key=lambda x: (-x[1], x[0]))
        if key[3] > 25 or key[3] == 0:
            want[key] = (covered([(r.start, r.end) for r in rows]), shares)
    for chart in range(4):
        mine = {k: v for k, v in want.items() if k[0] == chart}
        drop = {k for k, v in mine.items() if any(o[1] == k[1] and o[3] > k[3] and w[0] * 0.5 > v[0] for o, w in mine.items())}
        for p in {k[1] for k in mine}:
            drop |= set(sorted((k for k in mine if k[1] == p and k not in drop), key=lambda k: (-mine[k][0], k[3], k[2]))[3:])
        for k in drop:
            del want[k]
    summary = patterns.cluster_summary(clustered, "chart", spark.createDataFrame(list(modes.items()), "chart long, mode string"))
    rows = summary.collect()
    got = {(r.chart, r.pattern, r.mixed, r.bpm): (r.amount, [(n.name, n.share) for n in r.names]) for r in rows}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-6 and [n for n, _ in got[k][1]] == [n for n, _ in want[k][1]] for k in got)
    category = {r.chart: r.category for r in patterns.categorise(summary, "chart").collect()}
    card = patterns.cluster_card(summary, "chart", spark.createDataFrame([(c, 10000) for c in range(4)], "chart long, duration long"), "duration").collect()
    for chart in range(4):
        mine = sorted((r for r in rows if r.chart == chart), key=lambda r: -r.importance)
        first = mine[0]
        assert category[chart] == (first.names[0].name if first.names and first.names[0].share > 0.05 else first.pattern.capitalize()) + (" Tech" if first.mixed else "")
        shown = sorted((r for r in card if r.chart == chart), key=lambda r: r.place)
        assert len(shown) == min(6, len(mine)) and all(8 <= r.width <= 100 for r in shown) and max(r.width for r in shown) == 100
        assert abs(shown[0].amount_share - first.amount / 100) < 1e-6


def test_ratings_by_mode(spark):
    rows = [("stream", None, "RC"), ("stream", None, "LN"), ("density", "Inverse", "LN"), ("density", "Inverse", "HB"), ("wildcard", "Jacky WC", "RC"), ("coordination", "Release", "Mix"), ("jacks", "Gluts", "Mix")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, p string, n string, m string")
    got = [round(r.v, 6) for r in sorted(df.select("i", patterns.rating(F.col("p"), F.col("n"), F.col("m")).alias("v")).collect())]
    assert got == [0.333333, 0.1, 1.5, 0.0, 0.0, 0.3, 0.9]


def test_scroll_speed_and_clean_steps(spark):
    changes = spark.createDataFrame([(1, 100.0, 1.0), (1, 300.0, 2.0), (1, 700.0, 1.01), (2, 0.0, 0.5), (3, 5.0, 1.0)], "c long, t double, v double")
    tempos = spark.createDataFrame([(1, 0.0, 500.0), (2, 0.0, 500.0), (3, 0.0, 300.0), (3, 9.0, 1000.0)], "c long, t double, len double")
    spans = spark.createDataFrame([(1, 50.0, 1000.0), (2, 0.0, 90.0), (3, 0.0, 10.0), (4, 0.0, 7.0)], "c long, first double, last double")
    got = {r.c: r.speed_time for r in patterns.speed_time(changes, tempos, spans, "c", "t", "v", "len").collect()}
    assert got == {1: 400.0, 2: 90.0, 3: 2001.0, 4: 0.0}
    rng = random.Random(2)
    rows = [(c, rng.randrange(40), rng.choice([1.0, 1.003, 1.006, 1.2, 0.9]), i) for c in (1, 2) for i in range(60)]
    want = set()
    for c in (1, 2):
        last, before = {t: v for k, t, v, _ in rows if k == c}, 1.0
        for t in sorted(last):
            if abs(last[t] - before) > 0.005:
                want.add((c, t, last[t]))
                before = last[t]
    got = {tuple(r) for r in patterns.clean_steps(spark.createDataFrame(rows, "c long, t long, v double, i long"), "c", "t", "v", "i").collect()}
    assert got == want
