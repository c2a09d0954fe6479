"""Stitching against one-span encoding, replay against a walk, decoding against the notes that were encoded."""

import random

import pytest

from chronolane.operators import decoding, tokens
from chronolane.plans import stitching, windows

PER = 8


def legal_notes(seed, bars=40):
    """Taps and holds of four lanes, many of them across window ends."""
    rng, out = random.Random(seed), []
    for lane in range(4):
        tick = rng.randint(0, 12)
        while tick < bars * PER:
            if rng.random() < 0.4:
                end = tick + rng.choice([1, 5, 30, 90])
                out.append((lane, tick, "hold", end))
                tick = end
            else:
                out.append((lane, tick, "tap", None))
            tick += rng.choice([1, 2, 7, 25])
    return out


@pytest.fixture(scope="module")
def world(spark):
    notes = {c: legal_notes(c) for c in range(3)}
    events = [(c, t, lane, {"tap": "tap", "hold": "start"}[kind]) for c, n in notes.items() for lane, t, kind, _ in n] + [(c, end, lane, "end") for c, n in notes.items() for lane, _, kind, end in n if kind == "hold"]
    rows = spark.createDataFrame(events, "chart int, tick long, lane int, kind string")
    made = tokens.event_rows(rows, "chart", "tick", "lane", "kind").selectExpr("*", f"tick DIV {PER} AS bar", f"tick % {PER} AS pos").cache()
    spans = made.groupBy("chart").agg({"bar": "max"}).selectExpr("chart", "0L AS low", "`max(bar)` + 1 AS high")
    wins = windows.overlap_windows(spans, "chart", "low", "high")
    initial = stitching.initial_rows(rows, wins, "chart", "tick", "lane", "kind", PER)
    return notes, made, spans, stitching.encode_windows(made, wins, initial, "chart", "n", "bar", "pos", "row").cache()


def test_stitched_windows_equal_one_span(world):
    _, made, spans, wins = world
    bars = stitching.whole_charts(stitching.kept_bars(wins, "chart", "n"), spans, "chart", "low", "high")
    got = {r.chart: r.tokens for r in stitching.chart_tokens(bars, "chart").collect()}
    for chart, rows in got.items():
        want = {r.chart: r.tokens for r in tokens.encode_tokens(made, "chart", "bar", "pos", "row").collect()}[chart]
        assert rows[-len(want) :] == want and set(rows[: len(rows) - len(want)]) <= {"BAR"}  # bars before the first row
    assert stitching.missing_keeps(wins, "chart", "n").count() == 0
    states = {(r.chart, r.bar): r.row for r in stitching.states_at_bars(bars, "chart").collect()}
    assert all(r.tokens[1] == "ROW_" + states[r.chart, r.start] for r in wins.collect())
    assert any("3" in row for row in states.values())


def test_lost_ends_and_missing_bars(spark):
    rows = [
        (1, 0, 0, 0, 2, ["<BOS>", "ROW_0000", "BAR", "POS_0", "ROW_2000", "BAR", "POS_3", "<EOS>", "BAR", "POS_1", "ROW_1111"]),
        (1, 1, 0, 2, 4, ["<BOS>", "ROW_0000", "BAR", "BAR", "BAR", "POS_1", "POS_2", "ROW_1111"]),
        (2, 0, 5, 5, 6, []),
    ]
    wins = spark.createDataFrame(rows, "chart int, n int, start long, keep_start long, keep_end long, tokens array<string>")
    kept = stitching.kept_bars(wins, "chart", "n")
    assert sorted((r.chart, r.bar, " ".join(r.body)) for r in kept.collect()) == [(1, 0, "BAR POS_0 ROW_2000"), (1, 1, "BAR"), (1, 2, "BAR")]
    assert sorted(tuple(r) for r in stitching.missing_keeps(wins, "chart", "n").collect()) == [(1, 1, 3), (2, 0, 5)]
    spans = spark.createDataFrame([(1, 0, 5), (2, 5, 6)], "chart int, low long, high long")
    bars = stitching.whole_charts(kept, spans, "chart", "low", "high")
    assert {r.chart: " ".join(r.tokens) for r in stitching.chart_tokens(bars, "chart").collect()} == {1: "BAR POS_0 ROW_2000 BAR BAR BAR BAR", 2: "BAR"}
    assert [r.row for r in stitching.states_at_bars(bars, "chart").filter("chart = 1").orderBy("bar").collect()] == ["0000", "3000", "3000", "3000", "3000"]
    prompts = {(r.chart, r.n): r.prompt for r in stitching.context_prompts(bars, wins, "chart", "n").collect()}
    assert prompts == {(1, 0): None, (1, 1): ["<BOS>", "ROW_0000", "BAR", "POS_0", "ROW_2000", "BAR"], (2, 0): None}


def test_decoding_gives_the_notes_back(world):
    notes, _, _, wins = world
    seqs = wins.selectExpr("*", "substring(tokens[1], 5) AS initial")
    got = {}
    for r in decoding.decode_notes(seqs, ["chart", "n"], "tokens", "start", "initial", PER).collect():
        got.setdefault((r.chart, r.n), set()).add((r.lane, r.tick, r.kind, r.end, r.issue))
    for w in wins.collect():
        a, b, want = w.start * PER, w.end * PER, set()
        for lane, tick, kind, end in notes[w.chart]:
            if kind == "tap" and a <= tick < b:
                want.add((lane, tick, "tap", None, None))
            elif kind == "hold" and tick < b and end >= a:
                issues = ["missing_hold_head"] * (tick < a) + ["missing_hold_tail"] * (end >= b)
                low, high = max(tick, a), min(end, b)
                if high > low or issues:
                    want.add((lane, low, "hold" if high > low else None, high if high > low else None, ",".join(issues) or None))
        assert got.get((w.chart, w.n), set()) == want


def test_broken_sequences_are_rejected(spark):
    cases = {
        "": (["BAR", "POS_3", "ROW_2000", "POS_1", "ROW_3000", "BAR", "POS_3", "ROW_4000"], "0000", None),
        "syntax": (["BAR", "POS_0", "POS_1", "ROW_1000"], "0000", (2, "position without a row")),
        "end": (["BAR", "POS_0"], "0000", (2, "position without a row")),
        "early": (["POS_0", "ROW_1000"], "0000", (0, "position before a bar")),
        "twice": (["BAR", "POS_1", "ROW_1000", "POS_1", "ROW_1000"], "0000", (3, "repeated position")),
        "alone": (["BAR", "ROW_1000"], "0000", (1, "row without a position")),
        "other": (["BAR", "ROW_9000"], "0000", (1, "unexpected token")),
        "held": (["BAR", "POS_0", "ROW_0000"], "3000", (2, "lane state")),
        "tail": (["BAR", "POS_0", "ROW_0004"], "0000", (2, "lane state")),
        "row": (["BAR"], "1000", (-1, "initial row")),
        "none": ([], "0000", None),
    }
    seqs = spark.createDataFrame([(k, 2, t, i) for k, (t, i, _) in cases.items()], "chart string, start long, tokens array<string>, initial string")
    rejected = {r.chart: (r.i, r.reason) for r in decoding.cells(seqs, ["chart"], "tokens", "start", "initial", PER)[1].collect()}
    assert rejected == {k: want for k, (_, _, want) in cases.items() if want}
    decoded = decoding.decode_notes(seqs, ["chart"], "tokens", "start", "initial", PER).collect()
    assert [(r.chart, r.lane, r.tick, r.kind, r.end) for r in decoded] == [("", 0, 19, "hold", 27)]
