import math
import random

from chronolane.llm.licenses import LEAST, TEMPLATES, Scanner, _increasing, align, licenses, words_of

SCHEMA = "doc_id long, text string, license string"


def test_increasing_run_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        js = rng.sample(range(12), rng.randint(0, 9))
        pairs = list(enumerate(js))
        best = 0
        for mask in range(1 << len(js)):
            run = [js[k] for k in range(len(js)) if mask >> k & 1]
            if run == sorted(run):
                best = max(best, len(run))
        got = _increasing(pairs)
        assert len(got) == best and all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:]))


def test_alignment_is_increasing_and_equal_and_whole_for_copies():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 15))] for _ in range(2))
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x < p and y < q for (x, y), (p, q) in zip(pairs, pairs[1:]))
        assert len(align(a, a)) == len(a)


def test_every_template_is_found_in_prose_repeated_and_edited(spark):
    rows = []
    for k, (_, text) in enumerate(TEMPLATES):
        prose = "Lorem the ipsum of license dolor. " * 20
        rows.append((k, prose + text + " " + prose, "x"))
        rows.append((100 + k, (text + "\n") * 5, "x"))
        w = text.split()
        if len(w) > 15:
            w[7] = "altered"
            rows.append((200 + k, prose + " ".join(w), "x"))
    rows += [(900, None, "x"), (901, "", "x"), (902, "A plain text about the work and the license.", "x"), (903, "word " * 30000 + TEMPLATES[2][1], "x")]
    found = {}
    for r in licenses(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault(r.doc_id, {})[r.license] = r
    for k, (name, text) in enumerate(TEMPLATES):
        assert found[k][name].coverage == 1.0 and found[100 + k][name].coverage == 1.0
        if 200 + k in {r[0] for r in rows}:
            assert found[200 + k][name].coverage >= 0.9
    assert not {900, 901, 902} & set(found) and found[903]["MIT"].first_word == 30000


def test_scan_reports_place_and_number():
    hit = Scanner().scan("x y. Released under the MIT License. z. Released under the MIT License.")["MIT"]
    assert hit[2:] == (2, 7, 2) and words_of("A-b") == ["a", "b"]


def test_empty(spark):
    assert licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def edited(rng, t, missing, inserted):
    """A notice without some of its words, and with up to ``inserted`` words before each other one."""
    gone = set(rng.sample(range(len(t)), missing))
    return [w for j, v in enumerate(t) if j not in gone for w in [f"x{rng.randrange(10**6)}" for _ in range(rng.randint(0, inserted))] + [v]]


def test_edited_notices_are_found_as_by_aligning_whole_texts():
    rng, scanner, found = random.Random(5), Scanner(), 0
    for name, text in TEMPLATES * 60:
        t = words_of(text)
        body = edited(rng, t, rng.randint(0, len(t) // 4), rng.randint(0, 1))
        if rng.random() < 0.5:  # a long name somewhere
            body = [*body[: (at := rng.randrange(len(body)))], *[f"n{i}" for i in range(len(t) // 2)], *body[at:]] if len(body) <= len(t) else body
        words = [f"y{rng.randrange(10**6)}" for _ in range(rng.randint(0, 200))] + body + [f"z{rng.randrange(10**6)}" for _ in range(rng.randint(0, 200))]
        whole = len(align(words, t)) / len(t)
        hit = scanner.scan(" ".join(words)).get(name)
        if whole >= LEAST:
            found += 1
            assert hit and hit[0] >= whole
    assert found > 300


def test_no_words_are_needed_for_a_notice(spark):
    """Any words that a notice may lack, rarest ones too: once without 'and associated documentation files', 'restriction' changed."""
    mit = TEMPLATES[3][1].replace("and associated documentation files, ", "").replace("restriction", "limitation")
    rows = [(1, "Some prose. " * 9 + mit, "x")]
    scanner = Scanner()
    for k, (_, text) in enumerate(TEMPLATES):
        t = words_of(text)
        spare = len(t) - math.ceil(LEAST * len(t))
        rare = sorted(set(t), key=lambda w: (sum(w in words_of(x) for _, x in TEMPLATES), t.count(w), -len(w), w))[:spare]
        rows.append((100 + k, " ".join("gone" if w in rare and t.index(w) == j else w for j, w in enumerate(t)), "x"))
    found = {(r.doc_id, r.license) for r in licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (1, "MIT") in found and {(100 + k, name) for k, (name, _) in enumerate(TEMPLATES)} <= found
    assert scanner.scan(" ".join(f"rem{i} {w}" for i, w in enumerate(words_of(TEMPLATES[5][1]))))["GPL-3.0"][0] == 1.0


def test_notices_side_by_side_are_counted():
    for name, text in TEMPLATES:
        assert Scanner().scan((text + "\n") * 5)[name][4] == 5
