import math
import random
import zlib

import zstandard
from pyspark.sql import functions as F

from chronolane.llm import toxicity
from chronolane.llm.toxicity import fit, score_toxicity

DOCS = "doc_id long, text string, lang string, toxic int, toxic_logit string"


def corpus(n=700, seed=1):
    rng = random.Random(seed)
    syllables = ["an", "the", "tion", "er", "ou", "re", "st", "in", "ly", "ed"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 5)):
                words[rng.randrange(len(words))] = rng.choice(["vilewretch", "scumbag", "dimwit", "grubface"])
        rows.append((i, " ".join(words), "en", 0, "x"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    out = {r.doc_id: r.toxic_score for r in score_toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"), ["doc_id"]).collect()}
    held = [(out[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == bool(y) for s, y in held) >= 0.9 * len(held)


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    rows, labels = corpus(300)
    wrong = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    docs = spark.createDataFrame(rows, DOCS)
    runs = [sorted((r.doc_id, r.toxic_score) for r in score_toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int"), ["doc_id"]).collect()) for x in (labels, wrong)]
    assert runs[0] == runs[1]


def test_nulls_repeats_clashes_and_missing_labels(spark):
    rows, labels = corpus(120)
    odd = [(9001, None, None, None, None), (None, "", "en", 1, "x"), (3, rows[3][1], "en", 1, "x"), (9002, "the " * 40000, "en", 0, "x")]
    docs = spark.createDataFrame(rows + odd, DOCS)
    out = score_toxicity(docs, spark.createDataFrame(labels + [(None, 1), (7, None), (8, 1), (8, 0)], "doc_id long, toxic int"), ["doc_id", "text"])
    assert out.count() == len(rows) + len(odd)
    assert out.filter(F.col("toxic_score").isNull() | ~F.col("toxic_score").between(0, 1)).count() == 0
    none = score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.agg(F.max("toxic_score")).first()[0] == 0.0
    assert score_toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_fit_needs_both_classes():
    assert fit(["a"], []) is None and fit([], ["a"]) is None
    many = [f"{c} b c" for c in "abcdefghijkl"], [f"{c} e f" for c in "abcdefghijkl"]
    assert fit(*many) is not None


def plain_logit(text, model):
    """One window after the other with a compressor of its own, features by their words."""
    words = (text or "").lower().encode().split()
    cut = [b" " + b" ".join(words[i : i + 4]) + b" " for i in range(0, len(words), 4)] or [b""]
    if len(words) > 4 and len(words) % 4:
        assert len(cut) == math.ceil(len(words) / 4)
    lengths = []
    for content in (b"\xff" * len(model.toxic) + model.ordinary, model.toxic + model.ordinary):
        params = zstandard.ZstdCompressionParameters.from_level(3, source_size=128, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0)
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=params)
        lengths.append([len(zstandard.ZstdCompressor(compression_params=params, dict_data=data).compress(w + model.ordinary[-64:])) for w in cut])
    d = sorted((a - b for a, b in zip(*lengths)), reverse=True)
    n = len(d)
    x = [d[0], sum(d[:3]) / len(d[:3]), sum(d) / n, sum(d) / n**0.5, math.log(n), sum(max(v - 1, 0) for v in d) / n**0.5, sum(max(v - 3, 0) for v in d) / n**0.5]
    x += [sum(v >= 2 for v in d) / n, math.log1p(sum(v >= 2 for v in d)), math.log1p(sum(v >= 3 for v in d))]
    return sum((v - m) / s * w for v, m, s, w in zip(x, model.mean, model.scale, model.weights)) + model.weights[-1]


def test_scores_equal_a_plain_loop(spark):
    rows, labels = corpus(240)
    rows += [(5000, "", None, 0, ""), (5001, None, None, 0, ""), (5002, "one", None, 0, ""), (5003, "vilewretch " * 9 + "x", None, 0, "")]
    docs, marked = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    models = toxicity.fit_on(docs, marked)
    texts = {i: t for i, t, *_ in rows}
    logits = {i: [plain_logit(t, m) for m in models] for i, t in texts.items()}
    seen = [(y, logits[i][1 - toxicity.fold_of(texts[i])]) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    bins = [(y, math.floor(max(-10.0, min(10.0, v)) * 100) / 100) for y, v in seen]
    f1 = lambda t: 2 * sum(y for y, b in bins if b >= t) / (sum(b >= t for _, b in bins) + sum(y for y, _ in bins))
    best = max((f1(t), t) for t in {b for _, b in bins} | {0.0})
    cut = best[1]
    got = {r.doc_id: r.toxic_score for r in score_toxicity(docs, marked, ["doc_id"]).collect()}
    for i, (a, b) in logits.items():
        assert abs(got[i] - 1 / (1 + math.exp(cut - (a + b) / 2))) < 1e-6


def test_toxic_words_of_a_language_with_few_documents_are_found():
    """Made of the syllables of its ordinary words, each another one, in an eighth of the documents."""
    rng = random.Random(5)
    common = ["an", "the", "tion", "er", "ou", "re", "st", "in", "ly", "ed", "ha", "es", "on", "th"]
    rare = ["aux", "elle", "ique", "ment", "eau", "oir", "vi", "qu", "euil", "ai", "ch", "pa", "gne", "ille"]
    word = lambda of: "".join(rng.choice(of) for _ in range(rng.randint(1, 4)))

    def text(i):
        few = i % 8 == 0
        words = [word(rare if few else common) for _ in range(rng.randint(60, 240))]
        if i % 16 < 2:
            for at in rng.sample(range(len(words)), rng.randint(4, 8)):
                words[at] = "cheuilvi" + rng.choice(rare) if few else rng.choice(["vilewretch", "scumbag", "dimwit", "grubface", "worthless"])
        return few, " ".join(words)

    rows = [(i % 16 < 2, *text(i)) for i in range(1600)]
    seen, held = rows[:1200], rows[1200:]
    models = fit([t for y, _, t in seen if y], [t for y, _, t in seen if not y])
    logit = lambda t: sum(m.logits([t], toxicity.Compressors(m.ordinary, m.toxic))[0] for m in models) / 2
    scores = [(few, y, logit(t)) for y, few, t in held]
    clean = sorted(s for _, y, s in scores if not y)
    bar = clean[-1 - len(clean) // 50]
    for language in (False, True):
        toxic = [s for few, y, s in scores if y and few == language]
        assert sum(s > bar for s in toxic) >= 0.9 * len(toxic) > 0
