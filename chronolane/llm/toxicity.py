"""Toxicity by compression distance: two zstandard dictionaries, window compression lengths, calibrated thresholds.

One dictionary is trained on windows of ordinary texts, one on those of toxic texts. A toxic document is ordinary
language for its most part, so the toxic dictionary is trained on those of its words that compression tells apart. First
the toxic texts, and ordinary ones of the same length, are cut into PARTS small parts; words stay that the toxic parts
shorten, in the mean, by more than the ordinary parts do all but FALSE of ordinary words. What a single dictionary holds by
chance evens out over the parts, so a word counts that few documents share, as in a language that few are in. Then those
stay that the toxic dictionary shortens by more than it does all but FALSE of ordinary words, and it is trained again,
ROUNDS times. Documents are in two folds, and words are only ever judged by dictionaries of the other fold; so what stays
is what toxic documents share. The toxic dictionary goes before the ordinary content, as toxic text is ordinary text with
something more; the ordinary one has bytes there that no text contains, so that offsets cost the same.

A logistic curve over the differences of a document, fitted on documents that its dictionaries didn't see, gives a
logit for each fold's dictionaries. A document's logit is the mean of both; the threshold, set on all labelled training
rows by the logit of the other fold's dictionaries, becomes 0.5.

Only the fit of dictionaries and curve sees a sample: at most SAMPLE labelled documents a class, of at most LONGEST
characters, chosen by a hash of the id, and of their windows at most WINDOWS, of their words WORDS, a fold and class.
Thresholds and scores cover all rows and whole texts. Inputs of a score are the text alone.

Defined cases: a null text counts as empty; an empty text is one empty window and gets a score; a doc_id labelled more
than once is toxic if any label is; without toxic or ordinary training rows in both folds all scores are 0; an empty
table gives no rows; repeated rows each give a row; other columns pass through.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, write_cut

SAMPLE, LONGEST, WINDOWS, WORDS = 2000, 1 << 15, 60_000, 30_000
#: Words in a window that is scored, and in the overlapping ones that the ordinary dictionary is trained on.
SCORED, TRAINED = 4, 2
#: Bytes of the dictionaries, compression level.
ORDINARY, TOXIC, LEVEL = 65536, 2048, 3
#: Bytes of ordinary content behind each window: a short window alone would often be stored as it is, whatever the dictionary.
TAIL = 64
#: Parts that texts are cut into, bytes of a part at most, and of a text in it.
PARTS, PART, EACH = 16, 65536, 4096
#: Rounds in which the toxic words are refined, and the share of ordinary words that may pass for toxic.
ROUNDS, FALSE = 2, 0.003
#: Bins for the choice of the threshold.
BINS = 2000


def windows(text: str | None, words: int = SCORED, step: int = SCORED) -> list[bytes]:
    """The text's words, lower-cased, in groups; at least one window."""
    w = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return [b" " + b" ".join(w[i : i + words]) + b" " for i in range(0, max(1, len(w) - words + step), step)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=128, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0)
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=data)


class Compressors:
    """Both dictionaries, ready to compress."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.tail, self.both = ordinary[-TAIL:], [_compressor(content) for content in (b"\xff" * len(toxic) + ordinary, toxic + ordinary)]

    def differences(self, cut: list[bytes]) -> np.ndarray:
        """How many bytes shorter each window is with the toxic dictionary."""
        plain, toxic = (c.compress for c in self.both)
        cut = [w + self.tail for w in cut]
        return np.fromiter((len(plain(w)) - len(toxic(w)) for w in cut), np.float64, len(cut))

    def features(self, text: str | None) -> list[float]:
        """What the windows' differences say of a document: the largest, means, and sums by length."""
        d = np.sort(self.differences(windows(text)))[::-1]
        n, root = len(d), math.sqrt(len(d))
        over = [np.maximum(d - k, 0).sum() / root for k in (1, 3)]
        return [d[0], d[:3].mean(), d.mean(), d.sum() / root, math.log(n), *over, (d >= 2).mean(), math.log1p((d >= 2).sum()), math.log1p((d >= 3).sum())]


@dataclass(frozen=True)
class Model:
    """Dictionaries of one fold, and the curve over their features."""

    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def logits(self, texts, compressors: Compressors) -> np.ndarray:
        x = np.array([compressors.features(t) for t in texts]).reshape(-1, len(self.mean))
        return ((x - self.mean) / self.scale) @ np.array(self.weights[:-1]) + self.weights[-1]


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary's bytes; samples too few to train on are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights of a logistic regression with a small ridge, by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-1 * np.eye(len(w)), a.T @ (p - y) + 1e-1 * w)
    return mean, scale, w


def fold_of(text: str) -> int:
    """Fold of a text of the sample; equal texts share theirs, so that none is judged by its own dictionary."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 7 & 1


def _parts(toxic: list[str], ordinary: list[str], rng: random.Random) -> tuple[list[bytes], list[bytes]]:
    """Toxic and ordinary texts dealt into parts; the two of a pair are equally long."""
    n = min(PARTS, len(toxic), len(ordinary))
    plain = lambda t: b" " + b" ".join(t.lower().encode("utf-8", "surrogatepass").split())[:EACH] + b" "
    dealt = [[b"".join(plain(t) for t in docs[k::n])[:PART] for k in range(n)] for docs in (rng.sample(side, len(side)) for side in (toxic, ordinary))]
    return tuple(map(list, zip(*[(t[: len(o)], o[: len(t)]) for t, o in zip(*dealt, strict=True)], strict=True)))


def _leanings(cut: list[bytes], toxic: list[bytes], ordinary: list[bytes], tail: bytes) -> np.ndarray:
    """How many bytes shorter each word is, in the mean, with a toxic part as its dictionary than with an ordinary one."""
    place = {w: i for i, w in enumerate(dict.fromkeys(cut))}
    once, sums = [w + tail for w in place], np.zeros(len(place))
    for sign, parts in ((-1, toxic), (1, ordinary)):
        for part in parts:
            c = _compressor(part + tail).compress
            sums += sign * np.fromiter((len(c(w)) for w in once), np.float64, len(once))
    return sums[[place[w] for w in cut]] / len(toxic)


def fit(toxic: list[str], ordinary: list[str], seed: int = 7) -> tuple[Model, Model] | None:
    """Train dictionaries and curves on texts, in two folds; None if a class is missing in one."""
    rng = random.Random(seed)
    few = lambda cut, most: rng.sample(cut, most) if len(cut) > most else cut
    texts = [[[t for t in dict.fromkeys(side) if fold_of(t) == f] for f in (0, 1)] for side in (toxic, ordinary)]
    if not all(t for side in texts for t in side):
        return None
    base = [_trained(ORDINARY, few([w for t in fold for w in windows(t, TRAINED, 1)], WINDOWS)) for fold in texts[1]]
    # A word counts once for each text.
    cut = [[few([w for t in fold for w in dict.fromkeys(windows(t, 1, 1))], WORDS) for fold in side] for side in texts]
    kept = []
    for f in (0, 1):
        lean = _leanings(cut[1][f] + cut[0][f], *_parts(texts[0][1 - f], texts[1][1 - f], rng), base[1 - f][-TAIL:])
        n = len(cut[1][f])
        bar = max(0.0, np.quantile(lean[:n], 1 - FALSE, method="higher"))
        kept.append([w for w, d in zip(cut[0][f], lean[n:], strict=True) if d > bar] or cut[0][f])
    last = None
    for _ in range(ROUNDS):
        made = [Compressors(b, _trained(TOXIC, k)) for b, k in zip(base, kept, strict=True)]
        now = []
        for f in (0, 1):
            other = made[1 - f]
            bar = max(0.0, np.quantile(other.differences(cut[1][f]), 1 - FALSE, method="higher"))
            now.append([w for w, d in zip(cut[0][f], other.differences(cut[0][f]), strict=True) if d > bar] or kept[f])
        # What the last two rounds chose, as what fits into a dictionary may change by turns.
        kept, last = now if last is None else [p + q for p, q in zip(last, now, strict=True)], now
    own = [_trained(TOXIC, k) for k in kept]
    models = []
    for f in (0, 1):
        made = Compressors(base[f], own[f])
        x = np.array([made.features(t) for side in texts for t in side[1 - f]])
        y = np.r_[np.ones(len(texts[0][1 - f])), np.zeros(len(texts[1][1 - f]))]
        models.append(Model(base[f], own[f], *map(tuple, _curve(x, y))))
    return tuple(models)


def _training(labels: DataFrame) -> DataFrame:
    """(labelled, toxic) of the labelled rows that may be learned from."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    return labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold != 0)).groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("toxic").alias("toxic"))


def fit_on(docs: DataFrame, labels: DataFrame) -> tuple[Model, Model] | None:
    """Fit on the bounded sample; its ids are few enough to broadcast, so no text is shuffled."""
    train = _training(labels)
    few = [train.filter(F.col("toxic") == y).orderBy(F.xxhash64("labelled"), "labelled").limit(SAMPLE) for y in (1, 0)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") <= LONGEST).join(F.broadcast(few[0].unionByName(few[1])), F.col("doc_id") == F.col("labelled")).select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in rows if r.toxic == 1], [r.text for r in rows if r.toxic == 0])


def threshold(scored: DataFrame, labels: DataFrame) -> float:
    """The logit from which calling toxic gives the best F1, over all labelled training rows, in bins.

    ``scored`` has logits of both folds and ``toxic_fold``, the fold that a text belongs to: the other's logit counts.
    """
    logit = F.when(F.col("toxic_fold") == 0, F.col("toxic_logits")[1]).otherwise(F.col("toxic_logits")[0])
    bins = scored.join(_training(labels), F.col("doc_id").cast("long") == F.col("labelled")).groupBy(F.floor(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), logit)) * (BINS // 20)).alias("bin")).agg(F.sum("toxic").alias("hits"), F.count("*").alias("n")).collect()
    total, hits, n, best = sum(r.hits for r in bins), 0, 0, (0.0, 0.0)
    for r in sorted(bins, key=lambda r: -r.bin):
        hits, n = hits + r.hits, n + r.n
        best = max(best, (2 * hits / max(1, n + total), r.bin / (BINS // 20)))
    return best[1]


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and ``toxic_score`` of every document."""
    models = fit_on(docs, labels)
    keep = keep or docs.columns
    if models is None:
        return docs.select(*keep, F.lit(0.0).alias("toxic_score"))

    @F.pandas_udf("toxic_logits array<double>, toxic_fold int")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made = [Compressors(m.ordinary, m.toxic) for m in models]
        for texts in batches:
            logits = np.stack([m.logits(texts, c) for m, c in zip(models, made, strict=True)], axis=1)
            yield pd.DataFrame({"toxic_logits": list(logits), "toxic_fold": [fold_of(t or "") for t in texts]})

    scored = small_batches(docs).withColumn("_toxic", judge("text")).select(*keep, "_toxic.*")
    scored = write_cut(scored, "toxicity")
    logit = (F.col("toxic_logits")[0] + F.col("toxic_logits")[1]) / 2
    return scored.withColumn("toxic_score", 1 / (1 + F.exp(F.lit(threshold(scored, labels)) - logit))).drop("toxic_logits", "toxic_fold")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return score_toxicity(docs, table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
