"""Exact n-gram Jaccard self-join in size-banded tiles with hashed bitmap signatures.

A document is the sorted array of its distinct shingle hashes (64 bits). Documents with equal arrays are one class.
A tile gathers the classes of one size band that hold the same neighbouring hashes. In a tile, a 1024-bit parity bitmap
bounds the overlap from above by a bit count; what passes is decided by intersecting the arrays.

Why neighbours: two different sets at Jaccard >= num / den hold at least k = num / (den - num) common hashes for each
hash that one of them lacks. Laid on a circle in order, some gap between two such hashes so has k common hashes, and
these are neighbours in both sets. A set offers, of each k neighbours, the gram of GRAM neighbours with the least hash:
what it picks follows from those k alone, so both sets of a link offer the same gram. Sets of fewer than k hashes link
with equal ones alone. No tile rests on what a set lacks, so unrelated sets don't meet.

Tiles of more than SPLIT members, as a passage in many documents makes them, are parted by the k neighbours that the
gram was picked from, which both sets of a link hold too. A tile first offers its members to its first one. Only tiles
whose members are then still in several components compare the rest, by blocks of bounded size and across components
only: first each member with one other than the first that bitmaps leave possible, which joins most of what belongs
together; then, in tiles where components still differ, with all of them. So a group of thousands of near copies costs
about a pair a member, and no link between different components is lost: the last pass leaves out only pairs of one
component and pairs that were compared before.

Offers are the bulk of what is shuffled, as nearly every set makes hundreds. Tiles are therefore gathered in up to SLICES
passes, each over the keys with some lowest bits, which lie in a column of their own: a pass reads, shuffles and joins its
part of the offers alone, and all passes together no more than one over all of them would. What no later step reads is
removed from the shared folder on the way.

Links are counted on demand: inside each component every two classes are compared once, in blocks of bounded rows and
bytes, by bitmap and arrays, or by products of the blocks' incidence matrices where most pairs pass the bitmap. Pairs
are summed where they are found and never leave the task; the work is quadratic in a component's classes, not in their
copies.

Defined cases: null or empty text, or white space alone, is linked with nothing and is its own component; fewer words
than a shingle give one shingle; repeated rows share their class; rows of one doc_id are one document, so what any of
them links with is in one component, while links are counted by rows; a null doc_id counts for no minimum; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cuts, drop_unread, small_batches, small_side, table, write_cut
from .components import components

BITS = 1024
#: Classes in a block of a tile or component, in the mean, and bytes of their arrays in a block of a component.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Ratio of the upper ends of neighbouring size bands, and neighbours in a gram, at most.
BAND, GRAM = 4, 3
#: Members from which a tile is parted further.
SPLIT = 4096
#: Parts of the tiles' keys (a power of two), and hashes of all sets in a pass over some of them, if there are enough parts.
#: Any table but a small one takes all passes, so that their number doesn't grow with it.
SLICES, PASS = 8, 1 << 20
#: Words kept in a task's table of word hashes before it starts anew.
CACHED = 1 << 17
#: Columns of an incidence matrix at a time.
COLUMNS = 2048


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; A-Z lower-cased, words between ASCII white space."""

    def __init__(self, words: int) -> None:
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > CACHED:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(h))
        n = len(h) - k + 1
        total = np.full(n, (k * 0x9E3779B97F4A7C15) % (1 << 64), np.uint64)
        for i in range(k):
            total = total * np.uint64(0xD6E8FEB86659FD93) + _mix(h[i : i + n] + np.uint64(i))
        return np.unique(_mix(total))


def bands(n: int, num: int, den: int) -> range:
    """Bands of a set of ``n`` hashes: its own and those of larger sets that it may link with."""
    own, top = 0, 1
    while top < n:
        own, top = own + 1, top * BAND
    last = own
    while top < n * den // num:
        last, top = last + 1, top * BAND
    return range(own, last + 1)


def _chain(hashes: np.ndarray, length: int) -> np.ndarray:
    """A key for each hash and those that follow it on the circle, ``length`` together."""
    around = np.concatenate([hashes, hashes[:length]])
    keys = np.zeros(len(hashes), np.uint64)
    for i in range(length):
        keys = keys * np.uint64(0xD6E8FEB86659FD93) + _mix(around[i : i + len(hashes)] + np.uint64(i))
    return _mix(keys)


def picked(hashes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """For each k neighbours that start at a hash: the key of the gram picked there; and k."""
    n = len(hashes)
    if num >= den or n * (den - num) < num:
        return np.empty(0, np.uint64), 0
    k = max(1, -(-num // (den - num)))
    gram = max(1, min(GRAM, k // 2))
    keys = _chain(hashes, gram)
    around = np.concatenate([keys, keys[:k]])
    return reduce(np.minimum, [around[i : i + n] for i in range(k - gram + 1)]), k


def _in_band(keys: np.ndarray, band: int) -> np.ndarray:
    return _mix(keys + np.uint64((band + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def signatures(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the tiles that a set takes part in, for the threshold num / den."""
    keys, k = picked(hashes, num, den)
    return np.concatenate([_in_band(np.unique(keys), band) for band in bands(len(hashes), num, den)]) if k else keys


def parted(hashes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of tiles, and beside each the key of a part of it that the set is in."""
    keys, k = picked(hashes, num, den)
    if not k:
        return keys, keys
    near = _chain(hashes, k)
    tiles = [_in_band(keys, band) for band in bands(len(hashes), num, den)]
    return np.concatenate(tiles), np.concatenate([_mix(near ^ t) for t in tiles])


def _bitmap(hashes: np.ndarray) -> bytes:
    return np.packbits((np.bincount((hashes >> np.uint64(3) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


FEATURES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bits", pa.binary()), *[(f"sigs{k}", pa.list_(pa.int64())) for k in range(SLICES)]])


def _sliced(sigs: list[np.ndarray]) -> list[pa.ListArray]:
    """For each slice, the keys in it of every set."""
    keys, ends = np.concatenate([*sigs, np.empty(0, np.int64)]), np.cumsum([0, *map(len, sigs)])
    slices = []
    for k in range(SLICES):
        own = keys & (SLICES - 1) == k
        slices.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)])[ends].astype(np.int32)), pa.array(keys[own])))
    return slices


def features(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(row, doc_id, n, digest, bits, sigs0, ...) of every text; write it at once, as ``row`` follows the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            sizes, digests, bits, sigs = [], [], [], []
            for text in batch.column(1).to_pylist():
                h = shingle(text)
                sizes.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                bits.append(_bitmap(h))
                sigs.append(signatures(h, num, den).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bits, pa.binary()), *_sliced(sigs)], schema=FEATURES)

    columns = ", ".join(["doc_id long, n long, digest binary, bits binary", *[f"sigs{k} array<long>" for k in range(SLICES)]])
    made = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, columns)
    return made.select(F.monotonically_increasing_id().alias("row"), "*")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _may_link(n: np.ndarray, m: np.ndarray, apart: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sizes and the bit count of the bitmaps' difference leave a link possible."""
    overlap = (n + m - apart.astype(np.int64)) // 2
    return (den * np.minimum(n, m) >= num * np.maximum(n, m)) & (den * overlap >= num * (n + m - overlap))


def _bounded(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                a, n, p, b, m, q = (x.column(c) for c in ("a", "n_a", "bits_a", "b", "n_b", "bits_b"))
                apart = np.bitwise_count(_matrix(p) ^ _matrix(q)).sum(axis=1)
                keep = pa.array(_may_link(n.to_numpy(), m.to_numpy(), apart, num, den))
                yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    side = {c: sketches.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab"}
    return pairs.join(side["a"], "a").join(side["b"], "b").mapInArrow(run, "a long, b long")


def _texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text) of documents that some of ``nodes`` are classes of, among others, and (node, digest, id) of these classes, written."""
    wanted = write_cut(classes.join(small_side(nodes, 16), "node", "left_semi").select("node", "digest", F.col("least").alias("id")), "wanted")
    ids = small_side(wanted.select("id").distinct(), 16)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text"), wanted


def _arrays(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, have: DataFrame | None = None) -> DataFrame:
    """(node, hashes) for classes in ``pairs``, written; those in ``have`` are taken from there, the others' texts read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for x in batches:
            made = [shingle(t).tobytes() for t in x.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(h) for h in made], pa.binary()), pa.array(made, pa.binary())], ["digest", "hashes"])

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts, wanted = _texts(nodes if have is None else nodes.join(have.select("node"), "node", "left_anti"), classes, docs)
    # Other texts of the same doc_id, and repeated rows, fall out here.
    made = texts.mapInArrow(run, "digest binary, hashes binary").join(small_side(wanted.select("digest", "node"), 64), "digest").select("node", "hashes").dropDuplicates(["node"])
    made = write_cut(made, "arrays")
    return made if have is None else have.unionByName(made)


def _parts(nodes: DataFrame, hot: DataFrame, classes: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(sig, node) that replace the offers of ``nodes`` to the tiles in ``hot``, a part of a tile for each; texts are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for x in batches:
            for text in x.column(0).to_pylist():
                h = shingle(text)
                tiles, parts = (v.view(np.int64) for v in parted(h, num, den))
                if len(tiles):
                    yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(h.tobytes())] * len(tiles), pa.binary()), pa.array(tiles), pa.array(parts)], ["digest", "tile", "sig"])

    texts, wanted = _texts(nodes, classes, docs)
    dealt = texts.mapInArrow(run, "digest binary, tile long, sig long").join(hot.withColumnRenamed("sig", "tile"), "tile", "left_semi")
    return dealt.join(small_side(wanted.select("digest", "node"), 64), "digest").select("sig", "node").distinct()


def _overlap(p: np.ndarray, q: np.ndarray) -> int:
    at = np.searchsorted(p, q)
    return int((p[np.minimum(at, len(p) - 1)] == q).sum())


def _linked(pairs: DataFrame, arrays: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose sorted arrays intersect enough."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for p, q in zip(x.column("hashes_a"), x.column("hashes_b"), strict=True):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                overlap = _overlap(p, q)
                keep.append(den * overlap >= num * (len(p) + len(q) - overlap))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column("a").filter(keep), x.column("b").filter(keep)], ["a", "b"])

    side = {c: arrays.select(F.col("node").alias(c), F.col("hashes").alias(f"hashes_{c}")) for c in "ab"}
    return pairs.join(side["a"], "a").join(side["b"], "b").mapInArrow(decide, "a long, b long").distinct()


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys, in order, from sorted batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        k = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(k)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if held and tuple(k[i]) != last:
                yield pa.concat_tables(held)
                held = []
            held.append(rows.slice(i, j - i))
            last = tuple(k[i])
    if held:
        yield pa.concat_tables(held)


def _cells(members: DataFrame, group: str) -> DataFrame:
    """Members of ``group`` in ``blocks`` blocks, dealt to every pair (i, j) of blocks that theirs is in."""
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    cells = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(every))
    cells = cells.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    return cells.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def _across(members: DataFrame, num: int, den: int, one: bool = False) -> DataFrame:
    """Pairs of different components in the same tile that bitmaps leave possible; with ``one``, one for each member and block.

    The tile's first member, ``low``, was offered to all others before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _runs(batches, ["sig", "i", "j"]):
            tile = tile.combine_chunks()
            node, part, n, block, low = (tile.column(c).to_numpy() for c in ("node", "part", "n", "block", "low"))
            same = tile.column("i")[0].as_py() == tile.column("j")[0].as_py()
            bits, met = _matrix(tile.column("bits")), np.zeros(len(node), bool)
            out: list[np.ndarray] = []
            for k in range(0, len(node), 64):
                rows = slice(k, k + 64)
                fine = _may_link(n[rows, None], n[None], np.bitwise_count(bits[rows, None] ^ bits[None]).sum(axis=2), num, den)
                fine &= (part[rows, None] != part[None]) & (node[rows, None] < node[None]) & (node[rows, None] != low[rows, None])
                if not same:  # within a block is another tile's work
                    fine &= block[rows, None] != block[None]
                if one:
                    fine &= np.cumsum(fine, axis=0) == 1
                    fine[:, met] = False
                    met |= fine.any(axis=0)
                a, b = np.nonzero(fine)
                out.append(np.stack([node[rows][a], node[b]]))
            a, b = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return _cells(members.select("sig", "node", "low", "part", "n", "bits", "blocks"), "sig").mapInArrow(run, "a long, b long").distinct()


def links_between(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Matrix of which sets on the left link with which on the right."""
    n, m = (np.array([len(h) for h in side], np.int64) for side in (left, right))
    bits = [np.frombuffer(b"".join(map(_bitmap, side)), np.uint64).reshape(-1, BITS // 64) for side in (left, right)]
    fine = np.concatenate([_may_link(n[k : k + 64, None], m[None], np.bitwise_count(bits[0][k : k + 64, None] ^ bits[1][None]).sum(axis=2), num, den) for k in range(0, len(n), 64)])
    some = int(fine.sum())
    if some * (15 + 0.05 * n.mean()) < 50 + len(n) * len(m) * n.mean() / 2e4:  # in microseconds, with a guess at the shared hashes
        for a, b in zip(*np.nonzero(fine), strict=True):
            overlap = _overlap(left[a], right[b])
            fine[a, b] = den * overlap >= num * (n[a] + m[b] - overlap)
        return fine
    # Hashes of one set alone don't count, those of all sets count alike; the others are columns of 0 and 1.
    values, code, seen = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    everywhere = seen == len(n) + len(m)
    column = np.where((seen > 1) & ~everywhere, np.cumsum((seen > 1) & ~everywhere) - 1, -1)[code]
    owner = np.repeat(np.arange(len(n) + len(m)), np.concatenate([n, m]))
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    overlap = np.full((len(n), len(m)), int(everywhere.sum()), np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        at = slice(*np.searchsorted(column, (low, low + COLUMNS)))
        marks = np.zeros((len(n) + len(m), COLUMNS), np.float32)
        marks[owner[at], column[at] - low] = 1
        overlap += np.rint(marks[: len(n)] @ marks[len(n) :].T).astype(np.int64)
    return fine & (den * overlap >= num * (n[:, None] + m[None] - overlap))


def _link_counts(labels: DataFrame, classes: DataFrame, arrays: DataFrame, num: int, den: int) -> DataFrame:
    """(node, n): rows of other classes that each class of ``labels`` links with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _runs(batches, ["component", "i", "j"]):
            node, block, weight = (cell.column(c).to_numpy() for c in ("node", "block", "class_size"))
            sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in cell.column("hashes")]
            i, j = (cell.column(c)[0].as_py() for c in "ij")
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if not len(left) or not len(right):
                continue
            fine = links_between([sets[k] for k in left], [sets[k] for k in right], num, den)
            if i == j:
                np.fill_diagonal(fine, False)
                count = fine @ weight[right]
            else:
                count = np.concatenate([fine @ weight[right], fine.T @ weight[left]])
                left = np.concatenate([left, right])
            yield pa.RecordBatch.from_arrays([pa.array(node[left]), pa.array(count)], ["node", "n"])

    sizes = labels.join(arrays.select("node", F.octet_length("hashes").alias("bytes")), "node").groupBy("component")
    sizes = sizes.agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))
    members = labels.join(sizes, "component").join(classes.select("node", "class_size"), "node").join(arrays, "node")
    return _cells(members, "component").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def _same_ids(made: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes that rows of one doc_id are in, the first with each other."""
    rows = made.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "digest")
    again = write_cut(rows.groupBy("doc_id").agg(F.min("digest").alias("p"), F.max("digest").alias("q")).filter("p < q").select("doc_id"), "again")
    both = rows.join(small_side(again, 16), "doc_id", "left_semi").distinct().join(classes.select("digest", "node"), "digest").select("doc_id", F.col("node").alias("b"))
    return both.join(both.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").filter("a < b").select("a", "b").distinct()


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, count_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_size) of every document; linked: den * |A & B| >= num * |A | B|.

    With ``count_links`` also n_links, the number of other rows that it is linked with.
    """
    spark, mark = docs.sparkSession, cuts()
    dealt = write_cut(features(docs, words, num, den), "features")
    made = write_cut(dealt.select("row", "doc_id", "n", "digest", "bits"), "rows")
    # A class is known by its first row.
    classes = write_cut(made.filter("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("class_size")), "classes")
    firsts = small_side(classes.select("node"), 16)
    sketches = made.withColumnRenamed("row", "node").join(firsts, "node", "left_semi").select("node", "n", "bits")
    tile = lambda offered: offered.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size")).filter("low < high")
    passes = min(SLICES, 1 + (made.agg(F.sum("n")).first()[0] or 0) // PASS)
    tiles, members, crowds = [], [], []
    for k in range(passes):
        sigs = F.concat(*[f"sigs{i}" for i in range(k, SLICES, passes)])
        offers = dealt.select(F.col("row").alias("node"), sigs.alias("sigs")).join(firsts, "node", "left_semi").select(F.explode("sigs").alias("sig"), "node")
        tiles.append(write_cut(tile(offers), "tiles"))
        large = tiles[k].filter(F.col("size").between(3, SPLIT)).select("sig", "low")
        members.append(write_cut(offers.join(small_side(large, 40), "sig").select("sig", "node", "low"), "members"))
        hot = tiles[k].filter(F.col("size") > SPLIT).select("sig")
        if not hot.isEmpty():
            crowds.append(write_cut(offers.join(small_side(hot, 16), "sig", "left_semi").select("node").distinct(), "crowds"))
    tiles = reduce(DataFrame.unionByName, tiles)
    if crowds:
        hot = tiles.filter(F.col("size") > SPLIT).select("sig")
        apart = write_cut(_parts(reduce(DataFrame.unionByName, crowds).distinct(), small_side(hot, 16), classes, docs, words, num, den), "parts")
        again = write_cut(tile(apart), "part-tiles")
        tiles = tiles.filter(F.col("size") <= SPLIT).unionByName(again)
        members.append(apart.join(small_side(again.filter("size > 2").select("sig", "low"), 40), "sig").select("sig", "node", "low"))
    members = write_cut(reduce(DataFrame.unionByName, members), "members")
    drop_unread(spark, mark, made, classes, tiles, members)
    stars = tiles.filter("size = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).unionByName(members.filter("node > low").select(F.col("low").alias("a"), F.col("node").alias("b"))).distinct()
    tried = write_cut(_bounded(stars, sketches, num, den), "likely")
    drop_unread(spark, mark, made, classes, members, tried)
    arrays = _arrays(tried, classes, docs, words)
    same = write_cut(_same_ids(made, classes), "same-ids")
    links = write_cut(_linked(tried, arrays, num, den).unionByName(same), "links")
    labels = components(links, "a", "b")
    for one in (True, False):
        part = members.join(labels, "node", "left").withColumn("part", F.coalesce("component", "node"))
        mixed = part.groupBy("sig").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.ceil(F.count("*") / BLOCK).alias("blocks")).filter("p < q").select("sig", "blocks")
        rest = write_cut(part.select("sig", "node", "low", "part").join(mixed, "sig"), "rest")
        if rest.isEmpty():
            break
        more = write_cut(_across(rest.join(sketches, "node"), num, den, one).join(tried, ["a", "b"], "left_anti"), "more")
        if more.isEmpty():  # what the first pass offers may have been tried in other tiles; the last one still has to look at all
            continue
        arrays = _arrays(more, classes, docs, words, arrays)
        links = write_cut(links.unionByName(_linked(more, arrays, num, den)), "links")
        labels = components(links, "a", "b")
        tried = tried.unionByName(more)
    labels = write_cut(labels, "labels")
    roots = labels.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("root"))
    placed = classes.join(labels.join(roots, "component"), "node", "left").select("node", "digest", F.coalesce("root", "least").alias("component_id"), "class_size")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size")]
    if count_links:
        counts = write_cut(_link_counts(labels, classes, arrays, num, den), "link-counts")
        placed = placed.join(small_side(counts, 16), "node", "left").withColumn("n_links", F.col("class_size") - 1 + F.coalesce("n", F.lit(0))).drop("n")
        columns.append(F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    placed = placed.drop("node")
    if classes.count() * 64 <= BROADCAST_BYTES:
        placed = F.broadcast(placed)
    out = made.select("doc_id", "n", "digest").join(placed, "digest", "left").select(*columns)
    drop_unread(spark, mark, out)
    return out


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100, count_links=True)


#: All pairs that share a shingle, then components by walking links: for small tables.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * o >= 90 * (na + nb - o)),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id, CASE WHEN len(s) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY s) END AS class_size, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) k ON k.a = s.doc_id
"""
