"""Counting a frozen list of motifs in one pass, and reports of how two corpora's frequencies differ.

The list becomes a trie of steps: a first symbol, then gaps and symbols. Each task walks its sequences from every
position at once, a level at a time, by looking up sorted keys, and positions without a next node fall out; so the work
follows what matches, whatever the number of lengths, and a motif is found exactly. Long sequences are dealt in chunks
that overlap by the longest motif.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolane.operators.ranks import average_ranks
from chronolane.session import cut

#: Steps of a sequence in one task's chunk, and motifs that may be sent to every task.
CHUNK, MOTIFS = 1 << 16, 2_000_000
#: Names and bounds of the length buckets.
BUCKETS = (("1", 1, 1), ("2", 2, 2), ("3", 3, 3), ("4", 4, 4), ("5", 5, 5), ("6-8", 6, 8), ("9-16", 9, 16), ("17+", 17, 10**9))


@dataclass
class Trie:
    """Sorted keys of steps and the nodes they lead to; ``motif`` is the place in the list of a node that ends one, or -1."""

    scopes: list[str]
    symbols: list[str]
    gaps: list[int]
    root_keys: np.ndarray
    root_nodes: np.ndarray
    keys: np.ndarray
    nodes: np.ndarray
    motif: np.ndarray
    depth: int

    @classmethod
    def of(cls, motifs: list[tuple[str, str]]) -> Trie:
        listed = [(scope, text.split("/")[::2], [int(g) for g in text.split("/")[1::2]]) for scope, text in motifs]
        scopes = sorted({s for s, _, _ in listed})
        symbols = sorted({x for _, p, _ in listed for x in p})
        gaps = sorted({g for _, _, q in listed for g in q})
        at = [{v: i for i, v in enumerate(side)} for side in (scopes, symbols, gaps)]
        roots: dict[int, int] = {}
        steps: dict[int, int] = {}
        ends: list[int] = []

        def node(of: dict[int, int], key: int) -> int:
            if key not in of:
                of[key] = len(ends)
                ends.append(-1)
            return of[key]

        for number, (scope, parts, between) in enumerate(listed):
            now = node(roots, at[0][scope] * len(symbols) + at[1][parts[0]])
            for gap, part in zip(between, parts[1:], strict=True):
                now = node(steps, (now * len(gaps) + at[2][gap]) * len(symbols) + at[1][part])
            ends[now] = number
        table = lambda of: (np.array(sorted(of), np.int64), np.array([of[k] for k in sorted(of)], np.int64))
        return cls(scopes, symbols, gaps, *table(roots), *table(steps), np.array(ends, np.int64), max((len(p) for _, p, _ in listed), default=0))

    @staticmethod
    def _find(keys: np.ndarray, nodes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, nodes[at], -1)

    def matches(self, start: np.ndarray, seq: np.ndarray, scope: np.ndarray, symbol: np.ndarray, gap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, motifs) level by level; codes are -1 for what the list doesn't have."""
        pos = start[(scope[start] >= 0) & (symbol[start] >= 0)]
        node = self._find(self.root_keys, self.root_nodes, scope[pos] * len(self.symbols) + symbol[pos])
        for level in range(1, self.depth + 1):
            pos, node = pos[node >= 0], node[node >= 0]
            ended = self.motif[node] >= 0
            yield pos[ended], self.motif[node[ended]]
            if level == self.depth:
                return
            on = pos + level < len(seq)
            pos, node = pos[on], node[on]
            on = (seq[pos + level] == seq[pos]) & (gap[pos + level - 1] >= 0) & (symbol[pos + level] >= 0)
            pos, node = pos[on], node[on]
            node = self._find(self.keys, self.nodes, (node * len(self.gaps) + gap[pos + level - 1]) * len(self.symbols) + symbol[pos + level])


def _codes(column: pa.ChunkedArray, values: list) -> np.ndarray:
    found = pc.index_in(column, value_set=pa.array(values, column.type))
    return found.fill_null(-1).to_numpy().astype(np.int64)


def count_motifs(stepped: DataFrame, seq: list[str], vocabulary: DataFrame, chunk: int = CHUNK, by: list[str] | None = None) -> DataFrame:
    """(by..., scope, part, motif, n) of the motifs that occur, from steps (seq..., scope, part, i, symbol, gap) and a list (scope, motif).

    ``seq`` names a chart; with scope and part it names a sequence. ``by`` are the columns of ``seq`` that counts are kept
    apart by, none by default. The list is a frozen one, so it goes to every task; a list of more than MOTIFS is refused.
    A task hands on the counts of each batch, so it holds a batch and no table of counts.
    """
    spark, by = stepped.sparkSession, by or []
    rows = vocabulary.select(F.col("scope").cast("string"), "motif").distinct().limit(MOTIFS + 1).collect()
    if len(rows) > MOTIFS:
        raise ValueError(f"a list of more than {MOTIFS} motifs isn't sent to every task")
    motifs = sorted((r.scope, r.motif) for r in rows)
    trie = Trie.of(motifs)
    sent = spark.sparkContext.broadcast((trie, motifs))
    keys = [*seq, "scope", "part"]
    more = F.when((F.col("i") >= chunk) & (F.col("i") % chunk < trie.depth - 1), F.struct((F.floor(F.col("i") / chunk) - 1).cast("long").alias("_chunk"), F.lit(False).alias("_own")))
    both = F.array_compact(F.array(F.struct(F.floor(F.col("i") / chunk).cast("long").alias("_chunk"), F.lit(True).alias("_own")), more))
    dealt = stepped.select(*seq, F.col("scope").cast("string").alias("scope"), F.col("part").cast("string").alias("part"), F.col("i").cast("long").alias("i"), F.col("symbol").cast("string").alias("symbol"), F.col("gap").cast("long").alias("gap"), F.inline(both))
    dealt = dealt.repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, motifs = sent.value
        scopes, texts = (pa.array([m[k] for m in motifs], pa.string()) for k in (0, 1))
        held: pa.Table | None = None

        def work(rows: pa.Table, last: bool) -> tuple[pa.Table | None, list[pa.RecordBatch]]:
            """Walk from every row whose followers are all here; return the others, and what was counted."""
            rows = rows.combine_chunks()
            n = rows.num_rows
            code = lambda c: rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new = np.zeros(n, bool)
            new[:1] = True
            for c in [*keys, "_chunk"]:
                new[1:] |= code(c)[1:] != code(c)[:-1]
            seq_id = np.cumsum(new)
            first = n if last else min(int(np.flatnonzero(seq_id == seq_id[-1])[0]), n) if n else 0
            if not last and n - first > trie.depth:
                first = n - trie.depth
            start = np.flatnonzero(rows.column("_own").to_numpy()[:first])
            scope, symbol, gap = _codes(rows.column("scope"), trie.scopes), _codes(rows.column("symbol"), trie.symbols), _codes(rows.column("gap"), trie.gaps)
            group = np.zeros(n, np.int64)
            for c in [*by, "part"]:
                group = np.unique(group * (n + 1) + code(c), return_inverse=True)[1]
            hits = list(trie.matches(start, seq_id, scope, symbol, gap)) or [(start[:0], start[:0])]
            pos, found = (np.concatenate(side) for side in zip(*hits, strict=True))
            _, one, times = np.unique(group[pos] * max(1, len(motifs)) + found, return_index=True, return_counts=True)
            at, what = pa.array(pos[one]), pa.array(found[one])
            counted = pa.table([*[rows.column(c).take(at) for c in by], scopes.take(what), rows.column("part").take(at), texts.take(what), pa.array(times.astype(np.int64))], [*by, "scope", "part", "motif", "n"])
            return None if last else rows.slice(first), counted.combine_chunks().to_batches()

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held, counted = work(rows if held is None else pa.concat_tables([held, rows]), False)
            yield from counted
        if held is not None:
            yield from work(held, True)[1]

    text, whole = T.StringType(), T.LongType()
    fields = [*[dealt.schema[c] for c in by], *[T.StructField(c, kind) for c, kind in (("scope", text), ("part", text), ("motif", text), ("n", whole))]]
    return dealt.mapInArrow(run, T.StructType(fields)).groupBy(*by, "scope", "part", "motif").agg(F.sum("n").alias("n"))


def motif_report(stepped: DataFrame, seq: list[str], vocabulary: DataFrame, chunk: int = CHUNK, by: list[str] | None = None) -> DataFrame:
    """(by..., scope, part, motif, n, observations, average) of every motif of the list in every part and pooled (part all).

    Observations are a part's steps, the average is the count over the number of charts that have steps; zeros are kept.
    With ``by``, columns of ``seq`` that aren't null, all of it is worked out for each of their values in one pass.
    """
    by = by or []
    seen = stepped.groupBy(*by, F.col("scope").cast("string").alias("scope"), F.col("part").cast("string").alias("part")).agg(F.count("*").alias("observations"))
    pooled = lambda df, c, *of: df.withColumn("part", F.explode(F.when(F.col("part") != "all", F.array("part", F.lit("all"))).otherwise(F.array("part")))).groupBy(*by, "scope", "part", *of).agg(F.sum(c).alias(c))
    counts = pooled(count_motifs(stepped, seq, vocabulary, chunk, by), "n", "motif")
    every = pooled(seen, "observations").join(vocabulary.select(F.col("scope").cast("string").alias("scope"), "motif").distinct(), "scope")
    charts = stepped.select(*seq).distinct()
    every = every.join(charts.groupBy(*by).agg(F.count("*").alias("_charts")), by) if by else every.withColumn("_charts", F.lit(charts.count()))
    out = every.join(counts, [*by, "scope", "part", "motif"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.select(*by, "scope", "part", "motif", "n", "observations", (F.col("n") / F.col("_charts")).alias("average"))


def window_coverage(stepped: DataFrame, seq: list[str], section: str, counts: DataFrame, lengths: list[int]) -> DataFrame:
    """(scope, length, windows, crossing, hits, coverage): spans of each length, those that cross a section, and the share that the list matches.

    All lengths are read off one sorted window; ``counts`` has (scope, part, motif, n).
    """
    order = Window.partitionBy(*seq, "scope", "part").orderBy("i")
    each = [F.struct(F.lit(x).cast("long").alias("length"), F.lead("_here", x - 1).over(order).alias("there")) for x in lengths]
    rows = stepped.withColumn("_here", F.struct(F.col(section).alias("s"))).select(F.col("scope").cast("string").alias("scope"), "_here", F.array(*each).alias("e"))
    spans = rows.select("scope", "_here", F.inline("e")).filter("there IS NOT NULL").groupBy("scope", "length").agg(F.count("*").alias("windows"), F.count_if(~F.col("there.s").eqNullSafe(F.col("_here.s"))).alias("crossing"))
    found = counts.groupBy("scope", motif_length("motif").alias("length")).agg(F.sum("n").alias("hits"))
    return spans.join(found, ["scope", "length"], "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long"))).withColumn("coverage", F.try_divide("hits", "windows"))


def motif_length(motif: str) -> Column:
    return F.expr(f"(size(split({motif}, '/')) + 1) DIV 2").cast("long")


def distance_report(left: DataFrame, right: DataFrame, by: list[str], top: int = 15) -> DataFrame:
    """(by..., section, name, rank, length, f_left, f_right, value): how far two corpora's motif frequencies are apart.

    Each side has (by..., motif, n, observations), the same list on both; a frequency is n over the observations of its
    scope. Sections: summary (vocabulary, mae, rmse, spearman), largest and excess (the motif with the largest absolute
    gap, and with left most above right), bucket (mean gap by length, null for a bucket without motifs), contribution
    (what a bucket adds to the mae), length (number of motifs, and what they add), gap (the ``top`` largest). value is
    left - right for motifs. Ties go by text. A scope without observations on either side is undefined: its summary is
    null but for the size of the list, its buckets are null, and it has no other rows.
    """
    both = left.select(*by, "motif", F.col("n").alias("_a"), F.col("observations").alias("_na")).join(right.select(*by, "motif", F.col("n").alias("_b"), F.col("observations").alias("_nb")), [*by, "motif"], "full")
    rows = both.select(*by, "motif", motif_length("motif").alias("length"), F.try_divide(F.coalesce("_a", F.lit(0)), "_na").alias("f_left"), F.try_divide(F.coalesce("_b", F.lit(0)), "_nb").alias("f_right"))
    rows = cut(rows.withColumn("delta", F.col("f_left") - F.col("f_right")).withColumn("gap", F.round(F.abs("delta"), 12)), "distances")  # every section reads it
    defined = rows.filter("delta IS NOT NULL")
    none = lambda kind: F.lit(None).cast(kind)

    def long(df: DataFrame, section: str, name: Column, value: Column, rank: Column | None = None, length: Column | None = None, pair: bool = False) -> DataFrame:
        f = [F.col(c) if pair else none("double").alias(c) for c in ("f_left", "f_right")]
        return df.select(*by, F.lit(section).alias("section"), name.alias("name"), (none("long") if rank is None else rank.cast("long")).alias("rank"), (none("long") if length is None else length.cast("long")).alias("length"), *f, value.cast("double").alias("value"))

    ranked = average_ranks(defined, by, {"_ra": "f_left", "_rb": "f_right"})
    rank = F.when((F.count("*") > 1) & (F.var_pop("_ra") > 0) & (F.var_pop("_rb") > 0), F.corr("_ra", "_rb"))
    sizes = rows.groupBy(*by).agg(F.count("*").cast("double").alias("vocabulary"))
    totals = ranked.groupBy(*by).agg(F.avg(F.abs("delta")).alias("mae"), F.sqrt(F.avg(F.col("delta") * F.col("delta"))).alias("rmse"), rank.alias("spearman"))
    names = ("vocabulary", "mae", "rmse", "spearman")
    joined = sizes.join(totals, by, "left").select(*by, F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])))
    out = long(joined, "summary", F.col("name"), F.col("value"))
    for section, order, most in (("largest", [F.desc("gap"), F.col("motif")], 1), ("excess", [F.round("delta", 12).desc(), F.col("motif")], 1), ("gap", [F.desc("gap"), F.col("motif")], top)):
        first = defined.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= most)
        out = out.unionByName(long(first, section, F.col("motif"), F.col("delta"), F.col("_rank"), F.col("length"), True))
    by_length = rows.groupBy(*by, "length").agg(F.count("*").alias("n"), F.count("delta").alias("known"), F.sum(F.abs("delta")).alias("sum")).join(sizes, by)
    out = out.unionByName(long(by_length.filter("known > 0"), "length", F.col("length").cast("string"), F.col("sum") / F.col("vocabulary"), F.col("n"), F.col("length")))
    inside = [F.struct(F.lit(n).alias("name"), F.sum(F.when(F.col("length").between(a, b), F.col("sum"))).alias("sum"), F.sum(F.when(F.col("length").between(a, b), F.col("n"))).alias("n")) for n, a, b in BUCKETS]
    buckets = by_length.groupBy(*by).agg(F.max("vocabulary").alias("vocabulary"), F.max("known").alias("known"), F.array(*inside).alias("b")).select(*by, "vocabulary", "known", F.inline("b"))
    out = out.unionByName(long(buckets, "bucket", F.col("name"), F.try_divide("sum", "n")))
    return out.unionByName(long(buckets.filter("known > 0"), "contribution", F.col("name"), F.coalesce("sum", F.lit(0.0)) / F.col("vocabulary")))


def distance_to(made: DataFrame, human: DataFrame, by: list[str], top: int = 15) -> DataFrame:
    """distance_report of each of several corpora to one: ``made`` is a motif_report with ``by``, ``human`` one without.

    The pooled counts are compared; the result has (by..., scope) in front. A scope that ``human`` lacks is undefined.
    """
    left = made.filter("part = 'all'").select(*by, "scope", "motif", "n", "observations")
    right = left.select(*by, "scope", "motif").join(human.filter("part = 'all'").select("scope", "motif", "n", "observations"), ["scope", "motif"])
    return distance_report(left, right, [*by, "scope"], top)


def length_shares(report: DataFrame, by: list[str]) -> DataFrame:
    """(by..., length, motifs, contribution, share): what each length adds to the mae of a distance_report, and its part of it (0 without any gap)."""
    rows = report.filter("section = 'length'").select(*by, "length", F.col("rank").alias("motifs"), F.col("value").alias("contribution"))
    total = F.sum("contribution").over(Window.partitionBy(*by))
    return rows.withColumn("share", F.when(total > 0, F.col("contribution") / total).otherwise(0.0))
