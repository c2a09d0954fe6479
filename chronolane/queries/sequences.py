"""Tokens, motifs, row patterns, decision traces and window plans over events, embeddings and documents.

A user is a chart, an hour a tick, a day a bar; signups start holds, purchases end them, other events are taps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolane.operators import hold_patterns, logits, motif, patterns, stats, tokens
from chronolane.plans import windows
from chronolane.session import cut

from .base import EVENTS, bootstrap_sql, events, rounded, table

HOUR, PER_DAY = 3_600_000, 24


def _placed(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "end").otherwise("tap")
    tick = F.floor(F.col("ms") / HOUR)
    return events(spark, sf_dir).withColumn("kind", kind).withColumn("tick", tick).withColumn("bar", F.floor(F.col("tick") / PER_DAY)).withColumn("pos", F.pmod("tick", F.lit(PER_DAY)))


def _rows(spark, sf_dir) -> DataFrame:
    return tokens.event_rows(_placed(spark, sf_dir), "user_id", "tick", "lane", "kind")


def event_rows(spark, sf_dir):
    return _rows(spark, sf_dir)


def active_state(spark, sf_dir):
    rows = _placed(spark, sf_dir)
    marks = rows.select("user_id", (F.col("bar") * PER_DAY).alias("tick"))
    return tokens.active_at(rows, marks, "user_id", "tick", "lane", "kind")


def pair_intervals(spark, sf_dir):
    return tokens.pair_holds(_placed(spark, sf_dir), ["user_id", "lane"], "ms", "kind", "event_id")


def _sequences(spark, sf_dir) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("bar", F.floor(F.col("tick") / PER_DAY)).withColumn("pos", F.pmod("tick", F.lit(PER_DAY)))
    return tokens.encode_tokens(rows, "user_id", "bar", "pos", "row")


def encode_tokens(spark, sf_dir):
    return _sequences(spark, sf_dir).select("user_id", F.array_join("tokens", " ").alias("tokens"))


def decode_tokens(spark, sf_dir):
    return tokens.decode_tokens(_sequences(spark, sf_dir), "user_id", "tokens")


def cursor_times(spark, sf_dir):
    return rounded(tokens.cursor_times(_sequences(spark, sf_dir), "user_id", "tokens"))


def illegal_transitions(spark, sf_dir):
    return rounded(tokens.first_illegal(_sequences(spark, sf_dir), "user_id", "tokens"))


def pad_sequences(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    padded = tokens.pad_sequences(turns.withColumn("batch", F.pmod("conv_id", F.lit(7))), "batch", "roles")
    return padded.select("conv_id", "batch", F.array_join("padded", ",").alias("padded"), F.size(F.filter("mask", lambda m: m)).cast("long").alias("kept"))


def plausibility(spark, sf_dir):
    notes = events(spark, sf_dir).select("user_id", "lane", F.floor(F.col("ms") / 60000).alias("t"), F.when(F.col("value") > 50, F.floor(F.col("ms") / 60000) + F.col("value").cast("long") - 60).alias("end"))
    flagged = tokens.plausibility(notes.distinct(), ["user_id", "lane"], "t", "end")
    return flagged.groupBy("user_id").agg(*[F.count_if(F.col(c)).alias(c) for c in ("concurrent", "almost", "duplicate_start", "nonpositive_hold")])


def adjacent_warnings(spark, sf_dir):
    notes = events(spark, sf_dir).select("user_id", "lane", F.floor(F.col("ms") / 60000).alias("t"), F.lit(None).cast("long").alias("end")).distinct()
    return tokens.adjacent_warnings(tokens.plausibility(notes, ["user_id", "lane"], "t", "end"), ["user_id", "lane"], "t")


def _steps(spark, sf_dir) -> DataFrame:
    return motif.steps(_placed(spark, sf_dir), ["user_id"], ["ms", "event_id"], "event_type", "bar")


def motif_counts(spark, sf_dir):
    return motif.motif_keys(_steps(spark, sf_dir), ["user_id"], 3).groupBy("motif").agg(F.count("*").alias("n"))


def motif_topk(spark, sf_dir):
    stepped = _steps(spark, sf_dir).withColumn("scope", F.lit("user"))
    return rounded(motif.motif_topk(stepped, ["scope", "user_id"], ["scope"], 25))


def motif_scopes(spark, sf_dir):
    stepped = motif.scope_steps(_placed(spark, sf_dir), ["user_id"], ["ms", "event_id"], "lane", "event_type", "bar")
    return motif.motif_keys(stepped, ["user_id", "scope", "part"], 2).groupBy("scope", "motif").agg(F.count("*").alias("n"))


def motif_distance(spark, sf_dir):
    keys = motif.motif_keys(_steps(spark, sf_dir), ["user_id"], 2)
    sides = [keys.filter(F.pmod("user_id", F.lit(2)) == k).groupBy("motif").agg(F.count("*").alias("n")) for k in (0, 1)]
    return rounded(motif.frequency_distance(*sides, "motif", "n"))


def vocabulary_counts(spark, sf_dir):
    stepped = _steps(spark, sf_dir)
    vocabulary = motif.motif_keys(stepped, ["user_id"], 2).groupBy("motif").count().orderBy(F.desc("count"), "motif").limit(20).select("motif")
    return motif.vocabulary_counts(stepped, ["user_id"], vocabulary, [2])


def length_profile(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return rounded(motif.length_profile(turns, ["conv_id"], [], 6))


def window_audit(spark, sf_dir):
    stepped = motif.steps(_placed(spark, sf_dir), ["user_id"], ["ms", "event_id"], "event_type", "bar").join(motif.steps(_placed(spark, sf_dir), ["user_id"], ["ms", "event_id"], "bar").select("user_id", "i", F.floor(F.col("symbol") / 7).alias("week")), ["user_id", "i"])
    return rounded(motif.window_audit(stepped, ["user_id"], "week", [2, 3, 5]))


def marginals(spark, sf_dir):
    rows = _placed(spark, sf_dir)
    out = rows.groupingSets([["lane", "kind", "pos"], ["kind", "pos"], ["lane", "pos"], ["pos"]], "lane", "kind", "pos").agg(F.count("*").alias("n"))
    charts, total = rows.select("user_id").distinct().count(), rows.count()
    return rounded(out.select(F.coalesce(F.col("lane").cast("string"), F.lit("all")).alias("lane"), F.coalesce("kind", F.lit("all")).alias("kind"), "pos", "n", (F.col("n") / charts).alias("avg_count"), (F.col("n") / total).alias("pooled")))


def _primitives(spark, sf_dir) -> DataFrame:
    return patterns.row_primitives(_rows(spark, sf_dir), "user_id", "tick", "row")


def row_primitives(spark, sf_dir):
    rows = _primitives(spark, sf_dir)
    return rounded(rows.drop(*[c for c in rows.columns if c.endswith("_lanes")]).withColumn("raw", F.array_join("raw", "")))


def core_patterns(spark, sf_dir):
    return rounded(patterns.core_patterns(_primitives(spark, sf_dir), "user_id", "tick"))


def specific_patterns(spark, sf_dir):
    return rounded(patterns.specific_patterns(_primitives(spark, sf_dir), "user_id", "tick"))


def endpoint_distribution(spark, sf_dir):
    rows = _placed(spark, sf_dir)
    parts = {"position": F.col("pos"), "lane_kind": F.concat_ws(":", "lane", "kind"), "hold": F.when(F.col("kind") != "tap", F.col("event_type"))}
    return stats.merge_distributions(stats.distribution(rows, "user_id", parts))


def shift_response(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_linenumber") - 1).alias("shift"), "l_discount")
    return rounded(stats.shift_response(rows, "l_suppkey", "shift", "l_discount"))


def row_marginals(spark, sf_dir):
    facts = spark.range(64).select(F.col("id").alias("code"), F.bit_count("id").alias("heads"))
    return rounded(logits.row_marginals(_traces(spark, sf_dir), "vec_id", "x", "allowed", facts, "code", "heads"))


def trace_summary(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", F.col("event_id").alias("step"), F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 2).otherwise(0).alias("skipped"), (F.col("lane") == 3).cast("int").alias("extra"), F.col("value").alias("rank"))
    return rounded(logits.trace_summary(rows, ["user_id"], "skipped", "extra", "rank"))


def _wide(spark, sf_dir) -> DataFrame:
    """Rows of seven lanes, a day's hours apart."""
    rows = _placed(spark, sf_dir).withColumn("lane", F.pmod("event_id", F.lit(7)))
    return patterns.row_primitives(tokens.event_rows(rows.withColumn("tick", F.floor(F.col("ms") / (6 * HOUR))), "user_id", "tick", "lane", "kind", 7), "user_id", "tick", "row", 7)


def wide_patterns(spark, sf_dir):
    seven = patterns.specific_patterns(_wide(spark, sf_dir), "user_id", "tick", patterns.SEVEN).withColumn("lanes", F.lit("seven"))
    other = patterns.specific_patterns(_wide(spark, sf_dir), "user_id", "tick", patterns.OTHER).withColumn("lanes", F.lit("other"))
    return rounded(seven.unionByName(other))


def held_patterns(spark, sf_dir):
    return rounded(hold_patterns.held_patterns(_primitives(spark, sf_dir), "user_id", "tick", F.lit(40.0)))


def wide_held_patterns(spark, sf_dir):
    return rounded(hold_patterns.held_patterns(_wide(spark, sf_dir), "user_id", "tick", F.lit(12.0), 7))


def _found(spark, sf_dir) -> DataFrame:
    rows = cut(_primitives(spark, sf_dir), "primitives")  # cores, both kinds of sub-patterns and their spans read them
    names = patterns.specific_patterns(rows, "user_id", "tick").unionByName(hold_patterns.held_patterns(rows, "user_id", "tick", F.lit(40.0)))
    return patterns.found_patterns(rows, "user_id", "tick", specific=names)


def found_patterns(spark, sf_dir):
    return rounded(_found(spark, sf_dir))


def _summary(spark, sf_dir) -> DataFrame:
    modes = patterns.hold_ratios(_rows(spark, sf_dir), "user_id", "row").select("user_id", "mode")
    return patterns.cluster_summary(patterns.tempo_clusters(_found(spark, sf_dir), "user_id"), "user_id", modes)


def pattern_clusters(spark, sf_dir):
    return rounded(_summary(spark, sf_dir).withColumn("names", F.array_join(F.transform("names", lambda x: F.format_string("%s:%.3f", x["name"], x["share"])), ",")), 4)


def pattern_distribution(spark, sf_dir):
    return rounded(patterns.core_distribution(_summary(spark, sf_dir), "user_id", table(spark, sf_dir, "events")), 4)


def pattern_category(spark, sf_dir):
    return patterns.categorise(_summary(spark, sf_dir), "user_id", charts=table(spark, sf_dir, "events"))


def pattern_card(spark, sf_dir):
    spans = _rows(spark, sf_dir).groupBy("user_id").agg((F.max("tick") - F.min("tick")).alias("duration"))
    return rounded(patterns.cluster_card(_summary(spark, sf_dir), "user_id", spans, "duration"), 3)


def clean_steps(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", F.floor(F.col("ms") / HOUR).alias("t"), F.round(F.col("value") / 4000, 3).alias("v"), "event_id")
    return rounded(patterns.clean_steps(rows, "user_id", "t", "v", "event_id"))


def hold_ratios(spark, sf_dir):
    return rounded(patterns.hold_ratios(_rows(spark, sf_dir), "user_id", "row"))


def _traces(spark, sf_dir) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"), F.col("label").cast("long").alias("gold"), F.filter(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.pmod(F.col("vec_id") + i, F.lit(3)) > 0).alias("allowed"))


def nll_by_type(spark, sf_dir):
    return rounded(logits.nll_stats(_traces(spark, sf_dir), "x", "gold", ["gold"]))


def legal_mass(spark, sf_dir):
    return rounded(_traces(spark, sf_dir).select("vec_id", logits.legal(F.col("x"), F.col("allowed")).alias("l")).select("vec_id", "l.*"))


def decision_stats(spark, sf_dir):
    d = logits.decision(F.col("x"), F.col("allowed"), F.col("gold"), 0.8)
    return rounded(_traces(spark, sf_dir).select("vec_id", d.alias("d")).select("vec_id", "d.*"))


def history_pairs(spark, sf_dir):
    """Even and odd vectors are two traces over the same states."""
    a = _traces(spark, sf_dir).select(F.floor(F.col("vec_id") / 2).alias("state"), F.col("vec_id").alias("id"), F.lit(1).alias("gold"), F.lit(0).alias("allowed"))
    sides = [a.filter(F.pmod("id", F.lit(2)) == k) for k in (0, 1)]
    return logits.history_pairs(*sides, ["state"], "gold", "allowed").select("state", "a_id", "b_id")


def split_accuracy(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    guess = F.lag("row").over(Window.partitionBy("user_id").orderBy("tick"))
    return rounded(logits.split_accuracy(rows.withColumn("guess", guess).filter("guess IS NOT NULL"), "row", "guess", ["user_id"]))


def _spans(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(9)).alias("low"), (F.pmod("doc_id", F.lit(9)) + F.floor(F.col("n_chars") / 100)).alias("high"))


def bar_windows(spark, sf_dir):
    return windows.bar_windows(_spans(spark, sf_dir), "doc_id", "low", "high")


def overlap_windows(spark, sf_dir):
    return rounded(windows.overlap_windows(_spans(spark, sf_dir), "doc_id", "low", "high"))


def window_samples(spark, sf_dir):
    return rounded(windows.window_samples(_spans(spark, sf_dir), "doc_id", "low", "high", 3, 5))


def _event_windows(spark, sf_dir) -> DataFrame:
    spans = _placed(spark, sf_dir).groupBy("user_id").agg(F.min("bar").alias("low"), (F.max("bar") + 1).alias("high"))
    return windows.overlap_windows(spans, "user_id", "low", "high")


def window_tokens(spark, sf_dir):
    return windows.window_tokens(_rows(spark, sf_dir).withColumn("bar", F.floor(F.col("tick") / PER_DAY)), _event_windows(spark, sf_dir).select("user_id", "start", "end"), "user_id", "bar")


def stitch_windows(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("bar", F.floor(F.col("tick") / PER_DAY))
    made = rows.join(_event_windows(spark, sf_dir).select("user_id", "n", "start", "end"), "user_id").filter("bar >= start AND bar < end").select("user_id", "n", "bar", "tick", "row")
    return windows.stitch_windows(made, _event_windows(spark, sf_dir), "user_id", "n", "bar").select("user_id", "tick", "row")


def missing_bars(spark, sf_dir):
    spans = _placed(spark, sf_dir).groupBy("user_id").agg(F.min("bar").alias("low"), (F.max("bar") + 1).alias("high"))
    return windows.missing_bars(_event_windows(spark, sf_dir).filter("n <> 1"), spans, "user_id", "low", "high")


def tail_events(spark, sf_dir):
    rows = _placed(spark, sf_dir)
    ends = rows.filter("event_type = 'signup'").groupBy("user_id").agg(F.max("bar").alias("end"))
    return windows.tail_events(rows.select("user_id", "bar"), ends, "user_id", "bar", "end")


def length_windows(spark, sf_dir):
    return windows.length_windows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars")


def pack_batches(spark, sf_dir):
    return windows.pack_batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 16384, 0, 1)


def length_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("n_chars", F.length("source").cast("long").alias("width"), "lang")
    return rounded(windows.length_summary(rows, ["n_chars", "width"], F.col("lang") == "de"))


_P = f"p AS (SELECT *, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' ELSE 'tap' END AS kind, ms // 3600000 AS tick, ms // 86400000 AS bar, ms // 3600000 % 24 AS pos FROM {EVENTS})"
_CODE = "CASE kind WHEN 'tap' THEN 1 WHEN 'start' THEN 2 ELSE 4 END"
_R = (
    _P
    + ", r0 AS (SELECT user_id, tick, "
    + ", ".join(f"max({_CODE}) FILTER (WHERE lane = {i}) AS c{i}, count(*) FILTER (WHERE lane = {i}) AS n{i}" for i in range(4))
    + " FROM p GROUP BY ALL), r1 AS (SELECT *, "
    + ", ".join(f"coalesce(sum(CASE c{i} WHEN 2 THEN 1 WHEN 4 THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS o{i}" for i in range(4))
    + " FROM r0), r AS (SELECT user_id, tick, tick // 24 AS bar, tick % 24 AS pos, "
    + " || ".join(f"CAST(coalesce(c{i}, CASE WHEN o{i} THEN 3 ELSE 0 END) AS VARCHAR)" for i in range(4))
    + " AS row, "
    + " OR ".join(f"n{i} > 1" for i in range(4))
    + " AS conflict, "
    + " OR ".join(f"coalesce(CASE WHEN o{i} THEN c{i} IN (1, 2) ELSE c{i} = 4 END, false)" for i in range(4))
    + " AS illegal FROM r1)"
)
_TOK = (
    _R
    + """, sp AS (SELECT user_id, min(bar) AS a, max(bar) AS b FROM r GROUP BY ALL),
ev AS (SELECT user_id, unnest(range(a, b + 1)) AS bar, -1 AS pos, 0 AS k, 'BAR' AS tok FROM sp UNION ALL SELECT user_id, bar, pos, 0, 'POS_' || pos FROM r UNION ALL SELECT user_id, bar, pos, 1, 'ROW_' || row FROM r),
tk AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY bar, pos, k) - 1 AS i, tok, bar - min(bar) OVER (PARTITION BY user_id) AS bar, CASE WHEN pos >= 0 THEN pos END AS pos FROM ev)"""
)
_ST = _P + ", s AS (SELECT user_id, event_type AS symbol, ms, event_id, row_number() OVER w - 1 AS i, lead(bar) OVER w - bar AS gap FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id))"


def _grams(n: int, seq: str = "user_id", src: str = "s", extra: str = "") -> str:
    parts = "symbol" + "".join(f" || '/' || {'gap' if k == 1 else f'lead(gap, {k - 1}) OVER w'} || '/' || lead(symbol, {k}) OVER w" for k in range(1, n))
    return f"SELECT * FROM (SELECT {seq}, {extra}{parts} AS motif, {'lead(symbol, ' + str(n - 1) + ') OVER w' if n > 1 else 'symbol'} AS last FROM {src} WINDOW w AS (PARTITION BY {seq} ORDER BY i)) WHERE last IS NOT NULL"


_PRIM = (
    _R
    + """, q0 AS (SELECT user_id, tick, row, list_filter([0, 1, 2, 3], lambda k: row[k + 1] IN ('1', '2')) AS raw, len(regexp_replace(row, '[^2]', '', 'g')) AS heads, len(regexp_replace(row, '[^3]', '', 'g')) AS bodies, len(regexp_replace(row, '[^4]', '', 'g')) AS tails FROM r),
q1 AS (SELECT * FROM q0 WHERE len(raw) > 0 OR bodies > 0 OR tails > 0),
q2 AS (SELECT *, row_number() OVER w AS rn, (tick - lag(tick) OVER w) * 4.0 AS delta, last_value(CASE WHEN len(raw) > 0 THEN raw END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM q1 WINDOW w AS (PARTITION BY user_id ORDER BY tick)),
q3 AS (SELECT *, len(raw) > 0 AND prev IS NOT NULL AS has, list_min(raw) - list_min(prev) AS l, list_max(raw) - list_max(prev) AS g FROM q2 WHERE rn > 1),
q AS (SELECT user_id, tick, delta::DOUBLE AS delta, CAST(len(raw) AS BIGINT) AS notes, CAST(CASE WHEN has THEN len(list_intersect(raw, prev)) ELSE 0 END AS BIGINT) AS jacks,
  CASE WHEN NOT has THEN 'none' WHEN l > 0 AND g > 0 THEN 'right' WHEN l > 0 THEN 'inwards' WHEN l < 0 AND g < 0 THEN 'left' WHEN l < 0 THEN 'outwards' WHEN g < 0 THEN 'inwards' WHEN g > 0 THEN 'outwards' ELSE 'none' END AS direction,
  coalesce(has AND (list_min(prev) > list_max(raw) OR list_max(prev) < list_min(raw)), false) AS roll, raw, CAST(heads AS BIGINT) AS heads, CAST(bodies AS BIGINT) AS bodies, CAST(tails AS BIGINT) AS tails FROM q3)"""
)
_X = "x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, label::BIGINT AS gold, list_filter(range(64), lambda i: (vec_id + i) % 3 > 0) AS allowed FROM embeddings), u AS (SELECT vec_id, gold, allowed, unnest(range(64)) AS i, unnest(x) AS v FROM x)"
_SPAN = "sp AS (SELECT doc_id, doc_id % 9 AS low, doc_id % 9 + n_chars // 100 AS high FROM documents)"


def _windows(spans: str, key: str) -> str:
    return f"""wn AS (SELECT {key}, low, high, unnest(range(0, CASE WHEN high - low <= 16 THEN 1 ELSE (high - low - 16) // 4 + 3 END)) AS n FROM {spans} WHERE high > low),
wk AS (SELECT *, CASE WHEN n = 0 THEN low ELSE low + 8 + (n - 1) * 4 END AS keep_start, CASE WHEN n = 0 THEN low ELSE low + (n - 1) * 4 END AS ideal FROM wn),
w AS (SELECT {key}, n, CASE WHEN n > 0 AND ideal + 16 > high THEN high - 16 ELSE ideal END AS start, keep_start, CASE WHEN high - low <= 16 THEN high WHEN n = 0 THEN low + 8 WHEN ideal + 16 > high THEN high ELSE keep_start + 4 END AS keep_end FROM wk)"""


_ESP = "es AS (SELECT user_id, min(bar) AS low, max(bar) + 1 AS high FROM p GROUP BY ALL)"
_NOTE = f"n AS (SELECT DISTINCT user_id, lane, ms // 60000 AS t, CASE WHEN value > 50 THEN ms // 60000 + CAST(trunc(value) AS BIGINT) - 60 END AS fin FROM {EVENTS}), g AS (SELECT *, lead(t) OVER w AS nxt FROM n WINDOW w AS (PARTITION BY user_id, lane ORDER BY t, fin NULLS FIRST))"
SQL = {
    "event_rows": f"WITH {_R} SELECT user_id, tick, row, conflict, illegal FROM r",
    "active_state": f"WITH {_P}, m AS (SELECT DISTINCT user_id, bar * 24 AS tick FROM p), j AS (SELECT m.user_id, m.tick, lane, sum(CASE kind WHEN 'start' THEN 1 WHEN 'end' THEN -1 ELSE 0 END) AS x FROM m LEFT JOIN p ON p.user_id = m.user_id AND p.tick < m.tick GROUP BY ALL) SELECT user_id, tick, " + " || ".join(f"CASE WHEN coalesce(max(x) FILTER (WHERE lane = {i}), 0) > 0 THEN '3' ELSE '0' END" for i in range(4)) + " AS row FROM j GROUP BY ALL",
    "pair_intervals": f"WITH {_P}, h AS (SELECT user_id, lane, ms, kind, lead(kind) OVER w AS nk, lead(ms) OVER w AS nm, lag(kind) OVER w AS pk FROM p WHERE kind <> 'tap' WINDOW w AS (PARTITION BY user_id, lane ORDER BY ms, event_id)) SELECT user_id, lane, CASE WHEN kind = 'start' THEN ms END AS start, CASE WHEN kind = 'start' AND nk = 'end' THEN nm ELSE ms END AS \"end\", CASE WHEN kind = 'end' THEN 'orphan' WHEN nk = 'end' THEN 'paired' ELSE 'unclosed' END AS state FROM h WHERE kind = 'start' OR pk IS DISTINCT FROM 'start'",
    "encode_tokens": f"WITH {_TOK} SELECT user_id, string_agg(tok, ' ' ORDER BY i) AS tokens FROM tk GROUP BY ALL",
    "decode_tokens": f"WITH {_TOK} SELECT user_id, CAST(bar AS BIGINT) AS bar, pos, tok[5:] AS row FROM tk WHERE tok LIKE 'ROW%'",
    "cursor_times": f"WITH {_TOK} SELECT user_id, i, lag(bar) OVER w AS bar, lag(pos) OVER w AS pos FROM tk WINDOW w AS (PARTITION BY user_id ORDER BY i)",
    "illegal_transitions": f"""WITH {_TOK}, d AS (SELECT user_id, i, unnest([0, 1, 2, 3]) AS k, unnest([tok[5], tok[6], tok[7], tok[8]]) AS g FROM tk WHERE tok LIKE 'ROW%'),
h AS (SELECT *, coalesce(sum(CASE g WHEN '2' THEN 1 WHEN '4' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS held FROM d)
SELECT user_id, min(i) AS i, 'lane state' AS reason FROM h WHERE held <> (g IN ('3', '4')) GROUP BY ALL""",
    "pad_sequences": "WITH r AS (SELECT conv_id, conv_id % 7 AS batch, list(role ORDER BY turn) AS roles FROM conversations GROUP BY ALL) SELECT conv_id, batch, array_to_string(list_concat(roles, list_transform(range(max(len(roles)) OVER (PARTITION BY batch) - len(roles)), lambda i: '<PAD>')), ',') AS padded, CAST(len(roles) AS BIGINT) AS kept FROM r",
    "plausibility": f"WITH {_NOTE} SELECT user_id, count(*) FILTER (WHERE nxt - coalesce(fin, t) <= 2) AS concurrent, count(*) FILTER (WHERE abs(nxt - coalesce(fin, t)) < 10) AS almost, count(*) FILTER (WHERE nxt = t) AS duplicate_start, count(*) FILTER (WHERE fin <= t) AS nonpositive_hold FROM g GROUP BY ALL",
    "adjacent_warnings": f"WITH n AS (SELECT DISTINCT user_id, lane, ms // 60000 AS t FROM {EVENTS}), g AS (SELECT *, lead(t) OVER (PARTITION BY user_id, lane ORDER BY t) - t AS gap FROM n) SELECT user_id, lane, t, 'gap ' || gap AS warning FROM g WHERE gap < 10",
    "motif_counts": f"WITH {_ST}, g AS ({_grams(3)}) SELECT motif, count(*) AS n FROM g GROUP BY ALL",
    "motif_topk": f"WITH {_ST}, " + ", ".join(f"g{n} AS ({_grams(n)})" for n in (1, 2, 3, 4)) + ", a AS (" + " UNION ALL ".join(f"SELECT motif, {n}::BIGINT AS length, count(*) AS n FROM g{n} GROUP BY ALL" for n in (1, 2, 3, 4)) + ") SELECT 'user' AS scope, motif, n, length FROM a ORDER BY n DESC, motif LIMIT 25",
    "motif_scopes": f"""WITH {_P}, e AS (SELECT user_id, 'lane' AS scope, CAST(lane AS VARCHAR) AS part, event_type AS symbol, bar, ms, event_id FROM p UNION ALL SELECT user_id, 'hand', CASE WHEN lane < 2 THEN 'left' ELSE 'right' END, event_type || CASE WHEN lane < 2 THEN lane ELSE 3 - lane END, bar, ms, event_id FROM p UNION ALL SELECT user_id, 'row', 'all', event_type || lane, bar, ms, event_id FROM p),
s AS (SELECT user_id, scope, part, symbol, row_number() OVER w AS i, lead(bar) OVER w - bar AS gap FROM e WINDOW w AS (PARTITION BY user_id, scope, part ORDER BY ms, event_id)), g AS ({_grams(2, "user_id, scope, part")}) SELECT scope, motif, count(*) AS n FROM g GROUP BY ALL""",
    "motif_distance": f"""WITH {_ST}, g AS ({_grams(2)}), c AS (SELECT motif, count(*) FILTER (WHERE user_id % 2 = 0) AS a, count(*) FILTER (WHERE user_id % 2 = 1) AS b FROM g GROUP BY ALL),
f AS (SELECT motif, a / sum(a) OVER () AS x, b / sum(b) OVER () AS y FROM c), k AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM f)
SELECT count(*) AS size, round(avg(abs(y - x)), 6) AS mae, round(sqrt(avg((y - x) * (y - x))), 6) AS rmse, round(corr(rx, ry), 6) AS spearman, first(motif ORDER BY round(abs(y - x), 12) DESC, motif) AS largest_gap FROM k""",
    "vocabulary_counts": f"WITH {_ST}, g AS ({_grams(2)}), v AS (SELECT motif FROM g GROUP BY motif ORDER BY count(*) DESC, motif LIMIT 20) SELECT v.motif, count(g.motif) AS n FROM v LEFT JOIN g ON g.motif = v.motif GROUP BY ALL",
    "length_profile": "WITH c AS (SELECT count(*) AS size FROM conversations GROUP BY conv_id) SELECT l AS length, CAST(sum(greatest(0, size - l + 1)) AS BIGINT) AS spans FROM c, range(1, 7) r(l) GROUP BY ALL",
    "window_audit": f"WITH {_P}, s AS (SELECT user_id, bar // 7 AS week, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM p)" + " UNION ALL ".join(f" SELECT {n}::BIGINT AS length, count(*) AS spans, count(*) FILTER (WHERE l <> week) AS crossing FROM (SELECT week, lead(week, {n - 1}) OVER (PARTITION BY user_id ORDER BY i) AS l FROM s) WHERE l IS NOT NULL" for n in (2, 3, 5)),
    "marginals": f"WITH {_P} SELECT coalesce(CAST(lane AS VARCHAR), 'all') AS lane, coalesce(kind, 'all') AS kind, pos, count(*) AS n, round(count(*) / (SELECT count(DISTINCT user_id) FROM p), 6) AS avg_count, round(count(*) / (SELECT count(*) FROM p), 6) AS pooled FROM p GROUP BY GROUPING SETS ((lane, kind, pos), (kind, pos), (lane, pos), (pos))",
    "row_primitives": f"WITH {_PRIM} SELECT user_id, tick, delta, notes, jacks, direction, roll, array_to_string(raw, '') AS raw, heads, bodies, tails FROM q",
    "core_patterns": f"""WITH {_PRIM}, a AS (SELECT *, lead(raw, 4) OVER w AS r4, """ + ", ".join(f"lead(notes, {k}) OVER w AS n{k}, lead(jacks, {k}) OVER w AS j{k}" for k in (1, 2, 3, 4)) + """ FROM q WINDOW w AS (PARTITION BY user_id ORDER BY tick))
SELECT user_id, tick, 'stream' AS pattern, 5::BIGINT AS length FROM a WHERE notes = 1 AND n1 = 1 AND n2 = 1 AND n3 = 1 AND n4 = 1 AND jacks + j1 + j2 + j3 + j4 = 0 AND raw[1] <> r4[1]
UNION ALL SELECT user_id, tick, 'jacks', 1 FROM a WHERE jacks > 1 AND delta < 2000
UNION ALL SELECT user_id, tick, 'chordstream', 4 FROM a WHERE notes > 1 AND jacks + j1 + j2 + j3 = 0 AND (n1 > 1 OR n2 > 1 OR n3 > 1)
UNION ALL SELECT user_id, tick, 'coordination', 1 FROM a WHERE heads > 0 OR bodies > 0 OR tails > 0
UNION ALL SELECT user_id, tick, unnest(['density', 'wildcard']), 1 FROM a WHERE heads > 0""",
    "specific_patterns": f"""WITH {_PRIM}, a AS (SELECT *, """ + ", ".join(f"lead({c}, {k}) OVER w AS {c}{k}" for c in ("raw", "notes", "jacks", "direction", "roll") for k in (1, 2, 3, 4)) + """ FROM q WINDOW w AS (PARTITION BY user_id ORDER BY tick)), n AS (
SELECT *, [
  CASE WHEN notes = 1 AND notes1 = 1 AND notes2 = 1 AND direction IN ('left', 'right') AND direction = direction1 AND direction = direction2 THEN 'stream|Rolls|3' END,
  CASE WHEN jacks1 + jacks2 + jacks3 = 0 AND raw = raw2 AND raw1 = raw3 THEN 'stream|Trills|4' END,
  CASE WHEN jacks1 + jacks2 = 0 AND raw = raw2 AND raw1 <> raw3 THEN 'stream|Minitrills|4' END,
  CASE WHEN notes = 3 AND jacks + jacks1 + jacks2 + jacks3 = 0 THEN 'chordstream|Handstream|4' END,
  CASE WHEN notes = 2 AND notes1 = 2 AND notes2 = 2 AND jacks1 + jacks2 = 0 AND NOT roll1 AND NOT roll2 THEN 'chordstream|Split Trill|3' END,
  CASE WHEN notes = 2 AND notes1 = 2 AND notes2 = 2 AND notes3 = 2 AND roll1 AND roll2 AND roll3 THEN 'chordstream|Jumptrill|4' END,
  CASE WHEN notes = 2 AND notes1 = 1 AND notes2 < 3 AND notes3 < 3 AND jacks + jacks1 + jacks2 + jacks3 = 0 THEN 'chordstream|Jumpstream|4' END,
  CASE WHEN jacks > 0 AND jacks1 > 0 AND jacks2 > 0 AND jacks3 > 0 AND jacks4 > 0 AND len(list_filter(raw, lambda x: list_contains(raw1, x) AND list_contains(raw2, x) AND list_contains(raw3, x) AND list_contains(raw4, x))) > 0 THEN 'jacks|Longjacks|5' END,
  CASE WHEN notes = 4 AND jacks2 + jacks3 = 0 THEN 'jacks|Quadstream|4' END,
  CASE WHEN jacks1 = 1 AND jacks2 = 1 AND len(list_filter(raw, lambda x: list_contains(raw1, x) AND list_contains(raw2, x))) = 0 THEN 'jacks|Gluts|3' END,
  CASE WHEN notes > 2 AND notes1 > 1 AND jacks1 >= 1 AND (notes1 < notes OR jacks1 < notes1) THEN 'jacks|Chordjacks|2' END,
  CASE WHEN jacks > 0 AND jacks1 = 0 THEN 'jacks|Minijacks|2' END] AS f FROM a), u AS (SELECT user_id, tick, unnest(f) AS x FROM n)
SELECT user_id, tick, split_part(x, '|', 1) AS core, split_part(x, '|', 2) AS name, split_part(x, '|', 3)::BIGINT AS length FROM u WHERE x IS NOT NULL""",
    "endpoint_distribution": f"WITH {_P}, d AS (SELECT user_id, 'position' AS part, CAST(pos AS VARCHAR) AS key FROM p UNION ALL SELECT user_id, 'lane_kind', lane || ':' || kind FROM p UNION ALL SELECT user_id, 'hold', event_type FROM p WHERE kind <> 'tap') SELECT part, key, count(*) AS n, count(DISTINCT user_id) AS charts FROM d GROUP BY ALL",
    "shift_response": "WITH v AS (SELECT l_suppkey, l_linenumber::BIGINT - 1 AS shift, avg(l_discount) AS v FROM lineitem GROUP BY ALL), z AS (SELECT l_suppkey, v AS base FROM v WHERE shift = 0), p AS (SELECT shift, l_suppkey, v, v - base AS d FROM v JOIN z USING (l_suppkey))"
    + bootstrap_sql("p", "shift", "l_suppkey", "d")
    + "SELECT shift, count(v.v) AS count, round(avg(v.v), 6) AS mean, round(quantile_cont(v.v, 0.1), 6) AS p10, round(quantile_cont(v.v, 0.5), 6) AS p50, round(quantile_cont(v.v, 0.9), 6) AS p90, round(min(v.v), 6) AS min, round(max(v.v), 6) AS max, any_value(m.n) AS pairs, round(any_value(m.mean), 6) AS shift_mean, CASE WHEN any_value(m.n) > 1 THEN round(any_value(b.low), 6) END AS shift_low, CASE WHEN any_value(m.n) > 1 THEN round(any_value(b.high), 6) END AS shift_high FROM v LEFT JOIN m USING (shift) LEFT JOIN b USING (shift) GROUP BY shift",
    "row_marginals": f"WITH {_X}, w AS (SELECT vec_id, bit_count(i)::BIGINT AS h, exp(v) AS w FROM u WHERE list_contains(allowed, i)) SELECT vec_id, " + ", ".join(f"round(coalesce(sum(w) FILTER (WHERE h = {k}), 0) / sum(w), 6) AS p_{k}" for k in range(5)) + ", round(sum(w * h) / sum(w), 6) AS expected FROM w GROUP BY ALL",
    "trace_summary": f"WITH r AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END AS s, lane = 3 AS x, value FROM {EVENTS}), b AS (SELECT *, s > 0 OR x AS bad FROM r), n AS (SELECT *, bad AND NOT coalesce(lag(bad) OVER (PARTITION BY user_id ORDER BY event_id), false) AS fresh FROM b) SELECT user_id, count(*) AS steps, count(*) FILTER (WHERE s > 0) AS skipping, count(*) FILTER (WHERE x) AS extra, count(*) FILTER (WHERE fresh) AS blocks, round(quantile_cont(value, 0.5), 6) AS median_rank FROM n GROUP BY ALL",
    "hold_ratios": f"""WITH {_R}, c AS (SELECT user_id, len(regexp_replace(row, '[^1]', '', 'g')) AS t, len(regexp_replace(row, '[^2]', '', 'g')) AS h FROM r),
a AS (SELECT user_id, CASE WHEN sum(t + h) > 0 THEN sum(h) / sum(t + h) ELSE 0 END AS l, avg(CASE WHEN t > 0 AND h > 0 THEN 1.0 ELSE 0 END) AS b FROM c GROUP BY ALL)
SELECT user_id, round(l, 6) AS ln_ratio, round(b, 6) AS hybrid_ratio, CASE WHEN l <= 0.1 THEN 'RC' WHEN l >= 0.9 THEN 'LN' WHEN b >= 0.1 THEN 'HB' ELSE 'Mix' END AS mode FROM a""",
    "nll_by_type": f"WITH {_X}, l AS (SELECT vec_id, gold, max(v) + ln(sum(exp(v - m))) - max(v) FILTER (WHERE i = gold) AS nll, min(i) FILTER (WHERE v = m) AS best FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM u) GROUP BY ALL) SELECT gold, round(sum(nll), 6) AS nll, count(nll) AS n, count(*) FILTER (WHERE best = gold) AS hits FROM l GROUP BY ALL",
    "legal_mass": f"WITH {_X}, m AS (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM u) SELECT vec_id, bool_or(v = m AND list_contains(allowed, i)) AS argmax_legal, round(sum(exp(v - m)) FILTER (WHERE list_contains(allowed, i)) / sum(exp(v - m)), 6) AS mass FROM m GROUP BY ALL",
    "decision_stats": f"""WITH {_X}, g AS (SELECT *, max(v) FILTER (WHERE i = gold) OVER (PARTITION BY vec_id) AS gv, list_contains(allowed, i) AS ok FROM u),
s AS (SELECT vec_id, gv, count(*) FILTER (WHERE v > gv) + 1 AS raw_rank, count(*) FILTER (WHERE v > gv AND ok) + 1 AS legal_rank, sum(exp(v)) FILTER (WHERE ok) AS z, sum(exp(v / 0.8)) FILTER (WHERE ok) AS zt FROM g GROUP BY ALL),
e AS (SELECT g.vec_id, -sum(exp(v) / z * ln(exp(v) / z)) AS entropy FROM g JOIN s USING (vec_id) WHERE ok GROUP BY ALL)
SELECT vec_id, raw_rank, legal_rank, round(exp(gv) / z, 6) AS p, round(exp(gv / 0.8) / zt, 6) AS p_t, round(entropy, 6) AS entropy FROM s JOIN e USING (vec_id)""",
    "history_pairs": "SELECT a.vec_id // 2 AS state, a.vec_id AS a_id, b.vec_id AS b_id FROM embeddings a JOIN embeddings b ON a.vec_id // 2 = b.vec_id // 2 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1",
    "split_accuracy": f"""WITH {_R}, g AS (SELECT user_id, row, lag(row) OVER (PARTITION BY user_id ORDER BY tick) AS guess FROM r), l AS (SELECT user_id, row = guess AS same, unnest([row[1], row[2], row[3], row[4]]) AS a, unnest([guess[1], guess[2], guess[3], guess[4]]) AS b FROM g WHERE guess IS NOT NULL)
SELECT user_id, round(avg(CASE WHEN same THEN 1.0 ELSE 0 END), 6) AS row_accuracy, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0 END), 6) AS lane_accuracy, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) FILTER (WHERE a = '1'), 6) AS tap_recall, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) FILTER (WHERE a = '2'), 6) AS start_recall FROM l GROUP BY ALL""",
    "bar_windows": f"WITH {_SPAN} SELECT doc_id, s AS start, s + 16 AS \"end\" FROM (SELECT doc_id, unnest(range(low, high - 15)) AS s FROM sp WHERE high - low >= 16)",
    "overlap_windows": f"WITH {_SPAN}, {_windows('sp', 'doc_id')} SELECT doc_id, n, start, start + 16 AS \"end\", keep_start, keep_end FROM w",
    "window_samples": f"WITH {_SPAN} SELECT doc_id, i AS sample, low + CAST('0x' || substr(md5('5|' || doc_id || '|' || i), 1, 8) AS BIGINT) % (high - low - 15) AS start FROM sp, range(3) r(i) WHERE high - low >= 16",
    "window_tokens": f"WITH {_R}, {_ESP}, {_windows('es', 'user_id')} SELECT w.user_id, start, 2 * count(r.tick) + 16 + 3 AS tokens FROM (SELECT DISTINCT user_id, start FROM w) w LEFT JOIN r ON r.user_id = w.user_id AND r.bar >= start AND r.bar < start + 16 GROUP BY ALL",
    "stitch_windows": f"WITH {_R} SELECT user_id, tick, row FROM r",
    "missing_bars": f"WITH {_P}, {_ESP}, {_windows('es', 'user_id')} SELECT user_id, unnest(range(keep_start, keep_end)) AS bar FROM w WHERE n = 1",
    "tail_events": f"WITH {_P}, e AS (SELECT user_id, max(bar) AS fin FROM p WHERE kind = 'start' GROUP BY ALL) SELECT user_id, min(bar) AS first_bar, max(bar) AS last_bar, count(*) FILTER (WHERE bar >= fin) AS after FROM p JOIN e USING (user_id) GROUP BY ALL",
    "length_windows": """WITH RECURSIVE d AS (SELECT DISTINCT n_chars AS n FROM documents WHERE n_chars > 0), w(k, f) AS (SELECT 0::BIGINT, min(n) FROM d UNION ALL SELECT k + 1, (SELECT min(n) FROM d WHERE n > f * (1 + 0.1::DOUBLE)) FROM w WHERE EXISTS (SELECT 1 FROM d WHERE n > f * (1 + 0.1::DOUBLE)))
SELECT doc_id, n_chars, (SELECT max(k) FROM w WHERE f <= n_chars) AS \"window\" FROM documents""",
    "length_summary": "SELECT count(*) AS n, count(*) FILTER (WHERE lang = 'de') AS failed, " + ", ".join(f"round(quantile_cont({c}, 0.5) FILTER (WHERE lang <> 'de' AND {c} > 0), 6)::DOUBLE AS {n}_p50, round(quantile_cont({c}, 0.9) FILTER (WHERE lang <> 'de' AND {c} > 0), 6)::DOUBLE AS {n}_p90, max({c}) FILTER (WHERE lang <> 'de' AND {c} > 0) AS {n}_max" for n, c in (("n_chars", "n_chars"), ("width", "length(source)"))) + " FROM documents",
}

QUERIES = {
    f.__name__: f
    for f in (
        event_rows, active_state, pair_intervals, encode_tokens, decode_tokens, cursor_times, illegal_transitions, pad_sequences, plausibility, adjacent_warnings,
        motif_counts, motif_topk, motif_scopes, motif_distance, vocabulary_counts, length_profile, window_audit, marginals, row_primitives, core_patterns,
        specific_patterns, endpoint_distribution, shift_response, row_marginals, trace_summary, wide_patterns, held_patterns, wide_held_patterns, found_patterns, pattern_clusters, pattern_distribution, pattern_category, pattern_card, clean_steps, hold_ratios, nll_by_type, legal_mass, decision_stats, history_pairs, split_accuracy, bar_windows, overlap_windows,
        window_samples, window_tokens, stitch_windows, missing_bars, tail_events, length_windows, pack_batches, length_summary,
    )
}
