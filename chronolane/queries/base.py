"""Adapters: the supplied tables as timelines, samples and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some digits, integers to long: what two engines can agree on."""
    out = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ms since the epoch, a lane and the kind's first letter; the chart is the user."""
    rows = table(spark, sf_dir, "events")
    return rows.withColumn("ms", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)).withColumn("lane", F.pmod("event_id", F.lit(4)))


#: The same in SQL.
EVENTS = "(SELECT *, epoch_us(ts) // 1000 AS ms, event_id % 4 AS lane FROM events)"


_W = "CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3 WHEN u < 0.9963401531726563 THEN 4 WHEN u < 0.9994058151824183 THEN 5 WHEN u < 0.9999167588507119 THEN 6 WHEN u < 0.9999897508033253 THEN 7 ELSE 8 END"


def bootstrap_sql(source: str, by: str, key: str, value: str, draws: int = 2000) -> str:
    """Views m (by, n, mean) and b (by, low, high) of the bootstrap over ``source``, for use behind WITH."""

    half = lambda at: f"CAST('0x' || substr(md5('20261106|' || k), {at}, 8) AS UBIGINT)"
    return f"""
, bv AS (SELECT {by}, {key} AS k, {value} AS v FROM {source} WHERE {value} IS NOT NULL)
, b0 AS (SELECT {by}, v, draw, {half(1)} AS high, ({half(9)} + draw::UBIGINT * 2654435769::UBIGINT) % 4294967296 AS x FROM bv, range({draws}) r(draw))
, b1 AS (SELECT * REPLACE ((xor(x, x >> 16) * 2146121005::UBIGINT) % 4294967296 AS x) FROM b0)
, b2 AS (SELECT * REPLACE ((xor(x, x >> 15) * 2221713035::UBIGINT) % 4294967296 AS x) FROM b1)
, b3 AS (SELECT * REPLACE (xor(xor(x, x >> 16), high) AS x) FROM b2)
, b4 AS (SELECT * REPLACE ((xor(x, x >> 16) * 2146121005::UBIGINT) % 4294967296 AS x) FROM b3)
, b5 AS (SELECT * REPLACE ((xor(x, x >> 15) * 2221713035::UBIGINT) % 4294967296 AS x) FROM b4)
, b6 AS (SELECT {by}, v, draw, xor(x, x >> 16) / 4294967296.0 AS u FROM b5)
, bs AS (SELECT {by}, draw, sum(v * {_W}) AS s, sum({_W}) AS w FROM b6 GROUP BY ALL)
, b AS (SELECT {by}, quantile_cont(s / w, 0.025) AS low, quantile_cont(s / w, 0.975) AS high FROM bs WHERE w > 0 GROUP BY ALL)
, m AS (SELECT {by}, count(*) AS n, avg(v) AS mean FROM bv GROUP BY ALL)
"""
