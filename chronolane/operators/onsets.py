"""Onsets on frames: targets with a fraction, times from probabilities, and how well they agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame_targets(onsets: DataFrame, spans: DataFrame, key: str, t: str, low: str, frames: str, frame_ms: float) -> DataFrame:
    """(key, frame, fraction, reject): the frame of each onset, counted from ``low``, and how far into it the onset is.

    reject names what makes a key unusable: an onset outside the frames, or several in one frame.
    """
    at = F.col(t) / frame_ms
    rows = onsets.join(spans.select(key, low, frames), key).withColumn("_a", F.floor(at)).withColumn("frame", F.floor(at) - F.col(low))
    each = rows.groupBy(key, "frame", frames).agg(F.count("*").alias("_n"), F.min(at - F.col("_a")).alias("fraction"))
    reject = F.when((F.col("frame") < 0) | (F.col("frame") >= F.col(frames)), "outside").when(F.col("_n") > 1, "collision")
    return each.select(key, "frame", "fraction", reject.alias("reject"))


def threshold_onsets(frames: DataFrame, key: str, frame: Column, probability: str, fraction: str, threshold: float, frame_ms: float) -> DataFrame:
    """(key, t): times of the frames whose probability reaches the threshold."""
    return frames.filter(F.col(probability) >= threshold).select(key, ((frame + F.col(fraction)) * frame_ms).alias("t"))


def onset_errors(frames: DataFrame, key: str, present: str, silent: str, probability: str, made: str, wanted: str, threshold: float, frame_ms: float) -> DataFrame:
    """(key, silent, onsets, mae_ms, p95_ms, false_per_minute): offset errors where an onset is, and false ones in silence."""
    error = F.when(F.col(present) & ~F.col(silent), F.abs(F.col(made) - F.col(wanted)) * frame_ms)
    found = F.count_if(F.col(probability) >= threshold)
    return frames.groupBy(key, silent).agg(found.alias("onsets"), F.avg(error).alias("mae_ms"), F.percentile(error, 0.95).alias("p95_ms"), F.when(F.col(silent), found / (F.count("*") * frame_ms / 60000.0)).alias("false_per_minute"))
