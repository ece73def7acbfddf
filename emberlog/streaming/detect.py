"""Detection on streams: counts of each source's windows, final once the watermark has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P


def window_counts(logs: DataFrame, minutes: int = 5, late_minutes: int = 10) -> DataFrame:
    """Events and denials of each source in the windows of both clock grids.

    The same plan serves batch and stream; on a stream a window is emitted (append mode)
    when the newest log is ``late_minutes`` past its end, and later logs for it are
    dropped.  Sliding by half a window gives exactly the two grids.
    """
    timed = logs.withColumn("_t", F.col("generated_time").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_t", f"{late_minutes} minutes")
    w, seconds = P.weight("repeat_count"), minutes * 60
    by = timed.filter("src_ip is not null and src_ip <> ''").groupBy(F.window("_t", f"{seconds} seconds", f"{seconds // 2} seconds"), "source_id", "src_ip")
    return by.agg(F.sum(w).alias("events"), F.sum(F.when(P.denied("action"), w).otherwise(0)).alias("denials")).select(F.col("window.start").alias("window_start"), "source_id", "src_ip", "events", "denials")


def bursts(counts: DataFrame, repeated: int = 25, denials: int = 5) -> DataFrame:
    """Windows of sources that were busy or denied often."""
    return counts.filter((F.col("events") >= repeated) | (F.col("denials") >= denials))
