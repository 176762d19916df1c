"""Exact scores and window aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import dot, finite
from .intervals import range_join
from .ledger import HOUR

AGGREGATES = ("max", "mean", "top20_mean", "persistence")


def exact_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(vec_id, embedding) against one query vector: every row gets exactly one score; one that isn't finite is an error."""
    return vectors.select("vec_id", finite(dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))).alias("score"))


def ticks_in_windows(ticks: DataFrame, windows: DataFrame) -> DataFrame:
    return range_join(ticks, windows, ["video_id", "camera_id"], "pts", "t0", "t1", 4 * HOUR)


def window_scores(hits: DataFrame, keys: list[str], how: str, frame_threshold: float = 0.3) -> DataFrame:
    """One score a window (and channel): the greatest, the mean, the mean of the best fifth, or how many ticks reach a threshold.

    The mean's sum is rounded to 9 places, so that the order of addition doesn't show.
    """
    if how == "top20_mean":
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "tick_id")
        ranked = hits.withColumn("rn", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
        best = F.col("rn") <= F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(0.2)))
        return ranked.where(best).groupBy(*keys).agg(F.avg("score").alias("score"))
    value = {"max": F.max("score"), "mean": F.round(F.sum("score"), 9) / F.count("*"), "persistence": F.count_if(F.col("score") >= frame_threshold).cast("double")}[how]
    return hits.groupBy(*keys).agg(value.alias("score"))


def best_evidence(hits: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "pts", "tick_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def in_zones(windows: DataFrame, zones: list[str]) -> DataFrame:
    """Windows that share a zone with the ones asked for; windows without a `zones` column can't be asked for any."""
    if "zones" not in windows.columns:
        raise ValueError("these windows have no zones")
    return windows.where(F.arrays_overlap("zones", F.array(*[F.lit(z) for z in zones])))
