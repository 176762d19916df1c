"""Union, reciprocal rank fusion and clustering. Fusion orders; it never removes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import islands, ranked

RRF_K = 60
SCOPE = ["video_id", "camera_id", "t0", "t1"]


def fuse(scored: DataFrame, k: int = RRF_K) -> DataFrame:
    """scored: SCOPE, channel, score (thresholded). One row an interval: channels in order, best score, rrf."""
    score = F.round("score", 9)
    return ranked(scored, ["channel"], [-F.floor(score * 4096)], [F.desc(score), F.col("video_id"), F.col("t0"), F.col("t1")]).groupBy(*SCOPE).agg(
        F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("channels"), F.max("score").alias("best"), F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf")
    )


def cluster(candidates: DataFrame, gap: int, members: bool = False) -> DataFrame:
    """Intervals of one video and camera that overlap or lie at most gap apart become one cluster; with members also their list, in order."""
    marked = islands(candidates, ["video_id", "camera_id"], "t0", "t1", [], gap)
    more = [F.array_sort(F.collect_list(F.struct("t0", "t1"))).alias("member_spans")] if members else []
    return marked.groupBy("video_id", "camera_id", "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count("*").alias("members"), F.max(F.coalesce("rrf", F.lit(0.0))).alias("priority"), *more)


def merge(rows: DataFrame) -> DataFrame:
    """Candidates of one id as one: (candidate_id, SCOPE, seq, channel, score, evidence array).

    Of a channel's scores the one of greatest seq stays; evidence is kept once a
    node. One id with two intervals is an error.
    """
    span = F.struct(*SCOPE)
    per = rows.groupBy("candidate_id", "channel").agg(F.max_by("score", "seq").alias("score"), F.min(span).alias("a"), F.max(span).alias("b"), F.array_distinct(F.flatten(F.collect_list("evidence"))).alias("evidence"))
    one = per.groupBy("candidate_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "score")))).alias("scores"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"), F.min("a").alias("a"), F.max("b").alias("b")
    )
    same = F.when(~F.col("a").eqNullSafe(F.col("b")), F.raise_error(F.concat(F.lit("a candidate with two intervals: "), F.col("candidate_id").cast("string")))).otherwise(F.lit(True))
    return one.where(same).select("candidate_id", "a.*", "scores", "evidence")


def union_merge(scored: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """scored: SCOPE, channel, score. Intervals of all channels merged; a channel stays where it reaches its own threshold."""
    limits = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])
    kept = scored.where(F.round("score", 9) >= limits[F.col("channel")])
    return kept.groupBy(*SCOPE).agg(F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("channels"), F.max("score").alias("best"))
