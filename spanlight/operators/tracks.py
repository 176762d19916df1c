"""Greedy tracklet association: inherently in order, so one task per (video, camera, label)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .intervals import range_join

MIN_IOU, BREAK_GAP, CLOSE_GAP = 0.2, 1_000_000, 2_000_000


def iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def associate(detections: DataFrame, close_gap: int = CLOSE_GAP, break_gap: int = BREAK_GAP, min_iou: float = MIN_IOU) -> DataFrame:
    """(video_id, camera_id, detection_id, pts, label, x0, y0, x1, y1). Each detection's tracklet.

    A detection joins the open track of its label with the best overlap, also one of
    its own time; of equal ones the track that ended first, then the older one. A pause above break_gap marks the track
    interrupted, one above close_gap closes it.

    The detections of a video, camera and label pass in time order, and only the
    open tracks are held. A tracklet has the id of its first detection.
    """
    keys = ["video_id", "camera_id", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, open_, n = None, [], 0  # a track: [box, last pts, number, tracklet]
        for batch in batches:
            where, paused = [], []
            for video, camera, label, d, pts, *box in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (video, camera, label) != group:
                    group, open_, n = (video, camera, label), [], 0
                open_ = [t for t in open_ if pts is not None and pts - t[1] <= close_gap]
                fits = [(iou(t[0], box), -t[1], -t[2], t) for t in open_]
                best = max((f for f in fits if f[0] >= min_iou), key=lambda f: f[:3], default=None)
                if best is None:
                    where.append(d)
                    paused.append(False)
                    if pts is not None:
                        open_.append([box, pts, n, d])
                        n += 1
                else:
                    t = best[3]
                    where.append(t[3])
                    paused.append(pts - t[1] > break_gap)
                    t[0], t[1] = box, pts
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(where, pa.int64()), pa.array(paused, pa.bool_())], [*keys, "detection_id", "tracklet", "paused"])

    own = detections.select(*[F.col(k).cast("string") for k in keys], F.col("detection_id").cast("long"), F.col("pts").cast("long"), *[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")])
    ordered = own.repartition(*keys).sortWithinPartitions(*keys, F.col("pts").asc_nulls_last(), "detection_id")
    placed = materialize(ordered.mapInArrow(run, "video_id string, camera_id string, label string, detection_id long, tracklet long, paused boolean"), "tracklets")
    # A track is interrupted as a whole, so a pause marks its earlier detections too.
    broken = placed.where("paused").select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("tracklet").alias("tracklet_"), F.lit(True).alias("broken")).distinct()
    same = F.col("tracklet") == F.col("tracklet_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    continuity = F.when(F.col("broken"), "interrupted").otherwise("continuous").alias("continuity")
    return placed.join(broken, same, "left").select("video_id", "camera_id", "detection_id", "tracklet", continuity)


def continuity(rows: DataFrame, keys: list[str], order: list[str], break_gap: int, close_gap: int) -> DataFrame:
    """Adds gap (time since the row before) and what it means: continuous, interrupted or closed."""
    gap = F.col("pts") - F.lag("pts").over(Window.partitionBy(*keys).orderBy(*order))
    said = F.when(F.col("gap") > close_gap, "closed").when(F.col("gap") > break_gap, "interrupted").otherwise("continuous")
    return rows.withColumn("gap", gap).withColumn("continuity", said)


def evidence_frames(spans: DataFrame, frames: DataFrame, unit: int, width: int, least: int = 8, most: int = 24) -> DataFrame:
    """spans: span_id, video_id, camera_id, t0, t1. For each span its evidence frames (pts, frame_id), in time order with ordinals.

    As many as the span is long in units, least to most of them and no more than it
    has frames. Targets are the middles of equal parts; each takes the nearest frame
    that no earlier target took, the earlier frame on a tie. A target looks no
    further than `most` frames on either side, as fewer were taken before it: so a
    span's task holds most * 2 * most frames at the most.
    """
    inside = range_join(frames, spans.select("span_id", "video_id", "camera_id", "t0", "t1"), ["video_id", "camera_id"], "pts", "t0", "t1", width)
    counted = inside.groupBy("span_id", "t0", "t1").agg(F.count("*").alias("frames"))
    n = F.least(F.lit(most), F.greatest(F.lit(least), F.ceil((F.col("t1") - F.col("t0")) / unit)), F.col("frames"))
    targets = counted.select("span_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).alias("part"), "t0", "t1")
    targets = targets.withColumn("target", F.col("t0") + (F.col("t1") - F.col("t0")) * (F.col("part") + 0.5) / F.col("n"))
    # Frames are numbered within a span once; a target's place among them is how many lie before it.
    own = Window.partitionBy("span_id").orderBy("at", "kind", "frame_id")
    marks = targets.select("span_id", F.col("target").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("frame_id"), "part")
    both = inside.select("span_id", F.col("pts").cast("double").alias("at"), F.lit(0).alias("kind"), F.col("frame_id").cast("long").alias("frame_id"), F.lit(None).cast("long").alias("part")).unionByName(marks)
    placed = both.withColumn("place", F.count_if(F.col("kind") == 0).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    wanted = placed.where("kind = 1").select("span_id", F.explode(F.sequence(F.col("place") - most + 1, F.col("place") + most)).alias("place")).distinct()
    near = placed.where("kind = 0").join(wanted, ["span_id", "place"]).select("span_id", "at", "frame_id", F.lit(None).cast("double").alias("target"), F.lit(None).cast("long").alias("part"))
    rows = near.unionByName(targets.select("span_id", F.lit(None).cast("double").alias("at"), F.lit(None).cast("long").alias("frame_id"), "target", "part"))

    def choose(pdf):
        import pandas as pd

        pool = sorted(zip(pdf["at"][pdf["at"].notna()], pdf["frame_id"][pdf["at"].notna()], strict=True))
        taken = []
        for target in pdf.sort_values("part")["target"].dropna():
            best = min(range(len(pool)), key=lambda i: (abs(pool[i][0] - target), i))
            taken.append(pool.pop(best))
        taken.sort()
        return pd.DataFrame({"span_id": pdf["span_id"].iloc[0], "ordinal": range(1, len(taken) + 1), "frame_id": [int(f) for _, f in taken], "pts": [int(p) for p, _ in taken]})

    return rows.groupBy("span_id").applyInPandas(choose, "span_id string, ordinal int, frame_id long, pts long")
