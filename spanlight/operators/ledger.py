"""Tick ledger: expected ticks, windows, states and coverage. Times are whole microseconds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import islands, range_join

HOUR = 3_600_000_000
#: (scale, stride) of the window grid.
SCALES = ((4 * HOUR, 2 * HOUR), (12 * HOUR, 6 * HOUR), (30 * HOUR, 15 * HOUR))


def expected_ticks(videos: DataFrame, interval: int) -> DataFrame:
    """videos: (video_id, duration). Half-open grid [0, duration) of target_pts."""
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col("duration") - 1) / interval))
    return videos.where("duration > 0").select("video_id", F.explode(steps).alias("i")).select("video_id", (F.col("i") * interval).alias("target_pts"))


def windows(videos: DataFrame, scales=SCALES) -> DataFrame:
    """(video_id, camera_id, duration) -> overlapping windows per scale, the last one clamped to the end."""
    grid = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("scale"), F.lit(b).cast("long").alias("stride")) for a, b in scales])).alias("grid")
    scale, stride = F.col("grid.scale"), F.col("grid.stride")
    n = F.greatest(F.lit(1), F.ceil((F.col("duration") - scale) / stride) + 1)
    starts = videos.where("duration > 0").select("video_id", "camera_id", "duration", grid).select("*", F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).alias("i"))
    t0 = F.col("i") * stride
    return starts.select("video_id", "camera_id", scale.alias("scale"), t0.alias("t0"), F.least(t0 + scale, F.col("duration")).alias("t1"))


def coverage(ticks: DataFrame, keys: list[str], videos: DataFrame | None = None) -> DataFrame:
    """Failed and skipped ticks stay in the denominator. With videos (their keys) one that has no tick is there with coverage 0."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    rows = ticks
    if videos is not None:
        met = ticks.select(*[F.col(k).alias(f"{k}_t") for k in keys], "status")
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_t")) for k in keys])
        rows = videos.select(*keys).distinct().join(met, on, "left")
    return rows.groupBy(*keys).agg(F.count("status").alias("expected"), count("embedded"), count("decode_failed"), count("skipped")).withColumn("coverage", F.coalesce(F.try_divide("embedded", "expected"), F.lit(0.0)))


def last_state(changes: DataFrame, keys: list[str], seq: str, state: str) -> DataFrame:
    """The ledger's state: of each tick the last write."""
    return changes.groupBy(*keys).agg(F.max_by(state, seq).alias("status"), F.max(seq).alias("seq"))


def only_new(planned: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent planning: what the ledger doesn't have yet."""
    return planned.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def motion_intervals(samples: DataFrame, pad: int) -> DataFrame:
    """samples: (video_id, pts, duration) above the motion threshold. Padded, clamped and merged where they touch."""
    padded = samples.select("video_id", F.greatest(F.col("pts") - pad, F.lit(0)).alias("t0"), F.least(F.col("pts") + pad, F.col("duration")).alias("t1"))
    return islands(padded, ["video_id"], "t0", "t1", [], 0).groupBy("video_id", "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count("*").alias("samples"))


def dense_ticks(intervals: DataFrame, step: int) -> DataFrame:
    """Inclusive grid in each interval; neighbours' common ticks count once."""
    return intervals.select("video_id", F.explode(F.sequence("t0", "t1", F.lit(step).cast("long"))).alias("target_pts")).distinct()


def refinement_ticks(spans: DataFrame, step: int) -> DataFrame:
    """Half-open grid in each candidate interval, starting at its start."""
    last = F.floor((F.col("t1") - F.col("t0") - 1) / step)
    steps = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.col("t0") + i * step)
    return spans.where("t1 > t0").select("video_id", F.explode(steps).alias("target_pts")).distinct()


def evidence_targets(spans: DataFrame, unit: int, least: int = 8, most: int = 24) -> DataFrame:
    """Middles of equal parts of each interval: one a unit of time, but least to most of them."""
    n = F.least(F.lit(most), F.greatest(F.lit(least), F.ceil((F.col("t1") - F.col("t0")) / unit)))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("part")
    dealt = spans.select(*spans.columns, n.alias("parts"), parts)
    return dealt.withColumn("target_pts", F.expr("t0 + ((t1 - t0) * (2 * part + 1)) div (2 * parts)"))


def regressions(frames: DataFrame, key: str, order: str) -> DataFrame:
    """Frames whose time lies before that of the frame read just before them."""
    before = F.lag("pts").over(Window.partitionBy(key).orderBy(order, "tick_id"))
    return frames.withColumn("previous_pts", before).where("previous_pts > pts")


def tick_set(expected: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """Whether the scored ticks are exactly the expected ones: missing, extra and repeated ones."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = count(expected, "e").join(count(scored, "s"), key, "full_outer")
    return both.agg(F.count_if(F.col("s").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("extra"), F.count_if(F.col("s") > 1).alias("repeated"))


def register(incoming: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, sha256, cache_key) against the registered ones: new, same, or clash where an id has another source or configuration."""
    old = videos.select(F.col("video_id").alias("old_id"), F.struct("sha256", "cache_key").alias("old"))
    state = F.when(F.col("old_id").isNull(), "new").when(F.struct("sha256", "cache_key") == F.col("old"), "same").otherwise("clash")
    return incoming.join(old, F.col("video_id") == F.col("old_id"), "left").withColumn("state", state).drop("old_id", "old")


#: State before -> states that may follow (fixed values).
TRANSITIONS = {"pending": ["embedding_pending", "decode_failed", "skipped"], "embedding_pending": ["embedded"], "decode_failed": [], "skipped": [], "embedded": []}


def transitions(changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Writes to the ledger with `legal`: whether the state may follow the tick's state before it; the first one is pending."""
    before = F.lag("state").over(Window.partitionBy(*keys).orderBy(seq))
    legal = F.col("state") == "pending"
    legal = F.when(F.col("before").isNull(), legal)
    for state, nxt in TRANSITIONS.items():
        legal = legal.when(F.col("before") == state, F.col("state").isin(nxt) if nxt else F.lit(False))
    return changes.withColumn("before", before).withColumn("legal", F.coalesce(legal.otherwise(F.lit(False)), F.lit(False)))


def manifest(ticks: DataFrame, frames: DataFrame) -> DataFrame:
    """Each tick with its frame's time, if it has a frame."""
    f = frames.select(F.col("frame_id").alias("f_id"), F.col("pts").alias("actual_pts"))
    return ticks.join(f, F.col("frame_id") == F.col("f_id"), "left").drop("f_id")


def window_ledger(windows: DataFrame, ticks: DataFrame, frames: DataFrame, min_luminance: float | None, min_sharpness: float | None, width: int) -> DataFrame:
    """Per window what its ticks say of it: windows without a tick have zeros and are incomplete.

    Image quality is telemetry. It proves neither that a region was seen nor that
    something was absent, so assessable_ticks is 0 and a window is never assessable.
    """
    keys = ["video_id", "camera_id", "scale", "t0", "t1"]
    f = frames.select(F.col("frame_id").alias("f_id"), "luminance", "sharpness")
    full = ticks.join(f, F.col("frame_id") == F.col("f_id"), "left").drop("f_id")
    inside = range_join(full, windows, ["video_id", "camera_id"], "pts", "t0", "t1", width)
    seen = F.col("status") == "embedded"
    enough = lambda c, least: F.lit(True) if least is None else F.coalesce(F.col(c) >= least, F.lit(False))
    dark = F.lit(False) if min_luminance is None else F.coalesce(F.col("luminance") < min_luminance, F.lit(False))
    folded = inside.groupBy(*keys).agg(
        F.count("*").alias("expected_ticks"), F.count_if(seen).alias("observed_ticks"), F.count_if(seen & enough("luminance", min_luminance) & enough("sharpness", min_sharpness)).alias("quality_assessable_ticks"), F.count_if(seen & dark).alias("low_light_ticks")
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    old = folded.select(*[F.col(k).alias(f"{k}_f") for k in keys], *[c for c in folded.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_f")) for k in keys])
    met = windows.select(*keys).join(old, on, "left").select(*keys, n("expected_ticks"), n("observed_ticks"), n("quality_assessable_ticks"), n("low_light_ticks"))
    return met.withColumns({"assessable_ticks": F.lit(0).cast("long"), "coverage_complete": (F.col("expected_ticks") > 0) & (F.col("observed_ticks") == F.col("expected_ticks"))})


def window_reduction(windows: DataFrame, ticks: DataFrame, how: str, width: int) -> DataFrame:
    """Greatest or mean score of each window's ticks; null for a window without one."""
    if how not in ("max", "mean"):
        raise ValueError(f"unsupported reduction: {how}")
    keys = ["video_id", "camera_id", "scale", "t0", "t1"]
    inside = range_join(ticks, windows, ["video_id", "camera_id"], "pts", "t0", "t1", width)
    value = F.max("score") if how == "max" else F.round(F.sum("score"), 9) / F.count("score")
    folded = inside.groupBy(*keys).agg(value.alias("score"))
    old = folded.select(*[F.col(k).alias(f"{k}_f") for k in keys], "score")
    return windows.select(*keys).join(old, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_f")) for k in keys]), "left").select(*keys, "score")


def finalisable(expected: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """expected and written: keys, block. Generations whose written blocks are exactly the expected ones are complete."""
    a = expected.select(*keys, "block").distinct().withColumn("e", F.lit(1))
    b = written.select(*keys, "block").distinct().withColumn("w", F.lit(1))
    both = a.join(b, [*keys, "block"], "full_outer").groupBy(*keys).agg(F.count_if(F.col("w").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"))
    return both.withColumn("complete", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def activate(generations: DataFrame) -> DataFrame:
    """(video_id, generation, seq, status): each video's pointer, its newest complete generation; a video without one has none."""
    return generations.where("status = 'complete'").groupBy("video_id").agg(F.max_by("generation", "seq").alias("generation"))


def build_state(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, event: start, finish or fail): building, complete or failed. A complete build stays so, whatever is started later."""
    last = F.max_by("event", "seq")
    state = F.when(F.bool_or(F.col("event") == "finish"), "complete").when(last == "fail", "failed").otherwise("building")
    return events.groupBy(*keys).agg(state.alias("state"), F.count_if(F.col("event") == "start").alias("starts"))


def block_manifest(rows: DataFrame, keys: list[str], id_: str, *content: Column) -> DataFrame:
    """A hash for each block (bounded groups of rows): count, ids and the digest of the rows' digests in order of id."""
    own = F.sha2(F.concat_ws("\u001f", F.col(id_).cast("string"), *content), 256)
    rows = rows.withColumn("own_", own)
    digests = F.transform(F.array_sort(F.collect_list(F.struct(id_, "own_"))), lambda x: x["own_"])
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.min(id_).alias("first_id"), F.max(id_).alias("last_id"), F.sha2(F.array_join(digests, ""), 256).alias("digest"))
