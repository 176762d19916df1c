"""Range joins, nearest joins and islands, all on shuffled keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import materialize


def range_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, t0: str, t1: str, width: int) -> DataFrame:
    """points within half-open spans of the same keys (null keys are equal).

    Spans are dealt to all buckets of `width` they touch, points to one: an
    equi-join with the exact condition as a residue, instead of a nested loop.
    A point meets a span in exactly one bucket, so nothing is found twice. A span
    that doesn't end after its start is an error.
    """
    p = points.withColumn("bucket_", F.floor(F.col(at) / width))
    last = F.greatest(F.floor((F.col(t1) - 1) / width), F.floor(F.col(t0) / width))  # half-open
    first = F.when(F.col(t1) > F.col(t0), F.floor(F.col(t0) / width)).otherwise(F.raise_error(F.lit("an interval ends before it begins")))
    s = spans.select(*[F.col(k).alias(f"{k}_s") for k in keys], *[c for c in spans.columns if c not in keys], F.explode(F.sequence(first, last)).alias("bucket_s"))
    on = [p[k].eqNullSafe(s[f"{k}_s"]) for k in keys] + [p["bucket_"] == s["bucket_s"], p[at] >= s[t0], p[at] < s[t1]]
    return p.join(s, on).drop("bucket_", "bucket_s", *[f"{k}_s" for k in keys])


def _same(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of columns of two frames."""
    return reduce(lambda x, y: x & y, [a[x].eqNullSafe(b[y]) for x, y in pairs])


def _nearest_neighbours(targets: DataFrame, frames: DataFrame, keys: list[str], at: str, frame_id: str, width: int) -> DataFrame:
    """targets with before_ and after_: structs (at, id) of the last frame up to the target and the first one after it.

    Time is cut into buckets, so a key is as many tasks as it has buckets. A bucket
    also gets the last frame of those before it and the first of those after it,
    from windows over one row a bucket. Within a bucket both sides are running
    windows, one forwards and one backwards: linear in the rows.
    """
    bucket = F.floor(F.col(at) / width).alias("b_")
    kind = frames.schema[frame_id].dataType
    id_type = kind.simpleString() if isinstance(kind, StructType) else "bigint"  # a struct carries what the caller wants of a frame
    t = targets.select(*keys, bucket, F.col(at).alias("at_"), F.struct(*targets.columns).alias("target_"), F.lit(None).cast(f"struct<at:bigint,id:{id_type}>").alias("frame_"), F.lit(1).alias("kind_"))
    own = F.struct(F.col(at).cast("bigint").alias("at"), F.col(frame_id).cast(id_type).alias("id"))
    f = frames.where(F.col(at).isNotNull()).select(*keys, bucket, F.col(at).alias("at_"), F.lit(None).cast(t.schema["target_"].dataType).alias("target_"), own.alias("frame_"), F.lit(0).alias("kind_"))
    ends = t.select(*keys, "b_", "frame_").unionByName(f.select(*keys, "b_", "frame_")).groupBy(*keys, "b_").agg(F.min("frame_").alias("first_"), F.max("frame_").alias("last_"))
    by = Window.partitionBy(*keys)
    last = F.last("last_", ignorenulls=True).over(by.orderBy("b_").rowsBetween(Window.unboundedPreceding, -1))
    first = F.last("first_", ignorenulls=True).over(by.orderBy(F.desc("b_")).rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.withColumn("l_", last).withColumn("f_", first).select(*keys, "b_", F.explode(F.array("l_", "f_")).alias("frame_")).where("frame_ IS NOT NULL")
    carried = carried.select(*keys, "b_", F.col("frame_.at").alias("at_"), F.lit(None).cast(t.schema["target_"].dataType).alias("target_"), "frame_", F.lit(0).alias("kind_"))
    every = t.unionByName(f).unionByName(carried)
    near = Window.partitionBy(*keys, "b_").rowsBetween(Window.unboundedPreceding, 0)
    before = F.last("frame_", ignorenulls=True).over(near.orderBy("at_", "kind_", "frame_.id"))
    after = F.last("frame_", ignorenulls=True).over(near.orderBy(F.desc("at_"), F.desc("kind_"), F.desc("frame_.id")))
    return every.withColumn("before_", before).withColumn("after_", after).where("kind_ = 1")


def nearest_join(targets: DataFrame, frames: DataFrame, keys: list[str], at: str, frame_id: str, max_distance: int | None = None, width: int = 3_600_000_000) -> DataFrame:
    """For each target the nearest frame of its keys (null keys are equal), the earlier one on a tie.

    Adds frame_id, frame_pts and error_code: null, `no_decodable_frame` where the
    keys have no frame, or `nearest_frame_too_far` beyond max_distance; both leave
    the frame null. width: the buckets of time that a key is cut into.
    """
    both = _nearest_neighbours(targets, frames, keys, at, frame_id, width)
    ahead, behind = F.col("after_.at") - F.col("at_"), F.col("at_") - F.col("before_.at")
    hit = F.when(F.col("before_").isNull() | (F.col("after_").isNotNull() & (ahead < behind)), F.col("after_")).otherwise(F.col("before_"))
    far = F.lit(False) if max_distance is None else F.abs(hit["at"] - F.col("at_")) > max_distance
    error = F.when(hit.isNull(), "no_decodable_frame").when(far, "nearest_frame_too_far")
    return both.select("target_.*", F.when(error.isNull(), hit["id"]).alias("frame_id"), F.when(error.isNull(), hit["at"]).alias("frame_pts"), error.alias("error_code"))


def asof_join(targets: DataFrame, frames: DataFrame, keys: list[str], at: str, frame_id: str, width: int = 3_600_000_000) -> DataFrame:
    """For each target the last frame at or before it (null where there is none)."""
    both = _nearest_neighbours(targets, frames, keys, at, frame_id, width)
    return both.select("target_.*", F.col("before_.id").alias("frame_id"), F.col("before_.at").alias("frame_pts"))


def islands(df: DataFrame, keys: list[str], t0: str, t1: str, tie: list[str], gap, width: int = 24 * 3_600_000_000) -> DataFrame:
    """Numbers groups of intervals whose start is at most gap after the greatest end so far (inclusive).

    Starts are cut into buckets of time. What a bucket needs of the ones before it,
    the greatest end and the number of groups, comes from windows over one row a
    bucket; so one key is as many tasks as it has buckets.
    """
    cut = df.withColumn("b_", F.floor(F.col(t0) / width))
    earlier = Window.partitionBy(*keys).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)

    def joined(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
        f = found.select(*[F.col(k).alias(f"{k}_f") for k in [*keys, "b_"]], name)
        return rows.join(f, _same(rows, f, [(k, f"{k}_f") for k in [*keys, "b_"]])).drop(*[f"{k}_f" for k in [*keys, "b_"]])

    ends = cut.groupBy(*keys, "b_").agg(F.max(t1).alias("end_")).select(*keys, "b_", F.max("end_").over(earlier).alias("reach_"))
    order = Window.partitionBy(*keys, "b_").orderBy(t0, t1, *tie)
    local = F.max(t1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    reach = F.greatest(local, F.col("reach_"))
    marked = joined(cut, ends, "reach_").withColumn("fresh_", F.when(reach.isNull() | (F.col(t0) > reach + gap), 1).otherwise(0))
    groups = marked.groupBy(*keys, "b_").agg(F.sum("fresh_").alias("n_")).select(*keys, "b_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("done_"))
    number = F.col("done_") + F.sum("fresh_").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return joined(marked, groups, "done_").withColumn("island", number).drop("fresh_", "reach_", "done_", "b_")


def ranked(df: DataFrame, keys: list[str], coarse: list[Column], fine: list[Column], name: str = "rank") -> DataFrame:
    """Adds the row number within keys by coarse, then fine, without one task a key.

    Rows of equal coarse values are numbered by fine in a task of their own; how
    many rows come before them is a window over one row for each coarse value. So
    coarse should take many values, each on few rows. The rows are read twice, and
    written to the shared folder before, so that they are not computed twice.
    """
    names = [f"c{i}_" for i in range(len(coarse))]
    # An order column wraps its value: the values are computed once, then ordered by as the caller asked.
    rows = materialize(df.select("*", *[c.alias(n) for c, n in zip(coarse, names, strict=True)]), "ranked")
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    at = [*keys, *names]
    counts = rows.groupBy(*at).agg(F.count("*").alias("n_")).select(*[F.col(k).alias(f"{k}_f") for k in at], F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    own = F.row_number().over(Window.partitionBy(*at).orderBy(*fine))
    met = rows.join(counts, _same(rows, counts, [(k, f"{k}_f") for k in at]))
    return met.withColumn(name, (F.col("before_") + own).cast("int")).drop(*names, *[f"{k}_f" for k in at], "before_")


def rank_by(partition: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of half-open intervals (t0, t1) of equal keys that overlap, as structs l and r.

    Both sides go to all buckets of `width` they touch; a pair counts in the bucket
    of its later start only, so it is found once.
    """
    deal = lambda df, name: df.where("t1 > t0").select(
        F.struct(*df.columns).alias(name), *[F.col(k).alias(f"{k}_{name}") for k in keys], F.explode(F.sequence(F.floor(F.col("t0") / width), F.floor((F.col("t1") - 1) / width))).alias(f"b{name}")
    )
    a, b = deal(left, "l"), deal(right, "r")
    on = [F.col(f"{k}_l").eqNullSafe(F.col(f"{k}_r")) for k in keys] + [F.col("bl") == F.col("br")]
    later = F.greatest("l.t0", "r.t0")
    met = a.join(b, on).where((F.col("l.t0") < F.col("r.t1")) & (F.col("r.t0") < F.col("l.t1")) & (F.floor(later / width) == F.col("bl")))
    return met.select("l", "r")
