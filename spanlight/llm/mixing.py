"""Mixing sources to target weights by capped water-filling.

The water level is found in closed form: sources are ordered by cap / weight, and
the level is the first at which no later source is above its cap. Whole
repetitions are the same for all documents of a source; the fractional rest is a
seeded random sample without replacement: documents in hash order up to the rest
in words. That prefix is located on sums over 4,096 hash buckets; rows are joined and
ordered by source and bucket, so no task sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: (source, source_size), one row a source. Adds weight and target (double).

    Sources take the weights in turn by code point, null last. The targets share
    the total size by weight, none above max_epochs times its source's size; what
    exceeds a cap is shared again by weight. An empty source has target 0. The
    windows here run over one row a source, never over documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("long")
    cap = F.col("source_size") * F.lit(max_epochs)
    by_cap = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    rest_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = sizes.withColumn("weight", weight).withColumn("rest", rest).withColumn("rest_weight", rest_weight)
    # The first source (in cap order) that its share doesn't fill sets the level for itself and all later ones.
    share = F.col("rest").cast("double") * F.col("weight") / F.col("rest_weight")
    level = level.withColumn("open", (share < cap).cast("int")).withColumn("key", cap / F.col("weight"))
    first = Window.orderBy("key", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    at = lambda c: F.first(F.when(F.col("open") == 1, F.col(c)), ignorenulls=True).over(first)
    target = F.coalesce(at("rest").cast("double") * F.col("weight") / at("rest_weight"), cap.cast("double"))
    return level.withColumn("target", target).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs: (doc_id, text, source, ...). Per row: doc_id, source, h, size, source_size, target, reps, and the columns of carry.

    size is the words of the text (null: 0). reps is how often the mix takes the
    row: the whole part of target / source_size, one more for the seeded sample
    that makes up the rest; the taken words of a source differ from its target by
    at most half of one document. Rows of size 0 follow the order, and cost
    nothing. Repeated rows are rows of their own; a null doc_id hashes as ''.
    """
    h = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = materialize(docs.select("doc_id", "source", h.alias("h"), word_count(F.col("text")).alias("size"), *carry), "mix-sizes")
    bucket = F.substring("h", 1, 3).alias("bucket")
    sums = sized.groupBy("source", bucket).agg(F.sum("size").alias("bucket_size"))
    filled = water_fill(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    filled = filled.withColumn("whole", whole).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    run = Window.partitionBy("source").orderBy("bucket")
    cut = (
        sums.withColumn("before", F.sum("bucket_size").over(run) - F.col("bucket_size"))
        .join(filled.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")))
        .where((F.col("before") <= F.col("extra")) & (F.col("before") + F.col("bucket_size") > F.col("extra")))
        .select(F.col("source").alias("source_"), "bucket", "before")
    )
    # One row a source: where the sample ends. No bucket qualifies for a source of size 0.
    plan = (
        filled.join(cut, F.col("source").eqNullSafe(F.col("source_")), "left")
        .select(F.col("source").alias("source_"), "source_size", "target", "whole", "extra", "bucket", "before")
    )
    # Rows meet their source's plan by source and hash bucket, so a large source is dealt over its buckets.
    spread = (
        sums.select(F.col("source").alias("of"), F.col("bucket").alias("own"))
        .join(plan.withColumnRenamed("bucket", "end"), F.col("of").eqNullSafe(F.col("source_")))
        .drop("source_")
    )
    met = sized.join(spread, F.col("source").eqNullSafe(F.col("of")) & (F.substring("h", 1, 3) == F.col("own")))
    order = Window.partitionBy("of", "own").orderBy("h", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(order) - F.col("size") / 2.0
    sampled = (F.col("own") < F.col("end")) | ((F.col("own") == F.col("end")) & (middle <= F.col("extra")))
    taken = met.withColumn("more", F.when(sampled, 1).otherwise(0))
    reps = F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(F.col("whole"))
    return taken.withColumn("reps", reps.cast("long")).select("doc_id", "source", "h", "size", "source_size", "target", "reps", *carry)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """Mixes all documents; taken = size * reps."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("reps")).alias("taken"))


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS k,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight
  FROM sources),
opened AS (
  SELECT *, min(CASE WHEN rest::DOUBLE * weight / rest_weight < cap THEN k END) OVER () AS k0 FROM levels),
water AS (
  SELECT rest AS r0, rest_weight AS w0, k AS k1 FROM opened WHERE rest::DOUBLE * weight / rest_weight < cap ORDER BY k, source NULLS LAST LIMIT 1),
targets AS (
  SELECT o.source, source_size,
         CASE WHEN (SELECT k1 FROM water) IS NULL OR k < (SELECT k1 FROM water) THEN cap::DOUBLE
              ELSE (SELECT r0 FROM water)::DOUBLE * weight / (SELECT w0 FROM water) END AS target
  FROM opened o),
parts AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
run AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0 AS middle,
         p.target - p.whole * p.source_size AS extra
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN middle <= extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""
