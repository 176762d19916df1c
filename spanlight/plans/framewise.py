"""Queries over what is measured on frames, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames
from ..sources import tables as src
from . import evidence as ev

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(
    f"{ev._LEDGER}, f AS (SELECT tick_id, video_id, CASE WHEN status = 'embedded' THEN pts END AS actual_pts FROM led WHERE lane = 'base'), s AS (SELECT video_id, pts, arg_min(score, tick_id) AS score FROM led WHERE lane = 'motion' GROUP BY ALL), "
    "b AS (SELECT f.*, s.pts AS p, s.score AS ps FROM f ASOF LEFT JOIN s ON f.video_id = s.video_id AND f.actual_pts >= s.pts), a AS (SELECT f.tick_id, s.pts AS q, s.score AS qs FROM f ASOF LEFT JOIN s ON f.video_id = s.video_id AND f.actual_pts <= s.pts) "
    "SELECT b.tick_id, b.video_id, actual_pts, CASE WHEN q IS NULL OR actual_pts - p <= q - actual_pts THEN ps ELSE qs END AS motion_score FROM b JOIN a USING (tick_id)"
)
def motion_score_lookup(spark, d):
    """Frames of the base lane with the score of the nearest motion sample of their video; null where none was decoded."""
    led = ev._ledger(spark, d)
    base = led.where("lane = 'base'").select("tick_id", "video_id", F.when(F.col("status") == "embedded", F.col("pts")).alias("actual_pts"))
    samples = led.where("lane = 'motion'").select("video_id", F.col("tick_id").alias("sample_id"), "pts", "score")
    return frames.motion_scores(base, samples, ["video_id"], "actual_pts")


@query("SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS tick, l_partkey AS frame_id, l_linenumber AS pts, l_extendedprice AS price, l_quantity AS quantity FROM lineitem")
def feature_matrix(spark, d):
    """Records with a sequence a feature, turned into a vector a tick in a stated order."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    records = src.parquet(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    series = lambda c: F.col("items")[c].cast("array<double>")
    named = F.create_map(F.lit("quantity"), series("l_quantity"), F.lit("price"), series("l_extendedprice"))
    rows = frames.feature_rows(records.select("l_orderkey", F.col("items.l_partkey").alias("frame_ids"), F.col("items.l_linenumber").alias("pts"), named.alias("features")), ["l_orderkey"], ["price", "quantity"])
    return rows.select("l_orderkey", "tick", "frame_id", "pts", F.col("vector")[0].alias("price"), F.col("vector")[1].alias("quantity"))


_GROUNDED = """WITH c AS (SELECT o_orderkey, o_orderkey % 11 <> 0 AS verified, o_custkey % 13 <> 0 AS enabled, CASE o_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'failed' ELSE 'passed' END AS status FROM orders),
k AS (SELECT l_orderkey, l_linenumber * 10000000 + l_partkey * 10 + l_suppkey % 10 AS cid, l_partkey, l_suppkey, l_quantity, l_partkey % 4 <> 2 AND l_suppkey % 7 <> 0 AS wanted, CASE WHEN l_partkey % 31 = 0 THEN [] ELSE [l_partkey % 5, (l_partkey + 2) % 5] END AS ids FROM lineitem),
e AS (SELECT l_orderkey, cid, l_partkey, l_suppkey, l_quantity, unnest(CASE WHEN len(ids) = 0 THEN [NULL] ELSE ids END) AS f, unnest(CASE WHEN len(ids) = 0 THEN [-1] ELSE [0, 1] END) AS pos FROM k WHERE wanted),
b AS (SELECT l_orderkey, cid, pos, f IS NOT NULL AND (l_suppkey + f) % 3 <> 0 AS answered, CASE WHEN f IS NULL THEN 'no_cited_evidence' WHEN f = 4 AND l_orderkey % 6 = 0 THEN 'frame_not_supplied' WHEN (l_suppkey + f) % 3 = 0 THEN NULL WHEN l_partkey % 97 = 0 THEN 'box_outside_evidence'
  WHEN CAST(l_quantity AS BIGINT) % 50 = 0 THEN 'box_not_normalised' WHEN l_partkey % 101 = 0 THEN 'score_out_of_range' WHEN l_suppkey % 79 = 0 THEN 'phrase_or_revision_missing' WHEN l_suppkey % 89 = 0 THEN 'reference_changed' END AS fault FROM e),
g AS (SELECT l_orderkey, cid, coalesce(arg_min(fault, pos) FILTER (fault IS NOT NULL), CASE WHEN count(*) FILTER (answered) = 0 THEN 'no_stable_region' END) AS fault, count(*) FILTER (answered) AS n FROM b GROUP BY ALL),
w AS (SELECT l_orderkey AS o_orderkey, arg_min(fault, cid) FILTER (fault IS NOT NULL) AS fault, sum(n) AS n FROM g GROUP BY ALL), s AS (SELECT l_orderkey AS o_orderkey, string_agg(DISTINCT f, ',' ORDER BY f) AS cited FROM (SELECT l_orderkey, unnest(ids) AS f FROM k) GROUP BY ALL),
r AS (SELECT *, CASE WHEN NOT verified THEN 'not_accepted' WHEN NOT enabled THEN 'grounding_disabled' WHEN status IS DISTINCT FROM 'passed' THEN 'grounding_gate_not_passed' WHEN n IS NULL THEN 'no_supported_phrase' ELSE fault END AS reason FROM c LEFT JOIN w USING (o_orderkey) LEFT JOIN s USING (o_orderkey))
SELECT o_orderkey, reason IS NULL AS overlay, CAST(CASE WHEN reason IS NULL THEN n ELSE 0 END AS BIGINT) AS n_boxes, reason, CASE WHEN NOT enabled THEN 'disabled' ELSE coalesce(status, 'not_measured') END AS gate_status, coalesce(cited, '') AS cited FROM r"""


@query(_GROUNDED)
def grounded_overlays(spark, d):
    """Boxes of each candidate's supported constraints, shown whole or not at all."""
    k, c, part, supp = F.col("o_orderkey"), F.col("o_custkey"), F.col("l_partkey"), F.col("l_suppkey")
    orders, items = src.parquet(spark, d, "orders"), src.parquet(spark, d, "lineitem")
    status = F.when(c % 9 == 0, None).when(c % 9 == 1, "failed").otherwise("passed")
    candidates = orders.select("o_orderkey", (k % 11 != 0).alias("verified"), (c % 13 != 0).alias("enabled"), status.alias("gate_status"), (status == "passed").alias("gate_passed"))
    ids = F.when(part % 31 == 0, F.array().cast("array<bigint>")).otherwise(F.array((part % 5).cast("long"), ((part + 2) % 5).cast("long")))
    kind = F.when(part % 4 == 1, "attribute").when(part % 4 == 2, "action").otherwise("object")
    phrase, cid = F.concat(F.lit("part "), part), F.col("l_linenumber").cast("long") * 10000000 + part * 10 + supp % 10
    constraints = items.select(F.col("l_orderkey").alias("o_orderkey"), cid.alias("constraint_id"), kind.alias("kind"), F.when(supp % 7 == 0, "contradicted").otherwise("supported").alias("state"), phrase.alias("phrase"), ids.alias("frame_ids"), part, supp, "l_quantity")
    supplied = orders.select("o_orderkey", F.explode(F.when(k % 6 == 0, F.sequence(F.lit(0), F.lit(3))).otherwise(F.sequence(F.lit(0), F.lit(4))).cast("array<bigint>")).alias("frame_id"))
    f = F.col("asked")
    box = F.struct(F.lit(0.1).alias("x0"), F.lit(0.2).alias("y0"), F.when(F.col("l_quantity").cast("long") % 50 == 0, 1.5).otherwise(0.9).alias("x1"), F.lit(0.8).alias("y1"))
    boxes = constraints.select("*", F.explode("frame_ids").alias("asked")).where((supp + f) % 3 != 0).select(
        "o_orderkey", "constraint_id", "asked", (f + F.when(part % 97 == 0, 50).otherwise(0)).alias("frame_id"), F.when(supp % 89 == 0, "other").otherwise(F.col("phrase")).alias("phrase"), box.alias("box"),
        F.when(part % 101 == 0, 1.5).otherwise(0.5).alias("score"), F.when(supp % 79 == 0, "").otherwise("r1").alias("revision"),
    )
    found = frames.grounded_boxes(candidates, constraints.select("o_orderkey", "constraint_id", "kind", "state", "phrase", "frame_ids"), supplied, boxes, "o_orderkey")
    return found.withColumn("cited", F.array_join("cited", ","))
