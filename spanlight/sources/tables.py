"""Readers, and the star-schema tables viewed as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Declared schema, never inferred; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Content hashes of source files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def active(rows: DataFrame, generations: DataFrame) -> DataFrame:
    """Rows of each video's active generation only; generations: (video_id, generation), one a video."""
    return rows.join(generations, ["video_id", "generation"])


def finalised(rows: DataFrame, generations: DataFrame, wanted: list) -> DataFrame:
    """Rows of the wanted generations, all of which must be complete; generations: (generation, status), a row each."""
    known = generations.where(F.col("generation").isin(wanted) & (F.col("status") == "complete")).select("generation").distinct()
    refused = sorted(set(wanted) - {r[0] for r in known.limit(len(wanted)).collect()})
    if refused:
        raise ValueError(f"generations that are not finalised: {refused}")
    return rows.where(F.col("generation").isin(wanted))


def active_views(spark: SparkSession, nodes: str = "active_evidence_nodes", edges: str = "active_evidence_edges") -> bool:
    """Whether the views of active evidence are there: both or neither, else an error."""
    there = [spark.catalog.tableExists(v) for v in (nodes, edges)]
    if any(there) and not all(there):
        raise RuntimeError("one of the active evidence views is missing")
    return all(there)


def prediction_bundles(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One bundle a file, keyed by config; two bundles of one config are an error."""
    rows = json_documents(spark, path, schema)
    if twice := [r[0] for r in rows.groupBy("config").count().where("count > 1").limit(5).collect()]:
        raise ValueError(f"several bundles of one configuration: {twice}")
    return rows


def measurements(spark: SparkSession, path: str, schema: T.StructType, known: list[str]) -> DataFrame:
    """Benchmark runs from JSON lines; an unknown benchmark id is an error."""
    rows = json_lines(spark, path, schema)
    if strange := [r[0] for r in rows.where(~F.coalesce(F.col("benchmark_id").isin(known), F.lit(False))).select("benchmark_id").distinct().limit(5).collect()]:
        raise ValueError(f"unknown benchmarks: {strange}")
    return rows


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parquet(spark, sf_dir, "events")
    video = F.pmod("user_id", F.lit(8))
    status = F.when(F.col("event_id") % 17 == 0, "decode_failed").when(F.col("event_id") % 29 == 0, "skipped").otherwise("embedded")
    pts = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return e.select(
        F.col("event_id").alias("tick_id"), F.concat(F.lit("v"), video).alias("video_id"), F.concat(F.lit("cam"), video % 3).alias("camera_id"), pts.alias("pts"),
        (F.col("value") / 500).alias("score"), F.col("event_type").alias("label"), F.col("user_id").alias("actor"), status.alias("status"), "ts",
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).groupBy("video_id", "camera_id").agg((F.max("pts") + 1_000_000).alias("duration"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = parquet(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_returnflag").alias("label"))


def order_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = parquet(spark, sf_dir, "orders")
    hours = lambda c: F.expr(f"timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")
    t0 = hours("o_orderdate")
    return o.select("o_orderkey", F.pmod("o_custkey", F.lit(16)).alias("camera"), t0.alias("t0"), (t0 + 24 + F.col("o_orderkey") % 72).alias("t1"))
