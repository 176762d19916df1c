"""Queries over content ids, seals, block logs and generation pointers, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.canonical import content_id
from ..operators import commits, seals
from ..sources import tables as src
from ..sources.shared import new_path

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT o_orderkey, sha256('{"customer":{"key":' || o_custkey || ',"rank":' || (o_custkey % 7) || '},"order":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') AS id, true AS same FROM orders""")
def canonical_ids(spark, d):
    """Content ids of nested records, made twice with fields in another order, of a struct and of a map."""
    c, k, status = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderstatus")
    rank = (c % 7).cast("long").alias("rank")
    one = content_id(status.alias("status"), k.alias("order"), F.struct(rank, c.alias("key")).alias("customer"))
    two = content_id(F.create_map(F.lit("rank"), rank, F.lit("key"), c).alias("customer"), k.alias("order"), status.alias("status"))
    return src.parquet(spark, d, "orders").select("o_orderkey", one.alias("id"), (one == two).alias("same"))


def _parts(spark, d):
    path = F.concat(F.col("page_id").cast("string"), F.lit("/"), F.coalesce("url", F.lit("")))
    return src.parquet(spark, d, "pages").select((F.col("page_id") % 10).alias("seal_id"), "page_id", path.alias("path"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))


_PARTS = "p AS (SELECT page_id % 10 AS seal_id, page_id, page_id || '/' || coalesce(url, '') AS path, sha256(coalesce(html, '')) AS digest FROM pages)"


@query(
    f"WITH {_PARTS}, l AS (SELECT seal_id, sha256(path) AS node, sha256(length(path) || ':' || path || ':' || digest) AS d FROM p), a AS (SELECT seal_id, left(node, 4) AS node4, sha256(string_agg(node || d, '' ORDER BY node, d)) AS d, count(*) AS n FROM l GROUP BY ALL), "
    "b AS (SELECT seal_id, left(node4, 2) AS node2, sha256(string_agg(node4 || d, '' ORDER BY node4)) AS d, sum(n) AS n FROM a GROUP BY ALL) SELECT seal_id, sha256(string_agg(node2 || d, '' ORDER BY node2)) AS digest, CAST(sum(n) AS BIGINT) AS parts FROM b GROUP BY seal_id"
)
def session_seals(spark, d):
    """The seal of each session's files, recomputed level by level."""
    return seals.seal(_parts(spark, d))


@query(f"WITH {_PARTS} SELECT seal_id, path, 'altered' AS change FROM p WHERE page_id % 7 = 0 AND page_id % 11 <> 0 UNION ALL SELECT seal_id, path, 'removed' FROM p WHERE page_id % 11 = 0 UNION ALL SELECT seal_id, 'new/' || path, 'added' FROM p WHERE page_id % 13 = 0")
def seal_changes(spark, d):
    """What was altered, removed and added since a seal."""
    old = _parts(spark, d)
    kept = old.where("page_id % 11 <> 0").withColumn("digest", F.when(F.col("page_id") % 7 == 0, F.sha2("digest", 256)).otherwise(F.col("digest")))
    new = kept.unionByName(old.where("page_id % 13 = 0").withColumn("path", F.concat(F.lit("new/"), "path")))
    return seals.changed(old, new)


@query("SELECT vec_id % 3 AS block, count(*) AS \"rows\", min(vec_id) AS first_id, max(vec_id) AS last_id, bool_or(vec_id % 3 = 2) AS rewritten FROM embeddings GROUP BY 1")
def embedding_log(spark, d):
    """Embeddings in a log of three blocks: the last one is torn, cut off by the repair and written again."""
    e, log = src.parquet(spark, d, "embeddings"), commits.BlockLog(spark, new_path(spark, "embedding-log"))
    for i in range(3):
        log.append(e.where(F.col("vec_id") % 3 == i))
    fs, at = commits._files(spark, f"{log.path}/{log.blocks()[-1]}/data")
    fs.delete(at, True)
    cut = log.repair()
    for name in cut:
        log.append(e.where(F.col("vec_id") % 3 == int(name)))
    return log.rows().groupBy(F.col("block").cast("long").alias("block"), F.col("block").isin(cut).alias("rewritten")).agg(F.count("*").alias("rows"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


@query("WITH g AS (SELECT o_custkey::VARCHAR AS video_id, o_orderkey AS generation FROM orders WHERE o_orderstatus = 'F') SELECT video_id, CASE WHEN max(generation) FILTER (generation % 2 = 1) IS NOT NULL THEN max(generation) FILTER (generation % 2 = 1) ELSE max(generation) FILTER (generation % 2 = 0) END AS generation FROM g GROUP BY video_id")
def generation_swaps(spark, d):
    """Active generations after two writers in turn: the even ones first, then the odd ones of the videos that have some."""
    states = src.parquet(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("video_id"), F.col("o_orderkey").alias("generation"), F.lit("complete").alias("state"))
    pointer = commits.Generations(spark, new_path(spark, "generations"))
    for turn in (0, 1):
        wanted = states.where(F.col("generation") % 2 == turn).groupBy("video_id").agg(F.max("generation").alias("generation"))
        pointer.activate(wanted, states, turn)
    return pointer.current()[1]
