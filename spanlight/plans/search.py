"""Queries over the plane sweep and the text index, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger, sweep, textindex
from ..sources import tables as src
from ..sources.shared import new_path
from . import catalogue as base

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


_DATE = "epoch_us(o_orderdate::TIMESTAMP) // 3600000000"


@query(f"{base._T} SELECT {base._W}, count(*) AS ticks, min(tick_id) AS first_tick, max(score) AS best FROM hits GROUP BY {base._W}")
def sweep_windows(spark, d):
    """Windows with their ticks, by the plane sweep."""
    hits = sweep.sweep_join(src.ticks(spark, d), ledger.windows(src.videos(spark, d)), ["video_id", "camera_id"], "pts", "t0", "t1")
    return hits.groupBy(*base.WINDOW).agg(F.count("*").alias("ticks"), F.min("tick_id").alias("first_tick"), F.max("score").alias("best"))


@query(f"WITH p AS (SELECT o_custkey % 16 AS camera, {_DATE} AS at FROM orders), s AS (SELECT o_orderkey, o_custkey % 16 AS camera, {_DATE} AS t0, {_DATE} + 24 + o_orderkey % 72 AS t1 FROM orders) SELECT o_orderkey, count(*) AS starts FROM p JOIN s ON p.camera = s.camera AND p.at >= s.t0 AND p.at < s.t1 GROUP BY o_orderkey")
def sweep_overlaps(spark, d):
    """For each span how many spans of its camera begin while it is open, itself included."""
    spans = src.order_intervals(spark, d).where("camera IS NOT NULL AND t0 IS NOT NULL AND t1 IS NOT NULL")
    points = src.order_intervals(spark, d).select("camera", F.col("t0").alias("at"))
    return sweep.sweep_counts(points, spans, ["camera"], "at", "t0", "t1").groupBy("o_orderkey").agg(F.sum("points").alias("starts"))


_WORDS = f"w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{textindex.UPPER}', '{textindex.LOWER}'), '{textindex.WORD}') AS ws FROM documents), t AS (SELECT doc_id, i AS at, ws[i] AS term, len(ws) AS length FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w))"


def _index(spark, d):
    """All documents in two segments, as an index that was appended to would have them."""
    docs = src.parquet(spark, d, "documents")
    index = textindex.TextIndex(spark, new_path(spark, "text-index"))
    for odd in (0, 1):
        index.append(docs.where(F.pmod("doc_id", F.lit(2)) == odd), "doc_id", "text")
    return docs, index


@query(f"WITH {_WORDS}, q AS (SELECT doc_id AS query_id, ws[2] AS a, ws[3] AS b, left(ws[4], 2) AS c FROM w WHERE doc_id % 20 = 0 AND len(ws) >= 4) SELECT query_id, x.doc_id AS doc, count(*) AS n FROM q JOIN t x ON x.term = a JOIN t y ON y.doc_id = x.doc_id AND y.at = x.at + 1 AND y.term = b JOIN t z ON z.doc_id = x.doc_id AND z.at = x.at + 2 AND starts_with(z.term, c) GROUP BY ALL")
def text_phrases(spark, d):
    """Where the second and third word of every twentieth document stand in a row, before a word that begins as its fourth."""
    docs, index = _index(spark, d)
    ws = textindex.words(F.col("text"))
    some = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), ws.alias("ws")).where(F.size("ws") >= 4)
    phrase = F.concat_ws(" ", F.col("ws")[1], F.col("ws")[2], F.substring(F.col("ws")[3], 1, 2))
    return index.phrase(some.select("query_id", phrase.alias("phrase"), F.lit(True).alias("prefix")))


@query(
    f"WITH {_WORDS}, q AS (SELECT DISTINCT doc_id AS query_id, unnest(ws[1:4]) AS term FROM w WHERE doc_id % 20 = 0), n AS (SELECT count(*) AS docs, avg(len(ws)) AS mean FROM w), f AS (SELECT doc_id, term, length, count(*) AS tf FROM t GROUP BY ALL), i AS (SELECT term, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f, n GROUP BY term, docs), "
    f"s AS (SELECT query_id, doc_id AS doc, sum(CAST(round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) * {textindex.UNIT}) AS BIGINT)) AS score FROM q JOIN f USING (term) JOIN i USING (term), n GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s) SELECT query_id, CAST(rank AS INT) AS rank, doc, round(score / {textindex.UNIT}, 5) AS score FROM r WHERE rank <= 5"
)
def text_ranked(spark, d):
    """The five best documents by BM25 for the first four words of every twentieth."""
    docs, index = _index(spark, d)
    ws = textindex.words(F.col("text"))
    some = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", F.slice(ws, 1, 4)).alias("text"))
    return index.ranked(some, 5).withColumn("score", F.round("score", 5))
