"""Named queries over the tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import label_match, t_iou
from ..operators import assemble, decide, evaluate, fuse, graph, intervals, ledger, retrieve, tracks
from ..sources import tables as src
from ..streaming import ticks as streams

HOUR = ledger.HOUR

_TICKS = f"""
ticks AS (SELECT event_id AS tick_id, 'v' || (user_id % 8) AS video_id, 'cam' || ((user_id % 8) % 3) AS camera_id,
  epoch_us(ts) - 1704067200000000 AS pts, value / 500 AS score, event_type AS label, user_id AS actor, ts,
  CASE WHEN event_id % 17 = 0 THEN 'decode_failed' WHEN event_id % 29 = 0 THEN 'skipped' ELSE 'embedded' END AS status FROM events),
videos AS (SELECT video_id, camera_id, max(pts) + 1000000 AS duration FROM ticks GROUP BY ALL),
scales AS (SELECT * FROM (VALUES ({4 * HOUR}, {2 * HOUR}), ({12 * HOUR}, {6 * HOUR}), ({30 * HOUR}, {15 * HOUR})) s(scale, stride)),
windows AS (SELECT video_id, camera_id, scale, i * stride AS t0, least(i * stride + scale, duration) AS t1
  FROM (SELECT *, unnest(generate_series(0, greatest(1, CAST(ceil((duration - scale)::DOUBLE / stride) AS BIGINT) + 1) - 1)) AS i FROM videos, scales)),
hits AS (SELECT t.*, w.scale, w.t0, w.t1 FROM ticks t JOIN windows w ON t.video_id = w.video_id AND t.camera_id = w.camera_id AND t.pts >= w.t0 AND t.pts < w.t1)
"""
WINDOW = ["video_id", "camera_id", "scale", "t0", "t1"]
_W = ", ".join(WINDOW)


def _hits(spark, d, status: str | None = None):
    t = src.ticks(spark, d)
    return retrieve.ticks_in_windows(t, ledger.windows(src.videos(spark, d)))


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def exact_score(spark, d):
    e = src.parquet(spark, d, "embeddings")
    first = e.where("vec_id = 0").first()
    query, e = (first["embedding"], e) if first else ([], e.limit(0))
    return _round(retrieve.exact_scores(e, query), "score")


def exact_score_topk(spark, d):
    return exact_score(spark, d).orderBy(F.desc("score"), "vec_id").limit(20)


_EXACT = "SELECT vec_id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), lambda x: x[1] * x[2])), 6) AS score FROM embeddings"


def tick_generation(spark, d):
    return ledger.expected_ticks(src.videos(spark, d).select("video_id", "duration"), HOUR)


def window_generation(spark, d):
    return ledger.windows(src.videos(spark, d))


def _window(how):
    def run(spark, d):
        scored = retrieve.window_scores(_hits(spark, d), WINDOW, how)
        # A mean's last places may be ties, which engines round differently.
        return scored if how == "mean" else scored.withColumn("score", F.round("score", 9))

    return run


def scope_filter(spark, d):
    w = ledger.windows(src.videos(spark, d))
    return w.where((F.col("camera_id") == "cam1") & (F.col("t1") >= 100 * HOUR) & (F.col("t0") <= 200 * HOUR))


def window_clip(spark, d):
    w = ledger.windows(src.videos(spark, d)).where((F.col("t0") < 200 * HOUR) & (F.col("t1") > 100 * HOUR))
    return w.withColumn("t0", F.greatest("t0", F.lit(100 * HOUR))).withColumn("t1", F.least("t1", F.lit(200 * HOUR))).distinct()


def _scored(spark, d):
    """One channel a label; intervals of different scales that agree are one candidate."""
    s = retrieve.window_scores(_hits(spark, d), [*WINDOW, "label"], "top20_mean")
    s = s.groupBy("video_id", "camera_id", "t0", "t1", F.col("label").alias("channel")).agg(F.max("score").alias("score"))
    return s.where(F.round("score", 9) >= 0.2)


def rrf_order(spark, d):
    return _round(fuse.fuse(_scored(spark, d)), "best", "rrf")


def search_flagship(spark, d):
    """Ticks -> windows -> channels -> threshold -> rank fusion -> clusters."""
    return _round(fuse.cluster(fuse.fuse(_scored(spark, d)), 2 * HOUR), "priority")


_RANKED = f"""{_TICKS},
r AS (SELECT *, row_number() OVER (PARTITION BY {_W}, label ORDER BY score DESC, tick_id) AS rn, count(*) OVER (PARTITION BY {_W}, label) AS n FROM hits),
s0 AS (SELECT {_W}, label AS channel, avg(score) AS score FROM r WHERE rn <= greatest(1, ceil(n * 0.2::DOUBLE)) GROUP BY ALL),
scored AS (SELECT video_id, camera_id, t0, t1, channel, max(score) AS score FROM s0 GROUP BY ALL HAVING round(max(score), 9) >= 0.2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY round(score, 9) DESC, video_id, t0, t1) AS rank FROM scored),
fused AS (SELECT video_id, camera_id, t0, t1, string_agg(channel, ',' ORDER BY channel) AS channels, max(score) AS best, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM ranked GROUP BY ALL)
"""
_CLUSTER = f"""WITH {_RANKED},
m AS (SELECT *, max(t1) OVER (PARTITION BY video_id, camera_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fused),
i AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR t0 > reach + {2 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, camera_id ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM m)
SELECT video_id, camera_id, island, min(t0) AS t0, max(t1) AS t1, count(*) AS members, round(max(rrf), 6) AS priority FROM i GROUP BY ALL"""


def evidence_top3(spark, d):
    return _round(retrieve.best_evidence(_hits(spark, d), WINDOW).select(*WINDOW, "tick_id", "score", "rank"), "score")


def coverage_report(spark, d):
    return _round(ledger.coverage(src.ticks(spark, d), ["video_id", "camera_id"]), "coverage")


def ledger_last_state(spark, d):
    t = src.ticks(spark, d).withColumn("slot", F.floor(F.col("pts") / HOUR))
    return ledger.last_state(t, ["video_id", "slot"], "pts", "status")


def pending_ticks(spark, d):
    planned = ledger.expected_ticks(src.videos(spark, d).select("video_id", "duration"), HOUR)
    done = src.ticks(spark, d).where("status = 'embedded'").select("video_id", (F.floor(F.col("pts") / HOUR) * HOUR).alias("target_pts")).distinct()
    return ledger.only_new(planned, done, ["video_id", "target_pts"])


def nearest_frame(spark, d):
    planned = ledger.expected_ticks(src.videos(spark, d).select("video_id", "duration"), HOUR)
    return intervals.nearest_join(planned, src.ticks(spark, d).select("video_id", "pts", "tick_id").withColumnRenamed("pts", "target_pts"), ["video_id"], "target_pts", "tick_id").drop("error_code")


def motion_merge(spark, d):
    t = src.ticks(spark, d).join(src.videos(spark, d), ["video_id", "camera_id"]).where("score >= 0.3").select("video_id", "pts", "duration")
    return ledger.motion_intervals(t, HOUR // 2)


def contains_edges(spark, d):
    return _hits(spark, d).select("tick_id", "scale", "t0")


def co_occurs_edges(spark, d):
    return graph.co_occurs(src.detections(spark, d)).groupBy("frame_id").agg(F.count("*").alias("edges"), F.sum("subject").alias("subjects"))


def belongs_to_track_edges(spark, d):
    """Bridge rows of every tick; detections are the embedded ticks, tracklets the actors with a purchase."""
    t = src.ticks(spark, d)
    bridge = t.select(F.col("actor").alias("tracklet"), F.col("tick_id").alias("detection"))
    seen = t.where("status = 'embedded'").select(F.col("tick_id").alias("detection"), "pts")
    return graph.track_edges(bridge, seen, t.where("label = 'purchase'").select(F.col("actor").alias("tracklet")).distinct())


def text_search(spark, d):
    docs = src.parquet(spark, d, "documents")
    return docs.where(label_match(F.col("text"), "the AND")).select("doc_id", "lang")


def label_match_parts(spark, d):
    return src.parquet(spark, d, "orders").where(label_match(F.col("o_orderpriority"), "high")).select("o_orderkey", "o_orderpriority")


def _graph(spark, d):
    c, o = src.parquet(spark, d, "customer"), src.parquet(spark, d, "orders")
    nodes = c.select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_mktsegment").alias("label")).unionByName(o.select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.col("o_orderpriority").alias("label")))
    placed = o.select(F.concat(F.lit("c"), "o_custkey").alias("subject"), F.lit("placed").alias("predicate"), F.concat(F.lit("o"), "o_orderkey").alias("object"))
    supplied = src.parquet(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("o"), "l_orderkey").alias("subject"), F.lit("returned_by").alias("predicate"), F.concat(F.lit("s"), "l_suppkey").alias("object")).distinct()
    return nodes, placed.unionByName(supplied)


def pattern_join(spark, d):
    return graph.pattern(*_graph(spark, d), "BUILDING", "placed", "1-URGENT")


def pattern_optional_edge(spark, d):
    return graph.pattern(*_graph(spark, d), "BUILDING", "placed", "1-URGENT", "returned_by")


_GRAPH = """
nodes AS (SELECT 'c' || c_custkey AS node, c_mktsegment AS label FROM customer UNION ALL SELECT 'o' || o_orderkey, o_orderpriority FROM orders),
edges AS (SELECT 'c' || o_custkey AS subject, 'placed' AS predicate, 'o' || o_orderkey AS object FROM orders
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'returned_by', 's' || l_suppkey FROM lineitem WHERE l_returnflag = 'R'),
ab AS (SELECT a.node AS a, b.node AS b FROM edges e JOIN nodes a ON a.node = e.subject AND a.label = 'BUILDING' JOIN nodes b ON b.node = e.object AND b.label = '1-URGENT' WHERE e.predicate = 'placed')
"""


def _day(spark, d):
    return src.ticks(spark, d).withColumn("day", F.floor(F.col("pts") / (24 * HOUR)))


def observation_safety(spark, d):
    return graph.safety(_day(spark, d), ["video_id", "day"])


def visible_none(spark, d):
    t = _day(spark, d)
    s = graph.safety(t, ["video_id", "day"])
    m = t.where("label = 'purchase'").groupBy("video_id", "day").agg(F.count("*").alias("matches"))
    both = s.join(m, ["video_id", "day"], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return both.select("video_id", "day", graph.visible_none(F.col("matches"), F.col("observed") >= F.col("expected"), F.col("assessable") > 0).alias("state"))


def bounded_count(spark, d):
    """Tracks of an hour of all videos of a parity: some hours have tracks of several cameras. Every third actor's tracks are fragments of one."""
    t = src.ticks(spark, d).where("label = 'purchase'")
    t = t.select(
        F.floor(F.col("pts") / HOUR).alias("hour"), (F.expr("cast(substring(video_id, 2) AS BIGINT)") % 4).alias("part"), "video_id", "camera_id", F.when(F.col("actor") % 3 == 0, F.concat(F.lit("g"), "actor")).alias("fragment_group"),
        F.concat(F.lit("t"), "tick_id").alias("tracklet_id"), F.when(F.col("status") == "embedded", "continuous").otherwise("interrupted").alias("continuity"),
    )
    return graph.bounded_count(t, ["hour", "part"], 1, 2, 1)


def _anchors(spark, d, label):
    return src.ticks(spark, d).where(F.col("label") == label).select(F.col("tick_id").alias("id"), "video_id", "camera_id", F.col("pts").alias("t0"), F.col("pts").alias("t1"), "actor", "score")


def temporal_before(spark, d):
    return assemble.temporal_pairs(_anchors(spark, d, "click"), _anchors(spark, d, "purchase"), 6 * HOUR).select(F.col("l.id").alias("first_id"), F.col("r.id").alias("second_id"), "gap")


def same_actor_join(spark, d):
    return assemble.temporal_pairs(_anchors(spark, d, "click"), _anchors(spark, d, "purchase"), 6 * HOUR, same_actor=True).select(F.col("l.id").alias("first_id"), F.col("r.id").alias("second_id"), "gap")


def three_atom_episode(spark, d):
    a, b, c = (_anchors(spark, d, x) for x in ("view", "click", "purchase"))
    e = assemble.episodes({"a": a, "b": b, "c": c}, [("a", "b", HOUR, False), ("b", "c", HOUR, False)])
    return e.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("c.id").alias("c"), F.col("a.t0").alias("t0"), F.col("c.t1").alias("t1"))


_ANCHORS = f"{_TICKS}, p AS (SELECT a.tick_id AS first_id, b.tick_id AS second_id, b.pts - a.pts AS gap, a.actor = b.actor AS same FROM ticks a JOIN ticks b ON a.video_id = b.video_id AND a.camera_id = b.camera_id AND b.pts - a.pts BETWEEN 0 AND {6 * HOUR} WHERE a.label = 'click' AND b.label = 'purchase')"


def interval_cluster(spark, d):
    i = intervals.islands(src.order_intervals(spark, d), ["camera"], "t0", "t1", ["o_orderkey"], 12, 24 * 30)
    return i.groupBy("camera", "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count("*").alias("members"))


def t_iou_pairs(spark, d):
    i = src.order_intervals(spark, d)
    p0 = F.col("t0") + F.col("o_orderkey") % 5
    return i.select("o_orderkey", F.round(t_iou(F.col("t0"), F.col("t1"), p0, p0 + 40), 6).alias("tiou"))


def interval_recall(spark, d):
    i = src.order_intervals(spark, d).withColumn("p0", F.col("t0") + F.col("o_orderkey") % 5)
    i = i.withColumn("hit", t_iou(F.col("t0"), F.col("t1"), F.col("p0"), F.col("p0") + 40) >= 0.5)
    return i.groupBy("camera").agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("recall"), F.bool_and("hit").alias("complete"))


_IOU = """i AS (SELECT o_orderkey, o_custkey % 16 AS camera, epoch_us(o_orderdate) // 3600000000 AS t0 FROM orders),
j AS (SELECT *, t0 + 24 + o_orderkey % 72 AS t1, t0 + o_orderkey % 5 AS p0, t0 + o_orderkey % 5 + 40 AS p1 FROM i),
k AS (SELECT *, greatest(least(t1, p1) - greatest(t0, p0), 0)::DOUBLE AS inter, (t1 - t0) + (p1 - p0) AS len FROM j),
u AS (SELECT *, CASE WHEN len - inter > 0 THEN inter / (len - inter) ELSE 0 END AS tiou FROM k)"""


def _labels(spark, d):
    names = lambda c, v: F.when(F.col(c) == 1, v).otherwise("contradicted")
    lab = src.parquet(spark, d, "labels")
    return lab.select("doc_id", names("quality", "supported").alias("truth"), F.when(F.col("doc_id") % 7 == 0, "undetermined").otherwise(names("toxic", "supported")).alias("predicted"))


def class_scores(spark, d):
    return _round(evaluate.class_scores(_labels(spark, d)), "precision", "recall", "f1")


def macro_f1(spark, d):
    return evaluate.class_scores(_labels(spark, d)).agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.sum("support").cast("long").alias("support"))


_CLASSES = """l AS (SELECT CASE WHEN quality = 1 THEN 'supported' ELSE 'contradicted' END AS truth,
  CASE WHEN doc_id % 7 = 0 THEN 'undetermined' WHEN toxic = 1 THEN 'supported' ELSE 'contradicted' END AS predicted FROM labels),
c AS (SELECT truth AS class, count(*) AS support, count(*) FILTER (truth = predicted) AS tp FROM l GROUP BY ALL),
s AS (SELECT predicted AS class, count(*) AS said FROM l GROUP BY ALL),
pr AS (SELECT c.class, support, CASE WHEN coalesce(said, 0) > 0 THEN tp::DOUBLE / said ELSE 0 END AS p, tp::DOUBLE / support AS r FROM c LEFT JOIN s ON c.class = s.class),
f AS (SELECT class, support, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr)"""


def latency_percentiles(spark, d):
    return _round(evaluate.latency(src.parquet(spark, d, "events").withColumnRenamed("value", "ms"), ["event_type"], "ms"), "p50", "p95", "p95_rank", "mean")


def boundary_error(spark, d):
    return src.order_intervals(spark, d).groupBy("camera").agg(F.median(F.abs(F.col("o_orderkey") % 5).cast("double")).alias("onset"), F.round(F.avg(F.abs(F.col("t1") - F.col("t0") - 40)), 6).alias("offset_mean"))


def split_leakage(spark, d):
    o = src.parquet(spark, d, "orders").withColumn("split", F.concat(F.lit("s"), F.col("o_orderkey") % 3))
    return evaluate.leaks(o, "o_custkey", "split")


def dataset_summary(spark, d):
    docs = src.parquet(spark, d, "documents")
    return docs.cube("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("int").alias("level"))


def _evidence(spark, d):
    li = src.parquet(spark, d, "lineitem")
    state = F.when(F.col("l_returnflag") == "N", "supported").when(F.col("l_returnflag") == "A", F.when(F.col("l_linestatus") == "O", "undetermined").otherwise("contradicted")).otherwise("unobservable")
    return li.select(F.col("l_orderkey").alias("candidate"), F.col("l_linenumber").alias("constraint"), state.alias("state"))


def _judged(spark, d):
    """Candidates whose verification has the two required constraints; lines 1 and 2 of an order."""
    e = _evidence(spark, d)
    whole = e.where("constraint IN (1, 2)").groupBy(F.col("candidate").alias("c")).agg(F.countDistinct("constraint").alias("n")).where("n = 2")
    return decide.candidates(e.join(whole, F.col("candidate") == F.col("c"), "left_semi"), [1, 2])


def decide_candidates(spark, d):
    return _judged(spark, d)


def near_miss_rank(spark, d):
    rows = _judged(spark, d).withColumn("priority", (F.col("candidate") % 10) / 10)
    return decide.near_misses(rows).select("candidate", "supported", "contradicted", "rank")


def archive_conclusion(spark, d):
    """Archives of two neighbouring candidates at most; of five archives one was cut short."""
    rows = _judged(spark, d).withColumn("archive", F.floor(F.col("candidate") / 2))
    return decide.conclusion(rows, ["archive"], F.col("archive") % 5 != 0, mixed="insufficient_visual_evidence")


_DECIDED = """e AS (SELECT l_orderkey AS candidate, l_linenumber AS k, CASE WHEN l_returnflag = 'N' THEN 'supported' WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'O' THEN 'undetermined' ELSE 'contradicted' END ELSE 'unobservable' END AS state FROM lineitem WHERE l_linenumber IN (1, 2)),
f AS (SELECT candidate, count(*) FILTER (state = 'supported') AS supported, count(*) FILTER (state = 'contradicted') AS contradicted, count(*) FILTER (state = 'unobservable') AS unobservable, count(*) FILTER (state = 'undetermined') AS undetermined FROM e GROUP BY candidate HAVING count(DISTINCT k) = 2),
dc AS (SELECT candidate, supported = 2 AS verified_match, contradicted > 0 AS rejected_near_match, contradicted = 0 AND unobservable > 0 AS unresolved_visual, contradicted = 0 AND undetermined > 0 AS unresolved_system, supported, contradicted, unobservable, undetermined FROM f)"""


def budget_split(spark, d):
    return decide.within_budget(search_flagship(spark, d), 10).select("video_id", "t0", "rank", "state")


def boundary_refine(spark, d):
    t = _hits(spark, d).where(F.col("scale") == 30 * HOUR)
    hot = F.col("score") >= 0.3
    g = t.groupBy("video_id", "camera_id", "t0", "t1").agg(F.min(F.when(hot, F.col("pts"))).alias("a"), F.max(F.when(hot, F.col("pts"))).alias("b"))
    return g.select("video_id", "camera_id", "t0", "t1", F.greatest(F.coalesce("a", "t0") - HOUR, "t0").alias("onset"), F.least(F.coalesce("b", "t1") + HOUR, "t1").alias("offset"))


def detection_resume_check(spark, d):
    old = src.ticks(spark, d).where("tick_id % 5 <> 0").select("tick_id", "label")
    new = src.ticks(spark, d).where("tick_id % 7 <> 0").select("tick_id", F.when(F.col("tick_id") % 11 == 0, "changed").otherwise(F.col("label")).alias("label_new"))
    j = old.join(new, "tick_id", "full_outer")
    state = F.when(F.col("label").isNull(), "added").when(F.col("label_new").isNull(), "missing").when(F.col("label") != F.col("label_new"), "diverged").otherwise("same")
    return j.groupBy(state.alias("state")).count().withColumnRenamed("count", "n")


def window_stream(spark, d):
    return _round(streams.windowed(src.ticks(spark, d)), "score").withColumns({c: F.expr(f"timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast({c} as timestamp_ntz))") for c in ("t0", "t1")})


def tracklets(spark, d):
    t = src.ticks(spark, d)
    x = (F.col("actor") % 5) / 10.0
    boxes = t.select("video_id", "camera_id", F.col("tick_id").alias("detection_id"), "pts", "label", x.alias("x0"), F.lit(0.1).alias("y0"), (x + 0.3).alias("x1"), F.lit(0.5).alias("y1"))
    return tracks.associate(boxes, 12 * HOUR, 6 * HOUR)


QUERIES = {
    "search_flagship": search_flagship, "exact_score": exact_score, "exact_score_topk": exact_score_topk, "tick_generation": tick_generation, "window_generation": window_generation,
    **{f"window_{how}": _window(how) for how in retrieve.AGGREGATES},
    "scope_filter": scope_filter, "window_clip": window_clip, "rrf_order": rrf_order, "evidence_top3": evidence_top3, "coverage_report": coverage_report, "ledger_last_state": ledger_last_state,
    "pending_ticks": pending_ticks, "nearest_frame": nearest_frame, "motion_merge": motion_merge, "contains_edges": contains_edges, "co_occurs_edges": co_occurs_edges, "belongs_to_track_edges": belongs_to_track_edges,
    "text_search": text_search, "label_match": label_match_parts, "pattern_join": pattern_join, "pattern_optional_edge": pattern_optional_edge, "observation_safety": observation_safety, "visible_none": visible_none,
    "bounded_count": bounded_count, "temporal_before": temporal_before, "same_actor_join": same_actor_join, "three_atom_episode": three_atom_episode, "interval_cluster": interval_cluster, "t_iou_pairs": t_iou_pairs,
    "interval_recall": interval_recall, "class_scores": class_scores, "macro_f1": macro_f1, "latency_percentiles": latency_percentiles, "boundary_error": boundary_error, "split_leakage": split_leakage,
    "dataset_summary": dataset_summary, "decide_candidates": decide_candidates, "near_miss_rank": near_miss_rank, "archive_conclusion": archive_conclusion, "budget_split": budget_split,
    "boundary_refine": boundary_refine, "detection_resume_check": detection_resume_check, "window_stream": window_stream, "tracklets": tracklets,
}

_T = f"WITH {_TICKS} "
_DAY = f"WITH {_TICKS}, t AS (SELECT *, pts // {24 * HOUR} AS day FROM ticks), s AS (SELECT video_id, day, count(*) AS expected, count(*) FILTER (status <> 'skipped') AS observed, count(*) FILTER (status = 'embedded') AS assessable, bool_and(status = 'embedded') AS complete, count(*) FILTER (label = 'purchase') AS matches FROM t GROUP BY ALL) "
ORACLE_SQL = {
    "search_flagship": _CLUSTER,
    "exact_score": _EXACT,
    "exact_score_topk": f"SELECT * FROM ({_EXACT}) ORDER BY score DESC, vec_id LIMIT 20",
    "tick_generation": _T + f"SELECT video_id, unnest(generate_series(0, (duration - 1) // {HOUR})) * {HOUR} AS target_pts FROM videos",
    "window_generation": _T + "SELECT * FROM windows",
    "window_max": _T + f"SELECT {_W}, round(max(score), 9) AS score FROM hits GROUP BY ALL",
    "window_mean": _T + f"SELECT {_W}, round(sum(score), 9) / count(*) AS score FROM hits GROUP BY {_W}",
    "window_top20_mean": _T + f", r AS (SELECT *, row_number() OVER (PARTITION BY {_W} ORDER BY score DESC, tick_id) AS rn, count(*) OVER (PARTITION BY {_W}) AS n FROM hits) SELECT {_W}, round(avg(score), 9) AS score FROM r WHERE rn <= greatest(1, ceil(n * 0.2::DOUBLE)) GROUP BY {_W}",
    "window_persistence": _T + f"SELECT {_W}, (count(*) FILTER (score >= 0.3))::DOUBLE AS score FROM hits GROUP BY {_W}",
    "scope_filter": _T + f"SELECT * FROM windows WHERE camera_id = 'cam1' AND t1 >= {100 * HOUR} AND t0 <= {200 * HOUR}",
    "window_clip": _T + f"SELECT DISTINCT video_id, camera_id, scale, greatest(t0, {100 * HOUR}) AS t0, least(t1, {200 * HOUR}) AS t1 FROM windows WHERE t0 < {200 * HOUR} AND t1 > {100 * HOUR}",
    "rrf_order": f"WITH {_RANKED} SELECT video_id, camera_id, t0, t1, channels, round(best, 6) AS best, round(rrf, 6) AS rrf FROM fused",
    "evidence_top3": _T + f", r AS (SELECT *, row_number() OVER (PARTITION BY {_W} ORDER BY score DESC, pts, tick_id) AS rank FROM hits) SELECT {_W}, tick_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3",
    "coverage_report": _T + "SELECT video_id, camera_id, count(*) AS expected, count(*) FILTER (status = 'embedded') AS embedded, count(*) FILTER (status = 'decode_failed') AS decode_failed, count(*) FILTER (status = 'skipped') AS skipped, round((count(*) FILTER (status = 'embedded'))::DOUBLE / count(*), 6) AS coverage FROM ticks GROUP BY ALL",
    "ledger_last_state": _T + f"SELECT video_id, pts // {HOUR} AS slot, arg_max(status, pts) AS status, max(pts) AS seq FROM ticks GROUP BY ALL",
    "pending_ticks": _T + f", p AS (SELECT video_id, unnest(generate_series(0, (duration - 1) // {HOUR})) * {HOUR} AS target_pts FROM videos) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM ticks t WHERE status = 'embedded' AND t.video_id = p.video_id AND t.pts // {HOUR} * {HOUR} = p.target_pts)",
    "nearest_frame": _T + f", p AS (SELECT video_id, unnest(generate_series(0, (duration - 1) // {HOUR})) * {HOUR} AS target_pts FROM videos), b AS (SELECT p.*, t.tick_id AS bi, t.pts AS bp FROM p ASOF LEFT JOIN ticks t ON p.video_id = t.video_id AND p.target_pts >= t.pts), a AS (SELECT b.*, t.tick_id AS ai, t.pts AS ap FROM b ASOF LEFT JOIN ticks t ON b.video_id = t.video_id AND b.target_pts <= t.pts) SELECT video_id, target_pts, CASE WHEN bp IS NULL OR ap - target_pts < target_pts - bp THEN ai ELSE bi END AS frame_id, CASE WHEN bp IS NULL OR ap - target_pts < target_pts - bp THEN ap ELSE bp END AS frame_pts FROM a",
    "motion_merge": _T + f", p AS (SELECT video_id, greatest(pts - {HOUR // 2}, 0) AS t0, least(pts + {HOUR // 2}, duration) AS t1 FROM ticks JOIN videos USING (video_id, camera_id) WHERE score >= 0.3), m AS (SELECT *, max(t1) OVER (PARTITION BY video_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p), i AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR t0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM m) SELECT video_id, island, min(t0) AS t0, max(t1) AS t1, count(*) AS samples FROM i GROUP BY ALL",
    "contains_edges": _T + "SELECT tick_id, scale, t0 FROM hits",
    "co_occurs_edges": "SELECT a.l_orderkey AS frame_id, 2 * count(*) AS edges, CAST(sum(a.l_linenumber + b.l_linenumber) AS BIGINT) AS subjects FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber > a.l_linenumber GROUP BY ALL",
    "belongs_to_track_edges": _T + "SELECT 'd' || tick_id AS subject, 'belongs_to_track' AS predicate, 't' || actor AS object, pts AS t0 FROM ticks WHERE status = 'embedded' AND actor IN (SELECT actor FROM ticks WHERE label = 'purchase')",
    "text_search": "SELECT doc_id, lang FROM documents WHERE list_has_all(regexp_split_to_array(lower(trim(text)), '[^a-z0-9]+'), ['the', 'and'])",
    "label_match": "SELECT o_orderkey, o_orderpriority FROM orders WHERE list_contains(regexp_split_to_array(lower(o_orderpriority), '[^a-z0-9]+'), 'high')",
    "pattern_join": f"WITH {_GRAPH} SELECT a, b FROM ab",
    "pattern_optional_edge": f"WITH {_GRAPH} SELECT a, b, e.object AS c FROM ab LEFT JOIN edges e ON e.subject = ab.b AND e.predicate = 'returned_by'",
    "observation_safety": _DAY + "SELECT video_id, day, expected, observed, assessable, complete FROM s",
    "visible_none": _DAY + "SELECT video_id, day, CASE WHEN observed < expected THEN 'undetermined' WHEN assessable = 0 THEN 'unobservable' WHEN matches > 0 THEN 'contradicted' ELSE 'supported' END AS state FROM s",
    "bounded_count": _T + f", t AS (SELECT pts // {HOUR} AS hour, CAST(video_id[2:] AS BIGINT) % 4 AS part, video_id || camera_id AS cam, CASE WHEN actor % 3 = 0 THEN 'g' || actor END AS fg, coalesce(CASE WHEN actor % 3 = 0 THEN 'g' || actor END, 't' || tick_id) AS g, status <> 'embedded' AS broke FROM ticks WHERE label = 'purchase'), s AS (SELECT hour, part, count(DISTINCT g) AS observed, count(*) FILTER (broke) AS broken, count(fg) - count(DISTINCT fg) AS fragments, count(DISTINCT cam) > 1 AS several_cameras FROM t GROUP BY ALL), r AS (SELECT *, CASE WHEN several_cameras THEN 'cross_camera_count' WHEN broken + fragments > 1 THEN 'excessive_track_fragmentation' WHEN observed BETWEEN 1 AND 2 THEN 'count_within_bounds' ELSE 'count_out_of_bounds' END AS reason FROM s) SELECT *, CASE reason WHEN 'count_within_bounds' THEN 'supported' WHEN 'count_out_of_bounds' THEN 'contradicted' ELSE 'undetermined' END AS state FROM r",
    "temporal_before": f"WITH {_ANCHORS} SELECT first_id, second_id, gap FROM p",
    "same_actor_join": f"WITH {_ANCHORS} SELECT first_id, second_id, gap FROM p WHERE same",
    "three_atom_episode": _T + f"SELECT a.tick_id AS a, b.tick_id AS b, c.tick_id AS c, a.pts AS t0, c.pts AS t1 FROM ticks a JOIN ticks b ON a.video_id = b.video_id AND a.camera_id = b.camera_id AND b.pts - a.pts BETWEEN 0 AND {HOUR} JOIN ticks c ON b.video_id = c.video_id AND b.camera_id = c.camera_id AND c.pts - b.pts BETWEEN 0 AND {HOUR} WHERE a.label = 'view' AND b.label = 'click' AND c.label = 'purchase'",
    "interval_cluster": f"WITH {_IOU}, m AS (SELECT *, max(t1) OVER (PARTITION BY camera ORDER BY t0, t1, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM j), g AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR t0 > reach + 12 THEN 1 ELSE 0 END) OVER (PARTITION BY camera ORDER BY t0, t1, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM m) SELECT camera, island, min(t0) AS t0, max(t1) AS t1, count(*) AS members FROM g GROUP BY ALL",
    "t_iou_pairs": f"WITH {_IOU} SELECT o_orderkey, round(tiou, 6) AS tiou FROM u",
    "interval_recall": f"WITH {_IOU} SELECT camera, round(avg((tiou >= 0.5)::INT::DOUBLE), 6) AS recall, bool_and(tiou >= 0.5) AS complete FROM u GROUP BY camera",
    "class_scores": f"WITH {_CLASSES} SELECT class, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f",
    "macro_f1": f"WITH {_CLASSES} SELECT round(avg(f1), 6) AS macro_f1, CAST(sum(support) AS BIGINT) AS support FROM f",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.95), 6) AS p95_rank, round(avg(value), 6) AS mean, count(*) AS runs FROM events GROUP BY ALL",
    "boundary_error": f"WITH {_IOU} SELECT camera, median((o_orderkey % 5)::DOUBLE) AS onset, round(avg(abs(t1 - t0 - 40)), 6) AS offset_mean FROM u GROUP BY camera",
    "split_leakage": "SELECT o_custkey, count(DISTINCT o_orderkey % 3) AS splits FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderkey % 3) > 1",
    "dataset_summary": "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(grouping(lang, source) AS INT) AS level FROM documents GROUP BY CUBE (lang, source)",
    "decide_candidates": f"WITH {_DECIDED} SELECT * FROM dc",
    "near_miss_rank": f"WITH {_DECIDED} SELECT candidate, supported, contradicted, CAST(row_number() OVER (ORDER BY supported DESC, contradicted, (candidate % 10) / 10.0 DESC, candidate) AS INT) AS rank FROM dc WHERE rejected_near_match",
    "archive_conclusion": f"WITH {_DECIDED}, a AS (SELECT *, candidate // 2 AS archive FROM dc) SELECT archive, CASE WHEN bool_or(verified_match) THEN 'verified_matches_found' WHEN archive % 5 = 0 THEN 'search_incomplete' WHEN bool_or(unresolved_visual) THEN 'insufficient_visual_evidence' WHEN bool_or(unresolved_system) THEN 'not_applicable' ELSE 'no_verified_match' END AS conclusion, count(*) FILTER (verified_match) AS matches, count(*) FILTER (rejected_near_match) AS near_misses FROM a GROUP BY archive",
    "budget_split": f"WITH c AS ({_CLUSTER}), r AS (SELECT *, CAST(row_number() OVER (ORDER BY priority DESC, video_id, t0, t1) AS INT) AS rank FROM c) SELECT video_id, t0, rank, CASE WHEN rank <= 10 THEN 'verify' ELSE 'timeout' END AS state FROM r",
    "boundary_refine": _T + f", g AS (SELECT video_id, camera_id, t0, t1, min(pts) FILTER (score >= 0.3) AS a, max(pts) FILTER (score >= 0.3) AS b FROM hits WHERE scale = {30 * HOUR} GROUP BY ALL) SELECT video_id, camera_id, t0, t1, greatest(coalesce(a, t0) - {HOUR}, t0) AS onset, least(coalesce(b, t1) + {HOUR}, t1) AS offset FROM g".replace(" AS offset", ' AS "offset"'),
    "detection_resume_check": _T + ", o AS (SELECT tick_id, label FROM ticks WHERE tick_id % 5 <> 0), n AS (SELECT tick_id, CASE WHEN tick_id % 11 = 0 THEN 'changed' ELSE label END AS label FROM ticks WHERE tick_id % 7 <> 0) SELECT CASE WHEN o.tick_id IS NULL THEN 'added' WHEN n.tick_id IS NULL THEN 'missing' WHEN o.label <> n.label THEN 'diverged' ELSE 'same' END AS state, count(*) AS n FROM o FULL JOIN n ON o.tick_id = n.tick_id GROUP BY 1",
    "window_stream": _T + ", w AS (SELECT label, score, unnest([h, h - 2]) AS t0, hh FROM (SELECT label, score, pts / 3600000000.0 AS hh, (pts // 7200000000) * 2 AS h FROM ticks)) SELECT t0, t0 + 4 AS t1, label, count(*) AS ticks, round(max(score), 6) AS score FROM w GROUP BY ALL",
}
