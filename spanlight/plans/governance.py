"""Queries about evaluation, annotation and the archive's upkeep, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import bbox_iou, valid_box
from ..operators import assemble, evaluate, fuse, graph, intervals, ledger, retrieve
from ..sources import tables as src
from . import catalogue as base

HOUR = ledger.HOUR
SCOPE = "video_id, camera_id, t0, t1"
LIMITS = {"click": 0.3, "view": 0.25, "purchase": 0.2, "signup": 0.35, "logout": 0.4}


def _truth(spark, d):
    return src.order_intervals(spark, d).withColumnRenamed("o_orderkey", "id")


def _found(spark, d):
    t = _truth(spark, d).where("id % 6 <> 0").withColumn("t0", F.col("t0") + F.col("id") % 5)
    return t.withColumn("t1", F.col("t0") + 40)


def _best(spark, d, found):
    return evaluate.best_overlap(_truth(spark, d), found, ["camera"], 96)


def complete_set_recall(spark, d):
    whole = _best(spark, d, _found(spark, d)).groupBy("camera").agg(F.bool_and(F.col("best") >= 0.9).alias("whole"))
    return whole.agg(F.round(F.avg(F.col("whole").cast("double")), 6).alias("recall"), F.count("*").alias("queries"))


def candidate_recall(spark, d):
    return _best(spark, d, _found(spark, d)).groupBy("camera").agg(F.round(F.avg((F.col("best") >= 0.9).cast("double")), 6).alias("recall"))


def recall_at_budget(spark, d):
    first = _found(spark, d).withColumn("rank", intervals.rank_by(["camera"], F.col("t0"), F.col("id"))).where("rank <= 20").drop("rank")
    return _best(spark, d, first).groupBy("camera").agg(F.round(F.avg((F.col("best") > 0).cast("double")), 6).alias("recall"))


def greedy_match(spark, d):
    m = evaluate.greedy_match(_truth(spark, d), _found(spark, d), "camera", 96)
    return m.withColumn("iou", F.round("iou", 6))


_BEST = """i AS (SELECT o_orderkey AS id, o_custkey % 16 AS camera, epoch_us(o_orderdate) // 3600000000 AS t0 FROM orders),
g AS (SELECT *, t0 + 24 + id % 72 AS t1 FROM i), f AS (SELECT id, camera, t0 + id % 5 AS t0, t0 + id % 5 + 40 AS t1 FROM i WHERE id % 6 <> 0),
fr AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY t0, id) AS rank FROM f),
pairs AS (SELECT g.id, g.camera, f.rank, (least(g.t1, f.t1) - greatest(g.t0, f.t0))::DOUBLE AS inter, g.t1 - g.t0 + 40 AS len FROM g JOIN fr f ON g.camera = f.camera AND g.t0 < f.t1 AND f.t0 < g.t1),
best AS (SELECT g.id, g.camera, coalesce(max(inter / (len - inter)), 0) AS best, coalesce(max(inter / (len - inter)) FILTER (rank <= 20), 0) AS best20 FROM g LEFT JOIN pairs p ON g.id = p.id GROUP BY ALL)"""


def _families(spark, d):
    o = src.parquet(spark, d, "orders")
    return o.select((F.col("o_orderkey") % 3 == 0).alias("is_empty"), (F.col("o_custkey") % 3 == 0).alias("returned_empty"))


def rejection_f1(spark, d):
    return base._round(evaluate.rejection(_families(spark, d)), "precision", "recall", "f1")


def prf_micro(spark, d):
    lab = src.parquet(spark, d, "labels")
    n = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    return base._round(lab.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn")).select("tp", "fp", "fn", *evaluate.prf(F.col("tp"), F.col("fp"), F.col("fn"))), "precision", "recall", "f1")


def count_mae(spark, d):
    o = src.parquet(spark, d, "orders")
    said = lambda k, m: F.when(F.col(k) % m == 0, "unresolved").otherwise((F.col(k) % 9).cast("string"))
    return base._round(evaluate.count_error(o.select(said("o_custkey", 7).alias("pred"), said("o_orderkey", 11).alias("gt"))), "mae")


def bounded_logic(spark, d):
    pick = lambda c, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(c) % len(names) + 1).cast("int"))
    items = src.parquet(spark, d, "lineitem").select(
        pick("l_linenumber", "any", "visible_none", "count").alias("operator"), pick("l_orderkey", "satisfied", "unresolved", "2", "unobservable").alias("gt"),
        pick("l_partkey", "satisfied", "unresolved", "2", "not_satisfied").alias("pred"), (F.col("l_returnflag") == "R").alias("under_stress"),
    )
    return base._round(evaluate.bounded_logic(items), "accuracy", "abstention")


_ITEMS = """items AS (SELECT ['any', 'visible_none', 'count'][l_linenumber % 3 + 1] AS operator, ['satisfied', 'unresolved', '2', 'unobservable'][l_orderkey % 4 + 1] AS gt,
  ['satisfied', 'unresolved', '2', 'not_satisfied'][l_partkey % 4 + 1] AS pred, l_returnflag = 'R' AS stress FROM lineitem)"""


def _notes(spark, d):
    """Orders as targets: their customers' first passes, every fifth one an adjudication of two neighbours."""
    k = F.col("o_orderkey")
    o = src.parquet(spark, d, "orders")
    return o.select(
        k.alias("annotation_id"), F.col("o_custkey").alias("target"), F.when(k % 5 == 0, "adjudication").otherwise("independent").alias("pass_type"),
        F.when(k % 15 == 0, F.array(k - 1)).when(k % 5 == 0, F.array(k - 1, k + 5)).alias("adjudicates"), F.col("o_orderdate").alias("recorded_at"), (k % 4 != 0).alias("blind"),
    )


def annotation_ordering(spark, d):
    return evaluate.annotation_faults(_notes(spark, d))


def double_annotation(spark, d):
    families = src.parquet(spark, d, "customer").select(F.col("c_custkey").alias("family"))
    return base._round(evaluate.double_annotated(families, _notes(spark, d)), "fraction")


def _pair(spark, d):
    return base._anchors(spark, d, "click"), base._anchors(spark, d, "purchase")


def temporal_after(spark, d):
    click, purchase = _pair(spark, d)
    return assemble.temporal_pairs(purchase, click, 6 * HOUR).select(F.col("r.id").alias("first_id"), F.col("l.id").alias("second_id"), "gap")


def temporal_rejections(spark, d):
    return assemble.rejections(*_pair(spark, d), 6 * HOUR)


def threshold_union(spark, d):
    s = retrieve.window_scores(base._hits(spark, d), [*base.WINDOW, "label"], "max")
    s = s.groupBy("video_id", "camera_id", "t0", "t1", F.col("label").alias("channel")).agg(F.max("score").alias("score"))
    return base._round(fuse.union_merge(s, LIMITS), "best")


def pattern_any(spark, d):
    nodes, edges = base._graph(spark, d)
    b = graph.match_any(nodes, ["1-URGENT", "2-HIGH"]).withColumnRenamed("node", "object")
    a = graph.match_any(nodes, ["BUILDING"]).select(F.col("node").alias("subject"))
    return edges.where("predicate = 'placed'").join(a, "subject").join(b, "object").select(F.col("subject").alias("a"), F.col("object").alias("b"), "alternative")


def track_label_match(spark, d):
    t = src.ticks(spark, d)
    links = t.select(F.col("actor").alias("tracklet"), F.col("tick_id").alias("detection"))
    return graph.track_matches(links.select("tracklet").distinct(), links, t.where("label = 'purchase'").select(F.col("tick_id").alias("detection")))


def node_collisions(spark, d):
    o = src.parquet(spark, d, "orders")
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("payload"))
    new = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 10 == 0, "other").otherwise(F.col("o_orderpriority")).alias("payload"))
    return graph.put(new, old, "id", "payload").groupBy("state").agg(F.count("*").alias("n"))


def active_generation(spark, d):
    t = src.ticks(spark, d).withColumn("generation", F.col("tick_id") % 3)
    chosen = src.videos(spark, d).groupBy("video_id").agg(F.max(F.expr("cast(substring(video_id, 2) AS BIGINT) % 3")).alias("generation"))
    return src.active(t, chosen).select("video_id", "generation", "tick_id")


def tick_set_check(spark, d):
    t = src.ticks(spark, d)
    expected = t.select("tick_id")
    scored = t.where("status = 'embedded'").select("tick_id").unionByName(t.where("tick_id % 50 = 0").select((-F.col("tick_id") - 1).alias("tick_id"))).unionByName(t.where("tick_id % 31 = 1").select("tick_id"))
    return ledger.tick_set(expected, scored, "tick_id")


def pts_regression(spark, d):
    """Frames as a decoder hands them out: every fifth one late."""
    t = src.ticks(spark, d).withColumn("read", F.col("pts") + F.when(F.col("tick_id") % 5 == 0, 6 * HOUR).otherwise(0))
    return ledger.regressions(t, "video_id", "read").select("video_id", "tick_id", "previous_pts", "pts")


def overlapping_clips(spark, d):
    return ledger.windows(src.videos(spark, d), ((12 * HOUR, 6 * HOUR),)).drop("scale")


def refinement_ticks(spark, d):
    spans = ledger.windows(src.videos(spark, d), ((4 * HOUR, 2 * HOUR),))
    return ledger.refinement_ticks(spans, HOUR // 4)


def dense_ticks(spark, d):
    return ledger.dense_ticks(base.motion_merge(spark, d), HOUR // 4)


def evidence_targets(spark, d):
    return ledger.evidence_targets(ledger.windows(src.videos(spark, d)), HOUR).select(*base.WINDOW, "part", "target_pts")


def box_rates(spark, d):
    li = src.parquet(spark, d, "lineitem")
    box = F.struct(F.col("l_discount").alias("x0"), F.col("l_tax").alias("y0"), (F.col("l_discount") + 0.3).alias("x1"), (F.col("l_quantity") / 45).alias("y1"))
    fixed = F.struct(F.lit(0.05).alias("x0"), F.lit(0.05).alias("y0"), F.lit(0.25).alias("x1"), F.lit(0.55).alias("y1"))
    b = li.select("l_returnflag", valid_box(box).alias("valid"), bbox_iou(box, fixed).alias("iou"))
    return b.groupBy("l_returnflag").agg(F.count_if("valid").alias("valid"), F.count("*").alias("boxes"), F.round(F.avg(F.when(F.col("valid"), F.col("iou"))), 6).alias("mean_iou"))


QUERIES = {
    f.__name__: f
    for f in (
        complete_set_recall, candidate_recall, recall_at_budget, greedy_match, rejection_f1, prf_micro, count_mae, bounded_logic, annotation_ordering, double_annotation, temporal_after, temporal_rejections,
        threshold_union, pattern_any, track_label_match, node_collisions, active_generation, tick_set_check, pts_regression, overlapping_clips, refinement_ticks, dense_ticks, evidence_targets, box_rates,
    )
}

_T = base._T
_PRF = "round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1"
_NOTES = """n AS (SELECT o_orderkey AS id, o_custkey AS target, o_orderkey % 5 = 0 AS adj, CASE WHEN o_orderkey % 15 = 0 THEN [o_orderkey - 1] ELSE [o_orderkey - 1, o_orderkey + 5] END AS refs, o_orderdate AS made, o_orderkey % 4 <> 0 AS blind FROM orders),
r AS (SELECT id, made, unnest(refs) AS ref FROM n WHERE adj AND len(refs) = 2)"""
_LIMITS = "CASE channel " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in LIMITS.items()) + " END"
_CLICKS = f"{_T}, a AS (SELECT * FROM ticks WHERE label = 'click'), b AS (SELECT * FROM ticks WHERE label = 'purchase')"

ORACLE_SQL = {
    "complete_set_recall": f"WITH {_BEST}, w AS (SELECT camera, bool_and(best >= 0.9) AS whole FROM best GROUP BY camera) SELECT round(avg(whole::INT::DOUBLE), 6) AS recall, count(*) AS queries FROM w",
    "candidate_recall": f"WITH {_BEST} SELECT camera, round(avg((best >= 0.9)::INT::DOUBLE), 6) AS recall FROM best GROUP BY camera",
    "recall_at_budget": f"WITH {_BEST} SELECT camera, round(avg((best20 > 0)::INT::DOUBLE), 6) AS recall FROM best GROUP BY camera",
    "rejection_f1": f"WITH c AS (SELECT o_orderkey % 3 = 0 AS e, o_custkey % 3 = 0 AS r FROM orders), s AS (SELECT count(*) FILTER (e AND r) AS tp, count(*) FILTER (NOT e AND r) AS fp, count(*) FILTER (e AND NOT r) AS fn, count(*) FILTER (e) AS n_empty, count(*) FILTER (NOT e) AS n_nonempty FROM c) SELECT {_PRF}, n_empty, n_nonempty FROM s",
    "prf_micro": "WITH s AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn FROM labels) SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 6) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn), 6) ELSE 0 END AS recall, CASE WHEN tp > 0 THEN round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1 FROM s",
    "count_mae": "WITH s AS (SELECT CASE WHEN o_custkey % 7 <> 0 THEN o_custkey % 9 END AS p, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 9 END AS g FROM orders) SELECT round(avg(abs(p - g)), 6) AS mae, count(*) FILTER (p IS NULL OR g IS NULL) AS unresolved FROM s",
    "bounded_logic": f"WITH {_ITEMS} SELECT operator, count(*) AS n, round(avg((gt = pred)::INT::DOUBLE), 6) AS accuracy, round(count(*) FILTER (stress AND pred = 'unresolved')::DOUBLE / nullif(count(*) FILTER (stress), 0), 6) AS abstention, count(*) FILTER (gt IN ('unresolved', 'unobservable') AND pred <> 'unresolved') AS false_clean FROM items GROUP BY operator",
    "annotation_ordering": f"WITH {_NOTES} SELECT id AS annotation_id, 'not_two_passes' AS fault FROM n WHERE adj AND len(refs) <> 2 UNION SELECT r.id, 'unknown_pass' FROM r WHERE ref NOT IN (SELECT id FROM n) UNION SELECT r.id, 'not_independent' FROM r JOIN n ON r.ref = n.id AND n.adj UNION SELECT r.id, 'recorded_too_early' FROM r JOIN n ON r.ref = n.id AND r.made <= n.made UNION SELECT id, 'not_blind' FROM n WHERE NOT adj AND NOT blind AND target IN (SELECT target FROM n WHERE NOT adj GROUP BY target HAVING count(*) >= 2)",
    "double_annotation": f"WITH {_NOTES} SELECT round(avg((coalesce(p, 0) >= 2)::INT::DOUBLE), 6) AS fraction FROM customer LEFT JOIN (SELECT target, count(*) AS p FROM n WHERE NOT adj GROUP BY target) q ON target = c_custkey",
    "temporal_after": f"{_CLICKS} SELECT a.tick_id AS first_id, b.tick_id AS second_id, a.pts - b.pts AS gap FROM a JOIN b ON a.video_id = b.video_id AND a.camera_id = b.camera_id AND a.pts - b.pts BETWEEN 0 AND {6 * HOUR}",
    "temporal_rejections": f"{_CLICKS}, p AS (SELECT b.pts - a.pts AS gap FROM a JOIN b ON a.video_id = b.video_id AND a.camera_id = b.camera_id) SELECT count(*) FILTER (gap BETWEEN 0 AND {6 * HOUR}) AS accepted, count(*) FILTER (gap < 0) AS wrong_order_or_overlapping_anchors, count(*) FILTER (gap > {6 * HOUR}) AS maximum_gap_exceeded, (SELECT count(*) FROM a) * (SELECT count(*) FROM b) - count(*) AS cross_camera_or_video_join FROM p",
    "threshold_union": _T + f", s AS (SELECT {SCOPE}, label AS channel, max(score) AS score FROM hits GROUP BY ALL) SELECT {SCOPE}, string_agg(channel, ',' ORDER BY channel) AS channels, round(max(score), 6) AS best FROM s WHERE round(score, 9) >= {_LIMITS} GROUP BY {SCOPE}",
    "pattern_any": f"WITH {base._GRAPH} SELECT e.subject AS a, e.object AS b, CASE b.label WHEN '1-URGENT' THEN 0 ELSE 1 END AS alternative FROM edges e JOIN nodes a ON a.node = e.subject AND a.label = 'BUILDING' JOIN nodes b ON b.node = e.object AND b.label IN ('1-URGENT', '2-HIGH') WHERE e.predicate = 'placed'",
    "track_label_match": "SELECT DISTINCT user_id AS tracklet FROM events WHERE event_type = 'purchase'",
    "node_collisions": "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 10 = 0 THEN 'collision' ELSE 'same' END AS state, count(*) AS n FROM orders GROUP BY ALL",
    "active_generation": _T + "SELECT video_id, tick_id % 3 AS generation, tick_id FROM ticks WHERE tick_id % 3 = CAST(video_id[2:] AS BIGINT) % 3",
    "tick_set_check": _T + "SELECT count(*) FILTER (status <> 'embedded' AND tick_id % 31 <> 1) AS missing, count(*) FILTER (tick_id % 50 = 0) AS extra, count(*) FILTER (status = 'embedded' AND tick_id % 31 = 1) AS repeated FROM ticks",
    "pts_regression": _T + ", l AS (SELECT *, lag(pts) OVER (PARTITION BY video_id ORDER BY pts + CASE WHEN tick_id % 5 = 0 THEN 21600000000 ELSE 0 END, tick_id) AS previous_pts FROM ticks) SELECT video_id, tick_id, previous_pts, pts FROM l WHERE previous_pts > pts",
    "overlapping_clips": _T + f"SELECT video_id, camera_id, t0, t1 FROM windows WHERE scale = {12 * HOUR}",
    "refinement_ticks": _T + f"SELECT DISTINCT video_id, unnest(generate_series(t0, t1 - 1, {HOUR // 4})) AS target_pts FROM windows WHERE scale = {4 * HOUR}",
    "dense_ticks": f"WITH m AS ({base.ORACLE_SQL['motion_merge']}) SELECT DISTINCT video_id, unnest(generate_series(t0, t1, {HOUR // 4})) AS target_pts FROM m",
    "evidence_targets": _T + f", p AS (SELECT *, CAST(least(24, greatest(8, ceil((t1 - t0)::DOUBLE / {HOUR}))) AS BIGINT) AS n FROM windows), q AS (SELECT *, unnest(generate_series(0, n - 1)) AS part FROM p) SELECT {', '.join(base.WINDOW)}, part, t0 + ((t1 - t0) * (2 * part + 1)) // (2 * n) AS target_pts FROM q",
    "box_rates": "WITH b AS (SELECT l_returnflag, l_discount AS x0, l_tax AS y0, l_discount + 0.3::DOUBLE AS x1, l_quantity / 45 AS y1 FROM lineitem), v AS (SELECT *, greatest(x0, y0, x1, y1) <= 1 AND least(x0, y0) >= 0 AND x1 > x0 AND y1 > y0 AS valid, greatest(least(x1, 0.25::DOUBLE) - greatest(x0, 0.05::DOUBLE), 0) * greatest(least(y1, 0.55::DOUBLE) - greatest(y0, 0.05::DOUBLE), 0) AS i FROM b) SELECT l_returnflag, count(*) FILTER (valid) AS valid, count(*) AS boxes, round(avg(i / ((x1 - x0) * (y1 - y0) + 0.1::DOUBLE - i)) FILTER (valid), 6) AS mean_iou FROM v GROUP BY ALL",
}
