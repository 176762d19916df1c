"""Queries over the ledger, the evidence graph and the archive's upkeep, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import finite, frame_difference, in_group_scope, label_match, luminance, norm, normalised, payload, sharpness
from ..operators import assemble, boundary, checks, decide, fuse, graph, intervals, ledger, pattern, retrieve
from ..sources import tables as src
from ..sources.shared import materialize, new_path
from . import catalogue as base

HOUR = ledger.HOUR
DAY = 24 * HOUR
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_T = base._T
_LEDGER = f"""{_T}, led AS (SELECT *, CASE WHEN status = 'embedded' THEN tick_id + 1000000 END AS frame_id, CASE WHEN status = 'decode_failed' AND tick_id % 34 <> 0 THEN 'bad_packet' END AS error_code,
  CASE WHEN tick_id % 4 = 0 THEN 'motion' ELSE 'base' END AS lane FROM ticks),
frames AS (SELECT frame_id, video_id, camera_id, pts, (tick_id % 100)::DOUBLE / 100 AS luminance, (tick_id % 37)::DOUBLE AS sharpness FROM led WHERE frame_id IS NOT NULL AND tick_id % 13 <> 0)"""


def _ledger(spark, d):
    t = src.ticks(spark, d)
    k = F.col("tick_id")
    return t.withColumns({
        "frame_id": F.when(F.col("status") == "embedded", k + 1000000), "error_code": F.when((F.col("status") == "decode_failed") & (k % 34 != 0), "bad_packet"), "lane": F.when(k % 4 == 0, "motion").otherwise("base")
    })


def _frames(spark, d):
    k = F.col("tick_id")
    seen = _ledger(spark, d).where("frame_id IS NOT NULL AND tick_id % 13 <> 0")
    return seen.select("frame_id", "video_id", "camera_id", "pts", ((k % 100).cast("double") / 100).alias("luminance"), (k % 37).cast("double").alias("sharpness"))


@query(f"{_LEDGER} SELECT l.tick_id, l.video_id, l.pts, f.luminance FROM led l JOIN frames f ON l.frame_id = f.frame_id JOIN videos v ON l.video_id = v.video_id AND l.camera_id = v.camera_id WHERE l.status = 'embedded' AND l.lane = 'base' AND l.camera_id = 'cam1' AND l.pts >= {20 * HOUR} AND l.pts < {300 * HOUR} AND v.duration > {100 * HOUR}")
def embedded_tick_scan(spark, d):
    """Embedded ticks of a scope: the ledger, its frames and its videos."""
    t = _ledger(spark, d).where(f"status = 'embedded' AND lane = 'base' AND camera_id = 'cam1' AND pts >= {20 * HOUR} AND pts < {300 * HOUR}")
    seen = t.join(_frames(spark, d).select("frame_id", "luminance"), "frame_id")
    return seen.join(src.videos(spark, d).where(f"duration > {100 * HOUR}"), ["video_id", "camera_id"]).select("tick_id", "video_id", "pts", "luminance")


@query(f"{_T} SELECT video_id, t0, t1 FROM windows WHERE scale = {12 * HOUR} AND t1 > {100 * HOUR} AND t0 < {200 * HOUR}")
def clip_scan(spark, d):
    clips = ledger.windows(src.videos(spark, d), ((12 * HOUR, 6 * HOUR),))
    return clips.where((F.col("t1") > 100 * HOUR) & (F.col("t0") < 200 * HOUR)).select("video_id", "t0", "t1")


@query("SELECT l_orderkey AS frame_id, l_linenumber AS ordinal, l_returnflag AS label FROM lineitem WHERE l_orderkey % 4 IN (0, 2)")
def detection_scan(spark, d):
    """Detections of two finalised generations (an order's generation is its key modulo 4); asking for an open one is refused."""
    rows = src.detections(spark, d).withColumn("generation", F.col("frame_id") % 4)
    states = spark.createDataFrame([(0, "complete"), (1, "building"), (2, "complete"), (3, "failed")], "generation long, status string")
    return src.finalised(rows, states, [0, 2]).select("frame_id", "ordinal", "label")


@query(f"{_T}, n AS (SELECT video_id, 'd' || tick_id AS node, pts AS t0, row_number() OVER (PARTITION BY video_id ORDER BY pts, tick_id) AS r, count(*) OVER (PARTITION BY video_id) AS n FROM ticks WHERE pts <= {600 * HOUR} AND pts >= {10 * HOUR}) SELECT video_id, node, n > 50 AS truncated FROM n WHERE r <= 50")
def bounded_node_scan(spark, d):
    t = src.ticks(spark, d).where((F.col("pts") <= 600 * HOUR) & (F.col("pts") >= 10 * HOUR)).withColumn("node", F.concat(F.lit("d"), "tick_id"))
    return pattern.bounded_scan(t, ["video_id"], ["pts", "tick_id"], 50).select("video_id", "node", "truncated")


_GRAPH = f"""{_T}, nodes AS (SELECT 'd' || tick_id AS node, 'detection' AS node_type, video_id, camera_id, pts AS t0, pts AS t1, label AS labels, 't' || actor AS tracklet_id FROM ticks
  UNION ALL SELECT 't' || actor, 'tracklet', video_id, camera_id, min(pts), max(pts), '', NULL FROM ticks GROUP BY actor, video_id, camera_id),
edges AS (SELECT 'd' || tick_id AS subject, 'belongs_to_track' AS predicate, 't' || actor AS object FROM ticks
  UNION ALL SELECT 'd' || tick_id, 'near', 'd' || lead(tick_id) OVER (PARTITION BY video_id ORDER BY pts, tick_id) FROM ticks QUALIFY lead(tick_id) OVER (PARTITION BY video_id ORDER BY pts, tick_id) IS NOT NULL)"""


def _nodes(spark, d):
    t = src.ticks(spark, d)
    text = lambda c: F.lit(c)
    none = lambda t: F.lit(None).cast(t)
    number = F.expr("cast(substring(video_id, 2) AS BIGINT) % 4")
    pay = ", ".join(f"{name}:{kind}" for name, kind in (x.strip().split(" ") for x in graph.PAYLOAD.split(",")))
    rest = [none(f"struct<{pay}>").alias("payload"), none("array<string>").alias("predicate_scope"), none("string").alias("fragment_group")]
    keys = ["video_id", "camera_id"]
    dets = t.select(F.concat(text("d"), "tick_id").alias("node"), text("detection").alias("node_type"), *keys, F.col("pts").alias("t0"), F.col("pts").alias("t1"), F.col("label").alias("labels"), F.concat(text("t"), "actor").alias("tracklet_id"), *rest, none("string").alias("continuity"))
    tracks = t.groupBy("actor", *keys).agg(F.min("pts").alias("t0"), F.max("pts").alias("t1")).select(
        F.concat(text("t"), "actor").alias("node"), text("tracklet").alias("node_type"), *keys, "t0", "t1", text("").alias("labels"), none("string").alias("tracklet_id"), *rest, F.when(F.col("actor") % 11 == 0, "interrupted").otherwise("continuous").alias("continuity")
    )
    # A window a day: those of every fourth video are dark, of every fourth incomplete.
    seen = F.when(number == 2, F.count_if(F.col("status") != "skipped")).otherwise(F.count("*"))
    said = {"expected_ticks": F.col("e"), "observed_ticks": F.col("o"), "low_light_ticks": F.when(number == 1, F.col("e")).otherwise(F.lit(0))}
    fields = [said.get(x.strip().split(" ")[0], none(x.strip().split(" ")[1])).alias(x.strip().split(" ")[0]) for x in graph.PAYLOAD.split(",")]
    days = t.groupBy(*keys, F.floor(F.col("pts") / DAY).alias("day")).agg(F.count("*").alias("e"), seen.alias("o"))
    wins = days.select(
        F.concat(text("w"), "video_id", text("-"), "day").alias("node"), text("window").alias("node_type"), *keys, (F.col("day") * DAY).alias("t0"), ((F.col("day") + 1) * DAY).alias("t1"), text("").alias("labels"), none("string").alias("tracklet_id"), F.struct(*fields).alias("payload"),
        none("array<string>").alias("predicate_scope"), none("string").alias("fragment_group"), none("string").alias("continuity"),
    )
    ten = {k: F.lit(10).cast("long") for k in ("expected_ticks", "observed_ticks", "assessable_ticks")}
    own = [ten.get(x.strip().split(" ")[0], none(x.strip().split(" ")[1])).alias(x.strip().split(" ")[0]) for x in graph.PAYLOAD.split(",")]
    eps = src.videos(spark, d).where(number == 3).select(
        F.concat(text("e"), "video_id").alias("node"), text("episode").alias("node_type"), *keys, F.lit(0).cast("long").alias("t0"), F.col("duration").alias("t1"), text("").alias("labels"), none("string").alias("tracklet_id"), F.struct(*own).alias("payload"),
        F.array(text("none_logout")).alias("predicate_scope"), none("string").alias("fragment_group"), none("string").alias("continuity"),
    )
    return dets.unionByName(tracks).unionByName(wins).unionByName(eps)


def _edges(spark, d):
    from pyspark.sql import Window

    t = src.ticks(spark, d)
    nxt = F.lead("tick_id").over(Window.partitionBy("video_id").orderBy("pts", "tick_id"))
    near = t.select("tick_id", nxt.alias("nxt")).where("nxt IS NOT NULL").select(F.concat(F.lit("d"), "tick_id").alias("subject"), F.lit("near").alias("predicate"), F.concat(F.lit("d"), "nxt").alias("object"))
    return t.select(F.concat(F.lit("d"), "tick_id").alias("subject"), F.lit("belongs_to_track").alias("predicate"), F.concat(F.lit("t"), "actor").alias("object")).unionByName(near)


@query(f"{_GRAPH}, n AS (SELECT * FROM nodes WHERE node_type = 'detection' AND t0 <= {300 * HOUR}) SELECT e.subject, e.object FROM edges e WHERE predicate = 'near' AND subject IN (SELECT node FROM n) AND object IN (SELECT node FROM n)")
def bounded_edge_scan(spark, d):
    """Edges of a predicate between loaded nodes."""
    n = _nodes(spark, d).where(f"node_type = 'detection' AND t0 <= {300 * HOUR}").select("node")
    e = _edges(spark, d).where("predicate = 'near'")
    for end in ("subject", "object"):
        e = e.join(n.select(F.col("node").alias(end)), end, "left_semi")
    return e.select("subject", "object")


PATTERN = pattern.Pattern(
    variables=(
        pattern.Variable("a", "click", ("detection",)), pattern.Variable("b", "purchase", ("detection",), start=5 * HOUR), pattern.Variable("c", "signup", ("tracklet",)), pattern.Variable("x", "logout", ("detection",)), pattern.Variable("y", "view", ("detection",)),
        pattern.Variable("n", "logout", ("detection",), end=400 * HOUR), pattern.Variable("k", "signup", ("tracklet",)),
    ),
    edges=(pattern.Edge("a", "near", "b"), pattern.Edge("b", "near", "pick"), pattern.Edge("b", "belongs_to_track", "c"), pattern.Edge("a", "belongs_to_track", "c", required=False)),
    orders=(pattern.Order("b", "a", 6 * HOUR, relation="after"),),
    logic=(pattern.Logic("pick", "any", ("x", "y")), pattern.Logic("none_logout", "visible_none", ("n",)), pattern.Logic("count_signup", "count", ("k",), 1, 4), pattern.Logic("both", "all", ("a", "b"))),
    join_budget=50_000_000,
)
_BOUND = f"""{_GRAPH}, c AS (SELECT DISTINCT t.node, t.t0, t.t1, t.video_id, t.camera_id FROM nodes t JOIN edges e ON e.object = t.node AND e.predicate = 'belongs_to_track' JOIN nodes s ON s.node = e.subject AND s.labels = 'signup' WHERE t.node_type = 'tracklet'),
m AS (SELECT a.node AS a, b.node AS b, c.node AS c, p.node AS pick, CASE WHEN p.labels = 'logout' THEN 'x' ELSE 'y' END AS picked, a.video_id, a.camera_id, least(a.t0, b.t0, c.t0, p.t0) AS t0, greatest(a.t1, b.t1, c.t1, p.t1) + 1 AS t1, a.tracklet_id = b.tracklet_id AS a_in_track
  FROM nodes a JOIN edges e ON e.subject = a.node AND e.predicate = 'near' JOIN nodes b ON b.node = e.object JOIN edges f ON f.subject = b.node AND f.predicate = 'near' JOIN nodes p ON p.node = f.object JOIN c ON c.node = b.tracklet_id
  WHERE a.labels = 'click' AND b.labels = 'purchase' AND b.t1 >= {5 * HOUR} AND p.labels IN ('logout', 'view') AND b.t0 - a.t1 BETWEEN 0 AND {6 * HOUR})"""


@query(f"{_BOUND} SELECT a, b, c, pick, picked, a_in_track FROM m")
def pattern_bindings(spark, d):
    """Four variables, one of them a choice of two, tied by edges, order and an optional edge."""
    found = pattern.bindings(_nodes(spark, d), _edges(spark, d), PATTERN)
    return found.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("c.node").alias("c"), F.col("pick.node").alias("pick"), F.col("pick.bound").alias("picked"), F.col("edge_3").alias("a_in_track"))


@query(f"{_BOUND} SELECT video_id, camera_id, t0, t1, 'a,b,c,' || picked AS atoms, array_to_string(list_sort([a, b, c, pick]), ',') AS nodes FROM m")
def pattern_candidates(spark, d):
    found = pattern.candidates(pattern.bindings(_nodes(spark, d), _edges(spark, d), PATTERN), PATTERN)
    return found.select("video_id", "camera_id", "t0", "t1", F.array_join("atoms", ",").alias("atoms"), F.array_join("nodes", ",").alias("nodes"))


_PROBES = f"""{_GRAPH}, sets AS (SELECT 0 AS i, video_id FROM nodes WHERE labels = 'click' UNION ALL SELECT 1, video_id FROM nodes WHERE labels = 'purchase' AND t1 >= {5 * HOUR}
  UNION ALL SELECT 2, video_id FROM (SELECT DISTINCT t.node, t.video_id FROM nodes t JOIN edges e ON e.object = t.node JOIN nodes s ON s.node = e.subject AND s.labels = 'signup' WHERE t.node_type = 'tracklet' AND e.predicate = 'belongs_to_track')
  UNION ALL SELECT 3, video_id FROM nodes WHERE labels IN ('logout', 'view')),
p AS (SELECT video_id, (count(*) FILTER (i = 0))::DOUBLE AS n0, (count(*) FILTER (i = 1))::DOUBLE AS n1, (count(*) FILTER (i = 2))::DOUBLE AS n2, (count(*) FILTER (i = 3))::DOUBLE AS n3 FROM sets GROUP BY video_id),
j AS (SELECT sum(n0) + sum(n0) * sum(n1) + sum(n0 * n1) * sum(n2) + sum(n0 * n1 * n2) * sum(n3) AS joins FROM p)"""


@query(f"{_PROBES} SELECT CAST(least(joins, 50000000) AS BIGINT) AS joins_completed, joins > 50000000 AS join_budget_reached FROM j")
def pattern_budget(spark, d):
    """How many probes a nested search would make, from the sizes of the match sets."""
    return pattern.probes(_nodes(spark, d), _edges(spark, d), PATTERN)


_DECIDED = f"""{_BOUND}, v AS (SELECT video_id, CAST(video_id[2:] AS BIGINT) % 4 AS v FROM videos), o AS (SELECT t.video_id, t.pts // {DAY} AS day, count(*) AS e, CASE WHEN any_value(v) = 2 THEN count(*) FILTER (status <> 'skipped') ELSE count(*) END AS o, CASE WHEN any_value(v) = 1 THEN count(*) ELSE 0 END AS dark FROM ticks t JOIN v ON t.video_id = v.video_id GROUP BY ALL),
s AS (SELECT o.video_id, any_value(v) AS v, sum(o) >= sum(e) AS complete, sum(dark) < sum(o) AS assessable, sum(dark) >= sum(o) AS darkness FROM o JOIN v ON o.video_id = v.video_id GROUP BY o.video_id),
h AS (SELECT s.*, (SELECT count(*) FROM nodes n WHERE n.video_id = s.video_id AND labels IN ('logout', 'view')) AS picks, (SELECT count(*) FROM nodes n WHERE n.video_id = s.video_id AND labels = 'logout' AND t0 <= {400 * HOUR}) AS outs, (SELECT count(*) FROM c WHERE c.video_id = s.video_id) AS tracks,
  (SELECT count(*) FROM c WHERE c.video_id = s.video_id AND CAST(c.node[2:] AS BIGINT) % 11 = 0) AS broken, (SELECT count(*) FROM (SELECT DISTINCT a, b, c, pick, m.video_id FROM m) m WHERE m.video_id = s.video_id) AS boths FROM s)"""
_UNSAFE = "CASE WHEN NOT complete THEN 'undetermined' WHEN NOT assessable THEN 'unobservable'"
_WHY = "CASE WHEN NOT complete THEN 'incomplete_observation_coverage' WHEN NOT assessable THEN CASE WHEN darkness THEN 'low_light' ELSE 'occlusion_or_unassessable_region' END"


@query(
    f"""{_DECIDED} SELECT video_id, 'pick' AS "group", CASE WHEN picks > 0 THEN 'supported' ELSE {_UNSAFE} ELSE 'contradicted' END END AS state, CASE WHEN picks > 0 THEN 'visible_alternative_present' ELSE 'no_visible_alternative' END AS reason, picks AS hits FROM h
UNION ALL SELECT video_id, 'none_logout', CASE WHEN v <> 3 THEN {_UNSAFE} WHEN outs > 0 THEN 'contradicted' ELSE 'supported' END WHEN outs > 0 THEN 'contradicted' ELSE 'supported' END, CASE WHEN v <> 3 THEN {_WHY} WHEN outs > 0 THEN 'target_visibly_present' ELSE 'complete_visible_absence' END WHEN outs > 0 THEN 'target_visibly_present' ELSE 'complete_visible_absence' END, outs FROM h
UNION ALL SELECT video_id, 'count_signup', {_UNSAFE} WHEN broken > 0 THEN 'undetermined' WHEN tracks BETWEEN 1 AND 4 THEN 'supported' ELSE 'contradicted' END, {_WHY} WHEN broken > 0 THEN 'excessive_track_fragmentation' WHEN tracks BETWEEN 1 AND 4 THEN 'count_within_bounds' ELSE 'count_out_of_bounds' END, tracks FROM h
UNION ALL SELECT video_id, 'both', CASE WHEN boths > 0 THEN 'supported' ELSE {_UNSAFE} ELSE 'contradicted' END END, CASE WHEN boths > 0 THEN 'all_visible_terms_present' WHEN NOT complete THEN 'incomplete_observation_coverage' WHEN NOT assessable THEN 'occlusion_or_unassessable_region' ELSE 'required_visible_term_missing' END, boths FROM h"""
)
def pattern_decisions(spark, d):
    """All four kinds of logic groups, decided for each video."""
    nodes, edges = _nodes(spark, d), _edges(spark, d)
    found = pattern.candidates(pattern.bindings(nodes, edges, PATTERN), PATTERN)
    return pattern.decisions(nodes, edges, found, PATTERN, ["video_id"])


@query(f"{_PROBES} SELECT (SELECT count(*) FROM nodes WHERE node_type = 'tracklet') AS tracklets_considered, CAST(least(joins, 50000000) AS BIGINT) AS joins_completed, joins > 50000000 AS join_budget_reached, CASE WHEN joins > 50000000 THEN 'join_or_scan_budget_reached' END AS unresolved_reason FROM j")
def pattern_trace(spark, d):
    """Only the choice is decided here, and it is always there: nothing but a budget can be unresolved."""
    nodes, edges = _nodes(spark, d), _edges(spark, d)
    decided = spark.createDataFrame([("v0", "pick", "supported", "visible_alternative_present")], "video_id string, group string, state string, reason string")
    return pattern.trace(nodes, edges, decided, PATTERN)


@query(f"{_GRAPH} SELECT node FROM nodes WHERE node_type = 'detection' AND video_id IN ('v1', 'v2', 'v5') AND camera_id IN ('cam1', 'cam2') AND t1 >= {30 * HOUR} AND t0 <= {500 * HOUR}")
def node_scope(spark, d):
    v = pattern.Variable("a", "", ("detection",), ("v1", "v2", "v5"), ("cam1", "cam2"), 30 * HOUR, 500 * HOUR)
    return _nodes(spark, d).where(pattern.in_scope(v)).select("node")


@query(f"{_T} SELECT video_id, scale, t0 FROM (SELECT *, ['z' || ((t0 // {HOUR}) % 5), 'z' || (scale // {4 * HOUR} % 7)] AS zones FROM windows) WHERE list_has_any(zones, ['z1', 'z4'])")
def zone_filter(spark, d):
    zone = lambda x: F.concat(F.lit("z"), x.cast("long").cast("string"))
    w = ledger.windows(src.videos(spark, d)).withColumn("zones", F.array(zone(F.floor(F.col("t0") / HOUR) % 5), zone(F.floor(F.col("scale") / (4 * HOUR)) % 7)))
    return retrieve.in_zones(w, ["z1", "z4"]).select("video_id", "scale", "t0")


@query(f"{_T} SELECT tick_id, CASE WHEN tick_id % 3 = 0 THEN (tick_id % 5 = 0) WHEN tick_id % 3 = 1 THEN (tick_id % 7 = 0 OR tick_id % 5 = 0) ELSE (tick_id % 2 = 0) END AS matches FROM ticks")
def predicate_scope(spark, d):
    """Payloads that name their group as a string, in a list or in an object."""
    k = F.col("tick_id")
    g = lambda m: F.when(k % m == 0, "g1").otherwise("g2")
    said = F.when(k % 3 == 0, F.concat(F.lit('"'), g(5), F.lit('"'))).when(k % 3 == 1, F.to_json(F.array(g(7), g(5)))).otherwise(F.to_json(F.struct(g(2).alias("group_id"))))
    return src.ticks(spark, d).select("tick_id", in_group_scope(said, "g1").alias("matches"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) WHEN 1 THEN event_id WHEN 2 THEN event_id END AS k, CASE event_id % 4 WHEN 3 THEN 'not json {' END AS text FROM events")
def payload_parse(spark, d):
    """Objects stay; numbers, lists and texts that are no JSON are wrapped as {"value": ...}."""
    k = F.col("event_id")
    raw = F.when(k % 4 == 0, F.col("props")).when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, F.concat(F.lit("["), k.cast("string"), F.lit("]"))).otherwise(F.lit("not json {"))
    p = payload(raw)
    number = F.coalesce(F.try_variant_get(p, "$.k", "bigint"), F.try_variant_get(p, "$.value[0]", "bigint"), F.try_variant_get(p, "$.value", "bigint"))
    return src.parquet(spark, d, "events").select("event_id", number.alias("k"), F.when(k % 4 == 3, F.try_variant_get(p, "$.value", "string")).alias("text"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x * 9))**0.5, 6) AS norm, round(embedding[1] / list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))**0.5, 6) AS first FROM embeddings")
def normalised_embeddings(spark, d):
    """Vectors three times as long, brought back to length one."""
    e = src.parquet(spark, d, "embeddings").withColumn("long", F.transform("embedding", lambda x: x.cast("double") * 3))
    return e.select("vec_id", F.round(norm(F.col("long")), 6).alias("norm"), F.round(normalised(F.col("long"))[0], 6).alias("first"))


_PIXELS = """p AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor((x + 1) * 127)) AS g FROM embeddings), q AS (SELECT vec_id, g, unnest(generate_series(0, 63)) AS i FROM p),
l AS (SELECT vec_id, g[i] + g[i + 2] + g[i - 7] + g[i + 9] - 4 * g[i + 1] AS lap FROM q WHERE i % 8 BETWEEN 1 AND 6 AND i BETWEEN 8 AND 55)"""


@query(f"WITH {_PIXELS} SELECT p.vec_id, round(list_sum(g) / (64 * 255.0::DOUBLE), 6) AS luminance, round(v, 4) AS sharpness FROM p JOIN (SELECT vec_id, var_pop(lap) AS v FROM l GROUP BY vec_id) s ON p.vec_id = s.vec_id")
def frame_quality(spark, d):
    """Embeddings as grey images of eight by eight pixels."""
    e = src.parquet(spark, d, "embeddings").withColumn("g", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127)))
    return e.select("vec_id", F.round(luminance(F.col("g")), 6).alias("luminance"), F.round(sharpness(F.col("g"), 8), 4).alias("sharpness"))


@query(f"WITH {_PIXELS} SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.g, b.g), lambda x: abs(x[1] - x[2]))) / (64 * 255.0::DOUBLE), 6) AS difference FROM p a JOIN p b ON b.vec_id = a.vec_id + 1")
def frame_differences(spark, d):
    e = src.parquet(spark, d, "embeddings").withColumn("g", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127)))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("g").alias("h"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(frame_difference(F.col("g"), F.col("h")), 6).alias("difference"))


@query("""SELECT o_orderkey, substr(sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}'), 1, 16) AS id, 'embeddings/' || substr(sha256('{"o_custkey":' || o_custkey || '}'), 1, 32) AS path FROM orders""")
def stable_ids(spark, d):
    """16-hex ids over declared inputs, and the path of an artefact by its generation's key."""
    from ..functions.exprs import artefact_path, stable_id

    return src.parquet(spark, d, "orders").select("o_orderkey", stable_id(F.col("o_orderkey"), F.col("o_orderstatus")).alias("id"), artefact_path("embeddings", F.col("o_custkey")).alias("path"))


@query("SELECT o_orderkey, epoch_us(o_orderdate) + 3600000000 > epoch_us(o_orderdate) + (o_orderkey % 3) * 1800000000 AS after FROM orders")
def iso_dates(spark, d):
    """ISO texts with Z or an offset, parsed and compared strictly."""
    o = src.parquet(spark, d, "orders")
    stamp = lambda plus: F.date_format(F.expr(f"timestampadd(MINUTE, cast({plus} AS INT), o_orderdate)"), "yyyy-MM-dd'T'HH:mm:ss")
    late, early = F.to_timestamp(F.concat(stamp("60"), F.lit("Z"))), F.to_timestamp(F.concat(stamp("(o_orderkey % 3) * 30 + 120"), F.lit("+02:00")))
    return o.select("o_orderkey", (late > early).alias("after"))


@query("SELECT o_custkey % 100 AS video_id, CASE WHEN o_custkey % 100 >= 80 THEN 'new' WHEN o_custkey % 7 = 0 THEN 'clash' ELSE 'same' END AS state, count(*) AS n FROM orders GROUP BY ALL")
def register_videos(spark, d):
    """Incoming sources against 80 registered ones: one id with another source or configuration is a clash."""
    o = src.parquet(spark, d, "orders")
    known = spark.range(80).select(F.col("id").alias("video_id"), F.lit("s").alias("sha256"), F.lit("c").alias("cache_key"))
    came = o.select((F.col("o_custkey") % 100).alias("video_id"), F.lit("s").alias("sha256"), F.when(F.col("o_custkey") % 7 == 0, "other").otherwise("c").alias("cache_key"))
    return ledger.register(came, known).groupBy("video_id", "state").agg(F.count("*").alias("n"))


@query(f"{_T}, s AS (SELECT *, ['pending', 'embedding_pending', 'embedded', 'decode_failed'][CAST((tick_id // 3) % 4 + 1 AS INT)] AS state FROM ticks), l AS (SELECT *, lag(state) OVER (PARTITION BY actor ORDER BY tick_id) AS before FROM s) SELECT before, state, CASE WHEN before IS NULL THEN state = 'pending' WHEN before = 'pending' THEN state IN ('embedding_pending', 'decode_failed') WHEN before = 'embedding_pending' THEN state = 'embedded' ELSE false END AS legal, count(*) AS n FROM l GROUP BY ALL")
def tick_transitions(spark, d):
    pick = F.element_at(F.array(*[F.lit(s) for s in ("pending", "embedding_pending", "embedded", "decode_failed")]), (F.floor(F.col("tick_id") / 3) % 4 + 1).cast("int"))
    return ledger.transitions(src.ticks(spark, d).withColumn("state", pick), ["actor"], "tick_id").groupBy("before", "state", "legal").agg(F.count("*").alias("n"))


@query(f"{_LEDGER} SELECT l.tick_id, l.frame_id, f.pts AS actual_pts, l.error_code FROM led l LEFT JOIN frames f ON l.frame_id = f.frame_id")
def ledger_manifest(spark, d):
    return ledger.manifest(_ledger(spark, d), _frames(spark, d)).select("tick_id", "frame_id", "actual_pts", "error_code")


@query(f"{_T}, v AS (SELECT video_id FROM videos UNION SELECT 'empty') SELECT v.video_id, count(status) AS expected, count(*) FILTER (status = 'embedded') AS embedded, count(*) FILTER (status = 'decode_failed') AS decode_failed, count(*) FILTER (status = 'skipped') AS skipped, round(coalesce((count(*) FILTER (status = 'embedded'))::DOUBLE / nullif(count(status), 0), 0), 6) AS coverage FROM v LEFT JOIN ticks t ON v.video_id = t.video_id GROUP BY v.video_id")
def video_coverage(spark, d):
    """Coverage of every video, one without ticks included."""
    every = src.videos(spark, d).select("video_id").unionByName(spark.range(1).select(F.lit("empty").alias("video_id")))
    return base._round(ledger.coverage(src.ticks(spark, d), ["video_id"], every), "coverage")


_WL = f"""{_LEDGER}, x AS (SELECT w.video_id, w.camera_id, w.scale, w.t0, w.t1, l.status, l.tick_id, f.luminance, f.sharpness FROM windows w LEFT JOIN led l ON l.video_id = w.video_id AND l.camera_id = w.camera_id AND l.pts >= w.t0 AND l.pts < w.t1 LEFT JOIN frames f ON f.frame_id = l.frame_id)"""


@query(f"{_WL} SELECT video_id, camera_id, scale, t0, t1, count(tick_id) AS expected_ticks, count(*) FILTER (status = 'embedded') AS observed_ticks, count(*) FILTER (status = 'embedded' AND luminance >= 0.2 AND sharpness >= 5) AS quality_assessable_ticks, count(*) FILTER (status = 'embedded' AND luminance < 0.2) AS low_light_ticks, 0::BIGINT AS assessable_ticks, count(tick_id) > 0 AND count(tick_id) = count(*) FILTER (status = 'embedded') AS coverage_complete FROM x GROUP BY ALL")
def window_ledger(spark, d):
    return ledger.window_ledger(ledger.windows(src.videos(spark, d)), _ledger(spark, d), _frames(spark, d), 0.2, 5.0, 4 * HOUR)


@query(f"{_T} SELECT w.video_id, w.camera_id, w.scale, w.t0, w.t1, max(t.score) AS score FROM windows w LEFT JOIN ticks t ON t.video_id = w.video_id AND t.camera_id = w.camera_id AND t.pts >= w.t0 AND t.pts < w.t1 AND t.label = 'signup' GROUP BY ALL")
def window_reduction(spark, d):
    """A window without a tick of the label has a null score."""
    return ledger.window_reduction(ledger.windows(src.videos(spark, d)), src.ticks(spark, d).where("label = 'signup'"), "max", 4 * HOUR)


@query("WITH e AS (SELECT DISTINCT event_id % 20 AS generation, event_id // 100 AS block FROM events), w AS (SELECT DISTINCT event_id % 20 AS generation, event_id // 100 AS block FROM events WHERE event_id % 20 <> 3 OR event_id % 200 < 100), x AS (SELECT coalesce(e.generation, w.generation) AS generation, e.block IS NULL AS extra, w.block IS NULL AS miss FROM e FULL JOIN w ON e.generation = w.generation AND e.block = w.block) SELECT generation, count(*) FILTER (miss) AS missing, count(*) FILTER (extra) AS unexpected, count(*) FILTER (miss OR extra) = 0 AS complete FROM x GROUP BY generation")
def detection_finalise(spark, d):
    """Generations of which all blocks are written may be finalised."""
    rows = src.parquet(spark, d, "events").select((F.col("event_id") % 20).alias("generation"), F.floor(F.col("event_id") / 100).alias("block"), "event_id")
    return ledger.finalisable(rows, rows.where("generation <> 3 OR event_id % 200 < 100"), ["generation"])


@query("WITH g AS (SELECT o_custkey AS video_id, o_orderkey AS seq, o_orderkey % 9 AS generation, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'building' ELSE 'failed' END AS status FROM orders) SELECT video_id, arg_max(generation, seq) AS generation FROM g WHERE status = 'complete' GROUP BY video_id")
def generation_pointers(spark, d):
    """Each video's active generation: its newest complete one."""
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "building").otherwise("failed")
    return ledger.activate(src.parquet(spark, d, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 9).alias("generation"), status.alias("status")))


@query("WITH e AS (SELECT o_custkey AS build, o_orderkey AS seq, CASE o_orderkey % 5 WHEN 0 THEN 'finish' WHEN 1 THEN 'fail' ELSE 'start' END AS event FROM orders) SELECT build, CASE WHEN bool_or(event = 'finish') THEN 'complete' WHEN arg_max(event, seq) = 'fail' THEN 'failed' ELSE 'building' END AS state, count(*) FILTER (event = 'start') AS starts FROM e GROUP BY build")
def build_states(spark, d):
    k = F.col("o_orderkey")
    event = F.when(k % 5 == 0, "finish").when(k % 5 == 1, "fail").otherwise("start")
    return ledger.build_state(src.parquet(spark, d, "orders").select(F.col("o_custkey").alias("build"), k.alias("seq"), event.alias("event")), ["build"])


@query("SELECT vec_id // 64 AS block, count(*) AS \"rows\", min(vec_id) AS first_id, max(vec_id) AS last_id, sha256(string_agg(sha256(vec_id || chr(31) || label || chr(31) || array_to_string(list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 1099511627776) AS BIGINT)), ',')), '' ORDER BY vec_id)) AS digest FROM embeddings GROUP BY ALL")
def embedding_manifest(spark, d):
    e = src.parquet(spark, d, "embeddings").withColumn("block", F.floor(F.col("vec_id") / 64))
    # Components as whole multiples of 2^-40, which both engines write alike; a changed vector changes its block's digest.
    vector = F.array_join(F.transform("embedding", lambda x: F.floor(x.cast("double") * (1 << 40)).cast("string")), ",")
    return ledger.block_manifest(e, ["block"], "vec_id", F.col("label").cast("string"), vector)


@query("SELECT DISTINCT event_id // 50 AS block FROM events WHERE event_id // 50 NOT IN (SELECT event_id // 50 FROM events WHERE event_id % 450 = 0)")
def pending_blocks(spark, d):
    """Blocks that a run has still to do."""
    b = src.parquet(spark, d, "events").select(F.floor(F.col("event_id") / 50).alias("block"), "event_id")
    return ledger.only_new(b.select("block"), b.where("event_id % 450 = 0"), ["block"])


@query("WITH e AS (SELECT 'c' || (o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 10000000 ELSE 0 END) AS subject, 'o' || (o_orderkey + CASE WHEN o_orderkey % 70 = 0 THEN 100000000 ELSE 0 END) AS object FROM orders) SELECT subject, object, 'subject' AS missing FROM e WHERE subject NOT IN (SELECT 'c' || c_custkey FROM customer) UNION ALL SELECT subject, object, 'object' FROM e WHERE object NOT IN (SELECT 'o' || o_orderkey FROM orders)")
def dangling_edges(spark, d):
    o = src.parquet(spark, d, "orders")
    k = F.col("o_orderkey")
    e = o.select(F.concat(F.lit("c"), F.col("o_custkey") + F.when(k % 50 == 0, 10000000).otherwise(0)).alias("subject"), F.concat(F.lit("o"), k + F.when(k % 70 == 0, 100000000).otherwise(0)).alias("object"))
    nodes = src.parquet(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node")).unionByName(o.select(F.concat(F.lit("o"), k).alias("node")))
    return graph.dangling(e, nodes)


@query("SELECT l_orderkey AS frame_id, l_linenumber AS ordinal, 'contains' AS predicate, o_custkey AS video FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def frame_contains_edges(spark, d):
    """Detections joined to their frames; one without a frame has no edge."""
    frames = src.parquet(spark, d, "orders").select(F.col("o_orderkey").alias("frame_id"), F.col("o_custkey").alias("video"))
    return src.detections(spark, d).join(frames, "frame_id").select("frame_id", "ordinal", F.lit("contains").alias("predicate"), "video")


@query("SELECT page_id, octet_length(encode(coalesce(html, ''))) AS length, sha256(coalesce(html, '')) AS sha256 FROM pages")
def replica_manifest(spark, d):
    return src.parquet(spark, d, "pages").select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("length"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"))


@query("""WITH r AS (SELECT o_orderkey, sha256('{"candidate":' || o_orderkey || ',"frames":[' || o_custkey || ',' || (o_custkey + 1) || '],"model":null}') AS digest FROM orders) SELECT o_orderkey, digest, o_orderkey % 3 = 0 AS cached FROM r""")
def verification_cache(spark, d):
    """What a cache of earlier answers still lacks: requests meet it by the digest of all that an answer depends on."""
    o = src.parquet(spark, d, "orders")
    digest = decide.evidence_digest(F.col("o_orderkey").alias("candidate"), F.array("o_custkey", F.col("o_custkey") + 1).alias("frames"), F.lit(None).cast("string").alias("model"))
    asked = o.select("o_orderkey", digest.alias("digest"))
    known = asked.where("o_orderkey % 3 = 0").select("digest", F.lit(True).alias("hit"))
    return asked.join(known, "digest", "left").select("o_orderkey", "digest", F.coalesce("hit", F.lit(False)).alias("cached"))


@query(f"{_T} SELECT DISTINCT video_id, pts // {HOUR} AS slot FROM ticks WHERE tick_id % 4 IN (0, 1)")
def detector_frames(spark, d):
    """Distinct targets in the lanes that the detector reads."""
    return src.ticks(spark, d).where("tick_id % 4 IN (0, 1)").select("video_id", F.floor(F.col("pts") / HOUR).alias("slot")).distinct()


@query(f"{_T}, p AS (SELECT video_id, unnest(generate_series(0, (duration - 1) // {HOUR})) * {HOUR} AS target_pts FROM videos), k AS (SELECT * FROM ticks WHERE tick_id % 6 = 0), j AS (SELECT p.*, k.tick_id, k.pts FROM p ASOF LEFT JOIN k ON p.video_id = k.video_id AND p.target_pts >= k.pts) SELECT video_id, target_pts, tick_id AS frame_id, pts AS frame_pts FROM j")
def preceding_keyframe(spark, d):
    """The last keyframe at or before each target."""
    planned = ledger.expected_ticks(src.videos(spark, d).select("video_id", "duration"), HOUR)
    keyframes = src.ticks(spark, d).where("tick_id % 6 = 0").select("video_id", F.col("pts").alias("target_pts"), "tick_id")
    return intervals.asof_join(planned, keyframes, ["video_id"], "target_pts", "tick_id")


@query(f"SELECT video_id, target_pts, CASE WHEN abs(frame_pts - target_pts) <= {HOUR // 4} THEN frame_id END AS frame_id, CASE WHEN abs(frame_pts - target_pts) <= {HOUR // 4} THEN frame_pts END AS frame_pts, CASE WHEN frame_pts IS NULL THEN 'no_decodable_frame' WHEN abs(frame_pts - target_pts) > {HOUR // 4} THEN 'nearest_frame_too_far' END AS error_code FROM ({base.ORACLE_SQL['nearest_frame']})")
def nearest_within(spark, d):
    planned = ledger.expected_ticks(src.videos(spark, d).select("video_id", "duration"), HOUR)
    frames = src.ticks(spark, d).select("video_id", F.col("pts").alias("target_pts"), "tick_id")
    return intervals.nearest_join(planned, frames, ["video_id"], "target_pts", "tick_id", HOUR // 4)


@query(f"{_T}, g AS (SELECT tick_id, actor, pts - lag(pts) OVER (PARTITION BY actor ORDER BY pts, tick_id) AS gap FROM ticks) SELECT tick_id, gap, CASE WHEN gap > {48 * HOUR} THEN 'closed' WHEN gap > {12 * HOUR} THEN 'interrupted' ELSE 'continuous' END AS continuity FROM g")
def continuity_gaps(spark, d):
    from ..operators.tracks import continuity

    return continuity(src.ticks(spark, d), ["actor"], ["pts", "tick_id"], 12 * HOUR, 48 * HOUR).select("tick_id", "gap", "continuity")


@query(f"WITH {base._RANKED}, m AS (SELECT *, max(t1) OVER (PARTITION BY video_id, camera_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fused), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR t0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, camera_id ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT video_id, CAST(island AS BIGINT) AS island, count(*) AS n, sha256(string_agg(t0 || '-' || t1, ',' ORDER BY t0, t1)) AS members FROM i GROUP BY video_id, camera_id, island")
def cluster_members(spark, d):
    """Clusters with the list of their members, here by its digest."""
    c = fuse.cluster(fuse.fuse(base._scored(spark, d)), 0, members=True)
    names = F.array_join(F.transform("member_spans", lambda x: F.concat(x["t0"].cast("string"), F.lit("-"), x["t1"].cast("string"))), ",")
    return c.select("video_id", "island", F.col("members").alias("n"), F.sha2(names, 256).alias("members"))


@query("SELECT l_orderkey AS candidate_id, CAST(min(l_linenumber) AS INT) AS t0, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS channels, arg_max(l_quantity, l_linenumber * 1000 + l_quantity) FILTER (l_returnflag = 'N') AS n_score, count(DISTINCT l_suppkey) AS evidence FROM lineitem GROUP BY l_orderkey")
def candidate_merge(spark, d):
    """Candidates of one id from several channels: scores by channel (the later wins), evidence once a node, one interval."""
    li = src.parquet(spark, d, "lineitem")
    first = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linenumber").alias("t0"))
    rows = li.join(first, F.col("l_orderkey") == F.col("k")).select(F.col("l_orderkey").alias("candidate_id"), F.lit("v").alias("video_id"), F.lit(None).cast("string").alias("camera_id"), "t0", (F.col("t0") + 1).alias("t1"), (F.col("l_linenumber") * 1000 + F.col("l_quantity")).alias("seq"), F.col("l_returnflag").alias("channel"), F.col("l_quantity").alias("score"), F.array("l_suppkey").alias("evidence"))
    m = fuse.merge(rows)
    return m.select("candidate_id", "t0", F.array_join(F.array_sort(F.map_keys("scores")), ",").alias("channels"), F.try_element_at("scores", F.lit("N")).alias("n_score"), F.size("evidence").cast("long").alias("evidence"))


@query(f"WITH e AS ({base.ORACLE_SQL['three_atom_episode'].replace('SELECT a.tick_id AS a', 'SELECT a.video_id, a.camera_id, list_max([a.score, b.score, c.score]) AS priority, a.tick_id AS a')}) SELECT video_id, a, b, c, t0, t1, round(priority, 6) AS priority, (SELECT count(*) FROM e) > 40 AS cap_bound FROM e ORDER BY video_id, camera_id, t0, t1, a, b, c LIMIT 40")
def episode_order(spark, d):
    """The first 40 episodes in order, and whether there were more."""
    atoms = {k: base._anchors(spark, d, x) for k, x in (("a", "view"), ("b", "click"), ("c", "purchase"))}
    out = assemble.first_episodes(atoms, [("a", "b", HOUR, False), ("b", "c", HOUR, False)], ["a", "b", "c"], 40)
    ids = [F.col(f"{k}.id") for k in "abc"]
    return base._round(out.select("video_id", *[i.alias(k) for i, k in zip(ids, "abc", strict=True)], "t0", "t1", "priority", "cap_bound"), "priority")


@query(f"{_T} SELECT a.tick_id AS a, b.tick_id AS b, c.tick_id AS c, e.tick_id AS e FROM ticks a JOIN ticks b ON a.video_id = b.video_id AND a.camera_id = b.camera_id AND a.label = 'view' AND b.label = 'click' AND b.pts - a.pts BETWEEN 0 AND {HOUR} JOIN ticks c ON c.video_id = b.video_id AND c.camera_id = b.camera_id AND c.label = 'purchase' AND c.pts - b.pts BETWEEN 0 AND {HOUR} JOIN ticks e ON e.video_id = a.video_id AND e.camera_id = a.camera_id AND e.label = 'signup' AND e.pts - a.pts BETWEEN 0 AND {2 * HOUR} WHERE c.pts - a.pts BETWEEN 0 AND {HOUR}")
def four_atom_episode(spark, d):
    """Four atoms and four relations, one of them between atoms already bound."""
    atoms = {k: base._anchors(spark, d, x) for k, x in (("a", "view"), ("b", "click"), ("c", "purchase"), ("e", "signup"))}
    found = assemble.episodes(atoms, [("a", "b", HOUR, False), ("b", "c", HOUR, False), ("a", "c", HOUR, False), ("a", "e", 2 * HOUR, False)])
    return found.select(*[F.col(f"{k}.id").alias(k) for k in "abce"])


@query("WITH p AS (SELECT o_orderkey AS k, [o_custkey % 5, o_custkey % 7] AS l, [o_orderkey % 5, o_orderkey % 6] AS r FROM orders) SELECT k, array_to_string(list_sort(list_intersect(l, r)), ',') AS shared FROM p WHERE len(list_intersect(l, r)) > 0")
def shared_tracklets(spark, d):
    side = lambda a, b: F.struct(F.array(a, b).alias("tracklet_ids"))
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    p = src.parquet(spark, d, "orders").select(k.alias("k"), side(c % 5, c % 7).alias("l"), side(k % 5, k % 6).alias("r"))
    return assemble.shared_tracks(p).select("k", F.array_join(F.col("shared").cast("array<string>"), ",").alias("shared"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 9 = 0 THEN 'undetermined' ELSE 'supported' END AS state, CASE WHEN l_suppkey % 9 = 0 THEN 'inconsistent_output' ELSE 'visible_match' END AS reason, CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE 2 END AS cited FROM lineitem")
def citation_check(spark, d):
    k = F.col("l_partkey")
    items = src.parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(k, k + 1).alias("cited"), F.when(F.col("l_suppkey") % 9 == 0, F.array(k, k + 2)).otherwise(F.array(k, k + 1, k + 2)).alias("supplied"), F.lit("supported").alias("state"), F.lit("visible_match").alias("reason"))
    return decide.repair_citations(items).withColumn("cited", F.size("cited")).drop("supplied")


@query("SELECT l_returnflag AS flag, l_linestatus AS line, CASE l_returnflag WHEN 'N' THEN l_linestatus = 'O' WHEN 'A' THEN l_linestatus = 'F' ELSE false END AS fits FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)")
def state_reasons(spark, d):
    """Whether a state may give its reason."""
    li = src.parquet(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()
    state = F.when(F.col("l_returnflag") == "N", "supported").when(F.col("l_returnflag") == "A", "contradicted").otherwise("asleep")
    reason = F.when(F.col("l_linestatus") == "O", "visible_match").otherwise("visible_mismatch")
    return li.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line"), decide.reason_fits(state, reason).alias("fits"))


@query(f"WITH c AS ({base._CLUSTER}) SELECT video_id, t0, unnest(['a1', 'a2', 'g1']) AS constraint_id, 'undetermined' AS state, 'model_error' AS reason FROM c")
def unverified_outcomes(spark, d):
    c = base.search_flagship(spark, d).select("video_id", "t0")
    return decide.unverified(c, ["a1", "a2", "g1"])


_RERANK = """r AS (SELECT o_custkey AS query, o_orderkey AS cluster_id, o_orderkey % 11 AS priority, CASE WHEN o_custkey % 9 = 0 AND o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey % 17)::DOUBLE / 17 END AS relevance, ['disabled', 'shadow', 'active'][CAST(o_custkey % 3 + 1 AS INT)] AS want FROM orders),
w AS (SELECT *, CASE WHEN want = 'disabled' THEN 'disabled' WHEN bool_or(relevance IS NULL) OVER (PARTITION BY query) THEN 'fallback' ELSE want END AS mode FROM r)"""


@query(f"WITH {_RERANK} SELECT query, cluster_id, mode, CAST(row_number() OVER (PARTITION BY query ORDER BY CASE WHEN mode = 'active' THEN -relevance ELSE 0 END, priority DESC, cluster_id) AS INT) AS rank FROM w")
def rerank_modes(spark, d):
    o = src.parquet(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    relevance = F.when(~((c % 9 == 0) & (k % 4 == 0)), (k % 17).cast("double") / 17)
    rows = o.select(c.alias("query"), k.alias("cluster_id"), (k % 11).alias("priority"), relevance.alias("relevance"))
    mode = F.element_at(F.array(F.lit("disabled"), F.lit("shadow"), F.lit("active")), (F.col("query") % 3 + 1).cast("int"))
    return decide.rerank(rows, mode).select("query", "cluster_id", "mode", "rank")


@query()
def evidence_frames(spark, d):
    """For each cluster the frames nearest to evenly spread targets, each frame once; chosen in sequence, so there is no SQL twin."""
    from ..operators.tracks import evidence_frames as pick

    spans = ledger.windows(src.videos(spark, d), ((12 * HOUR, 12 * HOUR),)).withColumn("span_id", F.concat("video_id", F.lit("-"), "t0"))
    frames = src.ticks(spark, d).select("video_id", "camera_id", "pts", F.col("tick_id").alias("frame_id"))
    return pick(spans, frames, HOUR, 4 * HOUR)


@query(f"{_LEDGER}, s AS (SELECT tick_id, unnest(list_filter([CASE WHEN status = 'embedded' AND frame_id IS NULL THEN 'embedded_needs_frame' END, CASE WHEN status = 'decode_failed' AND error_code IS NULL THEN 'failed_needs_error' END], lambda x: x IS NOT NULL)) AS violation FROM led) SELECT * FROM s")
def ledger_invariants(spark, d):
    return checks.violations(_ledger(spark, d), ["tick_id"], checks.tick_rules())


@query(f"{_T} SELECT round(sum(score), 6) AS total, count(*) AS n FROM ticks")
def finite_scores(spark, d):
    """Scores pass a guard that refuses NaN and infinities."""
    return src.ticks(spark, d).agg(F.round(F.sum(finite(F.col("score"))), 6).alias("total"), F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE list_has_all(regexp_split_to_array(lower(coalesce(lang, '') || ' ' || coalesce(source, '')), '[^a-z0-9]+'), ['en'])")
def payload_label_match(spark, d):
    """Labels from several payload fields together, by whole tokens."""
    docs = src.parquet(spark, d, "documents")
    return docs.where(label_match(F.concat_ws(" ", "lang", "source"), "EN")).select("doc_id", "lang")


PROPS = {"type": "object", "required": ["k", "v"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 80}, "tags": {"type": "array", "maxItems": 2, "items": {"enum": ["a", "b"]}}, "v": {"const": 1}}, "additionalProperties": False}


@query(
    """WITH d AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 5 = 0 THEN '$: v is missing' END, CASE WHEN k < 10 THEN '$.k: minimum' END, CASE WHEN k > 80 THEN '$.k: maximum' END, CASE WHEN event_id % 4 = 0 THEN '$.tags: maxItems' END, CASE WHEN event_id % 4 = 0 THEN '$.tags[2]: not in enum' END,
  CASE WHEN event_id % 5 = 1 THEN '$.v: not the constant' END, CASE WHEN event_id % 7 = 0 THEN '$: unexpected z' END], lambda x: x IS NOT NULL), '; ') AS errors FROM d"""
)
def schema_errors(spark, d):
    """Documents with a bound number, tags of an enumeration, a constant that may be missing, and a field too many."""
    from ..functions.schema import errors

    k = F.col("event_id")
    tags = F.when(k % 4 == 0, F.lit('["a","b","c"]')).otherwise(F.lit('["b"]'))
    v = F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.lit(',"v":2')).otherwise(F.lit(',"v":1'))
    doc = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"tags":'), tags, v, F.when(k % 7 == 0, F.lit(',"z":0')).otherwise(F.lit("")), F.lit("}"))
    return src.parquet(spark, d, "events").select("event_id", F.array_join(errors(PROPS, F.try_parse_json(doc)), "; ").alias("errors"))


def _fake_encoder(payloads: list) -> list:
    """(event, value, user) -> (value, user); every 97th event poisons its batch."""
    if any(int(p[0]) % 97 == 0 for p in payloads):
        raise ValueError("poisoned")
    return [p[1:] for p in payloads]


@query("SELECT event_id AS id, CASE WHEN event_id % 97 = 0 THEN 'ValueError: poisoned' WHEN value * value + user_id * user_id = 0 THEN 'no_direction' END AS error, CASE WHEN event_id % 97 <> 0 THEN round(value / nullif(sqrt(value * value + user_id::DOUBLE * user_id), 0), 6) END AS x FROM events")
def encoded_events(spark, d):
    """An injected encoder over all events; a poisoned row costs that row."""
    e = src.parquet(spark, d, "events")
    rows = e.select(F.col("event_id").alias("id"), F.array(F.col("event_id").cast("double"), "value", F.col("user_id").cast("double")).alias("payload"))
    return base._round(boundary.encode(rows, _fake_encoder).select("id", "error", F.col("vector")[0].alias("x")), "x")


def _fake_call(prompt: str, frames: list, wrong: str | None) -> str:
    key = int(prompt)
    if key % 11 == 0 or (key % 5 == 0 and wrong is None):
        raise RuntimeError("no model")
    return "supported" if key % 7 or wrong else "?"


def _fake_valid(answer: str) -> bool:
    return answer == "supported"


@query("WITH r AS (SELECT o_orderkey AS k, 6 + o_orderkey % 20 AS n FROM orders) SELECT k AS \"key\", CASE WHEN n NOT BETWEEN 8 AND 24 THEN 'invalid_request' WHEN k % 11 = 0 THEN 'system_failure' ELSE 'stored' END AS outcome, CASE WHEN n BETWEEN 8 AND 24 AND k % 11 = 0 THEN 2 ELSE 0 END AS calls FROM r")
def verified_again(spark, d):
    """The second run over all requests: what the first one answered is read, only failures are asked again."""
    k = F.col("o_orderkey")
    o = src.parquet(spark, d, "orders").select(k.alias("key"), k.cast("string").alias("prompt"), F.sequence(F.lit(1).cast("long"), 6 + k % 20).alias("frames"))
    requests = materialize(o.withColumn("digest", boundary.request_digest(F.col("prompt"), F.array_join("frames", ","))), "requests")
    store = boundary.AnswerStore(spark, new_path(spark, "answers"))
    boundary.verify_cached(requests, store, _fake_call, _fake_valid)
    said = boundary.verify_cached(requests, store, _fake_call, _fake_valid)
    return requests.select("key", "digest").join(said, "digest").select("key", "outcome", "calls")
