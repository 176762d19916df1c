"""Queries over invariants, gates and scores, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, evaluate, ledger
from ..sources import tables as src
from . import catalogue as base
from . import evidence as ev
from . import governance as gov

QUERIES, ORACLE_SQL = {}, {}
HOUR = ledger.HOUR


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _found(cases: dict[str, str], id_: str, table: str) -> str:
    """SQL twin of violations: name -> the condition that breaks the rule."""
    return " UNION ALL ".join(f"SELECT {id_}, '{name}' AS violation FROM {table} WHERE {bad}" for name, bad in cases.items())


@query("WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN substr(sha256(o_orderkey::VARCHAR), 1, 60) ELSE sha256(o_orderkey::VARCHAR) END AS h, o_orderkey % 10 - 1 AS t0, o_custkey % 12 AS t1, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'p' END AS p FROM orders) " + _found({"source_digest": "length(h) <> 64", "interval": "t0 < 0 OR t1 < t0", "producer": "p = ''"}, "o_orderkey", "e"))
def provenance_check(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    digest = F.sha2(k.cast("string"), 256)
    e = src.parquet(spark, d, "orders").select("o_orderkey", F.when(k % 7 == 0, F.substring(digest, 1, 60)).otherwise(digest).alias("source_sha256"), (k % 10 - 1).alias("t0"), (c % 12).alias("t1"), F.when(k % 13 == 0, "").otherwise("p").alias("producer_version"), F.lit("v").alias("video_id"))
    return checks.violations(e, ["o_orderkey"], checks.provenance_rules())


@query(
    f"{base._T}, s AS (SELECT video_id, count(*) + CASE WHEN video_id IN ('v1', 'v4') THEN 1 ELSE 0 END AS e, count(*) FILTER (status = 'embedded') AS m, count(*) FILTER (status = 'decode_failed') AS f, count(*) FILTER (status = 'skipped') AS k FROM ticks GROUP BY video_id) "
    "SELECT video_id, 'counts_add_up' AS violation FROM s WHERE m + f + k <> e UNION ALL SELECT video_id, 'coverage_is_share' FROM s WHERE video_id IN ('v1', 'v4')"
)
def summary_invariants(spark, d):
    """Two videos' summaries count a tick too many, after their coverage was computed."""
    s = ledger.coverage(src.ticks(spark, d), ["video_id"]).withColumn("expected", F.col("expected") + F.when(F.col("video_id").isin("v1", "v4"), 1).otherwise(0))
    return checks.violations(s, ["video_id"], checks.summary_rules())


@query("WITH v AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'budget_reached' WHEN 2 THEN 'system_failure' ELSE 'done' END AS state, o_custkey % 9 AS total, o_orderkey % 10 AS verified FROM orders) " + _found({"state": "state = 'done'", "verified_within_total": "verified > total", "complete_covers_all": "state = 'complete' AND verified <> total"}, "o_orderkey", "v"))
def verification_invariants(spark, d):
    k = F.col("o_orderkey")
    state = F.when(k % 4 == 0, "complete").when(k % 4 == 1, "budget_reached").when(k % 4 == 2, "system_failure").otherwise("done")
    v = src.parquet(spark, d, "orders").select("o_orderkey", state.alias("state"), (F.col("o_custkey") % 9).alias("clusters_total"), (k % 10).alias("clusters_verified"))
    return checks.violations(v, ["o_orderkey"], checks.verification_rules())


@query("WITH c AS (SELECT o_orderkey, o_orderkey % 8 AS t0, o_custkey % 9 AS t1, o_orderkey % 5 AS n, o_custkey % 4 AS m FROM orders) " + _found({"interval": "t1 <= t0", "some_channel": "n = 0", "channels_have_scores": "n > 1 AND m <> 1"}, "o_orderkey", "c"))
def candidate_invariants(spark, d):
    """Candidates with no channel, one, or two of which a score is missing."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    some = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    scores = F.when(c % 4 == 1, F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), F.lit(0.25))).otherwise(F.create_map(F.lit("a"), F.lit(0.5)))
    rows = src.parquet(spark, d, "orders").select("o_orderkey", (k % 8).alias("t0"), (c % 9).alias("t1"), some.alias("qualifying"), scores.alias("scores"))
    return checks.violations(rows, ["o_orderkey"], checks.candidate_rules())


@query("SELECT o_orderkey, o_custkey % 5 >= o_orderkey % 5 AND o_orderkey % 3 <> 0 AS complete FROM orders")
def assembly_completeness(spark, d):
    k = F.col("o_orderkey")
    return src.parquet(spark, d, "orders").select("o_orderkey", checks.assembly_complete(k % 5, F.col("o_custkey") % 5, k % 3 == 0).alias("complete"))


@query(f"WITH {base._RANKED} SELECT channels, count(*) AS candidates, count(DISTINCT video_id) AS videos, round(min(best), 6) AS least, round(max(best), 6) AS most FROM fused GROUP BY channels")
def candidate_report(spark, d):
    """What fusion reports of its candidates, by their channels."""
    f = base.fuse.fuse(base._scored(spark, d))
    return base._round(f.groupBy("channels").agg(F.count("*").alias("candidates"), F.countDistinct("video_id").alias("videos"), F.min("best").alias("least"), F.max("best").alias("most")), "least", "most")


@query("WITH f AS (SELECT l_orderkey AS frame_id, CASE WHEN l_linenumber % 3 = 0 THEN 100000000 ELSE 0 END AS plus, l_linenumber FROM lineitem) SELECT frame_id + plus AS frame_id, l_linenumber, CASE WHEN plus = 0 THEN o_custkey END AS pts, plus = 0 AS known FROM f JOIN orders ON frame_id = o_orderkey")
def frame_pts_lookup(spark, d):
    """Times of cited frames; ids that no frame has are marked."""
    cited = src.parquet(spark, d, "lineitem").select((F.col("l_orderkey") + F.when(F.col("l_linenumber") % 3 == 0, 100000000).otherwise(0)).alias("frame_id"), "l_linenumber")
    frames = src.parquet(spark, d, "orders").select(F.col("o_orderkey").alias("frame_id"), F.col("o_custkey").alias("pts"))
    strange = checks.unknown_ids(cited, frames, "frame_id").withColumn("pts", F.lit(None).cast("long")).withColumn("known", F.lit(False))
    return cited.join(frames, "frame_id").select("frame_id", "l_linenumber", "pts", F.lit(True).alias("known")).unionByName(strange)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'count' WHEN o_orderkey % 3 = 0 THEN 'visible_none' WHEN o_orderkey % 2 = 0 THEN 'disjunction' WHEN o_orderkey % 7 = 0 THEN 'group' END AS outcome FROM orders")
def outcome_lookup(spark, d):
    """A logic group's true outcome: of its count, else its absence, else its choice, else its own."""
    k = F.col("o_orderkey")
    o = src.parquet(spark, d, "orders").select("o_orderkey", F.when(k % 7 == 0, "group").alias("own"))
    of = lambda m, name: o.where(k % m == 0).select("o_orderkey", F.lit(name).alias(name))
    met = o.join(of(5, "count"), "o_orderkey", "left").join(of(3, "visible_none"), "o_orderkey", "left").join(of(2, "disjunction"), "o_orderkey", "left")
    return met.select("o_orderkey", F.coalesce("count", "visible_none", "disjunction", "own").alias("outcome"))


@query("SELECT o_custkey % 20 AS archive, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS versions FROM orders GROUP BY ALL")
def policy_versions(spark, d):
    return src.parquet(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("archive")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("versions"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'full_gpu' WHEN o_orderstatus = 'O' THEN 'restricted_gpu' WHEN o_custkey % 2 = 0 THEN 'mlx_verifier' ELSE 'retrieval_only' END AS mode FROM orders")
def fallback_modes(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "healthy").when(F.col("o_orderstatus") == "O", "slow").otherwise("down")
    return src.parquet(spark, d, "orders").select("o_orderkey", checks.fallback_mode(state, F.col("o_custkey") % 2 == 0).alias("mode"))


@query(f"{base._T} SELECT actor, count(DISTINCT video_id || camera_id || '-' || (tick_id % 1000 = 0)) AS scopes FROM ticks GROUP BY actor HAVING count(DISTINCT video_id || camera_id || '-' || (tick_id % 1000 = 0)) > 1")
def tracklet_scope(spark, d):
    """Tracklets whose detections lie in more than one session; every thousandth tick is in another one."""
    t = src.ticks(spark, d).withColumn("session", F.concat("video_id", "camera_id", F.lit("-"), (F.col("tick_id") % 1000 == 0).cast("string")))
    return t.groupBy("actor").agg(F.countDistinct("session").alias("scopes")).where("scopes > 1")


@query("WITH r AS (SELECT o_orderkey AS run, o_orderkey % 4 = 0 AS broken, o_orderkey % 3 = 0 AS altered, o_custkey % 2 = 0 AS child, o_orderkey % 8 = 0 AS migrated FROM orders), s AS (SELECT run, broken OR altered AS changed, CASE WHEN broken AND NOT migrated THEN 'critical_mismatch' WHEN (broken OR altered) AND NOT child THEN 'needs_child_run' WHEN NOT (broken OR altered) AND child THEN 'needs_same_run' END AS refused FROM r) SELECT run, refused IS NULL AS allowed, refused IS NULL AND NOT changed AS exact, refused FROM s")
def resume_check(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    side = lambda run, parent, critical, config: F.struct(run.alias("run_id"), parent.alias("parent"), critical.alias("critical"), config.alias("config"), F.lit("gpu").alias("device"))
    word = F.lit
    old = side(word("r1"), word("r0"), word("x"), word("c"))
    new = side(F.when(c % 2 == 0, "r2").otherwise("r1"), F.when(c % 2 == 0, "r1").otherwise("r0"), F.when(k % 4 == 0, "y").otherwise("x"), F.when(k % 3 == 0, "d").otherwise("c"))
    rows = src.parquet(spark, d, "orders").select(k.alias("run"), old.alias("old"), new.alias("new"), F.when(k % 8 == 0, "m1").alias("migration"))
    return checks.resume(rows, "run")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'seal' END AS violation FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'files' FROM orders WHERE o_orderkey % 8 = 0")
def manifest_seals(spark, d):
    """Session manifests: their seal is the hash of their content, and every fifth was changed after it."""
    k = F.col("o_orderkey")
    files = F.when(k % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("f"), k.cast("string"))))
    content = lambda note: F.sha2(F.to_json(F.struct(k.alias("session"), files.alias("files"), note.alias("note"))), 256)
    rows = src.parquet(spark, d, "orders").select("o_orderkey", F.concat(F.lit("s"), k.cast("string")).alias("session_id"), F.array(F.lit("cam")).alias("cameras"), files.alias("files"), content(F.when(k % 5 == 0, "old").otherwise("now")).alias("content_hash"), content(F.lit("now")).alias("sealed"))
    return checks.violations(rows, ["o_orderkey"], checks.manifest_rules())


_TRUTH = "t AS (SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS absent, CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_partkey % 2 = 0 THEN 'visible_absence_supported' ELSE 'unresolved' END WHEN l_partkey % 4 = 0 THEN 'unresolved' ELSE (l_partkey % 9)::VARCHAR END AS outcome, l_suppkey % 3 <> 0 AND l_suppkey % 5 <> 0 AS certain, l_suppkey % 4 = 0 OR l_suppkey % 6 = 0 AS hard FROM lineitem)"


@query(f"WITH {_TRUTH} SELECT l_orderkey, l_linenumber, 'absence_needs_coverage' AS violation FROM t WHERE absent AND outcome = 'visible_absence_supported' AND NOT certain UNION ALL SELECT l_orderkey, l_linenumber, 'count_under_stress' FROM t WHERE NOT absent AND outcome <> 'unresolved' AND hard UNION ALL SELECT l_orderkey, l_linenumber, 'count_within_bound' FROM t WHERE NOT absent AND outcome <> 'unresolved' AND outcome::INT > 6")
def track_logic_safety(spark, d):
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    absent = F.col("l_linenumber") % 2 == 0
    outcome = F.when(absent, F.when(p % 2 == 0, "visible_absence_supported").otherwise("unresolved")).when(p % 4 == 0, "unresolved").otherwise((p % 9).cast("string"))
    rows = src.parquet(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(absent, "visible_none").otherwise("count").alias("kind"), outcome.alias("outcome"), (s % 3 != 0).alias("assessable"), (s % 5 != 0).alias("ticks_complete"), F.when(s % 4 == 0, "high").alias("fragmentation"), F.when(s % 6 == 0, "heavy").alias("occlusion"), F.lit(6).alias("bound")
    )
    return checks.violations(rows, ["l_orderkey", "l_linenumber"], checks.track_logic_rules())


@query("WITH f AS (SELECT 'sc' || o_custkey AS scenario, o_orderkey % 2 AS split, o_orderstatus AS pool, ['se' || (o_orderkey // 2), 'se' || (o_orderkey // 3)] AS sessions FROM orders), s AS (SELECT split, unnest(sessions) AS session FROM f) SELECT scenario AS item, 'scenario_split' AS fault, count(DISTINCT split) AS \"values\" FROM f GROUP BY scenario HAVING count(DISTINCT split) > 1 UNION ALL SELECT scenario, 'scenario_pool', count(DISTINCT pool) FROM f GROUP BY scenario HAVING count(DISTINCT pool) > 1 UNION ALL SELECT session, 'session_split', count(DISTINCT split) FROM s GROUP BY session HAVING count(DISTINCT split) > 1")
def split_discipline(spark, d):
    k = F.col("o_orderkey")
    s = lambda n: F.concat(F.lit("se"), F.floor(k / n).cast("string"))
    f = src.parquet(spark, d, "orders").select(F.concat(F.lit("sc"), "o_custkey").alias("scenario"), (k % 2).alias("split"), F.col("o_orderstatus").alias("pool"), F.array(s(2), s(3)).alias("sessions"))
    return checks.split_faults(f)


@query("WITH r AS (SELECT o_orderkey, o_orderkey % 6 AS n, o_custkey % 6 AS m, o_orderkey % 3 AS rel, o_custkey % 7 AS a, o_orderkey % 5 AS b, o_custkey % 11 = 0 AS back FROM orders) " + _found({"length": "n = 0 OR n <> CASE WHEN m = 5 THEN n + 1 ELSE n END", "pts_rise": "back AND n >= 2", "features_aligned": "m = 4 AND n <> 2", "relevance": "rel = 2", "start_in_sequence": "a > n - 1", "end_in_sequence": "b > n - 1", "start_before_end": "a > b", "bounds": "o_orderkey % 17 = 0"}, "o_orderkey", "r"))
def feature_checks(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    n = k % 6
    pts = upto(n + F.when(c % 6 == 5, 1).otherwise(0))
    rows = src.parquet(spark, d, "orders").select(
        "o_orderkey", upto(n).alias("frame_ids"), F.when(c % 11 == 0, F.reverse(pts)).otherwise(pts).cast("array<double>").alias("pts"), F.create_map(F.lit("x"), F.when(c % 6 == 4, F.array(F.lit(1.0), F.lit(2.0))).otherwise(upto(n).cast("array<double>"))).alias("features"),
        (k % 3).alias("relevance"), (c % 7).alias("start_index"), (k % 5).alias("end_index"), F.lit(0).alias("t0"), F.when(k % 17 == 0, 0).otherwise(5).alias("t1"),
    )
    return checks.violations(rows, ["o_orderkey"], checks.feature_rules())


@query("WITH h AS (SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS ocr, l_partkey % 5 <> 0 AS known, l_suppkey % 6 AS t1, l_partkey % 9 = 0 AS blank FROM lineitem) SELECT l_orderkey, l_linenumber, 'frame' AS violation FROM h WHERE ocr AND NOT known UNION ALL SELECT l_orderkey, l_linenumber, 'interval' FROM h WHERE NOT ocr AND t1 <= 2 UNION ALL SELECT l_orderkey, l_linenumber, 'text' FROM h WHERE blank")
def text_hit_checks(spark, d):
    p = F.col("l_partkey")
    rows = src.parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, "ocr").otherwise("asr").alias("kind"), (p % 5 != 0).alias("frame_known"), F.lit(2).alias("t0"), (F.col("l_suppkey") % 6).alias("t1"), F.when(p % 9 == 0, "  ").otherwise("x").alias("text"))
    return checks.violations(rows, ["l_orderkey", "l_linenumber"], checks.text_hit_rules())


@query("WITH e AS (SELECT o_orderkey, o_custkey % 4 AS t1, o_orderkey % 9 AS x, o_custkey % 9 AS o, o_orderkey % 5 AS a, o_orderkey % 2 = 0 AS whole FROM orders) " + _found({"interval": "t1 < 1", "counts": "x < o OR o < a", "complete_is_observed": "whole AND o <> x"}, "o_orderkey", "e"))
def episode_declarations(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = src.parquet(spark, d, "orders").select("o_orderkey", F.lit(1).alias("t0"), (c % 4).alias("t1"), (k % 9).alias("expected_ticks"), (c % 9).alias("observed_ticks"), (k % 5).alias("assessable_ticks"), (k % 2 == 0).alias("coverage_complete"))
    return checks.violations(rows, ["o_orderkey"], checks.episode_rules())


_PROBED = """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 7.5::DOUBLE ELSE (o_custkey % 50)::DOUBLE END AS duration, CASE o_orderkey % 3 WHEN 0 THEN '1/90000' WHEN 1 THEN '1/0' ELSE '25' END AS time_base, 1::BIGINT AS stream, CASE WHEN o_orderkey % 2 = 0 THEN '2024-01-01T00:00:00Z' END AS recording_start, CASE WHEN o_orderkey % 3 = 1 THEN 'invalid_time_base' END AS fault FROM orders"""


@query(_PROBED)
def probe_metadata(spark, d):
    """Probe documents: sound first, video second; durations of the stream, of the format, or negative ones that count as none."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    own = F.when(k % 4 == 0, "-1").when(k % 4 == 1, "inf").otherwise((c % 50).cast("string"))
    of_format = F.when(k % 4 == 1, "7.5").otherwise("nan")
    base_ = F.when(k % 3 == 0, "1/90000").when(k % 3 == 1, "1/0").otherwise("25")
    tags = F.when(k % 2 == 0, F.create_map(F.lit("creation_time"), F.lit("2024-01-01T00:00:00Z")))
    stream = lambda i, kind, dur: F.struct(F.lit(i).alias("index"), F.lit(kind).alias("codec_type"), dur.alias("duration"), base_.alias("time_base"), tags.alias("tags"))
    raw = F.to_json(F.struct(F.array(stream(0, "audio", F.lit("3")), stream(1, "video", own)).alias("streams"), F.struct(of_format.alias("duration")).alias("format")))
    return src.parquet(spark, d, "orders").select("o_orderkey", checks.probe(raw).alias("p")).select("o_orderkey", "p.*")


@query("SELECT o_custkey % 100 AS bench, count(*) AS strange FROM orders WHERE o_custkey % 100 >= 80 GROUP BY ALL")
def unknown_measurements(spark, d):
    """Measurements whose benchmark no list names."""
    rows = src.parquet(spark, d, "orders").select((F.col("o_custkey") % 100).alias("bench"))
    return checks.unknown_ids(rows, spark.range(80).select(F.col("id").alias("bench")), "bench").groupBy("bench").agg(F.count("*").alias("strange"))


_RUNS = "r AS (SELECT o_custkey % 97 AS bench, CASE WHEN o_orderkey % 6 = 0 THEN 'cold' ELSE 'warm' END AS phase, o_orderkey % 11 <> 0 AS success, (o_orderkey % 41)::DOUBLE AS latency, CASE WHEN o_custkey % 97 = 5 AND o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS hits FROM orders)"
_SUMMARY = f"{_RUNS}, s AS (SELECT bench, count(latency) FILTER (phase = 'warm' AND success) AS warm_runs, min(latency) FILTER (phase = 'cold' AND success) AS cold, CAST(sum(hits) AS BIGINT) AS cache_hits, count(*) FILTER (NOT success) AS failures, median(latency) FILTER (phase = 'warm' AND success) AS m, quantile_disc(latency, 0.95) FILTER (phase = 'warm' AND success) AS p FROM r GROUP BY bench), u AS (SELECT bench, warm_runs, cold, cache_hits, failures, CASE WHEN warm_runs >= 10 THEN m END AS median, CASE WHEN warm_runs >= 20 THEN p END AS p95 FROM s), b AS (SELECT *, list_filter([CASE WHEN cache_hits > 0 THEN 'cache_hits' END, CASE WHEN warm_runs < 10 THEN 'few_warm_runs' END, CASE WHEN warm_runs < 20 THEN 'p95_not_reportable' END, CASE WHEN median IS NULL OR median > 20 THEN 'median_above_limit' END], lambda x: x IS NOT NULL) AS bl FROM u)"


@query(f"WITH {_SUMMARY} SELECT bench, warm_runs, cold, cache_hits, failures, median, p95, array_to_string(bl, ',') AS blockers, len(bl) = 0 AS passed FROM b")
def benchmark_summary(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = src.parquet(spark, d, "orders").select((c % 97).alias("bench"), F.when(k % 6 == 0, "cold").otherwise("warm").alias("phase"), (k % 11 != 0).alias("success"), (k % 41).cast("double").alias("latency"), F.when((c % 97 == 5) & (k % 2 == 0), 1).otherwise(0).cast("long").alias("cache_hits"))
    return checks.benchmark_summary(rows, 20.0)


_GATE = "m AS (SELECT o_orderkey, (o_orderkey % 10) / 100.0::DOUBLE AS gain, o_custkey % 9 AS calls, o_custkey % 3 > 0 AS same, (o_orderkey % 7) / 100.0::DOUBLE AS loss, o_orderkey % 5 = 0 AS macro, o_custkey % 5 = 0 AS atom, o_orderkey % 8 = 0 AS whole, o_custkey % 6 = 0 AS slow, o_orderkey % 9 = 0 AS unexercised FROM orders), g AS (SELECT *, CASE WHEN gain >= 0.03 THEN 'temporal_set_f1' WHEN calls <= 6 AND same THEN 'calls_at_same_recall' END AS improvement FROM m), b AS (SELECT *, list_filter([CASE WHEN improvement IS NULL THEN 'no_improvement' END, CASE WHEN loss > 0.025 THEN 'rejection' END, CASE WHEN macro THEN 'macro' END, CASE WHEN atom THEN 'atom' END, CASE WHEN whole THEN 'complete_set' END, CASE WHEN slow THEN 'latency' END, CASE WHEN unexercised THEN 'fallback' END], lambda x: x IS NOT NULL) AS bl FROM g)"


@query(f"WITH {_GATE} SELECT o_orderkey, improvement, array_to_string(bl, ',') AS blockers, len(bl) = 0 AS passed FROM b")
def ship_gate(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    half = F.lit(0.5)
    drop = lambda bad: F.when(bad, 0.4).otherwise(0.5)
    rows = src.parquet(spark, d, "orders").select(
        "o_orderkey", half.alias("base_f1"), (half + (k % 10) / 100).alias("new_f1"), F.lit(8).alias("base_calls"), (c % 9).alias("new_calls"), half.alias("base_recall"), drop(c % 3 == 0).alias("new_recall"), half.alias("base_rejection"), (half - (k % 7) / 100).alias("new_rejection"),
        half.alias("base_macro"), drop(k % 5 == 0).alias("new_macro"), half.alias("base_atom"), drop(c % 5 == 0).alias("new_atom"), half.alias("base_complete"), drop(k % 8 == 0).alias("new_complete"), F.when(c % 6 == 0, 1.0).otherwise(0.5).alias("latency"), (k % 9 != 0).alias("fallback"),
    )
    return checks.ship_gate(rows, ["o_orderkey"], 0.025)


@query("WITH m AS (SELECT o_orderkey, o_orderkey % 30 AS e, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey % 4 END AS wrong, o_orderkey % 6 = 0 AS gross, o_custkey % 7 = 0 AS slow, o_orderkey % 8 = 0 AS changed FROM orders), b AS (SELECT o_orderkey, wrong, list_filter([CASE WHEN e < 20 THEN 'few_instances' END, CASE WHEN wrong IS NULL OR wrong = 1 THEN 'wrong_region' END, CASE WHEN gross THEN 'gross_box' END, CASE WHEN slow THEN 'latency' END, CASE WHEN changed THEN 'verdict_changed' END], lambda x: x IS NOT NULL) AS bl FROM m) SELECT o_orderkey, CASE WHEN wrong IS NULL THEN 'not_measured' ELSE 'measured' END AS status, array_to_string(bl, ',') AS blockers, len(bl) = 0 AS passed FROM b")
def grounding_gate(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    right = F.when(c % 10 != 0, k % 30 - F.when(c % 4 == 1, 1).otherwise(0))
    rows = src.parquet(spark, d, "orders").select("o_orderkey", (k % 30).alias("evaluated"), right.alias("correct"), F.when(k % 6 == 0, 2).otherwise(0).alias("gross"), F.when(c % 7 == 0, 3.0).otherwise(1.0).alias("latency"), F.lit(2.0).alias("max_latency"), (k % 8 != 0).alias("unchanged"))
    return checks.grounding_gate(rows, ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'not_accepted' WHEN o_custkey % 5 = 0 THEN 'propagation_disabled' WHEN o_custkey % 4 = 0 THEN 'grounding_gate_not_passed' WHEN o_orderkey % 4 = 0 THEN 'no_valid_seed_boxes' END AS reason FROM orders")
def propagation_scope(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = src.parquet(spark, d, "orders").select("o_orderkey", (k % 3 != 0).alias("verified_match"), (c % 5 != 0).alias("enabled"), (c % 4 != 0).alias("gate_passed"), (k % 4).alias("seeds"))
    return checks.propagation(rows).select("o_orderkey", "reason")


_TRAIN = """r AS (SELECT o_custkey % 31 AS "set", o_custkey AS scenario, o_orderkey % 40 AS session, o_orderkey AS episode, CASE WHEN o_custkey % 31 % 4 = 0 THEN o_orderkey % 3 ELSE (o_custkey + o_orderkey % 40) % 3 END AS split, o_orderkey % 2 AS relevance, o_custkey % 31 <> 7 AND o_orderkey % 10 = 0 AS absent, CASE o_orderkey % 3 WHEN 0 THEN 'order' WHEN 1 THEN 'colour' ELSE CASE WHEN o_custkey % 31 % 5 = 0 THEN 'other' ELSE 'absent_object' END END AS challenger FROM orders),
l AS (SELECT "set", count(*) FILTER (n > 1) AS leaked FROM (SELECT "set", scenario, session, count(DISTINCT split) AS n FROM r GROUP BY ALL) GROUP BY "set"),
f AS (SELECT "set", count(DISTINCT episode) AS episodes, count(*) FILTER (relevance = 1) AS pos, count(*) FILTER (absent) AS abs, count(*) FILTER (challenger = 'absent_object') AS c0, count(*) FILTER (challenger = 'colour') AS c1, count(*) FILTER (challenger = 'order') AS c2, count(*) FILTER (split = 0) AS s0, count(*) FILTER (split = 1) AS s1, count(*) FILTER (split = 2) AS s2 FROM r GROUP BY "set"),
b AS (SELECT f."set", episodes, list_filter([CASE WHEN episodes < 40 THEN 'few_episodes' END, CASE WHEN pos = 0 THEN 'no_positive' END, CASE WHEN abs = 0 THEN 'no_absent' END, CASE WHEN c0 = 0 THEN 'no_absent_object' END, CASE WHEN c1 = 0 THEN 'no_colour' END, CASE WHEN c2 = 0 THEN 'no_order' END, CASE WHEN leaked > 0 THEN 'leak' END, CASE WHEN s0 = 0 THEN 'no_train_group' END, CASE WHEN s1 = 0 THEN 'no_dev_group' END, CASE WHEN s2 = 0 THEN 'no_test_group' END], lambda x: x IS NOT NULL) AS bl FROM f JOIN l ON f."set" = l."set")"""


@query(f"""WITH {_TRAIN} SELECT "set", episodes, array_to_string(bl, ',') AS blockers, len(bl) = 0 AS passed FROM b""")
def training_gate(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    part = c % 31
    split = F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("test")), (F.when(part % 4 == 0, k % 3).otherwise((c + k % 40) % 3) + 1).cast("int"))
    challenger = F.when(k % 3 == 0, "order").when(k % 3 == 1, "colour").when(part % 5 == 0, "other").otherwise("absent_object")
    rows = src.parquet(spark, d, "orders").select(part.alias("set"), c.alias("scenario"), (k % 40).alias("session"), k.alias("episode"), split.alias("split"), (k % 2).alias("relevance"), ((part != 7) & (k % 10 == 0)).alias("absent"), challenger.alias("challenger"))
    return checks.training_gate(rows, ["set"], 40, ["absent_object", "colour", "order"], ["train", "dev", "test"])


@query("WITH l AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'model_error' ELSE 'insufficient_context' END AS reason, doc_id % 7 = 0 AS open FROM labels) SELECT reason, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM l), 6) AS rate FROM l WHERE open GROUP BY reason")
def undetermined_reasons(spark, d):
    """How often and why predictions are undetermined, of all items."""
    k = F.col("doc_id")
    rows = src.parquet(spark, d, "labels").select(F.when(k % 4 == 0, "timeout").when(k % 4 == 1, "model_error").otherwise("insufficient_context").alias("reason"), F.when(k % 7 == 0, "undetermined").otherwise("supported").alias("predicted"))
    return base._round(evaluate.reasons(rows), "rate")


@query("WITH t AS (SELECT lang, unnest(['src:' || source, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END]) AS tag FROM documents) SELECT lang, tag, count(*) AS n, grouping(lang) = 0 AND grouping(tag) = 1 AS subtotal FROM t GROUP BY GROUPING SETS ((lang, tag), (lang))")
def tag_histogram(spark, d):
    """Items by language and tag (an item has two), and by language alone."""
    docs = src.parquet(spark, d, "documents").select("lang", F.explode(F.array(F.concat(F.lit("src:"), "source"), F.when(F.col("n_chars") > 1000, "long").otherwise("short"))).alias("tag"))
    return docs.groupingSets([["lang", "tag"], ["lang"]], "lang", "tag").agg(F.count("*").alias("n"), (F.grouping("tag") == 1).alias("subtotal"))


@query(f"{base._T}, f AS (SELECT actor, count(*) AS n, count(*) FILTER (status <> 'embedded') AS broken FROM ticks GROUP BY actor) SELECT count(*) AS tracks, round((count(*) FILTER (broken > 0))::DOUBLE / count(*), 6) AS fragmentation, round((count(*) FILTER (n > 15))::DOUBLE / count(*), 6) AS duplicates, (SELECT round((count(*) FILTER (tick_id % 13 <> 0))::DOUBLE / count(*), 6) FROM ticks) AS edge_validity, NULL::DOUBLE AS overlay_failure FROM f")
def track_rates(spark, d):
    """Rates of tracks and edges; one without a denominator is null."""
    t = src.ticks(spark, d)
    f = t.groupBy("actor").agg(F.count("*").alias("n"), F.count_if(F.col("status") != "embedded").alias("broken"))
    rates = f.agg(F.count("*").alias("tracks"), evaluate.rate(F.count_if(F.expr("broken > 0")), F.count("*")).alias("fragmentation"), evaluate.rate(F.count_if(F.expr("n > 15")), F.count("*")).alias("duplicates"), evaluate.rate(F.count_if(F.expr("n < 0")), F.count_if(F.expr("n < 0"))).alias("overlay_failure"))
    valid = t.agg(evaluate.rate(F.count_if(F.expr("tick_id % 13 <> 0")), F.count("*")).alias("edge_validity"))
    return base._round(rates.join(F.broadcast(valid), F.lit(True)), "fragmentation", "duplicates", "edge_validity")


_BEST = gov._BEST
_CONFIGS = f"""{_BEST}, c AS (SELECT unnest([1, 2, 3]) AS config), m AS (SELECT c.config, g.camera, g.id, coalesce(max(p.inter / (p.len - p.inter)), 0) AS best FROM c, g LEFT JOIN pairs p ON p.id = g.id AND p.rank % c.config = 0 GROUP BY ALL),
q AS (SELECT config, camera, count(*) AS total, count(*) FILTER (best > 0) AS hit, bool_and(best > 0) AS whole FROM m GROUP BY ALL)"""


@query(f"WITH {_CONFIGS} SELECT config, CAST(sum(hit) AS BIGINT) AS hits, CAST(sum(total) AS BIGINT) AS truths, round(sum(hit)::DOUBLE / sum(total), 6) AS interval_recall, round(avg(whole::INT::DOUBLE), 6) AS complete_set FROM q GROUP BY config")
def config_scores(spark, d):
    """Three configurations over all queries (cameras): recall weighted by a query's intervals, and whole queries. Configuration n keeps every nth find."""
    truth, found = gov._truth(spark, d), gov._found(spark, d).withColumn("rank", gov.intervals.rank_by(["camera"], F.col("t0"), F.col("id")))
    configs = F.explode(F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.col("rank") % n == 0)).alias("config")
    bundles = found.select("camera", "id", "t0", "t1", configs)
    return base._round(evaluate.score_configs(truth, bundles, [1, 2, 3], "camera", 96), "interval_recall", "complete_set")


@query(f"{ev._LEDGER}, p AS (SELECT lane, video_id, count(*) AS expected, count(*) FILTER (status = 'embedded') AS embedded FROM led GROUP BY ALL) SELECT lane, count(*) AS videos, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(embedded) AS BIGINT) AS embedded, count(*) FILTER (embedded < expected) AS incomplete FROM p GROUP BY lane")
def lane_coverage(spark, d):
    """Coverage by sampling lane: how many videos a lane covers wholly."""
    c = ledger.coverage(ev._ledger(spark, d), ["lane", "video_id"])
    return c.groupBy("lane").agg(F.count("*").alias("videos"), F.sum("expected").alias("expected"), F.sum("embedded").alias("embedded"), F.count_if(F.expr("embedded < expected")).alias("incomplete"))
