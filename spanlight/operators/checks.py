"""Invariants and gates: queries that return violations, and verdicts over measured numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, id_: list[str], rules: dict[str, Column]) -> DataFrame:
    """(id_, violation): one row for each rule that a row breaks; a rule holds where its column is true, and null breaks it."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(*id_, F.explode(broken).alias("violation"))


def provenance_rules() -> dict[str, Column]:
    """Of evidence: video_id, source_sha256, t0, t1, producer_version."""
    return {
        "source_digest": F.col("source_sha256").rlike(r"\A[0-9a-fA-F]{64}\z"), "interval": (F.col("t0") >= 0) & (F.col("t1") >= F.col("t0")),
        "producer": F.length("producer_version") > 0, "video": F.length("video_id") > 0,
    }


def tick_rules() -> dict[str, Column]:
    """Of a ledger's ticks: an embedded one has a frame, a failed one an error code."""
    return {"embedded_needs_frame": (F.col("status") != "embedded") | F.col("frame_id").isNotNull(), "failed_needs_error": (F.col("status") != "decode_failed") | (F.length("error_code") > 0)}


def summary_rules() -> dict[str, Column]:
    """Of counts: expected, embedded, decode_failed, skipped, coverage."""
    share = F.coalesce(F.try_divide("embedded", "expected"), F.lit(0.0))
    return {"counts_add_up": F.col("embedded") + F.col("decode_failed") + F.col("skipped") == F.col("expected"), "coverage_is_share": F.abs(F.col("coverage") - share) <= 1e-9}


def verification_rules() -> dict[str, Column]:
    """Of a verification's summary: state, clusters_total, clusters_verified."""
    return {
        "state": F.col("state").isin("complete", "budget_reached", "system_failure"), "verified_within_total": F.col("clusters_verified") <= F.col("clusters_total"),
        "complete_covers_all": (F.col("state") != "complete") | (F.col("clusters_verified") == F.col("clusters_total")),
    }


def candidate_rules() -> dict[str, Column]:
    """Of candidates: t0, t1, scores (a map) and qualifying (channels)."""
    return {"interval": F.col("t1") > F.col("t0"), "some_channel": F.size("qualifying") > 0, "channels_have_scores": F.size(F.array_except("qualifying", F.map_keys("scores"))) == 0}


def assembly_complete(qualifying: Column, retained: Column, cap_bound: Column) -> Column:
    """An assembly that let anchors go, or met its cap, is not complete, whatever it says."""
    return (retained >= qualifying) & ~cap_bound


def manifest_rules() -> dict[str, Column]:
    """Of a session's manifest: session_id, cameras and files (arrays), content_hash, sealed (the hash of its content)."""
    return {"session": F.length("session_id") > 0, "cameras": F.size("cameras") > 0, "files": F.size("files") > 0, "seal": F.col("content_hash") == F.col("sealed")}


def track_logic_rules() -> dict[str, Column]:
    """Of track-logic truths: kind, outcome, assessable, ticks_complete, fragmentation, occlusion, bound."""
    number = F.expr("try_cast(outcome AS BIGINT)")
    certain = F.coalesce(F.col("assessable") & F.col("ticks_complete"), F.lit(False))
    counted = (F.col("kind") == "count") & number.isNotNull()
    hard = F.coalesce(F.col("fragmentation") == "high", F.lit(False)) | F.coalesce(F.col("occlusion") == "heavy", F.lit(False))
    return {
        "absence_needs_coverage": ~((F.col("kind") == "visible_none") & (F.col("outcome") == "visible_absence_supported")) | certain,
        "count_under_stress": ~counted | ~hard, "count_within_bound": ~counted | F.col("bound").isNull() | (number <= F.col("bound")),
    }


def feature_rules() -> dict[str, Column]:
    """Of reranker records: frame_ids and pts (arrays), features (map of arrays), relevance, start_index, end_index, t0, t1."""
    n = F.size("frame_ids")
    index = lambda c: F.col(c).isNull() | F.col(c).between(0, n - 1)
    rising = F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (n < 2) | (F.try_element_at("pts", i) <= F.try_element_at("pts", i + 1)))
    return {
        "length": (n > 0) & (F.size("pts") == n), "pts_rise": F.coalesce(rising, F.lit(False)), "features_aligned": F.forall(F.map_values("features"), lambda v: F.size(v) == n), "relevance": F.col("relevance").isin(0, 1),
        "start_in_sequence": index("start_index"), "end_in_sequence": index("end_index"), "start_before_end": F.coalesce(F.col("start_index") <= F.col("end_index"), F.lit(True)), "bounds": F.col("t1") > F.col("t0"),
    }


def text_hit_rules() -> dict[str, Column]:
    """Of text hits: kind (ocr or asr), frame_known, t0, t1, text."""
    return {"frame": (F.col("kind") != "ocr") | F.col("frame_known"), "interval": (F.col("kind") != "asr") | (F.col("t1") > F.col("t0")), "text": F.length(F.trim("text")) > 0}


def episode_rules() -> dict[str, Column]:
    """Of declared episodes: t0, t1 and the safety that they declare (expected, observed, assessable ticks, complete)."""
    return {
        "interval": F.col("t1") >= F.col("t0"), "counts": (F.col("expected_ticks") >= F.col("observed_ticks")) & (F.col("observed_ticks") >= F.col("assessable_ticks")) & (F.col("assessable_ticks") >= 0),
        "complete_is_observed": ~F.col("coverage_complete") | (F.col("observed_ticks") == F.col("expected_ticks")),
    }


def unknown_ids(rows: DataFrame, known: DataFrame, id_: str) -> DataFrame:
    """Rows whose id is not known."""
    return rows.join(known.select(F.col(id_).alias("known_")).distinct(), F.col(id_) == F.col("known_"), "left_anti")


def single_valued(rows: DataFrame, group: str, value: str, fault: str) -> DataFrame:
    """(item, fault) of groups with more than one value."""
    return rows.groupBy(F.col(group).alias("item")).agg(F.countDistinct(value).alias("values")).where("values > 1").select("item", F.lit(fault).alias("fault"), "values")


def split_faults(families: DataFrame) -> DataFrame:
    """families: scenario, split, pool, sessions (array). A scenario or session in several splits, or a scenario in several pools."""
    sessions = families.select("split", F.explode("sessions").alias("session"))
    return reduce(lambda a, b: a.unionByName(b), [single_valued(families, "scenario", "split", "scenario_split"), single_valued(families, "scenario", "pool", "scenario_pool"), single_valued(sessions, "session", "split", "session_split")])


def blockers(row: DataFrame, keys: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds blockers, the names of the rules that hold, and passed; a rule on a missing measurement (null) holds."""
    held = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules]))
    return row.select(*keys, F.array_join(held, ",").alias("blockers"), (F.size(held) == 0).alias("passed"))


def training_gate(records: DataFrame, keys: list[str], least: int, challengers: list[str], splits: list[str]) -> DataFrame:
    """records: keys, scenario, session, episode, split, relevance, absent, challenger. What keeps each data set from being trained on."""
    n = lambda c: F.count_if(c)
    episodes = F.countDistinct("scenario", "session", "episode")
    leaks = records.groupBy(*[F.col(k).alias(f"{k}_l") for k in keys], "scenario", "session").agg(F.countDistinct("split").alias("splits")).groupBy(*[f"{k}_l" for k in keys]).agg(F.count_if(F.expr("splits > 1")).alias("leaked"))
    folded = records.groupBy(*keys).agg(
        episodes.alias("episodes"), n(F.col("relevance") == 1).alias("positives"), n(F.col("absent")).alias("absents"), *[n(F.col("challenger") == c).alias(f"c_{i}") for i, c in enumerate(challengers)], *[n(F.col("split") == s).alias(f"s_{i}") for i, s in enumerate(splits)]
    )
    met = folded.join(leaks, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_l")) for k in keys]))
    rules = [("few_episodes", F.col("episodes") < least), ("no_positive", F.col("positives") == 0), ("no_absent", F.col("absents") == 0)]
    rules += [(f"no_{c}", F.col(f"c_{i}") == 0) for i, c in enumerate(challengers)] + [("leak", F.col("leaked") > 0)] + [(f"no_{s}_group", F.col(f"s_{i}") == 0) for i, s in enumerate(splits)]
    return blockers(met, [*keys, "episodes"], rules)


def ship_gate(metrics: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """metrics: base_ and new_ of f1, calls, recall, rejection, macro, atom, complete; latency, fallback. Improvement and blockers."""
    gain = F.round(F.col("new_f1") - F.col("base_f1"), 9) >= 0.03
    fewer = (F.col("base_calls") > 0) & (F.round(1 - F.col("new_calls") / F.col("base_calls"), 9) >= 0.25) & (F.col("new_recall") >= F.col("base_recall"))
    worse = lambda c: F.col(f"new_{c}") < F.col(f"base_{c}")
    improvement = F.when(gain, "temporal_set_f1").when(fewer, "calls_at_same_recall")
    rules = [
        ("no_improvement", ~(gain | fewer)), ("rejection", F.col("new_rejection") < F.col("base_rejection") - tolerance), ("macro", worse("macro")), ("atom", worse("atom")), ("complete_set", worse("complete")),
        ("latency", F.col("latency") >= 1.0), ("fallback", ~F.col("fallback")),
    ]
    return blockers(metrics.withColumn("improvement", improvement), [*keys, "improvement"], rules)


def grounding_gate(measured: DataFrame, keys: list[str]) -> DataFrame:
    """measured: evaluated, correct, gross, latency, max_latency, unchanged; one that lacks any is not measured."""
    names = ["evaluated", "correct", "gross", "latency", "max_latency", "unchanged"]
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in names])
    rules = [("few_instances", F.col("evaluated") < 20), ("wrong_region", F.col("correct") != F.col("evaluated")), ("gross_box", F.col("gross") > 0), ("latency", F.col("latency") > F.col("max_latency")), ("verdict_changed", ~F.col("unchanged"))]
    return blockers(measured.withColumn("status", F.when(missing, "not_measured").otherwise("measured")), [*keys, "status"], rules)


def benchmark_summary(runs: DataFrame, median_limit: float) -> DataFrame:
    """runs: bench, phase, success, latency, cache_hits. A median needs 10 warm runs, a nearest-rank p95 20; no run may come from a cache."""
    warm = (F.col("phase") == "warm") & F.col("success") & F.col("latency").isNotNull()
    value = F.when(warm, F.col("latency"))
    folded = runs.groupBy("bench").agg(
        F.count(value).alias("warm_runs"), F.median(value).alias("m"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN phase = 'warm' AND success THEN latency END)").alias("p"),
        F.min(F.when((F.col("phase") == "cold") & F.col("success"), F.col("latency"))).alias("cold"), F.sum("cache_hits").alias("cache_hits"), F.count_if(~F.col("success")).alias("failures"),
    )
    out = folded.select("bench", "warm_runs", "cold", "cache_hits", "failures", F.when(F.col("warm_runs") >= 10, F.col("m")).alias("median"), F.when(F.col("warm_runs") >= 20, F.col("p")).alias("p95"))
    rules = [("cache_hits", F.col("cache_hits") > 0), ("few_warm_runs", F.col("warm_runs") < 10), ("p95_not_reportable", F.col("warm_runs") < 20), ("median_above_limit", F.col("median") > median_limit)]
    return blockers(out, ["bench", "warm_runs", "cold", "cache_hits", "failures", "median", "p95"], rules)


def fallback_mode(state: Column, other_verifier: Column) -> Column:
    """What a worker's state allows."""
    return F.when(state == "healthy", "full_gpu").when(state == "slow", "restricted_gpu").when(other_verifier, "mlx_verifier").otherwise("retrieval_only")


def resume(saved: DataFrame, key: str) -> DataFrame:
    """saved: key, old and new structs (run_id, parent, critical, config, device) and migration. Whether training may go on, and as what."""
    o, n = lambda f: F.col(f"old.{f}"), lambda f: F.col(f"new.{f}")
    broken = ~o("critical").eqNullSafe(n("critical"))
    changed = ~o("config").eqNullSafe(n("config")) | ~o("device").eqNullSafe(n("device")) | broken
    refused = F.when(broken & F.col("migration").isNull(), "critical_mismatch").when(changed & ~n("parent").eqNullSafe(o("run_id")), "needs_child_run").when(~changed & (n("run_id") != o("run_id")), "needs_same_run")
    return saved.select(key, refused.isNull().alias("allowed"), (refused.isNull() & ~changed).alias("exact"), refused.alias("refused"))


def propagation(decided: DataFrame) -> DataFrame:
    """decided: verified_match, enabled, gate_passed, seeds. Only an accepted candidate's boxes may be propagated; why others are not."""
    reason = F.when(~F.col("verified_match"), "not_accepted").when(~F.col("enabled"), "propagation_disabled").when(~F.col("gate_passed"), "grounding_gate_not_passed").when(F.col("seeds") == 0, "no_valid_seed_boxes")
    return decided.withColumn("reason", reason).withColumn("propagated", reason.isNull())


def probe(raw: Column) -> Column:
    """A media probe's JSON: duration of the first video stream, else of the format (finite and not negative), its time base, index and recording start.

    A time base that is no fraction, or has a zero denominator, is an error in `fault`.
    """
    streams = F.from_json(F.get_json_object(raw, "$.streams"), "array<struct<index:bigint,codec_type:string,duration:string,time_base:string,tags:map<string,string>>>")
    video = F.get(F.filter(streams, lambda s: s["codec_type"] == "video"), F.lit(0))
    seconds = lambda c: F.when((c.try_cast("double") >= 0) & (c.try_cast("double") < float("inf")), c.try_cast("double"))
    base = video["time_base"]
    parts = F.regexp_extract_all(base, F.lit(r"\A(\d+)/(\d+)\z|\A(\d+)\z"), F.lit(0))
    bad = base.isNotNull() & (F.length(base) > 0) & ((F.size(parts) == 0) | base.rlike(r"/0+\z"))
    tag = lambda k: F.coalesce(F.try_element_at(video["tags"], F.lit(k)), F.get_json_object(raw, f"$.format.tags.{k}"))
    return F.struct(
        F.coalesce(seconds(video["duration"]), seconds(F.get_json_object(raw, "$.format.duration"))).alias("duration"), base.alias("time_base"), video["index"].alias("stream"),
        F.coalesce(tag("creation_time"), tag("date")).alias("recording_start"), F.when(bad, "invalid_time_base").alias("fault"),
    )
