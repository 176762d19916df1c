"""Four-state decisions and conclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import ranked

#: Reasons that each state may give (fixed values).
REASONS = {
    "supported": ["visible_match"],
    "contradicted": ["visible_mismatch"],
    "unobservable": ["occlusion", "low_light", "out_of_frame"],
    "undetermined": ["insufficient_context", "inconsistent_output", "timeout", "model_error"],
}


def candidates(evidence: DataFrame, required: list) -> DataFrame:
    """(candidate, constraint, state) -> one row a candidate. Only required constraints decide; a candidate without one of them is an error.

    All required ones supported: a verified match. Any contradicted: a rejected near
    match. Else what could not be seen (unobservable) and what the system left open
    (undetermined) are two flags of their own: a candidate may have both.
    """
    if not required:
        raise ValueError("a verdict needs a required constraint")
    wanted = evidence.where(F.col("constraint").isin(list(required)))
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    folded = wanted.groupBy("candidate").agg(n("supported"), n("contradicted"), n("unobservable"), n("undetermined"), F.countDistinct("constraint").alias("n"))
    every = evidence.select("candidate").distinct().join(folded, "candidate", "left")
    whole = F.when(F.coalesce("n", F.lit(0)) < len(set(required)), F.raise_error(F.concat(F.lit("required constraints are missing: candidate "), F.col("candidate").cast("string")))).otherwise(F.lit(True))
    clear = F.col("contradicted") == 0
    return every.where(whole).select(
        "candidate", (F.col("supported") == len(set(required))).alias("verified_match"), (~clear).alias("rejected_near_match"),
        (clear & (F.col("unobservable") > 0)).alias("unresolved_visual"), (clear & (F.col("undetermined") > 0)).alias("unresolved_system"),
        "supported", "contradicted", "unobservable", "undetermined",
    )


def near_misses(decided: DataFrame) -> DataFrame:
    """Rejected near matches by most supported, fewest contradicted, highest priority (0 where there is none), id."""
    rows = decided.where("rejected_near_match")
    priority = F.coalesce(F.col("priority"), F.lit(0.0)) if "priority" in decided.columns else F.lit(0.0)
    return ranked(rows, [], [-F.col("supported"), F.col("contradicted"), -F.floor(priority * 4096)], [F.desc(priority), F.col("candidate")])


def conclusion(decided: DataFrame, keys: list[str], complete: Column, mixed: str | None = None) -> DataFrame:
    """Each archive's conclusion; complete: a column of decided, equal within keys: assembly, verification and join budgets all ran to their end.

    A match is a match. Then a search that was cut short is `search_incomplete`,
    whatever its candidates say. What could not be seen comes next; only system
    causes give `not_applicable`. Archives with both kinds are an error, or `mixed`
    where the caller names what to report.
    """
    some = lambda c: F.bool_or(c)
    folded = decided.groupBy(*keys).agg(
        some("verified_match").alias("match"), F.bool_and(complete).alias("whole"), some("unresolved_visual").alias("visual"), some("unresolved_system").alias("system"),
        F.count_if("verified_match").alias("matches"), F.count_if("rejected_near_match").alias("near_misses"),
    )
    both = F.lit(mixed) if mixed else F.raise_error(F.lit("visual and system causes are mixed: name the conclusion to report"))
    said = (
        F.when(F.col("match"), "verified_matches_found").when(~F.col("whole"), "search_incomplete").when(F.col("visual") & F.col("system"), both)
        .when(F.col("visual"), "insufficient_visual_evidence").when(F.col("system"), "not_applicable").otherwise("no_verified_match")
    )
    return folded.select(*keys, said.alias("conclusion"), "matches", "near_misses")


def within_budget(clusters: DataFrame, budget: int) -> DataFrame:
    """The first clusters by priority are verified, the rest time out; none is dropped."""
    rows = ranked(clusters, [], [-F.floor(F.col("priority") * 65536)], [F.desc("priority"), F.col("video_id"), F.col("t0"), F.col("t1")])
    return rows.withColumn("state", F.when(F.col("rank") <= budget, "verify").otherwise("timeout"))


def unverified(clusters: DataFrame, required: list[str], reason: str = "model_error") -> DataFrame:
    """Every required constraint of a plan, for every cluster, as undetermined."""
    return clusters.select("*", F.explode(F.array(*[F.lit(c) for c in required])).alias("constraint_id")).withColumns({"state": F.lit("undetermined"), "reason": F.lit(reason)})


def reason_fits(state: Column, reason: Column) -> Column:
    """Whether a state may give this reason; unknown states have none."""
    fits = F.lit(False)
    for name, reasons in REASONS.items():
        fits = F.when(state == name, reason.isin(reasons)).otherwise(fits)
    return F.coalesce(fits, F.lit(False))


def repair_citations(items: DataFrame) -> DataFrame:
    """items: cited, supplied (arrays of frame ids), state, reason. A citation outside the supplied frames makes the item undetermined without citations."""
    strange = F.size(F.array_except("cited", "supplied")) > 0
    return items.withColumns({
        "state": F.when(strange, "undetermined").otherwise(F.col("state")), "reason": F.when(strange, "inconsistent_output").otherwise(F.col("reason")),
        "cited": F.when(strange, F.array().cast("array<bigint>")).otherwise(F.col("cited")),
    })


def rerank(clusters: DataFrame, mode: Column) -> DataFrame:
    """clusters: query, cluster_id, priority, relevance (null where the model failed). Orders by mode, one a query.

    active follows relevance, ties and everything else the baseline (priority, then
    id). A query with a missing relevance falls back, whatever its mode.
    """
    whole = clusters.groupBy(F.col("query").alias("q_")).agg(F.bool_and(F.col("relevance").isNotNull()).alias("scored"))
    rows = clusters.withColumn("mode", mode).join(whole, F.col("query") == F.col("q_")).drop("q_")
    used = F.when(F.col("mode") == "disabled", "disabled").when(~F.col("scored"), "fallback").otherwise(F.col("mode"))
    rows = rows.withColumn("mode", used)
    by = F.when(F.col("mode") == "active", -F.col("relevance")).otherwise(F.lit(0.0))
    return ranked(rows, ["query"], [F.floor(by * 4096), -F.floor(F.col("priority") * 64)], [by, F.desc("priority"), F.col("cluster_id")]).drop("scored")


def evidence_digest(*columns: Column) -> Column:
    """A cache key over everything an answer depends on."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
