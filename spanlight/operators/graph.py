"""Evidence graph: edges, pattern joins, and decisions about absence and count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def co_occurs(detections: DataFrame) -> DataFrame:
    """(frame_id, ordinal, label): ordered pairs of one frame, emitted in both directions."""
    a = detections.select("frame_id", F.col("ordinal").alias("a"), F.col("label").alias("a_label"))
    b = detections.select("frame_id", F.col("ordinal").alias("b"), F.col("label").alias("b_label"))
    pairs = a.join(b, "frame_id").where("b > a")
    both = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))
    return pairs.select("frame_id", F.explode(both).alias("p")).select("frame_id", F.col("p.x").alias("subject"), F.col("p.y").alias("object"))


def pattern(nodes: DataFrame, edges: DataFrame, label_a: str, predicate: str, label_b: str, optional: str | None = None) -> DataFrame:
    """Bindings a -predicate-> b by labels; an optional edge from b adds c or null."""
    a = nodes.where(F.col("label") == label_a).select(F.col("node").alias("a"))
    b = nodes.where(F.col("label") == label_b).select(F.col("node").alias("b"))
    out = edges.where(F.col("predicate") == predicate).select(F.col("subject").alias("a"), F.col("object").alias("b")).join(a, "a").join(b, "b")
    if optional:
        out = out.join(edges.where(F.col("predicate") == optional).select(F.col("subject").alias("b"), F.col("object").alias("c")), "b", "left")
    return out


def safety(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """Observation safety of a scope: counts of ticks and whether all were observed."""
    return ticks.groupBy(*keys).agg(
        F.count("*").alias("expected"), F.count_if(F.col("status") != "skipped").alias("observed"), F.count_if(F.col("status") == "embedded").alias("assessable"), F.bool_and(F.col("status") == "embedded").alias("complete")
    )


#: What an observation node's payload may say, and what counts where it doesn't (fixed values).
PAYLOAD = "expected_ticks BIGINT, observed_ticks BIGINT, assessable_ticks BIGINT, occluded_ticks BIGINT, low_light_ticks BIGINT, assessable BOOLEAN, occluded BOOLEAN, low_light BOOLEAN, region_assessable BOOLEAN, occlusion_assessed BOOLEAN, coverage_complete BOOLEAN"


def fold_safety(observations: DataFrame, scopes: DataFrame, keys: list[str]) -> DataFrame:
    """observations: keys and a `payload` struct (PAYLOAD). One row for each of scopes; a scope that nothing observed is incomplete: (1, 0, 0)."""
    p = lambda name, default: F.coalesce(F.col(f"payload.{name}"), default)
    number, true = F.lit, F.lit(True)
    flag = lambda name: p(name, F.lit(False)).cast("long")
    total = lambda c, name: F.sum(c).alias(name)
    folded = observations.groupBy(*keys).agg(
        total(p("expected_ticks", number(1)), "expected"), total(p("observed_ticks", number(1)), "observed"),
        total(p("assessable_ticks", F.when(~p("assessable", true), 0).otherwise(1)), "assessable_n"), total(p("occluded_ticks", flag("occluded")), "occluded_n"), total(p("low_light_ticks", flag("low_light")), "low_light_n"),
        F.bool_and(p("region_assessable", p("assessable", true)) & p("occlusion_assessed", true)).alias("region"), F.bool_and(p("coverage_complete", true)).alias("whole"),
    )
    at = [F.col(k) for k in keys]
    every = scopes.select(*at).distinct().join(folded.select(*[F.col(k).alias(f"{k}_f") for k in keys], *[c for c in folded.columns if c not in keys]), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_f")) for k in keys]), "left")
    c = lambda name, default=0: F.coalesce(F.col(name), F.lit(default)).cast("long")
    observed = c("observed")
    return every.select(
        *at, c("expected", 1).alias("expected"), observed.alias("observed"), c("assessable_n").alias("assessable_ticks"), c("occluded_n").alias("occluded_ticks"), c("low_light_n").alias("low_light_ticks"),
        (F.coalesce("whole", F.lit(False)) & (observed >= c("expected", 1))).alias("complete"),
        (F.coalesce("region", F.lit(True)) & (c("assessable_n") > 0) & (c("occluded_n") < observed) & (c("low_light_n") < observed)).alias("assessable"),
    )


def visible_none(matches: Column, complete: Column, assessable: Column) -> Column:
    """Coverage comes first, then visibility; only in a complete and assessable scope does a match contradict and its absence support."""
    return F.when(~complete, "undetermined").when(~assessable, "unobservable").when(matches > 0, "contradicted").otherwise("supported")


def bounded_count(tracks: DataFrame, keys: list[str], at_least: int, at_most: int, tolerance: int = 0) -> DataFrame:
    """tracks: keys, video_id, camera_id, fragment_group, tracklet_id, continuity. Distinct groups within bounds.

    Tracks of several cameras can't be counted together; nor can tracks in more
    fragments (interrupted ones, and further ones of a fragment group) than tolerated.
    """
    group = F.coalesce(F.col("fragment_group"), F.col("tracklet_id"))
    camera = F.struct("video_id", "camera_id")
    per_group = tracks.groupBy(*keys, group.alias("g")).agg(
        F.count("*").alias("n"), F.count_if(F.col("fragment_group").isNotNull()).alias("grouped"), F.count_if(F.col("continuity") != "continuous").alias("broken"), F.min(camera).alias("c0"), F.max(camera).alias("c1")
    )
    out = per_group.groupBy(*keys).agg(
        F.count("*").alias("observed"), F.sum("broken").alias("broken"), F.sum(F.greatest(F.lit(0), F.col("grouped") - 1)).alias("fragments"), (~F.min("c0").eqNullSafe(F.max("c1"))).alias("several_cameras")
    )
    reason = (
        F.when(F.col("several_cameras"), "cross_camera_count").when(F.col("broken") + F.col("fragments") > tolerance, "excessive_track_fragmentation")
        .when(F.col("observed").between(at_least, at_most), "count_within_bounds").otherwise("count_out_of_bounds")
    )
    state = F.when(F.col("reason") == "count_within_bounds", "supported").when(F.col("reason") == "count_out_of_bounds", "contradicted").otherwise("undetermined")
    return out.withColumn("reason", reason).withColumn("state", state)


def track_edges(bridge: DataFrame, detections: DataFrame, tracklets: DataFrame) -> DataFrame:
    """bridge: (tracklet, detection). `belongs_to_track` edges whose two ends exist."""
    met = bridge.join(detections.select("detection", F.col("pts").alias("t0")), "detection").join(tracklets.select("tracklet"), "tracklet")
    return met.select(F.concat(F.lit("d"), "detection").alias("subject"), F.lit("belongs_to_track").alias("predicate"), F.concat(F.lit("t"), "tracklet").alias("object"), "t0")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node, and which."""
    known = nodes.select(F.col("node").alias("known_")).distinct()
    miss = lambda end: edges.join(known, F.col(end) == F.col("known_"), "left_anti").withColumn("missing", F.lit(end))
    return miss("subject").unionByName(miss("object"))


def match_any(nodes: DataFrame, alternatives: list[str]) -> DataFrame:
    """(node, label) bound to the first of the alternatives that its label is."""
    wanted = F.array(*[F.lit(a) for a in alternatives])
    return nodes.withColumn("alternative", F.array_position(wanted, F.col("label"))).where("alternative > 0").select("node", (F.col("alternative") - 1).cast("int").alias("alternative"))


def track_matches(tracks: DataFrame, links: DataFrame, detections: DataFrame) -> DataFrame:
    """Tracks linked to a matching detection, each once; links: (tracklet, detection)."""
    return tracks.join(links.join(detections.select("detection"), "detection", "left_semi"), "tracklet", "left_semi")


def put(incoming: DataFrame, existing: DataFrame, key: str, payload: str) -> DataFrame:
    """Idempotent insert as states: new rows, equal ones, and collisions of one key with another payload."""
    old = existing.select(F.col(key).alias("old_key"), F.col(payload).alias("old_payload"))
    state = F.when(F.col("old_key").isNull(), "new").when(F.col(payload).eqNullSafe(F.col("old_payload")), "same").otherwise("collision")
    return incoming.join(old, F.col(key) == F.col("old_key"), "left").withColumn("state", state).drop("old_key", "old_payload")
