"""What is measured on frames: motion scores, aligned feature rows, grounding boxes that are kept whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import valid_box
from .intervals import nearest_join

#: Kinds of constraints that a region of a frame can show.
GROUNDED = ("object", "attribute")


def motion_scores(frames: DataFrame, samples: DataFrame, keys: list[str], at: str, width: int = 3_600_000_000) -> DataFrame:
    """frames with motion_score, that of the sample of their keys nearest to `at`; samples: keys, sample_id, pts, score.

    The earlier sample wins a tie, of samples at one time the least sample_id. It is
    null for frames without a time (they were not decoded) and keys without samples.
    """
    one = samples.where("pts IS NOT NULL").groupBy(*keys, F.col("pts").alias(at)).agg(F.min_by(F.struct("score"), "sample_id").alias("sample_"))
    rows = frames.where(F.col(at).isNotNull()).select(*keys, at, F.struct(*frames.columns).alias("row_"))
    met = nearest_join(rows, one, keys, at, "sample_", width=width)
    scored = met.select("row_.*", F.col("frame_id.score").alias("motion_score"))
    return scored.unionByName(frames.where(F.col(at).isNull()).withColumn("motion_score", F.lit(None).cast(samples.schema["score"].dataType)))


def feature_rows(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """records: keys, frame_ids and pts (arrays), features (map of arrays). A row a tick: keys, tick, frame_id, pts, vector in the given order.

    A record that lacks a feature, or has one of another length than pts, is an
    error that names the features. Records without ticks have no rows.
    """
    wanted = F.array(*[F.lit(name) for name in order])
    wrong = F.filter(wanted, lambda name: ~F.coalesce(F.size(F.try_element_at("features", name)) == F.size("pts"), F.lit(False)))
    ids = F.when(F.size("frame_ids") == F.size("pts"), F.col("frame_ids")).otherwise(F.raise_error(F.lit("frame_ids and pts differ in length")).cast(records.schema["frame_ids"].dataType))
    said = F.concat(F.lit("features missing or of another length: "), F.array_join(wrong, ", "))
    at = F.when(F.size(wrong) == 0, F.arrays_zip(ids.alias("frame_id"), F.col("pts").alias("pts"))).otherwise(F.raise_error(said).cast("array<void>"))
    ticks = records.select(*keys, "features", F.posexplode(at).alias("tick", "at_"))
    vector = F.transform(wanted, lambda name: F.col("features")[name][F.col("tick")])
    return ticks.select(*keys, "tick", F.col("at_.frame_id").alias("frame_id"), F.col("at_.pts").alias("pts"), vector.alias("vector"))


def grounded_boxes(candidates: DataFrame, constraints: DataFrame, frames: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Whether a candidate's boxes may be shown: key, overlay, n_boxes, reason, gate_status, cited (sorted frame ids).

    candidates: key (unique), verified, enabled, gate_status, gate_passed.
    constraints: key, constraint_id, kind, state, phrase, frame_ids (cited ones).
    frames: key, frame_id; those that were supplied. boxes: key, constraint_id,
    asked (the frame asked about), and the answer: frame_id, phrase, box, score, revision.

    Supported objects and attributes are grounded. A fault of any of them drops all
    boxes of its candidate; the reason is the first fault by constraint, cited frame
    and rule. Nulls in what a rule looks at break it.
    """
    cited = constraints.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("frame_ids")))).alias("cited"))
    wanted = constraints.where(F.col("kind").isin(*GROUNDED) & (F.col("state") == "supported"))
    asked = wanted.select(key, "constraint_id", "phrase", F.posexplode_outer("frame_ids").alias("at", "asked"))
    supplied = lambda name: frames.select(key, F.col("frame_id").alias(name), F.lit(True).alias(f"has_{name}")).distinct()
    answers = boxes.select(key, "constraint_id", "asked", F.col("frame_id").alias("shown"), F.col("phrase").alias("said"), "box", "score", "revision", F.lit(True).alias("answered"))
    met = asked.join(supplied("asked"), [key, "asked"], "left").join(answers, [key, "constraint_id", "asked"], "left").join(supplied("shown"), [key, "shown"], "left")
    fails = lambda c: ~F.coalesce(c, F.lit(False))
    fault = (
        F.when(F.col("asked").isNull(), "no_cited_evidence")
        .when(F.col("has_asked").isNull(), "frame_not_supplied")
        .when(F.col("answered").isNull(), None)
        .when(F.col("has_shown").isNull(), "box_outside_evidence")
        .when(fails(valid_box(F.col("box"))), "box_not_normalised")
        .when(fails(F.col("score").between(0, 1)), "score_out_of_range")
        .when(fails((F.col("said") != "") & (F.col("revision") != "")), "phrase_or_revision_missing")
        .when(fails(F.col("said") == F.col("phrase")), "reference_changed")
    )
    first = F.when(fault.isNotNull(), F.struct(F.coalesce("at", F.lit(-1)).alias("at"), fault.alias("reason")))
    each = met.groupBy(key, "constraint_id").agg(F.min(first).alias("first"), F.count("answered").alias("n"))
    none = F.when(F.col("n") == 0, F.lit("no_stable_region"))
    reason = F.coalesce(F.col("first.reason"), none)
    whole = each.groupBy(key).agg(F.min(F.when(reason.isNotNull(), F.struct("constraint_id", reason.alias("reason")))).alias("fault"), F.sum("n").alias("n"))
    all_ = candidates.join(whole, key, "left").join(cited, key, "left")
    open_ = fails(F.col("verified")), fails(F.col("enabled")), fails(F.col("gate_passed"))
    why = F.when(open_[0], "not_accepted").when(open_[1], "grounding_disabled").when(open_[2], "grounding_gate_not_passed").when(F.col("n").isNull(), "no_supported_phrase").otherwise(F.col("fault.reason"))
    status = F.when(open_[1], "disabled").when(open_[2], F.coalesce("gate_status", F.lit("not_measured"))).otherwise(F.col("gate_status"))
    named = all_.withColumn("reason", why)
    overlay = F.col("reason").isNull()
    return named.select(key, overlay.alias("overlay"), F.when(overlay, F.col("n")).otherwise(0).cast("long").alias("n_boxes"), "reason", status.alias("gate_status"), F.coalesce("cited", F.array().cast(constraints.schema["frame_ids"].dataType)).alias("cited"))
