"""Evaluation metrics as aggregations."""

from __future__ import annotations

from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio, t_iou
from ..sources.shared import discard, materialize
from .intervals import overlap_join
from .selection import percentiles


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1")]


def class_scores(pairs: DataFrame) -> DataFrame:
    """(truth, predicted) -> scores per class that the truth has; `undetermined` predictions are misses of the true class only."""
    confusion = pairs.groupBy("truth", "predicted").count()
    true = confusion.groupBy(F.col("truth").alias("class")).agg(F.sum("count").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("count")).otherwise(0)).alias("tp"))
    said = confusion.groupBy(F.col("predicted").alias("class")).agg(F.sum("count").alias("said"))
    joined = true.join(said, "class", "left").withColumn("fp", F.coalesce("said", F.lit(0)) - F.col("tp"))
    return joined.select("class", "support", *prf(F.col("tp"), F.col("fp"), F.col("support") - F.col("tp")))


def latency(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Interpolated and nearest-rank percentiles are different measures; both are exact, and no group is held in one task."""
    ranks = percentiles(df, keys, value, {"p50": 0.5, "p95": 0.95}, {"p95_rank": 0.95})
    rest = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count("*").alias("runs"))
    other = ranks.select(*[F.col(k).alias(f"{k}_r") for k in keys], "p50", "p95", "p95_rank")
    met = rest.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in keys], F.lit(True)), "left")
    return met.select(*keys, "p50", "p95", "p95_rank", "mean", "runs")


def leaks(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that stand in more than one split."""
    return rows.groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def rejection(families: DataFrame) -> DataFrame:
    """(is_empty, returned_empty): scores of the event that an absent family is answered with the empty set."""
    n = lambda c: F.count_if(c)
    e, r = F.col("is_empty"), F.col("returned_empty")
    counted = families.agg(n(e & r).alias("tp"), n(~e & r).alias("fp"), n(e & ~r).alias("fn"), n(e).alias("n_empty"), n(~e).alias("n_nonempty"))
    return counted.select(*prf(F.col("tp"), F.col("fp"), F.col("fn")), "n_empty", "n_nonempty")


def count_error(pairs: DataFrame) -> DataFrame:
    """(pred, gt) as strings: mean absolute error of pairs resolved on both sides, null where there is none."""
    p, g = F.expr("try_cast(pred AS BIGINT)"), F.expr("try_cast(gt AS BIGINT)")
    return pairs.agg(F.avg(F.abs(p - g)).alias("mae"), F.count_if(p.isNull() | g.isNull()).alias("unresolved"))


#: Outcomes that abstain, and those that assert (fixed values); an asserted count is a whole number.
ABSTENTIONS = ["unobservable", "unresolved"]
ASSERTIONS = ["satisfied", "not_satisfied", "visible_absence_supported", "present_contradicted"]


def bounded_logic(items: DataFrame) -> DataFrame:
    """(operator, gt, pred, under_stress): accuracy, abstention under stress, and assertions where the truth abstains."""
    asserted = F.col("pred").isin(ASSERTIONS) | F.expr("try_cast(pred AS BIGINT)").isNotNull()
    s = items.groupBy("operator").agg(
        F.count("*").alias("n"), F.count_if(F.col("pred").eqNullSafe(F.col("gt"))).alias("right"), F.count_if("under_stress").alias("stressed"),
        F.count_if(F.col("under_stress") & F.col("pred").isin(ABSTENTIONS)).alias("abstained"), F.count_if(F.col("gt").isin(ABSTENTIONS) & asserted).alias("false_clean"),
    )
    return s.select("operator", "n", ratio(F.col("right"), F.col("n")).alias("accuracy"), F.when(F.col("stressed") > 0, F.col("abstained") / F.col("stressed")).alias("abstention"), "false_clean")


def best_overlap(truth: DataFrame, found: DataFrame, keys: list[str], width: int) -> DataFrame:
    """truth and found: keys, id, t0, t1. Each true interval with the greatest overlap ratio found for it (0 for none).

    Only distinct spans are paired, as a ratio depends on nothing else; so pairs grow
    with the spans that differ, not with the rows. Rows of one id share their best; a null id has none.
    """
    span = [*keys, "t0", "t1"]
    pairs = overlap_join(truth.select(*span).distinct(), found.select(*span).distinct(), keys, width)
    best = pairs.groupBy(*_span_of(span)).agg(F.max(_iou()).alias("best"))
    one = F.when(F.col("id").isNotNull(), F.max("best").over(Window.partitionBy("id")))
    return _at_spans(truth, best, span).select("id", *[c for c in truth.columns if c != "id"], F.coalesce(one, F.lit(0.0)).alias("best"))


def _iou() -> Column:
    return t_iou(F.col("l.t0"), F.col("l.t1"), F.col("r.t0"), F.col("r.t1"))


def _span_of(span: list[str]) -> list[Column]:
    return [F.col(f"l.{c}").alias(f"{c}_s") for c in span]


def _at_spans(rows: DataFrame, values: DataFrame, span: list[str]) -> DataFrame:
    """rows with the values of their spans, null where there are none."""
    return rows.join(values, reduce(lambda a, b: a & b, [rows[c].eqNullSafe(values[f"{c}_s"]) for c in span]), "left").drop(*[f"{c}_s" for c in span])


def greedy_match(truth: DataFrame, found: DataFrame, key: str, width: int, threshold: float = 0.5) -> DataFrame:
    """One-to-one matches by falling overlap ratio, ties to the lower true id, then the lower found id: (key, gt, pred, iou).

    Time is cut into blocks. A row that lies within a block meets all its partners
    there; of one that reaches over an edge some may be elsewhere, so its pairs are
    open, and so is what depends on them. A block decides all that doesn't (`_decide`). What is
    open goes to the next round, whose blocks are twice as long and have the old edges
    well inside, until nothing is. Rows of null ids take no part.
    """
    truth, found = (df.where(F.col("id").isNotNull()) for df in (truth, found))
    if any(df.groupBy(key, "id").count().where("count > 1").take(1) for df in (truth, found)):
        return _match_pairs(truth, found, key, width, threshold)
    kinds = [df.schema["id"].dataType.simpleString() for df in (truth, found)]
    side = lambda df, n: df.where("t1 > t0").select(F.lit(n).alias("kind"), F.col(key).alias("key"), *[(F.col("id") if i == n else F.lit(None).cast(kinds[i])).alias(f"id{i}") for i in (0, 1)], "t0", "t1")
    rest = side(truth, 0).unionByName(side(found, 1))
    span = [rest.schema[c].dataType.simpleString() for c in ("key", "t0", "t1")]
    schema = f"kind int, key {span[0]}, id0 {kinds[0]}, id1 {kinds[1]}, t0 {span[1]}, t1 {span[2]}, iou double"
    parts = int(truth.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    length, edge, matched, held = 2 * width, 0, None, None
    while True:
        block = lambda c: F.floor((c - edge) / length)  # noqa: B023, E731
        cut = rest.withColumn("first", block(F.col("t0"))).withColumn("last", F.greatest("first", F.ceil((F.col("t1") - edge) / length) - 1))
        dealt = cut.select(*rest.columns, (F.col("first") == F.col("last")).alias("whole"), F.explode(F.sequence("first", "last")).alias("block"))
        said = materialize(dealt.repartition(parts, "key", "block").groupBy("key", "block").applyInArrow(_decide(threshold), schema), "greedy-said")
        won = said.where("kind = 2").select(F.col("key").alias(key), F.col("id0").alias("gt"), F.col("id1").alias("pred"), "iou")
        matched = won if matched is None else matched.unionByName(won)
        nxt = materialize(said.where("kind < 2").drop("iou").unionByName(cut.where("first < last").select(*rest.columns)), "greedy-rest")
        if held is not None:
            discard(held)
        rest = held = nxt
        if not rest.take(1):
            return matched
        edge, length = edge + length // 2, 2 * length


def _decide(threshold: float):
    """Rows (kind, key, id0, id1, t0, t1, whole, block) of one key and block -> matches (kind 2), and whole rows that are open (kinds 0 and 1).

    Pairs come in their order. Of two free ends whose earlier pairs are all decided the
    pair is a match. A pair with an open end leaves both open. Rows of equal spans have the same
    ratios, so they are a class: within it ids alone decide, and it is open as a whole.
    """

    def run(t: pa.Table) -> pa.Table:
        kind, t0, t1, whole = (t[c].to_numpy() for c in ("kind", "t0", "t1", "whole"))
        sides = []
        for n in (0, 1):
            own = np.flatnonzero(kind == n)
            ids = t[f"id{n}"].take(pa.array(own)).to_pylist()
            classes: dict[tuple, list[int]] = {}
            for i in sorted(range(len(own)), key=ids.__getitem__):
                classes.setdefault((t0[own[i]], t1[own[i]]), []).append(i)
            spans = sorted(classes)
            rows = [classes[s] for s in spans]
            sides.append((own, ids, spans, rows, [0] * len(rows), [not whole[own[r[0]]] for r in rows]))
        (g_own, g_ids, g_spans, g_rows, g_head, g_open), (p_own, p_ids, p_spans, p_rows, p_head, p_open) = sides
        links = _links(g_spans, p_spans, threshold)
        matches: list[tuple[int, int, float]] = []
        for iou, pairs in links:
            of: dict[int, list[int]] = {}
            for g, p in pairs:
                of.setdefault(g, []).append(p)
            heap = [(g_ids[g_rows[g][g_head[g]]], g) for g in of if g_head[g] < len(g_rows[g])]
            heapify(heap)
            while heap:
                _, g = heappop(heap)
                free = [(p_ids[p_rows[p][p_head[p]]], p) for p in of[g] if p_head[p] < len(p_rows[p])]
                if not free:
                    continue
                p = min(free)[1]
                if g_open[g] or p_open[p]:
                    g_open[g] = True
                    for _, q in free:
                        p_open[q] = True
                    continue
                matches.append((g_rows[g][g_head[g]], p_rows[p][p_head[p]], iou))
                g_head[g] += 1
                p_head[p] += 1
                if g_head[g] < len(g_rows[g]):
                    heappush(heap, (g_ids[g_rows[g][g_head[g]]], g))
        left = []
        for own, _, _, rows, head, is_open in sides:
            left += [own[i] for r, h, o in zip(rows, head, is_open, strict=True) if o for i in r[h:] if whole[own[i]]]
        rest = t.select(["kind", "key", "id0", "id1", "t0", "t1"]).take(pa.array(np.array(left, np.int64))).append_column("iou", pa.nulls(len(left), pa.float64()))
        g = t.take(pa.array(np.array([g_own[m[0]] for m in matches], np.int64)))
        p = t.take(pa.array(np.array([p_own[m[1]] for m in matches], np.int64)))
        won = pa.table([pa.array(np.full(len(matches), 2), rest.schema.field("kind").type), g["key"], g["id0"], p["id1"], g["t0"], g["t1"], pa.array([m[2] for m in matches], pa.float64())], rest.column_names)
        return pa.concat_tables([rest, won])

    return run


def _links(left: list[tuple], right: list[tuple], threshold: float) -> list[tuple[float, list[tuple[int, int]]]]:
    """Pairs of sorted spans whose ratio is positive and at least threshold, by falling ratio; equal ratios together."""
    if not left or not right:
        return []
    a, b = np.array(left), np.array(right)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 20) // len(b))
    for at in range(0, len(a), step):
        x = a[at : at + step]
        inter = np.minimum(x[:, None, 1], b[None, :, 1]) - np.maximum(x[:, None, 0], b[None, :, 0])
        i, j = np.nonzero(inter > 0)
        both = inter[i, j].astype(np.float64)
        ratio = both / ((x[i, 1] - x[i, 0]) + (b[j, 1] - b[j, 0]) - both)
        keep = ratio >= threshold
        found.append((ratio[keep], at + i[keep], j[keep]))
    ratio, i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(-ratio, kind="stable")
    ratio, pairs = ratio[order], list(zip(i[order].tolist(), j[order].tolist(), strict=True))
    cuts = [0, *(np.flatnonzero(ratio[1:] != ratio[:-1]) + 1).tolist(), len(ratio)]
    return [(float(ratio[x]), pairs[x:y]) for x, y in zip(cuts, cuts[1:], strict=False) if y > x]


def _match_pairs(truth: DataFrame, found: DataFrame, key: str, width: int, threshold: float) -> DataFrame:
    """The same for ids that repeat: an id is one end, whatever rows it has.

    The order is total, so a pair that comes first for both of its ends is in the
    greedy choice whatever else is. Each round takes those pairs, drops all pairs of
    their ends and writes the rest to the shared folder, until none is left.
    """
    iou = t_iou(F.col("l.t0"), F.col("l.t1"), F.col("r.t0"), F.col("r.t1"))
    pairs = overlap_join(truth, found, [key], width).select(F.col(f"l.{key}").alias(key), F.col("l.id").alias("gt"), F.col("r.id").alias("pred"), iou.alias("iou"))
    rest = materialize(pairs.where((F.col("iou") >= threshold) & (F.col("iou") > 0)), "greedy-pairs")
    order = F.struct((-F.col("iou")).alias("by"), "gt", "pred")
    taken = rest.limit(0)
    while rest.take(1):
        of_gt = rest.groupBy(F.col(key).alias("k"), F.col("gt").alias("g")).agg(F.min(order).alias("best"))
        of_pred = rest.groupBy(F.col(key).alias("k2"), F.col("pred").alias("p")).agg(F.min(order).alias("best2"))
        both = of_gt.join(of_pred, F.col("k").eqNullSafe(F.col("k2")) & (F.col("best.pred") == F.col("p"))).where("best = best2")
        won = materialize(both.select(F.col("k").alias(key), F.col("g").alias("gt"), F.col("p").alias("pred"), (-F.col("best.by")).alias("iou")), "greedy-won")
        taken = taken.unionByName(won)
        gone = lambda c: rest[key].eqNullSafe(F.col("wk")) & (rest[c] == F.col("w"))
        ends = lambda c: won.select(F.col(key).alias("wk"), F.col(c).alias("w"))
        left = materialize(rest.join(ends("gt"), gone("gt"), "left_anti").join(ends("pred"), gone("pred"), "left_anti"), "greedy-pairs")
        discard(rest)
        rest = left
    return taken


def annotation_faults(notes: DataFrame) -> DataFrame:
    """notes: annotation_id (unique), target, pass_type, adjudicates (array), recorded_at, blind. (annotation_id, fault).

    An adjudication names two independent passes recorded strictly before it;
    independent passes of a target that has several are blind.
    """
    adj = notes.where("pass_type = 'adjudication'").select("annotation_id", "recorded_at", "adjudicates")
    two = F.coalesce(F.size("adjudicates") == 2, F.lit(False))
    refs = adj.where(two).select("annotation_id", "recorded_at", F.explode("adjudicates").alias("ref"))
    named = notes.select(F.col("annotation_id").alias("ref"), F.col("pass_type").alias("kind"), F.col("recorded_at").alias("ref_at"))
    met = refs.join(named, "ref", "left")
    fault = lambda df, name: df.select("annotation_id", F.lit(name).alias("fault"))
    independent = notes.where("pass_type = 'independent'")
    several = independent.groupBy("target").count().where("count >= 2")
    return (
        fault(adj.where(~two), "not_two_passes")
        .unionByName(fault(met.where("kind IS NULL"), "unknown_pass"))
        .unionByName(fault(met.where("kind <> 'independent'"), "not_independent"))
        .unionByName(fault(met.where("recorded_at <= ref_at"), "recorded_too_early"))
        .unionByName(fault(independent.join(several, "target", "left_semi").where("NOT coalesce(blind, false)"), "not_blind"))
        .distinct()
    )


def double_annotated(families: DataFrame, notes: DataFrame) -> DataFrame:
    """Share of families (one column, family) with two or more independent passes; 0 for no family."""
    passes = notes.where("pass_type = 'independent'").groupBy(F.col("target").alias("family")).agg(F.count("*").alias("passes"))
    return families.join(passes, "family", "left").agg(F.coalesce(F.avg((F.coalesce("passes", F.lit(0)) >= 2).cast("double")), F.lit(0.0)).alias("fraction"))


def rate(part: Column, whole: Column) -> Column:
    """part of whole; null where there is nothing to measure."""
    return F.when(whole > 0, part / whole)


def reasons(items: DataFrame) -> DataFrame:
    """(predicted, reason): how many predictions are undetermined for each reason, and their share of all items."""
    n = items.agg(F.count("*").alias("all_"))
    open_ = items.where("predicted = 'undetermined'").groupBy("reason").agg(F.count("*").alias("n"))
    return open_.join(F.broadcast(n), F.lit(True)).select("reason", "n", (F.col("n") / F.col("all_")).alias("rate"))


def score_configs(truth: DataFrame, bundles: DataFrame, configs: list, query: str, width: int, threshold: float = 0.0) -> DataFrame:
    """truth: query, id, t0, t1; bundles: config, query, id, t0, t1. Recall of each configuration over all queries with a truth.

    Interval recall weighs a query by its intervals; complete_set is the share of
    queries of which every interval is found. A configuration that found nothing
    has zeros. Distinct spans alone are paired, as in best_overlap.
    """
    span = [query, "t0", "t1"]
    pairs = overlap_join(truth.select(*span).distinct(), bundles.select("config", *span).distinct(), [query], width)
    hits = pairs.groupBy(*_span_of(span), F.col("r.config").alias("config")).agg(F.max(_iou()).alias("best")).where(F.col("best") > threshold)
    met = _at_spans(truth, hits.groupBy(*[f"{c}_s" for c in span]).agg(F.collect_set("config").alias("hit_")), span)
    # A column a configuration: rows of one id are hit together, and a null id never is.
    hit = lambda c: F.coalesce(F.array_contains("hit_", F.lit(c)) & F.col("id").isNotNull(), F.lit(False))
    rows = met.select(query, *[F.max(hit(c)).over(Window.partitionBy("id")).alias(f"hit_{i}") for i, c in enumerate(configs)])
    per = rows.groupBy(query).agg(F.count("*").alias("total"), *[f(f"hit_{i}").alias(f"{name}_{i}") for i in range(len(configs)) for name, f in (("found", F.count_if), ("whole", F.bool_and))])
    each = [F.struct(F.lit(c).alias("config"), F.col(f"found_{i}").alias("found"), F.col(f"whole_{i}").alias("whole")) for i, c in enumerate(configs)]
    per = per.select("total", F.inline(F.array(*each)))
    return per.groupBy("config").agg(F.sum("found").alias("hits"), F.sum("total").alias("truths"), ratio(F.sum("found"), F.sum("total")).alias("interval_recall"), F.avg(F.col("whole").cast("double")).alias("complete_set"))
