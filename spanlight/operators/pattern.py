"""Graph patterns as joins: variables, edges, order, actors, alternatives, and what an archive can say of absence and count.

The result is complete: budgets raise a flag and never cut it, so a flagged result
can only hold more than an imperative search that stops.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import label_match
from ..sources.shared import materialize
from .graph import bounded_count, fold_safety, visible_none
from .reducer import join_all

#: Predicates that stored edges may have, and what a query's predicate is stored as; None is for the verifier alone (fixed values).
EDGE_PREDICATES = {"overlaps", "precedes", "follows", "near", "contains", "belongs_to_track", "carries", "enters", "exits", "co_occurs"}
QUERY_PREDICATES = {"carries": "carries", "near": "near", "follows": "follows", "wears": None, "places": None, "picks_up": None}
LONGEST_SAME_ACTOR = 30_000_000
SCOPE = ["video_id", "camera_id"]


@dataclass(frozen=True)
class Variable:
    name: str
    text: str
    types: tuple[str, ...]
    videos: tuple[str, ...] = ()
    cameras: tuple[str, ...] = ()
    start: int | None = None
    end: int | None = None


@dataclass(frozen=True)
class Edge:
    subject: str
    predicate: str
    object: str
    required: bool = True


@dataclass(frozen=True)
class Order:
    first: str
    second: str
    max_gap: int
    relation: str = "before"
    same_actor: bool = False


@dataclass(frozen=True)
class Logic:
    group: str
    operator: str  # all, any, visible_none or count
    variables: tuple[str, ...]
    at_least: int = 0
    at_most: int = 8


@dataclass(frozen=True)
class Pattern:
    variables: tuple[Variable, ...]
    edges: tuple[Edge, ...] = ()
    orders: tuple[Order, ...] = ()
    logic: tuple[Logic, ...] = ()
    join_budget: int = 1_000_000
    named: dict[str, Variable] = field(init=False, default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        if self.join_budget <= 0:
            raise ValueError("a join budget is positive")
        if strange := [e.predicate for e in self.edges if e.predicate not in EDGE_PREDICATES]:
            raise ValueError(f"predicates outside the registry: {strange}")
        if any(o.same_actor and o.max_gap > LONGEST_SAME_ACTOR for o in self.orders):
            raise ValueError("one actor can't be followed over so long a gap")
        self.named.update({v.name: v for v in self.variables})

    def grouped(self, *operators: str) -> list[Logic]:
        return [g for g in self.logic if g.operator in operators]

    def joined(self) -> list[str]:
        """Variables that a binding has: those of no absence, count or choice."""
        apart = {v for g in self.grouped("visible_none", "count", "any") for v in g.variables}
        return [v.name for v in self.variables if v.name not in apart]


def stored_predicate(name: str) -> str | None:
    if name not in QUERY_PREDICATES:
        raise ValueError(f"a predicate outside the registry: {name!r}")
    return QUERY_PREDICATES[name]


def in_scope(v: Variable) -> Column:
    """Type, video, camera and closed time overlap."""
    said = F.col("node_type").isin(list(v.types))
    if v.videos:
        said &= F.col("video_id").isin(list(v.videos))
    if v.cameras:
        said &= F.col("camera_id").isin(list(v.cameras))
    if v.start is not None:
        said &= F.col("t1") >= v.start
    if v.end is not None:
        said &= F.col("t0") <= v.end
    return F.coalesce(said, F.lit(False))


def matches(nodes: DataFrame, edges: DataFrame, v: Variable) -> DataFrame:
    """Nodes in scope that say the text, and tracklets of which a linked detection says it (whatever camera it has)."""
    scoped = nodes.where(in_scope(v))
    says = label_match(F.coalesce(F.col("labels"), F.lit("")), v.text)
    saying = nodes.where(says).select(F.col("node").alias("subject"))
    linked = edges.where("predicate = 'belongs_to_track'").join(saying, "subject", "left_semi").select(F.col("object").alias("linked_")).distinct()
    met = scoped.join(linked, F.col("node") == F.col("linked_"), "left")
    return met.where(says | ((F.col("node_type") == "tracklet") & F.col("linked_").isNotNull())).drop("linked_")


def choices(nodes: DataFrame, edges: DataFrame, pattern: Pattern, group: Logic) -> DataFrame:
    """The nodes that match an alternative of the group, each bound to the first one that it matches."""
    each = [matches(nodes, edges, pattern.named[v]).withColumn("turn_", F.lit(i)) for i, v in enumerate(group.variables)]
    every = reduce(lambda a, b: a.unionByName(b), each)
    first = every.groupBy("node").agg(F.min("turn_").alias("turn_"))
    names = F.array(*[F.lit(v) for v in group.variables])
    return nodes.join(first, "node").withColumn("bound", names[F.col("turn_")]).drop("turn_")


def _bound(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{c}_{name}") for c in SCOPE], F.struct("node", "node_type", "t0", "t1", "tracklet_id", *([F.col("bound")] if "bound" in rows.columns else [F.lit(name).alias("bound")])).alias(name))


def bindings(nodes: DataFrame, edges: DataFrame, pattern: Pattern) -> DataFrame:
    """video_id, camera_id and a struct for each variable (or group of alternatives, by its name): all complete bindings.

    Each pair of variables that required edges tie is a relation of the nodes at
    both ends, each other variable one of its own nodes. They are joined without
    dead rows (`reducer`); an order filters once both of its variables are bound.
    Optional edges come last, as left joins that add `edge_<n>`.
    """
    nodes, edges = materialize(nodes, "pattern-nodes"), materialize(edges, "pattern-edges")
    sets = {v: matches(nodes, edges, pattern.named[v]) for v in pattern.joined()} | {g.group: choices(nodes, edges, pattern, g) for g in pattern.grouped("any")}
    if not sets:
        raise ValueError("a pattern without a variable to bind")
    sets = {n: materialize(_bound(s, n), "pattern-set") for n, s in sets.items()}
    by = edges.select(F.col("subject").alias("s_"), F.col("predicate").alias("p_"), F.col("object").alias("o_")).distinct()
    relations, frames = _relations(sets, by, pattern)
    left = list(pattern.orders)

    def ordered(rows: DataFrame, have: set[str]) -> DataFrame:
        for o in [o for o in left if {o.first, o.second} <= have]:
            left.remove(o)
            times = [sets[n].select(F.col(f"{n}.node").alias(f"{n}_at"), F.col(n).alias(f"{n}_s")) for n in (o.first, o.second)]
            for n, t in zip((o.first, o.second), times, strict=True):
                rows = rows.join(t, F.col(n) == F.col(f"{n}_at")).drop(f"{n}_at")
            rows = rows.where(reduce(lambda a, b: a & b, _ordered(o, "_s"))).drop(*[f"{n}_s" for n in (o.first, o.second)])
        return rows

    ids = join_all(frames, relations, SCOPE, ordered)
    out = ids.select(*SCOPE, *[F.col(n).alias(f"{n}_id") for n in sets])
    for n, s in sets.items():
        out = out.join(s.select(n), F.col(f"{n}_id") == F.col(f"{n}.node"))
    out = out.select(*SCOPE, *sets)
    for i, e in enumerate(pattern.edges):
        if not e.required:
            hop = by.where(F.col("p_") == e.predicate).select(F.col("s_").alias("near_"), F.col("o_").alias("far_"), F.lit(True).alias(f"edge_{i}"))
            out = out.join(hop, (F.col(f"{e.subject}.node") == F.col("near_")) & (F.col(f"{e.object}.node") == F.col("far_")), "left").drop("near_", "far_").withColumn(f"edge_{i}", F.coalesce(f"edge_{i}", F.lit(False)))
    return out


def _relations(sets: dict[str, DataFrame], by: DataFrame, pattern: Pattern) -> tuple[dict[str, set[str]], dict[str, DataFrame]]:
    """The variables of each relation, and its rows: scope and a node id for each variable."""
    ids = {n: s.select(*[F.col(f"{c}_{n}").alias(c) for c in SCOPE], F.col(f"{n}.node").alias(n)) for n, s in sets.items()}
    relations: dict[str, set[str]] = {}
    frames: dict[str, DataFrame] = {}
    for e in pattern.edges:
        if not e.required or e.subject == e.object:
            continue
        a, b = sorted((e.subject, e.object))
        hop = by.where(F.col("p_") == e.predicate).select(F.col("s_").alias(e.subject), F.col("o_").alias(e.object))
        name = f"{a} {b}"
        if name in frames:
            frames[name] = frames[name].join(hop, [a, b], "left_semi")
        else:
            other = ids[b].select(*[F.col(c).alias(f"{c}_b") for c in SCOPE], b)
            both = hop.join(ids[a], a).join(other, b)
            frames[name] = both.where(reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}_b")) for c in SCOPE])).select(*SCOPE, a, b)
            relations[name] = {a, b}
    frames = {n: materialize(f, "pattern-tie") for n, f in frames.items()}
    for n in sets:
        if not any(n in r for r in relations.values()):
            relations[n], frames[n] = {n}, ids[n]
    return relations, frames


def _ordered(o: Order, end: str = "") -> list[Column]:
    first, second = (f"{n}{end}" for n in ((o.second, o.first) if o.relation == "after" else (o.first, o.second)))
    gap = F.col(f"{second}.t0") - F.col(f"{first}.t1")
    said = [gap >= 0, gap <= o.max_gap]
    if o.same_actor:
        track = lambda n: F.when(F.col(f"{n}.node_type") == "tracklet", F.col(f"{n}.node")).otherwise(F.col(f"{n}.tracklet_id"))
        said.append(track(first) == track(second))
    return said


def candidates(bound: DataFrame, pattern: Pattern) -> DataFrame:
    """One row a set of nodes: the interval they span (one past the last instant), the atoms it covers and its nodes."""
    names = [*pattern.joined(), *[g.group for g in pattern.grouped("any")]]
    least = lambda f: F.array_min(F.array(*[F.col(f"{n}.{f}") for n in names]))
    most = lambda f: F.array_max(F.array(*[F.col(f"{n}.{f}") for n in names]))
    rows = bound.select(
        *SCOPE, least("t0").alias("t0"), (most("t1") + 1).alias("t1"), F.array(*[F.col(f"{n}.bound") for n in names]).alias("atoms"), F.array_sort(F.array(*[F.col(f"{n}.node") for n in names])).alias("nodes")
    )
    return rows.groupBy(*SCOPE, "nodes").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.min("atoms").alias("atoms"))


def probes(nodes: DataFrame, edges: DataFrame, pattern: Pattern) -> DataFrame:
    """One row: how many (binding, node) probes a nested search of the scopes makes, and whether the budget is reached.

    A variable is probed with all of its nodes for each binding so far; bindings
    grow within a scope only. Both come from the sizes of the match sets by scope.
    """
    sets = [matches(nodes, edges, pattern.named[v]) for v in pattern.joined()] + [choices(nodes, edges, pattern, g) for g in pattern.grouped("any")]
    each = [s.groupBy(*SCOPE).agg(F.count("*").alias("n")).withColumn("turn", F.lit(i)) for i, s in enumerate(sets)]
    sizes = reduce(lambda a, b: a.unionByName(b), each)
    by_scope = sizes.groupBy(*SCOPE).agg(*[F.sum(F.when(F.col("turn") == i, F.col("n")).otherwise(0)).cast("double").alias(f"n{i}") for i in range(len(sets))])
    grown = [F.coalesce(F.sum(reduce(lambda a, b: a * b, [F.col(f"n{j}") for j in range(i)], F.lit(1.0))), F.lit(0.0)) if i else F.lit(1.0) for i in range(len(sets))]
    total = [F.coalesce(F.sum(f"n{i}"), F.lit(0.0)) for i in range(len(sets))]
    joins = reduce(lambda a, b: a + b, [g * t for g, t in zip(grown, total, strict=True)], F.lit(0.0))
    one = by_scope.agg(joins.alias("joins"))
    return one.select(F.least("joins", F.lit(float(pattern.join_budget))).cast("long").alias("joins_completed"), (F.col("joins") > pattern.join_budget).alias("join_budget_reached"))


def decisions(nodes: DataFrame, edges: DataFrame, found: DataFrame, pattern: Pattern, scope: list[str], tolerance: int = 0) -> DataFrame:
    """One row a scope (columns of nodes) and logic group: state and reason.

    nodes also have `payload` (see graph.PAYLOAD) on observations, `predicate_scope`
    (the groups an episode speaks for), fragment_group and continuity. An episode
    that speaks for a group stands in for all other observations of its scope.
    """
    scopes = nodes.select(*scope).distinct()
    observed = nodes.where(F.col("node_type").isin("frame", "window", "episode") & F.col("payload").isNotNull())
    out: DataFrame | None = None
    for g in pattern.logic:
        own = observed.where((F.col("node_type") == "episode") & F.array_contains("predicate_scope", g.group))
        rest = observed.join(own.select(*[F.col(k).alias(f"{k}_o") for k in scope]).distinct(), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_o")) for k in scope]), "left_anti")
        safe = fold_safety(own.unionByName(rest), scopes, scope)
        if g.operator == "all":
            covers = found.where(F.size(F.array_except(F.array(*[F.lit(v) for v in g.variables]), "atoms")) == 0)
            hits = covers.groupBy(*scope).agg(F.count("*").alias("hits"))
        elif g.operator == "count":
            tracks = matches(nodes, edges, pattern.named[g.variables[0]]).where("node_type = 'tracklet'").withColumn("tracklet_id", F.col("node"))
            hits = bounded_count(tracks, scope, g.at_least, g.at_most, tolerance).select(*scope, F.col("observed").alias("hits"), F.col("state").alias("c_state"), F.col("reason").alias("c_reason"))
        else:
            every = [matches(nodes, edges, pattern.named[v]).select(*scope, "node") for v in g.variables]
            hits = reduce(lambda a, b: a.unionByName(b), every).groupBy(*scope).agg(F.count_distinct("node").alias("hits"))
        hits = hits.select(*[F.col(k).alias(f"{k}_h") for k in scope], *[c for c in hits.columns if c not in scope])
        met = safe.join(hits, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_h")) for k in scope]), "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
        dark = F.when(F.col("low_light_ticks") >= F.greatest(F.lit(1), F.col("observed")), "low_light").otherwise("occlusion_or_unassessable_region")
        unsafe = F.when(~F.col("complete"), F.lit("incomplete_observation_coverage")).when(~F.col("assessable"), dark)
        if g.operator == "visible_none":
            state = visible_none(F.col("hits"), F.col("complete"), F.col("assessable"))
            reason = F.coalesce(unsafe, F.when(F.col("hits") > 0, "target_visibly_present").otherwise("complete_visible_absence"))
        elif g.operator == "count":
            none = F.lit(g.at_least <= 0 <= g.at_most)
            own_state = F.coalesce(F.col("c_state"), F.when(none, "supported").otherwise("contradicted"))
            own_reason = F.coalesce(F.col("c_reason"), F.when(none, "count_within_bounds").otherwise("count_out_of_bounds"))
            state = F.when(~F.col("complete"), "undetermined").when(~F.col("assessable"), "unobservable").otherwise(own_state)
            reason = F.coalesce(unsafe, own_reason)
        else:
            yes, no = ("visible_alternative_present", "no_visible_alternative") if g.operator == "any" else ("all_visible_terms_present", "required_visible_term_missing")
            state = F.when(F.col("hits") > 0, "supported").when(~F.col("complete"), "undetermined").when(~F.col("assessable"), "unobservable").otherwise("contradicted")
            reason = F.when(F.col("hits") > 0, yes).otherwise(F.coalesce(F.when(~F.col("complete"), F.lit("incomplete_observation_coverage")).when(~F.col("assessable"), "occlusion_or_unassessable_region"), F.lit(no)))
        one = met.select(*scope, F.lit(g.group).alias("group"), state.alias("state"), reason.alias("reason"), F.col("hits").cast("long").alias("hits"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("a pattern without a logic group")
    return out


def trace(nodes: DataFrame, edges: DataFrame, decided: DataFrame, pattern: Pattern, scan_truncated: bool = False) -> DataFrame:
    """One row: tracklets considered, probes, whether a budget was reached, and what is unresolved (budget first)."""
    cost = probes(nodes, edges, pattern).select("joins_completed", (F.col("join_budget_reached") | F.lit(scan_truncated)).alias("join_budget_reached"))
    open_ = decided.where("state IN ('undetermined', 'unobservable')").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    tracks = nodes.agg(F.count_if(F.col("node_type") == "tracklet").alias("tracklets_considered"))
    # Three aggregates of one row each.
    one = tracks.join(F.broadcast(cost), F.lit(True)).join(F.broadcast(open_), F.lit(True))
    said = F.array_join(F.concat(F.when(F.col("join_budget_reached"), F.array(F.lit("join_or_scan_budget_reached"))).otherwise(F.array().cast("array<string>")), "reasons"), ";")
    return one.select("tracklets_considered", "joins_completed", "join_budget_reached", F.nullif(said, F.lit("")).alias("unresolved_reason"))


def bounded_scan(rows: DataFrame, units: list[str], order: list[str], limit: int) -> DataFrame:
    """The first `limit` rows of each scan unit, and whether the unit had more. Only limit + 1 rows a unit leave a task."""
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy(*units).orderBy(*order))
    some = rows.withColumn("turn_", turn).where(F.col("turn_") <= limit + 1)
    more = some.groupBy(*[F.col(u).alias(f"{u}_u") for u in units]).agg((F.max("turn_") > limit).alias("truncated"))
    return some.where(F.col("turn_") <= limit).drop("turn_").join(more, reduce(lambda a, b: a & b, [F.col(u).eqNullSafe(F.col(f"{u}_u")) for u in units])).drop(*[f"{u}_u" for u in units])
