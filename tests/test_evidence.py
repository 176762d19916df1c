"""Hand cases and brute force for what SQL twins can't show: readers, guards, patterns, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanlight.functions.exprs import finite, frame_difference, in_group_scope, luminance, normalised, sharpness
from spanlight.operators import assemble, checks, decide, fuse, graph, ledger, pattern, retrieve, tracks
from spanlight.sources import tables as src

PAYLOAD = ", ".join(f"{n}:{k}" for n, k in (x.strip().split(" ") for x in graph.PAYLOAD.split(",")))
NODES = f"node string, node_type string, video_id string, camera_id string, t0 long, t1 long, labels string, tracklet_id string, payload struct<{PAYLOAD}>, predicate_scope array<string>, fragment_group string, continuity string"
EDGES = "subject string, predicate string, object string"


def node(name, kind="detection", labels="", t=(0, 0), payload=None, scope=None, camera="c", **more):
    said = {k.strip().split(" ")[0]: None for k in graph.PAYLOAD.split(",")} | payload if payload is not None else None
    return (name, kind, "v", camera, *t, labels, more.get("tracklet"), said and tuple(said.values()), scope, more.get("group"), more.get("continuity", "continuous"))


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), NODES)


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), EDGES)


def test_budget_is_a_flag_and_cuts_nothing(spark):
    n = nodes(spark, *[node(f"a{i}", labels="person") for i in range(5)], *[node(f"b{i}", labels="bag") for i in range(5)])
    p = pattern.Pattern((pattern.Variable("x", "person", ("detection",)), pattern.Variable("y", "bag", ("detection",))), join_budget=2)
    e = edges(spark, ("q", "near", "q"))
    assert pattern.probes(n, e, p).first()[:] == (2, True)
    assert pattern.bindings(n, e, p).count() == 25
    none = spark.createDataFrame([], "state string, reason string")
    assert pattern.trace(n, e, none, p).first().unresolved_reason == "join_or_scan_budget_reached"


def test_patterns_refuse_what_is_unsafe():
    v = (pattern.Variable("x", "a", ("detection",)),)
    for bad in ({"join_budget": 0}, {"edges": (pattern.Edge("x", "wears", "x"),)}, {"orders": (pattern.Order("x", "x", 40_000_000, same_actor=True),)}):
        with pytest.raises(ValueError):
            pattern.Pattern(v, **bad)
    assert pattern.stored_predicate("near") == "near" and pattern.stored_predicate("wears") is None
    with pytest.raises(ValueError):
        pattern.stored_predicate("owns")


def test_a_node_of_several_alternatives_takes_the_first(spark):
    n = nodes(spark, node("m", labels="red car"), node("o", labels="car"))
    p = pattern.Pattern((pattern.Variable("a1", "red", ("detection",)), pattern.Variable("a2", "car", ("detection",))), logic=(pattern.Logic("g", "any", ("a1", "a2")),))
    got = {r.nodes[0]: r.atoms for r in pattern.candidates(pattern.bindings(n, edges(spark, ("q", "near", "q")), p), p).collect()}
    assert got == {"m": ["a1"], "o": ["a2"]}


def test_absence_by_the_scope_that_speaks_for_it(spark):
    full = {"expected_ticks": 10, "observed_ticks": 10, "assessable_ticks": 10}
    dark = {"expected_ticks": 10, "observed_ticks": 10, "assessable_ticks": 0, "assessable": False}
    p = pattern.Pattern((pattern.Variable("x", "person", ("detection",)),), logic=(pattern.Logic("g1", "visible_none", ("x",)),))

    def state(*rows):
        n = nodes(spark, *rows)
        found = spark.createDataFrame([], "video_id string, atoms array<string>")
        return [r[2:4] for r in pattern.decisions(n, edges(spark, ("q", "near", "q")), found, p, ["video_id"]).collect()]

    assert state(node("w", "window", payload=full)) == [("supported", "complete_visible_absence")]
    assert state(node("w", "window", payload=full | {"observed_ticks": 9})) == [("undetermined", "incomplete_observation_coverage")]
    assert state(node("w", "window", payload=dark), node("e", "episode", payload=full, scope=["g1"])) == [("supported", "complete_visible_absence")]
    assert state(node("w", "window", payload=dark), node("e", "episode", payload=full, scope=["g2"]))[0][0] == "unobservable"
    assert state(node("w", "window", payload=full), node("d", labels="a person")) == [("contradicted", "target_visibly_present")]
    assert state(node("d", labels="nothing seen")) == [("undetermined", "incomplete_observation_coverage")]


def test_counts_of_tracks(spark):
    full = node("w", "window", payload={"expected_ticks": 4, "observed_ticks": 4, "assessable_ticks": 4})
    p = pattern.Pattern((pattern.Variable("x", "person", ("tracklet",)),), logic=(pattern.Logic("g", "count", ("x",), 1, 1),))
    none = spark.createDataFrame([], "video_id string, atoms array<string>")

    def state(*rows, link=()):
        return pattern.decisions(nodes(spark, full, *rows), edges(spark, ("q", "near", "q"), *link), none, p, ["video_id"]).first()[2:4]

    assert state(node("t", "tracklet", "person", continuity="interrupted")) == ("undetermined", "excessive_track_fragmentation")
    # A track without a label of its own, linked to a detection of another camera that has it.
    assert state(node("t", "tracklet"), node("d", labels="person", camera=None), link=[("d", "belongs_to_track", "t")]) == ("supported", "count_within_bounds")
    assert state(node("t", "tracklet", "person"), node("u", "tracklet", "person", camera="k"))[1] == "cross_camera_count"
    assert state(node("t", "tracklet", "person"), node("u", "tracklet", "person")) == ("contradicted", "count_out_of_bounds")
    assert state() == ("contradicted", "count_out_of_bounds")


def test_pattern_bindings_against_brute_force(spark):
    rng = random.Random(6)
    rows = [node(f"n{i}", labels=rng.choice(["a", "b", "c"]), t=(t := rng.randrange(60), t + rng.randrange(4)), camera=rng.choice(["c", None]), tracklet=f"t{i % 3}") for i in range(40)]
    links = list({(f"n{rng.randrange(40)}", rng.choice(["near", "follows"]), f"n{rng.randrange(40)}") for _ in range(900)})
    p = pattern.Pattern(
        tuple(pattern.Variable(v, v, ("detection",)) for v in "abc"), (pattern.Edge("a", "near", "b"), pattern.Edge("b", "follows", "c", required=False)), (pattern.Order("a", "c", 50), pattern.Order("c", "b", 60, relation="after", same_actor=True))
    )
    known, want = set(links), set()
    for a in rows:
        for b in rows:
            for c in rows:
                if (a[6], b[6], c[6]) == ("a", "b", "c") and a[3] == b[3] == c[3] and (a[0], "near", b[0]) in known and 0 <= c[4] - a[5] <= 50 and 0 <= c[4] - b[5] <= 60 and c[7] == b[7]:
                    want.add((a[0], b[0], c[0], (b[0], "follows", c[0]) in known))
    got = pattern.bindings(nodes(spark, *rows), edges(spark, *links), p).select("a.node", "b.node", "c.node", "edge_1").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 3


ANCHOR = "id long, video_id string, camera_id string, t0 long, t1 long, actor long, score double"


def _atoms(spark, seed, spans, n=60):
    r = random.Random(seed)
    row = lambda i: (lambda t: (i, r.choice(["v", "w"]), r.choice(["c", None]), t, t + r.choice(spans), r.randrange(2), r.random()))(r.randrange(100))
    rows = {k: [row(i) for i in range(n)] + [row(7)] for k in "abce"}  # two anchors of id 7
    return rows, {k: spark.createDataFrame(v, ANCHOR) for k, v in rows.items()}


CHAIN, TREE = [("a", "b", 9, False), ("b", "c", 5, True)], [("a", "b", 9, False), ("b", "c", 9, False), ("a", "c", 12, False), ("a", "e", 4, False)]


def _plain(rows, relations):
    names = list(dict.fromkeys(n for r in relations for n in r[:2]))
    out = [{}]
    for n in names:
        out = [{**o, n: x} for o in out for x in rows[n] if all((not o or x[1:3] == next(iter(o.values()))[1:3], *(0 <= {**o, n: x}[s][3] - {**o, n: x}[f][4] <= g and (not same or {**o, n: x}[s][5] == {**o, n: x}[f][5]) for f, s, g, same in relations if n in (f, s) and {f, s} <= {*o, n})))]
    return names, out


@pytest.mark.parametrize(("spans", "relations"), [([0], CHAIN), ([0], TREE), ([0, 1, 3], TREE), ([0, 1, 3], [("b", "a", 6, False), ("c", "a", 9, False)]), ([0, 1, 900], CHAIN), ([0, 1, 900], [("b", "a", 6, True), ("c", "a", 9, False)]), ([-2, 0, 3], CHAIN)])
def test_episodes_are_those_of_plain_loops(spark, spans, relations):
    """Repeated ids too: a binding is of anchors, not of ids."""
    rows, atoms = _atoms(spark, len(spans), spans)
    names, want = _plain(rows, relations)
    got = assemble.episodes(atoms, relations)
    assert sorted(str([tuple(r[n]) for n in names]) for r in got.collect()) == sorted(str([o[n] for n in names]) for o in want)
    assert len(want) > 5
    key = lambda o: (o[names[0]][1], o[names[0]][2] or "", min(x[3] for x in o.values()), max(x[4] for x in o.values()), *(o[n][0] for n in names))
    for cap in (1, 7, 10**6):
        few = assemble.first_episodes(atoms, relations, names, cap).collect()
        assert [(r.video_id, r.camera_id or "", r.t0, r.t1, *(r[n].id for n in names)) for r in few] == sorted(map(key, want))[:cap]
        assert {r.cap_bound for r in few} == {len(want) > cap}


def test_episodes_shuffle_anchors_not_bindings(spark):
    """One exchange an atom, and none of bindings (round 4: four_atom_episode filled the disk with them)."""
    atoms = _atoms(spark, 5, [0])[1]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = assemble.episodes(atoms, TREE)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 4 and plan.count("SortMergeJoin") == 3


def test_pairs_in_time_shuffle_what_is_read(spark):
    """Ids and times alone are shuffled, in as many parts as are named; a gap of 0 is a gap (before, a division by zero)."""
    rows, atoms = _atoms(spark, 5, [0, 2])
    pairs = lambda gap: assemble.temporal_pairs(atoms["a"], atoms["b"], gap).select("l.id", F.col("r.id").alias("r"))
    for gap in (0, 7):
        want = sorted((x[0], y[0]) for x in rows["a"] for y in rows["b"] if x[1:3] == y[1:3] and 0 <= y[3] - x[4] <= gap)
        assert sorted(map(tuple, pairs(gap).collect())) == want and want
    plan = pairs(7)._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
    assert "score" not in plan.split("LogicalRDD")[0] and "actor" not in plan.split("LogicalRDD")[0]


def test_first_episodes_are_not_enumerated(spark, monkeypatch):
    """Only first anchors that begin one of the first episodes are bound (round 4: episode_order formed all episodes)."""
    atoms = _atoms(spark, 5, [0])[1]
    met, whole = [], assemble.episodes
    monkeypatch.setattr(assemble, "episodes", lambda a, r: met.append(a["a"].count()) or whole(a, r))
    assert assemble.first_episodes(atoms, CHAIN, ["a", "b", "c"], 2).count() == 2
    assert 0 < met[0] <= 6


def test_bounded_scan_flags_units_of_their_own(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(3)] + [(None, 1)], "unit string, t long")
    got = sorted((str(r.unit), r.t, r.truncated) for r in pattern.bounded_scan(rows, ["unit"], ["t"], 3).collect())
    assert got == [("None", 1, False), *[("a", i, True) for i in range(3)], *[("b", i, False) for i in range(3)]]


def test_episodes_and_their_cap(spark):
    cols = "id long, video_id string, camera_id string, t0 long, t1 long, actor long, score double"
    enter = spark.createDataFrame([(1, "v", "c", 10, 14, 1, 0.5), (2, "v", "c", 150, 160, 2, 0.1)], cols)
    leave = spark.createDataFrame([(3, "v", "c", 200, 204, 1, 0.9), (4, "v", "c", 5, 6, 1, 0.9), (5, "v", "k", 200, 204, 1, 0.9)], cols)
    e = assemble.episodes({"enter": enter, "leave": leave}, [("enter", "leave", 600, False)])
    assert sorted((r.enter.id, r.leave.id, r.t0, r.t1, r.priority) for r in e.collect()) == [(1, 3, 10, 204, 0.9), (2, 3, 150, 204, 0.9)]
    same = assemble.episodes({"enter": enter, "leave": leave}, [("enter", "leave", 600, True)])
    assert [(r.enter.id, r.leave.id) for r in same.collect()] == [(1, 3)]
    ids = [F.col("enter.id"), F.col("leave.id")]
    assert [(r.enter.id, r.cap_bound) for r in assemble.capped(e, ids, 1).collect()] == [(1, True)]
    assert [r.cap_bound for r in assemble.capped(e, ids, 2).collect()] == [False, False]


def test_evidence_frames_against_brute_force(spark):
    rng = random.Random(1)
    spans = [(f"s{i}", "v", None if i % 2 else "c", t := rng.randrange(500), t + rng.randrange(5, 120)) for i in range(25)]
    frames = [("v", c, rng.randrange(650), i) for i, c in enumerate([None, "c"] * 120)]
    got = tracks.evidence_frames(spark.createDataFrame(spans, "span_id string, video_id string, camera_id string, t0 long, t1 long"), spark.createDataFrame(frames, "video_id string, camera_id string, pts long, frame_id long"), 5, 50)
    by = {}
    for r in got.orderBy("span_id", "ordinal").collect():
        by.setdefault(r.span_id, []).append((r.pts, r.frame_id))
    for name, _, camera, t0, t1 in spans:
        pool = sorted((p, i) for _, c, p, i in frames if c == camera and t0 <= p < t1)
        n = min(24, max(8, -(-(t1 - t0) // 5)), len(pool))
        taken = []
        for k in range(n):
            target = t0 + (t1 - t0) * (k + 0.5) / n
            best = min(range(len(pool)), key=lambda i: (abs(pool[i][0] - target), i))
            taken.append(pool.pop(best))
        assert by.get(name, []) == sorted(taken)


def test_readers(spark, tmp_path):
    schema = "benchmark_id string, latency double"
    (tmp_path / "ok.jsonl").write_text('{"benchmark_id":"B1","latency":1.5}\n{"benchmark_id":"B2","latency":2}\n')
    (tmp_path / "bad.jsonl").write_text('{"benchmark_id":"B1","latency":1.5}\n{"benchmark_id":\n')
    from pyspark.sql.types import StructType

    s = StructType.fromDDL(schema)
    assert src.json_lines(spark, str(tmp_path / "ok.jsonl"), s).count() == 2
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        src.json_lines(spark, str(tmp_path / "bad.jsonl"), s).collect()
    assert src.measurements(spark, str(tmp_path / "ok.jsonl"), s, ["B1", "B2"]).count() == 2
    with pytest.raises(ValueError, match="B2"):
        src.measurements(spark, str(tmp_path / "ok.jsonl"), s, ["B1"])
    docs = tmp_path / "docs"
    docs.mkdir()
    for i in (1, 2):
        (docs / f"{i}.json").write_text(json.dumps({"config": f"c{i}", "n": i}, indent=1))
    b = StructType.fromDDL("config string, n long")
    assert src.prediction_bundles(spark, str(docs), b).count() == 2
    (docs / "3.json").write_text('{"config":"c1","n":3}')
    with pytest.raises(ValueError, match="c1"):
        src.prediction_bundles(spark, str(docs), b)
    import hashlib

    assert {r.sha256 for r in src.file_digests(spark, str(tmp_path / "ok.jsonl")).collect()} == {hashlib.sha256((tmp_path / "ok.jsonl").read_bytes()).hexdigest()}


def test_views_and_generations_are_guarded(spark):
    assert not src.active_views(spark, "an_nodes", "an_edges")
    spark.range(1).createOrReplaceTempView("an_nodes")
    with pytest.raises(RuntimeError):
        src.active_views(spark, "an_nodes", "an_edges")
    spark.range(1).createOrReplaceTempView("an_edges")
    assert src.active_views(spark, "an_nodes", "an_edges")
    rows = spark.createDataFrame([(1, 0), (2, 1)], "id long, generation long")
    states = spark.createDataFrame([(0, "complete"), (1, "building")], "generation long, status string")
    assert src.finalised(rows, states, [0]).count() == 1
    with pytest.raises(ValueError, match="1"):
        src.finalised(rows, states, [0, 1])


def test_errors_are_raised_where_rows_break_a_rule(spark):
    one = spark.range(1)
    for bad in (normalised(F.array(F.lit(0.0))), finite(F.lit(float("nan"))), frame_difference(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)))):
        with pytest.raises(Exception, match="zero vector|finite|dimensions"):
            one.select(bad).collect()
    with pytest.raises(ValueError):
        retrieve.in_zones(one, ["z"])
    clash = spark.createDataFrame([(1, "v", None, 0, 1, 1, "a", 0.5, [1]), (1, "v", None, 0, 2, 2, "b", 0.5, [1])], "candidate_id long, video_id string, camera_id string, t0 long, t1 long, seq long, channel string, score double, evidence array<long>")
    with pytest.raises(Exception, match="two intervals"):
        fuse.merge(clash).collect()


def test_image_measures(spark):
    flat, spot = [10] * 16, [0] * 5 + [255] + [0] * 10
    d = spark.createDataFrame([(flat, spot)], "a array<int>, b array<int>")
    r = d.select(luminance(F.col("a")), sharpness(F.col("a"), 4), sharpness(F.col("b"), 4), frame_difference(F.col("a"), F.col("b")), sharpness(F.slice("a", 1, 4), 2)).first()
    lap = [-1020, 255, 255, 0]
    mean = sum(lap) / 4
    assert r[0] == pytest.approx(10 / 255) and r[1] == 0 and r[2] == pytest.approx(sum((x - mean) ** 2 for x in lap) / 4) and r[3] == pytest.approx((15 * 10 + 245) / 16 / 255) and r[4] == 0


def test_group_scopes_of_odd_payloads(spark):
    d = spark.createDataFrame([('"g"',), ('["x","g"]',), ('{"group_id":"g"}',), ("3",), (None,), ("no json",), ('{"other":"g"}',)], "p string")
    assert [r[0] for r in d.select(in_group_scope(F.col("p"), "g")).collect()] == [True, True, True, False, False, False, False]


def test_gates_count_what_is_missing_against_them(spark):
    g = spark.createDataFrame([(1, 25, 25, 0, 1.0, 2.0, True), (2, 25, None, 0, 1.0, 2.0, True)], "id long, evaluated long, correct long, gross long, latency double, max_latency double, unchanged boolean")
    got = {r.id: r for r in checks.grounding_gate(g, ["id"]).collect()}
    assert got[1].passed and not got[2].passed and got[2].status == "not_measured"


def test_reranking_falls_back_as_a_whole(spark):
    rows = [(1, "a", 0.1, 0.9), (1, "b", 0.9, None), (2, "a", 0.1, 0.9), (2, "b", 0.9, 0.2)]
    d = spark.createDataFrame(rows, "query long, cluster_id string, priority double, relevance double")
    got = {(r.query, r.cluster_id): (r["mode"], r["rank"]) for r in decide.rerank(d, F.lit("active")).collect()}
    assert got == {(1, "a"): ("fallback", 2), (1, "b"): ("fallback", 1), (2, "a"): ("active", 1), (2, "b"): ("active", 2)}


def test_coverage_of_a_video_without_ticks(spark):
    t = spark.createDataFrame([("v", "embedded"), ("v", "decode_failed"), ("v", "skipped")], "video_id string, status string")
    every = spark.createDataFrame([("v",), ("w",)], "video_id string")
    assert {r.video_id: round(r.coverage, 6) for r in ledger.coverage(t, ["video_id"], every).collect()} == {"v": 0.333333, "w": 0.0}


def _stream(spark, tmp_path, batches, schema, build, mode="append"):
    """Feeds batches one after the other as files, restarting the query from its checkpoint after each."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir(parents=True)
    from spanlight.streaming import stateful

    spark.conf.set("spark.sql.shuffle.partitions", "1")  # state has a store a partition
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{i}"))
        df = build(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(folder)))
        q = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(stateful.write_block(out)).start()
        q.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark.read.option("basePath", out).parquet(out)


def _cuts(rng, rows, late, end):
    """rows, (time, ...), in an order in which none is more than `late` after a later one, in three micro-batches, and `end` alone."""
    rows = sorted(rows, key=lambda r: r[0] + rng.uniform(0, late))
    a, b = sorted(rng.sample(range(1, len(rows)), 2))
    return [[r[1] for r in part] for part in (rows[:a], rows[a:b], rows[b:])] + [end]


@pytest.mark.parametrize("seed", [1])
def test_streaming_nearest_frames_for_any_split(spark, tmp_path, seed):
    """Targets and frames come late and out of order; another video's rows move the watermark."""
    from spanlight.operators import intervals
    from spanlight.streaming import stateful

    ms, rng = 1000, random.Random(seed)
    frames = [("v", rng.randrange(0, 5000) * ms, i) for i in range(40)] + [("u", 900 * ms, 99)]
    targets = [("v", rng.randrange(0, 5200) * ms) for _ in range(40)] + [("u", 0), ("w", 100 * ms)]
    rows = [(p, (v, "frame", p, i)) for v, p, i in frames] + [(p, (v, "target", p, None)) for v, p in targets]
    end = [(v, "end", 9_000 * ms, None) for v in "vuw"]
    got = _stream(spark, tmp_path, _cuts(rng, rows, 400 * ms, end), "video_id string, kind string, pts long, frame_id long", lambda df: stateful.nearest_stream(df, 300 * ms, "500 milliseconds")).collect()
    t = spark.createDataFrame(targets, "video_id string, at long")
    f = spark.createDataFrame([(v, p, i) for v, p, i in frames], "video_id string, at long, id long")
    want = intervals.nearest_join(t, f, ["video_id"], "at", "id", 300 * ms).collect()
    key = lambda rows, at: sorted((r.video_id, r[at], r.frame_pts or -1, r.error_code or "") for r in rows)
    assert key(got, "target_pts") == key(want, "at")


def test_streaming_late_target_finds_its_frame(spark, tmp_path):
    from spanlight.streaming import stateful

    rows = [[("v", "frame", 0, 1), ("v", "frame", 100_000, 2)], [("v", "target", 10_000, None)], [("x", "frame", 900_000, 3)]]
    got = _stream(spark, tmp_path, rows, "video_id string, kind string, pts long, frame_id long", lambda df: stateful.nearest_stream(df, late="200 milliseconds", idle=300_000)).collect()
    assert [tuple(r)[:4] for r in got] == [("v", 10_000, 1, 0)]
    # Video v said no end: a timer has closed it, and its state is gone.
    left = spark.read.format("statestore").option("stateVarName", "frames").load(str(tmp_path / "ck")).select("key.video_id").distinct().collect()
    assert [r[0] for r in left] == ["x"]


@pytest.mark.parametrize("seed", [1])
def test_streaming_tracklets_equal_the_batch_for_any_split(spark, tmp_path, seed):
    from spanlight.streaming import stateful

    ms, rng = 1000, random.Random(seed)
    schema = "video_id string, camera_id string, detection_id long, pts long, label string, x0 double, y0 double, x1 double, y1 double"
    rows = [("v", rng.choice(["c", "k"]), i, rng.randrange(2000) * ms, rng.choice(["a", "b"]), x := rng.random(), 0.0, x + 0.5, 1.0) for i in range(120)]
    end = [("z", "c", 999, 9_000 * ms, "a", 0.0, 0.0, 1.0, 1.0)]
    out = _stream(spark, tmp_path, _cuts(rng, [(r[3], r) for r in rows], 100 * ms, end), schema, lambda df: stateful.tracklet_stream(df, 90 * ms, 30 * ms, late="150 milliseconds")).where("video_id = 'v'").collect()
    want = tracks.associate(spark.createDataFrame(rows, schema), 90 * ms, 30 * ms).collect()
    assert {r.detection_id: r.tracklet for r in out if r.event == "placed"} == {r.detection_id: r.tracklet for r in want}
    # Each track is closed once, by a timer at last, with the continuity that the batch gives it.
    assert sorted((r.tracklet, r.continuity) for r in out if r.event == "closed") == sorted({(r.tracklet, r.continuity) for r in want})


def test_ledger_stream_checks_restarts_and_replays(spark, tmp_path):
    from spanlight.streaming import stateful

    schema = "video_id string, target_pts long, seq long, status string, at long"
    rng = random.Random(4)
    rows = [("v", p, s, rng.choice(list(ledger.TRANSITIONS)), 1000 * (s + 1)) for p in range(30) for s in range(rng.randint(1, 5))] + [("v", 99, 0, "pending", 1)]
    batches = [[r for r in rows if r[2] < 2], [r for r in rows if r[2] >= 1]]  # the changes of number 1 come twice
    out = _stream(spark, tmp_path, batches, schema, stateful.ledger_stream)
    want = ledger.transitions(spark.createDataFrame(rows, schema).withColumnRenamed("status", "state"), ["video_id", "target_pts"], "seq")
    plain = lambda df, state: sorted(map(tuple, df.select("video_id", "target_pts", "seq", state, F.coalesce("before", F.lit("")), "legal").collect()))
    assert plain(out, "status") == plain(want, "state")
    last = _stream(spark, tmp_path / "later", [[("v", 1, 0, "pending", 10)], [("w", 1, 0, "pending", 9_000_000)]], schema, lambda df: stateful.ledger_stream(df, 1_000_000, "1 second"))
    assert last.count() == 2
    left = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "later" / "ck")).select("key.video_id").collect()
    assert [r[0] for r in left] == ["w"]
    again = stateful.write_block(str(tmp_path / "replay"))
    for _ in range(2):
        again(spark.range(7), 3)
    assert spark.read.parquet(str(tmp_path / "replay")).count() == 7


def test_json_schema_errors(spark):
    from spanlight.functions.schema import errors

    schema = {
        "$defs": {"id": {"type": "string", "pattern": "^[a-z]+$", "minLength": 2}},
        "type": "object", "required": ["id"],
        "properties": {"id": {"$ref": "#/$defs/id"}, "n": {"oneOf": [{"type": "integer"}, {"type": "number", "maximum": 1}]}, "x": {"anyOf": [{"type": "null"}, {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/id"}}]}},
    }
    docs = ['{"id":"ab"}', '{"id":"A"}', "{}", "[]", None, '{"id":"ab","n":0.5}', '{"id":"ab","n":1}', '{"id":"ab","n":2.5}', '{"id":"ab","x":null}', '{"id":"ab","x":["ab","c"]}', '{"id":7,"x":["ab"]}']
    d = spark.createDataFrame([(x,) for x in docs], "t string")
    got = [r[0] for r in d.select(errors(schema, F.try_parse_json("t"))).collect()]
    assert got == [[], ["$.id: pattern", "$.id: minLength"], ["$: id is missing"], ["$: type is not object"], ["$: no JSON document"], [], ["$.n: oneOf"], ["$.n: oneOf"], [], ["$.x: anyOf"], ["$.id: type is not string"]]
    with pytest.raises(ValueError, match="itself"):
        errors({"properties": {"a": {"$ref": "#"}}, "$defs": {}} | {"$ref": "#/$defs/a", "$defs": {"a": {"$ref": "#/$defs/a"}}}, F.lit(None))
    with pytest.raises(ValueError, match="unsupported"):
        errors({"format": "date"}, F.lit(None))
