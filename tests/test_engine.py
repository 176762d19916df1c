import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from spanlight.functions.exprs import label_match, precedes, t_iou
from spanlight.operators import assemble, decide, graph, intervals, ledger, retrieve
from spanlight.plans import registry
from spanlight.streaming import ticks as streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted((tuple(round(float(x), 7) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    cur = con.execute(registry.ORACLE_SQL[name])
    theirs = [c[0] for c in cur.description]
    assert sorted(theirs) == names
    want = [tuple(r[theirs.index(n)] for n in names) for r in cur.fetchall()]
    assert plain(want) == plain(df.select(*names).collect())


def test_half_open_ticks(spark):
    v = spark.createDataFrame([("a", 3_000_000), ("b", 0)], "video_id string, duration long")
    assert [r.target_pts for r in ledger.expected_ticks(v, 1_000_000).orderBy("target_pts").collect()] == [0, 1_000_000, 2_000_000]


def test_nearest_frame_takes_the_earlier_of_a_tie(spark):
    t = spark.createDataFrame([("v", x) for x in (0, 100, 200)], "video_id string, at long")
    f = spark.createDataFrame([("v", 4, 1), ("v", 90, 2), ("v", 110, 3), ("v", 220, 4)], "video_id string, at long, id long")
    got = intervals.nearest_join(t, f, ["video_id"], "at", "id").orderBy("at").collect()
    assert [r.frame_id for r in got] == [1, 2, 4]


@pytest.mark.parametrize("width", [3, 40, 10_000])
def test_nearest_frame_in_buckets(spark, width):
    import random

    rng = random.Random(2)
    t = [(v, rng.randrange(2000)) for v in ("a", None, "none") for _ in range(60)]
    f = [(v, rng.randrange(300, 1500), i) for i, v in enumerate(["a", None] * 40)]
    got = intervals.nearest_join(spark.createDataFrame(t, "video_id string, at long"), spark.createDataFrame(f, "video_id string, at long, id long"), ["video_id"], "at", "id", 100, width).collect()
    assert len(got) == len(t)
    for r in got:
        own = [x[1] for x in f if x[0] == r.video_id]
        best = min(own, key=lambda x: (abs(x - r.at), x), default=None)
        far = best is not None and abs(best - r.at) > 100
        assert r.frame_pts == (None if far else best)
        assert r.error_code == ("no_decodable_frame" if best is None else "nearest_frame_too_far" if far else None)


@pytest.mark.parametrize("width", [5, 1000])
def test_islands_and_ranks_in_buckets(spark, width):
    import random

    rng = random.Random(3)
    rows = [(k, a, a + rng.randrange(1, 9)) for k in ("x", None) for a in (rng.randrange(400) for _ in range(80))]
    d = spark.createDataFrame(rows, "k string, t0 long, t1 long")
    want = []
    for k in ("x", None):
        reach, n = None, 0
        for a, b in sorted(r[1:] for r in rows if r[0] == k):
            n += reach is None or a > reach + 2
            reach = b if reach is None else max(reach, b)
            want.append((str(k), a, b, n))
    got = intervals.islands(d, ["k"], "t0", "t1", [], 2, width)
    assert sorted((str(r.k), r.t0, r.t1, r.island) for r in got.collect()) == sorted(want)
    ranks = intervals.ranked(d.distinct(), ["k"], [-F.floor(F.col("t1") / width)], [F.desc("t1"), F.desc("t0")])
    for k in ("x", None):
        own = sorted({r for r in rows if r[0] == k}, key=lambda r: (-r[2], -r[1]))
        assert [(r.t0, r.t1) for r in ranks.where(F.col("k").eqNullSafe(F.lit(k))).orderBy("rank").collect()] == [r[1:] for r in own]


def test_range_join_has_null_cameras_and_no_doubles(spark):
    p = spark.createDataFrame([("v", None, 5), ("v", "c", 5)], "video_id string, camera_id string, pts long")
    s = spark.createDataFrame([("v", None, 0, 30), ("v", None, 5, 6), ("v", None, 6, 9)], "video_id string, camera_id string, t0 long, t1 long")
    assert intervals.range_join(p, s, ["video_id", "camera_id"], "pts", "t0", "t1", 4).count() == 2


def test_top_fifth(spark):
    h = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.1, 0.2, 0.9, 0.8, 0.3])], "w int, tick_id int, score double")
    assert retrieve.window_scores(h, ["w"], "top20_mean").first().score == pytest.approx(0.9)


def test_islands_join_at_exactly_the_gap(spark):
    d = spark.createDataFrame([(1, 0, 10), (1, 12, 13), (1, 16, 17)], "k int, t0 long, t1 long")
    assert [r.island for r in intervals.islands(d, ["k"], "t0", "t1", [], 2).orderBy("t0").collect()] == [1, 1, 2]


def test_whole_tokens_only(spark):
    d = spark.createDataFrame([("a red-car",), ("scarred",)], "t string")
    assert [r[0] for r in d.select(label_match(F.col("t"), "Red car")).collect()] == [True, False]


def test_interval_expressions(spark):
    d = spark.createDataFrame([(0, 10, 5, 15)], "a long, b long, c long, d long")
    r = d.select(t_iou(*[F.col(x) for x in "abcd"]), precedes(F.col("b"), F.col("d"), 5)).first()
    assert r[0] == pytest.approx(1 / 3) and r[1]


def test_pairs_stay_in_their_camera(spark):
    cols = "id long, video_id string, camera_id string, t0 long, t1 long"
    a = spark.createDataFrame([(1, "v", None, 0, 10)], cols)
    b = spark.createDataFrame([(2, "v", None, 15, 20), (3, "v", "c", 15, 20), (4, "v", None, 5, 6), (5, "v", None, 21, 22)], cols)
    assert [r.r.id for r in assemble.temporal_pairs(a, b, 10).collect()] == [2]


def test_absence_needs_a_complete_interval(spark):
    d = spark.createDataFrame([(0, True, True), (0, False, True), (0, True, False), (1, True, True), (1, False, True)], "m int, c boolean, a boolean")
    got = [r[0] for r in d.select(graph.visible_none(*[F.col(x) for x in "mca"])).collect()]
    assert got == ["supported", "undetermined", "unobservable", "contradicted", "undetermined"]


def test_decisions_keep_visual_and_system_causes_apart(spark):
    e = [(1, "a", "supported"), (1, "b", "supported"), (2, "a", "contradicted"), (2, "b", "unobservable"), (3, "a", "unobservable"), (3, "b", "undetermined"), (4, "a", "undetermined"), (4, "b", "supported"), (1, "extra", "contradicted")]
    df = spark.createDataFrame(e, "candidate long, constraint string, state string")
    got = {r.candidate: r[1:5] for r in decide.candidates(df, ["a", "b"]).collect()}
    assert got == {1: (True, False, False, False), 2: (False, True, False, False), 3: (False, False, True, True), 4: (False, False, False, True)}
    with pytest.raises(Exception, match="required constraints are missing"):
        decide.candidates(df, ["a", "c"]).collect()
    with pytest.raises(ValueError):
        decide.candidates(df, [])


def test_conclusions_in_their_order(spark):
    cols = "archive int, whole boolean, verified_match boolean, rejected_near_match boolean, unresolved_visual boolean, unresolved_system boolean"
    rows = [(1, False, True, False, False, True), (2, False, False, False, True, False), (3, True, False, False, True, False), (4, True, False, False, False, True), (5, True, False, True, False, False), (6, True, False, False, True, True)]
    d = spark.createDataFrame(rows, cols)
    got = {r.archive: r.conclusion for r in decide.conclusion(d.where("archive < 6"), ["archive"], F.col("whole")).collect()}
    assert got == {1: "verified_matches_found", 2: "search_incomplete", 3: "insufficient_visual_evidence", 4: "not_applicable", 5: "no_verified_match"}
    with pytest.raises(Exception, match="mixed"):
        decide.conclusion(d, ["archive"], F.col("whole")).collect()


def test_stream_equals_batch(spark, tmp_path):
    from spanlight.sources import tables

    t = tables.ticks(spark, DATA).select(F.col("ts").cast("timestamp").alias("ts"), "label", "score")
    t.repartition(3).write.parquet(str(tmp_path / "in"))
    q = streams.windowed(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert plain(spark.table("w").collect()) == plain(streams.windowed(t).collect())


def test_greedy_match_against_brute_force(spark):
    from spanlight.operators import evaluate

    truth = [(q, i, 7 * i % 40, 7 * i % 40 + 6 + i % 5) for q in (1, 2) for i in range(25)]
    found = [(q, i, 5 * i % 43, 5 * i % 43 + 4 + i % 7) for q in (1, 2) for i in range(30)]
    cols = "q long, id long, t0 long, t1 long"

    def iou(a, b):
        inter = max(0, min(a[3], b[3]) - max(a[2], b[2]))
        return inter / (a[3] - a[2] + b[3] - b[2] - inter)

    want, used_g, used_f = set(), set(), set()
    for s, g, f in sorted(((-iou(g, f), g, f) for g in truth for f in found if g[0] == f[0] and iou(g, f) >= 0.3), key=lambda x: (x[0], x[1][1], x[2][1])):
        if g not in used_g and f not in used_f:
            used_g.add(g)
            used_f.add(f)
            want.add((g[0], g[1], f[1]))
    got = evaluate.greedy_match(spark.createDataFrame(truth, cols), spark.createDataFrame(found, cols), "q", 8, 0.3)
    assert {(r.q, r.gt, r.pred) for r in got.collect()} == want


def test_empty_tables_give_defined_metrics(spark):
    from spanlight.operators import evaluate

    none = spark.createDataFrame([], "is_empty boolean, returned_empty boolean")
    assert evaluate.rejection(none).first()[:3] == (0.0, 0.0, 0.0)
    assert evaluate.count_error(spark.createDataFrame([], "pred string, gt string")).first().mae is None
    a = spark.createDataFrame([], "id long, video_id string, camera_id string, t0 long, t1 long")
    assert assemble.rejections(a, a, 5).first()[:] == (0, 0, 0, 0)


def test_tracklets_against_brute_force(spark):
    import random

    from spanlight.operators import tracks

    rng = random.Random(4)
    rows = [(v, None if k % 9 == 0 else "c", 1000 * v + k, rng.randrange(3000), rng.choice(["a", "b", None]), x := rng.random(), 0.0, x + 0.5, 1.0) for v in (1, 2) for k in range(300)]
    want = {}
    for group in {(r[0], r[1], r[4]) for r in rows}:
        own = []
        for r in sorted((r for r in rows if (r[0], r[1], r[4]) == group), key=lambda r: (r[3], r[2])):
            fits = [(i, -t[-1][3], -k, t) for k, t in enumerate(own) if 0 <= r[3] - t[-1][3] <= 90 and (i := tracks.iou(t[-1][5:], r[5:])) >= 0.2]
            max(fits, key=lambda f: f[:3])[3].append(r) if fits else own.append([r])
        for t in own:
            broken = any(b[3] - a[3] > 30 for a, b in zip(t, t[1:]))
            want |= {r[2]: (t[0][2], "interrupted" if broken else "continuous") for r in t}
    got = tracks.associate(spark.createDataFrame(rows, "video_id int, camera_id string, detection_id long, pts long, label string, x0 double, y0 double, x1 double, y1 double"), 90, 30)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    assert {r.detection_id: (r.tracklet, r.continuity) for r in got.collect()} == want and len(want) == 600
    assert len(set(want.values())) > 20
