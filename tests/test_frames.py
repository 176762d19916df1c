"""Motion scores, feature rows and grounding boxes; their queries against SQL twins."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from spanlight.operators import frames
from spanlight.plans import framewise


@pytest.mark.parametrize("name", list(framewise.QUERIES))
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = framewise.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({framewise.ORACLE_SQL[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert len(rows) > 100 and sorted(map(repr, rows)) == sorted(map(repr, want))


def test_motion_scores_against_a_loop(spark):
    rng = random.Random(3)
    samples = [(rng.choice(["a", "b", None]), i, rng.randrange(0, 200), rng.random()) for i in range(60)]
    rows = [(rng.choice(["a", "b", "c", None]), i, rng.choice([None, rng.randrange(-20, 220)]), "kept") for i in range(150)]
    got = frames.motion_scores(
        spark.createDataFrame(rows, "video_id string, frame_id long, at long, score string"),
        spark.createDataFrame(samples, "video_id string, sample_id long, pts long, score double"), ["video_id"], "at", width=25,
    ).collect()
    assert len(got) == len(rows) and all(r["score"] == "kept" for r in got)
    for r in got:
        own = [s for s in samples if s[0] == r["video_id"]]
        want = min(own, key=lambda s: (abs(s[2] - r["at"]), s[2], s[1]))[3] if own and r["at"] is not None else None
        assert r["motion_score"] == want


def test_feature_rows_and_their_errors(spark):
    schema = "id long, frame_ids array<long>, pts array<double>, features map<string,array<double>>"
    rows = spark.createDataFrame([(1, [5, 6], [0.0, 1.5], {"m": [1.0, 2.0], "s": [3.0, 4.0], "extra": [0.0]}), (2, [], [], {"m": [], "s": []})], schema)
    got = [(r["id"], r["tick"], r["frame_id"], r["pts"], r["vector"]) for r in frames.feature_rows(rows, ["id"], ["s", "m"]).collect()]
    assert got == [(1, 0, 5, 0.0, [3.0, 1.0]), (1, 1, 6, 1.5, [4.0, 2.0])]
    with pytest.raises(Exception, match="another length: extra, none"):
        frames.feature_rows(rows.where("id = 1"), ["id"], ["s", "extra", "none"]).collect()
    with pytest.raises(Exception, match="differ in length"):
        frames.feature_rows(rows.where("id = 1").withColumn("frame_ids", F.array(F.lit(1))), ["id"], ["s"]).collect()


def test_one_fault_drops_all_boxes_of_its_candidate(spark):
    box = lambda x1: {"x0": 0.0, "y0": 0.0, "x1": x1, "y1": 1.0}
    candidates = spark.createDataFrame([(i, i != 6, i != 7, None if i == 8 else "passed", i != 8) for i in range(1, 10)], "id long, verified boolean, enabled boolean, gate_status string, gate_passed boolean")
    said = [(i, k, "object", "supported", f"p{k}", [10, 11]) for i in range(1, 9) for k in (1, 2)] + [(9, 1, "action", "supported", "p1", [11, 10]), (9, 2, "object", "unclear", "p2", None)]
    said = [(*r[:5], []) if r[:2] == (3, 2) else r for r in said]
    supplied = [(i, f) for i in range(1, 10) for f in (10, 11) if (i, f) != (4, 11)]
    boxes = [(i, k, 10, 10, f"p{k}", box(1.0), 0.5, "r") for i in range(1, 9) for k in (1, 2) if (i, k) != (2, 2)]
    boxes += [(5, 1, 11, 11, "p1", box(1.1), 0.5, "r"), (5, 2, 11, 12, "p2", box(1.0), 0.5, "r")]
    got = frames.grounded_boxes(
        candidates,
        spark.createDataFrame(said, "id long, constraint_id long, kind string, state string, phrase string, frame_ids array<long>"),
        spark.createDataFrame(supplied, "id long, frame_id long"),
        spark.createDataFrame(boxes, "id long, constraint_id long, asked long, frame_id long, phrase string, box struct<x0:double,y0:double,x1:double,y1:double>, score double, revision string"), "id",
    )
    by = {r["id"]: (r["overlay"], r["n_boxes"], r["reason"], r["gate_status"], r["cited"]) for r in got.collect()}
    assert by[1] == (True, 2, None, "passed", [10, 11])
    reasons = {i: by[i][2] for i in range(2, 10)}
    assert reasons == {2: "no_stable_region", 3: "no_cited_evidence", 4: "frame_not_supplied", 5: "box_not_normalised", 6: "not_accepted", 7: "grounding_disabled", 8: "grounding_gate_not_passed", 9: "no_supported_phrase"}
    assert all(by[i][:2] == (False, 0) for i in range(2, 10)) and by[8][3] == "not_measured" and by[7][3] == "disabled" and by[9][4] == [10, 11]
