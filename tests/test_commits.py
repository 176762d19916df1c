"""Canonical JSON, seals, logs that are torn, pointers with two writers, and lines of files in many parts."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlight.functions import canonical as c
from spanlight.operators import commits, seals
from spanlight.sources import jsonlines


def test_key_order_and_nesting_do_not_change_ids(spark):
    a = '{"b": 1.50, "a": {"d": [{"z": 1, "y": null}], "c": "é"}, "Z": true}'
    b = '{"Z":true,"a":{"c":"é","d":[{"y":null,"z":1}]},"b":1.5}'
    rows = spark.createDataFrame([(a, 1), (b, 1)], "j string, x int")
    assert {r[0] for r in rows.select(c.canonical_text(F.col("j"))).collect()} == {b}
    x = F.col("x")
    one = c.content_id(x.alias("k"), F.struct(x.alias("q"), F.create_map(F.lit("n"), x, F.lit("m"), x).alias("p")).alias("a"))
    two = c.content_id(F.struct(F.create_map(F.lit("m"), x, F.lit("n"), x).alias("p"), x.alias("q")).alias("a"), x.alias("k"))
    other = c.content_id(x.alias("k"), F.lit(None).cast("int").alias("a"))
    got = rows.select(one, two, other, c.canonical(x.alias("k"), F.when(x > 5, x).alias("a"))).first()
    assert got[0] == got[1] != got[2] and got[3] == '{"a":null,"k":1}'
    with pytest.raises(Exception, match="MALFORMED"):
        spark.createDataFrame([('{"a":1,"a":2}',)], "j string").select(c.canonical_text(F.col("j"))).collect()


def test_seals_name_what_changed(spark):
    r = random.Random(2)
    old = [(s, f"dir/{i}", f"{r.random()}") for s in "ab" for i in range(600)]
    new = [x for x in old if x != old[5]]
    new[17] = (*new[17][:2], "altered")
    new.append(("b", "dir/new", None))
    r.shuffle(new)
    frame = lambda rows: spark.createDataFrame(rows, "seal_id string, path string, digest string")
    a, b = frame(old), frame(new)
    want = {("a", "dir/5", "removed"), ("a", "dir/18", "altered"), ("b", "dir/new", "added")}
    assert {tuple(x) for x in seals.changed(a, b).collect()} == want
    one = {x.seal_id: (x.digest, x.parts) for x in seals.seal(a).collect()}
    assert one == {x.seal_id: (x.digest, x.parts) for x in seals.seal(frame(old[::-1])).collect()} and one["a"][1] == 600
    assert all(one[x.seal_id][0] != x.digest for x in seals.seal(b).collect())
    assert seals.seal(a.limit(0)).count() == 0 and seals.changed(a, a).count() == 0


def test_a_torn_tail_is_cut_back(spark, tmp_path):
    log = commits.BlockLog(spark, str(tmp_path / "log"))
    block = lambda i: spark.range(10 * i, 10 * i + 10).select("id", F.array(F.col("id") * 0.5).alias("vector"))
    for i in range(4):
        log.append(block(i))
    whole, final = log.rows().count(), log.final_hash()
    assert log.repair() == [] and whole == 40
    part = next((tmp_path / "log" / "00000002" / "data").glob("part-*.parquet"))
    part.write_bytes(part.read_bytes()[:100])
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    (tmp_path / "log" / "_draft-dead" / "data").mkdir(parents=True)
    assert log.orphans() == ["_draft-dead"] and not log.sound("00000002") and log.sound("00000003")
    assert log.repair() == ["00000002", "00000003"]
    assert log.blocks() == ["00000000", "00000001"] and log.rows().count() == 20
    log.append(block(2))
    log.append(block(3))
    assert log.final_hash() == final
    changed = commits.BlockLog(spark, str(tmp_path / "other"))
    changed.append(block(0).withColumn("vector", F.array(F.lit(9.0))))
    assert changed.final_hash() != log.final_hash()
    for gone in (tmp_path / "log" / "00000003" / "data").iterdir():
        gone.unlink()
    assert log.repair() == ["00000003"]


def test_one_of_two_writers_moves_the_pointer(spark, tmp_path):
    g = commits.Generations(spark, str(tmp_path / "g"))
    states = spark.createDataFrame([("v1", 1, "complete"), ("v1", 2, "complete"), ("v2", 1, "complete"), ("v2", 2, "building")], "video_id string, generation long, state string")
    want = lambda *rows: spark.createDataFrame(list(rows), "video_id string, generation long")
    assert g.current()[0] == 0 and g.activate(want(("v1", 1), ("v2", 1)), states, 0) == 1
    seen = g.current()[1]
    assert g.activate(want(("v1", 2)), states, 1) == 2
    with pytest.raises(commits.Conflict):
        g.activate(want(("v2", 1)), states, 1)
    assert {tuple(r) for r in seen.collect()} == {("v1", 1), ("v2", 1)}  # a reader keeps its version
    assert {tuple(r) for r in g.current()[1].collect()} == {("v1", 2), ("v2", 1)}
    for bad in (want(("v2", 2)), want(("v1", 1), ("v1", 2))):
        with pytest.raises(ValueError, match="not complete"):
            g.activate(bad, states, 2)
    old = commits.Generations(spark, str(tmp_path / "g"))
    old.current = lambda: (1, seen)  # two writers that read the same version
    with pytest.raises(commits.Conflict, match="another writer"):
        old.activate(want(("v1", 1)), states, 1)
    assert g.current()[0] == 2


def test_malformed_lines_are_named_in_files_of_many_parts(spark, tmp_path):
    rows = [json.dumps({"a": i, "b": "x" * (i % 50)}) for i in range(3000)]
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text("\n".join(rows[:1000] + [""] + rows[1000:]) + "\n")
    schema = T.StructType.fromDDL("a long, b string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(good)).rdd.getNumPartitions() > 5
        got = jsonlines.json_lines_checked(spark, str(good), schema)
        assert got.count() == 3000 and got.agg(F.sum("a")).first()[0] == sum(range(3000))
        lines = {(r.line): r.value for r in jsonlines.numbered(spark, str(good)).collect()}
        assert len(lines) == 3001 and lines[1001] == "" and lines[3001] == rows[-1]
        rows[1999], rows[2500] = '{"a": 5', "[1]"
        bad.write_text("\n".join(rows))
        with pytest.raises(ValueError, match=r"bad\.jsonl:2000: .*bad\.jsonl:2501"):
            jsonlines.json_lines_checked(spark, str(tmp_path), schema)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
