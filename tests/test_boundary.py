"""Injected models that fail, and a store that two writers fill."""

import json

import numpy as np

from spanlight.operators import boundary as b


def fake_encoder():
    """A local function goes to the workers by value; they can't import this file."""

    def encoder(payloads):
        if any(p < 0 for p in payloads):
            raise ValueError("poisoned")
        return np.array([[3.0 * p, 4.0 * p] for p in payloads])

    return encoder


def test_a_poisoned_row_costs_one_row(spark):
    rows = [(i, float(i)) for i in range(1, 500)] + [(1000, -1.0), (1001, None), (1002, 0.0)]
    got = {r.id: (r.vector, r.error) for r in b.encode(spark.createDataFrame(rows, "id long, payload double").coalesce(2), fake_encoder()).collect()}
    assert len(got) == 502 and all(np.allclose(got[i][0], [0.6, 0.8]) and got[i][1] is None for i in range(1, 500))
    assert got[1000] == (None, "ValueError: poisoned") and got[1001] == (None, "null_payload") and got[1002] == (None, "no_direction")
    wrong = b.encode(spark.createDataFrame(rows[:3], "id long, payload double"), lambda p: np.zeros((1, 2, 3))).collect()
    assert all("gave" in r.error for r in wrong)


def test_data_and_manifest_are_committed_together(spark, tmp_path):
    at = str(tmp_path / "c")
    df = spark.range(100).selectExpr("id", "id * 2 AS x")
    assert b.commit(df, at, "0001") and not b.commit(df, at, "0001")
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["0001"]
    assert b.torn(spark, at, ["0001"]) == []
    victim = next((tmp_path / "c" / "0001" / "data").glob("part-*"))
    victim.unlink()
    assert b.torn(spark, at, ["0001"]) == ["0001"]


def test_first_writer_wins_and_conflicts_are_reported(spark, tmp_path):
    s = b.AnswerStore(spark, str(tmp_path / "store"))
    put = lambda rows: sorted(map(tuple, s.put(spark.createDataFrame(rows, "digest string, answer string")).collect()))
    assert s.answers() is None
    assert put([("a", "1"), ("b", "2"), ("n", None)]) == []
    assert put([("a", "9"), ("c", "3"), ("b", "2")]) == [("a", "1", "9")]
    assert put([("d", "5"), ("d", "4")]) == [("d", "4", "5")]  # within a put: the least
    assert dict(s.answers().collect()) == {"a": "1", "b": "2", "c": "3", "d": "4"}


def test_two_writers_take_different_commits(spark, tmp_path, monkeypatch):
    """Another writer commits between a writer's look and its rename: the second one looks again and doesn't overwrite."""
    s, other = (b.AnswerStore(spark, str(tmp_path / "store")) for _ in range(2))
    rows = lambda x: spark.createDataFrame(x, "digest string, answer string")
    real, done = b.commit, []

    def commit(df, path, name):
        if not done:
            done.append(1)
            other.put(rows([("a", "theirs")]))
        return real(df, path, name)

    monkeypatch.setattr(b, "commit", commit)
    conflicts = s.put(rows([("a", "mine"), ("z", "mine")])).collect()
    assert [tuple(r) for r in conflicts] == [("a", "theirs", "mine")]
    assert dict(s.answers().collect()) == {"a": "theirs", "z": "mine"} and s.commits() == ["00000000", "00000001"]


def fake_verifier():
    def valid(answer):
        return answer.startswith("{") and "state" in json.loads(answer)

    def call(prompt, frames, wrong):
        if prompt == "down" or (prompt == "shaky" and wrong is None):
            raise RuntimeError("no model")
        if prompt == "never" or (prompt == "sloppy" and wrong is None):
            return "no json"
        return json.dumps({"state": "supported", "frames": len(frames)})

    return call, valid


def test_calls_retry_recover_and_are_not_made_twice(spark, tmp_path):
    good = list(range(8))
    rows = [("d1", "fine", good), ("d2", "shaky", good), ("d3", "sloppy", good), ("d4", "down", good), ("d5", "never", good), ("d6", "fine", good[:7]), ("d7", "fine", [*good[:6], 5, 9]), ("d8", "fine", list(range(25))), ("d9", None, good), ("d1", "fine", good)]
    df = spark.createDataFrame(rows, "digest string, prompt string, frames array<long>")
    s = b.AnswerStore(spark, str(tmp_path / "store"))
    call, valid = fake_verifier()
    first = {r.digest: (r.outcome, r.calls) for r in b.verify_cached(df, s, call, valid).collect()}
    assert first == {"d1": ("answered", 1), "d2": ("answered", 2), "d3": ("answered", 2), "d4": ("system_failure", 2), "d5": ("invalid_answer", 2), **{d: ("invalid_request", 0) for d in ("d6", "d7", "d8", "d9")}}

    def none(prompt, frames, wrong):
        raise AssertionError("called again")

    answered = df.where("digest IN ('d1', 'd2', 'd3')")
    again = b.verify_cached(answered, s, none, valid).collect()
    assert {(r.outcome, r.calls) for r in again} == {("stored", 0)} and len(again) == 3


def test_request_digests_keep_parts_apart(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc")], "x string, y string")
    assert df.select(b.request_digest(F.col("x"), F.col("y"))).distinct().count() == 4
