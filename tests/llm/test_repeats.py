import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from spanlight.llm import repeats


def brute(rows):
    """Result of each (doc_id, text) row by the rule itself: all windows in a dictionary."""
    code = {t: i for i, t in enumerate(sorted({r[1] or "" for r in rows}))}
    order = sorted({(r[0] is None, r[0] or 0, code[r[1] or ""], r[1] or "") for r in rows})
    seen, out = set(), {}
    for late, id_, _, text in order:
        b = text.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - repeats.DEPTH + 1):
            w = b[s : s + repeats.DEPTH]
            if w in seen:
                gone[s : s + repeats.DEPTH] = b"\1" * repeats.DEPTH
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[None if late else id_, text] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((r[0] is None, r[0] or 0, *out[r[0], r[1] or ""]) for r in rows))


def result(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def planted(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(rng.randint(14, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        text = " ".join([" ".join(word() for _ in range(rng.randint(0, 40))), *rng.sample(passages, rng.randint(0, 2)), word(), rng.choice(passages)[rng.randint(0, 40) :]])
        rows.append((i, text, "x"))
    rows += [(n + i, rows[3][1], "x") for i in range(20)]  # exact copies
    rows += [(200 + i, rows[5][1][: 50 + i] + "Q" + rows[5][1][50 + i :], "x") for i in range(20)]  # near copies
    rows += [(300, "a" * 500, "x"), (301, "ab" * 300, "x"), (302, "a" * 99, "x"), (303, "a" * 100, "x"), (304, "", "x"), (305, None, "x")]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, tie string"


@pytest.mark.parametrize("batch", [10_000, 7])
def test_whole_result_against_all_windows(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = planted(batch)
        assert result(repeats.strip(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_first_digits_give_the_same(spark, monkeypatch):
    """Every first digit hot: runs are dealt out over tasks, and their windows are shuffled."""
    rows = planted(3)
    df = spark.createDataFrame(rows, SCHEMA)
    codes = {r[0] >> 16 for r in repeats.first_digits(repeats.documents(df)).select("digit").collect()}
    monkeypatch.setattr(repeats, "hot_digits", lambda docs: set(list(codes)[::2]))
    assert result(repeats.strip(df)) == brute(rows)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(1, t, "a"), (1, t, "b"), (2, t[3:], None), (None, t + "!", ""), (None, t + "!", ""), (3, "x" + t, "")]
    assert result(repeats.strip(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    # Texts of one id: the order among them is a hash's, so only the sum is fixed.
    got = repeats.strip(spark.createDataFrame([(7, t, ""), (7, t + "?", ""), (None, t, "")], SCHEMA)).collect()
    assert sum(r.n_removed for r in got) == 2 * len(t) and len(got) == 3
    assert repeats.strip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text_in_many_blocks(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(90_000))
    text = text[:40_000] + text[1_000:3_000] + text[40_000:]
    rows = [(1, text, ""), (2, text[33_000:50_000] + "zz", "")]
    assert result(repeats.strip(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_sync_positions_depend_on_the_window_alone():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 101, 70_000, dtype=np.uint8)
    place, code = repeats.sync_positions(data)
    for s in [0, 5, 32_767, 32_768, 40_000, len(data) - repeats.DEPTH]:
        alone, own = repeats.sync_positions(data[s : s + repeats.DEPTH])
        assert (alone[0], own[0]) == (place[s] - s, code[s])
        h = repeats.gram_hashes(data[s : s + repeats.DEPTH]) >> np.uint64(16)
        assert alone[0] == int(np.argmin(h)) and own[0] == h.min()


def test_first_digits_hold_few_texts_at_once():
    """8 MB of texts in one batch, at under 30 MB (243 before)."""
    import tracemalloc

    class Docs:
        def mapInArrow(self, run, schema):
            return run

    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 123, 2000, dtype=np.uint8).tobytes() for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array([0] * 4000), pa.array(texts)], ["id", "tie", "text"])
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in repeats.first_digits(Docs())(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n > 100_000 and peak < 30e6


def test_hot_windows_are_sorted_not_joined(spark, monkeypatch):
    """Every first digit hot, few windows a batch: no join of windows with their groups, and fewer are shuffled than there are where copies are many."""
    rows = planted(5) + [(1000 + i, "the same passage of words again and again " * 4, "x") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    codes = {r[0] >> 16 for r in repeats.first_digits(repeats.documents(df)).select("digit").collect()}
    monkeypatch.setattr(repeats, "hot_digits", lambda docs: codes)
    kept, write = {}, repeats.materialize
    monkeypatch.setattr(repeats, "materialize", lambda df, label: kept.setdefault(label, write(df, label)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        own = repeats.documents(df)
        plan = repeats.repeats(own)._jdf.queryExecution().analyzed().toString()
        assert "Join" not in plan
        seen = kept["repeats-windows"]
        assert seen.where("wa IS NULL").count() > 0
        most = seen.where("wa IS NOT NULL").groupBy("wa", "wb").count().agg({"count": "max"}).first()[0]
        assert most <= repeats.SPLIT
        kept.clear()
        assert result(repeats.strip(df)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_copies_leave_one_run_each(spark, monkeypatch):
    """300 copies, every first digit hot: each of their windows is sorted again once, not once a task that they were dealt to."""
    rng = random.Random(11)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    rows = [(i, text, "x") for i in range(300)] + [(None, text, "x"), (400, "Q" + text, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    codes = {r[0] >> 16 for r in repeats.first_digits(repeats.documents(df)).select("digit").collect()}
    monkeypatch.setattr(repeats, "hot_digits", lambda docs: codes)
    kept, write = {}, repeats.materialize
    monkeypatch.setattr(repeats, "materialize", lambda df, label: kept.setdefault(label, write(df, label)))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(repeats.strip(df)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    firsts = kept["repeats-windows"].where("wa IS NOT NULL")
    assert firsts.count() <= 2 * (len(text) + 2 - repeats.DEPTH), firsts.count()
