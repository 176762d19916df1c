"""Best overlaps and scores of configurations against plain loops, with repeated spans, repeated and null ids."""

import random

import pytest

from spanlight.operators import evaluate

ROW = "id long, q string, t0 long, t1 long"


def _rows(r, n, ids):
    return [(r.choice([*range(ids), None]), r.choice(["a", "b", None]), t, t + r.choice([3, 5, 40])) for t in (r.randrange(60) for _ in range(n))]


def _iou(x, y):
    both = min(x[3], y[3]) - max(x[2], y[2])
    return both / (x[3] - x[2] + y[3] - y[2] - both) if x[1] == y[1] and both > 0 else 0.0


@pytest.mark.parametrize("ids", [5, 1000])
def test_best_overlaps_are_those_of_plain_loops(spark, ids):
    r = random.Random(ids)
    truth, found = _rows(r, 60, ids), _rows(r, 40, ids)
    got = evaluate.best_overlap(spark.createDataFrame(truth, ROW), spark.createDataFrame(found, ROW), ["q"], 7)
    assert got.columns == ["id", "q", "t0", "t1", "best"]
    best = lambda x: max((_iou(y, z) for y in truth if x[0] is not None and y[0] == x[0] for z in found), default=0.0)
    want = sorted((str(x), round(best(x), 9)) for x in truth)
    assert sorted((str(tuple(x)[:4]), round(x.best, 9)) for x in got.collect()) == want and sum(b > 0 for _, b in want) > 20


def test_configurations_are_scored_as_by_plain_loops(spark):
    r = random.Random(4)
    truth, found = [x for x in _rows(r, 60, 40) if x[0] is not None], _rows(r, 40, 40)
    bundles = [(c, *x) for x in found for c in ("x", "y") if r.random() < 0.2]
    got = evaluate.score_configs(spark.createDataFrame(truth, ROW), spark.createDataFrame(bundles, f"config string, {ROW}"), ["x", "y", "none"], "q", 7, 0.1)
    hit = {(c, x[0]) for c, *y in bundles for x in truth if _iou(x, y) > 0.1}
    want = {}
    for c in ("x", "y", "none"):
        whole = [all((c, x[0]) in hit for x in truth if x[1] == q) for q in ("a", "b", None)]
        n = sum((c, x[0]) in hit for x in truth)
        want[c] = (n, len(truth), round(n / len(truth), 9), round(sum(whole) / 3, 9))
    assert {x.config: (x.hits, x.truths, round(x.interval_recall, 9), round(x.complete_set, 9)) for x in got.collect()} == want
    assert want["x"][0] > 5 and want["none"] == (0, len(truth), 0.0, 0.0)


def test_equal_spans_are_paired_once(spark, monkeypatch):
    """400 rows of two spans make four pairs at most (round 4: complete_set_recall and config_scores paired all rows)."""
    made, join = [], evaluate.overlap_join
    monkeypatch.setattr(evaluate, "overlap_join", lambda *a: made.append(join(*a).count()) or join(*a))
    rows = spark.createDataFrame([(i, "a", i % 2, 10) for i in range(400)], ROW)
    assert evaluate.best_overlap(rows, rows, ["q"], 7).where("best = 1").count() == 400
    configs = rows.selectExpr("'x' AS config", "*")
    assert evaluate.score_configs(rows, configs, ["x"], "q", 7).first().hits == 400
    assert made == [4, 4]


def _greedy(truth, found, threshold):
    pairs = sorted((-_iou(x, y), x[0], y[0], str(x[1])) for x in truth for y in found if x[0] is not None and y[0] is not None and _iou(x, y) >= threshold and _iou(x, y) > 0)
    gone, out = set(), []
    for v, g, p, q in pairs:
        if ("g", q, g) not in gone and ("p", q, p) not in gone:
            gone |= {("g", q, g), ("p", q, p)}
            out.append((q, g, p, round(-v, 9)))
    return sorted(out)


@pytest.mark.parametrize(("seed", "ids", "threshold", "width"), [(1, None, 0.5, 3), (2, None, 0.0, 1), (3, None, 0.2, 200), (4, 30, 0.3, 7)])
def test_matches_are_those_of_a_plain_loop(spark, seed, ids, threshold, width):
    """Unique ids and, last, repeated and null ones; blocks shorter than a span, and one for all."""
    r = random.Random(seed)
    truth, found = ([(i if ids is None else x[0], *x[1:]) for i, x in zip(r.sample(range(500), 150), _rows(r, 150, ids or 1), strict=True)] for _ in range(2))
    got = evaluate.greedy_match(spark.createDataFrame(truth, ROW), spark.createDataFrame(found, ROW), "q", width, threshold).collect()
    assert sorted((str(x.q), x.gt, x.pred, round(x.iou, 9)) for x in got) == _greedy(truth, found, threshold) and len(got) > 10


def test_equal_spans_take_few_rounds(spark, monkeypatch):
    """300 rows of one span are matched at once (round 4: greedy_match took a round for each)."""
    written, write = [], evaluate.materialize
    monkeypatch.setattr(evaluate, "materialize", lambda df, name: written.append(name) or write(df, name))
    rows = spark.createDataFrame([(i, "a", 1, 10) for i in range(300)], ROW)
    got = evaluate.greedy_match(rows, rows, "q", 50)
    assert got.where("gt = pred").count() == 300 and len(written) <= 2
