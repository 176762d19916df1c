"""The reducer against brute force, and that no row it keeps is dead."""

import random
from itertools import product

import pytest

from spanlight.operators import pattern, reducer

SCOPE = ["v"]


def _relations(spark, rng, shape, size, values):
    """One relation a key of shape: rows (v, *variables)."""
    rows = {n: sorted({(rng.choice("xy"), *(rng.randrange(values) for _ in own)) for _ in range(size)}) for n, own in shape.items()}
    frames = {n: spark.createDataFrame(rows[n], "v string, " + ", ".join(f"{c} int" for c in sorted(own))) for n, own in shape.items()}
    return rows, frames


def brute(rows, shape):
    names = sorted(set().union(*shape.values()))
    out = set()
    for choice in product(*rows.values()):
        bound, ok = {"v": choice[0][0]}, True
        for (_, own), row in zip(shape.items(), choice, strict=True):
            for c, x in zip(["v", *sorted(own)], row, strict=True):
                ok = ok and bound.setdefault(c, x) == x
        if ok:
            out.add((bound["v"], *(bound[c] for c in names)))
    return sorted(out)


#: A node id fixes its scope in patterns, so here values do: x and y don't share any.
def _scoped(rows):
    return {n: [(r[0], *(c * 2 + (r[0] == "y") for c in r[1:])) for r in rs] for n, rs in rows.items()}


SHAPES = {
    "path": {"ab": {"a", "b"}, "bc": {"b", "c"}, "cd": {"c", "d"}},
    "star": {"ab": {"a", "b"}, "ac": {"a", "c"}, "d": {"d"}},
    "apart": {"ab": {"a", "b"}, "cd": {"c", "d"}},
    "triangle": {"ab": {"a", "b"}, "bc": {"b", "c"}, "ac": {"a", "c"}},
}


@pytest.mark.parametrize("shape", SHAPES)
def test_all_results(spark, shape):
    rng, own = random.Random(3), SHAPES[shape]
    rows, _ = _relations(spark, rng, own, 14, 6)
    rows = _scoped(rows)
    frames = {n: spark.createDataFrame(r, "v string, " + ", ".join(f"{c} int" for c in sorted(own[n]))) for n, r in rows.items()}
    names = ["v", *sorted(set().union(*own.values()))]
    got = reducer.join_all(frames, own, SCOPE).select(*names)
    assert sorted(map(tuple, got.collect())) == brute(rows, own)


def test_no_dead_rows(spark):
    """A path of which most edges lead nowhere: every row kept is part of a result, and each join makes rows of results only."""
    own = SHAPES["path"]
    rows = {"ab": [("x", i, i % 50) for i in range(400)], "bc": [("x", b, c) for b in range(50) for c in range(40)], "cd": [("x", c, d) for c in range(38, 60) for d in range(3)]}
    frames = {n: spark.createDataFrame(r, "v string, " + ", ".join(f"{c} int" for c in sorted(own[n]))) for n, r in rows.items()}
    reduced, tree, root = reducer.full_reduce(frames, own, SCOPE)
    result = reducer.join_all(frames, own, SCOPE)
    total = result.count()
    for n, f in reduced.items():
        assert sorted(map(tuple, f.collect())) == sorted(map(tuple, result.select("v", *sorted(own[n])).distinct().collect()))
    assert len(tree) == 2 and {root, *(e for e, _ in tree)} == set(own)
    sizes = []
    reducer.join_all(frames, own, SCOPE, lambda rows, have: sizes.append(rows.count()) or rows)
    assert max(sizes) <= total + sum(f.count() for f in frames.values()) and total < 50 * 40 * 22
    assert sorted(sizes) == sizes  # from the root on, each join only adds to what stays


def test_ears():
    assert reducer.ears(SHAPES["triangle"]) is None and reducer.ears(SHAPES["path"]) is not None
    assert reducer.forest(SHAPES["triangle"]) == ({"ab": {"a", "b"}, "bc": {"b", "c"}}, ["ac"])
    assert reducer.ears({"abc": {"a", "b", "c"}, "ab": {"a", "b"}, "bc": {"b", "c"}, "ac": {"a", "c"}}) is not None


def test_a_cyclic_pattern_against_loops(spark):
    rng = random.Random(8)
    nodes = [(f"n{i}", rng.choice(["v", "w"]), None, rng.randrange(100), 0) for i in range(24)]
    edges = sorted({(f"n{rng.randrange(24)}", rng.choice(["near", "carries"]), f"n{rng.randrange(24)}") for _ in range(260)})
    n = spark.createDataFrame([(i, v, c, t, t + 5, "detection", "thing", None) for i, v, c, t, _ in nodes], "node string, video_id string, camera_id string, t0 long, t1 long, node_type string, labels string, tracklet_id string")
    e = spark.createDataFrame(edges, "subject string, predicate string, object string")
    var = lambda x: pattern.Variable(x, "thing", ("detection",))
    p = pattern.Pattern((var("a"), var("b"), var("c")), (pattern.Edge("a", "near", "b"), pattern.Edge("b", "near", "c"), pattern.Edge("c", "carries", "a")), (pattern.Order("a", "c", 40),))
    got = sorted((r.a.node, r.b.node, r.c.node) for r in pattern.bindings(n, e, p).collect())
    at, has = {x[0]: x for x in nodes}, set(edges)
    want = sorted((a, b, c) for a, b, c in product(at, repeat=3) if at[a][1] == at[b][1] == at[c][1] and {(a, "near", b), (b, "near", c), (c, "carries", a)} <= has and 0 <= at[c][3] - at[a][3] - 5 <= 40)
    assert got == want and want
