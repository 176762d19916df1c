"""SimHash trees on families of codes that share a half."""

import numpy as np
import pytest

from spanlight.llm import simhash

LEAF = 500


def family(rng, n, share, spread):
    """n codes; a share of them have one low half with up to `spread` bits changed."""
    x = rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64).view(np.uint64)
    m = int(n * share)
    low = np.full(m, 0x9E3779B9, dtype=np.uint64)
    for _ in range(spread):
        low ^= np.uint64(1) << rng.integers(0, 32, m).astype(np.uint64)
    x[:m] = (x[:m] >> np.uint64(32) << np.uint64(32)) | low
    return np.unique(x)


def dealt(spark, x, leaf=LEAF):
    frame = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long").repartition(4)
    got = simhash.shards(frame, leaf).toPandas()
    return got, got.groupby("leaf").size().max()


@pytest.mark.parametrize(("share", "spread"), [(0.3, 2), (0.8, 2), (0.55, 0)])
def test_families_make_few_rows_and_no_large_leaf(spark, share, spread):
    rng = np.random.default_rng(3)
    plain, _ = dealt(spark, family(rng, 20_000, 0, 0))
    got, largest = dealt(spark, family(rng, 20_000, share, spread))
    assert len(got) <= 3 * len(plain)
    assert largest <= 4 * LEAF


@pytest.mark.parametrize(("share", "spread"), [(0.8, 2), (0.55, 0), (0.7, 1)])
def test_families_lose_no_link(spark, share, spread):
    rng = np.random.default_rng(4)
    x = family(rng, 3000, share, spread)
    near = x[rng.integers(0, len(x), 1500)]
    for _ in range(3):
        near = near ^ np.where(rng.random(1500) < 0.8, np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64), np.uint64(0))
    x = np.unique(np.concatenate([x, near]))
    got, _ = dealt(spark, x, leaf=40)
    together = np.zeros((len(x), len(x)), dtype=bool)
    for _, fp in got.groupby("leaf")["fp"]:
        at = np.searchsorted(x, fp.to_numpy().view(np.uint64))
        together[np.ix_(at, at)] = True
    for i in range(len(x)):
        linked = np.flatnonzero(np.bitwise_count(x ^ x[i]) <= simhash.RADIUS)
        assert together[i, linked].all()
    links = {(r.u, r.v) for r in simhash.edges(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")).collect()}
    up = {int(v): int(v) for v in x.view(np.int64)}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for u, v in links:
        up[max(root(u), root(v))] = min(root(u), root(v))
    want = simhash.link(x)
    assert len({root(v) for v in up}) == len(set(want.tolist()))


def test_a_shard_of_many_batches_is_linked_whole(spark):
    low = np.uint64(7)
    x = np.unique((np.arange(0, 1 << 13, dtype=np.uint64) << np.uint64(40)) | low)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        links = simhash.edges(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long"))
        assert links.select("u").union(links.select("v")).distinct().count() == len(x)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
