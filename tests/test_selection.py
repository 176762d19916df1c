"""Ranks and percentiles against Spark's own, which hold a group in one task."""

import math
import random

from pyspark.sql import functions as F

from spanlight.operators import evaluate, selection


def test_percentiles_equal_sparks(spark):
    rng = random.Random(1)
    odd = [0.0, -0.0, math.inf, -math.inf, math.nan, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, 1.0, 1.0, None]
    rows = [(g, rng.choice(odd) if rng.random() < 0.3 else rng.gauss(0, 10 ** rng.randint(-3, 6))) for g in ("a", "b", None) for _ in range(rng.randint(40, 300))]
    rows += [("one", 4.5), ("two", -1.0), ("two", 3.0), ("ties", 2.0), ("ties", 2.0), ("ties", 7.0), ("none", None), *(("inf", x) for x in (-math.inf, math.inf))]
    df = spark.createDataFrame(rows, "g string, x double")
    ps = [0.0, 0.25, 0.5, 0.9, 0.95, 1.0]
    got = selection.percentiles(df, ["g"], "x", {f"c{i}": p for i, p in enumerate(ps)}, {f"d{i}": p for i, p in enumerate(ps)})
    want = df.where("x IS NOT NULL").groupBy("g").agg(*[F.expr(f"percentile(x, {p})").alias(f"c{i}") for i, p in enumerate(ps)], *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY x)").alias(f"d{i}") for i, p in enumerate(ps)])
    plain = lambda df: sorted((str(r.g), *(repr(x + 0.0) for x in r[1:])) for r in df.collect())
    assert plain(got) == plain(want)
    assert selection.percentiles(df.limit(0), ["g"], "x", {"c": 0.5}, {}).count() == 0


def test_one_large_group_in_bounded_memory(spark):
    """A group of distinct values: no task of a pass puts out more counts than digits, whatever the group's size."""
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("g"), (F.pmod(F.col("id") * 7919, F.lit(n)) / 7 - 1000).alias("x"))
    r = selection.percentiles(df, ["g"], "x", {"c": 0.5}, {"d": 0.95}).first()
    at = lambda k: k / 7 - 1000
    assert (r.c, r.d) == (0.5 * at(n // 2 - 1) + 0.5 * at(n // 2), at(math.ceil(0.95 * n) - 1))
    bits = df.select(F.shiftright(selection.order_bits("x"), 48).alias("d")).distinct().count()
    assert bits < 1 << selection.DIGIT


def test_order_is_kept(spark):
    xs = [-math.inf, -1.5e300, -1.0, -5e-324, 0.0, 5e-324, 1e-9, 1.0, 1.0000000000000002, math.inf, math.nan]
    bits = [r[0] for r in spark.createDataFrame(list(enumerate(xs)), "i int, x double").orderBy("i").select(selection.order_bits("x")).collect()]
    assert bits == sorted(set(bits))
    back = [r[0] for r in spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "i int, b long").orderBy("i").select(selection.from_order_bits(F.col("b"))).collect()]
    assert [repr(x) for x in back] == [repr(x) for x in xs]


def test_latency_keeps_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, None)], "k string, v double")
    assert sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in evaluate.latency(df, ["k"], "v").collect()), key=str) == [("a", 2.0, 2.9, 3.0, 2.0, 2), (None, None, None, None, None, 1)]
