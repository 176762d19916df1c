"""Exact ranks and percentiles of groups of any size, by radix histograms.

A double becomes a long of the same order. Four passes each fix 16 more bits of
every wanted rank: count the next digit of the rows that agree so far, and take
the digit in which the rank falls. A pass counts in partial aggregates, so a group
is never in one task; at most 65,536 counts of a group and prefix are ordered.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import materialize

DIGIT, PASSES = 16, 4
NAN_BITS = np.int64(0x7FF8000000000000)
#: Wanted prefixes up to which they reach the rows by broadcast.
FEW = 1 << 16


@F.pandas_udf(T.LongType())
def order_bits(values: pd.Series) -> pd.Series:
    """Longs in the order of the doubles: NaN is the greatest, both zeros are equal."""
    x = values.to_numpy(dtype=np.float64) + 0.0
    bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
    bits = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
    return pd.Series(np.where(np.isnan(x), NAN_BITS, bits))


@F.pandas_udf(T.DoubleType())
def _numbers(bits: pd.Series) -> pd.Series:
    b = bits.to_numpy(dtype=np.int64)
    return pd.Series(np.where(b < 0, b ^ np.int64(0x7FFFFFFFFFFFFFFF), b).view(np.float64))


def from_order_bits(bits: Column) -> Column:
    """The doubles again. pandas would turn NaN into null."""
    return F.when(bits == int(NAN_BITS), F.lit(float("nan"))).otherwise(_numbers(bits))


def _on(left: list[str], suffix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}{suffix}")) for k in left], F.lit(True))


def select_ranks(df: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """keys, n_ (values that aren't null), rank_ and value_: the values at ranks(n), from 0, of each group with a value. Null keys are a group."""
    # A pandas function gets no nulls here, so it can't mistake them for NaN.
    rows = materialize(df.where(F.col(value).isNotNull()).select(*keys, order_bits(F.col(value).cast("double")).alias("bits_")), "ranks")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n_"))
    wanted = F.array_distinct(F.array(*[r.cast("long") for r in ranks(F.col("n_"))]))
    found = sizes.select(*keys, "n_", F.explode(wanted).alias("rank_")).withColumn("left_", F.col("rank_")).withColumn("prefix_", F.lit(0).cast("long"))
    found = materialize(found, "ranks-wanted")
    for level in range(PASSES):
        shift = 64 - DIGIT * (level + 1)
        above = F.shiftright("bits_", shift + DIGIT) if level else F.lit(0).cast("long")
        # The first digit is signed, as the longs are.
        digit = F.shiftright("bits_", shift) if not level else F.shiftright("bits_", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        mine = rows.select(*keys, above.alias("prefix_"), digit.alias("digit_"))
        if level:
            open_ = found.select(*[F.col(k).alias(f"{k}_w") for k in [*keys, "prefix_"]]).distinct()
            open_ = F.broadcast(open_) if found.count() <= FEW else open_
            mine = mine.join(open_, _on([*keys, "prefix_"], "_w"), "left_semi")
        counts = mine.groupBy(*keys, "prefix_", "digit_").agg(F.count("*").alias("c_"))
        upto = F.sum("c_").over(Window.partitionBy(*keys, "prefix_").orderBy("digit_"))
        counts = counts.select(*[F.col(k).alias(f"{k}_c") for k in [*keys, "prefix_"]], "digit_", "c_", (upto - F.col("c_")).alias("before_"))
        hit = found.join(counts, _on([*keys, "prefix_"], "_c") & (F.col("before_") <= F.col("left_")) & (F.col("left_") < F.col("before_") + F.col("c_")))
        prefix = F.shiftleft("prefix_", DIGIT).bitwiseOR(F.col("digit_")) if level else F.col("digit_")
        found = materialize(hit.select(*keys, "n_", "rank_", (F.col("left_") - F.col("before_")).alias("left_"), prefix.alias("prefix_")), "ranks-found")
    return found.select(*keys, "n_", "rank_", from_order_bits(F.col("prefix_")).alias("value_"))


def percentiles(df: DataFrame, keys: list[str], value: str, between: dict[str, float], at: dict[str, float]) -> DataFrame:
    """keys and a column for each name: percentiles interpolated between ranks, and those at a rank (the least value that a part of at least p doesn't exceed).

    The same as percentile and percentile_disc, for groups of any size. Nulls don't
    count; a group without values has no row; NaN is greater than all numbers.
    """
    low = {c: lambda n, p=p: F.floor((n - 1) * F.lit(p)) for c, p in between.items()}
    high = {c: lambda n, p=p: F.ceil((n - 1) * F.lit(p)) for c, p in between.items()}
    rank = {c: lambda n, p=p: F.greatest(F.ceil(n * F.lit(p)) - 1, F.lit(0)) for c, p in at.items()}
    found = select_ranks(df, keys, value, lambda n: [f(n) for d in (low, high, rank) for f in d.values()])
    by_rank = found.groupBy(*keys, "n_").agg(F.map_from_entries(F.collect_list(F.struct("rank_", "value_"))).alias("v_"))
    n = F.col("n_")
    get = lambda r: F.element_at("v_", r.cast("long"))

    def mixed(c: str, p: float) -> Column:
        a, b, where = low[c](n), high[c](n), (n - 1) * F.lit(p)
        return F.when(a == b, get(a)).when(get(a) == get(b), get(a)).otherwise((b - where) * get(a) + (where - a) * get(b))

    return by_rank.select(*keys, *[mixed(c, p).alias(c) for c, p in between.items()], *[get(rank[c](n)).alias(c) for c in at])
