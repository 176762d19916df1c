"""Range joins by a plane sweep: one pass over points and spans in order of time, with the open spans carried along."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import materialize

#: Rows looked at for each border between parts, and pairs that a task holds before it hands them on.
PROBES, PAIRS = 64, 65536


def _events(points: DataFrame, spans: DataFrame, keys: list[str], at: str, t0: str, t1: str) -> DataFrame:
    """Points (kind 1) and spans (kind 0) as one table: key_, at_, tie_, end_, kind_, point_, span_."""
    # A null field is left out of the JSON, so null keys are equal and unlike any other.
    key = F.to_json(F.struct(*keys)).alias("key_")
    p = points.where(F.col(at).isNotNull())
    rest = [c for c in spans.columns if c not in keys]
    end = F.when(F.col(t1) > F.col(t0), F.col(t1).cast("long")).otherwise(F.raise_error(F.lit("an interval ends before it begins")))
    span = F.struct(*rest).alias("span_")
    kind = spans.select(span).schema["span_"].dataType
    a = p.select(key, F.col(at).cast("long").alias("at_"), F.xxhash64(F.to_json(F.struct(*points.columns))).alias("tie_"), F.lit(None).cast("long").alias("end_"), F.lit(1).alias("kind_"), F.struct(*points.columns).alias("point_"), F.lit(None).cast(kind).alias("span_"))
    b = spans.select(key, F.col(t0).cast("long").alias("at_"), F.lit(None).cast("long").alias("tie_"), end.alias("end_"), F.lit(0).alias("kind_"), F.lit(None).cast(a.schema["point_"].dataType).alias("point_"), span)
    return a.unionByName(b)


def borders(events: DataFrame, parts: int) -> list[tuple[str, int, int]]:
    """Where parts after the first begin, as (key_, at_, tie_), so that they hold about as many rows each.

    They come from the PROBES * parts rows of least hash, so at most that many reach
    the driver. Where they lie decides how even the parts are, never what is found.
    """
    tie = F.coalesce("tie_", F.lit(-(1 << 63)))
    probes = events.select("key_", "at_", tie.alias("tie_")).orderBy(F.xxhash64("key_", "at_", "tie_")).limit(PROBES * parts).collect()
    rows = sorted((r["key_"], r["at_"], r["tie_"]) for r in probes)
    return sorted({rows[len(rows) * i // parts] for i in range(1, parts)}) if rows else []


def deal(events: DataFrame, starts: list[tuple[str, int, int]]) -> DataFrame:
    """events with part_: a point goes to one part, a span to its own and to those that begin while it is open."""
    least = -(1 << 63)

    def parts_of(key: pd.Series, at: pd.Series, tie: pd.Series, end: pd.Series) -> pd.Series:
        out = []
        for k, a, t, e in zip(key.tolist(), at.tolist(), tie.tolist(), end.tolist(), strict=True):
            own = bisect_right(starts, (k, a, t))
            out.append(list(range(own, max(bisect_left(starts, (k, e, least)), own) + 1)))
        return pd.Series(out)

    named = F.pandas_udf(parts_of, T.ArrayType(T.IntegerType()))
    # Neither is null: pandas would make doubles of nullable longs, and lose digits. A point ends at once.
    tie, end = F.coalesce("tie_", F.lit(least)), F.coalesce("end_", "at_")
    return events.select("*", F.explode(named("key_", "at_", tie, end)).alias("part_")) if starts else events.withColumn("part_", F.lit(0))


def sweep_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, t0: str, t1: str, parts: int | None = None) -> DataFrame:
    """points within half-open spans of the same keys (null keys are equal): the columns of points, then those of spans but the keys.

    The same rows as intervals.range_join finds, which deals spans to buckets of a
    fixed width. Here parts are even in rows, however time is filled: a span is
    copied only to the parts that begin while it is open, so what is shuffled are
    the rows and these carried spans. One instant of one key may fill several parts.
    A task reads its part once, in order, and keeps the spans that are open. A span
    that doesn't end after its start is an error; points at null are in none.
    """
    spark = points.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = _events(points, spans, keys, at, t0, t1)
    dealt = deal(events, borders(events, n)).drop("tie_")
    ordered = dealt.repartitionById(n, F.col("part_")).sortWithinPartitions("part_", "key_", "at_", "kind_")
    fields = [*points.schema.fields, *[f for f in spans.schema.fields if f.name not in keys]]
    clash = {c for c in points.columns} & {c for c in spans.columns if c not in keys}
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    schema = T.StructType([T.StructField(f"c{i}_", f.dataType) for i, f in enumerate(fields)])
    met = ordered.select("part_", "key_", "at_", "end_", "kind_", "point_", "span_").mapInArrow(_sweep, schema)
    return met.toDF(*[f.name for f in fields])


def sweep_counts(points: DataFrame, spans: DataFrame, keys: list[str], at: str, t0: str, t1: str, parts: int | None = None) -> DataFrame:
    """spans with `points`: how many points of the same keys (null keys are equal) lie within each, as sweep_join would find, without the pairs.

    A count is the points before the end less those before the start. Both are read off
    one running sum over the distinct instants, cut into parts even in instants; what
    a part needs of those before it is a window over one row a part. So work grows
    with the rows. A span that doesn't end after its start is an error.
    """
    n = parts or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = F.when(F.col(t1) > F.col(t0), F.col(t1)).otherwise(F.raise_error(F.lit("an interval ends before it begins")))
    bounds = spans.select(*keys, F.explode(F.array(F.col(t0).cast("long"), end.cast("long"))).alias("at_"), F.lit(0).cast("long").alias("n_"))
    seen = points.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("long").alias("at_"), F.lit(1).cast("long").alias("n_"))
    # The number of the part is written with the rows, as borders of another run may differ.
    instants = bounds.unionByName(seen).groupBy(*keys, "at_").agg(F.sum("n_").alias("n_"))
    times = materialize(instants.repartitionByRange(n, *keys, "at_").withColumn("part_", F.spark_partition_id()), "instants")
    before = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(k).alias(f"{k}_k") for k in keys]
    whole = times.groupBy(*keys, "part_").agg(F.sum("n_").alias("n_"))
    earlier = whole.select(*named, F.col("part_").alias("part__k"), F.coalesce(F.sum("n_").over(before("part_").partitionBy(*keys)), F.lit(0)).alias("earlier_"))
    same = lambda a, b, pairs: reduce(lambda x, y: x & y, [a[x].eqNullSafe(b[y]) for x, y in pairs])
    met = times.join(earlier, same(times, earlier, [(k, f"{k}_k") for k in [*keys, "part_"]])).drop(*[f"{k}_k" for k in [*keys, "part_"]])
    local = F.coalesce(F.sum("n_").over(before("at_").partitionBy(*keys, "part_")), F.lit(0))
    sums = materialize(met.select(*keys, "at_", (F.col("earlier_") + local).alias("sum_")), "running")
    out = spans
    for name, column in (("to_", t1), ("from_", t0)):
        s = sums.select(*named, F.col("at_").alias("at_k"), F.col("sum_").alias(name))
        out = out.join(s, same(out, s, [*[(k, f"{k}_k") for k in keys], (column, "at_k")])).drop(*[f"{k}_k" for k in keys], "at_k")
    return out.withColumn("points", F.col("to_") - F.col("from_")).drop("to_", "from_")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in order of part, key, time and kind -> point and span columns of the pairs."""
    spans, ends, owner = None, np.zeros(0, np.int64), None  # the open spans, all of one part and key
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        kind = batch.column(4).to_numpy()
        at = batch.column(2).to_numpy()
        end = np.where(kind == 0, batch.column(3).fill_null(0).to_numpy(), 0)
        part, key = batch.column(0).to_numpy(), batch.column(1)
        codes = key.dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (codes[1:] != codes[:-1])) + 1).tolist(), n]
        where = np.flatnonzero(kind == 1)  # rows that are points
        before = np.concatenate([[0], np.cumsum(kind == 1)])  # points before each row
        points, own = batch.column(5), batch.column(6)
        for a, b in zip(cuts, cuts[1:], strict=False):
            name = (int(part[a]), key[a].as_py())
            if name != owner:
                spans, ends, owner = None, ends[:0], name
            new = a + np.flatnonzero(kind[a:b] == 0)
            # Each span's points are neighbours: from its own row, or the run's start, up to its end.
            first = before[np.concatenate([np.full(len(ends), a, np.int64), new])]
            stop = np.concatenate([ends, end[new]])
            last = before[a + np.searchsorted(at[a:b], stop, "left")]
            taken = own.take(pa.array(new))
            held = taken if spans is None else pa.concat_arrays([spans, taken])
            yield from _pairs(points, where, held, first, np.maximum(last, first))
            still = np.flatnonzero(stop > at[b - 1])
            spans, ends = held.take(pa.array(still)), stop[still]


def _pairs(points: pa.StructArray, where: np.ndarray, spans: pa.StructArray, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Span i with points first[i] to last[i], at most PAIRS pairs a batch."""
    many = last - first
    done = np.concatenate([[0], np.cumsum(many)])
    for lo in range(0, int(done[-1]), PAIRS):
        pair = np.arange(lo, min(lo + PAIRS, int(done[-1])))
        i = np.searchsorted(done, pair, "right") - 1
        p = points.take(pa.array(where[first[i] + pair - done[i]]))
        s = spans.take(pa.array(i))
        columns = [*p.flatten(), *s.flatten()]
        yield pa.RecordBatch.from_arrays(columns, [f"c{j}_" for j in range(len(columns))])
