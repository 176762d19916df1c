"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import discard, materialize, new_path, shared_dir  # noqa: F401

#: A word is a run of characters outside this ASCII white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with row_a and row_b, 128 bits that equal rows share and no others; columns of any type."""
    own = [docs[f"`{c.replace('`', '``')}`"] for c in docs.columns]
    nulls = F.concat(*[c.isNull().cast("string") for c in own])
    values = [_hashable(c, f.dataType) for c, f in zip(own, docs.schema, strict=True)]
    return docs.select("*", F.xxhash64(nulls, *values).alias("row_a"), F.xxhash64(*values, nulls, F.lit(42)).alias("row_b"))


def _hashable(value: Column, kind: T.DataType) -> Column:
    """The value itself, or what Spark can hash in its place: maps as sorted entries, variants as JSON, at any depth."""
    if isinstance(kind, T.VariantType):
        return F.to_json(value)
    if isinstance(kind, T.MapType):
        pair = lambda e: F.struct(_hashable(e["key"], kind.keyType).alias("key"), _hashable(e["value"], kind.valueType).alias("value"))
        pairs = F.transform(F.map_entries(value), pair)
        return F.array_sort(pairs, lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _hashable(x, kind.elementType)) if _strange(kind) else value
    if isinstance(kind, T.StructType) and _strange(kind):
        return F.when(value.isNotNull(), F.struct(*[_hashable(value.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind)]))
    return value


def _strange(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: A key of more than this part of a join's rows is joined by broadcast; so there are fewer such keys than this.
HEAVY = 1000


def attach(rows: DataFrame, key: str | list[str], values: DataFrame, n: int) -> DataFrame:
    """rows joined with values on key; values: one row a key, deg is how often rows hold it, at most n rows in all.

    Keys with more than n / HEAVY rows meet theirs by broadcast: there are fewer
    than HEAVY of them, whatever n is. The others meet by shuffle, so no task gets
    more than that share of the rows for one key.
    """
    heavy = values.where(F.col("deg") > n / HEAVY).drop("deg")
    light = values.where(F.col("deg") <= n / HEAVY).drop("deg")
    few = rows.join(F.broadcast(heavy), key)
    many = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return few.unionByName(many)
