"""Seals over many parts: a hash tree whose root is the seal, and whose nodes lead to what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hex digits of a part's hashed path that name its node, from the leaves to the root.
LEVELS = (4, 2, 0)


def tree(parts: DataFrame) -> DataFrame:
    """parts: (seal_id, path, digest) -> nodes (seal_id, level, node, digest, parts); the node of level 0 is the seal.

    A part lies at the hash of its path, so nodes are even, and no task gets more
    than one node's members: 256, or a 65,536th of a seal's parts. A null digest
    counts as a text of its own kind.
    """
    leaf = F.concat(F.length("path").cast("string"), F.lit(":"), F.col("path"), F.lit(":"), F.coalesce("digest", F.lit("-")))
    below = parts.where(F.col("path").isNotNull()).select("seal_id", F.sha2("path", 256).alias("node"), F.sha2(leaf, 256).alias("digest"), F.lit(1).cast("long").alias("parts"))
    out = None
    for digits in LEVELS:
        own = F.substring("node", 1, digits) if digits else F.lit("")
        members = F.array_sort(F.collect_list(F.struct("node", "digest")))
        text = F.array_join(F.transform(members, lambda m: F.concat(m["node"], m["digest"])), "")
        below = below.groupBy("seal_id", own.alias("up_")).agg(F.sha2(text, 256).alias("digest"), F.sum("parts").alias("parts")).withColumnRenamed("up_", "node")
        level = below.select("seal_id", F.lit(digits).alias("level"), "node", "digest", "parts")
        out = level if out is None else out.unionByName(level)
    return out


def seal(parts: DataFrame) -> DataFrame:
    """(seal_id, digest, parts): one seal each; seals of equal parts are equal, in whatever order the parts come."""
    return tree(parts).where("level = 0").select("seal_id", "digest", "parts")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(seal_id, path, change): parts that were added, removed or altered between two states of (seal_id, path, digest).

    Only parts under nodes whose digests differ are compared.
    """
    low = LEVELS[0]
    a, b = (tree(x).where(F.col("level") == low).select("seal_id", "node", F.col("digest").alias(n)) for x, n in ((old, "a_"), (new, "b_")))
    differ = a.join(b, ["seal_id", "node"], "full_outer").where(~F.col("a_").eqNullSafe(F.col("b_"))).select("seal_id", "node")

    def under(parts: DataFrame, name: str) -> DataFrame:
        at = parts.where(F.col("path").isNotNull()).select("seal_id", "path", F.coalesce("digest", F.lit("-")).alias(name), F.substring(F.sha2("path", 256), 1, low).alias("node"))
        return at.join(differ, ["seal_id", "node"], "left_semi").drop("node").groupBy("seal_id", "path").agg(F.array_sort(F.collect_list(name)).alias(name))

    both = under(old, "a_").join(under(new, "b_"), ["seal_id", "path"], "full_outer").where(~F.col("a_").eqNullSafe(F.col("b_")))
    return both.select("seal_id", "path", F.when(F.col("a_").isNull(), "added").when(F.col("b_").isNull(), "removed").otherwise("altered").alias("change"))
