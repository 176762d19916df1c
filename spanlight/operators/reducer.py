"""Joins of many relations without dead rows: a join tree by ear removal, semi-joins up and down it, then joins from its root.

After both passes each row of each relation is part of a result, so no join on the
way from the root makes more rows than its inputs and the result hold. A relation
is a frame whose variables are columns; relations meet on the variables they
share, and on `scope` columns (null-safe) where they share none.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize


def ears(relations: Mapping[str, set[str]]) -> tuple[list[tuple[str, str]], str] | None:
    """(ear, the relation that holds all that the ear shares with others) in order of removal, and the root; None if the relations are cyclic."""
    left, tree = dict(relations), []
    while len(left) > 1:
        for name, own in left.items():
            others = {m: v for m, v in left.items() if m != name}
            shared = own & set().union(*others.values())
            holder = next((m for m, v in others.items() if shared <= v), None)
            if holder is not None:
                tree.append((name, holder))
                del left[name]
                break
        else:
            return None
    return tree, next(iter(left))


def forest(relations: Mapping[str, set[str]]) -> tuple[dict[str, set[str]], list[str]]:
    """An acyclic part of the relations, as large as taking them in turn makes it, and the names of the others: those that close a cycle."""
    kept: dict[str, set[str]] = {}
    closing = []
    for name, own in relations.items():
        if ears(kept | {name: own}) is None:
            closing.append(name)
        else:
            kept[name] = own
    return kept, closing


def _met(a: DataFrame, b: DataFrame, shared: list[str], scope: list[str], how: str) -> DataFrame:
    """a joined with b; their common columns come from a."""
    keys = shared or scope
    right = b.select(*[F.col(k).alias(f"{k}_r") for k in keys], *[c for c in b.columns if how != "left_semi" and c not in {*keys, *scope}])
    same = lambda k: F.col(k).eqNullSafe(F.col(f"{k}_r")) if k in scope else F.col(k) == F.col(f"{k}_r")
    on: Column = reduce(lambda x, y: x & y, map(same, keys))
    if how == "left_semi":
        return a.join(right.distinct(), on, how)
    return a.join(right, on, how).drop(*[f"{k}_r" for k in keys])


def full_reduce(frames: dict[str, DataFrame], relations: Mapping[str, set[str]], scope: list[str]) -> tuple[dict[str, DataFrame], list[tuple[str, str]], str]:
    """The frames without rows that no result has, and their join tree. relations must be acyclic."""
    found = ears(relations)
    if found is None:
        raise ValueError("these relations have a cycle")
    tree, root = found
    out = dict(frames)
    for ear, holder in tree:
        out[holder] = materialize(_met(out[holder], out[ear], sorted(relations[ear] & relations[holder]), scope, "left_semi"), "reduced")
    for ear, holder in reversed(tree):
        out[ear] = materialize(_met(out[ear], out[holder], sorted(relations[ear] & relations[holder]), scope, "left_semi"), "reduced")
    return out, tree, root


def join_all(frames: dict[str, DataFrame], relations: Mapping[str, set[str]], scope: list[str], bound=None) -> DataFrame:
    """All rows that agree in their variables. bound(rows, variables) is called once more variables are bound, and may filter.

    Relations that close a cycle cut both ends' relations down first, and are met
    as soon as all of their variables are bound.
    """
    kept, closing = forest(relations)
    frames = dict(frames)
    for name in closing:
        for other, own in kept.items():
            if shared := sorted(own & relations[name]):
                frames[other] = _met(frames[other], frames[name], shared, scope, "left_semi")
    reduced, tree, root = full_reduce({n: frames[n] for n in kept}, kept, scope)
    out, have, open_ = reduced[root], set(kept[root]), list(closing)

    def settled(rows: DataFrame) -> DataFrame:
        for name in [n for n in open_ if relations[n] <= have]:
            rows = _met(rows, frames[name], sorted(relations[name]), scope, "left_semi")
            open_.remove(name)
        return bound(rows, have) if bound else rows

    out = settled(out)
    for ear, _ in reversed(tree):
        out = _met(out, reduced[ear], sorted(kept[ear] & have), scope, "inner")
        have |= kept[ear]
        out = settled(out)
    return out
