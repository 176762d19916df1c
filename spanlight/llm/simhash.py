"""SimHash near-duplicates by vantage-point trees.

Random 64-bit fingerprints lie 32 +- 4 bits from any vantage point: with a radius
of 3 bits a median split would send 57 % of them to both sides. So the forest has
a tree for each 32-bit half. Two fingerprints at most 3 bits apart are at most one
bit apart on one half at least, and at radius 1 only those whose distance is
exactly the cut lie on a boundary, about 14 %.

Each node of a tree has a vantage point and a cut of its own. By the triangle
bound two codes one bit apart are at distances that differ by one at most; so both
are inside, or both outside, or one is at the cut, and that one goes to both sides.
Every link is thus within a leaf. Where no vantage point splits a node cheaply, as
among codes that share the half, its codes are dealt by the other half instead: at
most 3 of its bits differ, so one of its four bytes is equal in both. The leaves are
the shards; within one, a vantage-point tree on all 64 bits finds the pairs.

Vantage points and cuts are chosen on a sample of fingerprints, a fixed share of
them and 2^18 at most. It decides how even the leaves are, never which links are
found: every fingerprint goes down both trees, and any cut keeps all links.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, discard, materialize, table

#: Fixed values of the fingerprint.
SHINGLE, SEED, RADIUS = 3, 42, 3
HALF = 32
#: Fingerprints that a leaf should have at most, by estimate; leaves of a tree, which is sent to all tasks (0.2 MB at most).
LEAF, MAX_LEAVES = 2000, 1 << 13
#: Fingerprints of a leaf in the sample that the trees are grown on; bound of the sample.
SAMPLED, MAX_SAMPLE = 32, 1 << 18
#: Doublings of the rows that a split may cost for each halving of a node. Dealing by bytes makes 4 rows of one for 1/256 of the node: 2 / 8.
RATE = 0.25
#: Fingerprints compared directly at the bottom of a tree.
BOTTOM = 256

U64 = np.uint64


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's word shingles as an unsigned 64-bit integer; 0 without words."""
    words = (text or "").encode("utf-8").lower().split()  # on bytes, both touch ASCII alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - SHINGLE + 1].tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)])
    total, n = np.zeros(64, dtype=np.int64), len(starts)
    bits = np.frombuffer(raw, dtype=np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 16):
        total += np.unpackbits(bits[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                found = np.array([fingerprint(t) for t in part.column(1).to_pylist()], dtype=U64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
    return i, j


class Forest:
    """Union-find over the positions of one shard's fingerprints."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def apart(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose ends have different roots so far."""
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        roots = np.array([self.root(x) for x in nodes.tolist()])[at]
        keep = roots[: len(a)] != roots[len(a) :]
        return a[keep], b[keep]

    def join(self, pairs: Iterator[tuple[int, int]]) -> None:
        for a, b in pairs:
            a, b = self.root(a), self.root(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)


def link(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of distinct fingerprints the place of the least one that links reach in this shard: the pairs' spanning forest.

    A vantage-point tree: nodes are split at the median distance from a vantage
    point; pairs across the split lie within `radius` of it on both sides.
    """
    forest = Forest(len(fps))

    def pairs(x: np.ndarray, y: np.ndarray) -> None:
        for at in range(0, len(x), 64):
            i, j = _near(fps[x[at : at + 64]], fps[y], radius)
            i, j = x[at + i], y[j]
            if len(i) > 1000:  # among many copies most links join nothing new
                i, j = forest.apart(i, j)
            forest.join(zip(i.tolist(), j.tolist(), strict=True))

    stack = [(np.arange(len(fps)), np.arange(len(fps)))]
    while stack:
        x, y = stack.pop()  # links between x and y; x is y or they are disjoint
        same = x is y or (len(x) == len(y) and len(x) > 0 and x[0] == y[0])
        if not len(x) or not len(y):
            continue
        if len(x) * len(y) <= BOTTOM * BOTTOM:
            pairs(x, y)
            continue
        v = fps[(x if len(x) >= len(y) else y)[0]]
        dx, dy = np.bitwise_count(fps[x] ^ v).astype(np.int16), np.bitwise_count(fps[y] ^ v).astype(np.int16)
        cut = int(np.median(dx if len(x) >= len(y) else dy))
        inner_x, outer_x, inner_y, outer_y = x[dx <= cut], x[dx > cut], y[dy <= cut], y[dy > cut]
        if max(len(inner_x), len(outer_x)) == len(x) and max(len(inner_y), len(outer_y)) == len(y):
            pairs(x, y)  # all at one side of the median: no bound prunes here
            continue
        if same:
            stack += [(inner_x, inner_x), (outer_x, outer_x), (x[(dx <= cut) & (dx > cut - radius)], x[(dx > cut) & (dx <= cut + radius)])]
        else:
            stack += [(inner_x, inner_y), (outer_x, outer_y)]
            stack += [(x[(dx <= cut) & (dx > cut - radius)], y[(dy > cut) & (dy <= cut + radius)]), (x[(dx > cut) & (dx <= cut + radius)], y[(dy <= cut) & (dy > cut - radius)])]
    return np.array([forest.root(i) for i in range(len(fps))], dtype=np.int64)


def vantage_point(level: int) -> int:
    """A row of the Hadamard matrix of order 32 as bits: any two are about 16 bits apart, so distances to them are independent of each other.

    Rows have 16 bits; every second one gets another, as else all distances of a
    code would be even, or all odd, and half of the codes lie on every boundary.
    """
    return sum(1 << i for i in range(HALF) if ((level + 1) & i).bit_count() % 2) | (level % 2)


VANTAGE = np.array([vantage_point(j) for j in range(HALF - 1)], dtype=U64)


def choose(codes: np.ndarray) -> tuple[int, int] | None:
    """The vantage point and cut that split these codes of a half at the least cost: Hadamard rows and some of the codes are tried.

    The cost is the growth of rows (those at the cut go to both sides) against the
    entropy of the split. Sides of 70 % at most are preferred to those of 90 %.
    None: no split costs RATE or less.
    """
    v = np.concatenate([VANTAGE, codes[np.linspace(0, len(codes) - 1, 5).astype(np.int64)]])
    n, wide = len(codes), HALF + 1
    away = np.bitwise_count(codes[:, None] ^ v[None, :]) + np.arange(len(v)) * wide
    at = np.bincount(away.ravel(), minlength=wide * len(v)).reshape(len(v), wide)
    inner = at.cumsum(axis=1)
    widest = np.maximum(inner, n - inner + at)
    share = np.clip((inner - at / 2) / n, 1e-9, 1 - 1e-9)
    rate = np.log2(1 + at / n) / -(share * np.log2(share) + (1 - share) * np.log2(1 - share))
    for most in (0.7, 0.9):
        fit = np.where(widest <= most * n, rate, np.inf)
        best = int(fit.argmin())
        if fit.flat[best] <= RATE:
            return int(v[best // wide]), best % wide
    return None


class Tree:
    """A vantage-point tree over one half of fingerprints; cuts below 0 mark leaves."""

    PLAIN, DEALT = -1, -2

    def __init__(self, codes: np.ndarray, weight: int, leaf: int) -> None:
        """codes: the sampled halves; each stands for `weight` fingerprints. Largest nodes are split first."""
        self.vantage, self.cut, self.inner = [0], [self.PLAIN], [0]  # the outer child follows the inner one
        leaves, heap = 1, [(-len(codes), 0, codes)]
        while -heap[0][0] * weight > leaf:
            size, node, own = heapq.heappop(heap)
            found = choose(own) if leaves < MAX_LEAVES else None
            if found is None:
                self.cut[node] = self.DEALT if -size * weight > 2 * leaf else self.PLAIN
                if not heap:
                    break
                continue
            self.vantage[node], self.cut[node] = found
            self.inner[node] = len(self.cut)
            away = np.bitwise_count(own ^ U64(found[0]))
            for side in (own[away <= found[1]], own[away >= found[1]]):
                heapq.heappush(heap, (-len(side), len(self.cut), side))
                self.vantage.append(0)
                self.cut.append(self.PLAIN)
                self.inner.append(0)
            leaves += 1

    def leaves(self, codes: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(leaf, place) arrays: where each code goes; other: the other halves. A leaf's number holds its node, byte and the byte's value."""
        stack = [(0, np.arange(len(codes)))]
        while stack:
            node, at = stack.pop()
            cut = self.cut[node]
            if not len(at):
                continue
            if cut == self.PLAIN:
                yield np.full(len(at), node << 11, dtype=np.int64), at
            elif cut == self.DEALT:
                for b in range(4):
                    value = (other[at] >> U64(8 * b)) & U64(255)
                    yield (node << 11) + 1024 + 256 * b + value.astype(np.int64), at
            else:
                away = np.bitwise_count(codes[at] ^ U64(self.vantage[node]))
                stack += [(self.inner[node], at[away <= cut]), (self.inner[node] + 1, at[away >= cut])]


def _halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return fps & U64((1 << HALF) - 1), fps >> U64(HALF)


def shards(fps: DataFrame, leaf: int = LEAF) -> DataFrame:
    """fps: distinct (fp). Rows (leaf, fp): the leaves of both trees that a fingerprint is in.

    Measured: 100,000 random fingerprints make 4.8 rows each, 2 million 9.1; families
    that share a half make 3.5 to 8.4, and no leaf above 4,600. From some 3 million on
    trees have all their leaves, and those too large are dealt by bytes: 4 times the
    rows for 1/256 of the size. Codes that agree on a half and on a byte of the other
    stay together, however many they are.
    """
    n = fps.count()
    weight = max(1, leaf // SAMPLED, -(-n // MAX_SAMPLE))
    sample = np.array([r["fp"] for r in fps.where(F.pmod(F.xxhash64("fp"), F.lit(weight)) == 0).collect()], dtype=np.int64)
    trees = [Tree(half, weight, leaf) for half in _halves(np.sort(sample).view(U64))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            low, high = _halves(fp.view(U64))
            dealt = [(2 * number + t, at) for t, (own, other) in enumerate(((low, high), (high, low))) for number, at in trees[t].leaves(own, other)]
            if dealt:
                where = np.concatenate([at for _, at in dealt])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([number for number, _ in dealt])), pa.array(fp[where])], ["leaf", "fp"])

    return fps.select("fp").mapInArrow(run, "leaf long, fp long")


#: Fingerprints of a shard up to which all its pairs are compared, the shards of a batch side by side; the links are the same.
SMALL = 8


def link_sorted(group: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links' spanning forests of many shards at once: group numbers them, rising. Returns (fingerprint, root) of what isn't a root."""
    n = len(group)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(starts, n))
    rest = np.repeat(size, size)
    forest = Forest(n)
    tiny = rest <= SMALL
    for k in range(1, min(SMALL, int(size[size <= SMALL].max(initial=0)))):
        i = np.flatnonzero(tiny[:-k] & (group[k:] == group[:-k]))
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + k]) <= radius]
        forest.join(zip(i.tolist(), (i + k).tolist(), strict=True))
    for at, m in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        root = link(fps[at : at + m], radius)
        moved = np.flatnonzero(root != np.arange(m))
        forest.join(zip((at + moved).tolist(), (at + root[moved]).tolist(), strict=True))
    up = np.array([forest.root(x) if forest.up[x] != x else x for x in range(n)], dtype=np.int64)
    moved = np.flatnonzero(up != np.arange(n))
    return fps[moved], fps[up[moved]]


def edges(fps: DataFrame) -> DataFrame:
    """Distinct (u, v), u < v as signed longs: a spanning forest of all links within each shard. Every link is in one shard at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            leaf, fp = t.column("leaf").to_numpy(), t.column("fp").to_numpy().view(U64)
            turn = np.concatenate([[0], np.cumsum(leaf[1:] != leaf[:-1])])
            a, b = (x.view(np.int64) for x in link_sorted(turn, fp))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])

        held: list[pa.RecordBatch] = []  # whole shards are linked; the last one may go on in the next batch
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = batch.column(0).to_numpy()
            held.append(batch)
            rows += len(leaf)
            ended = np.flatnonzero(leaf != leaf[-1])
            if rows >= 50_000 and (len(ended) or last != leaf[-1]):  # nothing is joined anew while one shard goes on
                whole = int(ended[-1]) + 1 if len(ended) else 0
                yield linked(pa.Table.from_batches([*held[:-1], batch.slice(0, whole)]))
                held, rows = [batch.slice(whole)], len(leaf) - whole
            last = leaf[-1]
        if held:
            yield linked(pa.Table.from_batches(held))

    sorted_ = shards(fps).repartition("leaf").sortWithinPartitions("leaf", "fp")
    return sorted_.mapInArrow(run, "u long, v long").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: (u, v), u < v. Rows (node, root): root is the least node that links reach; all nodes of links.

    Alternating large-star and small-star steps, each one grouped minimum and
    a join; written to the shared folder after each round, until nothing changes.
    Rounds grow with the logarithm of the longest path; running out of them is an error.
    """
    now = materialize(links.select("u", "v"), "links")  # v hangs on u, u < v
    n = now.count()
    if not n:
        return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    was = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("deg"))
        # large star: each greater neighbour hangs on the least one
        large = materialize(attach(both.where("v > u"), "u", least, n).select(F.col("m").alias("u"), "v").where("u < v"), "links-large")
        # small star: a node's lesser neighbours and itself hang on the least of them
        below = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("deg"))
        small = attach(large, "v", below, n).select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u < v").distinct()
        nxt = materialize(small, "links")
        mark = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(now)
        discard(large)
        now = nxt
        if mark == was:
            break
        was, n = mark, mark["n"]
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, fp, component_id (least doc_id reachable), one row for each row of docs.

    Texts that are null, empty or without words share fingerprint 0. Repeated rows
    and copies meet in one fingerprint; a null id is never a component's id unless
    all of its ids are null. Other columns are ignored.
    """
    prints = materialize(fingerprints(docs), "simhash")
    owners = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("deg")), "simhash-fps")
    found = components(edges(owners.select("fp")))
    linked = found.join(owners, found["node"] == owners["fp"]).select("fp", "root", "first")
    of_root = linked.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("deg"))
    own = attach(linked, "root", of_root, owners.count()).select("fp", "component")
    named = owners.join(own, "fp", "left").select("fp", "deg", F.coalesce("component", "first").alias("component_id"))
    return attach(prints, "fp", named, prints.count()).select("doc_id", "fp", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
