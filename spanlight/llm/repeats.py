"""Suffix-array dedup: a depth-limited radix sort of the corpus's suffixes, which leaves the repeated 100-byte windows.

Suffixes are ordered by their first DEPTH bytes only, and by most-significant-digit
passes; a suffix that is alone after a pass leaves. A digit is many bytes wide, kept
as a hash, so a pass is one shuffle of longs.

1. The first digit of a window is the GRAM bytes at its synchronising position: the
   place of the least GRAM-byte hash in the window. It depends on the window's bytes
   alone, so equal windows have it at the same offset; and some 40 neighbouring
   windows share it, so it is sorted once for all of them (a run), not once a window.
2. The second digit is all bytes that the run's windows cover. Runs equal in it are
   equal window by window: all but the earliest are repeats.
3. The earliest runs of groups with more than one second digit may still agree in
   some windows. Their third digit is each window's bytes; equal groups are exactly
   the repeated windows.

A pass may keep a run too many (where a group crosses batches): the third pass
decides it. A group that is split over tasks, as it is hot, leaves a run a task, of
which a second look keeps the earliest. Groups compare 112 bits in pass 2
and 128 in pass 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HEAVY, discard, materialize, table

#: Bytes of a window, of the first digit, and places that a first digit has in a window.
DEPTH, GRAM = 100, 24
PLACES = DEPTH - GRAM + 1
#: Starts whose first digits are found at once; with PLACES more they fit 16 bits.
BLOCK = 1 << 15
#: Bytes of texts that are taken together (one text, if longer); some 60 times as many are held for them meanwhile.
SLICE = 1 << 18
#: Tasks that a hot first digit is dealt to; hot ones are found on one document of SAMPLE.
SPLIT, SAMPLE = 64, 64

U64 = np.uint64
_rng = np.random.default_rng(2024)
LETTERS = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
STEPS = [U64(int(x) | 1) for x in _rng.integers(1 << 40, 1 << 62, 8)]
LOW = U64(0xFFFF)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position of data on."""
    h, n, powers = LETTERS[data], 1, {}
    while n <= GRAM:
        powers[n] = h
        if 2 * n > GRAM:
            break
        h = h[:-n] * STEPS[n.bit_length() % 8] + h[n:]
        n *= 2
    rest = GRAM - n
    while rest:  # the lesser powers of two that make up GRAM
        m = 1 << (rest.bit_length() - 1)
        tail = powers[m][n:]
        size = min(len(h), len(tail))
        h = h[:size] * STEPS[m.bit_length() % 8] + tail[:size]
        n, rest = n + m, rest - m
    h = h ^ (h >> U64(32))
    h *= U64(0x9E3779B97F4A7C15)
    return h ^ (h >> U64(29))


def sync_positions(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of DEPTH bytes of data: where its first digit is, and the upper 48 bits of that one's hash."""
    n = len(data) - DEPTH + 1
    place, code = np.empty(n, dtype=np.int64), np.empty(n, dtype=U64)
    for at in range(0, n, BLOCK):
        size = min(BLOCK, n - at)
        h = gram_hashes(data[at : at + size + DEPTH - 1])
        least = (h & ~LOW) | np.arange(len(h), dtype=U64)  # the leftmost of equal hashes
        width = 1
        while 2 * width <= PLACES:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = PLACES - width
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        place[at : at + size] = (least & LOW).astype(np.int64) + at
        code[at : at + size] = least >> U64(16)
    return place, code


def runs(data: bytes, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts side by side in data. Per run of windows: its text's number, first digit's code, its place, first and last start (in data)."""
    if len(data) < DEPTH:
        return
    place, code = sync_positions(np.frombuffer(data, dtype=np.uint8))
    starts = np.arange(len(place))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    inside = starts + DEPTH <= offsets[doc + 1]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    lo = np.flatnonzero(first)
    if len(lo):
        ends = np.flatnonzero(inside & np.append(~inside[1:] | first[1:], True))
        yield doc[lo], code[lo], place[lo], lo, ends


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE bytes of text."""
    part = np.cumsum(pc.binary_length(batch.column(text)).to_numpy()) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


RUN = "id long, at long, digit long, rest long"


def first_digits(docs: DataFrame) -> DataFrame:
    """(id, tie, text binary) -> RUN rows. digit: 48 bits of the first digit's hash, and how far before it the run begins and ends (8 bits each); rest: the second digit; at: tie and the run's first start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for part in slices(batch, 2):
                texts = part.column(2).to_pylist()
                data, offsets = b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                tie = part.column(1).to_numpy()
                for doc, code, place, lo, hi in runs(data, offsets):
                    rest = np.array([digest(data[a : b + DEPTH]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], dtype=U64)
                    digit = (code << U64(16)) | ((place - lo) << 8 | (place - hi)).astype(U64)
                    at = (tie[doc] << 32) | (lo - offsets[doc])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(at), pa.array(digit.view(np.int64)), pa.array(rest.view(np.int64))], ["id", "at", "digit", "rest"])

    return docs.mapInArrow(run, RUN)


def sorted_tables(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray, bool]]:
    """Rows sorted by key and then by place, in tables that overlap by a row: (table, whether a row's key is new, whether it is the last table).

    A table's last row comes again as the next one's first, which then belongs to
    that one alone. Rows that equal the one before in key and place are left out:
    those of repeated rows of one document.
    """
    held, before = None, None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        same_key, same = np.ones(t.num_rows, dtype=bool), np.ones(t.num_rows, dtype=bool)
        for c in (*key, "at", "id"):
            x = t.column(c)
            v = x.fill_null(0).to_numpy()
            same[1:] &= v[1:] == v[:-1]
            if x.null_count:
                v = x.is_null().to_numpy()
                same[1:] &= v[1:] == v[:-1]
            if c in key:
                same_key[1:] &= v[1:] == v[:-1]
        if not t.num_rows:
            continue
        same[0] = False
        new = ~same_key[~same]
        t = t.filter(pa.array(~same)).combine_chunks()
        new[0] = before != tuple(t.column(c)[0].as_py() for c in key)
        if t.num_rows < 2:
            held = t
            continue
        yield t, new, False
        before = tuple(t.column(c)[-2].as_py() for c in key)
        held = t.slice(t.num_rows - 1)
    if held is not None:
        yield held, np.array([before != tuple(held.column(c)[0].as_py() for c in key)]), True


FOUND = "id long, at long, digit long, sure boolean, rest long"


def _code(digit: Column) -> Column:
    return F.shiftright(digit, 16)


def refine(rows: DataFrame, hot: set[int]) -> DataFrame:
    """Passes 1 and 2 over RUN rows: those that are sure to be repeats, and those that pass 3 has to decide (sure is false; rest is left where `once` needs it)."""
    # A first digit is 48 bits; `digit` also holds the run's extent, and equal first digits stand together in its order.
    code = _code(F.col("digit"))
    salt = F.when(code.isin(list(hot)), F.pmod(F.xxhash64("id", "at"), F.lit(SPLIT))).otherwise(0) if hot else F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, open_ = np.array(sorted(hot), dtype=np.int64), None
        for t, new, last in sorted_tables(batches, ("digit", "rest")):
            group, n = t.column("digit").to_numpy() >> 16, t.num_rows
            same = np.zeros(n + 1, dtype=bool)  # whether a row has the first digit of the one before
            same[1:n] = group[1:] == group[:-1]
            same[0] = open_ == group[0]
            # The row after a class decides if the class is alone; where that isn't here yet, pass 3 decides.
            ends = np.append(np.flatnonzero(new), n)
            after = ends[np.searchsorted(ends, np.arange(n), side="right").clip(max=len(ends) - 1)]
            shared = same[:n] | np.where(after < n, same[after], not last)
            keep = ~new | shared | np.isin(group, known)
            if not last:
                keep[n - 1] = False
                open_ = group[n - 2]
            rest = pa.array(t.column("rest").to_numpy(), mask=~new | ~np.isin(group, known))
            t = t.select(["id", "at", "digit"]).append_column("sure", pa.array(~new)).append_column("rest", rest).filter(pa.array(keep))
            yield from t.to_batches()

    dealt = rows.repartition(code, salt).sortWithinPartitions("digit", "rest", F.col("id").asc_nulls_last(), "at")
    return dealt.mapInArrow(run, FOUND)


def once(found: DataFrame, hot: set[int]) -> DataFrame:
    """FOUND rows of hot first digits, of which each task has left the earliest of equal runs, SPLIT of them at most: all but the earliest of all are sure."""
    own = found.where(~F.col("sure") & _code(F.col("digit")).isin(list(hot)))
    order = Window.partitionBy("digit", "rest").orderBy(F.col("id").asc_nulls_last(), "at")
    return own.withColumn("sure", F.row_number().over(order) > 1)


LOW_32 = (1 << 32) - 1


def _spans(rows: DataFrame) -> DataFrame:
    """FOUND rows -> id, tie, first and last start, digit."""
    start = F.col("at").bitwiseAND(F.lit(LOW_32))
    last = start + F.shiftright(F.col("digit"), 8).bitwiseAND(F.lit(255)) - F.col("digit").bitwiseAND(F.lit(255))
    return rows.select("id", F.shiftright("at", 32).alias("tie"), start.alias("a"), last.alias("b"), "digit")


def contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: (id, tie, a, b, digit). Rows (code, id, at, bytes): all bytes that a run's windows cover."""
    spans = asked.groupBy("id", "tie").agg(F.collect_list(F.struct("a", "b", "digit")).alias("spans")).select(F.col("id").alias("i"), F.col("tie").alias("t"), "spans")
    found = docs.join(spans, F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows = [(s["digit"] >> 16, id_, tie << 32 | s["a"], text[s["a"] : s["b"] + DEPTH]) for id_, tie, text, spans in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True) for s in spans]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["code", "id", "at", "bytes"])

    return found.select("id", "tie", "text", "spans").mapInArrow(run, "code long, id long, at long, bytes binary")


WINDOW = "wa long, wb long, id long, at long"


def windows(runs: DataFrame) -> DataFrame:
    """Third digits: (wa, wb) of each window of the runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                texts = part.column("bytes").to_pylist()
                size = np.array([len(t) - DEPTH + 1 for t in texts])
                w = np.frombuffer(b"".join([digest(t[s : s + DEPTH]) for t in texts for s in range(len(t) - DEPTH + 1)]), dtype=np.int64).reshape(-1, 2)
                row = np.repeat(np.arange(len(texts)), size)
                at = part.column("at").to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                one = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(w[:, 0]), pa.array(w[:, 1]), part.column("id").take(one), pa.array(at), part.column("open").take(one)], ["wa", "wb", "id", "at", "open"])

    return runs.select("id", "at", "bytes", "open").mapInArrow(run, f"{WINDOW}, open boolean")


def _sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's sorted windows those that aren't the first of their group, which are repeats whatever other tasks hold, with wa and wb null; and the firsts that are open, as another task may hold an earlier one."""
    for t, new, last in sorted_tables(batches, ("wa", "wb")):
        keep = ~new | t.column("open").to_numpy()
        if not last:
            keep[-1] = False
        w = [pa.array(t.column(c).to_numpy(), mask=~new) for c in ("wa", "wb")]
        yield from pa.table([*w, t.column("id"), t.column("at")], ["wa", "wb", "id", "at"]).filter(pa.array(keep)).to_batches()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (id, at) rows the spans of starts that follow each other."""
    for batch in batches:
        if batch.num_rows:
            at, id_ = batch.column("at").to_numpy(), batch.column("id")
            known, null = id_.fill_null(0).to_numpy(), id_.is_null().to_numpy(zero_copy_only=False)
            new = np.ones(len(at), dtype=bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (known[1:] != known[:-1]) | (null[1:] != null[:-1])
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], len(at)) - 1
            yield pa.RecordBatch.from_arrays([id_.take(pa.array(lo)), pa.array(at[lo] >> 32), pa.array(at[lo] & LOW_32), pa.array(at[hi] & LOW_32)], ["id", "tie", "a", "b"])


SPAN = "id long, tie long, a long, b long"


def _decided(dealt: DataFrame) -> DataFrame:
    """Windows dealt to tasks -> WINDOW rows: repeats (wa is null), and open firsts. The sort spills."""
    return dealt.sortWithinPartitions("wa", "wb", F.col("id").asc_nulls_last(), "at").mapInArrow(_sifted, WINDOW)


def third_pass(runs: DataFrame, hot: set[int]) -> DataFrame:
    """SPAN rows of the windows of runs, (code, id, at, bytes), that an earlier one equals.

    Windows are made after the shuffle, by first digit, and sorted within the task.
    Runs of a hot first digit are dealt to SPLIT tasks at most; the first
    window of each group in each of them, SPLIT a group at most, are shuffled and
    sorted again.
    """
    is_hot = F.col("code").isin(list(hot)) if hot else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64("id", "at"), F.lit(SPLIT))).otherwise(0) if hot else F.lit(0)
    out = _decided(windows(runs.withColumn("open", is_hot).repartition("code", salt)))
    if hot:
        seen = materialize(out, "repeats-windows")
        firsts = seen.where("wa IS NOT NULL").withColumn("open", F.lit(False)).repartition("wa", "wb")
        out = seen.where("wa IS NULL").unionByName(_decided(firsts))
    return out.select("id", "at").sortWithinPartitions("id", "at").mapInArrow(_joined, SPAN)


def hot_digits(docs: DataFrame) -> set[int]:
    """First digits with more than 1 / HEAVY of a sample's runs: fewer than HEAVY. They only decide how rows are dealt."""
    few = first_digits(docs.where(F.pmod(F.xxhash64("id", "text"), F.lit(SAMPLE)) == 0)).groupBy(_code(F.col("digit")).alias("code")).count()
    few = materialize(few, "repeats-sample")
    total = few.agg(F.sum("count")).first()[0] or 0
    out = {r[0] for r in few.where(F.col("count") > max(total / HEAVY, 8)).select("code").collect()}
    discard(few)
    return out


def repeats(docs: DataFrame) -> DataFrame:
    """docs: (id, tie, text binary). SPAN rows: starts a to b of windows that an earlier start equals."""
    hot = hot_digits(docs)
    found = materialize(refine(first_digits(docs), hot), "repeats-runs")
    if hot:
        cold = found.where(F.col("sure") | ~_code(F.col("digit")).isin(list(hot)))
        found = cold.unionByName(materialize(once(found, hot), "repeats-once"))
    asked = materialize(contexts(docs, _spans(found.where("NOT sure"))), "repeats-contexts")
    return _spans(found.where("sure")).drop("digit").unionByName(third_pass(asked, hot))


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (id, tie, text binary); a null text counts as empty. tie tells different texts of one id apart, and is 0 if no id has several."""
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    code = F.xxhash64("text")
    several = own.groupBy("id").agg((F.min(code) != F.max(code)).alias("x")).where("x").limit(1).count()
    return own.select("id", (F.shiftrightunsigned(code, 33) if several else F.lit(0).cast("long")).alias("tie"), "text")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def kept_parts(n: int, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int, int]:
    """What remains of n bytes if the windows that start in the spans go: the remaining parts, the bytes removed, the removed runs."""
    kept, at, removed, count = [], 0, 0, 0
    end = -1
    for a, b in sorted(spans):
        if a > end:  # a new removed run
            if end >= 0:
                removed += end - start
            kept.append((max(at, 0), a))
            start, count = a, count + 1
        end = max(end, b + DEPTH)
        at = end
    if end >= 0:
        removed += end - start
    kept.append((at, n))
    return kept, removed, count


def strip(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> RESULT, one row for each row of docs: without bytes that a repeated 100-byte string covers.

    The earlier of two equal strings stays: that of the smaller doc_id, null ids
    last, texts of one id in the order of a hash; within a text the earlier start.
    Rows equal in id and text are one document and get the same result. Null and
    empty texts have no bytes; other columns are ignored.
    """
    own = documents(docs)
    spans = repeats(own).groupBy("id", "tie").agg(F.collect_set(F.struct("a", "b")).alias("spans")).select(F.col("id").alias("i"), F.col("tie").alias("t"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                out = []
                for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    kept, removed, count = kept_parts(len(text), [(s["a"], s["b"]) for s in spans or ()])
                    h = hashlib.sha256()
                    for a, b in kept:
                        h.update(text[a:b])
                    out.append((len(text), removed, count, h.hexdigest()))
                n, removed, count, sha = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = own.join(spans, F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")), "left")
    return joined.select(F.col("id").alias("doc_id"), "text", "spans").mapInArrow(run, RESULT)


def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return strip(table(spark, sf_dir, "documents"))
