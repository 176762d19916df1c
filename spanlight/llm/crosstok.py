"""Cross-tokenizer alignment by label strings.

Every byte of a text gets a label: n (no token ends here), a (one of A's ends), b
(one of B's), x (both). A regular expression cuts the label string after each x;
the labels of a span say how many tokens of A and B form that group. Within it,
each label but n closes a stretch of bytes that one token of A and one of B cover,
so the labels are also the links.

A link's count is the number of documents that hold its pair of ids. Documents keep
their distinct pairs; the counts of the most frequent pairs, at most TOP, reach them
by broadcast, all others by a shuffled join.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer_path
from .common import materialize, table

#: Pairs whose counts are broadcast (17 bytes each).
TOP = 1 << 18
#: Stretches of text whose tokens a worker remembers, the longest in characters, and label spans it remembers.
CACHE, CACHE_LENGTH = 1 << 18, 48
#: Documents and characters that are aligned together (one document, if longer).
DOCS, CHARS = 256, 1 << 20

SPACE = "▁"
SPAN = re.compile(rb"[nab]*x")
LETTERS = np.frombuffer(b"nabx", dtype=np.uint8)
#: Where texts may be cut without a change of tokens: before a space after something else than white space.
CUT = re.compile(r"(?<=\S)(?= )")
#: White space before a space, or a character that the plain cut uses.
UNEVEN = re.compile(r"\s\x20|\0")


class Counts(dict):
    """Label span -> tokens of A, tokens of B in one integer."""

    def __missing__(self, span: bytes) -> int:
        said = (span.count(b"a") + 1) << 32 | (span.count(b"b") + 1)
        if len(self) < CACHE:
            self[span] = said
        return said


class Pair(dict):
    """The two tokenizers. As a dict: stretch of text -> ids of A and of B as packed 32-bit integers, or None where bytes differ.

    No token of A begins in front of white space and goes on into it, and none of
    B holds a space mark after another character (checked); so stretches that begin
    with a space after something else are encoded alone.
    """

    def __init__(self, ranks_path: str, piece_path: str) -> None:
        super().__init__()
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.text_a = [b""] * (1 + max(ranks.values()))
        for t, i in ranks.items():
            self.text_a[i] = t
        self.text_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(SPACE, " ").encode() for p in pieces]
        self.len_a, self.len_b = (np.array([len(t) for t in x]) for x in (self.text_a, self.text_b))
        self.lone = pieces.index(SPACE)
        # Decimal ids with what may follow: within a group, between its sides, between groups, at the end.
        self.words = [*(b"%d%s" % (i, s) for s in (b",", b"|") for i in range(len(self.text_a))), *(b"%d%s" % (i, s) for s in (b",", b";", b"") for i in range(len(pieces)))]
        self.counts = Counts()

    def tokens(self, text: str) -> tuple[bytes, bytes] | None:
        """Packed ids of A and B for text, which begins with a space; None if one of them doesn't give its bytes back."""
        own = text.encode()
        a = self.a.encode_ordinary(text)
        b = self.b.encode(text[1:]) or [self.lone] * (text == " ")
        if b"".join(map(self.text_a.__getitem__, a)) != own or b"".join(map(self.text_b.__getitem__, b)) != own:
            return None
        return np.array(a, dtype="<u4").tobytes(), np.array(b, dtype="<u4").tobytes()

    def __missing__(self, part: str) -> tuple[bytes, bytes] | None:
        said = self.tokens(part)
        if len(self) < CACHE and len(part) <= CACHE_LENGTH:
            self[part] = said
        return said

    def encode(self, text: str | None) -> tuple[bytes, bytes] | None:
        """Packed ids of A and B for a whole text; None if it is null, empty or not given back."""
        if not text:
            return None
        text = " " + text
        if not self.cuts:
            return self.tokens(text)
        parts = CUT.split(text) if UNEVEN.search(text) else text.replace(" ", "\0 ").split("\0")[1:]
        said = [self[p] for p in parts]
        if None in said:
            return self.tokens(text)
        return b"".join([x for x, _ in said]), b"".join([x for _, x in said])


@lru_cache(maxsize=1)
def pair(ranks_path: str, piece_path: str) -> Pair:
    return Pair(ranks_path, piece_path)


def labels(end_a: np.ndarray, end_b: np.ndarray, size: int) -> np.ndarray:
    """Label of each of size bytes: 0 none, 1 A ends, 2 B ends, 3 both."""
    out = np.zeros(size, dtype=np.uint8)
    out[end_a - 1] = 1
    out[end_b - 1] |= 2
    return out


def group_sizes(label: np.ndarray, memo: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B in each group, from the spans of the label string."""
    both = np.array([memo[s] for s in SPAN.findall(LETTERS[label].tobytes())], dtype=np.int64)
    return both >> 32, both & 0xFFFFFFFF


class Aligned:
    """Texts aligned side by side; each ends at a both-label, so none reaches into the next."""

    def __init__(self, p: Pair, texts: list[str | None]) -> None:
        said = [p.encode(t) for t in texts]
        a, b = (np.frombuffer(b"".join([x[i] for x in said if x]), dtype="<u4").astype(np.int64) for i in range(2))
        self.a, self.b = a, b
        end_a, end_b = np.cumsum(p.len_a[a]), np.cumsum(p.len_b[b])
        label = labels(end_a, end_b, int(end_a[-1]) if len(a) else 0)
        self.in_a, self.in_b = group_sizes(label, p.counts)
        # Tokens, groups and links of a text end where its own end.
        self.n_a, self.n_b = (np.array([len(x[i]) // 4 if x else 0 for x in said], dtype=np.int64) for i in range(2))
        self.to_a, self.to_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        at = np.flatnonzero(label)
        kind = label[at]
        bytes_to = np.concatenate([[0], end_a])[self.to_a]
        self.to_group = np.searchsorted(np.cumsum(self.in_a), self.to_a, side="right") if len(a) else np.zeros(len(texts), dtype=np.int64)
        self.to_link = np.searchsorted(at, bytes_to)
        ends_a, ends_b = (kind & 1).astype(np.int64), (kind >> 1).astype(np.int64)
        self.links = a[np.cumsum(ends_a) - ends_a] * len(p.text_b) + b[np.cumsum(ends_b) - ends_b] if len(a) else np.zeros(0, dtype=np.int64)

    def written(self, p: Pair) -> Iterator[bytes]:
        """Each text's groups as `a1,a2|b1;a3|b2`."""
        n = len(self.in_a)
        upto_a, upto_b = np.cumsum(self.in_a), np.cumsum(self.in_b)
        group_a, group_b = np.repeat(np.arange(n), self.in_a), np.repeat(np.arange(n), self.in_b)
        last_a, last_b = np.zeros(len(self.a), dtype=np.int64), np.zeros(len(self.b), dtype=np.int64)
        last_a[upto_a - 1], last_b[upto_b - 1] = 1, 1
        last_b[self.to_b[self.n_b > 0] - 1] = 2
        out = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        out[np.arange(len(self.a)) + (upto_b - self.in_b)[group_a]] = self.a + last_a * len(p.text_a)
        out[np.arange(len(self.b)) + upto_a[group_b]] = self.b + last_b * len(p.text_b) + 2 * len(p.text_a)
        at = 0
        for to in (self.to_a + self.to_b).tolist():
            yield b"".join(map(p.words.__getitem__, out[at:to].tolist()))
            at = to

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, links), one for each text and pair in it, by text."""
        n = np.diff(self.to_link, prepend=0)
        doc = np.repeat(np.arange(len(n)), n)
        key, times = np.unique(doc << 48 | self.links, return_counts=True)
        return key >> 48, key & ((1 << 48) - 1), times


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """At most DOCS rows and about CHARS characters at a time, and their texts."""
    texts = batch.column(column).to_pylist()
    at = chars = 0
    for i, t in enumerate(texts):
        if i > at and (i - at >= DOCS or chars + len(t or "") > CHARS):
            yield batch.slice(at, i - at), texts[at:i]
            at, chars = i, 0
        chars += len(t or "")
    if at < len(texts):
        yield batch.slice(at), texts[at:]


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


GROUPS = "doc_id long, a array<int>, b array<int>, in_a array<int>, in_b array<int>"


def token_groups(docs: DataFrame, ranks_path: str, piece_path: str) -> DataFrame:
    """(doc_id, text) -> the ids of A and B, and how many of each make up group after group; all empty for texts without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(ranks_path, piece_path)
        for batch in batches:
            for part, texts in slices(batch, 1):
                x = Aligned(p, texts)
                cut = lambda v, to: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], to]), pa.int32()), pa.array(v, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), cut(x.a, x.to_a), cut(x.b, x.to_b), cut(x.in_a, x.to_group), cut(x.in_b, x.to_group)], ["doc_id", "a", "b", "in_a", "in_b"])

    return _own(docs).mapInArrow(run, GROUPS)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]


def aligned(docs: DataFrame, ranks_path: str, piece_path: str) -> DataFrame:
    """(doc_id, text) -> NAMES: counts, the digest of the groups, and each pair of linked ids with its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(ranks_path, piece_path)
        for batch in batches:
            for part, texts in slices(batch, 1):
                x = Aligned(p, texts)
                sha = [hashlib.sha256(w).hexdigest() if w else "" for w in x.written(p)]
                doc, pairs, times = x.distinct()
                to = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
                counts = [pa.array(v) for v in (x.n_a, x.n_b, np.diff(x.to_group, prepend=0), np.diff(x.to_link, prepend=0))]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(sha), pa.ListArray.from_arrays(to, pa.array(pairs)), pa.ListArray.from_arrays(to, pa.array(times, pa.int32()))], NAMES)

    return _own(docs).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(found: DataFrame, n_b: int) -> DataFrame:
    """Documents that hold each pair, and whether no pair of its A id is in more: (pair, n, best)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    counts = found.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counts.withColumn("a", F.floor(F.col("pair") / n_b)), "crosstok-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most a row for each id of A
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(found: DataFrame, n_b: int, top: int = TOP) -> DataFrame:
    """found: (row, pairs, times), row unique. Per row: n_best and count_sum over its links."""
    counts = materialize(pair_counts(found, n_b), "crosstok-pairs")
    first = sorted(counts.orderBy(F.desc("n"), "pair").limit(top).collect())
    known = found.sparkSession.sparkContext.broadcast((np.array([r[0] for r in first], dtype=np.int64), np.array([r[1] for r in first], dtype=np.int64), np.array([r[2] for r in first], dtype=bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = known.value
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            pairs, times = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(keys, pairs).clip(max=max(0, len(keys) - 1))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), dtype=bool)
            total, top_ = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            np.add.at(total, row[hit], times[hit] * n[at[hit]])
            np.add.at(top_, row[hit], times[hit] * best[at[hit]])
            to = pa.array(np.searchsorted(row[~hit], np.arange(len(size) + 1)), pa.int32())
            rest = [pa.ListArray.from_arrays(to, pa.array(v)) for v in (pairs[~hit], times[~hit])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top_), pa.array(total), *rest], ["row", "n_best", "count_sum", "pairs", "times"])

    part = materialize(found.select("row", "pairs", "times").mapInArrow(run, "row long, n_best long, count_sum long, pairs array<long>, times array<long>"), "crosstok-part")
    rest = part.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("t"))
    more = rest.join(counts, "pair").select("row", F.when(F.col("best"), F.col("t")).otherwise(0).alias("n_best"), (F.col("t") * F.col("n")).alias("count_sum"))
    return part.select("row", "n_best", "count_sum").unionByName(more).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, ranks_path: str, piece_path: str, top: int = TOP) -> DataFrame:
    """(doc_id, text) -> one row for each row of docs: tokens, groups and links of both tokenizers, and the links' counts.

    ranks_path: A, a byte-level BPE as ranks; piece_path: B, a piece model that adds
    a space. Both are readable on every machine. Texts that are null or empty, or
    that a tokenizer doesn't give back with the space in front, have no tokens:
    zeros and an empty digest. Repeated rows and null ids count as documents of
    their own. Other columns are ignored.
    """
    n_b = len(pair(ranks_path, piece_path).text_b)
    found = materialize(aligned(docs, ranks_path, piece_path).withColumn("row", F.monotonically_increasing_id()), "crosstok")
    return found.drop("pairs", "times").join(scored(found, n_b, top), "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_cross_tokenizer(spark, sf_dir: str) -> DataFrame:
    """A is byte_bpe_50k: its ranks file holds the same vocabulary as the JSON file."""
    return align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"))
