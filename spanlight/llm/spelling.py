"""Spelling variants: words one edit apart, found in tries.

The words, sorted, are cut into shards; each becomes a compact trie of flat arrays,
children side by side. Blocks of shards of at most BLOCK_BYTES are broadcast, and
each word's distance-one automaton walks every shard of a block depth-first. Its
states are how many letters are read and whether the edit is spent, so it follows
the word itself, and at each node on that path spends the edit on a deletion, a
replacement or an insertion, after which only the rest of the word is accepted. A
word reports the number of its neighbours in a block and the best of them; nothing
emits pairs.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, table

#: A word's letters; how often a letter goes; what words and forms need.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
DROP_ONE_IN, MIN_LENGTH, MIN_COUNT, FORM_FACTOR = 97, 5, 3, 2

#: Words of a shard at most; bytes of tries that are broadcast at once.
SHARD_WORDS, BLOCK_BYTES = 1 << 18, 32 << 20
#: Words that a task looks up; their walks take longer than their bytes tell.
TASK_WORDS = 1 << 14
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 18


def spoilt(run: bytes, seed: int) -> str:
    """The run, lower-cased, without a letter where its hash says so. seed: crc32 of the document's part of the hash."""
    h = zlib.crc32(run, seed)
    text = run.decode()
    if h % DROP_ONE_IN == 0:
        at = h % len(text)
        return text[:at] + text[at + 1 :]
    return text


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (word, n): partial counts of the words of MIN_LENGTH letters and more. A null id is hashed as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                seed = zlib.crc32(b"%s:" % (b"" if id_ is None else str(id_).encode()))
                # On bytes, lower() touches A-Z alone.
                for word, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    said = spoilt(word.encode(), seed)
                    if len(said) >= MIN_LENGTH:
                        held[said] += n
                if len(held) >= HELD:
                    yield flush()
                    held.clear()
        yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words with at least MIN_COUNT occurrences in all texts together."""
    return occurrences(docs).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


class Trie:
    """Flat arrays: node i's children are at first[i] to first[i + 1] - 1, by letter; count[i] is the n of the word that ends there, or 0."""

    def __init__(self, words: list[bytes], counts: list[int]) -> None:
        """words: in Latin-1, which holds all letters; sorted, no two equal."""
        letter, self.first, self.count = bytearray(1), array("I"), array("q", [0])
        level, depth = [(0, len(words))], 0  # ranges of words below each node of a level
        while level:
            nxt = []
            for lo, hi in level:
                self.first.append(len(letter))
                at = lo + (len(words[lo]) == depth) if hi > lo else hi
                while at < hi:
                    c, end = words[at][depth], at + 1
                    while end < hi and words[end][depth] == c:
                        end += 1
                    letter.append(c)
                    self.count.append(counts[at] if len(words[at]) == depth + 1 else 0)
                    nxt.append((at, end))
                    at = end
            level, depth = nxt, depth + 1
        self.first.append(len(letter))
        self.letter = bytes(letter)

    def to_bytes(self) -> bytes:
        head = array("I", [len(self.letter), len(self.first)])
        return b"".join((head.tobytes(), self.letter, self.first.tobytes(), self.count.tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes) -> Trie:
        out = cls.__new__(cls)
        n, m = array("I", data[:8])
        out.letter, at = data[8 : 8 + n], 8 + n
        for name, kind, size in (("first", "I", m), ("count", "q", n)):
            to = at + size * array(kind).itemsize
            setattr(out, name, array(kind, data[at:to]))
            at = to
        return out

    def near(self, word: bytes) -> list[tuple[bytes, int]]:
        """(word, count) of each word exactly one edit from word, depth-first, each once."""
        find, first, count, out = self.letter.find, self.first, self.count, []
        size = len(word)

        def rest(node: int, at: int) -> int:
            """The count at the node that word[at:] leads to from node; 0 if there is none."""
            for c in word[at:]:
                node = find(c, first[node], first[node + 1])
                if node < 0:
                    return 0
            return count[node]

        node = 0
        for at in range(size + 1):
            lo, hi = first[node], first[node + 1]
            nxt, after = -1, -1
            if at < size:
                own = word[at]
                nxt = find(own, lo, hi)
                after = word[at + 1] if at + 1 < size else -1
                # Deleting one of equal neighbours gives one word: the last of them goes.
                if after != own and (n := rest(node, at + 1)):
                    out.append((word[:at] + word[at + 1 :], n))
            for child in range(lo, hi):
                if child == nxt:
                    continue  # inserting it here is inserting it after itself
                below, end = first[child], first[child + 1]
                if at == size:
                    n = count[child]
                else:
                    if after < 0:
                        n = count[child]
                    else:
                        to = find(after, below, end)
                        n = rest(to, at + 2) if to >= 0 else 0
                    if n:
                        out.append((word[:at] + self.letter[child : child + 1] + word[at + 1 :], n))
                    to = find(own, below, end)
                    n = rest(to, at + 1) if to >= 0 else 0
                if n:
                    out.append((word[:at] + self.letter[child : child + 1] + word[at:], n))
            if nxt < 0:
                break
            node = nxt
        return out


def shards(words: DataFrame, size: int = SHARD_WORDS) -> DataFrame:
    """(word, n) -> (trie): sorted words, at most `size` of them a trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_words: list[bytes] = []
        held_n: list[int] = []
        for batch in batches:
            held_words += [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            held_n += batch.column(1).to_pylist()
            while len(held_words) >= size:
                yield pa.RecordBatch.from_arrays([pa.array([Trie(held_words[:size], held_n[:size]).to_bytes()], pa.binary())], ["trie"])
                del held_words[:size], held_n[:size]
        if held_words:
            yield pa.RecordBatch.from_arrays([pa.array([Trie(held_words, held_n).to_bytes()], pa.binary())], ["trie"])

    return words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word").mapInArrow(run, "trie binary")


def blocks(tries: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The tries in blocks of at most `most` bytes, or of one trie; the driver holds one block at a time."""
    held: list[bytes] = []
    for row in tries.toLocalIterator():
        if held and sum(map(len, held)) + len(row[0]) > most:
            yield held
            held = []
        held.append(bytes(row[0]))
    if held:
        yield held


#: Neighbours of one block: how many, the largest count with the first word of it in code-point order.
NEAR = "word string, n long, n_near long, best string, best_n long"


def neighbours(words: DataFrame, tries: list[bytes], tasks: int) -> DataFrame:
    """(word, n) against a block of tries -> NEAR rows, one for each word that has neighbours there."""
    sent = words.sparkSession.sparkContext.broadcast(tries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Trie.from_bytes(t) for t in sent.value]
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                letters, found, best = word.encode("latin-1"), 0, None
                for trie in own:
                    for other, m in trie.near(letters):
                        found += 1
                        if best is None or (-m, other) < best:
                            best = (-m, other)
                if best:
                    rows.append((word, n, found, best[1].decode("latin-1"), -best[0]))
            names = ["word", "n", "n_near", "best", "best_n"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names)

    return words.select("word", "n").repartition(tasks, "word").mapInArrow(run, NEAR)


def forms(words: DataFrame, most: int = BLOCK_BYTES, size: int = SHARD_WORDS) -> DataFrame:
    """(word, n) -> word, n, n_near, form, form_n: the near word of largest n, if that is FORM_FACTOR times the word's at least."""
    tries = materialize(shards(words, size), "spelling-tries")
    tasks = 1 + words.count() // TASK_WORDS
    found = [materialize(neighbours(words, block, tasks), "spelling-near") for block in blocks(tries, most)]
    if not found:
        return words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))
    all_ = found[0]
    for f in found[1:]:
        all_ = all_.unionByName(f)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    near = all_.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x"))
    joined = words.join(near, "word", "left")
    ok = -F.col("x.m") >= FORM_FACTOR * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(ok, F.col("x.best")).alias("form"), F.when(ok, -F.col("x.m")).alias("form_n"))


def roots(found: DataFrame, max_rounds: int = 64) -> DataFrame:
    """found: (word, form, ...) with root, the last word that forms lead to. A form's n is twice the word's at least, so forms have no cycle; paths halve each round."""
    up = materialize(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(max_rounds):
        step = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = materialize(up.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = nxt.where("moved").limit(1).count()
        discard(up)
        up = nxt.drop("moved")
        if not moved:
            break
    else:
        raise RuntimeError(f"roots still move after {max_rounds} rounds")
    return found.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, most: int = BLOCK_BYTES, size: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, text) -> word, form, root, n, n_near, form_n, one row a word of the whole corpus.

    Null and empty texts have no words; a null doc_id is hashed as an empty string;
    repeated rows count as often as they stand. Ties of the largest n go to the
    first word in code-point order. Other columns are ignored.
    """
    words = materialize(vocabulary(docs), "spelling-words")
    found = materialize(forms(words, most, size), "spelling-forms")
    return roots(found).select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
