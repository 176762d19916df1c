"""A positional text index in blocks of documents: phrases, prefixes, and BM25 that skips blocks that can't matter.

A posting block holds one term's documents out of WIDTH consecutive ids: offsets of
the ids from the block's first, lengths and counts of the documents, and places as
steps from the one before. All terms of a block stand in one Parquet file, sorted by
term. A segment is one commit; appending adds a segment and rewrites nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize
from . import boundary

#: Ids a block spans, and what a word is (fixed values); only A-Z are lower-cased.
WIDTH, WORD = 1024, r"[\p{L}\p{N}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Scores are sums of whole units of this, so they don't depend on the order of summing.
UNIT = 1_000_000_000

BLOCK = "term string, block long, segment string, offsets array<int>, lengths array<int>, counts array<int>, steps array<int>, n int, most int, shortest int"


def words(text: Column) -> Column:
    """The words of a text in order; of null none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({WORD})"), 1), F.array().cast("array<string>"))


def _posted(docs: pa.Table, block: int, segment: str) -> pa.RecordBatch:
    """(doc, words) of one block, sorted by doc -> its posting blocks, a row a term; and one without a term that holds all documents."""
    doc, held = docs["doc"].to_numpy(), docs["words"].combine_chunks()
    if (doc[1:] == doc[:-1]).any():
        raise ValueError("a document is there twice")
    length, offset = held.value_lengths().to_numpy().astype(np.int32), (doc - block * WIDTH).astype(np.int32)
    named = held.flatten().dictionary_encode()
    code = named.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    of = np.repeat(np.arange(len(doc), dtype=np.int32), length)[order]
    at = (np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)[order]
    code = code[order]
    fresh = np.append(True, (code[1:] != code[:-1]) | (of[1:] != of[:-1])) if len(code) else np.zeros(0, bool)
    steps = np.where(fresh, at, at - np.append(0, at[:-1])).astype(np.int32) if len(code) else at
    first = np.flatnonzero(fresh)  # of each term and document
    counts = np.diff(np.append(first, len(code))).astype(np.int32)
    start = np.flatnonzero(np.append(True, code[first][1:] != code[first][:-1])) if len(first) else first  # of each term, among these
    n = np.diff(np.append(start, len(first)))
    lists = lambda cuts, none, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0, none], none + cuts]), pa.int32()), pa.array(values, pa.int32()))
    docs_of, cuts = of[first], np.append(start[1:], len(first)) if len(start) else start
    whole = np.append(first[start[1:]], len(code)) if len(start) else start
    most, least = (f.reduceat(x, start) if len(start) else start for f, x in ((np.maximum, counts), (np.minimum, length[docs_of])))
    out = {
        "term": pa.concat_arrays([pa.nulls(1, pa.string()), named.dictionary.cast(pa.string())]), "block": pa.array(np.full(len(n) + 1, block), pa.int64()), "segment": pa.array([segment] * (len(n) + 1)),
        "offsets": lists(cuts, len(doc), np.concatenate([offset, offset[docs_of]])), "lengths": lists(cuts, len(doc), np.concatenate([length, length[docs_of]])), "counts": lists(cuts, len(doc), np.concatenate([np.zeros(len(doc), np.int32), counts])),
        "steps": lists(whole, 0, steps), "n": pa.array(np.append(len(doc), n), pa.int32()), "most": pa.array(np.append(0, most), pa.int32()), "shortest": pa.array(np.append(length.min(), least), pa.int32()),
    }
    return pa.RecordBatch.from_arrays(list(out.values()), list(out))


def blocks(docs: DataFrame, segment: str) -> DataFrame:
    """Posting blocks of (doc, text), a file's sorted by term. Two rows of one doc are an error.

    Texts are shuffled once, to the task of their block, which writes the block's postings
    whole: a task holds the words of one block of WIDTH documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # of the block that may go on in the next batch
        last = None
        for batch in batches:
            block = batch.column(0).to_numpy() // WIDTH
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and last != block[a]:
                    yield _posted(pa.concat_tables(held), int(last), segment)
                    held = []
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
                last = block[a]
        if held:
            yield _posted(pa.concat_tables(held), int(last), segment)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc", "text").repartition(parts, F.floor(F.col("doc") / WIDTH)).sortWithinPartitions("doc")
    return dealt.select("doc", words(F.col("text")).alias("words")).mapInArrow(run, BLOCK).sortWithinPartitions("term", "block")


class TextIndex:
    """Segments under path, in the order of their commits."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.commits = boundary.AnswerStore(spark, path).commits

    def append(self, docs: DataFrame, id_: str, text: str) -> str:
        """Indexes whole texts as a new segment and returns its name. Null ids are left out; a null text is an empty one.

        An id that is indexed already, or twice in docs, is an error and nothing is
        written. Of two writers who take one number the second fails and may try again.
        """
        names = self.commits()
        own = docs.where(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("doc"), F.col(text).alias("text"))
        if names:
            old = self.rows().where("term IS NULL").select("block", F.explode("offsets").alias("offset")).select((F.col("block") * WIDTH + F.col("offset")).alias("doc"))
            if again := [r[0] for r in own.select("doc").join(old, "doc", "left_semi").limit(5).collect()]:
                raise ValueError(f"indexed already: {again}")
        name = f"{len(names):08d}"
        if not boundary.commit(blocks(own, name), self.path, name):
            raise RuntimeError(f"{self.path}: another writer took {name}")
        return name

    def rows(self) -> DataFrame:
        names = self.commits()
        if not names:
            raise ValueError(f"{self.path}: no segment")
        return self.spark.read.parquet(*[f"{self.path}/{n}/data" for n in names])

    def _at_blocks(self, columns: list[str], where: DataFrame, run, schema: str) -> DataFrame:
        """run(postings, rows of where) for each block: postings go to the task of their block once, however many queries look at it."""
        place = ["segment", "block"]
        lists = self.rows().where("term IS NOT NULL").select(*place, "term", *columns)
        return lists.groupBy(*place).cogroup(where.groupBy(*place)).applyInArrow(run, schema)

    def phrase(self, queries: DataFrame) -> DataFrame:
        """queries: (query_id, phrase, prefix boolean) -> (query_id, doc, n): how often a document has the phrase's words in a row.

        With prefix the last word may go on. Equal phrases are looked for once. A block
        gets those phrases all whose words it has, which is found without the places; so what
        is shuffled are the index and a row a phrase and block, no places a phrase.
        A phrase without a word, and one of a null query_id, is found nowhere.
        """
        asked = queries.select("query_id", words(F.col("phrase")).alias("said"), F.coalesce("prefix", F.lit(False)).alias("open")).where(F.size("said") > 0)
        phrases = materialize(asked.groupBy("said", "open").agg(F.collect_set("query_id").alias("ids")).withColumn("key", F.monotonically_increasing_id()), "phrases")
        each = phrases.select("key", "open", F.size("said").alias("size_"), F.posexplode("said").alias("at_", "term"))
        items = each.select("key", "term", (F.col("open") & (F.col("at_") == F.col("size_") - 1)).alias("open_")).distinct()
        has = self.rows().where("term IS NOT NULL").select("term", "segment", "block")
        # A word is met by those of its beginnings that are as long as a wanted one: there are as many as wanted lengths.
        begins = items.where("open_").select(F.col("term").alias("begin_")).distinct()
        sizes = F.broadcast(begins.select(F.length("begin_").alias("size_")).distinct())
        cut = has.join(sizes, F.length("term") >= F.col("size_")).select(F.expr("left(term, size_)").alias("begin_"), "segment", "block").distinct()
        begun = cut.join(begins, "begin_").select(F.col("begin_").alias("term"), "segment", "block", F.lit(True).alias("open_"))
        met = items.join(has.withColumn("open_", F.lit(False)).unionByName(begun), ["term", "open_"]).groupBy("key", "segment", "block").agg(F.count("*").alias("have_"))
        whole = met.join(items.groupBy("key").agg(F.count("*").alias("need_")), "key").where("have_ = need_").select("key", "segment", "block")
        where = whole.join(phrases, "key").select("segment", "block", "said", "open", "ids")
        return self._at_blocks(["offsets", "counts", "steps"], where, _in_a_row, "query_id long, doc long, n long")

    def ranked(self, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """queries: (query_id, text) -> (query_id, rank, doc, score): the k documents of greatest BM25 score, ties to the smaller id.

        Every block has a greatest score that its counts and lengths allow. The blocks
        of the k greatest ones are scored first; the k-th best score found there is
        what any other block must be able to reach. So the result is exact, and blocks
        that can't reach it are never scored. A block scores all its queries in one task and
        hands on the k best of each. Words that a query repeats count once; queries of the same words are one.
        """
        store = self.rows()
        all_ = store.where("term IS NULL").agg(F.sum("n").alias("docs_"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("words_")).first()
        docs, mean = all_["docs_"] or 0, (all_["words_"] or 0) / max(all_["docs_"] or 1, 1)
        asked = queries.select("query_id", F.array_sort(F.array_distinct(words(F.col("text")))).alias("said")).where(F.size("said") > 0)
        asked = materialize(asked.groupBy("said").agg(F.collect_set("query_id").alias("ids")).withColumn("key", F.monotonically_increasing_id()), "asked")
        terms = asked.select("key", F.explode("said").alias("term"))
        store = store.where("term IS NOT NULL").join(terms.select("term").distinct(), "term", "left_semi")
        df = store.groupBy("term").agg(F.sum("n").alias("df_"))
        weights = materialize(terms.join(df, "term").select("key", "term", F.log(1 + (docs - F.col("df_") + 0.5) / (F.col("df_") + 0.5)).alias("idf_")), "weights")
        units = lambda tf, length: F.col("idf_") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)) * UNIT

        most = F.ceil(units(F.col("most"), F.col("shortest"))) + 1
        bounds = weights.join(store.select("term", "segment", "block", "most", "shortest"), "term").groupBy("key", "segment", "block").agg(F.sum(most).alias("bound_"))
        bounds = materialize(bounds, "bounds")
        first = bounds.withColumn("r_", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("bound_"), "segment", "block"))).where(F.col("r_") <= k)
        said = weights.groupBy("key").agg(F.collect_list("term").alias("terms"), F.collect_list("idf_").alias("idfs"))

        def scored(chosen: DataFrame) -> DataFrame:
            where = chosen.join(said, "key").select("segment", "block", "key", "terms", "idfs", "reach_")
            return self._at_blocks(["offsets", "lengths", "counts"], where, _scorer(k, k1, b, mean), "key long, doc long, score_ long")

        def best(rows: DataFrame) -> DataFrame:
            order = Window.partitionBy("key").orderBy(F.desc("score_"), "doc")
            return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        reach = best(scored(first.withColumn("reach_", F.lit(0).cast("long")))).where(F.col("rank") == k).select("key", F.col("score_").alias("reach_"))
        able = bounds.join(reach, "key", "left").where(F.col("reach_").isNull() | (F.col("bound_") >= F.col("reach_"))).withColumn("reach_", F.coalesce("reach_", F.lit(0)))
        found = best(scored(able)).join(asked.select("key", "ids"), "key")
        return found.select(F.explode("ids").alias("query_id"), "rank", "doc", (F.col("score_") / UNIT).alias("score"))


def _scorer(k: int, k1: float, b: float, mean: float):
    """The k best documents of a block for each of its queries, of those that reach what the query asks for."""

    def run(lists: pa.Table, queries: pa.Table) -> pa.Table:
        row = {t: i for i, t in enumerate(lists["term"].to_pylist())} if queries.num_rows else {}
        offsets, lengths, counts = (lists[c].combine_chunks() for c in ("offsets", "lengths", "counts"))
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def unit(term: str, idf: float) -> tuple[np.ndarray, np.ndarray]:
            if term not in known:
                at, length, tf = (c[row[term]].values.to_numpy(zero_copy_only=False).astype(kind) for c, kind in ((offsets, np.int64), (lengths, np.float64), (counts, np.float64)))
                x = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)) * UNIT
                low = np.floor(x)
                known[term] = at, (low + (x - low >= 0.5)).astype(np.int64)  # halves go up, as Spark's round does
            return known[term]

        out: list[list[np.ndarray]] = [[], [], []]
        place = lists["block"][0].as_py() * WIDTH if lists.num_rows else 0
        for key, terms, idfs, reach in zip(*(queries[c].to_pylist() for c in ("key", "terms", "idfs", "reach_")), strict=True):
            score = np.zeros(WIDTH, np.int64)
            seen = np.zeros(WIDTH, bool)
            for term, idf in zip(terms, idfs, strict=True):
                if term in row:
                    at, add = unit(term, idf)
                    score[at] += add
                    seen[at] = True
            at = np.flatnonzero(seen & (score >= reach))
            if len(at) > k:
                at = at[score[at] >= np.partition(score[at], -k)[-k]]
                at = at[np.argsort(-score[at], kind="stable")[:k]]
            for column, x in zip(out, (np.full(len(at), key, np.int64), place + at, score[at]), strict=True):
                column.append(x)
        cat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        return pa.table([cat(c) for c in out], ["key", "doc", "score_"])

    return run


def _in_a_row(lists: pa.Table, phrases: pa.Table) -> pa.Table:
    """A block's postings and phrases -> for each query and document how many starts all words of the phrase agree on."""
    lists = lists.sort_by("term") if phrases.num_rows else lists.slice(0, 0)
    ordered = lists["term"].to_pylist()
    flat = lambda c: lists[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    counts, step = flat("counts"), flat("steps")
    # Document and place of each occurrence in one number, for all terms in order at once.
    total, begin = np.cumsum(step), np.cumsum(counts) - counts
    every = (np.repeat(flat("offsets"), counts) << 32) | (total - np.repeat(total[begin] - step[begin], counts))
    ends = np.concatenate([[0], np.cumsum(lists["steps"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))])
    known: dict[tuple[str, bool], np.ndarray] = {}

    def places(term: str, is_open: bool) -> np.ndarray:
        """Where a term, or any that begins with it, stands; sorted. No word holds the last code point."""
        if (term, is_open) not in known:
            lo = bisect_left(ordered, term)
            hi = bisect_left(ordered, term + "\U0010ffff") if is_open else lo + (ordered[lo : lo + 1] == [term])
            held = every[ends[lo] : ends[hi]]
            known[term, is_open] = np.sort(held) if hi - lo > 1 else held
        return known[term, is_open]

    out: list[list[np.ndarray]] = [[], [], []]
    place = lists["block"][0].as_py() * WIDTH if lists.num_rows else 0
    for said, is_open, ids in zip(*(phrases[c].to_pylist() for c in ("said", "open", "ids")), strict=True):
        each = sorted(((places(w, is_open and i == len(said) - 1), i) for i, w in enumerate(said)), key=lambda x: len(x[0]))
        common, i = each[0]
        common = common[(common & 0xFFFFFFFF) >= i] - i
        for held, i in each[1:]:
            if not len(common):
                break
            at = np.searchsorted(held, common + i)
            common = common[held[np.minimum(at, len(held) - 1)] == common + i]
        docs, n = np.unique(common >> 32, return_counts=True)
        for column, x in zip(out, (np.repeat(np.array(ids, np.int64), len(docs)), np.tile(place + docs, len(ids)), np.tile(n, len(ids))), strict=True):
            column.append(x)
    cat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
    return pa.table([cat(c) for c in out], ["query_id", "doc", "n"])
