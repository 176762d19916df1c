"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are measured on a sample inside Spark tasks,
on documents that pass the base and of which the base's statistics are known, as
the cascade finds them; a rule's rate is that on what the rules before it leave.
Rules then run in the order of rejection per cost, and the first that rejects ends
a document's cascade, so statistics that only later rules need are
never computed. The order changes what is computed, never the verdict.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from copy import copy
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the base statistics.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: About so many rows make up the sample for costs and selectivity.
SAMPLE_ROWS = 2000


class Doc:
    """A text and its statistics, each computed when first asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # bytes.split() parts at exactly the six ASCII spaces

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return self.text.split("\n")

    @cached_property
    def n_dup_lines(self) -> int:
        seen: set[str] = set()
        dup = 0
        if len(self.lines) > 1:
            for line in self.lines:
                if line.strip(SPACES):
                    if line in seen:
                        dup += 1
                    else:
                        seen.add(line)
        return dup

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def kinds(self) -> dict[bytes, int]:
        return Counter(self.words)

    @property
    def base_failed(self) -> bool:
        return len(self.words) < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * len(self.words)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words found twice or more.

    Windows are compared by exact codes: a window's code is the pair of its
    first half's rank and its next word, ranked again where it could overflow.
    """
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    vocabulary, window, base = len(ids), code, len(ids)
    for k in range(1, width):
        if base * vocabulary >= 1 << 62:
            window = np.unique(window, return_inverse=True)[1].astype(np.int64)
            base = n
        window = window[: n - k] * vocabulary + code[k : k + n - k]
        base *= vocabulary
    _, which, counts = np.unique(window, return_inverse=True, return_counts=True)
    found = (counts > 1)[which].astype(np.int8)
    if not found.any():
        return 0
    edges = np.zeros(n + 1, dtype=np.int64)
    edges[: n - width + 1] += found
    edges[width : n + 1] -= found
    return int((np.cumsum(edges[:n]) > 0).sum())


def _few_letters(d: Doc) -> bool:
    """Under 60 % of the words have a letter."""
    return 10 * sum(1 for w in d.words if _LETTER.search(w.decode("utf-8", "replace"))) < 6 * len(d.words)


def _share(d: Doc, shape, tenths: int) -> bool:
    """Whether more than so many tenths of the lines have the shape."""
    return 10 * sum(1 for x in d.lines if shape.search(x)) > tenths * len(d.lines)


_LETTER, _UPPER = regex.compile(r"\p{L}"), regex.compile(r"\p{Lu}")
_BULLET, _TRAILING, _CONTROL = re.compile(r"\A[ \t]*[-*\u2022]"), re.compile(r"(?:\.\.\.|\u2026)[ \t]*\Z"), re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")

#: Name -> True where the document is rejected. Each sees whole texts.
RULES: dict[str, Callable[[Doc], bool]] = {
    "symbols": lambda d: 2 * d.n_symbols > len(d.words),
    "duplicate_lines": lambda d: 2 * d.n_dup_lines > len(d.lines),
    "word_length": lambda d: not 2 * len(d.words) <= d.word_chars <= 20 * len(d.words),
    "few_letters": _few_letters,
    "shouting": lambda d: 2 * len(_UPPER.findall(d.text)) > d.word_chars,
    "few_kinds_of_words": lambda d: 20 * len(d.kinds) < len(d.words) < 2000,
    "one_word": lambda d: 10 * max(d.kinds.values(), default=0) > 3 * len(d.words),
    "bullets": lambda d: _share(d, _BULLET, 9),
    "cut_off_lines": lambda d: _share(d, _TRAILING, 3),
    "control_characters": lambda d: 100 * len(_CONTROL.findall(d.text)) > d.word_chars,
}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents that pass the base: how many each set of rules rejects (bit i: rule i), and what every rule took on them."""
    tally: dict[int, list[int]] = {}
    for batch in batches:
        for text in batch.column(0).to_pylist():
            doc = Doc(text)
            if doc.base_failed:
                continue
            said, took = 0, []
            for i, rejects in enumerate(RULES.values()):
                own = copy(doc)  # has what the base computed, and nothing of other rules
                began = time.perf_counter_ns()
                said |= int(rejects(own)) << i
                took.append(time.perf_counter_ns() - began)
            t = tally.setdefault(said, [0] * (1 + len(RULES)))
            for i, x in enumerate([1, *took]):
                t[i] += x
    rows = [(said, i, t[0], t[1 + i]) for said, t in tally.items() for i in range(len(RULES))]
    yield pa.RecordBatch.from_pydict({name: pa.array([r[j] for r in rows], pa.int64()) for j, name in enumerate(("said", "rule", "n", "ns"))})


def order_rules(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rules by rejection per cost, best first, as measured on about sample_rows rows; ties by name.

    An empty sample leaves the rules in the order of their names.
    """
    n = docs.count()
    picked = docs.select("text").sample(fraction=min(1.0, sample_rows / max(n, 1)), seed=7)
    rows = picked.mapInArrow(_measure, "said long, rule long, n long, ns long").groupBy("said", "rule").agg(F.sum("n").alias("n"), F.sum("ns").alias("ns")).collect()
    return best_order([(r["said"], r["rule"], r["n"], r["ns"]) for r in rows])


def best_order(rows: list[tuple[int, int, int, int]]) -> list[str]:
    """rows: (rules that reject, as bits; a rule; documents; nanoseconds). Greedy: the next rule is the one that rejects most per cost of what the rules before it leave.

    A rule's rate is (rejected + 1) of (documents + 2), so one that rejects nothing has a place too.
    """
    names, out = list(RULES), []
    while len(out) < len(names):
        done = sum(1 << names.index(x) for x in out)
        worth = {}
        for i, name in enumerate(names):
            if name not in out:
                left = [(said, n, ns) for said, rule, n, ns in rows if rule == i and not said & done]
                n = sum(x[1] for x in left)
                rejected = sum(x[1] for x in left if x[0] >> i & 1)
                cost = max(sum(x[2] for x in left) / n, 1.0) if n else 1.0
                worth[name] = (rejected + 1) / (n + 2) / cost
        out.append(min(worth, key=lambda name: (-worth[name], name)))
    return out


def first_rejecting(doc: Doc, rules: list[str]) -> str | None:
    """The first rule in the order that rejects; `base` where the base fails."""
    return "base" if doc.base_failed else next((name for name in rules if RULES[name](doc)), None)


def cascade(docs: DataFrame, order: list[str]) -> DataFrame:
    """(doc_id, text) -> doc_id, kept, rejected_by: the rule that ended the document's cascade, or null. Null and empty texts fail the base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                by = [first_rejecting(Doc(t), order) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([b is None for b in by], pa.bool_()), pa.array(by, pa.string())], ["doc_id", "kept", "rejected_by"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, kept boolean, rejected_by string")


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge(docs: DataFrame, order: list[str]) -> DataFrame:
    """(doc_id, text) -> the base statistics and verdict of every row.

    A null or empty text has no words, fails the base and isn't kept. Repeated
    rows and null ids pass through row by row. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in OUT.split(", ")]
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                out: list[list] = [part.column(0).to_pylist(), *([] for _ in names[1:])]
                for text in part.column(1).to_pylist():
                    doc = Doc(text)
                    kept = first_rejecting(doc, order) is None
                    for column, value in zip(out[1:], (len(doc.words), doc.word_chars, doc.n_symbols, doc.n_dup_lines, doc.n_repeat_words, doc.base_failed, kept), strict=True):
                        column.append(value)
                kinds = [pa.int64()] * 6 + [pa.bool_()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, OUT)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, order_rules(docs))


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
w AS (
  SELECT r, i, lead(w, 0) OVER o || chr(10) || lead(w, 1) OVER o || chr(10) || lead(w, 2) OVER o || chr(10) || lead(w, 3) OVER o || chr(10) || lead(w, 4) OVER o AS win
  FROM (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d) WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM (SELECT r, i, win, count(*) OVER (PARTITION BY r, win) AS n FROM w WHERE win IS NOT NULL) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY r),
lined AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(lines) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (
  SELECT d.r, doc_id, text, words, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines, len(list_distinct(words)) AS n_kinds,
         len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_lettered,
         coalesce(list_max(map_values(list_aggregate(words, 'histogram'))), 0) AS n_top,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[-*\x{2022}]'))) AS n_bullets,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[ \t]*$'))) AS n_cut,
         length(text) - length(regexp_replace(text, '[\x00-\x08\x0e-\x1f\x7f]', '', 'g')) AS n_control,
         length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_upper
  FROM d LEFT JOIN covered USING (r) LEFT JOIN lined USING (r)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (2 * n_symbols > n_words) AND NOT (2 * n_dup_lines > n_lines)
       AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND NOT (10 * n_lettered < 6 * n_words)
       AND NOT (2 * n_upper > word_chars) AND NOT (20 * n_kinds < n_words AND n_words < 2000)
       AND NOT (10 * n_top > 3 * n_words) AND NOT (10 * n_bullets > 9 * n_lines) AND NOT (10 * n_cut > 3 * n_lines)
       AND NOT (100 * n_control > word_chars) AS kept
FROM failed
"""
