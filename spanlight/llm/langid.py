"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by FTRL-proximal with elastic-net penalties on a bounded sample of
labelled rows; document frequencies cover all rows that may be learnt from.
Probabilities are calibrated by one temperature.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: n-gram lengths, and hash buckets of all of them together.
ORDERS, BITS = (1, 2, 3), 16
#: The bound of the training sample, in rows over all languages, and the share of it kept for calibration.
MAX_TRAIN_ROWS, CALIBRATION = 1500, 0.2
#: FTRL-proximal: step, smoothing, L1 and L2; passes over the sample.
STEP, SMOOTH, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.005, 2
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> its lower case if it is a letter, else a space."""
    if not _LETTERS:
        t = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _LETTERS.append(t)
    return _LETTERS[0]


def buckets(text: str | None) -> np.ndarray:
    """Hash buckets of all n-grams of a whole text, repeats included; none if it has no letter.

    Runs of other characters than letters count as one space; letters are lower-cased.
    """
    if not text:
        return np.empty(0, dtype=np.uint32)
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    keep = c != 32
    if not keep.any():
        return np.empty(0, dtype=np.uint32)
    keep[1:] |= keep[:-1].copy()
    c = np.concatenate([[np.uint32(32)], c[keep], [np.uint32(32)]]).astype(np.uint32)
    out, h = [], np.zeros(len(c), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1)
        if n in ORDERS:
            out.append((h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))
    return np.concatenate(out)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    found = np.bincount(buckets(text), minlength=1 << BITS)
    at = np.flatnonzero(found)
    return at, found[at]


def features(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF values; the term frequency is 1 + ln(count)."""
    x = (1.0 + np.log(n)) * idf[at]
    norm = math.sqrt(float(x @ x))
    return x / norm if norm else x


@dataclass
class Model:
    """weights[bucket, language] are mostly zero rows; only the others are kept."""

    languages: list[str]
    idf: np.ndarray
    row: np.ndarray  # bucket -> row of weights, 0 for none
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        at, n = counted(text)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        z = (features(at, n, self.idf) @ self.weights[self.row[at]] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def held_out(doc_id) -> F.Column:
    """crc32 of the id's text, mod 3, is 1; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Per bucket the rows that have it, over all rows of docs, and the rows that have any. 2^BITS numbers, however many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                for text in part.column(0).to_pylist():
                    at = np.bincount(buckets(text), minlength=1 << BITS) > 0
                    seen += at
                    rows += bool(at.any())
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], rows), pa.int64())], ["bucket", "n"])

    df, rows = np.zeros(1 << BITS, dtype=np.int64), 0
    for r in docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] < 0:
            rows = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return df, rows


def training_sample(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """About max_rows labelled rows in expectation, languages alike: those of least id hash. Texts become counts in the tasks."""
    per_lang = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not per_lang:
        return []
    quota = max_rows / len(per_lang)
    share = F.lit(None).cast("double")
    for lang, n in per_lang.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, quota / n))).otherwise(share)
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(t) for t in batch.column(1).to_pylist()]
            packed = [pa.array([f[k].astype("<i4").tobytes() for f in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *packed], ["lang", "h", "at", "n"])

    picked = docs.where(u < share).select("lang", F.col("text").cast("string"), F.xxhash64("doc_id").alias("h"))
    rows = picked.mapInArrow(run, "lang string, h long, at binary, n binary").collect()
    return [(r["lang"], np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["n"], "<i4").astype(np.int64)) for r in sorted(rows, key=lambda r: (r["h"], r["lang"]))]


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """rows: (class, buckets, values). Weights [2^BITS, classes] and bias by per-coordinate FTRL-proximal.

    Each step's weights follow from the sums z and n alone: 0 where |z| is at most
    L1, which makes them sparse.
    """
    z = np.zeros(((1 << BITS) + 1, classes))
    n = np.zeros_like(z)

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((SMOOTH + np.sqrt(n[at])) / STEP + L2))

    for _ in range(EPOCHS):
        for y, at, x in rows:
            at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = np.outer(x, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / STEP
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm.

    A share of 1 in n + 2 of each target goes to the other languages (as Platt
    does), else rows without an error would call for certainty.
    """
    n, classes = logits.shape
    if classes < 2:
        return 1.0
    off = 1.0 / (n + 2)
    target = np.full((n, classes), off / (classes - 1))
    target[np.arange(n), y] = 1.0 - off

    def loss(t: float) -> float:
        s = logits / math.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - (target * s).sum(axis=1)))

    lo, hi, g = math.log(0.02), math.log(50.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def train(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """docs: (doc_id, text, lang). Learns from rows with an id, a language and a text with a letter, none of them held out.

    Without such rows the model knows no language and predicts `und`.
    """
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    df, rows = document_frequencies(usable)
    idf = np.log((1.0 + rows) / (1.0 + df)) + 1.0
    sample = [(lang, at, features(at, n, idf)) for lang, at, n in training_sample(usable, max_rows) if len(at)]
    languages = sorted({lang for lang, _, _ in sample})
    place = {lang: i for i, lang in enumerate(languages)}
    data = [(place[lang], at, x) for lang, at, x in sample]
    if not data:
        return Model([], idf, np.zeros(1, dtype=np.int32), np.zeros((1, 0)), np.zeros(0), 1.0)
    every = max(2, round(1 / CALIBRATION))
    kept, fit = data[::every], [d for i, d in enumerate(data) if i % every]
    w, bias = ftrl(fit or data, len(languages))
    logits = np.array([x @ w[at] + bias for _, at, x in kept])
    t = temperature(logits, np.array([y for y, _, _ in kept]))
    live = np.flatnonzero(np.any(w != 0, axis=1))
    row = np.zeros(1 << BITS, dtype=np.int32)
    row[live] = np.arange(1, len(live) + 1)
    return Model(languages, idf, row, np.vstack([np.zeros((1, len(languages))), w[live]]), bias, t)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and lang_pred, score (0 to 1; 0 for `und`).

    A text that is null or has no letter gets `und`. Repeated rows are predicted
    each; a column of docs named lang_pred or score is replaced.
    """
    docs = docs.drop("lang_pred", "score")
    schema, at = docs.schema, docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                said = [m.predict(t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    said = predict(docs.select("doc_id", "text"), train(docs))
    return said.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
