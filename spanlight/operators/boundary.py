"""Boundaries to models that a caller injects, and a store that keeps what they said.

Models run where Spark puts them: in Arrow batches inside tasks. A bad row costs
that row, not its batch. What a model has answered is written once, under the
digest of its request; later runs read it and call nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialize

#: Frames that a verifier takes (fixed values), and buckets of a store.
FEWEST, MOST, BUCKETS = 8, 24, 256

ENCODED = "id long, vector array<double>, error string"


def encode(rows: DataFrame, encoder: Callable[[list], np.ndarray], size: int = 256) -> DataFrame:
    """rows: (id, payload). ENCODED rows: the payload's vector at length 1, or why there is none.

    encoder: a list of payloads -> a matrix. A batch on which it fails is halved until
    the bad rows stand alone. A vector that is zero or not finite is an error, and
    so is a null payload, which no encoder sees.
    """

    def vectors(ids: list, payloads: list) -> Iterator[tuple]:
        try:
            found = np.asarray(encoder(payloads), dtype=np.float64)
            if found.ndim != 2 or len(found) != len(payloads):
                raise ValueError(f"an encoder gave {found.shape} for {len(payloads)} rows")
        except Exception as e:  # an encoder may raise anything
            if len(ids) == 1:
                yield ids[0], None, f"{type(e).__name__}: {e}"[:200]
            else:
                half = len(ids) // 2
                yield from vectors(ids[:half], payloads[:half])
                yield from vectors(ids[half:], payloads[half:])
            return
        for id_, v in zip(ids, found, strict=True):
            n = float(np.sqrt((v * v).sum()))
            ok = np.isfinite(n) and n > 0
            yield id_, (v / n).tolist() if ok else None, None if ok else "no_direction"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, size) for i in range(0, batch.num_rows, size)):
                ids, payloads = part.column(0).to_pylist(), part.column(1).to_pylist()
                there = [i for i, p in enumerate(payloads) if p is not None]
                out = [(ids[i], None, "null_payload") for i, p in enumerate(payloads) if p is None]
                if there:
                    out += vectors([ids[i] for i in there], [payloads[i] for i in there])
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.list_(pa.float64())), pa.array(c, pa.string())], ["id", "vector", "error"])

    return rows.select(F.col("id").cast("long"), "payload").mapInArrow(run, ENCODED)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def commit(df: DataFrame, path: str, name: str) -> bool:
    """Writes df and its manifest as the folder path/name by one rename; False, and nothing written, if it is there already.

    The manifest, one row, has the number of rows and a digest that doesn't depend
    on their order. Readers see both or neither.
    """
    spark, draft = df.sparkSession, f"{path}/_draft-{uuid.uuid4().hex}"
    df.write.parquet(f"{draft}/data")
    written = spark.read.schema(df.schema).parquet(f"{draft}/data")
    manifest(written).coalesce(1).write.parquet(f"{draft}/manifest")
    fs, to = _files(spark, f"{path}/{name}")
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(draft)
    # Unlike a file system's own rename, this one refuses a target that is there.
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(source, to, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        fs.delete(source, True)
        return False
    return True


def manifest(df: DataFrame) -> DataFrame:
    """(rows, digest): the digest is a sum over the rows' hashes of all columns."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def torn(spark: SparkSession, path: str, names: list[str]) -> list[str]:
    """The commits whose data no longer give their manifest."""
    out = []
    for name in names:
        said = spark.read.parquet(f"{path}/{name}/manifest").first()
        if tuple(manifest(spark.read.parquet(f"{path}/{name}/data")).first()) != tuple(said):
            out.append(name)
    return out


def request_digest(*parts: Column) -> Column:
    """A request's identity: its parts with their lengths, so that no two requests run together."""
    one = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*one), 256)


class AnswerStore:
    """Answers by request digest, in immutable commits; of several answers to one request the one of the first commit counts.

    Commits are folders, numbered; one is made by a rename, so two writers that take
    the same number can't both succeed, and the second one tries again after it.
    Rows are bucketed by digest, and a lookup reads the buckets of its requests only.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> list[str]:
        fs, at = _files(self.spark, self.path)
        if not fs.exists(at):
            return []
        return sorted(n for s in fs.listStatus(at) if not (n := s.getPath().getName()).startswith("_"))

    def answers(self) -> DataFrame | None:
        """(digest, answer), one row a digest; None where nothing is stored."""
        names = self.commits()
        if not names:
            return None
        rows = self.spark.read.parquet(*[f"{self.path}/{n}/data" for n in names])
        return rows.groupBy("digest").agg(F.min_by("answer", "commit").alias("answer"))

    def get(self, requests: DataFrame) -> DataFrame:
        """requests, with a digest column, and `answer`: null where none is stored."""
        known = self.answers()
        if known is None:
            return requests.withColumn("answer", F.lit(None).cast("string"))
        return requests.join(known, "digest", "left")

    def put(self, answers: DataFrame, tries: int = 10) -> DataFrame:
        """Stores (digest, answer) rows of digests not yet there. Returns the conflicts: (digest, stored, offered) where another answer holds."""
        for _ in range(tries):
            names = self.commits()
            known = self.answers()
            own = answers.where("digest IS NOT NULL AND answer IS NOT NULL").groupBy("digest").agg(F.min("answer").alias("answer"), F.max("answer").alias("other_"))
            new = own if known is None else own.join(known.select("digest"), "digest", "left_anti")
            name = f"{len(names):08d}"
            bucket = F.pmod(F.xxhash64("digest"), F.lit(BUCKETS))
            rows = new.select("digest", "answer", F.lit(name).alias("commit")).repartition(bucket).sortWithinPartitions("digest")
            if commit(rows, self.path, name):
                held = self.answers()
                offered = answers.select("digest", F.col("answer").alias("offered")).distinct()
                return offered.join(held.select("digest", F.col("answer").alias("stored")), "digest").where("offered <> stored").select("digest", "stored", "offered")
        raise RuntimeError(f"{self.path}: other writers took {tries} commits in turn")


SAID = "digest string, answer string, outcome string, calls int"


def verify(requests: DataFrame, call: Callable[[str, list[int], str | None], str], valid: Callable[[str], bool]) -> DataFrame:
    """requests: (digest, prompt, frames array<long>) -> SAID, one row a request.

    A request needs FEWEST to MOST frames, each later than the one before. call gets
    the prompt, the frames and what was wrong before, if anything. An answer that
    isn't valid is asked for once more, and a call that fails is made once more;
    after that the outcome names the failure and there is no answer.
    """

    def one(prompt: str, frames: list[int] | None) -> tuple[str | None, str, int]:
        if prompt is None or frames is None or not FEWEST <= len(frames) <= MOST or any(a is None or b is None or a >= b for a, b in zip(frames, frames[1:], strict=False)):
            return None, "invalid_request", 0
        wrong, retried, recovered, calls = None, False, False, 0
        while True:
            calls += 1
            try:
                answer = call(prompt, frames, wrong)
            except Exception as e:  # a model may raise anything
                if recovered:
                    return None, "system_failure", calls
                recovered, wrong = True, f"{type(e).__name__}: {e}"[:200]
                continue
            if valid(answer):
                return answer, "answered", calls
            if retried:
                return None, "invalid_answer", calls
            retried, wrong = True, "the answer doesn't fit the schema"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [one(p, f) for p, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.string()), pa.array([x[2] for x in said], pa.int32())], ["digest", "answer", "outcome", "calls"])

    return requests.select("digest", "prompt", "frames").mapInArrow(run, SAID)


def verify_cached(requests: DataFrame, store: AnswerStore, call: Callable, valid: Callable) -> DataFrame:
    """SAID rows; only requests without a stored answer are put to the model, and what it answers is stored. Equal requests are asked once."""
    met = store.get(requests.dropDuplicates(["digest"]))
    known = met.where("answer IS NOT NULL").select("digest", "answer", F.lit("stored").alias("outcome"), F.lit(0).alias("calls"))
    asked = materialize(verify(met.where("answer IS NULL"), call, valid), "verified")
    known = materialize(known, "known-answers")  # as it was before this run's answers
    store.put(asked.select("digest", "answer"))
    return known.unionByName(asked)
