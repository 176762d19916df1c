"""Logs of whole blocks that can be cut back to the last sound one, and pointers that one writer at a time moves."""

from __future__ import annotations

import hashlib

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boundary import AnswerStore, _files, commit, manifest

#: What Spark says of a file that is gone, empty or cut short (fixed values). Any other failure is no proof of a tear.
TORN = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "is not a Parquet file", "FileNotFoundException")


class Conflict(RuntimeError):
    """Another writer was first; nothing was written."""


class BlockLog:
    """Blocks 0, 1, 2, ... under path, each a commit: rows and a manifest over all their columns, vectors included."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.blocks = AnswerStore(spark, path).commits

    def append(self, rows: DataFrame) -> str:
        name = f"{len(self.blocks()):08d}"
        if not commit(rows, self.path, name):
            raise Conflict(f"{self.path}: {name} is there")
        return name

    def rows(self) -> DataFrame:
        """All blocks' rows with `block`. Drafts of writers that died are no part of it."""
        frames = [self.spark.read.parquet(f"{self.path}/{n}/data").withColumn("block", F.lit(n)) for n in self.blocks()]
        if not frames:
            raise ValueError(f"{self.path}: no block")
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def sound(self, name: str) -> bool:
        """Whether a block's rows are those of its manifest."""
        try:
            said = self.spark.read.parquet(f"{self.path}/{name}/manifest").first()
            return said is not None and tuple(manifest(self.spark.read.parquet(f"{self.path}/{name}/data")).first()) == tuple(said)
        except (PySparkException, Py4JJavaError) as e:
            if any(word in str(e) for word in TORN):
                return False
            raise

    def orphans(self) -> list[str]:
        """Drafts that no commit took: of writers that died, or that are still at work."""
        fs, at = _files(self.spark, self.path)
        return sorted(n for s in fs.listStatus(at) if (n := s.getPath().getName()).startswith("_draft-")) if fs.exists(at) else []

    def repair(self) -> list[str]:
        """Takes the first block that is unsound or out of turn, and all after it, out of the log; they stay as `_cut-` folders. Returns their names."""
        names = self.blocks()
        keep = next((i for i, n in enumerate(names) if n != f"{i:08d}" or not self.sound(n)), len(names))
        for name in reversed(names[keep:]):  # from the end: a repair that dies leaves a log without a gap
            fs, at = _files(self.spark, f"{self.path}/{name}")
            i = 0
            while fs.exists(to := _files(self.spark, f"{self.path}/_cut-{name}-{i}")[1]):
                i += 1
            if not fs.rename(at, to):
                raise RuntimeError(f"{self.path}: {name} could not be moved")
        return names[keep:]

    def final_hash(self) -> str:
        """A chain over the manifests in order: equal for logs of equal blocks. One small row a block is read."""
        out = hashlib.sha256()
        for name in self.blocks():
            out = hashlib.sha256(f"{out.hexdigest()}:{tuple(self.spark.read.parquet(f'{self.path}/{name}/manifest').first())}".encode())
        return out.hexdigest()


class Generations:
    """Which generation of each video is active. A version is one commit, so readers see a whole one, and only one writer can follow a version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = AnswerStore(spark, path).commits

    def current(self) -> tuple[int, DataFrame]:
        """The newest version, 0 for none yet, and its rows (video_id, generation)."""
        names = self.versions()
        if not names:
            return 0, self.spark.createDataFrame([], "video_id string, generation long")
        return len(names), self.spark.read.parquet(f"{self.path}/{names[-1]}/data")

    def activate(self, wanted: DataFrame, states: DataFrame, expected: int) -> int:
        """Makes wanted (video_id, generation) active for its videos, if the version is still the expected one; returns the new version.

        states: (video_id, generation, state). A generation that isn't complete, or a
        video that is wanted with two, is an error. If another writer was first, that
        is a Conflict, and this one reads again and decides anew.
        """
        version, held = self.current()
        if version != expected:
            raise Conflict(f"{self.path}: version {version}, not {expected}")
        done = states.where("state = 'complete'").select("video_id", "generation").distinct()
        refused = wanted.join(done, ["video_id", "generation"], "left_anti").limit(5).collect()
        twice = wanted.groupBy("video_id").agg(F.countDistinct("generation").alias("n")).where("n > 1").limit(5).collect()
        if refused or twice:
            raise ValueError(f"not complete: {[tuple(r) for r in refused]}; wanted twice: {[r['video_id'] for r in twice]}")
        new = wanted.select("video_id", "generation").distinct()
        rows = held.join(new.select("video_id"), "video_id", "left_anti").unionByName(new)
        if not commit(rows, self.path, f"{version:08d}"):
            raise Conflict(f"{self.path}: another writer made version {version + 1}")
        return version + 1
