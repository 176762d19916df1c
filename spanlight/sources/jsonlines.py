"""JSON lines with the file and line of what is malformed, for files that are read in many parts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, nth, value): each line with the byte where its part of the file begins, and its place in that part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for batch in batches:
            nth = []
            for at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = n + 1 if at == now else 1
                now = at
                nth.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nth, pa.int64()), batch.column(2)], ["file", "part", "nth", "value"])

    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), "value")
    return text.mapInArrow(run, "file string, part long, nth long, value string")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value), lines from 1. A part's first number is the sum of the lines of the parts before it: a window over one row a part."""
    lines = _lines(spark, path)
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("file", "part").agg(F.count("*").alias("n_")).select("file", "part", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    return lines.join(counts, ["file", "part"]).select("file", (F.col("before_") + F.col("nth")).alias("line"), "value")


def json_lines_checked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a declared schema. Malformed lines are an error that names file and line of the first five; empty lines are passed over.

    Lines are numbered only where some line is malformed.
    """
    bad = "malformed_line_"
    wide = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    said = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    # A top-level array or scalar is no row either: such a line has no object.
    wrong = (F.trim("value") != "") & (said.isNull() | said[bad].isNotNull() | ~F.ltrim("value").startswith("{"))
    lines = spark.read.text(path)
    if lines.where(wrong).limit(1).count():
        found = numbered(spark, path).where(wrong).orderBy("file", "line").limit(5).collect()
        raise ValueError("malformed JSON: " + "; ".join(f"{r['file']}:{r['line']}: {r['value'][:60]}" for r in found))
    return lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("row")).select("row.*")
