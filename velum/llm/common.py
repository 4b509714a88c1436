"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty() and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="velum-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    That cuts the lineage, so a lost executor costs one read, and what several
    branches of a plan use is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/velum/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_groups(sizes: Sequence[int], limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that have at most ``limit`` characters together, or are a single text."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_parts(texts: pa.Array, limit: int = 1 << 22) -> Iterator[list[str | None]]:
    """``texts`` as lists of at most ``limit`` bytes together, or of a single text, so that not all are Python strings at once."""
    for a, b in text_groups(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), limit):
        yield texts.slice(a, b - a).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
