"""Live views by Structured Streaming: heads of late and repeated commits, and views that follow them (T rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from velum.sources.log import complete_versions


class LiveHeads:
    """A table with the newest commit of each key, kept up to date by micro-batches.

    A commit may be late or repeated: the one with the greatest (ts, id) stays,
    without a watermark. Each batch joins the table with the keys it touches and
    writes the next version of it, which counts once it is complete. A new
    instance goes on from the last complete version, and the stream from its
    checkpoint in the same folder; a batch that is applied twice changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.version = max(complete_versions(spark, self.root, "v"), default=0)

    def table(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/v{self.version}") if self.version else None

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        now = self.table()
        rows = batch if now is None else now.unionByName(batch)
        rest = [c for c in rows.columns if c != "key"]
        newest = rows.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("ts", "id")).alias("c")).select("key", "c.*")
        newest.select(*batch.columns).write.mode("overwrite").parquet(f"{self.root}/v{self.version + 1}")
        self.version += 1

    def start(self, stream: DataFrame, checkpoint: str | None = None) -> StreamingQuery:
        where = checkpoint or f"{self.root}/checkpoint"
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", where).trigger(availableNow=True).start()


def follow(spark: SparkSession, folder: str, files: str, root: str, change: Callable[[DataFrame], DataFrame], at_once: int = 1) -> DataFrame:
    """Stream a folder's Parquet files of some name through ``LiveHeads`` to their end and return the heads."""
    schema = spark.read.parquet(f"{folder}/{files}").schema
    live = LiveHeads(spark, root)
    live.start(change(spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).option("pathGlobFilter", files).parquet(folder))).awaitTermination()
    return live.table()


def view(heads: DataFrame, predicate: Column) -> DataFrame:
    return heads.filter(predicate)


def resume(view_now: DataFrame, commits: DataFrame, age: int, predicate: Column, key: str = "key") -> DataFrame:
    """A view's rows after the commits behind ``age``: those of touched keys are decided anew.

    ``commits`` are all commits: one behind ``age`` may be older than the head
    that its key had, which the view doesn't show where the predicate failed.
    """
    touched = commits.filter(F.col("age") > age).select(key).distinct()
    rest = [c for c in commits.columns if c != key]
    newest = commits.join(touched, key, "left_semi").groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts", "id")).alias("c")).select(key, "c.*")
    return view_now.join(touched, key, "left_anti").unionByName(newest.filter(predicate).select(*view_now.columns))
