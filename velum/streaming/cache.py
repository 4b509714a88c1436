"""Results of views kept in a folder, which go on from the age they were stored at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.operators.graph import latest
from velum.sources.log import complete_versions
from velum.streaming.live import resume


class ResultCache:
    """Views by name, each stored as of an age, the number of the last commit in it.

    A view is the newest commit of each key, if the predicate holds for it. The
    name must tell apart whatever differs: source and predicate. A folder counts
    once it is complete, so a broken write is as if it never was.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def age(self, name: str) -> int | None:
        return max(complete_versions(self.spark, f"{self.root}/{name}", "age"), default=None)

    def load(self, name: str) -> DataFrame | None:
        age = self.age(name)
        return None if age is None else self.spark.read.parquet(f"{self.root}/{name}/age{age}")

    def store(self, name: str, rows: DataFrame, age: int) -> DataFrame:
        path = f"{self.root}/{name}/age{age}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def view(self, name: str, commits: DataFrame, predicate: Column) -> DataFrame:
        """The view over all ``commits(key, id, ts, age, ...)``: as stored if nothing is newer, else with the newer commits only."""
        last = commits.agg(F.max("age")).first()[0] or 0
        age = self.age(name)
        if age is None:
            return self.store(name, latest(commits).filter(predicate), last)
        if age >= last:
            return self.load(name)
        return self.store(name, resume(self.load(name), commits, age, predicate), last)


def view_changes(before: DataFrame, after: DataFrame, key: str = "key") -> DataFrame:
    """``(key, change)``: what listeners of a view are told, ``added``, ``removed`` or ``changed``; a row that is the same is no change."""
    rest = [c for c in after.columns if c != key]
    sides = before.select(key, F.struct(*rest).alias("__before")).join(after.select(key, F.struct(*rest).alias("__after")), key, "full")
    change = F.when(F.col("__before").isNull(), "added").when(F.col("__after").isNull(), "removed").when(F.col("__before") != F.col("__after"), "changed")
    same = F.col("__before").eqNullSafe(F.col("__after"))
    return sides.filter(~same).select(key, F.coalesce(change, F.lit("changed")).alias("change"))
