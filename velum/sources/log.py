"""The commit log: readers, the append sink, ingestion and arrival numbers (S rows)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.functions.columns import number_of


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or tempfile.mkdtemp(prefix="velum-")).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage."""
    path = f"{scratch_dir(df.sparkSession)}/velum-{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def complete_versions(spark: SparkSession, root: str, prefix: str) -> list[int]:
    """The numbers of the folders ``prefix`` and a number below ``root`` whose writing came to its end."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    path = make(root)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path)]
    return [int(p.getName()[len(prefix) :]) for p in found if re.fullmatch(f"{prefix}[0-9]+", p.getName()) and files.exists(make(p, "_SUCCESS"))]


def sample(entries: DataFrame, id_col: str, one_in: int, seed: int = 0) -> DataFrame:
    """One in so many entries, by a hash of the id, so that any run takes the same."""
    return entries.filter(number_of(F.col(id_col), seed) % one_in == 0)


def read_json_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A log of one JSON object a line, up to the first line that isn't complete.

    Lines are numbered within their file; those from a file's first broken line on are dropped.
    """
    lines = spark.read.text(path).withColumn("__file", F.col("_metadata.file_path")).withColumn("__at", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = lines.withColumn("__row", F.from_json("value", bad, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    cut = parsed.filter("__row._corrupt_record is not null").groupBy("__file").agg(F.min("__at").alias("__cut"))
    good = parsed.join(cut, "__file", "left").filter(F.col("__cut").isNull() | (F.col("__at") < F.col("__cut")))
    return good.select(*[F.col("__row")[f.name].alias(f.name) for f in schema.fields])


def append_new(existing: DataFrame, entries: DataFrame, id_col: str = "id") -> DataFrame:
    """Those entries, each id once, whose id is set and isn't in the log yet."""
    return entries.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col]).join(existing.select(id_col), id_col, "left_anti")


def ingest(existing: DataFrame, entries: DataFrame, namespaces: list[str], ns_col: str = "ns", id_col: str = "id") -> DataFrame:
    """New commits of allowed namespaces (S17, F17); a null namespace is never allowed."""
    return append_new(existing, entries.filter(F.col(ns_col).isin(*namespaces)), id_col)


def number_arrivals(df: DataFrame, ts: str = "ts", id_col: str = "id", out: str = "age") -> DataFrame:
    """``df`` numbered from 1 in the order of (ts, id), without bringing it into one task.

    Rows are dealt out by ranges of (ts, id) and written with their range;
    ranges are counted and added up, and rows numbered within them.
    """
    ranged = written(df.repartitionByRange(F.asc_nulls_first(ts), F.asc_nulls_first(id_col)).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    offsets = counts.select("__range", before.alias("__before"))
    number = F.row_number().over(W.partitionBy("__range").orderBy(ts, id_col)) + F.col("__before")
    return ranged.join(F.broadcast(offsets), "__range").withColumn(out, number.cast("long")).drop("__range", "__before")


def commit_log(events: DataFrame) -> DataFrame:
    """``events`` read as commits: the previous one of its key is a commit's parent, for every fifth id the one before that."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    parent = F.when(F.col("event_id") % 5 == 0, F.lag("event_id", 2).over(w)).otherwise(F.lag("event_id", 1).over(w))
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("event_type").alias("session"), (F.col("event_id") % 4).alias("connection"), "ts", "value", "props", parent.alias("parent"))


def readonly_sql(spark: SparkSession, statement: str, **views: DataFrame) -> DataFrame:
    """Run one statement that only reads, over the given views."""
    plain = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", " ", statement, flags=re.DOTALL).strip().rstrip(";").lower()
    if not re.match(r"(?:select|with)\b", plain) or ";" in plain or re.search(r"\b(?:insert|update|delete|merge|create|drop|alter|truncate|set|load|call)\b", plain):
        raise ValueError("only a single SELECT is allowed")
    return spark.sql(statement.strip().rstrip(";"), **views)
