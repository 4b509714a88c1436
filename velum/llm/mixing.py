"""Mixing sources to target weights, by Efraimidis-Spirakis keys and prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velum.llm.common import materialize, table

CAP = 3
BUCKETS = 4096
#: The order in which a source's documents are taken.
ORDER = ("__key", "__id", "__size", "__tie")
#: Sources up to which the table of sources, some 80 bytes each, is broadcast.
SMALL = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """The default weight of a document: 2 if its words have 3 to 12 characters on average, with the white space, else 1."""
    return F.when((size > 0) & F.length(text).between(3 * size, 12 * size), 2.0).otherwise(1.0)


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """``docs`` with ``__id``, ``__source``, ``__size`` (words), ``__key``, ``__bucket`` and ``__tie`` (a hash of the text).

    The key is an exponential variate over the weight, from a hash of the id, so
    that any run draws the same; the bucket is a step function of the key with
    ranges of nearly equal numbers of documents.
    """
    text, id_ = F.col(text_col).cast("string"), F.col(id_col).cast("string")
    seed = F.coalesce(id_, F.md5(text), F.lit(""))
    draw = (F.conv(F.substring(F.md5(seed), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    sized = docs.withColumns({"__id": F.col(id_col), "__source": F.col(source_col).cast("string"), "__size": word_count(text), "__tie": F.xxhash64(text)})
    w = quality(text, F.col("__size")) if weight is None else weight
    keyed = sized.withColumn("__key", -F.log(draw) / w)
    return keyed.withColumn("__bucket", F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("__key"))) * BUCKETS)).cast("int"))


def targets(totals: DataFrame, cycle: int = 3) -> DataFrame:
    """``(source, source_size, target)`` of ``(source, source_size)``.

    Sources by code point, null last, weigh 1 to ``cycle`` and again. They share
    the sum of all sizes by weight; a target stops at CAP times its source's
    size, and the excess is shared again by weight. Sources are in order of the
    share at which they stop: the first that doesn't stop fixes the share of
    all behind it. The table has a row for each source, whatever the documents.
    """
    by_name = W.orderBy(F.asc_nulls_last("source"))
    ranked = totals.select("source", "source_size", ((F.row_number().over(by_name) - 1) % cycle + 1).cast("long").alias("weight"))
    stops = ranked.withColumn("stop", CAP * F.col("source_size") / F.col("weight"))
    order = W.orderBy("stop", F.asc_nulls_last("source"))
    before = F.coalesce(F.sum(CAP * F.col("source_size")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    whole = F.sum("source_size").over(W.partitionBy())
    leveled = stops.withColumn("level", (whole - before) / rest)
    level = F.min_by(F.when(F.col("level") <= F.col("stop"), F.col("level")), F.when(F.col("level") <= F.col("stop"), F.col("stop"))).over(W.partitionBy())
    share = F.coalesce(level, F.lit(0.0))
    return leveled.select("source", "source_size", F.least((CAP * F.col("source_size")).cast("double"), share * F.col("weight")).alias("target"))


def mixing_plan(keys: DataFrame) -> DataFrame:
    """For each source its target, complete epochs, and the place in the order of keys up to which documents are taken once more.

    Sizes are summed for each source and bucket first; only the one bucket of a
    source in which its budget ends is sorted.
    """
    rows = keys.select("__source", "__bucket", *ORDER)
    sums = materialize(rows.groupBy(F.col("__source").alias("source"), F.col("__bucket").alias("bucket")).agg(F.sum("__size").alias("inside")), "buckets")
    goal = targets(sums.groupBy("source").agg(F.sum("inside").alias("source_size"))).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = materialize(goal.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    order = W.partitionBy("source").orderBy("bucket")
    placed = sums.withColumn("before", F.sum("inside").over(order) - F.col("inside")).withColumnRenamed("source", "s")
    ends = placed.join(goal.select("source", "budget"), F.col("s").eqNullSafe(F.col("source"))).filter((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("inside") > F.col("budget"))).select("source", "bucket", "before", "budget")
    inside = rows.join(few(ends), F.col("__source").eqNullSafe(F.col("source")) & (F.col("__bucket") == F.col("bucket")))
    run = F.sum("__size").over(W.partitionBy("source").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)) - F.col("__size")
    taken = inside.withColumn("run", F.col("before") + run).filter(F.col("run") + F.col("__size") / 2 < F.col("budget"))
    last = taken.groupBy("source").agg(F.max(F.struct(*ORDER)).alias("last"))
    cut = ends.select(F.col("source").alias("s"), "bucket").join(last, F.col("s").eqNullSafe(F.col("source")), "left").select("s", "bucket", "last")
    plan = goal.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
    return materialize(plan.select(*[F.col(c).alias(f"__plan_{c}") for c in ("source", "source_size", "target", "epochs", "bucket", "last")]), "plan")


def few(plan: DataFrame) -> DataFrame:
    """Broadcast a table with a row for each source if its rows, counted, are few."""
    return F.broadcast(plan) if plan.count() <= SMALL else plan


def planned(keys: DataFrame, plan: DataFrame) -> DataFrame:
    """``keys`` with its source's row of the plan and ``__times``, how often a document is taken."""
    bucket, last = F.col("__plan_bucket"), F.col("__plan_last")
    once_more = (F.col("__bucket") < bucket) | ((F.col("__bucket") == bucket) & (F.struct(*ORDER) <= last))
    met = keys.join(few(plan), F.col("__source").eqNullSafe(F.col("__plan_source")), "left")
    return met.withColumn("__times", F.col("__plan_epochs") + F.when(F.coalesce(once_more, F.lit(False)), 1).otherwise(0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """``(id, size, source_size, target, times, taken)`` for every row of ``docs``.

    A source's documents are taken in complete epochs first. What is left of its
    target goes to documents in the order of their keys, as long as the middle
    of a document is within it. Null texts have size 0, and null sources are a
    source of their own, the last one. Ties in the key go by id, then size, null
    ids first; of rows that repeat an id and a size as many are taken as fit.
    No rows give no rows.
    """
    keys = with_keys(docs, id_col, text_col, source_col, weight).select("__id", "__source", "__size", "__key", "__bucket")
    keys = materialize(keys.withColumn("__tie", F.monotonically_increasing_id()), "keys")
    found = planned(keys, mixing_plan(keys))
    names = {"__id": "id", "__size": "size", "__plan_source_size": "source_size", "__plan_target": "target", "__times": "times"}
    return found.select(*[F.col(c).alias(n) for c, n in names.items()], (F.col("__size") * F.col("__times")).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; rows of size 0 are in every complete epoch.

    As ``mix``, but ties in key, id and size go by the text, and rows that
    repeat all of these are taken or left together. All columns stay, whatever
    their names (but for ones that begin with two underscores).
    """
    keys = with_keys(docs, id_col, text_col, source_col, weight)
    plan = mixing_plan(materialize(keys.select("__source", "__bucket", *ORDER), "keys"))
    return planned(keys, plan).filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes."""
    found = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


#: The same from one window over all documents of a source.
OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), keyed AS (
  SELECT doc_id, source, size,
    -ln((CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / CASE WHEN size > 0 AND length(text) / size BETWEEN 3.0 AND 12.0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM sized
), totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM totals
), stops AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS stop FROM ranked
), leveled AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(3 * source_size) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM stops
), share AS (SELECT arg_min(level, stop) AS level FROM leveled WHERE level <= stop
), goals AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), coalesce(share.level, 0) * weight) AS target FROM leveled, share
), epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goals
), runs AS (
  SELECT doc_id, size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS run
  FROM keyed k JOIN epochs e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN run + size / 2 < budget THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM runs
"""
