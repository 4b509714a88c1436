"""The relations that the registered queries read, as DataFrames and as SQL for both engines."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velum.sources.log import commit_log, number_arrivals

#: Common table expressions that a query's SQL may use.
CTE = {
    "c0": """c0 AS (SELECT event_id AS id, user_id AS key, event_type AS session, event_id % 4 AS connection, ts, value, props,
      lag(event_id, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p1, lag(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p2,
      row_number() OVER (ORDER BY ts, event_id) AS age FROM events)""",
    "c": "c AS (SELECT id, key, session, connection, ts, value, props, CASE WHEN id % 5 = 0 THEN p2 ELSE p1 END AS parent, age FROM c0)",
    "lv": "lv AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.parent = c.id))",
    "i": """i AS (SELECT '/data/orders/' || o_orderkey AS path, o_orderpriority AS ns, o_orderstatus = 'F' AS is_deleted, o_orderkey AS age,
      o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders)""",
    "k": """k AS (SELECT l_orderkey AS id, coalesce(list_sort(list(DISTINCT l_partkey) FILTER (l_linenumber % 3 = 0)), []) AS base,
      coalesce(list_sort(list(DISTINCT l_partkey) FILTER (l_linenumber % 3 <> 1)), []) AS a, coalesce(list_sort(list(DISTINCT l_partkey) FILTER (l_linenumber % 3 <> 2)), []) AS b FROM lineitem GROUP BY 1)""",
    "n": "n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)",
    "t": """t AS (SELECT o_custkey AS key, max(CASE WHEN rn = 1 THEN o_totalprice END) AS p0, max(CASE WHEN rn = 2 THEN o_totalprice END) AS p1, max(CASE WHEN rn = 3 THEN o_totalprice END) AS p2,
      max(CASE WHEN rn = 1 THEN o_orderpriority END) AS s0, max(CASE WHEN rn = 2 THEN o_orderpriority END) AS s1, max(CASE WHEN rn = 3 THEN o_orderpriority END) AS s2,
      max(CASE WHEN rn = 1 THEN nullif(o_orderstatus, 'P') END) AS u0, max(CASE WHEN rn = 2 THEN nullif(o_orderstatus, 'P') END) AS u1, max(CASE WHEN rn = 3 THEN nullif(o_orderstatus, 'P') END) AS u2
      FROM n WHERE rn <= 3 GROUP BY 1 HAVING count(*) = 3)""",
    "d": "d AS (SELECT doc_id, text, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))",
}
NEEDS = {"c": ["c0"], "lv": ["c0", "c"], "t": ["n"]}


def with_relations(body: str, *names: str, recursive: bool = False) -> str:
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*NEEDS.get(n, []), n] if x not in wanted]
    if not wanted:
        return body
    head = ",\n".join(CTE[n] for n in wanted)
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {'RECURSIVE ' * recursive}{head},\n{body.lstrip()[5:]}"
    return f"WITH {'RECURSIVE ' * recursive}{head}\n{body}"


class Tables:
    """Tables of a folder as attributes, and the relations made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def c(self) -> DataFrame:
        return commit_log(self.events)

    @cached_property
    def aged(self) -> DataFrame:
        return number_arrivals(self.c)

    @cached_property
    def i(self) -> DataFrame:
        return self.orders.select(
            F.concat(F.lit("/data/orders/"), F.col("o_orderkey").cast("string")).alias("path"),
            F.col("o_orderpriority").alias("ns"),
            (F.col("o_orderstatus") == "F").alias("is_deleted"),
            F.col("o_orderkey").alias("age"),
            "o_orderkey",
            "o_custkey",
            "o_orderstatus",
            "o_totalprice",
            "o_orderdate",
        )

    @cached_property
    def k(self) -> DataFrame:
        n, part = F.col("l_linenumber") % 3, F.col("l_partkey")
        pick = lambda test: F.sort_array(F.collect_set(F.when(test, part)))
        return self.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(pick(n == 0).alias("base"), pick(n != 1).alias("a"), pick(n != 2).alias("b"))

    @cached_property
    def t(self) -> DataFrame:
        w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        three = self.orders.withColumn("rn", F.row_number().over(w)).filter("rn <= 3")
        fields = {"p": F.col("o_totalprice"), "s": F.col("o_orderpriority"), "u": F.nullif(F.col("o_orderstatus"), F.lit("P"))}
        picked = [F.max(F.when(F.col("rn") == k + 1, c)).alias(f"{n}{k}") for n, c in fields.items() for k in range(3)]
        return three.groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"), *picked).filter("n = 3").drop("n")

    @cached_property
    def d(self) -> DataFrame:
        return self.documents.join(self.labels, "doc_id", "left")
