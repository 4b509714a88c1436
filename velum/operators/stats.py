"""Statistics of measured values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latency(values: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """Mean, extremes, population deviation, the values at ranks floor(0.95 n) and floor(0.99 n) from 0, and runs a second of values in ms.

    Equal values are counted first, so a group is as many rows as it has
    different values.
    """
    counted = values.groupBy(F.col(by).alias(out), F.col(value).alias("x")).agg(F.count("*").alias("times"))
    order = W.partitionBy(out).orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    ranked = counted.withColumns({"upto": F.sum("times").over(order), "total": F.sum("times").over(W.partitionBy(out))})

    def at(q: float):
        rank = F.least(F.col("total"), F.floor(F.col("total") * q) + 1)
        return F.min(F.when(F.col("upto") >= rank, F.col("x")))

    tail = ranked.groupBy(out).agg(at(0.95).alias("p95"), at(0.99).alias("p99"))
    whole = values.groupBy(F.col(by).alias(out)).agg(F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.stddev_pop(value), 4).alias("sd"), F.round(1000 / F.avg(value), 6).alias("throughput"), F.count("*").alias("n"))
    return whole.join(tail, out)
