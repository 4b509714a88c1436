"""Shards by a lookup table that the shards fill in turns."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm.common import table

SLOTS = 65_537
SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS, weights: Sequence[float] | None = None) -> np.ndarray:
    """The index of the shard in each of a prime number of slots.

    A shard's name gives its preference order, a permutation of all slots:
    offset + k * skip. The shards take turns, those of greater weight more
    often, and in a turn each claims the first free slot in its order. Shares
    differ by about a slot, and when a shard comes or goes few other slots
    change hands.
    """
    if not _is_prime(slots):
        raise ValueError(f"{slots} isn't a prime")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards are names, each once, at most as many as slots")
    weights = [1.0] * len(shards) if weights is None else list(weights)
    if len(weights) != len(shards) or min(weights) <= 0:
        raise ValueError("a weight above 0 for each shard")
    digest = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digest]
    skip = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digest]
    turn = [w / max(weights) for w in weights]
    credit = [0.0] * len(shards)
    owner = [-1] * slots
    left = slots
    while left:
        for s in range(len(shards)):
            credit[s] += turn[s]
            if credit[s] < 1 or not left:
                continue
            credit[s] -= 1
            while owner[at[s]] >= 0:
                at[s] = (at[s] + skip[s]) % slots
            owner[at[s]] = s
            left -= 1
    return np.array(owner, np.int32)


def with_shards(docs: DataFrame, shards: Sequence[str], key_col: str = "doc_id", slots: int = SLOTS, weights: Sequence[float] | None = None, slot_out: str = "slot", shard_out: str = "shard", spread_nulls_by: str | None = "text") -> DataFrame:
    """``docs`` with the slot and the shard of each row, by a hash of ``key_col`` as text.

    The table's size is a parameter; it is broadcast, and each row needs one
    lookup. Rows with a null key go by a hash of ``spread_nulls_by``, so that
    they don't meet in one shard; empty and null texts there are alike. Rows that
    repeat a key share its shard. Columns with the names of the new ones are
    replaced; no rows give no rows.
    """
    spark = docs.sparkSession
    owner = lookup_table(shards, slots, weights)
    names = np.array(list(shards), dtype=object)[owner]
    lookup = spark.createDataFrame(pa.table({"__slot": pa.array(np.arange(slots), pa.int64()), "__shard": pa.array(names.tolist(), pa.string())}))
    spare = F.col(spread_nulls_by).cast("string") if spread_nulls_by in docs.columns else F.lit("")
    placed = docs.withColumn("__slot", F.pmod(F.xxhash64(F.coalesce(F.col(key_col).cast("string"), spare, F.lit(""))), F.lit(slots)))
    met = placed.join(F.broadcast(lookup), "__slot", "left")
    kept = [F.col(c) for c in docs.columns if c not in (slot_out, shard_out)]
    return met.select(*kept, F.col("__slot").alias(slot_out), F.col("__shard").alias(shard_out))


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return with_shards(docs, shard_names()).select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"), "slot", "shard")
