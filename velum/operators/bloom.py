"""Bloom filters as rows of set bits, built and asked with built-in functions only (BF, A13, T14)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sizes(n: int, p: float, most: int = 8) -> tuple[int, int]:
    bits = max(8, math.ceil(n * math.log(p) / math.log(1 / 2 ** math.log(2))))
    return bits, min(most, max(1, round(bits / max(n, 1) * math.log(2))))


def sync_rate(n: int, cycles: int = 3) -> float:
    """The false-positive rate with which peers of at most ``n`` values meet in about so many rounds."""
    return min(0.5, max(n, 1) ** (-2 / cycles))


def positions(value: Column, bits: int, hashes: int, seed: int = 0) -> Column:
    """A value's bits: each MD5 of a number and the value gives four."""
    digests = [F.md5(F.concat(F.lit(f"{seed * 64 + k}/"), value.cast("string"))) for k in range(-(-hashes // 4))]
    return F.array(*[F.conv(F.substring(digests[k // 4], k % 4 * 8 + 1, 8), 16, 10).cast("long") % bits for k in range(hashes)])


def fill(values: DataFrame, column: str, bits: int, hashes: int, seed: int = 0) -> DataFrame:
    """``(word, mask)``: the filter's bits, 32 a row."""
    at = values.select(F.explode(positions(F.col(column), bits, hashes, seed)).alias("b"))
    return at.groupBy(F.floor(F.col("b") / 32).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 32 as int))")).alias("mask"))


def fill_rate(filled: DataFrame, bits: int) -> DataFrame:
    return filled.agg((F.sum(F.bit_count("mask")) / bits).alias("fill_rate"))


def absent(values: DataFrame, column: str, filled: DataFrame, bits: int, hashes: int, seed: int = 0) -> DataFrame:
    """Those values that the filter surely doesn't hold."""
    at = values.withColumn("__b", F.explode(positions(F.col(column), bits, hashes, seed)))
    met = at.join(filled, F.floor(F.col("__b") / 32) == F.col("word"), "left")
    hit = F.coalesce(F.col("mask").bitwiseAND(F.expr("shiftleft(1L, cast(__b % 32 as int))")) != 0, F.lit(False))
    return met.groupBy(*values.columns).agg(F.bool_and(hit).alias("__held")).filter(~F.col("__held")).drop("__held")


def blocks(n: int, bits: int) -> int:
    """How many blocks of 256 bits a filter of ``bits`` for ``n`` values has."""
    return max(1, math.ceil(max(bits, n) / 256))


def place(value: Column, count: int, seed: int = 0) -> Column:
    """A value's block and its eight bits in it, one in each 32 bits of four masks; null has a place as well."""
    bits = F.xxhash64(F.lit(2 * seed + 1), value)
    at = lambda k: F.shiftrightunsigned(bits, 5 * k).bitwiseAND(F.lit(31)).cast("int")
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), at(k)) + F.call_function("shiftleft", F.lit(1 << 32).cast("long"), at(k + 1))
    return F.struct(F.pmod(F.xxhash64(F.lit(2 * seed), value), F.lit(count).cast("long")).alias("block"), *[one(2 * k).alias(f"m{k}") for k in range(4)])


def fill_blocks(values: DataFrame, column: str, count: int, seed: int = 0) -> DataFrame:
    """``(block, m0, m1, m2, m3)``: a filter of blocks, where a value is one row and not one for each bit."""
    at = values.select(place(F.col(column), count, seed).alias("p")).select("p.*")
    return at.groupBy("block").agg(*[F.bit_or(f"m{k}").alias(f"m{k}") for k in range(4)])


def absent_blocks(values: DataFrame, column: str, filled: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """Those values that the filter of blocks surely doesn't hold; one that occurs twice stays twice."""
    names = [f"__f{k}" for k in range(4)]
    at = values.withColumn("__p", place(F.col(column), count, seed)).withColumn("__block", F.col("__p.block"))
    met = at.join(filled.toDF("__block", *names), "__block", "left")
    held = F.lit(True)
    for k, name in enumerate(names):
        held = held & (F.col(name).bitwiseAND(F.col(f"__p.m{k}")) == F.col(f"__p.m{k}"))
    return met.filter(~F.coalesce(held, F.lit(False))).select(*values.columns)
