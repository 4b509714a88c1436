"""Two peers that exchange what the other's Bloom filter lacks until both have everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.operators import bloom
from velum.sources.log import written


def cycles(average_ms: float) -> int:
    """Rounds that fit into a second, from 1 to 3, none counted as shorter than 300 ms."""
    return max(1, min(3, int(1000 // max(average_ms, 300))))


def sent(lacks: DataFrame, held: DataFrame, column: str, count: int, seed: int) -> DataFrame:
    """What a peer that has ``held`` gets in one round: of the values it lacks, those that its filter surely hasn't.

    A filter never denies a value that it was filled with, so asking it for the
    values that the peer lacks gives the same as asking it for all of the other's.
    Only the blocks that are asked for are filled.
    """
    asked = lacks.select(bloom.place(F.col(column), count, seed)["block"].alias("__block")).distinct()
    wanted = held.select(column, bloom.place(F.col(column), count, seed)["block"].alias("__block")).join(asked, "__block", "left_semi")
    return bloom.absent_blocks(lacks, column, bloom.fill_blocks(wanted, column, count, seed), count, seed)


def lacking(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """What ``b`` has and ``a`` has not; null is a value."""
    return b.join(a.select(F.col(column).alias("__held")), F.col(column).eqNullSafe(F.col("__held")), "left_anti")


def converge(a: DataFrame, b: DataFrame, column: str, rounds: int = 3, most: int = 10) -> tuple[DataFrame, DataFrame, int]:
    """Both peers with everything, and how many rounds it took.

    A new seed in each round lets values through that an earlier filter seemed to
    hold. Rounds end when neither peer lacks anything; after ``most`` of them the
    rest is sent by comparing values. What a peer lacks is compared once and from
    then on is what the round before left over; only what is sent is written.
    """
    a, b = written(a, "peer"), written(b, "peer")
    peers, lacks = [a, b], [written(lacking(a, b, column), "lacks"), written(lacking(b, a, column), "lacks")]
    held, left = [a.count(), b.count()], [d.count() for d in lacks]
    for k in range(most):
        if not any(left):
            return *peers, k
        n = max(1, *held)
        count = bloom.blocks(n, bloom.sizes(n, bloom.sync_rate(n, rounds))[0])
        got = [written(sent(lacks[i], peers[i], column, count, k + 1), "sent") if left[i] else None for i in (0, 1)]
        for i in (0, 1):
            if left[i]:
                arrived = got[i].count()
                peers[i], held[i] = peers[i].unionByName(got[i]), held[i] + arrived
                lacks[i] = written(lacking(got[i], lacks[i], column), "lacks") if arrived < left[i] else lacks[i].limit(0)
                left[i] -= arrived
    return peers[0].unionByName(lacks[0]), peers[1].unionByName(lacks[1]), most
