"""Exact top-k by inner product, with a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velum.llm.common import materialize, table

#: Components must be smaller in size after scaling, so that differences fit 64 bits.
LARGEST = 1 << 62
BLOCK = 1 << 15
QUERIES = 1 << 15


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, v)`` with v = floor(scale * component), of rows with an id and all components finite."""

    def component(x):
        scaled = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(scaled) < float(LARGEST), F.floor(scaled)).otherwise(F.raise_error(F.lit(f"a component of {vector_col} is 2**62 or more after scaling")).cast("long"))

    v = F.transform(F.col(vector_col), component)
    fits = F.forall(F.col(vector_col), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(fits).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; an error if one leaves 64 bits."""
    if rows.size and float(np.abs(rows).max()) * np.abs(query).astype(np.float64).sum() >= 2.0**62:
        scores = rows.astype(object) @ query.astype(object)
        if any(not -(1 << 63) <= x < 1 << 63 for x in scores):
            raise OverflowError("a score leaves 64 bits")
        return scores.astype(np.int64)
    return rows @ query


class SlicedIndex:
    """Bit slices of a block of vectors: ``slices[dimension, bit]`` is a bitmap over the block's rows, sorted by id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.n = len(ids)
        self.low = self.rows.min(axis=0) if self.rows.size else np.zeros(rows.shape[1], np.int64)
        shifted = (self.rows - self.low).T
        self.bits = [int(x).bit_length() for x in shifted.max(axis=1)] if self.n else []
        words = -(-self.n // 64)
        self.slices: list[list[np.ndarray]] = []
        for d, bits in enumerate(self.bits):
            own = []
            for b in range(bits):
                packed = np.zeros(words * 8, np.uint8)
                bitmap = np.packbits(((shifted[d] >> b) & 1).astype(np.uint8), bitorder="little")
                packed[: len(bitmap)] = bitmap
                own.append(packed.view(np.uint64))
            self.slices.append(own)
        self.top = [(1 << bits) - 1 for bits in self.bits]
        every = np.zeros(words * 8, np.uint8)
        ones = np.packbits(np.ones(self.n, np.uint8), bitorder="little")
        every[: len(ones)] = ones
        self.every = every.view(np.uint64)

    def scores(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of every row's inner product with ``query``, less what is the same for all rows.

        A weight is a sum of signed powers of two; each adds an attribute's
        slices, or their complement for a negative one, moved up by the power.
        The slices at a position are added three at a time, a carry going up.
        """
        at: list[list[np.ndarray]] = []
        for d, weight in enumerate(query.tolist()):
            power = 0
            while weight:
                if weight & 1:
                    digit = 2 - (weight & 3)  # 1 or -1, so that the next binary digit is 0
                    weight -= digit
                    while len(at) < power + self.bits[d]:
                        at.append([])
                    for b, bitmap in enumerate(self.slices[d]):
                        at[power + b].append(bitmap if digit > 0 else ~bitmap)
                weight >>= 1
                power += 1
        out = []
        k = 0
        while k < len(at):
            column = at[k]
            while len(column) > 1:
                if k + 1 == len(at):
                    at.append([])
                a, b = column.pop(), column.pop()
                if column:
                    c = column.pop()
                    half = a ^ b
                    column.insert(0, half ^ c)
                    at[k + 1].append((a & b) | (c & half))
                else:
                    column.append(a ^ b)
                    at[k + 1].append(a & b)
            out.append(column[0] if column else None)
            k += 1
        return out

    def top_k(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows, ties to the smaller id, without rows that have the id ``own``.

        From the most significant slice down, ``sure`` holds rows above the
        boundary and ``tied`` those that equal it so far. Of rows tied to the
        end the first ones by id fill what is left.
        """
        tied = self.every.copy()
        a, b = np.searchsorted(self.ids, [own, own + 1])
        for i in range(int(a), int(b)):
            tied[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        sure, n_sure = np.zeros_like(tied), 0
        for bitmap in reversed(self.scores(query)):
            if bitmap is None:
                continue
            with_bit = tied & bitmap
            n = n_sure + int(np.bitwise_count(with_bit).sum())
            if n > k:
                tied = with_bit
            else:
                sure, n_sure = sure | with_bit, n
                tied &= ~bitmap
                if n == k:
                    tied[:] = 0
                    break
        rows = np.r_[self._rows(sure), self._rows(tied)[: k - n_sure]]
        return self.ids[rows], exact_scores(self.rows[rows], query)

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        word = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        return word[at] * 64 + bit


def _best(sent, k: int):
    """A partition's k best rows for each query, from blocks of at most BLOCK rows."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = sent.value
        held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def index(size: int) -> None:
            ids, rows = (np.concatenate(x) for x in held.pop(size))
            block = SlicedIndex(ids, rows)
            query_ids, queries = by_size[size]
            for j, own in enumerate(query_ids.tolist()):
                found, score = block.top_k(queries[j], own, k)
                if (size, j) in best:
                    found, score = np.r_[best[size, j][0], found], np.r_[best[size, j][1], score]
                order = np.lexsort((found, -score))[:k]
                best[size, j] = found[order], score[order]

        for batch in batches:
            ids, v = batch.column(0).to_numpy(), batch.column(1)
            flat, ends = v.flatten().to_numpy(), v.offsets.to_numpy()
            sizes = np.diff(ends)
            first = ends[:-1] - ends[0]
            for size in np.unique(sizes).tolist():
                if size not in by_size:
                    continue
                own = np.flatnonzero(sizes == size)
                rows = flat[first[own][:, None] + np.arange(size)]
                for a in range(0, len(own), BLOCK):
                    part = held.setdefault(size, ([], []))
                    part[0].append(ids[own[a : a + BLOCK]])
                    part[1].append(rows[a : a + BLOCK])
                    if sum(map(len, part[0])) >= BLOCK:
                        index(size)
        for size in list(held):
            index(size)
        for (size, j), (found, score) in best.items():
            if len(found):
                query = np.full(len(found), by_size[size][0][j])
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(found), pa.array(score)], schema=schema)

    return of


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best rows of ``vectors`` by integer inner product, ties to the smaller id.

    Components are floor(scale * x). A row with the query's id is no candidate.
    Rows with a null id or vector or a null or non-finite component take no
    part; a component of 2**62 or more after scaling, or a best score that
    leaves 64 bits, is an error, as no such score could be given; a query meets vectors of its own
    length only; of repeated query ids the smallest vector counts; repeated
    candidates each count. No queries or no rows give no rows.

    Every task builds an index of each block of its rows and answers all
    queries on it, so no vector is shuffled; the partial answers are ranked
    once more by query. Queries are broadcast in parts of about QUERIES, with a
    pass over the vectors for each.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, scale)
    asked = materialize(quantised(queries, id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v")), "queries")
    parts = max(1, -(-asked.count() // QUERIES))
    found = None
    for p in range(parts):
        part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).toArrow()
        by_size: dict[int, tuple[list[int], list[list[int]]]] = {}
        for i, v in zip(part.column("id").to_pylist(), part.column("v").to_pylist()):
            own = by_size.setdefault(len(v), ([], []))
            own[0].append(i)
            own[1].append(v)
        sent = spark.sparkContext.broadcast({n: (np.array(i, np.int64), np.array(v, np.int64).reshape(len(i), n)) for n, (i, v) in by_size.items()})
        answers = rows.mapInArrow(_best(sent, k), "query_id long, vec_id long, score long")
        found = answers if found is None else found.unionByName(answers)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors for each of those whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
