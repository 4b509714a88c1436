"""The commit graph: leaves, heads, ancestors, versions in time (J, W1, G rows)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velum.functions.columns import rendezvous
from velum.sources.log import written


#: So many rows at least are looked at together in Python: some 30 MB of memory.
BATCH = 200_000


def newest_first() -> list[Column]:
    return [F.desc("ts"), F.desc("id")]


def edges(commits: DataFrame) -> DataFrame:
    return commits.filter("parent is not null").select("key", F.col("id").alias("child"), "parent")


def leaves(commits: DataFrame) -> DataFrame:
    """Commits that no commit names as its parent."""
    return commits.join(commits.select(F.col("parent").alias("id")), "id", "left_anti")


def neighbours(links: DataFrame, source: str, target: str) -> DataFrame:
    """``(vertex, neighbour, outgoing)``: each neighbour once in each direction."""
    out = links.select(F.col(source).alias("vertex"), F.col(target).alias("neighbour"), F.lit(True).alias("outgoing"))
    back = links.select(F.col(target).alias("vertex"), F.col(source).alias("neighbour"), F.lit(False).alias("outgoing"))
    return out.unionByName(back).filter("vertex is not null and neighbour is not null").distinct()


def roots(commits: DataFrame) -> DataFrame:
    return commits.filter("parent is null")


def heads(commits: DataFrame, prefer: Column | None = None) -> DataFrame:
    """The newest leaf of each key; ``prefer`` puts leaves with a smaller value first."""
    order = [*([prefer] if prefer is not None else []), *newest_first()]
    return leaves(commits).withColumn("__n", F.row_number().over(W.partitionBy("key").orderBy(*order))).filter("__n = 1").drop("__n")


def latest(commits: DataFrame, by: str = "key") -> DataFrame:
    """The newest commit of each ``by``, with one partial aggregation (A4)."""
    rest = [c for c in commits.columns if c != by]
    return commits.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct("ts", "id")).alias("c")).select(by, "c.*")


def as_of(commits: DataFrame, ts: Column) -> DataFrame:
    """Each key's newest commit at or before a time."""
    return latest(commits.filter(F.col("ts") <= ts))


def missing_parents(commits: DataFrame) -> DataFrame:
    """Edges to parents that aren't in the table."""
    return edges(commits).join(commits.select(F.col("id").alias("parent")), "parent", "left_anti")


def with_parent(commits: DataFrame, columns: list[str]) -> DataFrame:
    """Commits with columns of their parent as ``parent_*``."""
    other = commits.select(F.col("id").alias("parent"), *[F.col(c).alias(f"parent_{c}") for c in columns])
    return commits.join(other, "parent")


def _by_batches(rows: DataFrame, weights: str | None, carried: str | None) -> DataFrame:
    """``rows(id, up, ...)`` with every ``up`` followed as far as it leads within some hundred thousand neighbouring rows.

    ``weights`` are added up on the way, ``carried`` is taken from where it ends.
    """

    def follow(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def done(parts: list):
            t = pa.Table.from_batches(parts).combine_chunks()
            ids, up = t["id"], t["up"]
            at = pc.index_in(up, value_set=ids, skip_nulls=True)
            if pc.count_distinct(ids).as_py() == len(ids) and at.null_count < len(at):
                own = np.arange(len(ids))
                links = at.is_valid().to_numpy()
                to = np.where(links, pc.fill_null(at, 0).to_numpy(), own)
                add = t[weights].to_numpy() if weights else np.zeros(len(ids), "int64")
                way = np.where(links, add, 0)
                for _ in range(len(ids).bit_length()):  # a cycle stays one
                    further = to[to]
                    if (further == to).all():
                        break
                    way, to = way + way[to], further
                if ((to != own) == links).all() and not links[to].any():
                    end = pa.array(to)
                    new = {"up": up.take(end)} | ({weights: pa.array(way + add[to])} if weights else {}) | ({carried: t[carried].take(end)} if carried else {})
                    for at, field in enumerate(t.schema):
                        if field.name in new:  # a field stays as it is, or batches would differ in what may be null
                            t = t.set_column(at, field, new[field.name])
            return t.to_batches(max_chunksize=20_000)

        parts, n = [], 0
        for batch in batches:
            parts.append(batch)
            n += batch.num_rows
            if n >= BATCH:
                yield from done(parts)
                parts, n = [], 0
        if parts:
            yield from done(parts)

    return rows.mapInArrow(follow, rows.schema)


def _jumped(jump: DataFrame, weights: str | None = None, carried: str | None = None) -> DataFrame:
    """``jump(id, up, ...)`` with every ``up`` followed to its end, ``weights`` added up and ``carried`` taken from the first that has one.

    First within neighbouring rows: a key's commits mostly stand together. What
    is left leads to rows of other batches; only these double their jumps, so n
    generations take log n joins, and rows that have come to their end stay out
    of them (in a join on ``up``, all of them would meet in the task of null).
    Each round is written to the shared folder. A chain that is longer than the
    table is a cycle, which is an error.
    """
    now = written(_by_batches(jump, weights, carried), "jumps")
    some = now.filter("up is not null")
    if some.isEmpty():
        return now
    ups = some.select(F.col("up").alias("id")).distinct()
    met = [c for c in (weights, carried) if c]

    def advance(rows: DataFrame, above: DataFrame) -> DataFrame:
        above = above.select(F.col("id").alias("up"), F.col("up").alias("__up"), *[F.col(c).alias(f"__{c}") for c in met])
        new = {"up": F.col("__up")} | ({weights: F.col(weights) + F.coalesce(f"__{weights}", F.lit(0))} if weights else {}) | ({carried: F.coalesce(carried, f"__{carried}")} if carried else {})
        return rows.join(above, "up", "left").select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])

    hubs = written(now.join(ups, "id", "left_semi").select("id", "up", *met), "hubs")
    most, reach, ended, going = hubs.count(), 1, hubs.filter("up is null"), hubs.filter("up is not null")
    while not going.isEmpty():
        if reach > 2 * most:
            raise ValueError("the parents form a cycle")
        moved = written(advance(going, ended.unionByName(going)), "hubs")
        ended, going = ended.unionByName(moved.filter("up is null")), moved.filter("up is not null")
        reach *= 2
    return now.filter("up is null").unionByName(advance(some, ended))


def depths(commits: DataFrame) -> DataFrame:
    """``(id, key, depth)``, a root having depth 0; a parent that isn't in the table counts as a root's child."""
    jump = commits.select("id", "key", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    return _jumped(jump, weights="depth").select("id", "key", "depth")


def nearest(commits: DataFrame, good: Column) -> DataFrame:
    """``(id, found)``: each commit itself if it is ``good``, else its nearest ancestor that is, null if none is."""
    marked = commits.select("id", F.when(~F.coalesce(good, F.lit(False)), F.col("parent")).alias("up"), F.when(good, F.col("id")).alias("found"))
    return _jumped(marked, carried="found").select("id", "found")


def jump_index(commits: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Depths, and tables of jumps of 1, 2, 4 and so on generations up to the greatest depth."""
    deep = written(depths(commits), "depths")
    deepest = deep.agg(F.max("depth")).first()[0] or 0
    jumps = [written(commits.filter("parent is not null").select("id", F.col("parent").alias("up")), "jumps")]
    while 1 << len(jumps) <= deepest:
        last = jumps[-1]
        jumps.append(written(last.join(last.toDF("up", "up2"), "up").select("id", F.col("up2").alias("up")), "jumps"))
    return deep, jumps


def _by_jumps(pairs: DataFrame, index: tuple[DataFrame, list[DataFrame]]) -> DataFrame:
    """``(key, a, b, base)`` of those pairs that have one.

    Jumps of 1, 2, 4 and so on generations are tables; both sides are brought to
    the same depth and then up together, the longest jumps first. So rows never
    grow beyond the pairs and the joins are log of the depth.
    """
    deep, jumps = index
    of = lambda name: deep.select(F.col("id").alias(name), F.col("depth").alias(f"d{name}"))
    now = pairs.select("key", "a", "b", F.col("a").alias("x"), F.col("b").alias("y")).join(of("x"), "x").join(of("y"), "y")
    now = now.select("key", "a", "b", *[F.when(F.col("dx") >= F.col("dy"), F.col(p)).otherwise(F.col(q)).alias(r) for p, q, r in (("x", "y", "x"), ("y", "x", "y"))], F.abs(F.col("dx") - F.col("dy")).alias("gap"))
    for k in range(len(jumps) - 1, -1, -1):
        moved = now.join(jumps[k].toDF("x", "x2"), "x", "left")
        now = written(moved.withColumn("x", F.when(F.col("gap").bitwiseAND(F.lit(1 << k)) != 0, F.col("x2")).otherwise(F.col("x"))).select("key", "a", "b", "x", "y", "gap"), "pairs")
    for k in range(len(jumps) - 1, -1, -1):
        moved = now.join(jumps[k].toDF("x", "x2"), "x", "left").join(jumps[k].toDF("y", "y2"), "y", "left")
        apart = ~F.col("x2").eqNullSafe(F.col("y2"))
        now = written(moved.select("key", "a", "b", F.when(apart, F.col("x2")).otherwise(F.col("x")).alias("x"), F.when(apart, F.col("y2")).otherwise(F.col("y")).alias("y")), "pairs")
    above = now.join(jumps[0].toDF("x", "up"), "x", "left").join(jumps[0].toDF("y", "up2"), "y", "left")
    base = F.when(F.col("x") == F.col("y"), F.col("x")).when(F.col("up") == F.col("up2"), F.col("up"))
    return above.select("key", "a", "b", base.alias("base")).filter("base is not null")


def _by_keys(commits: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(key, a, b, base, open)``: the nearest common ancestor within the commits of whole keys; ``open`` where the way leaves them before it is found.

    Commits and pairs are dealt out by key and come in its order, so that keys
    are whole up to five times ``BATCH`` commits.
    """
    kind = commits.schema["id"].dataType
    none = F.lit(None).cast(kind)
    rows = commits.select("key", "id", "parent", none.alias("a"), none.alias("b")).unionByName(pairs.select("key", none.alias("id"), none.alias("parent"), F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")))
    dealt = rows.repartition("key").sortWithinPartitions("key")
    result = pairs.select("key", F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), none.alias("base"), F.lit(True).alias("open")).schema

    def find(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def done(t):
            asked = t.filter(pc.is_valid(t["a"]))
            if not len(asked):
                return
            t = t.filter(pc.is_valid(t["id"])).combine_chunks()
            x, y = (pc.fill_null(pc.index_in(asked[c], value_set=t["id"]), -1).to_numpy().copy() for c in "ab")
            base, still = np.full(len(asked), -1), np.ones(len(asked), "bool")
            if len(t) and pc.count_distinct(t["id"]).as_py() == len(t):
                at = pc.index_in(t["parent"], value_set=t["id"], skip_nulls=True)
                own, links = np.arange(len(t), dtype="int32"), at.is_valid().to_numpy()
                outside = pc.is_valid(t["parent"]).to_numpy() & ~links
                jumps, depth = [np.where(links, pc.fill_null(at, 0).to_numpy(), own).astype("int32")], links.astype("int64")
                while len(jumps) <= len(t).bit_length() and not (jumps[-1][jumps[-1]] == jumps[-1]).all():
                    depth = depth + depth[jumps[-1]]
                    jumps.append(jumps[-1][jumps[-1]])
                ends = jumps[-1]
                if not links[ends].any():
                    there = (x >= 0) & (y >= 0)
                    met = there & (ends[x] == ends[y])
                    still = ~met & ~(there & ~outside[ends[x]] & ~outside[ends[y]])
                    p, q = x[met], y[met]
                    p, q = np.where(depth[p] >= depth[q], p, q), np.where(depth[p] >= depth[q], q, p)
                    gap = depth[p] - depth[q]
                    for k in range(len(jumps)):
                        p = np.where(gap >> k & 1, jumps[k][p], p)
                    for jump in reversed(jumps):
                        apart = jump[p] != jump[q]
                        p, q = np.where(apart, jump[p], p), np.where(apart, jump[q], q)
                    base[met] = np.where(p == q, p, jumps[0][p])
            keep = pa.array((base >= 0) | still)
            found = t["id"].take(pa.array(base, mask=base < 0))
            yield from pa.table({"key": asked["key"], "a": asked["a"], "b": asked["b"], "base": found, "open": pa.array(still)}).filter(keep).to_batches(max_chunksize=20_000)

        parts, n = [], 0
        for batch in batches:
            parts.append(batch)
            n += batch.num_rows
            if n >= BATCH:
                t = pa.Table.from_batches(parts)
                last = pc.index(pc.equal(t["key"], t["key"][-1]), True).as_py() if t["key"][-1].is_valid else n
                cut = last or (n if n >= 5 * BATCH else 0)
                if cut:
                    yield from done(t.slice(0, cut))
                    parts, n = t.slice(cut).to_batches(), n - cut
        if n:
            yield from done(pa.Table.from_batches(parts))

    return dealt.mapInArrow(find, result)


def common_ancestor(spark: SparkSession, commits: DataFrame, pairs: DataFrame, index: Callable[[], tuple[DataFrame, list[DataFrame]]] | None = None) -> DataFrame:
    """The nearest common ancestor of each ``(key, a, b)`` with one.

    It is looked for among the commits of the key first, which takes one pass over
    the commits; only for what leads further, to other keys or through more
    commits than are looked at together, the tables of jumps are made.
    """
    found = written(_by_keys(commits, pairs), "pairs")
    rest = found.filter("open").select("key", "a", "b")
    met = found.filter("not open").select("key", "a", "b", "base")
    return met if rest.isEmpty() else met.unionByName(_by_jumps(rest, index() if index else jump_index(commits)))


def revert_connection(commits: DataFrame, connections: list) -> DataFrame:
    """``(key, id)``: each key's head, or where a given connection made it the newest older commit of another one."""
    now = heads(commits).select("key", F.col("id").alias("head"), F.col("ts").alias("head_ts"), F.col("connection").isin(connections).alias("theirs"))
    older = commits.filter(~F.col("connection").isin(connections)).join(now.filter("theirs"), "key").filter("ts < head_ts")
    found = older.groupBy("key").agg(F.max_by("id", F.struct("ts", "id")).alias("found"))
    return now.join(found, "key", "left").select("key", F.when(F.col("theirs"), F.col("found")).otherwise(F.col("head")).alias("id")).filter("id is not null")


def merge_leader(leaves_: DataFrame, within: Column) -> DataFrame:
    """``(key, leader)``: of the connections whose leaf is no older than ``within`` before the newest, the one that rendezvous hashing picks."""
    newest = leaves_.groupBy("key").agg(F.max("ts").alias("newest"))
    fresh = leaves_.join(newest, "key").filter(F.col("ts") >= F.col("newest") - within)
    return fresh.select("key", F.col("connection").cast("string").alias("peer")).distinct().groupBy("key").agg(rendezvous(F.col("peer"), F.col("key")).alias("leader"))


def merge_base(spark: SparkSession, commits: DataFrame, tips: DataFrame) -> DataFrame:
    """``(key, base)``: the nearest common ancestor of all of a key's ``tips(key, id)``, for keys that have one.

    Tips are folded in pairs, so n of them take log n rounds. A key of one tip has itself.
    """
    now = written(tips.select("key", "id").distinct(), "tips")
    commits = written(commits.select("key", "id", "parent"), "commits")
    index = functools.cache(lambda: jump_index(commits))
    while not now.groupBy("key").count().filter("count > 1").isEmpty():
        place = now.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("id")) - 1)
        pairs = place.groupBy("key", F.floor(F.col("n") / 2).alias("pair")).agg(F.min("id").alias("a"), F.max("id").alias("b"))
        found = common_ancestor(spark, commits, pairs.filter("a <> b").select("key", "a", "b"), index)
        met = pairs.join(found, ["key", "a", "b"], "left").select("key", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("base")).alias("id"))
        apart = met.filter("id is null").select("key").distinct()
        now = written(met.join(apart, "key", "left_anti").distinct(), "tips")
    return now.select("key", F.col("id").alias("base"))


def merge_tips(spark: SparkSession, commits: DataFrame, fields: list[str], by: str = "connection") -> DataFrame:
    """``(key, base, tips, *fields)``: the merge of each key's newest leaf of every ``by``, for keys of several.

    A field takes its newest value that differs from the base; where none does, it
    keeps the base's value unless a tip removed it. Without a common ancestor the
    base is null and every value counts as set.
    """
    newest = leaves(commits).groupBy("key", by).agg(F.max_by(F.struct("id", "ts", *fields), F.struct("ts", "id")).alias("c")).select("key", "c.*")
    tips = written(newest.withColumn("n", F.count("*").over(W.partitionBy("key"))).filter("n > 1").drop("n"), "leaves")
    base = merge_base(spark, commits, tips)
    values = commits.select(F.col("id").alias("base"), *[F.col(f).alias(f"__base_{f}") for f in fields])
    sides = tips.join(base, "key", "left").join(values, "base", "left")
    out = []
    for f in fields:
        old = F.col(f"__base_{f}")
        changed = F.col(f).isNotNull() & ~F.col(f).eqNullSafe(old)
        newest_change = F.max_by(F.when(changed, F.col(f)), F.when(changed, F.struct("ts", "id")))
        out.append(F.coalesce(newest_change, F.when(~F.bool_or(F.col(f).isNull()), F.max(old))).alias(f))
    return sides.groupBy("key").agg(F.max("base").alias("base"), F.count("*").alias("tips"), *out)
