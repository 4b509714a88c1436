"""Near-duplicate documents by SimHash and multi-index hashing."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm.common import materialize, table
from velum.llm.graph import connected_components, local_components

SEED = 42
BITS = 64
#: Ids up to which a table of ids, 8 bytes each, is broadcast.
SMALL = 1_000_000
#: Pairs of fingerprints that are compared at once; a worker's memory follows them, results don't.
PAIRS = 1 << 19


#: The bits of each byte, lowest first, and where the counts of each of 8 bytes begin.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_PLACE = 256 * np.arange(8)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit: each byte's values are counted first."""
    values = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8) + _PLACE
    return (np.bincount(values.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS).astype(np.int64).ravel()


def fingerprint(text: str | None, width: int = 3) -> int:
    """The signed 64-bit SimHash of a text's word shingles; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        starts = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
        ends = (starts[width:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends)), np.uint64, len(ends))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += _ones(hashes[i : i + (1 << 14)])
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)`` of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of, f"id {kind}, fp long")


def word_fingerprints(text: str | None, seeds: Sequence[int]) -> list[int]:
    """The signed 64-bit SimHash of a text's words for each seed; 0 if it has none."""
    counts = Counter((text or "").encode("utf-8", "surrogatepass").lower().split())
    words, weights = list(counts), np.fromiter(counts.values(), np.float64, len(counts))
    found = []
    for seed in seeds:
        ones = np.zeros(BITS)
        for i in range(0, len(words), 1 << 14):
            part = words[i : i + (1 << 14)]
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in part), "<u8", len(part))
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += weights[i : i + (1 << 14)] @ bits.astype(np.float64)
        found.append(int(np.packbits(2 * ones > weights.sum(), bitorder="little").view("<i8")[0]))
    return found


def ball(bits: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` of ``bits`` bits, 0 first."""
    return [sum(1 << j for j in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _links(rows: tuple[np.ndarray, ...], radius: int, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint linked with it) within whole buckets; rows are sorted by key and tile."""
    key, tile, fp, role = rows
    group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
    index, probe = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
    held = np.bincount(group[index], minlength=group[-1] + 1)
    first = np.r_[0, np.cumsum(held)[:-1]]
    probe = probe[held[group[probe]] > 0]
    n = held[group[probe]]
    known, us, vs = np.unique(fp), [], []
    rank = np.searchsorted(known, fp)
    ends = np.cumsum(n)
    at = 0
    while at < len(probe):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + pairs, "right")))
        m = n[at:to]
        left = np.repeat(probe[at:to], m)
        step = np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)
        right = index[np.repeat(first[group[probe[at:to]]], m) + step]
        near = np.flatnonzero((np.bitwise_count(fp[left] ^ fp[right]) <= radius) & (fp[left] != fp[right]))
        u, v = rank[left[near]], rank[right[near]]
        if len(u) > 4 * len(known):  # keep a forest of what was found so far
            label = local_components(u, v, len(known))
            u = np.flatnonzero(label != np.arange(len(known)))
            v = label[u]
        us.append(u)
        vs.append(v)
        at = to
    if not us:
        return fp[:0], fp[:0]
    label = local_components(np.concatenate(us), np.concatenate(vs), len(known))
    u = np.flatnonzero(label != np.arange(len(known)))
    return known[u], known[label[u]]


def _first(found: list[tuple[np.ndarray, ...]], most: int) -> tuple[np.ndarray, ...]:
    """Of the pairs (u, v, d) found, each once, the ``most`` first of each u by d and v."""
    u, v, d = map(np.concatenate, zip(*found))
    order = np.lexsort((v, d, u))
    u, v, d = u[order], v[order], d[order]
    new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])][: len(u)]
    u, v, d = u[new], v[new], d[new]
    start = np.flatnonzero(np.r_[True, u[1:] != u[:-1]][: len(u)])
    kept = np.arange(len(u)) - np.repeat(start, np.diff(np.r_[start, len(u)])) < most
    return u[kept], v[kept], d[kept].astype(np.int32)


def _gather(found: list[tuple[np.ndarray, ...]], part: tuple[np.ndarray, ...], most: int) -> None:
    """Add a part to those found; they are merged as soon as they hold ``PAIRS`` pairs and twice the last merge's."""
    found.append(part)
    held = sum(len(x[0]) for x in found)
    if len(found) > 1 and held > max(PAIRS, 2 * len(found[0][0])):
        found[:] = [_first(found, most)]


def _nearest(rows: tuple[np.ndarray, ...], radius: int, pairs: int = PAIRS) -> tuple[np.ndarray, ...]:
    """(fingerprint, the nearest smaller one, distance) within whole buckets; the smallest of equally near ones."""
    key, tile, fp, role = rows
    group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
    index, probe = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
    held = np.bincount(group[index], minlength=group[-1] + 1)
    first = np.r_[0, np.cumsum(held)[:-1]]
    probe = probe[held[group[probe]] > 0]
    n = held[group[probe]]
    ends = np.cumsum(n)
    signed = fp.view(np.int64)  # the order of the column
    found, at = [], 0
    while at < len(probe):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + pairs, "right")))
        m = n[at:to]
        left = np.repeat(probe[at:to], m)
        right = index[np.repeat(first[group[probe[at:to]]], m) + np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)]
        far = np.bitwise_count(fp[left] ^ fp[right])
        near = np.flatnonzero((far <= radius) & (signed[right] < signed[left]))
        _gather(found, _first([(signed[left[near]], signed[right[near]], far[near])], 1), 1)
        at = to
    return _first(found, 1) if found else (signed[:0], signed[:0], np.zeros(0, np.int32))


def _others(rows: tuple[np.ndarray, ...], radius: int, most: int, apart: int, pairs: int = PAIRS) -> tuple[np.ndarray, ...]:
    """(number, a smaller number of another component, distance) within whole buckets: for each number the ``most`` first by distance and number."""
    key, tile, fp, role, number, component = rows[:6]
    mark = rows[6].view(np.uint64)  # the bits of a negative number are counted without its sign
    group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
    index, probe = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
    held = np.bincount(group[index], minlength=group[-1] + 1)
    first = np.r_[0, np.cumsum(held)[:-1]]
    probe = probe[held[group[probe]] > 0]
    n = held[group[probe]]
    ends = np.cumsum(n)
    found, at = [], 0
    while at < len(probe):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + pairs, "right")))
        m = n[at:to]
        left = np.repeat(probe[at:to], m)
        right = index[np.repeat(first[group[probe[at:to]]], m) + np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)]
        far = np.bitwise_count(fp[left] ^ fp[right])
        near = np.flatnonzero((far <= radius) & (number[right] < number[left]))
        left, right = left[near], right[near]
        shared = np.bitwise_count(mark[left] ^ mark[right])
        kept = np.flatnonzero((shared <= apart) & (component[right] != component[left]))
        _gather(found, _first([(number[left[kept]], number[right[kept]], shared[kept])], most), most)
        at = to
    return _first(found, most) if found else (number[:0], number[:0], np.zeros(0, np.int32))


def _verify(radius: int, nearest: bool = False, most: int = 0, apart: int = BITS, rows_at_once: int = 1 << 18):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())] + [("d", pa.int32())] * (nearest or most > 0))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def taken(last: bool):
            rows = tuple(np.concatenate(c) for c in zip(*held))
            held.clear()
            if not last:
                key, tile = rows[0], rows[1]
                cut = len(key) - int(np.argmin((key == key[-1])[::-1] & (tile == tile[-1])[::-1]))
                if cut == len(key) and key[0] == key[-1] and tile[0] == tile[-1]:
                    cut = 0
                held.append(tuple(c[cut:] for c in rows))
                rows = tuple(c[:cut] for c in rows)
            return rows

        def out(rows):
            u, v, *d = _others(rows, radius, most, apart) if most else (_nearest if nearest else _links)(rows, radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), *map(pa.array, d)], schema=schema)

        for batch in batches:
            if batch.num_rows:
                key, at, fp, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                held.append((key, at, fp.view(np.uint64), *rest))
                if sum(len(h[0]) for h in held) >= rows_at_once and len((rows := taken(False))[0]):
                    yield out(rows)
        if held and len((rows := taken(True))[0]):
            yield out(rows)

    return of


def _dealt(classes: DataFrame, radius: int, segments: int, tile: int) -> DataFrame:
    """``(key, tile, fp, role)`` and further columns of ``classes(fp)``, with all that may be within ``radius`` bits in one bucket of key and tile.

    Each row is stored under its segments and, unless its column ``asks`` is
    false, asks for every value in the ball round each of them. Role 0 is
    stored only, 1 asks only, 2 is both.
    """
    width = BITS // segments
    masks = ball(width, radius // segments)
    wanted = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(m).cast("long").alias("m")) for s in range(segments) for m in masks])
    low = (1 << width) - 1
    asks = F.col("asks") if "asks" in classes.columns else F.lit(True)
    kind = (F.col("kind") if "kind" in classes.columns else F.lit(0)).cast("long")
    rest = [c for c in classes.columns if c not in ("fp", "asks", "kind")]
    role = F.when(F.col("w.m") != 0, 1).when(F.col("asks"), 2).otherwise(0)
    classes = classes.select("fp", *rest, asks.alias("asks"), kind.alias("kind"))
    rows = classes.select("fp", *rest, "asks", "kind", F.explode(wanted).alias("w")).filter(F.col("asks") | (F.col("w.m") == 0))
    rows = rows.select((F.expr(f"(shiftrightunsigned(fp, {width} * w.s) & {low}L) ^ w.m") * segments + F.col("w.s") + F.shiftleft("kind", 40)).alias("key"), F.lit(0).alias("tile"), "fp", role.alias("role"), *rest)
    stored = classes.select("fp", "kind", F.explode(F.array(*map(F.lit, range(segments)))).alias("s")).select((F.expr(f"shiftrightunsigned(fp, {width} * s) & {low}L") * segments + F.col("s") + F.shiftleft("kind", 40)).alias("key"))
    heavy = materialize(stored.groupBy("key").count().filter(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("blocks")), "heavy")
    n_heavy = heavy.count()
    if n_heavy:
        heavy = F.broadcast(heavy) if n_heavy <= 100_000 else heavy  # 12 bytes a row
        rows = rows.join(heavy, "key", "left")
        own = F.pmod(F.xxhash64("fp", *rest), F.col("blocks")).cast("int")
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        none = F.array().cast("array<struct<tile:int,role:int>>")
        spread = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("tile"), F.col("role").alias("role")))).otherwise(
            F.concat(
                F.when(F.col("role") != 0, F.transform(every, lambda i: F.struct((i * F.col("blocks") + own).alias("tile"), F.lit(1).alias("role")))).otherwise(none),
                F.when(F.col("role") != 1, F.transform(every, lambda j: F.struct((own * F.col("blocks") + j).alias("tile"), F.lit(0).alias("role")))).otherwise(none),
            )
        )
        rows = rows.select("key", "fp", *rest, F.explode(spread).alias("t")).select("key", "t.tile", "fp", "t.role", *rest)
    return rows.repartition("key", "tile").sortWithinPartitions("key", "tile")


def link_fingerprints(classes: DataFrame, radius: int = 3, segments: int = 2, tile: int = 2048, nearest: bool = False) -> DataFrame:
    """``(u, v)`` edges that join the distinct fingerprints ``classes(fp)`` within ``radius`` bits.

    Two fingerprints at most ``radius`` bits apart have a segment at most
    ``radius // segments`` bits apart. Each fingerprint is stored under its
    segments and asks for every value in the small Hamming ball round each of
    them; what meets under a value is verified on all 64 bits. A task emits a
    spanning forest of the links it has verified, never the pairs. Values under
    which more than ``tile`` fingerprints are stored are dealt out in a grid of
    tiles, so that no task holds such a bucket. With ``nearest`` there is one
    edge from each fingerprint to the nearest smaller one, if any is that near.
    """
    rows = _dealt(classes.select("fp"), radius, segments, tile)
    if not nearest:
        return rows.mapInArrow(_verify(radius), "u long, v long")
    found = rows.mapInArrow(_verify(radius, True), "u long, v long, d int")
    return found.groupBy("u").agg(F.min(F.struct("d", "v")).alias("n")).select("u", "n.v")


def other_components(rows: DataFrame, most: int, radius: int = 3, segments: int = 2, tile: int = 2048, apart: int = BITS) -> DataFrame:
    """``(u, near)`` of ``rows(kind, fp, number, component, mark, asks)``: for each number that asks, smaller numbers of other components within ``radius`` bits in any kind and within ``apart`` bits of their marks.

    They are the ``most`` first by distance of the marks and number, so fewer
    than ``most`` are all there are.
    """
    met = _dealt(rows.select("kind", "fp", "number", "component", "mark", "asks"), radius, segments, tile)
    found = met.mapInArrow(_verify(radius, most=most, apart=apart), "u long, v long, d int")
    return found.groupBy("u").agg(F.slice(F.sort_array(F.collect_set(F.struct("d", "v"))), 1, most).alias("n")).select("u", F.col("n.v").alias("near"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, segments: int = 2, tile: int = 2048) -> DataFrame:
    """``(id, fp, component_id)`` of every row of ``docs``.

    ``component_id`` is the smallest id that can be reached over links of at
    most ``radius`` differing bits. Equal fingerprints are one class with one
    representative from the start, so copies cost nothing further. Null and
    empty texts have fingerprint 0, which links like any other. Rows with a
    null id get a fingerprint but link nothing and have a null component unless
    a row with an id has their fingerprint. Rows that repeat an id are each
    returned. An empty table gives no rows. Other columns are not read.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = materialize(fps.filter("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    links = materialize(link_fingerprints(classes.select("fp"), radius, segments, tile), "links")
    edges = links.join(classes.select(F.col("fp").alias("u"), F.col("rep").alias("a")), "u").join(classes.select(F.col("fp").alias("v"), F.col("rep").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    named = classes.join(connected_components(edges), F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select("id", "fp", "component_id")


def shingle_sets(docs: DataFrame, width: int = 5, buckets: int | None = None) -> DataFrame:
    """``(id, shingles)`` of ``docs(id, text)``: the different hashes of a text's word shingles.

    With ``buckets`` it is ``(id, counts)``: how many of the hashes are in each
    of so many buckets, by remainder.
    """
    name, item, to = ("shingles", "long", pa.int64()) if buckets is None else ("counts", "int", pa.int32())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for text in batch.column(1):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                own = {xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(max(1, len(words) - width + 1))} if words else set()
                hashes = np.fromiter(own, np.uint64, len(own))
                sets.append(hashes.view(np.int64) if buckets is None else np.bincount((hashes % np.uint64(buckets)).astype(np.int64), minlength=buckets).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(to))], names=["id", name])

    return docs.mapInArrow(of, f"id {docs.schema['id'].dataType.simpleString()}, {name} array<{item}>")


def likely_pairs(docs: DataFrame, ids: DataFrame, seeds: Sequence[int] = (SEED, SEED + 1, SEED + 2), radius: int = 3) -> DataFrame:
    """Pairs ``(id, rep)`` of ``docs(id, text)`` among ``ids(id)`` whose word fingerprints are alike.

    For each seed a text is paired with the smallest id that has its
    fingerprint, and that one with the nearest smaller fingerprint within
    ``radius`` bits. So there are at most as many pairs as texts for each seed.
    """
    seeds = list(seeds)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_fingerprints(t.as_py(), seeds) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "fps"])

    fps = docs.select("id", "text").mapInArrow(of, f"id {docs.schema['id'].dataType.simpleString()}, fps array<long>")
    fps = materialize(fps.join(ids, "id", "left_semi"), "word_fingerprints")
    pairs = None
    for i in range(len(seeds)):
        own = fps.select("id", F.col("fps")[i].alias("fp"))
        classes = materialize(own.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
        links = materialize(link_fingerprints(classes.select("fp"), radius, nearest=True), "links")
        near = links.join(classes.select(F.col("fp").alias("u"), F.col("rep").alias("a")), "u").join(classes.select(F.col("fp").alias("v"), F.col("rep").alias("b")), "v").select("a", "b")
        same = own.join(classes, "fp").filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        pairs = near.union(same) if pairs is None else pairs.union(near).union(same)
    return pairs.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("rep")).distinct()


def similar_to(docs: DataFrame, pairs: DataFrame, width: int = 5, at_least: float = 0.8, buckets: int | None = 256) -> DataFrame:
    """Those of ``pairs(id, rep)`` whose texts in ``docs(id, text)`` share ``at_least`` of all shingles of both, counted exactly.

    Two texts share no more than the smaller of their counts in each bucket of
    hashes. Pairs that this bound rules out go first, so that only the shingles
    of the rest, most of which are similar, are shuffled. With None for
    ``buckets`` all pairs are counted at once, for pairs most of which are.
    """

    def met(among: DataFrame, buckets: int | None) -> DataFrame:
        ids = materialize(among.select("id").union(among.select("rep")).distinct(), "wanted")
        ids = F.broadcast(ids) if ids.count() <= SMALL else ids  # else the texts are shuffled to meet their ids
        found = materialize(shingle_sets(docs.join(ids, "id", "left_semi"), width, buckets).toDF("id", "a"), "shingles")
        return among.join(found, "id").join(found.select(F.col("id").alias("rep"), F.col("a").alias("b")), "rep")

    def enough(shared: Column, total: Column) -> Column:
        return (shared > 0) & (shared >= at_least * (total - shared))

    def add(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda x, y: x + y)

    if buckets is None:
        return met(pairs, None).filter(enough(F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b"))).select("id", "rep")
    bound = met(pairs, buckets).select("id", "rep", add(F.zip_with("a", "b", lambda x, y: F.least(x, y))).alias("most"), (add(F.col("a")) + add(F.col("b"))).alias("total"))
    likely = materialize(bound.filter(enough(F.col("most"), F.col("total"))).select("id", "rep"), "likely")
    return met(likely, None).filter(enough(F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b"))).select("id", "rep")


def word_marks(words: list[bytes], kinds: int) -> list[int]:
    """Signed 64-bit SimHashes of the same words; the first is by the words' XXH64, each further one by those mixed once more. 0 without words."""
    if not words:
        return [0] * kinds
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    ones = []
    for _ in range(kinds):
        ones.append(_ones(hashes))
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(32)
    return np.packbits(2 * np.array(ones) > len(words), axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def text_marks(docs: DataFrame, kinds: int, width: int = 3) -> DataFrame:
    """``(id, digest, mark, fps)`` of ``docs(id, text)``: 128 bits of the text's words, the fingerprint of its shingles, and ``kinds`` word fingerprints."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, marks, found = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                digests.append(xxhash.xxh3_128_digest(b" ".join(words), SEED))
                marks.append(fingerprint(text, width))
                found.append(word_marks(words, kinds))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(marks, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["id", "digest", "mark", "fps"])

    return docs.select("id", "text").mapInArrow(of, f"id {docs.schema['id'].dataType.simpleString()}, digest binary, mark long, fps array<long>")


def similar_leaders(
    docs: DataFrame, similarity: float = 0.8, kinds: int = 3, width: int = 3, radius: int = 3, segments: int = 2, tile: int = 2048, apart: int = 16, first: int = 1
) -> DataFrame:
    """``(id)``, the smallest of each component of ``docs(id, text)``.

    Links are texts of equal words, and pairs that share ``similarity`` of their
    five-word shingles, counted exactly. Pairs are counted if they are within
    ``radius`` bits by the SimHash of their shingles or one of ``kinds`` of
    their words, and in any case within ``apart`` bits by that of their
    shingles, where unrelated texts are some 32 bits apart and texts that share
    0.8 some 6; unless links found before join them. A round takes the ``first``
    nearest texts of other components for each text, the next eight times as
    many for those that had that many, until none has, so a group of copies
    costs few pairs whatever its size.
    """
    marks = materialize(text_marks(docs, kinds, width), "marks")
    items = marks.filter("id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("mark").alias("mark"), F.first("fps").alias("fps"))
    items = materialize(items.select("rep", "mark", "fps"), "items")
    numbers = materialize(items.select("rep").distinct().withColumn("number", F.monotonically_increasing_id()), "numbers")
    items = materialize(items.join(numbers, "rep").select("number", "mark", F.concat(F.array("mark"), "fps").alias("fps")), "items")
    named = lambda pairs: pairs.join(numbers.toDF("id", "u"), "u").join(numbers.toDF("rep", "v"), "v").select("id", "rep")
    numbered = lambda pairs: pairs.join(numbers.toDF("id", "u"), "id").join(numbers.toDF("rep", "v"), "rep").select("u", "v")
    near_by = lambda rows: materialize(other_components(rows, most, radius, segments, tile, apart), "near")
    asking = tested = edges = components = None
    most = first
    while asking is None or not asking.isEmpty():
        if asking is None:  # one kind after the other, as all texts ask
            near = None
            for i in range(1 + kinds):
                own = near_by(items.select("number", "mark", F.lit(i).alias("kind"), F.col("fps")[i].alias("fp"), F.col("number").alias("component"), F.lit(True).alias("asks")))
                near = own if near is None else near.union(own)
        else:
            rows = items if components is None else items.join(components.toDF("number", "component"), "number", "left")
            rows = rows.withColumn("component", F.lit(None).cast("long") if components is None else F.col("component")).withColumn("component", F.coalesce("component", "number"))
            rows = rows.join(asking.withColumn("asks", F.lit(True)), F.col("number") == F.col("u"), "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
            near = near_by(materialize(rows.select("number", "mark", "component", "asks", F.posexplode("fps").alias("kind", "fp")), "asking"))
        asking = near.filter(F.size("near") >= most).select("u").distinct()
        found = near.select("u", F.explode("near").alias("v"))
        new = found.distinct() if tested is None else found.distinct().join(tested, ["u", "v"], "left_anti")
        new = materialize(new, "pairs")
        tested = new if tested is None else tested.union(new)
        links = materialize(numbered(similar_to(docs, named(new), at_least=similarity, buckets=None)), "similar")
        if not links.isEmpty():
            edges = links if edges is None else edges.union(links)
            components = materialize(connected_components(edges), "components")
        most *= 8
    if components is None:
        return numbers.select(F.col("rep").alias("id"))
    of = numbers.join(components.toDF("number", "component"), "number", "left")
    return of.groupBy(F.coalesce("component", "number")).agg(F.min("rep").alias("id")).select("id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = 0.8, **how) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Links are pairs that share ``similarity`` of their five-word shingles,
    counted exactly, found among SimHash fingerprints and among those of single
    words for several seeds, which fewer bits move when a few words differ; see
    ``similar_leaders``. With None they are those of ``simhash_components``,
    not counted. Rows with a null id stay. Of rows that repeat an id one stays.
    """
    if similarity is None:
        found = materialize(simhash_components(docs, id_col, text_col, **how), "components")
        keep = materialize(found.filter("id = component_id").groupBy("id").count(), "kept")
    else:
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        leaders = similar_leaders(texts, similarity=similarity, **how)
        keep = materialize(texts.groupBy("id").count().join(leaders, "id", "left_semi"), "kept")
    repeated = keep.filter("count > 1").select("id")
    ids = keep.select(F.col("id").alias("__keep"))
    ids = F.broadcast(ids) if keep.count() <= SMALL else ids  # else the texts are shuffled to meet their ids
    kept = docs.join(ids, F.col(id_col) == F.col("__keep"), "left_semi")
    if not repeated.isEmpty():
        again = repeated.select(F.col("id").alias("__again"))
        kept = kept.join(again, F.col(id_col) == F.col("__again"), "left_anti").unionByName(kept.join(again, F.col(id_col) == F.col("__again"), "left_semi").dropDuplicates([id_col]))
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the smallest id of its component."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
