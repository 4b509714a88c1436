"""Repeated multi-line chunks across documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velum.llm.common import materialize, table

#: Hashes up to which the table of repeated ones, some 16 bytes each, is broadcast.
SMALL = 1_000_000
#: A hash that more than one in so many pieces has is joined by broadcast: there are fewer of them than this.
FREQUENT = 500_000


def chunk_ends(hashes: Column, divisor: int, least: int) -> Column:
    """The numbers of the lines, from 1, that end a chunk.

    A rolling hash over the hashes of a line and the one before it marks a
    line; a marked line ends a chunk if none of the ``least - 1`` lines before
    it is marked. So a boundary depends on ``least + 1`` lines only, a chunk
    that moves within its document, or to another, keeps its boundaries, and
    has at least ``least`` lines; the last line ends the last one.
    """
    pairs = F.size(hashes) - 1
    marks = F.zip_with(F.slice(hashes, F.lit(1), pairs), F.slice(hashes, F.lit(2), pairs), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(divisor)) == 0)
    ends = marks
    for k in range(1, least):
        ends = F.zip_with(ends, F.slice(F.concat(F.array_repeat(F.lit(False), k), marks), F.lit(1), pairs), lambda a, b: a & ~b)
    places = F.filter(F.transform(ends, lambda m, i: F.when(m, i + 2)), lambda i: i.isNotNull())
    return F.array_union(F.when(F.size(hashes) > 1, places).otherwise(F.array().cast("array<int>")), F.array(F.size(hashes)))


def with_chunks(docs: DataFrame, text_col: str, divisor: int, least: int) -> DataFrame:
    """``docs`` with ``__lines``, their ``__hashes``, and ``__chunks``, an array of struct<first, n, hash>."""
    lined = docs.withColumn("__lines", F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1))
    hashed = lined.withColumn("__hashes", F.transform("__lines", lambda x: F.xxhash64(x)))
    ended = hashed.withColumn("__ends", chunk_ends(F.col("__hashes"), divisor, least))

    def chunk(end, k):
        first = F.when(k == 0, F.lit(0)).otherwise(F.get("__ends", k - 1)) + 1
        n = end - first + 1
        return F.struct(first.alias("first"), n.alias("n"), F.xxhash64(F.slice("__lines", first, n)).alias("hash"))

    return ended.withColumn("__chunks", F.transform("__ends", chunk)).drop("__ends")


def with_pieces(docs: DataFrame, text_col: str, divisor: int, least: int, words: int, texts: bool = False) -> DataFrame:
    """``docs`` with ``__pieces``, an array of struct<first, n, hash, chunk, words of each line>, or with ``texts`` of struct<hash, text>.

    Pieces are the chunks of two lines or more and, for what lies across their
    boundaries, all windows of two lines and the lines of ``words`` words. Each
    holds its own part of the text only, so that rows of them stay small.
    """
    chunked = with_chunks(docs, text_col, divisor, least).withColumn("__words", F.transform("__lines", lambda x: F.regexp_count(x, F.lit(r"\S+"))))
    pairs = F.greatest(F.size("__lines") - 1, F.lit(0))
    former, latter = (lambda c: F.slice(c, F.lit(1), pairs)), (lambda c: F.slice(c, F.lit(2), pairs))
    multi = F.filter("__chunks", lambda c: c["n"] >= 2)
    met = F.zip_with(former("__hashes"), latter("__hashes"), lambda a, b: F.xxhash64(b, a))
    long = lambda values: F.filter(F.zip_with("__words", values, lambda w, x: F.when(w >= words, x)), lambda x: x.isNotNull())
    if texts:
        own = lambda h, x: F.struct(h.alias("hash"), x.alias("text"))
        chunks = F.transform(multi, lambda c: own(c["hash"], F.array_join(F.slice("__lines", c["first"], c["n"]), "\n")))
        joined = F.zip_with(former("__lines"), latter("__lines"), lambda a, b: F.concat(a, F.lit("\n"), b))
        pieces = F.concat(chunks, F.zip_with(met, joined, own), F.zip_with(long("__hashes"), long("__lines"), own))
    else:
        own = lambda first, n, h, chunk, w: F.struct(first.alias("first"), F.lit(n).alias("n") if isinstance(n, int) else n.alias("n"), h.alias("hash"), F.lit(chunk).alias("chunk"), w.alias("words"))
        chunks = F.transform(multi, lambda c: own(c["first"], c["n"], c["hash"], True, F.slice("__words", c["first"], c["n"])))
        counts = F.zip_with(former("__words"), latter("__words"), lambda a, b: F.array(a, b))
        windows = F.transform(F.zip_with(met, counts, lambda h, w: F.struct(h.alias("h"), w.alias("w"))), lambda x, i: own(i + 1, 2, x["h"], False, x["w"]))
        placed = F.transform(F.zip_with("__words", "__hashes", lambda w, h: F.struct(w.alias("w"), h.alias("h"))), lambda x, i: own(i + 1, 1, x["h"], False, F.array(x["w"])))
        pieces = F.concat(chunks, windows, F.filter(placed, lambda p: F.get(p["words"], F.lit(0)) >= words))
    return chunked.withColumn("__pieces", pieces).drop("__chunks", "__hashes", "__words", "__lines")


def repeated_runs(docs: DataFrame, divisor: int, least: int, words: int) -> DataFrame:
    """``(id, version, first, n)`` of ``docs(id, version, text)``: the runs of lines to cut."""
    # explode_outer, as explode would compute all pieces a second time, inlined, to filter texts without any
    light = materialize(with_pieces(docs, "text", divisor, least, words).select("id", "version", F.explode_outer("__pieces").alias("p")).filter("p is not null").select("id", "version", "p.*"), "pieces")
    counted = light.groupBy("hash").agg(F.count("*").alias("times"), F.min(F.struct("id", "version", "first")).alias("leader"), F.max(F.struct("id", "version", "first")).alias("latest"))
    often = materialize(counted.filter(F.col("leader") != F.col("latest")).drop("latest"), "often")
    chosen = often.select("hash")
    chosen = F.broadcast(chosen) if often.count() <= SMALL else chosen
    texts = with_pieces(docs, "text", divisor, least, words, texts=True).select(F.explode_outer("__pieces").alias("p")).filter("p is not null").select("p.*").join(chosen, "hash", "left_semi")
    same = texts.groupBy("hash", "text").count().groupBy("hash").count().filter("count = 1").select("hash")
    sure = materialize(often.join(same, "hash", "left_semi"), "sure")
    n = light.count()
    limit = max(1, n // FREQUENT)
    cut = light.join(F.broadcast(sure.filter(F.col("times") > limit)), "hash")  # fewer than FREQUENT rows
    if limit > 1:
        cut = cut.unionByName(light.join(sure.filter(F.col("times") <= limit).hint("shuffle_merge"), "hash"))
    cut = cut.filter(F.struct("id", "version", "first") != F.col("leader"))
    lines = cut.select("id", "version", "chunk", "first", F.posexplode("words").alias("at", "n_words"))
    lines = lines.groupBy("id", "version", (F.col("first") + F.col("at")).alias("line")).agg(F.max("chunk").alias("chunk"), F.max("n_words").alias("n_words"))
    order = W.partitionBy("id", "version").orderBy("line")  # of one document
    runs = lines.withColumn("run", F.col("line") - F.row_number().over(order)).groupBy("id", "version", "run")
    runs = runs.agg(F.min("line").alias("first"), F.count("*").cast("int").alias("n"), F.max("chunk").alias("chunk"), F.sum("n_words").alias("n_words"))
    return runs.filter(F.col("chunk") | (F.col("n_words") >= words)).select("id", "version", "first", "n")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 2, least: int = 2, words: int = 50) -> DataFrame:
    """``docs`` with repeated chunks cut out of the text, and ``n_lines``, ``n_cut_lines``, ``n_cut_chunks`` (runs of lines cut).

    Texts are cut into chunks of whole lines at boundaries that depend on
    content. A chunk of two lines or more that occurs more than once over all
    documents stays where it is first, by id, version of the text and place,
    and goes elsewhere. What a chunk boundary divides is compared line by line:
    windows of two lines, and lines of ``words`` words, that occur more than
    once go likewise if they continue a chunk that goes, or if the run of them
    has ``words`` words. So every passage of whole lines and that many words
    stays once only, wherever boundaries are, and each line's text stays where
    it is first. Occurrences are found by hash and then compared as text; a
    hash that different texts share cuts nothing. Lines are divided by newlines.

    Null texts stay null, with no lines. Rows with a null id stay as they are
    and don't count. Rows that repeat an id and its text are one occurrence and
    stay alike; those that repeat an id only are two. Columns with the names of
    the new ones are replaced; no rows give no rows.
    """
    new = ("n_lines", "n_cut_lines", "n_cut_chunks")
    docs = docs.select(*[c for c in docs.columns if c not in new])
    keyed = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("version"), F.col(text_col).alias("text"))
    runs = repeated_runs(keyed, divisor, least, words)
    cuts = runs.groupBy("id", "version").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("__cuts")).withColumnsRenamed({"id": "__id", "version": "__version"})
    met = docs.withColumn("__v", F.xxhash64(F.col(text_col))).join(cuts, (F.col(id_col) == F.col("__id")) & (F.col("__v") == F.col("__version")), "left")
    lines = F.split(F.col(text_col).cast("string"), "\n", -1)
    from_ = F.concat(F.array(F.lit(1)), F.transform("__cuts", lambda c: c["first"] + c["n"]))
    to = F.concat(F.transform("__cuts", lambda c: c["first"]), F.array(F.size(lines) + 1))
    kept = F.flatten(F.zip_with(from_, to, lambda a, b: F.slice(lines, a, b - a)))
    n_cut = F.coalesce(F.aggregate("__cuts", F.lit(0), lambda acc, c: acc + c["n"]), F.lit(0)).cast("long")
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    cut_text = F.when(F.col("__cuts").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    columns = [cut_text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return met.select(*columns, n_lines.alias(new[0]), n_cut.alias(new[1]), F.coalesce(F.size("__cuts"), F.lit(0)).cast("long").alias(new[2]))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, cut lines and a digest of the text that is left."""
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_cut_lines", "n_cut_chunks", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))
