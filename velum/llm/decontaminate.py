"""Benchmark items in documents, by one Aho-Corasick automaton over normalised words."""

from __future__ import annotations

import re
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm.common import table, text_groups

#: Bytes that are part of a word after lower-casing: digits, letters and everything outside ASCII.
_TABLE = bytes(b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
BASE_OF_DIGITS = 104
MOST_WORDS = BASE_OF_DIGITS**3
RESULT = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<start:long,end:long>>>"
_RESULT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def item_windows(text: str | None, width: int) -> set[tuple[bytes, ...]]:
    """Windows of ``width`` consecutive words; a shorter item is one window, one without words has none."""
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


class Automaton:
    """All windows of some items in one automaton, each with the items that hold it.

    A word stands as a number of three digits, each place with signs of its own,
    so that matches begin with words, windows are short keys, and no state has
    more than BASE_OF_DIGITS ways on, as these are searched one by one.
    """

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        held: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            for w in item_windows(text, width):
                held[w].add(item)
        known = {w for window in held for w in window}
        if len(known) > MOST_WORDS:
            raise ValueError(f"more than {MOST_WORDS} different words in one block of items")
        first, second, third = ([chr(a + 256 * place) for a in range(1, BASE_OF_DIGITS + 1)] for place in range(1, 4))
        self.signs = {w: first[n // BASE_OF_DIGITS**2] + second[n // BASE_OF_DIGITS % BASE_OF_DIGITS] + third[n % BASE_OF_DIGITS] for n, w in enumerate(known)}
        self.machine = ahocorasick.Automaton()
        for window, ids in held.items():
            self.machine.add_word("".join(map(self.signs.__getitem__, window)), (len(window), tuple(ids)))
        self.empty = not held
        if held:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> list[tuple[int, int, tuple[str, ...]]]:
        """(number of the last word, words, items) of each occurrence."""
        if self.empty or not words:
            return []
        sign = self.signs.get
        return [(e // 3, *found) for e, found in self.machine.iter("".join([sign(w, "\0\0\0") for w in words]))]


def find_items(text: str | None, machines: list[Automaton]) -> dict:
    """Words, hit words, items found and the hit runs as offsets in the text, of one text."""
    plain = words(text)
    found = [x for m in machines for x in m.scan(plain)]
    if not found:
        return {"n_words": len(plain), "n_hit": 0, "items": [], "spans": []}
    end = np.fromiter((e + 1 for e, _, _ in found), np.int64, len(found))
    n = np.fromiter((k for _, k, _ in found), np.int64, len(found))
    edge = np.zeros(len(plain) + 1, np.int64)
    np.add.at(edge, end - n, 1)
    np.add.at(edge, end, -1)
    hit = np.cumsum(edge[:-1]) > 0
    turn = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    at = [m.span() for m in _WORD.finditer(text)]
    spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(turn[::2], turn[1::2])]
    return {"n_words": len(plain), "n_hit": int(hit.sum()), "items": sorted({i for _, _, ids in found for i in ids}), "spans": spans}


_BUILT: dict = {}


def contamination(benchmark: DataFrame, width: int = 8, item_col: str = "item_id", text_col: str = "text", block_bytes: int = 1 << 20):
    """A function from a text column to ``RESULT``.

    The items' texts are broadcast in blocks of about ``block_bytes`` bytes.
    One block is the rule and is one automaton, built once in each Python
    worker; a larger benchmark is more blocks, of which a worker holds one at a
    time and builds it for each batch of texts, so memory doesn't grow. Items with a null id or no words take no part; an id with several
    texts is one item with the windows of all.
    """
    spark = benchmark.sparkSession
    items = benchmark.filter(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    sent = [spark.sparkContext.broadcast([(r.item, r.text) for r in items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()]) for k in range(blocks)]

    def machine(block) -> Automaton:
        items = block.value
        if _BUILT.get("items") is not items:
            _BUILT.clear()
            _BUILT.update(items=items, machine=Automaton(items, width))
        return _BUILT["machine"]

    @F.arrow_udf(RESULT)
    def find(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        if len(sent) == 1:
            one = [machine(sent[0])]
            return pa.array([find_items(t, one) for t in values], _RESULT)
        out: list[dict] = []
        for a, b in text_groups([len(t or "") for t in values], 1 << 25):
            part = [{"n_words": 0, "n_hit": 0, "items": [], "spans": []} for _ in range(a, b)]
            for block in sent:
                one = [machine(block)]
                for k, t in enumerate(values[a:b]):
                    part[k] = _both(t, part[k], find_items(t, one))
            out += part
        return pa.array(out, _RESULT)

    return find


def _both(text: str | None, x: dict, y: dict) -> dict:
    if not x["items"] or not y["items"]:
        return y if y["items"] else x | {"n_words": y["n_words"]}
    spans: list[dict] = []
    for s in sorted([*x["spans"], *y["spans"]], key=lambda s: s["start"]):
        if spans and s["start"] <= spans[-1]["end"]:
            spans[-1] = {"start": spans[-1]["start"], "end": max(s["end"], spans[-1]["end"])}
        else:
            spans.append(dict(s))
    n = sum(len(_WORD.findall(text, s["start"], s["end"])) for s in spans)
    return {"n_words": y["n_words"], "n_hit": n, "items": sorted({*x["items"], *y["items"]}), "spans": spans}


def with_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "contamination", **how) -> DataFrame:
    """``docs`` with a struct of words, hit words, items found and hit runs (code points of the text).

    A null or empty text has no words. A column of ``docs`` with that name is
    replaced. No documents give no rows, no items no hits.
    """
    return docs.withColumn(out, contamination(benchmark, **how)(F.col(text_col).cast("string")))


def contaminated(result: Column, items: int = 2) -> Column:
    """Whether at least ``items`` items occur."""
    return F.size(result["items"]) >= items


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", items: int = 2, **how) -> DataFrame:
    """``docs`` without those in which at least ``items`` items occur."""
    find = contamination(benchmark, **how).asNondeterministic()  # else the filter would run it again
    marked = docs.withColumn("__found", find(F.col(text_col).cast("string")))
    return marked.filter(~contaminated(F.col("__found"), items)).drop("__found")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and benchmark items of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contamination.*")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


#: The same digest from windows as rows.
OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)
), found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, win)
), hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), held AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN held USING (doc_id)
"""
