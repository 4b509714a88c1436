"""Language identification by bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velum.llm.common import materialize, table, text_groups, text_parts

UNKNOWN = "und"
SIZES = (3, 4)
RESULT = "struct<lang:string,score:double,coverage:double>"
_RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("coverage", pa.float64())])
BLANK = 0x20
#: Characters of texts taken together, and of those whose n-grams are held at once; a worker's memory follows them, results don't.
TOGETHER, AT_ONCE = 1 << 19, 1 << 16


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def ngrams(texts: list[str], chunk: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, 64-bit hash) of all n-grams of ``SIZES`` letters.

    Texts are lower-cased, and everything but letters is a blank. An n-gram may
    have a blank at either end, for the bounds of a word, but not inside.
    """
    low = [t.lower() for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    if not len(low):
        return
    points = np.frombuffer(f" {' '.join(low)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.cumsum(size + 1) - size  # of each text, behind its blank
    for a in range(0, len(points), chunk):
        part = points[a : a + chunk + max(SIZES) - 1]
        letter = _letters()[part]
        sign = np.where(letter, part, BLANK).astype(np.uint64)
        n = min(chunk, len(part))
        inner = letter
        code = sign * np.uint64(0x9E3779B97F4A7C15)
        for k in range(1, max(SIZES)):
            if len(part) <= k:
                break
            code = (code[: len(part) - k] ^ sign[k:]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(32)
            if k > 1:
                inner = inner[: len(part) - k] & letter[k - 1 : len(part) - 1]
            else:
                inner = np.ones(len(part) - 1, bool)
            if k + 1 in SIZES:
                at = np.flatnonzero(inner[:n])
                yield np.searchsorted(start, a + at + 1, "right") - 1, _mix(code[at] + np.uint64(k))


@dataclass
class LanguageFilter:
    """A mask of languages in every slot; an n-gram's languages are those set in all of its slots. ``more`` has the masks of languages beyond the first word's."""

    langs: list[str]
    slots: np.ndarray
    false_rate: np.ndarray
    default: str
    more: tuple[np.ndarray, ...] = ()

    @staticmethod
    def places(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
        return (h & np.uint64(slots - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(slots - 1)).astype(np.int64)

    @classmethod
    def build(cls, langs: list[str], members: list[np.ndarray], default: str, slots: int = 1 << 20) -> LanguageFilter:
        kind = next((t for t in (np.uint8, np.uint16, np.uint32) if len(langs) <= 8 * np.dtype(t).itemsize), np.uint64)
        bits = 8 * np.dtype(kind).itemsize
        held = np.zeros((max(1, -(-len(langs) // bits)), slots), kind)
        for k, h in enumerate(members):
            for at in cls.places(h, slots):
                held[k // bits, at] |= kind(1 << k % bits)
        full = np.array([np.mean((held[k // bits] >> kind(k % bits)) & kind(1)) for k in range(len(langs))])
        return cls(langs, held[0], full**2, default, tuple(held[1:]))

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its n-grams, and for each language those that its filter holds."""
        n = np.zeros(len(texts), np.int64)
        held = np.zeros((len(texts), len(self.langs)), np.int64)
        for owner, h in ngrams(texts):
            a, b = self.places(h, len(self.slots))
            n += np.bincount(owner, minlength=len(texts))
            lo, hi = (int(owner.min()), int(owner.max()) + 1) if len(owner) else (0, 0)
            for word, slots in enumerate((self.slots, *self.more)):
                mask = slots[a] & slots[b]
                for byte in range(mask.itemsize):
                    low = ((mask >> mask.dtype.type(8 * byte)) & mask.dtype.type(0xFF)).astype(np.int64)
                    seen = np.bincount((owner - lo) * 256 + low, minlength=(hi - lo) * 256).reshape(hi - lo, 256)
                    for bit in range(8):
                        if (k := 8 * (word * mask.itemsize + byte) + bit) < len(self.langs):
                            held[lo:hi, k] += seen[:, (np.arange(256) >> bit) & 1 == 1].sum(axis=1)
        return n, held

    def predict(self, texts: list[str | None]) -> list[dict]:
        """Language, its share of all languages' counts, and the share of n-grams that it holds."""
        out: list[dict] = []
        for a, b in text_groups([len(t or "") for t in texts], TOGETHER):
            part = [t or "" for t in texts[a:b]]
            n, held = self.counts(part) if self.langs else (np.zeros(len(part), np.int64), np.zeros((len(part), 0)))
            true = np.maximum(0, (held - n[:, None] * self.false_rate) / (1 - self.false_rate))
            for t, total, row in zip(part, n.tolist(), true):
                if not self.langs or not (total or any(map(str.isalpha, t))):
                    out.append({"lang": UNKNOWN, "score": 0.0, "coverage": 0.0})
                elif (whole := row.sum()) <= 0:
                    out.append({"lang": self.default, "score": 0.0, "coverage": 0.0})
                else:
                    k = int(row.argmax())
                    out.append({"lang": self.langs[k], "score": float(row[k] / whole), "coverage": float(min(1.0, row[k] / total))})
        return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, hash, count) of a partition's n-grams, a row for each part of a batch, language and hash."""
    for batch in batches:
        langs, texts = batch.columns
        for lang in sorted(pc.unique(langs).to_pylist()):
            for part in text_parts(texts.filter(pc.equal(langs, lang)), TOGETHER):
                found = [h for _, h in ngrams(part)]
                if found:
                    h, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(h)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "h", "n"])


def train_language_filter(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_language: int = 4000, ngrams_per_language: int = 40_000, max_languages: int | None = None, least: int = 3, share: float = 0.5, slots: int = 1 << 20
) -> LanguageFilter:
    """Learn from rows that have a text and a language.

    The classifier is fitted on a bounded sample: about ``docs_per_language``
    whole texts of each language, or only of the ``max_languages`` most frequent
    ones, those whose id's hash is lowest. A language's filter gets the n-grams that occur
    at least ``least`` times in it and, in proportion to all of its n-grams, at
    least ``share`` times as often as in any other language: of these the
    ``ngrams_per_language`` most frequent ones.
    """
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    known = (counted if max_languages is None else counted.limit(max_languages)).collect()
    if not known:
        return LanguageFilter([], np.zeros(slots, np.uint8), np.zeros(0), UNKNOWN)
    taken = pa.table({"lang": pa.array([r["lang"] for r in known], pa.string()), "taken": pa.array([min(1.0, docs_per_language / r["count"]) for r in known], pa.float64())})
    taken = docs.sparkSession.createDataFrame(taken)  # rows in Python would start a second set of workers
    place = F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(F.broadcast(taken), "lang").filter(place < F.col("taken")).select("lang", "text")
    counts = materialize(sample.mapInArrow(_counted, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n")), "ngrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))  # a row for each language
    best = rate.groupBy("h").agg(F.max("rate").alias("best"))
    mine = rate.join(best, "h").filter((F.col("n") >= least) & (F.col("rate") >= share * F.col("best")))
    top = mine.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "h"))).filter(F.col("k") <= ngrams_per_language).select("lang", "h").toArrow()
    langs = sorted(r["lang"] for r in known)
    of, h = np.array(top.column("lang").to_pylist(), dtype=object), top.column("h").to_numpy().view(np.uint64)
    return LanguageFilter.build(langs, [h[of == x] for x in langs], min(known, key=lambda r: (-r["count"], r["lang"]))["lang"], slots)


def language_of(spark: SparkSession, model: LanguageFilter):
    """A function from a text column to ``RESULT``; the model's size is fixed by its parameters, and it is broadcast."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        return pa.array([x for part in text_parts(texts, TOGETHER) for x in sent.value.predict(part)], _RESULT)

    return predict


def with_language(docs: DataFrame, model: LanguageFilter, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct of language, score and coverage.

    Null texts and texts without a letter are ``und`` with score 0; so is every
    text if nothing was learned. A text of which no n-gram is known has the most
    frequent language and score 0; ties go to the language that sorts first. A
    column with that name is replaced, repeated rows each get theirs, no rows
    give no rows.
    """
    return docs.withColumn(out, language_of(docs.sparkSession, model)(F.col(text_col).cast("string")))


def keep_known_languages(docs: DataFrame, model: LanguageFilter, text_col: str = "text", coverage: float = 0.05) -> DataFrame:
    """``docs`` without texts that are ``und`` or of which the best language holds less than ``coverage`` of the n-grams."""
    predict = language_of(docs.sparkSession, model).asNondeterministic()  # else the filter would run it again
    marked = docs.withColumn("__language", predict(F.col(text_col).cast("string")))
    return marked.filter((F.col("__language.lang") != UNKNOWN) & (F.col("__language.coverage") >= coverage)).drop("__language")


def held_out(id_col: str = "doc_id"):
    """Whether the CRC of an id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.filter(F.crc32(F.col(id_col).cast("string")) % 5 != 0)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, from what the documents that are not held out teach."""
    docs = table(spark, sf_dir, "documents")
    model = train_language_filter(training_rows(docs))
    found = with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.coverage").alias("coverage"))
