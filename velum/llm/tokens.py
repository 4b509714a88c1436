"""Token counts of byte-level BPE vocabularies, by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm.common import table, text_groups

#: Fixed value: the pattern by which byte-level vocabularies of this family split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NONE = np.iinfo(np.int32).max
CACHE = 1 << 20


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Memo(dict):
    """Counts by string. A string that isn't there is noted in ``asked`` and counts as MISSING until it is set."""

    MISSING = 1 << 40

    def __init__(self):
        self.asked: list[str] = []

    def __missing__(self, key: str) -> int:
        self.asked.append(key)
        self[key] = self.MISSING
        return self.MISSING

    def totals(self, rows: list[list[str]]) -> list[int]:
        self.asked = []
        get = self.__getitem__
        return [sum(map(get, r)) for r in rows]

    def again(self, rows: list[list[str]], totals: list[int]) -> list[int]:
        get = self.__getitem__
        return [n if n < self.MISSING else sum(map(get, r)) for r, n in zip(rows, totals)]


@dataclass
class BytePairs:
    """A vocabulary as arrays: the symbol of each byte, and merges sorted by pair."""

    byte_symbol: np.ndarray
    pair: np.ndarray
    rank: np.ndarray
    merged: np.ndarray
    n_symbols: int
    special: list[str]
    spaced: Memo = field(default_factory=Memo)
    known: Memo = field(default_factory=Memo)

    def __getstate__(self):
        return self.__dict__ | {"spaced": Memo(), "known": Memo()}

    @classmethod
    def from_file(cls, path: str) -> BytePairs:
        """Read a tokenizers JSON file with a byte-level BPE model, no normaliser and no added prefix space."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        n = max(vocab.values()) + 1
        order = np.argsort(left * n + right, kind="stable")
        return cls(
            np.array([vocab[c] for c in byte_alphabet()], np.int64),
            (left * n + right)[order],
            np.arange(len(merges), dtype=np.int32)[order],
            np.array([vocab[a + b] for a, b in merges], np.int64)[order],
            n,
            [t["content"] for t in spec["added_tokens"]],
        )

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = a * self.n_symbols + b
        at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
        return np.where(self.pair[at] == pair, self.rank[at], NONE), self.merged[at]

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols that are left of each piece.

        All pieces lie in one flat array. In each step every piece merges all
        occurrences of its own lowest-ranked pair, left to right, and only the
        pairs beside a merge are looked up again. Pieces with no pair left go.
        """
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        left = size.copy()
        sym = self.byte_symbol[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), size)
        rank = np.full(len(sym), NONE, np.int32)  # of the pair that begins here
        into = np.zeros(len(sym), np.int64)

        def look(i: np.ndarray) -> None:
            i = i[(i >= 0) & (i < len(sym) - 1)]
            same = piece[i] == piece[np.minimum(i + 1, len(sym) - 1)]
            rank[i[~same]] = NONE
            i = i[same]
            rank[i], into[i] = self._ranks(sym[i], sym[i + 1])

        look(np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            low = np.minimum.reduceat(rank, first)
            n = np.diff(np.r_[first, len(sym)])
            if (low == NONE).any():
                keep = np.repeat(low != NONE, n)
                sym, piece, rank, into = sym[keep], piece[keep], rank[keep], into[keep]
                continue
            hit = np.flatnonzero(rank == np.repeat(low, n))
            if len(hit) > 1:  # of overlapping pairs, as in "aaa", every other one merges
                run = np.r_[True, (hit[1:] != hit[:-1] + 1) | (piece[hit[1:]] != piece[hit[:-1]])]
                start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            np.subtract.at(left, piece[hit], 1)
            sym[hit] = into[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1
            sym, piece, rank, into = sym[keep], piece[keep], rank[keep], into[keep]
            if len(sym):
                rank[-1] = NONE
            look(np.concatenate([at, at - 1]))
        return left

    def count_pieces(self, texts: list[str]) -> list[int]:
        """Symbols of texts that are to be split by PATTERN; no special tokens."""
        found = [(_QUICK if _SIMPLE.fullmatch(t) else _SPLIT).findall(t) for t in texts]
        if len(self.known) > CACHE >> 2:
            self.known.clear()
        out = self.known.totals(found)
        if self.known.asked:
            fresh = self.known.asked
            for i in range(0, len(fresh), 1 << 15):
                part = fresh[i : i + (1 << 15)]
                self.known.update(zip(part, self.counts([p.encode("utf-8", "surrogatepass") for p in part]).tolist()))
            out = self.known.again(found, out)
        return out

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text.

        A text is cut before each single space that begins a piece of its own,
        so what stands between two spaces is counted once and kept. Texts with
        runs of white space that such cuts would divide are split as a whole.
        """
        out = [0] * len(texts)
        plain: list[tuple[int, list[str]]] = []
        whole: list[tuple[int, str]] = []
        for k, text in enumerate(texts):
            for s, part in enumerate(self._cut(text)):
                out[k] += s > 0
                if _DIVIDED.search(part):
                    whole.append((k, part))
                elif part:
                    first, *rest = part.split(" ")
                    whole.append((k, first))
                    plain.append((k, rest))
        for (k, _), n in zip(whole, self.count_pieces([t for _, t in whole])):
            out[k] += n
        if len(self.spaced) > CACHE:
            self.spaced.clear()
        units = [u for _, u in plain]
        totals = self.spaced.totals(units)
        if self.spaced.asked:
            fresh = self.spaced.asked
            self.spaced.update(zip(fresh, self.count_pieces([" " + u for u in fresh])))
            totals = self.spaced.again(units, totals)
        for (k, _), n in zip(plain, totals):
            out[k] += n
        return out

    def _cut(self, text: str) -> list[str]:
        """The text between special tokens."""
        if not any(s in text for s in self.special):
            return [text]
        return re.split("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))), text)


_SPLIT = regex.compile(PATTERN)
#: Characters for which the faster pattern splits alike, and that pattern.
_SIMPLE = re.compile("[\\t\\n\\r -~À-ÖØ-öø-ſ‘’“”–—…¿¡«»]*")
_QUICK = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_DIVIDED = re.compile(r"\s (?!\S)")


def token_counter(spark: SparkSession, path: str):
    """A function from a text column to its number of tokens, for the vocabulary at ``path``.

    The driver reads the file; its arrays, a few MB whatever the input, are broadcast.
    """
    pairs = spark.sparkContext.broadcast(BytePairs.from_file(path))

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        vocabulary = pairs.value
        values = [t or "" for t in texts.to_pylist()]
        out: list[int] = []
        for a, b in text_groups(list(map(len, values))):
            out += vocabulary.count_texts(values[a:b])
        return pa.array(out, pa.int64())

    return count


def with_token_counts(docs: DataFrame, path: str, text_col: str = "text", limit: int = 512, out: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit")) -> DataFrame:
    """``docs`` with bytes, tokens and whether there are more than ``limit`` tokens.

    Null and empty texts have 0 of both. Columns of ``docs`` with the names in
    ``out`` are replaced; repeated rows are each counted; no rows give no rows.
    A piece without white space of n bytes takes as many steps as it has
    different merges, each over what is left of it.
    """
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n_bytes, n_tokens, over = out
    counted = docs.withColumn(n_tokens, token_counter(docs.sparkSession, path)(text))
    return counted.withColumns({n_bytes: F.octet_length(text).cast("long"), over: F.col(n_tokens) > limit})


def op3_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs, path).select("doc_id", "n_bytes", "n_tokens", "over_limit")
