"""Secrets in texts, by one combined automaton over all rules."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm.automaton import Automaton, accept_places, longest
from velum.llm.common import table, text_groups


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regular expression and the least length of the run of ``tail`` characters at its end, or of all if there is no tail."""

    kind: str
    pattern: str
    least: int = 1
    tail: str = ""


#: The base kinds, then the kinds that this operator adds.
RULES = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", 8, "value"),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _value_length(match: bytes) -> int:
    """Length of what stands behind the first : or = of an assignment, its blanks and one quote."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
    rest = match[at:].lstrip(b" ")
    return len(rest) - (rest[:1] in (b'"', b"'"))


class Scanner:
    """The automata of some rules.

    One reads a text backwards, once, for all rules, and accepts where a match
    of a rule begins; the other finds from such a place how far it reaches.
    """

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        patterns = [r.pattern for r in rules]
        self.begins = Automaton(patterns, anywhere=True, backward=True)
        self.reach = Automaton(patterns)
        self._table, self._accepts = self.reach.next.tolist(), self.reach.accepts.tolist()

    def spans(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """Leftmost-longest matches of each rule that don't overlap each other, by start, then rule; code points."""
        out: list[list[tuple[str, int, int]]] = []
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        for a, b in text_groups(list(map(len, data)), 1 << 23):
            for d, places in zip(data[a:b], accept_places(self.begins, data[a:b])):
                out.append(self._resolve(d, places) if places else [])
        return out

    def _resolve(self, data: bytes, places: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        free = [0] * len(self.rules)
        found = []
        for start, mask in sorted(places):
            for k, rule in enumerate(self.rules):
                if mask >> k & 1 and start >= free[k]:
                    free[k] = end = longest(self.reach, data, start, self._table, self._accepts, k)
                    if (_value_length(data[start:end]) if rule.tail else end - start) >= rule.least:
                        found.append((start, k, end))
        if data.isascii():
            return [(self.rules[k].kind, s, e) for s, k, e in sorted(found)]
        points, at, by_byte = 0, 0, {}
        for x in sorted({x for s, _, e in found for x in (s, e)}):
            points += len(data[at:x].decode("utf-8", "surrogatepass"))
            at, by_byte[x] = x, points
        return [(self.rules[k].kind, by_byte[s], by_byte[e]) for s, k, e in sorted(found)]


def secret_finder(rules: tuple[Rule, ...] = RULES):
    """A function from a text column to ``SPANS``. The automata are built once in each Python worker."""

    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        scanner = _scanner(rules)
        return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in found] for found in scanner.spans(texts.to_pylist())], _SPANS)

    return find


_BUILT: dict[tuple[Rule, ...], Scanner] = {}


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _BUILT:
        _BUILT[rules] = Scanner(rules)
    return _BUILT[rules]


def with_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the spans of secrets, as code points of the text, end exclusive.

    Null and empty texts have none; a column with that name is replaced;
    repeated rows each get theirs; no rows give no rows. A match is as long as
    its rule allows; those under a rule's least length are dropped, but what
    they cover isn't searched again for that rule.
    """
    return docs.withColumn(out, secret_finder(rules)(F.col(text_col).cast("string")))


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secrets")
    count = {f"n_{k}": F.size(of_kinds(spans, k)).cast("long") for k in BASE}
    base = of_kinds(spans, *BASE)
    return docs.select("doc_id", *[c.alias(n) for n, c in count.items()], F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
