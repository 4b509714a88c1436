"""Personal data: patterns, and a span classifier trained on weak votes. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm.common import materialize, table

#: The base kinds and their patterns. Possessive repeats and the
#: look at what stands before keep the search linear, with the same matches.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that may be added, and where candidates for them are. Some are what base
#: matches that fail leave behind, as two cards side by side.
LOOSE = {
    "local_phone": r"(?<![0-9+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])",
    "intl_phone": r"(?:\+|(?<![0-9])00)[1-9][0-9]{0,2}[\x20-]?\(?[0-9]{2,4}\)?[\x20-]?[0-9]{3,4}[\x20-]?[0-9]{3,4}(?![0-9])",
    "card_group": r"(?<![0-9])[0-9]{4}(?:([\x20-]?)[0-9]{4})(?:\1[0-9]{4}){2}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "spelled_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "name": r"(?<![A-Za-z])(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?",
}
ORDER = [*BASE, *LOOSE]
#: A text needs one of these for candidates of the kind; else a digit.
NEEDS = {"email": "@", "phone": "+", "spelled_email": "at", "name": None}
#: Words that speak for a kind near it, and words that speak against any.
CUES = {
    "email": "e-?mail|contact|write|schreib|correo|courriel|adresse",
    "ip": "ip|address|server|host|login|client",
    "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "tel|phone|call|mobile|fax|anruf|llama|appel",
    "ssn": "ssn|social|security|tax",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "name": "name|contact|from|dear|signed|patient|client",
}
CUES |= {"local_phone": CUES["phone"], "intl_phone": CUES["phone"], "card_group": CUES["card"], "spelled_email": CUES["email"]}
AGAINST = r"(?i)\b(?:version|isbn|order|invoice|ticket|serial|release|article|figure)\b"
#: What speaks for a kind in the span itself; issuers of cards,
#: country and area codes, countries with IBANs, domains, given names.
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|de|fr|es|uk|eu|io)$",
    "ip": r"^(?:10|127|172|192)\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "local_phone": r"^\(?(?:20[1-7]|21[2-7]|30[1-5]|31[0-7]|41[0-9]|51[0-8]|61[0-9]|71[2-8]|80[0-8]|888|877|866|91[0-9])",
    "intl_phone": r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "spelled_email": r"(?:com|org|net|edu|gov|de|fr|es|uk|eu|io)$",
    "name": r"(?i)\b(?:anna|david|james|john|juan|maria|marie|michael|paul|peter|pierre|robert|sarah|thomas)\b",
}
GAZETTEER["card_group"] = GAZETTEER["card"]
#: Kinds of which a span that isn't in the gazetteer is voted against.
CLOSED = ("card", "card_group", "iban")
NEAR = 40
SPOT = "struct<start:bigint,end:bigint,found:string,before:string,after:string>"
SPAN = "struct<kind:string,start:bigint,end:bigint,votes:array<int>,size:int>"
PART = 512


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, zero: int, add: Callable[[Column, Column], Column]) -> Column:
    """For each of some longs, at least one, the sum of those before it; ``add`` is associative and ``zero`` its neutral value.

    Sums are taken in parts of PART values and then over the parts, as an array
    that grows by one is copied each time.
    """
    begin = F.struct(F.lit(zero).cast("long").alias("total"), F.array().cast("array<bigint>").alias("before"))

    def sums(of: Column, total: Callable[[Column], Column]) -> Column:
        return F.aggregate(of, begin, lambda acc, x: F.struct(add(acc["total"], total(x)).alias("total"), F.concat(acc["before"], F.array(acc["total"])).alias("before")))

    def whole(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PART).cast("int")), lambda k: sums(F.slice(v, k * PART + 1, F.lit(PART)), lambda x: x))
        return let(parts, lambda p: F.flatten(F.zip_with(p, sums(p, lambda x: x["total"])["before"], lambda own, at: F.transform(own["before"], lambda x: add(at, x)))))

    return let(values, whole)


def regex_spans(text: Column, pattern: str) -> Column:
    """array<SPOT> of a pattern's matches in code points, with up to NEAR characters on both sides, no further than to the next match.

    Pieces between the matches add up to their places, so the time is linear in
    the length of the text whatever the number of matches.
    """
    none = F.array().cast(f"array<{SPOT}>")

    def spans(found: Column, gaps: Column) -> Column:
        n = F.size(found)
        left, right = F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n)
        at = running(F.zip_with(left, found, lambda g, m: (F.length(g) + F.length(m)).cast("long")), 0, lambda a, b: a + b)
        former = F.zip_with(found, left, lambda m, g: F.struct(m.alias("found"), F.length(g).alias("gap"), F.substring(g, -NEAR, NEAR).alias("before")))
        latter = F.zip_with(at, right, lambda o, g: F.struct(o.alias("at"), F.substring(g, 1, NEAR).alias("after")))

        def spot(x, y):
            start = y["at"] + x["gap"]
            return F.struct(start.alias("start"), (start + F.length(x["found"])).alias("end"), x["found"].alias("found"), x["before"].alias("before"), y["after"].alias("after"))

        return F.zip_with(former, latter, spot)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: spans(found, gaps))).otherwise(none))


def luhn(digits: Column) -> Column:
    def add(acc, i):
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits)).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def mod97(found: Column) -> Column:
    """The remainder of an IBAN, whose letters are numbers from 10 on."""
    plain = F.replace(found, F.lit(" "), F.lit(""))
    signs = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")

    def step(acc, c):
        letter = c.rlike("[A-Z]")
        return F.when(letter, (acc * 100 + F.ascii(c) - 55) % 97).when(c == "", acc).otherwise((acc * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(signs, F.lit(0), step)


def _checked(kind: str, found: Column) -> Column:
    """Whether a span has the structure of its kind, beyond its pattern."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "email":
        return found.rlike("^[A-Za-z0-9]") & found.rlike(r"\.[A-Za-z]{2,}$") & ~F.contains(found, F.lit(".."))
    if kind == "ip":
        return ~found.rlike(r"^(?:0|22[4-9]|2[34][0-9]|25[0-5])\.|^(?:[0-9]\.){3}[0-9]$")
    if kind in ("card", "card_group"):
        return ~found.rlike(r"^([0-9])(?:[\x20-]?\1)+$") & luhn(digits)
    if kind in ("phone", "intl_phone"):
        number = F.regexp_replace(digits, "^00", "")
        return F.when(number.startswith("1"), number.rlike("^1[2-9][0-9]{2}[2-9][0-9]{6}$")).otherwise(F.length(number).between(9, 14))
    if kind == "local_phone":
        return digits.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
    if kind == "ssn":
        return found.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)")
    if kind == "iban":
        return mod97(found) == 1
    if kind == "name":
        return ~found.rlike(r"\x20(?:The|This|That|These|And|But|No|Not|Yes|Der|Die|Das|Und|Le|La|Les|Et|El|Los|Las|Y)\b")
    return ~found.rlike(r"\.\.")


def _votes(kind: str, found: Column, near: Column) -> Column:
    """Votes of the three labelers on a span: the pattern's own check, the gazetteer, the context."""
    gazetteer = F.when(found.rlike(GAZETTEER[kind]), 1).otherwise(-1 if kind in CLOSED else 0) if kind in GAZETTEER else F.lit(0)
    context = F.when(near.rlike(AGAINST), -1).when(near.rlike(f"(?i)(?<![a-z])(?:{CUES[kind]})"), 1).otherwise(0)
    return F.array(F.when(_checked(kind, found), 1).otherwise(-1), gazetteer, context)


def _voted(kind: str, found: Column, votes: Callable[[str, Column, Column], Column]) -> Column:
    def one(s):
        near = F.concat(s["before"], F.lit(" | "), s["after"])
        size = F.least(F.lit(3), F.floor((s["end"] - s["start"]) / 8).cast("int"))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), votes(kind, s["found"], near).cast("array<int>").alias("votes"), size.alias("size"))

    return F.transform(F.filter(found, lambda s: _valid(kind, s["found"])), one)


def _free(base: Column, loose: Column) -> Column:
    """Those of ``loose`` that meet none of ``base``, in the order of kinds, then by start.

    All are put in order, and the greatest end of base spans before each and the
    least start of those behind it are carried along, in linear time.
    """
    far = 1 << 60

    def marked(spans: Column, is_loose: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(is_loose).alias("loose"), s.alias("s")))

    ordered = F.sort_array(F.concat(marked(base, False), marked(loose, True)))

    def free(every: Column) -> Column:
        ended = running(F.transform(every, lambda x: F.when(x["loose"], -1).otherwise(x["end"]).cast("long")), -1, lambda a, b: F.greatest(a, b))
        begun = F.reverse(running(F.reverse(F.transform(every, lambda x: F.when(x["loose"], far).otherwise(x["start"]).cast("long"))), far, lambda a, b: F.least(a, b)))
        placed = F.zip_with(F.zip_with(every, ended, lambda x, e: F.struct(x.alias("x"), e.alias("e"))), begun, lambda y, b: F.struct(y["x"]["loose"].alias("loose"), (y["e"] <= y["x"]["start"]).alias("behind"), (b >= y["x"]["end"]).alias("before"), y["x"]["s"].alias("s")))
        kept = F.filter(placed, lambda y: y["loose"] & y["behind"] & y["before"])
        rank = lambda kind: F.array_position(F.array(*map(F.lit, LOOSE)), kind)
        return F.transform(F.sort_array(F.transform(kept, lambda y: F.struct(rank(y["s"]["kind"]).alias("k"), y["s"]["start"].alias("start"), y["s"].alias("s")))), lambda y: y["s"])

    return F.when((F.size(base) > 0) & (F.size(loose) > 0), let(ordered, free)).otherwise(loose)


def candidates(docs: DataFrame, text_col: str = "text", votes: Callable[[str, Column, Column], Column] = _votes) -> DataFrame:
    """``docs`` with ``__base`` and ``__loose``, arrays of SPAN; loose ones that meet a base one are left out."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    now = docs.withColumn("__digit", t.rlike("[0-9]"))
    none = F.array().cast(f"array<{SPAN}>")
    spans = {}
    for kind, pattern in {**BASE, **LOOSE}.items():
        need = F.contains(t, F.lit(NEEDS[kind])) if NEEDS.get(kind) else F.lit(True) if kind in NEEDS else F.col("__digit")
        spans[kind] = F.when(need, _voted(kind, regex_spans(t, pattern), votes)).otherwise(none)
    now = now.withColumns({"__base": F.concat(*[spans[k] for k in BASE]), "__all": F.concat(*[spans[k] for k in LOOSE])})
    return now.withColumn("__loose", _free(F.col("__base"), F.col("__all"))).drop("__all", "__digit")


#: A labeler's reliability at first and at most: the pattern's own check is nearly a proof, the others are hints.
RELIABLE = ((0.95, 0.99), (0.7, 0.8), (0.7, 0.8))


def estimate_by_kind(counts: dict[tuple[str, tuple[int, ...]], float], rounds: int = 50) -> tuple[dict[str, float], list[float], dict[tuple[str, tuple[int, ...]], float]]:
    """Expectation-maximisation over counts of (kind, votes): each kind's share of true spans, each labeler's reliability, and the posterior of each.

    A labeler that votes is right with its reliability, alike for true and
    false spans; abstaining says nothing. Counts have a row for each kind and
    pattern of votes, however many spans there are.
    """
    k = len(next(iter(counts), ("", (0, 0, 0)))[1])
    right, most = map(list, zip(*[*RELIABLE, *[RELIABLE[-1]] * k][:k]))
    prior = {kind: 0.7 for kind, _ in counts}
    posterior: dict[tuple[str, tuple[int, ...]], float] = {}
    for _ in range(rounds):
        for kind, votes in counts:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(v * math.log(r / (1 - r)) for v, r in zip(votes, right))
            posterior[kind, votes] = 1 / (1 + math.exp(-odds))
        for kind in prior:
            own = [(n, posterior[x]) for x, n in counts.items() if x[0] == kind]
            prior[kind] = min(0.99, max(0.01, (1 + sum(n * p for n, p in own)) / (2 + sum(n for n, _ in own))))
        for i in range(k):
            said = [(n, posterior[x] if x[1][i] > 0 else 1 - posterior[x]) for x, n in counts.items() if x[1][i]]
            right[i] = min(most[i], max(0.51, (4 + sum(n * p for n, p in said)) / (5 + sum(n for n, _ in said))))
    return prior, right, posterior


def estimate_reliabilities(patterns: dict[tuple[int, ...], float], rounds: int = 50) -> tuple[float, list[float], dict[tuple[int, ...], float]]:
    """``estimate_by_kind`` of spans of a single kind, by their votes only."""
    prior, right, posterior = estimate_by_kind({("", votes): n for votes, n in patterns.items()}, rounds)
    return prior.get("", 0.7), right, {votes: p for (_, votes), p in posterior.items()}


FEATURES = [f"kind={k}" for k in ORDER] + [f"size={k}" for k in range(4)] + [f"vote{i}={v}" for i, v in product(range(3), (-1, 1))]


def _features(kind: str, size: int, votes: tuple[int, ...]) -> list[int]:
    names = [f"kind={kind}", f"size={size}", *(f"vote{i}={v}" for i, v in enumerate(votes) if v)]
    return [FEATURES.index(n) for n in names]


def train_classifier(counts: list[tuple[str, int, tuple[int, ...], float]], rounds: int = 200) -> dict[str, float]:
    """Weights of a logistic classifier of spans, fitted to the posteriors of their votes; ``counts`` has (kind, size, votes, n)."""
    patterns: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind, _, votes, n in counts:
        patterns[kind, votes] = patterns.get((kind, votes), 0) + n
    _, _, posterior = estimate_by_kind(patterns)
    rows = [(_features(kind, size, votes), posterior[kind, votes], n) for kind, size, votes, n in counts]
    total = sum(n for _, _, n in rows)
    weights, bias = [0.0] * len(FEATURES), 0.0
    for _ in range(rounds if total else 0):
        slope, slope0 = [0.0] * len(FEATURES), 0.0
        for own, wanted, n in rows:
            p = 1 / (1 + math.exp(-bias - sum(weights[i] for i in own)))
            slope0 += (wanted - p) * n / total
            for i in own:
                slope[i] += (wanted - p) * n / total
        bias += 2 * slope0
        weights = [w + 2 * (g - 0.001 * w) for w, g in zip(weights, slope)]
    return {"bias": bias, **dict(zip(FEATURES, weights))}


def _probability(s: Column, weights: dict[str, float]) -> Column:
    score = F.lit(weights["bias"])
    for name in FEATURES:
        field, _, value = name.partition("=")
        own = s["kind"] == value if field == "kind" else s["size"] == int(value) if field == "size" else F.get(s["votes"], F.lit(int(field[4:]))) == int(value)
        score = score + F.when(own, F.lit(weights[name])).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5, votes: Callable[[str, Column, Column], Column] = _votes) -> DataFrame:
    """``(id, base, added)`` of every row: arrays of struct<kind, start, end>, in the order of the kinds, then by start.

    Base spans are the patterns' matches. Candidates of further kinds are added
    if the classifier gives them ``at_least``. It is trained on all spans of
    all rows: their votes are counted, expectation-maximisation over the counts
    gives each pattern of votes a probability, and the classifier is fitted to
    that. Null and empty texts have none; repeated rows each get theirs; other
    columns aren't read; no rows give no rows. Offsets are code points. The
    context of a span ends at the next match of its kind. ``votes`` gives the
    labelers' votes, each 1, 0 or -1, of a kind's span and its context.
    """
    rows = materialize(candidates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text")), "__text", votes).select("id", "__base", "__loose"), "candidates")
    spans = rows.select(F.explode(F.concat("__base", "__loose")).alias("s"))
    counted = spans.groupBy("s.kind", "s.size", "s.votes").count().collect()  # a row for each of at most 11 * 4 * 27 patterns
    weights = train_classifier([(r["kind"], r["size"], tuple(r["votes"]), float(r["count"])) for r in counted])

    def bare(spans):
        return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    added = F.filter("__loose", lambda s: _probability(s, weights) >= at_least)
    return rows.select("id", bare(F.col("__base")).alias("base"), F.when(F.size("__loose") > 0, bare(added)).otherwise(bare(F.col("__loose"))).alias("added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts, digest and spans."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), *map(_count, BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"))
