"""Scalar functions as Columns: paths, strings, dates, numbers, versions and sets."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: an address is one @ between a name and a dotted domain.
EMAIL = r"^[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)+$"
EPSILON = 2.220446049250313e-16
MAX_MS = 8_640_000_000_000_000


# Paths (P1-P7)
def item_path(*parts: Column) -> Column:
    return F.concat(F.lit("/"), F.concat_ws("/", *parts))


def path_part(path: Column, n: int) -> Column:
    """The n-th part from 1; null where there is none; the first slash may be missing."""
    part = F.get(F.split(F.ltrim(path, F.lit("/")), "/"), F.lit(n - 1))
    return F.when(part != "", part)


def path_repo(path: Column) -> Column:
    return F.concat(F.lit("/"), path_part(path, 1), F.lit("/"), path_part(path, 2))


def path_normalize(path: Column) -> Column:
    return F.concat(F.lit("/"), F.regexp_replace(F.trim(path, F.lit("/")), "/+", "/"))


def path_join(a: Column, b: Column) -> Column:
    return F.concat(F.rtrim(a, F.lit("/")), F.lit("/"), F.ltrim(b, F.lit("/")))


def path_valid(path: Column) -> Column:
    return path.rlike("^/[a-z0-9_/-]*$") & (F.length(path) - F.length(F.replace(path, F.lit("/"))) <= 4)


# Strings (ST)
def splice(text: Column, start: int, delete: int, new: str) -> Column:
    return F.concat(F.substring(text, 1, start), F.lit(new), F.substring(text, start + delete + 1, 1 << 30))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix: the length compared is halved until it is found, in 32 steps."""
    start = F.struct(F.lit(0).alias("low"), F.least(F.length(a), F.length(b)).alias("high"))

    def halve(acc, _):
        middle = ((acc["low"] + acc["high"] + 1) / 2).cast("int")
        same = F.substring(a, acc["low"] + 1, middle - acc["low"]) == F.substring(b, acc["low"] + 1, middle - acc["low"])
        return F.struct(F.when(same, middle).otherwise(acc["low"]).alias("low"), F.when(same, acc["high"]).otherwise(middle - 1).alias("high"))

    steps = F.array(*[F.lit(k) for k in range(32)])
    return F.aggregate(steps, start, lambda acc, k: F.when(acc["low"] < acc["high"], halve(acc, k)).otherwise(acc), lambda acc: acc["low"])


def common_suffix(a: Column, b: Column) -> Column:
    """Length of the longest common suffix."""
    return common_prefix(F.reverse(a), F.reverse(b))


def append_component(path: Column, name: Column) -> Column:
    """A path with one more part, with one slash between them (ST6)."""
    return F.when(path == "", name).otherwise(F.concat(F.rtrim(path, F.lit("/")), F.lit("/"), F.ltrim(name, F.lit("/"))))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by code points (ST11)."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def number_of(value: Column, seed: int) -> Column:
    """A 32-bit number of a value and a seed, alike in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), value.cast("string"))), 1, 8), 16, 10).cast("long")


def checksum(fields: dict[str, Column]) -> Column:
    """MD5 of a document's fields in the order of their names; a field is told from an absent one and from any other split."""
    parts = []
    for name in sorted(fields):
        value = fields[name].cast("string")
        parts.append(F.coalesce(F.concat(F.lit(f"{name}:"), F.length(value).cast("string"), F.lit(":"), value, F.lit(";")), F.lit(f"{name};")))
    return F.md5(F.concat(*parts))


def rendezvous(peer: Column, key: Column) -> Column:
    """Of a group's peers the one with the least hash of peer and key."""
    return F.min_by(peer, F.struct(F.md5(F.concat_ws("/", peer, key.cast("string"))), peer))


# File paths
def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extname(path: Column) -> Column:
    """With its dot; empty without one or if the name only begins with one."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


# Arrays (L6)
def insertion_point(sorted_values: Column, x: Column) -> Column:
    """How many values of a sorted array are smaller; -1 if all are, or if there are none."""
    n = F.size(F.filter(sorted_values, lambda v: v < x))
    return F.when(n == F.size(sorted_values), -1).otherwise(n)


def is_rtl(text: Column) -> Column:
    """Whether the first letter with a direction is of a script that runs to the left."""
    return text.rlike(r"^[^A-Za-zÀ-ʸͰ-֐ऀ-῿]*[֑-߿יִ-﷽ﹰ-ﻼ]")


def normalize_email(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.rlike(EMAIL), low)


# Values (V)
def json_kind(value: Column) -> Column:
    """``object``, ``array``, ``string``, ``number``, ``boolean`` or ``null``, by the JSON text or, of other texts, ``string`` (V5)."""
    kind = F.schema_of_variant(F.try_parse_json(value))
    named = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
    return F.when(value.isNull(), "null").otherwise(F.coalesce(named, F.lit("string")))


# Dates (D)
def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def from_number(x: Column) -> Column:
    """Numbers under 1e12 are seconds, others milliseconds."""
    return F.timestamp_micros(F.round(F.when(x < 1e12, x * 1e6).otherwise(x * 1e3)).cast("long"))


def week_start(ts: Column) -> Column:
    """The Sunday on or before."""
    return F.date_sub(ts.cast("date"), F.dayofweek(ts.cast("date")) - 1)


def workdays_left_in_week(ts: Column) -> Column:
    return F.greatest(F.lit(0), 6 - F.dayofweek(ts.cast("date")))


def days_in_month(ts: Column) -> Column:
    return F.day(F.last_day(ts.cast("date")))


def day_label(ts: Column, today: Column) -> Column:
    gap = F.datediff(today, ts.cast("date"))
    return F.when(gap == 0, "Today").when(gap == 1, "Yesterday").otherwise(F.date_format(ts.cast("date"), "yyyy-MM-dd"))


#: Milliseconds of each unit.
MS = {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}


def to_ms(n: Column, unit: str) -> Column:
    """So many units as milliseconds."""
    return (n * MS[unit]).cast("long")


def reverse_ms(ms: Column) -> Column:
    """A number that sorts the other way round; applied twice it is the time again."""
    return F.lit(MAX_MS) - ms


# Numbers (MA)
def random_int(value: Column, low: int, high: int, seed: int) -> Column:
    """A whole number from ``low`` up to but without ``high``, the same for a value and seed (MA4, L10)."""
    return F.lit(low) + number_of(value, seed) % (high - low)


def agreement_size(n: Column) -> Column:
    """How many of the newest commits must agree on a leaf: 2 log2(n) / log2(4), rounded up (MA7)."""
    return F.ceil(2 * F.log2(n) / math.log2(4))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ease(kind: str, x: Column) -> Column:
    if kind in ("linear", "quad", "sine"):
        x = clip(x, 0.0, 1.0)
    return {
        "linear": x,
        "quad": x * x,
        "sine": -(F.cos(x * math.pi) - 1) / 2,
        "quint": F.when(x < 0.5, 16 * F.pow(x, F.lit(5.0))).otherwise(1 - F.pow(2 - 2 * x, F.lit(5.0)) / 2),
        "expo": F.when(x == 0, 0.0).otherwise(F.pow(F.lit(2.0), 10 * x - 10)),
    }[kind]


def nearly_equal(a: Column, b: Column) -> Column:
    return F.abs(a - b) < EPSILON


def pack_version(*parts: Column) -> Column:
    return reduce(lambda a, b: F.shiftleft(a, 8).bitwiseOR(b), [p.cast("long") for p in parts])


def unpack_version(packed: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(packed, 8 * k).bitwiseAND(F.lit(255)).cast("string") for k in (3, 2, 1, 0)])


def bloom_bits(n: Column, p: Column) -> Column:
    return F.ceil(n * F.log(p) / math.log(1 / 2 ** math.log(2)))


def bloom_hashes(bits: Column, n: Column, most: int) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(1), F.round(bits / n * math.log(2)).cast("int")))


# Sets (U)
def set_difference(a: Column, b: Column) -> Column:
    """The elements of one of both only."""
    return F.sort_array(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def set_equal(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def set_equal_where(a: Column, b: Column, test) -> Column:
    """Whether both have the same of the elements that pass a test."""
    return set_equal(F.filter(a, test), F.filter(b, test))


def map_equal(a: Column, b: Column) -> Column:
    """Whether two maps have the same entries, in any order (V6, V7)."""
    return F.array_sort(F.map_entries(a)).eqNullSafe(F.array_sort(F.map_entries(b)))


def toggle(a: Column, x: Column) -> Column:
    return F.sort_array(F.when(F.array_contains(a, x), F.array_remove(a, x)).otherwise(F.array_append(a, x)))
