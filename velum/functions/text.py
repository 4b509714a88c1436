"""Strings as Columns: code points, neighbours in order, base 32, directions, file paths and ids (ST, P8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The alphabet of RFC 4648 in lower case; the first sign of padding is "_".
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"
#: Letters of scripts that run to the left.
RTL = "֑-߿יִ-﷽ﹰ-ﻼ"


def code_point_at(text: Column, index: int) -> Column:
    """The code point at an index from 0; null beyond the text (ST4)."""
    return F.when(F.length(text) > index, F.ascii(F.substring(text, index + 1, 1)))


def of_code_point(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def _last(text: Column) -> tuple[Column, Column]:
    return F.substring(text, F.lit(1), F.length(text) - 1), F.ascii(F.substring(text, -1, 1))


def next_string(text: Column) -> Column:
    """The text with its last character one higher, or with U+0001 behind it if none is higher or the text is empty (ST5)."""
    rest, code = _last(text)
    higher = F.when(code == 0xD7FF, 0xE000).otherwise(code + 1)
    return F.when((text == "") | (code == 0x10FFFF), F.concat(text, F.lit("\x01"))).otherwise(F.concat(rest, of_code_point(higher)))


def previous_string(text: Column) -> Column:
    """The text with its last character one lower, without it if it is U+0000; the empty text stays."""
    rest, code = _last(text)
    lower = F.when(code == 0xE000, 0xD7FF).otherwise(code - 1)
    return F.when(text == "", text).when(code == 0, rest).otherwise(F.concat(rest, of_code_point(lower)))


def _with(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def base32_encode(text: Column) -> Column:
    """UTF-8 in base 32, five bytes at a time (ST9)."""

    def eight(full: Column, g: Column) -> Column:
        number = F.conv(F.substring(full, g * 10 + 1, F.lit(10)), 16, 10).cast("long")
        return _with(number, lambda n: F.concat(*[F.substring(F.lit(BASE32), (F.shiftright(n, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for j in range(8)]))

    def code(digits: Column) -> Column:
        size = F.length(digits)
        groups = F.ceil(size / 10).cast("int")
        signs = _with(F.rpad(digits, groups * 10, F.lit("0")), lambda full: F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), lambda g: eight(full, g)), ""))
        used = F.ceil(size * 4 / 5).cast("int")
        pad = groups * 8 - used
        padding = F.when(pad > 0, F.concat(F.lit("_"), F.repeat(F.lit("="), pad - 1))).otherwise("")
        return F.concat(F.substring(signs, F.lit(1), used), padding)

    return F.when(text == "", "").otherwise(_with(F.hex(F.encode(text, "UTF-8")), code))


def base32_decode(code: Column) -> Column:
    """The text of ``base32_encode``."""

    def five(full: Column, g: Column) -> Column:
        n = F.lit(0).cast("long")
        for j in range(8):
            n = F.shiftleft(n, 5).bitwiseOR((F.instr(F.lit(BASE32), F.substring(full, g * 8 + 1 + j, F.lit(1))) - 1).cast("long"))
        return F.lpad(F.hex(n), 10, "0")

    def back(signs: Column) -> Column:
        groups = F.ceil(F.length(signs) / 8).cast("int")
        digits = _with(F.rpad(signs, groups * 8, F.lit("a")), lambda full: F.array_join(F.transform(F.sequence(F.lit(0), groups - 1), lambda g: five(full, g)), ""))
        return F.decode(F.unhex(F.substring(digits, F.lit(1), F.floor(F.length(signs) * 5 / 8).cast("int") * 2)), "UTF-8")

    return _with(F.rtrim(F.lower(code), F.lit("_=")), lambda signs: F.when(signs == "", "").otherwise(back(signs)))


def direction(text: Column, base: str = "auto") -> Column:
    """``rtl`` or ``ltr`` by the first letter with a direction, else ``base`` (ST7)."""
    first = F.regexp_extract(text, f"[A-Za-z_{RTL}]", 0)
    return F.when(F.coalesce(first, F.lit("")) == "", base).when(first.rlike("[A-Za-z_]"), "ltr").otherwise("rtl")


def match_ends(df: DataFrame, id_col: str, text: str, pattern: str) -> DataFrame:
    """``(id, n, end)``: where each match ends, ids being unique; the next one is looked for a character further on (ST10).

    The pattern must not match the empty text. A text is split at its matches, so
    the time is linear in its length.
    """
    whole = F.lit(f"(?s)({pattern}).?")
    pieces = F.arrays_zip(F.split(text, f"(?s)(?:{pattern}).?").alias("g"), F.regexp_extract_all(text, whole, F.lit(0)).alias("w"), F.regexp_extract_all(text, whole, F.lit(1)).alias("m"))
    each = df.select(id_col, F.posexplode(pieces).alias("n", "p")).filter("p.m is not null")
    each = each.select(id_col, "n", F.length("p.g").alias("g"), F.length("p.w").alias("w"), F.length("p.m").alias("m"))
    done = F.sum(F.col("g") + F.col("w")).over(W.partitionBy(id_col).orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    return each.select(id_col, "n", (done - F.col("w") + F.col("m")).alias("end"))


def unique_id(length: int = 24, seed: int | None = None) -> Column:
    """A random id of a-z and 0-9 (ST12)."""
    return F.lower(F.randstr(length) if seed is None else F.randstr(length, seed))


def resolve_path(path: Column) -> Column:
    """A path without empty parts, ``.`` and ``..``; an absolute one can't go above its root."""
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(done: Column, p: Column) -> Column:
        up = (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != "..")
        back = F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(absolute, done).otherwise(F.array_append(done, p))
        return F.when(p == "..", back).otherwise(F.array_append(done, p))

    clean = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(absolute, F.concat(F.lit("/"), clean)).when(clean == "", ".").otherwise(clean)


def is_absolute(path: Column) -> Column:
    return path.startswith("/")


def from_file_url(url: Column) -> Column:
    """The path of a ``file://`` URL, null of any other."""
    return F.when(url.startswith("file://"), F.url_decode(F.replace(F.regexp_replace(url, "^file://[^/]*", ""), F.lit("+"), F.lit("%2B"))))


def create_path(path: Column, seed: int | None = None) -> Column:
    """A path with an id of its own where it names a repository only."""
    return F.when(path.rlike("^/?[^/]+/[^/]+/?$"), F.concat(F.rtrim(path, F.lit("/")), F.lit("/"), unique_id(seed=seed))).otherwise(path)
