"""Order stamps: strings that keep a manual order, as Columns.

A stamp is a text over 62 signs in their order that never ends with the lowest
one, so there is always another between two of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from velum.functions.columns import common_prefix

SIGNS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MOST = 1 << 53


def _encoded(n: Column) -> Column:
    """16 hexadecimal digits in the order of numbers from -2**53 to 2**53."""
    return F.lpad(F.hex(n.cast("long") + MOST), 16, "0")


def of_number(n: Column, key: Column | None = None) -> Column:
    """Stamps in the order of whole numbers, then of a key of letters and digits."""
    return F.concat(F.lit("U"), _encoded(n), F.lit("") if key is None else key, F.lit("V"))


def end(now_ms: Column, key: Column | None = None) -> Column:
    """Behind every stamp of an earlier time."""
    return F.concat(F.lit("y"), _encoded(now_ms), F.lit("") if key is None else key, F.lit("V"))


def start(now_ms: Column, key: Column | None = None) -> Column:
    """Before every stamp of an earlier time."""
    return F.concat(F.lit("1"), _encoded(-now_ms.cast("long")), F.lit("") if key is None else key, F.lit("V"))


def _place(text: Column, at: Column) -> Column:
    """The rank of the sign behind ``at`` signs, -1 at the end."""
    sign = F.substring(text, at + 1, F.lit(1))
    return F.when(sign == "", -1).otherwise(F.instr(F.lit(SIGNS), sign) - 1)


def _sign(place: Column) -> Column:
    return F.substring(F.lit(SIGNS), place.cast("int") + 1, F.lit(1))


def between(a: Column, b: Column) -> Column:
    """A stamp between two; null unless ``a`` is before ``b``.

    Where the stamps part, a sign halfway is taken if there is one; else the
    lower stamp grows by a middle sign. If the lower one begins the higher one,
    the new one begins like it too and stays below what follows.
    """
    same = common_prefix(a, b)
    low, high = _place(a, same), _place(b, same)
    parted = F.when(high - low >= 2, F.concat(F.substring(a, F.lit(1), same), _sign(F.floor((low + high) / 2)))).otherwise(F.concat(a, F.lit("V")))
    rest = F.substring(b, F.length(a) + 1, F.length(b))
    zeros = F.length(rest) - F.length(F.ltrim(rest, F.lit("0")))
    first = _place(rest, zeros)
    more = F.when(first >= 2, _sign(F.floor(first / 2))).otherwise(F.lit("0V"))
    inside = F.concat(a, F.repeat(F.lit("0"), zeros), more)
    return F.when(a < b, F.when(same == F.length(a), inside).otherwise(parted))
