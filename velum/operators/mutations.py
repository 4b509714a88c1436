"""Packs of mutations: what changed in an item, in order, as array<struct<field, local, value>> (DC14, DC15, T11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mutation(field: Column, local: Column, value: Column) -> Column:
    return F.struct(field.alias("field"), local.alias("local"), value.alias("value"))


def append(pack: Column, one: Column) -> Column:
    """The pack with one more; a pack that is null begins with it."""
    return F.coalesce(F.array_append(pack, one), F.array(one))


def optimize(pack: Column) -> Column:
    """The first mutation of each field, in order."""
    fields = F.transform(pack, lambda m: m["field"])
    return F.filter(pack, lambda m, i: F.array_position(fields, m["field"]) == i + 1)


def is_empty(pack: Column) -> Column:
    return F.coalesce(F.size(pack), F.lit(0)) <= 0


def has_local(pack: Column) -> Column:
    return F.coalesce(F.exists(pack, lambda m: m["local"]), F.lit(False))


def has_remote(pack: Column) -> Column:
    return F.coalesce(F.exists(pack, lambda m: ~m["local"]), F.lit(False))


def has_field(pack: Column, *names: str) -> Column:
    return F.coalesce(F.exists(pack, lambda m: m["field"].isin(*names)), F.lit(False))


def delete_field(pack: Column, name: str) -> Column:
    return F.filter(pack, lambda m: m["field"] != name)


def subtract_fields(pack: Column, other: Column) -> Column:
    """Those whose field the other pack doesn't have."""
    theirs = F.transform(other, lambda m: m["field"])
    return F.coalesce(F.filter(pack, lambda m: ~F.array_contains(theirs, m["field"])), pack)


def apply(values: Column, pack: Column) -> Column:
    """A map of fields after all mutations; a null value removes its field."""
    last = F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform(pack, lambda m: m["field"])),
            lambda f: F.struct(f.alias("key"), F.element_at(F.filter(pack, lambda m: m["field"] == f), -1)["value"].alias("value")),
        )
    )
    kept = F.map_filter(values, lambda k, v: ~F.map_contains_key(last, k))
    return F.map_concat(kept, F.map_filter(last, lambda k, v: v.isNotNull()))
