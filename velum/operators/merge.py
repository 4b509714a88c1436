"""Three-way merge and rebase in closed form (A12, G9-G11, DC10-DC12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_value(base: Column, *sides: Column) -> Column:
    """Sides from oldest to newest: the newest change to a value wins; a removal counts only where no side set a value."""
    changed = [F.when(s.isNotNull() & ~s.eqNullSafe(base), s) for s in reversed(sides)]
    removed = F.lit(False)
    for s in sides:
        removed = removed | s.isNull()
    return F.coalesce(*changed, F.when(~removed, base))


def merge_sets(base: Column, *sides: Column) -> Column:
    """Everything added to the base less everything removed from it."""
    out = base
    for s in sides:
        out = F.array_union(out, F.array_except(s, base))
    for s in sides:
        out = F.array_except(out, F.array_except(base, s))
    return F.sort_array(out)


def rebase_value(base: Column, local: Column, head: Column) -> Column:
    """A local change wins over the head, whatever the times."""
    return F.when(~local.eqNullSafe(base), local).otherwise(head)


def diff(before: Column, after: Column) -> Column:
    """struct<removed, added> of a field, null where nothing changed (DC4)."""
    return F.when(~before.eqNullSafe(after), F.struct(before.alias("removed"), after.alias("added")))


def changed_names(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """The names of the fields that differ, sorted (DC5)."""
    return F.array_sort(F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(n)) for n, (a, b) in pairs.items()])))


def patch_value(current: Column, removed: Column, added: Column) -> Column:
    """Set what was added; remove only what still stands as it was (DC6, DC10)."""
    return F.when(added.isNotNull(), added).when(current.eqNullSafe(removed), F.lit(None)).otherwise(current)


def set_diff(before: Column, after: Column) -> Column:
    """struct<removed, added> of two sets (DC11)."""
    return F.struct(F.array_except(before, after).alias("removed"), F.array_except(after, before).alias("added"))


def set_patch(current: Column, diff: Column) -> Column:
    return F.array_union(F.array_except(current, diff["removed"]), diff["added"])


def map_diff(before: Column, after: Column) -> Column:
    """struct<removed, added> of two maps: entries that are new or other, and those that are gone (DC12)."""
    added = F.map_filter(after, lambda k, v: ~F.try_element_at(before, k).eqNullSafe(v))
    removed = F.map_filter(before, lambda k, v: ~F.map_contains_key(after, k))
    return F.struct(removed.alias("removed"), added.alias("added"))


def map_patch(current: Column, diff: Column) -> Column:
    """Entries are set; one is removed only if it still stands as it was."""
    kept = F.map_filter(current, lambda k, v: ~F.map_contains_key(diff["added"], k) & ~F.coalesce(F.map_contains_key(diff["removed"], k) & F.try_element_at(diff["removed"], k).eqNullSafe(v), F.lit(False)))
    return F.map_concat(kept, diff["added"])


def merge_maps(base: Column, *sides: Column) -> Column:
    """``merge_value`` for every key (A12, G9); sides from oldest to newest."""
    keys = F.map_keys(base)
    for s in sides:
        keys = F.array_union(keys, F.map_keys(s))
    entries = F.transform(keys, lambda k: F.struct(k.alias("key"), merge_value(F.try_element_at(base, k), *[F.try_element_at(s, k) for s in sides]).alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def concat_changes(*sets: Column) -> Column:
    """Sets of changes one after the other as one; null ones count as empty, and null if there are none (DC7)."""
    joined = F.flatten(F.array_compact(F.array(*sets)))
    return F.when(F.size(joined) > 0, joined)


def rewrite_refs(df: DataFrame, id_col: str, refs: str, mapping: DataFrame) -> DataFrame:
    """``(id, refs)``: each reference replaced by its ``new`` one in ``mapping(old, new)``, kept where it has none (DC13).

    The mapping may be as large as the table: references are joined as rows.
    ``old`` must be unique; a set of references stays a set, null stays null.
    """
    each = df.select(id_col, F.explode_outer(refs).alias("old")).join(mapping.select("old", "new"), "old", "left")
    found = each.groupBy(id_col).agg(F.sort_array(F.collect_set(F.coalesce("new", "old"))).alias(refs))
    return found.join(df.filter(F.col(refs).isNull()).select(F.col(id_col), F.lit(True).alias("__none")), id_col, "left").select(id_col, F.when(F.col("__none").isNull(), F.col(refs)).alias(refs))
