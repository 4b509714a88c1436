"""Versioned schemas: validation, normalisation and stepwise upgrades (DC1-DC3)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A field; its default is a value or a function that gives a Column of the row."""

    type: str
    required: bool = False
    default: object = None
    check: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Schema:
    ns: str
    version: int
    fields: dict[str, Field]
    upgrade: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class SchemaRegistry:
    """Schemas by namespace and version; versions follow each other without gaps."""

    schemas: dict[str, list[Schema]] = field(default_factory=dict)

    def register(self, schema: Schema) -> None:
        own = self.schemas.setdefault(schema.ns, [])
        if schema.version != len(own) + 1:
            raise ValueError(f"{schema.ns}: version {len(own) + 1} comes next, not {schema.version}")
        own.append(schema)

    def get(self, ns: str, version: int | None = None) -> Schema:
        return self.schemas[ns][-1 if version is None else version - 1]

    def upgrade(self, df: DataFrame, ns: str, start: int) -> DataFrame:
        """Apply the upgrade of every version behind ``start``."""
        for schema in self.schemas[ns][start:]:
            df = schema.upgrade(df) if schema.upgrade else df
        return df


def validate(schema: Schema) -> Column:
    """The first thing wrong with a row, null if nothing is: missing fields first, then failing checks."""
    missing = [F.when(F.col(n).isNull(), F.lit(f"{n} is required")) for n, f in schema.fields.items() if f.required]
    failing = [F.when(F.col(n).isNotNull() & ~f.check(F.col(n)), F.lit(f"{n} is invalid")) for n, f in schema.fields.items() if f.check]
    return F.coalesce(*missing, *failing, F.lit(None).cast("string"))


def normalize(schema: Schema, df: DataFrame) -> DataFrame:
    """Empty collections are absent; absent fields take their default."""
    out = {}
    for n, f in schema.fields.items():
        c = F.when(F.size(n) > 0, F.col(n)) if f.type.startswith(("array", "map")) else F.col(n)
        out[n] = F.coalesce(c, f.default() if callable(f.default) else F.lit(f.default)) if f.default is not None else c
    return df.withColumns(out)
