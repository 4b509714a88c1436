"""The declarative query: filter, namespace, order and limit over documents; queries chain (F, L, J8, T5)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    """A view over documents with columns ``path``, ``ns``, ``is_deleted``, ``age`` and fields.

    ``predicate`` and ``sort_by`` are Columns, names or functions of the context;
    missing values sort first upwards and last downwards, and ties go by age and
    path. Deleted documents never show; documents without a namespace don't
    where one is asked for. ``count`` is that of all matches, before ``limit``.
    """

    source: DataFrame | Query
    predicate: Column | Callable[[dict], Column] | None = None
    schema: str | None = None
    sort_by: str | Sequence[str] | None = None
    descending: bool = False
    limit: int = 0
    ctx: dict = field(default_factory=dict)

    @property
    def id(self) -> str:
        """A name made of every part of the configuration."""
        parts = [self.source.id if isinstance(self.source, Query) else str(self.source.columns), str(self.predicate(self.ctx) if callable(self.predicate) else self.predicate), str(self.schema), str(self.sort_by), str(self.descending), str(self.limit), json.dumps(self.ctx, sort_keys=True, default=str)]
        return hashlib.md5("|".join(parts).encode()).hexdigest()

    def matches(self) -> DataFrame:
        df = self.source.results() if isinstance(self.source, Query) else self.source
        if self.schema is not None:
            df = df.filter(F.col("ns") == self.schema)
        df = df.filter(~F.coalesce(F.col("is_deleted"), F.lit(False)))
        if self.predicate is not None:
            df = df.filter(self.predicate(self.ctx) if callable(self.predicate) else self.predicate)
        return df

    def order(self) -> list[Column]:
        names = [] if self.sort_by is None else [self.sort_by] if isinstance(self.sort_by, str) else list(self.sort_by)
        keys = [F.desc_nulls_last(n) if self.descending else F.asc_nulls_first(n) for n in names]
        return [*keys, F.asc("age"), F.asc("path")]

    def results(self) -> DataFrame:
        df = self.matches()
        if self.limit:
            return df.orderBy(*self.order()).limit(self.limit)
        return df.orderBy(*self.order()) if self.sort_by is not None else df

    def count(self) -> DataFrame:
        return self.matches().agg(F.count("*").alias("n"))

    def paths(self) -> DataFrame:
        return self.results().select("path")

    def entries(self) -> DataFrame:
        df = self.results()
        return df.select("path", F.struct(*[c for c in df.columns if c != "path"]).alias("item"))

    def has(self, paths: DataFrame) -> DataFrame:
        """``paths(path)`` with whether the query has them."""
        mine = self.results().select("path", F.lit(True).alias("__in")).dropDuplicates(["path"])
        return paths.join(mine, "path", "left").select("path", F.coalesce("__in", F.lit(False)).alias("has"))

    def find(self, name: str, value) -> DataFrame:
        """The first document, in the query's order, whose field has the value."""
        return self.matches().filter(F.col(name) == F.lit(value)).orderBy(*self.order()).limit(1)
