"""Who may read what: rules for repositories, by exact path or pattern."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = Callable[[str], Column]


class AuthRules:
    """Rules for repository paths; the first that matches decides, the built-in ones last, and a path without a rule is closed.

    A rule is a function of the user that gives a condition on the row. An exact
    path goes before a pattern.
    """

    def __init__(self) -> None:
        self.rules: list[tuple[str | re.Pattern, Rule]] = []

    def register(self, path: str | re.Pattern, rule: Rule) -> AuthRules:
        self.rules.append((path, rule))
        return self

    def _all(self, repo: Column) -> list[tuple[str | re.Pattern, Rule]]:
        built_in: list[tuple[str | re.Pattern, Rule]] = [
            ("/sys/sessions", lambda user: F.lit(True)),
            ("/sys/stats", lambda user: F.lit(False)),
            (re.compile("^/sys/.*$"), lambda user: F.lit(False)),
            (re.compile("^/user/[^/]+$"), lambda user: F.substring_index(repo, "/", -1) == user),
        ]
        every = [*self.rules, *built_in]
        return [x for x in every if isinstance(x[0], str)] + [x for x in every if not isinstance(x[0], str)]

    def readable(self, repo: Column, user: str, root: str | None = None, trusted: bool = False) -> Column:
        """Whether the user may read a row of ``repo``; the root user and trusted code may read all."""
        if trusted or (root is not None and user == root):
            return F.lit(True)
        found = None
        for path, rule in self._all(repo):
            match = repo == path if isinstance(path, str) else repo.rlike(path.pattern)
            found = F.when(match, rule(user)) if found is None else found.when(match, rule(user))
        return F.coalesce(found.otherwise(False), F.lit(False))


def of_org(org: Column, own: str) -> Column:
    """Rows of no organisation or of one's own."""
    return org.isNull() | (org == own)
