"""Rich text: trees as JSON, ``{"root": {"children": [...]}}``, of elements (``tag``, ``children``) and texts (``text``).

Trees recurse, which no struct type can express, so these are Arrow-batched
UDFs over JSON strings. Null stays null; further fields of a node are its
attributes and are kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What stands before the text of these elements.
PREFIXES = {"h1": "# ", "h2": "## ", "li": "* ", "ref": "- "}

#: What differs in more than so many places is divided in the middle of a shortest way first, so that memory stays linear.
DEEP = 500

Atom = tuple[str, str, str]  # open, text or close; tag or character; attributes


def walk(tree: dict) -> Iterator[tuple[dict, int, str]]:
    """(node, depth, path) in depth-first order; the root has depth 0 and an empty path."""
    open_ = [(tree["root"], 0, "")]
    while open_:
        node, depth, path = open_.pop()
        yield node, depth, path
        open_ += [(c, depth + 1, f"{path}/{k}") for k, c in reversed(list(enumerate(node.get("children", []))))]


def to_plain_text(tree: dict) -> str:
    """All texts; a line break before each element but the first two nodes."""
    nodes = [node for node, depth, _ in walk(tree) if depth]
    return "".join(node["text"] if "text" in node else "\n" if at > 1 else "" for at, node in enumerate(nodes))


def to_markdown(tree: dict) -> str:
    """Texts and the prefixes of their elements; a line break wherever the depth changes."""
    out, before = [], 2
    for node, depth, _ in walk(tree):
        if depth:
            out += ["\n" * (depth != before), PREFIXES.get(node.get("tag"), ""), node.get("text", "")]
            before = depth
    return "".join(out)


def atoms(tree: dict) -> list[Atom]:
    """The flat form: an atom where an element opens and where it closes, and one for each character."""
    out: list[Atom] = []
    todo: list[dict | Atom] = list(reversed(tree["root"].get("children", [])))
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            out.append(node)
            continue
        attributes = json.dumps({k: v for k, v in node.items() if k not in ("tag", "children", "text")}, sort_keys=True)
        if "text" in node:
            out += [("text", c, attributes) for c in node["text"]]
        else:
            out.append(("open", node.get("tag", ""), attributes))
            todo.append(("close", node.get("tag", ""), ""))
            todo += reversed(node.get("children", []))
    return out


def rebuild(flat: Iterable[Atom]) -> dict:
    """The normal tree of a flat form, even if a merge left it unbalanced.

    Neighbouring characters of equal attributes are one text, elements without
    children get an empty text, texts outside of elements get a paragraph, and
    a tree of nothing is one empty paragraph.
    """
    root: dict = {"children": []}
    path = [root]

    def leave() -> None:
        node = path.pop()
        node["children"] = node["children"] or [{"text": ""}]

    for (kind, _), run in groupby(flat, key=lambda a: (a[0], a[2] if a[0] == "text" else "")):
        for atom in [("text", "".join(a[1] for a in group), group[0][2])] if kind == "text" and (group := list(run)) else run:
            if kind == "text":
                if len(path) == 1:
                    path[0]["children"].append({"tag": "p", "children": [{**json.loads(atom[2]), "text": atom[1]}]})
                else:
                    path[-1]["children"].append({**json.loads(atom[2]), "text": atom[1]})
            elif kind == "open":
                node = {"tag": atom[1], **json.loads(atom[2]), "children": []}
                path[-1]["children"].append(node)
                path.append(node)
            elif any(n["tag"] == atom[1] for n in path[1:]):
                while path[-1]["tag"] != atom[1]:
                    leave()
                leave()
    while len(path) > 1:
        leave()
    return {"root": {"children": root["children"] or [{"tag": "p", "children": [{"text": ""}]}]}}


def _words(flat: list[Atom]) -> list[tuple[Atom, ...]]:
    """Runs of characters that aren't blanks, and all other atoms by themselves."""
    out: list[tuple[Atom, ...]] = []
    for solid, run in groupby(flat, key=lambda a: a[0] == "text" and not a[1].isspace()):
        out += [tuple(run)] if solid else [(a,) for a in run]
    return out


def _middle(a: list, b: list) -> tuple[int, int, int, int]:
    """(x, y, u, v): a shortest way from ``a`` to ``b`` goes through (x, y) and, over equal items, to (u, v) (Myers 1986, linear space)."""
    n, m = len(a), len(b)
    odd, size = (n + m) % 2, 2 * min(n, m) + 2
    ahead, back = [0] * size, [0] * size  # furthest on each diagonal, from the start and from the end
    for d in range((n + m + 1) // 2 + 1):
        for own, other, first in ((ahead, back, 1), (back, ahead, 0)):
            for k in range(-(d - 2 * max(0, d - m)), d - 2 * max(0, d - n) + 1, 2):
                x = own[(k + 1) % size] if k == -d or (k != d and own[(k - 1) % size] < own[(k + 1) % size]) else own[(k - 1) % size] + 1
                s, t, y = x, x - k, x - k
                while x < n and y < m and (a[x] == b[y] if first else a[n - 1 - x] == b[m - 1 - y]):
                    x, y = x + 1, y + 1
                own[k % size] = x
                z = n - m - k
                if odd == first and first - d <= z <= d - first and x + other[z % size] >= n:
                    return (s, t, x, y) if first else (n - x, m - y, n - s, m - t)
    raise AssertionError("two ways over one table meet")


def _edits(a: list, b: list) -> list[tuple[int, int, int, int]]:
    """(i, j, k, n): ``a[i:j]`` becomes ``b[k:n]``, with the fewest insertions and deletions (Myers 1986)."""
    furthest, seen = {1: 0}, []
    for d in range(min(len(a) + len(b), DEEP) + 1):
        seen.append(dict(furthest))
        for k in range(-d, d + 1, 2):
            x = furthest[k + 1] if k == -d or (k != d and furthest[k - 1] < furthest[k + 1]) else furthest[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            furthest[k] = x
            if x >= len(a) and x - k >= len(b):
                break
        else:
            continue
        break
    else:
        if not a or not b:
            return [(0, len(a), 0, len(b))]
        x, y, u, v = _middle(a, b)
        parts = _edits(a[:x], b[:y])
        for i, j, k, n in _edits(a[u:], b[v:]):
            if parts and (i + u, k + v) == (parts[-1][1], parts[-1][3]):
                parts[-1] = (parts[-1][0], j + u, parts[-1][2], n + v)
            else:
                parts.append((i + u, j + u, k + v, n + v))
        return parts
    out: list[tuple[int, int, int, int]] = []
    x, y = len(a), len(b)
    for d in range(len(seen) - 1, 0, -1):
        k, was = x - y, seen[d]
        before = k + 1 if k == -d or (k != d and was[k - 1] < was[k + 1]) else k - 1
        i, n = was[before], was[before] - before
        x, y = (i, n + 1) if before == k + 1 else (i + 1, n)
        if out and (x, y) == (out[-1][0], out[-1][2]):
            out[-1] = (i, out[-1][1], n, out[-1][3])
        else:
            out.append((i, x, n, y))
        x, y = i, n
    return out[::-1]


def changes(before: list, after: list) -> list[tuple[int, int, list]]:
    """(from, to, values): what replaces ``before[from:to]``; from == to is an insertion.

    Equal ends are set aside, then words are compared, then the characters of
    words that differ.
    """
    start, shorter = 0, min(len(before), len(after))
    while start < shorter and before[start] == after[start]:
        start += 1
    end = 0
    while end < shorter - start and before[-1 - end] == after[-1 - end]:
        end += 1
    old, new = before[start : len(before) - end], after[start : len(after) - end]
    a, b = _words(old), _words(new)
    at, to = ([0, *accumulate(map(len, w))] for w in (a, b))
    out = []
    for i, j, k, n in _edits(a, b):
        left, right = old[at[i] : at[j]], new[to[k] : to[n]]
        out += [(start + at[i] + f, start + at[i] + t, right[x:y]) for f, t, x, y in _edits(left, right)]
    return out


def both(first: list, second: list) -> list:
    """All of two insertions at one place; what they share is taken once."""
    out, at = [], 0
    for start, end, values in changes(first, second):
        out += first[at:end] + values
        at = end
    return out + first[at:]


def merge_trees(base: dict, sides: list[dict]) -> dict:
    """What any side removed from the base goes, what any side inserted comes, by places in the base."""
    flat = atoms(base)
    gone, come = set(), {}
    for side in sides:
        for start, end, values in changes(flat, atoms(side)):
            gone.update(range(start, end))
            if values:
                come[start] = both(come[start], values) if start in come else values
    merged = []
    for at in range(len(flat) + 1):
        merged += come.get(at, [])
        if at < len(flat) and at not in gone:
            merged.append(flat[at])
    return rebuild(merged)


def _over(column: pd.Series, f) -> pd.Series:
    return pd.Series([f(json.loads(x)) if isinstance(x, str) else None for x in column], dtype=object)


def _dump(tree: dict) -> str:
    return json.dumps(tree, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(StringType())
def plain_text(tree: pd.Series) -> pd.Series:
    return _over(tree, to_plain_text)


@F.pandas_udf(StringType())
def markdown(tree: pd.Series) -> pd.Series:
    return _over(tree, to_markdown)


@F.pandas_udf(StringType())
def normal(tree: pd.Series) -> pd.Series:
    """The tree as it comes back from its flat form."""
    return _over(tree, lambda x: _dump(rebuild(atoms(x))))


@F.pandas_udf(StringType())
def _merged(base: pd.Series, sides: pd.Series) -> pd.Series:
    out = []
    for tree, some in zip(base, sides):
        found = [json.loads(x) for x in some if isinstance(x, str)]
        before = json.loads(tree) if isinstance(tree, str) else {"root": {"children": []}}
        out.append(_dump(merge_trees(before, found)) if found else tree if isinstance(tree, str) else None)
    return pd.Series(out, dtype=object)


def merge_richtext(base: Column, *sides: Column) -> Column:
    """Three-way merge of trees, sides from oldest to newest. A null base is an empty tree; null sides are left out."""
    return _merged(base, F.array(*sides))


def find_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For ``mapInPandas`` over ``(id, tree)``: nodes in depth-first order, with the offset of their first character in all texts."""
    for batch in batches:
        rows = []
        for id_, tree in zip(batch["id"], batch["tree"]):
            offset = 0
            for node, depth, path in walk(json.loads(tree)) if isinstance(tree, str) else ():
                rows.append((id_, depth, path, node.get("tag"), node.get("text"), offset))
                offset += len(node.get("text", ""))
        yield pd.DataFrame(rows, columns=["id", "depth", "path", "tag", "text", "offset"])
