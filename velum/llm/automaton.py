"""Regular expressions over bytes as one minimal deterministic automaton.

Rules may use literals, escapes (``\\xNN``, ``\\n`` and escaped punctuation),
classes, groups, ``(?i:...)``, alternation and ``? * + {m} {m,} {m,n}``.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

_ALL = frozenset(range(256))


class _Parser:
    """A rule as a tree: ("set", bytes), ("seq", parts), ("or", parts), ("rep", part, least, most or None)."""

    def __init__(self, rule: str):
        self.rule, self.at, self.fold = rule, 0, False

    def parse(self):
        tree = self._either()
        if self.at < len(self.rule):
            raise ValueError(f"{self.rule!r} at {self.at}")
        return tree

    def _peek(self) -> str:
        return self.rule[self.at] if self.at < len(self.rule) else ""

    def _either(self):
        parts = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            parts.append(self._sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeat(self._atom()))
        return ("seq", parts)

    def _repeat(self, part):
        c = self._peek()
        if c in ("?", "*", "+") and c:
            self.at += 1
            return ("rep", part, int(c == "+"), 1 if c == "?" else None)
        if c == "{":
            end = self.rule.index("}", self.at)
            low, comma, high = self.rule[self.at + 1 : end].partition(",")
            self.at = end + 1
            return ("rep", part, int(low), int(high) if high else None if comma else int(low))
        return part

    def _atom(self):
        c = self._peek()
        if c == "(":
            fold = self.fold
            self.at += 1
            for mark in ("?i:", "?:"):
                if self.rule.startswith(mark, self.at):
                    self.fold |= mark == "?i:"
                    self.at += len(mark)
                    break
            tree = self._either()
            if self._peek() != ")":
                raise ValueError(f"{self.rule!r} lacks )")
            self.at += 1
            self.fold = fold
            return tree
        if c == "[":
            return ("set", self._class())
        return ("set", self._cased({self._char()}))

    def _cased(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found |= {ord(chr(b).swapcase()) for b in found if b < 128 and chr(b).isalpha()}
        return frozenset(found)

    def _char(self) -> int:
        c = self._peek()
        self.at += 1
        if c != "\\":
            if ord(c) > 127:
                raise ValueError("rules are ASCII")
            return ord(c)
        c = self._peek()
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.rule[self.at - 2 : self.at], 16)
        if c == "n":
            return 10
        if c.isalnum():
            raise ValueError(f"\\{c} isn't supported")
        return ord(c)

    def _class(self) -> frozenset[int]:
        self.at += 1
        negated = self._peek() == "^"
        self.at += negated
        found: set[int] = set()
        while self._peek() != "]" or not found:
            a = self._char()
            if self._peek() == "-" and self.rule[self.at + 1] != "]":
                self.at += 1
                found |= set(range(a, self._char() + 1))
            else:
                found.add(a)
        self.at += 1
        found = set(self._cased(found))
        return frozenset(_ALL - found if negated else found)


def _reverse(tree):
    kind = tree[0]
    if kind == "seq":
        return ("seq", [_reverse(p) for p in reversed(tree[1])])
    if kind == "or":
        return ("or", [_reverse(p) for p in tree[1]])
    return ("rep", _reverse(tree[1]), *tree[2:]) if kind == "rep" else tree


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.step: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.step.append([])
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """The state behind ``tree`` from ``start``."""
        kind = tree[0]
        if kind == "set":
            self.step[start].append((tree[1], end := self.state()))
            return end
        if kind == "seq":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in tree[1]:
                self.free[start].append(first := self.state())
                self.free[self.add(part, first)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            self.free[start].append(loop := self.state())
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end := self.state())
            return end
        end = self.state()
        self.free[start].append(end)
        for _ in range(most - least):
            start = self.add(part, start)
            self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        found, open_ = set(states), list(states)
        while open_:
            for s in self.free[open_.pop()]:
                if s not in found:
                    found.add(s)
                    open_.append(s)
        return frozenset(found)


class Automaton:
    """The minimal automaton of all rules: ``next[state, byte]``, ``accepts[state]`` (a bit for each rule) and ``start``.

    ``anywhere``: a match may begin at any place. ``backward``: it reads texts
    from their end, and accepts where a match begins. State 0 has no way out
    unless ``anywhere``.
    """

    def __init__(self, rules: list[str], anywhere: bool = False, backward: bool = False):
        nfa = _Nfa()
        root, ends = nfa.state(), []
        for rule in rules:
            tree = _Parser(rule).parse()
            nfa.free[root].append(first := nfa.state())
            ends.append(nfa.add(_reverse(tree) if backward else tree, first))
        if anywhere:
            nfa.step[root].append((_ALL, root))
        # Bytes that no rule tells apart are one symbol.
        sets = sorted({s for step in nfa.step for s, _ in step}, key=sorted)
        symbol_of: dict[tuple[bool, ...], int] = {}
        self.symbol = np.array([symbol_of.setdefault(tuple(b in s for s in sets), len(symbol_of)) for b in range(256)])
        sample = [int(np.flatnonzero(self.symbol == k)[0]) for k in range(len(symbol_of))]
        # Subset construction.
        number = {frozenset(): 0, (begin := nfa.closure([root])): 1}
        order, table = [frozenset(), begin], []
        for states in order:
            row = []
            for b in sample:
                to = nfa.closure({t for s in states for on, t in nfa.step[s] if b in on})
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            table.append(row)
        step = np.array(table)
        accepts = np.array([sum(1 << k for k, e in enumerate(ends) if e in states) for states in order])
        # Minimisation: split classes of states until all in a class go to the same classes.
        part = np.unique(accepts, return_inverse=True)[1]
        while True:
            new = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].ravel()
            if new.max() == part.max():
                break
            part = new
        first = np.unique(part, return_index=True)[1]
        name = np.empty(len(first), np.int64)  # the state without a way out is 0
        rest = [int(p) for p in range(len(first)) if p != part[0]]
        name[[int(part[0]), *rest]] = np.arange(len(first))
        part = name[part]
        kept = np.empty(len(first), np.int64)
        kept[name] = first
        self.next = part[step[kept]][:, self.symbol].astype(np.int32)
        self.accepts, self.start = accepts[kept], int(part[1])

    def run(self, data: np.ndarray, lanes: np.ndarray, entry: np.ndarray, on_accept=None) -> np.ndarray:
        """Step every lane, a column of ``data[:, lanes]``, from its entry state; returns the exit states.

        ``on_accept(row, lane indices, masks)`` is called where lanes accept.
        """
        flat, state, any_ = self.next.ravel(), entry.astype(np.int32), self.accepts > 0
        for i in range(data.shape[0]):
            state = flat[(state << 8) | data[i, lanes]]
            if on_accept is not None and (hit := np.flatnonzero(any_[state])).size:
                on_accept(i, hit, self.accepts[state[hit]])
        return state


def accept_places(machine: Automaton, texts: list[bytes], segment: int = 512) -> list[list[tuple[int, int]]]:
    """For each text, read from its end, the places (offset of the last byte read) and masks at which ``machine`` accepts.

    All texts are cut into segments that advance together, one byte a step.
    Each first starts in the start state; segments whose predecessor ends in
    another state are run again from that state, until all fit together.
    """
    size = np.array([len(t) for t in texts], np.int64)
    parts = -(-size // segment)
    total = int(parts.sum())
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not total:
        return out
    first = np.cumsum(parts) - parts
    data = np.zeros(total * segment, np.uint8)
    for t, a, n in zip(texts, first.tolist(), size.tolist()):
        data[a * segment : a * segment + n] = np.frombuffer(t, np.uint8)[::-1]
    data = np.ascontiguousarray(data.reshape(total, segment).T)
    owner = np.repeat(np.arange(len(texts)), parts)
    head = np.zeros(total, bool)
    head[first[parts > 0]] = True
    entry = np.full(total, machine.start, np.int32)
    exit_ = np.empty(total, np.int32)
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    again = np.arange(total)
    while len(again):
        for lane in again.tolist() if len(hits) else ():
            hits.pop(lane, None)

        def found(i, lanes, masks, again=again):
            for lane, mask in zip(again[lanes].tolist(), masks.tolist()):
                hits[lane].append((i, mask))

        exit_[again] = machine.run(data, again, entry[again], found)
        wanted = np.where(head, machine.start, np.r_[machine.start, exit_[:-1]])
        again = np.flatnonzero(wanted != entry)
        entry = wanted.astype(np.int32)
    for lane in sorted(hits):
        k = int(owner[lane])
        base = (lane - int(first[k])) * segment
        for i, mask in hits[lane]:
            if base + i < size[k]:
                out[k].append((int(size[k]) - 1 - base - i, mask))
    return out


def longest(machine: Automaton, data: bytes, start: int, table: list[list[int]], accepts: list[int], rule: int) -> int:
    """The end of the longest match of ``rule`` from ``start``, -1 if there is none."""
    state, end, bit = machine.start, -1, 1 << rule
    for i in range(start, len(data)):
        state = table[state][data[i]]
        if not state:
            break
        if accepts[state] & bit:
            end = i + 1
    return end
