"""Finite-state transducers over small alphabets, composed on demand.

A machine has a start state, ``step(state, symbol) -> (state, outputs)`` and ``end(state) -> outputs``. States are hashable,
outputs are tuples of symbols. ``Composed`` runs the outputs of each machine through the next one; its states are the tuples of their
states, built as inputs reach them and kept as one transition table, so that a composed chain costs one lookup a symbol.

A symbol is a string; a symbol that begins with ``~`` is the same symbol, damped.
"""

from __future__ import annotations

import re
from functools import lru_cache

_ITEM = re.compile(r"(?:\[(\^?)([^\]]*)\]|(\S+?))(\?|\*|\+|\{\d+,\d+\})?(?:\s+|$)")
Item = tuple[bool, frozenset, int, int | None]


def items(pattern: str) -> tuple[Item, ...]:
    """A pattern as items (negated, symbols, least, most): symbols apart by blanks, ``[a b]`` one of, ``[^a b]`` none of, ``? * + {m,n}``."""
    out = []
    for negated, of, one, times in _ITEM.findall(pattern):
        lo, hi = {"": (1, 1), "?": (0, 1), "*": (0, None), "+": (1, None)}.get(times) or tuple(int(x) for x in times[1:-1].split(","))
        out.append((bool(negated), frozenset(of.split() if not one else [one]), lo, hi))
    return tuple(out)


def _fits(item: Item, symbol: str) -> bool:
    return (symbol in item[1]) != item[0]


class Positions:
    """A pattern as a chain of positions without loops but for ``*`` and ``+``."""

    def __init__(self, pattern: str):
        self.item, self.skips, self.loops = [], [], []
        for it in items(pattern):
            lo, hi = it[2], it[3]
            for i in range(max(lo, 1) if hi is None else hi):
                self.item.append(it)
                self.skips.append(i >= lo)
                self.loops.append(hi is None and i == max(lo, 1) - 1)
        self.final = len(self.item)

    def closure(self, at: int) -> list[int]:
        out = [at]
        while at < self.final and self.skips[at]:
            at += 1
            out.append(at)
        return out

    def after(self, at: int, symbol: str) -> list[int]:
        """Positions reached by reading ``symbol`` at ``at``."""
        if at == self.final or not _fits(self.item[at], symbol):
            return []
        out = self.closure(at + 1)
        return [at, *out] if self.loops[at] else out


class Rewrite:
    """Replaces the leftmost longest match of its rules; other symbols pass through ``other``. A state is the symbols held back."""

    start: tuple = ()

    def __init__(self, rules: list[tuple[str, str]], other=lambda s: s):
        self.rules, self.other = [(Positions(p), tuple(out.split())) for p, out in rules], other
        self._reads = lru_cache(200_000)(self._read)
        by: dict[str, list[int]] = {}
        for r, (p, _) in enumerate(self.rules):
            for at in p.closure(0):
                if at < p.final and not p.item[at][0]:
                    for s in p.item[at][1]:
                        by.setdefault(s, []).append(r)
        self.by = by

    def _read(self, held: tuple) -> tuple[int, tuple, bool]:
        """(length, outputs, open): the longest match at the front of ``held``, and whether more symbols could still lengthen it."""
        best, out, live = 0, (), False
        for r in dict.fromkeys(self.by.get(held[0], ())):
            p, output = self.rules[r]
            at, n = set(p.closure(0)), 0
            for s in held:
                at = {y for x in at for y in p.after(x, s)}
                n += 1
                if not at:
                    break
                if p.final in at and n > best:
                    best, out = n, output
            live = live or any(x < p.final for x in at)
        return best, out, live

    def _drain(self, held: tuple, closed: bool) -> tuple[tuple, tuple]:
        said: list[str] = []
        while held:
            best, out, live = self._reads(held)
            if live and not closed:
                break
            said.extend(out if best else (self.other(held[0]),))
            held = held[max(best, 1) :]
        return held, tuple(said)

    def step(self, state: tuple, symbol: str) -> tuple[tuple, tuple]:
        return self._drain((*state, symbol), False)

    def end(self, state: tuple) -> tuple:
        return self._drain(state, True)[1]


class Weighted:
    """Acceptor: the best weight of each kind among the patterns that match anywhere, as outputs ``(kind, weight)`` at the end.

    A match over a damped symbol keeps ``damp`` of its weight. ``^`` and ``$`` stand for the ends of the input. ``tag`` damps the matches made
    since the last but one break: a report that follows what it reports.
    """

    def __init__(self, patterns: list[tuple[str, float, str]], *, damp: float = 0.1, tag: str = "tag", breaks: frozenset = frozenset((",", "/"))):
        self.patterns, self.damp, self.tag, self.breaks = [(k, w, Positions(p)) for k, w, p in patterns], damp, tag, breaks
        first: dict[str, list[tuple[int, int]]] = {}
        self.any_first = []
        for i, (_, _, p) in enumerate(self.patterns):
            for at in p.closure(0):
                if p.item[at][0]:
                    self.any_first.append((i, at))
                else:
                    for s in p.item[at][1]:
                        first.setdefault(s, []).append((i, at))
        self.first = first
        self.start = self._read((frozenset(), (), (), ()), "^")

    @staticmethod
    def _best(a: tuple, b: tuple) -> tuple:
        got = dict(a)
        for k, w in b:
            got[k] = max(w, got.get(k, 0.0))
        return tuple(sorted(got.items()))

    def _read(self, state: tuple, symbol: str) -> tuple:
        live, now, held, done = state
        damped, s = symbol[0] == "~", symbol.lstrip("~")
        if s == self.tag:
            lower = lambda x: tuple((k, round(w * self.damp, 6)) for k, w in x)
            now, held = lower(now), lower(held)
        # A position is (pattern, place, damped): of two ways to one place the undamped one is kept.
        ways: dict[tuple[int, int], bool] = {}
        todo = [(i, at, d) for i, at, d in live] + [(i, at, False) for i, at in (*self.first.get(s, ()), *self.any_first)]
        for i, at, d in todo:
            for to in self.patterns[i][2].after(at, s):
                ways[i, to] = ways.get((i, to), True) and (d or damped)
        got: dict[str, float] = {}
        for (i, at), d in ways.items():
            kind, weight, p = self.patterns[i]
            if at == p.final:
                got[kind] = max(got.get(kind, 0.0), round(weight * self.damp, 6) if d else weight)
        now = self._best(now, tuple(got.items())) if got else now
        if s in self.breaks:
            done, held, now = self._best(done, held), now, ()
        return frozenset((i, at, d) for (i, at), d in ways.items() if at < self.patterns[i][2].final), now, held, done

    def step(self, state: tuple, symbol: str) -> tuple[tuple, tuple]:
        return self._read(state, symbol), ()

    def end(self, state: tuple) -> tuple:
        _, now, held, done = self._read(state, "$")
        return self._best(self._best(done, held), now)


class Composed:
    """The composition of machines, read from left to right. ``limit``: transitions kept before the table starts anew."""

    def __init__(self, *machines, limit: int = 1_000_000):
        self.machines, self.limit = machines, limit
        self._reset()

    def _reset(self) -> None:
        self.table, self.ids, self.states, self.ends = {}, {}, [], {}
        self.start = self._id(tuple(m.start for m in self.machines))

    def _id(self, state: tuple) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
        return self.ids[state]

    def _step(self, state: tuple, symbol: str) -> tuple:
        new, line = list(state), (symbol,)
        for i, m in enumerate(self.machines):
            said: list = []
            for s in line:
                new[i], out = m.step(new[i], s)
                said.extend(out)
            line = tuple(said)
        return tuple(new)

    def _end(self, state: tuple) -> tuple:
        new, line = list(state), ()
        for i, m in enumerate(self.machines):
            said: list = []
            for s in line:
                new[i], out = m.step(new[i], s)
                said.extend(out)
            said.extend(m.end(new[i]))
            line = tuple(said)
        return line

    def run(self, symbols: list[str]) -> tuple:
        """The outputs at the end of the last machine."""
        if len(self.table) > self.limit:
            self._reset()
        at, table = self.start, self.table
        for s in symbols:
            to = table.get((at, s))
            if to is None:
                to = table[at, s] = self._id(self._step(self.states[at], s))
            at = to
        if at not in self.ends:
            self.ends[at] = self._end(self.states[at])
        return self.ends[at]
