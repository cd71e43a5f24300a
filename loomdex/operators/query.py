"""The full-text query language: sanitiser and parser, on the driver, without Spark.

Grammar, tightest first: implicit AND of neighbouring phrases, NOT (and-not), AND, OR; parentheses only with explicit operators;
``"..."`` and ``+`` make phrases, a trailing ``*`` a prefix, ``^`` anchors at the start of a column, ``NEAR(a b, k)`` bounds a distance,
``column:`` limits a phrase.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from loomdex.functions.text import fold_text


class QuerySyntaxError(ValueError):
    """The query cannot be parsed."""


@dataclass(frozen=True)
class Phrase:
    """Adjacent tokens in one column; ``prefix``: the last one is a prefix."""

    tokens: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    column: str | None = None


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Op:
    """kind: and, or, not."""

    kind: str
    items: tuple = field(default_factory=tuple)


def sanitise(text: str) -> str:
    """The query string as it is parsed: quotes dropped, terms with ``: / # -`` quoted, a single plain term made a prefix."""
    terms = text.replace('"', "").split()
    if not terms:
        return '""'
    out = [t if t in ("AND", "OR", "NOT", "NEAR") or t.endswith("*") else f'"{t}"' if re.search(r"[:/#-]", t) else t for t in terms]
    if len(out) == 1 and not out[0].startswith('"') and not out[0].endswith("*"):
        return out[0] + "*"
    return " ".join(out)


_LEX = re.compile(r'\s*(?:(?P<string>"(?:[^"]|"")*")|(?P<word>[\w\x80-\U0010ffff]+)|(?P<mark>[()*^+:,]))')


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            raise QuerySyntaxError(f"syntax error near {text[at:at + 10]!r}")
        kind = m.lastgroup
        value = m.group(kind)
        if kind == "word" and value in ("AND", "OR", "NOT"):
            kind = value
        out.append((kind, value))
        at = m.end()
    return out


def tokens_of(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", fold_text(text)))


class _Parser:
    def __init__(self, text: str, columns: tuple[str, ...]):
        self.items, self.at, self.columns = _lex(text), 0, columns

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        k, v = self.peek()
        if (kind and k != kind) or (value and v != value):
            raise QuerySyntaxError(f"syntax error near {v!r}")
        self.at += 1
        return v

    def whole(self):
        tree = self.either()
        if self.peek()[0] != "end":
            raise QuerySyntaxError(f"syntax error near {self.peek()[1]!r}")
        return tree

    def either(self):
        items = [self.both()]
        while self.peek()[0] == "OR":
            self.take()
            items.append(self.both())
        return items[0] if len(items) == 1 else Op("or", tuple(items))

    def both(self):
        items = [self.unless()]
        while self.peek()[0] == "AND":
            self.take()
            items.append(self.unless())
        return items[0] if len(items) == 1 else Op("and", tuple(items))

    def unless(self):
        tree = self.operand()
        while self.peek()[0] == "NOT":
            self.take()
            tree = Op("not", (tree, self.operand()))
        return tree

    def operand(self):
        if self.peek() == ("mark", "("):
            self.take()
            tree = self.either()
            self.take("mark", ")")
            return tree
        items = [self.near()]
        while self.peek()[0] in ("string", "word") or self.peek() == ("mark", "^"):
            items.append(self.near())
        return items[0] if len(items) == 1 else Op("and", tuple(items))

    def near(self):
        column = None
        if self.peek()[0] == "word" and self.peek(1) == ("mark", ":"):
            column = self.take().lower()
            if column not in self.columns:
                raise QuerySyntaxError(f"no such column: {column}")
            self.take()
        if self.peek() == ("word", "NEAR") and self.peek(1) == ("mark", "("):
            self.at += 2
            phrases = []
            while self.peek()[0] in ("string", "word"):
                phrases.append(self.phrase(column))
            distance = 10
            if self.peek() == ("mark", ","):
                self.take()
                number = self.take("word")
                if not number.isdigit():
                    raise QuerySyntaxError("expected integer")
                distance = int(number)
            self.take("mark", ")")
            if not phrases:
                raise QuerySyntaxError("empty NEAR")
            return phrases[0] if len(phrases) == 1 else Near(tuple(phrases), distance)
        return self.phrase(column)

    def phrase(self, column: str | None) -> Phrase:
        first = self.peek() == ("mark", "^")
        if first:
            self.take()
        words: list[str] = []
        while True:
            kind, value = self.peek()
            if kind not in ("string", "word"):
                raise QuerySyntaxError(f"syntax error near {value!r}")
            self.take()
            words += tokens_of(value[1:-1].replace('""', '"') if kind == "string" else value)
            if self.peek() != ("mark", "+"):
                break
            self.take()
        prefix = self.peek() == ("mark", "*")
        if prefix:
            self.take()
        return Phrase(tuple(words), prefix, first, column)


def _prune(tree):
    """Phrases without tokens match nothing alone and are ignored next to others."""
    if isinstance(tree, Phrase):
        return tree if tree.tokens else None
    if isinstance(tree, Near):
        kept = tuple(p for p in tree.phrases if p.tokens)
        return None if not kept else kept[0] if len(kept) == 1 else Near(kept, tree.distance)
    items = [_prune(i) for i in tree.items]
    if tree.kind == "not":
        return None if items[0] is None else items[0] if items[1] is None else Op("not", tuple(items))
    items = [i for i in items if i is not None]
    return None if not items else items[0] if len(items) == 1 else Op(tree.kind, tuple(items))


def parse(text: str, columns: tuple[str, ...] = ("title", "body")):
    """The tree of a user's query: Phrase, Near or Op; None if it matches nothing. Raises QuerySyntaxError."""
    return _prune(_Parser(sanitise(text), columns).whole())


def phrases(tree) -> list[Phrase]:
    """All phrases of a tree in order; equal ones keep their own place."""
    if tree is None:
        return []
    if isinstance(tree, Phrase):
        return [tree]
    if isinstance(tree, Near):
        return list(tree.phrases)
    return [p for i in tree.items for p in phrases(i)]
