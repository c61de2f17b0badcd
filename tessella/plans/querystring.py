"""Boolean query strings: terms, field:term, "phrases", ranges, ^boost, AND, OR, NOT, +, -, brackets.

A small recursive-descent parser gives a tree; the tree gives a condition and a score as Columns, so the optimizer sees
plain predicates and pushes down what it can.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:(AND|OR|NOT)(?=[\s(]|$)|([()+\-])|(\^\d+(?:\.\d+)?)|(?:([A-Za-z_]\w*):)?(?:"((?:[^"\\]|\\.)*)"|(\[\s*\S+\s+TO\s+\S+\s*\])|(\*:\*)|([^\s()"^]+)))')


class QueryError(ValueError):
    pass


@dataclass
class Node:
    """kind: all, term, range, and, or; occur: '', '+' or '-' within its parent."""

    kind: str
    name: str | None = None
    value: str = ""
    upper: str = ""
    boost: float = 1.0
    occur: str = ""
    parts: list[Node] = field(default_factory=list)


def parse(query: str) -> Node:
    """The tree of a query; an empty one matches all."""
    tokens, at = [], 0
    query = query.strip()
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m or m.end() == at:
            raise QueryError(f"cannot read {query[at:]!r}")
        tokens.append(m)
        at = m.end()
    if not tokens:
        return Node("all")
    node, rest = _any(tokens, 0)
    if rest != len(tokens):
        raise QueryError("a bracket closes that was not opened")
    return node


def _any(tokens: list, i: int) -> tuple[Node, int]:
    """Alternatives: clauses side by side or joined by OR; AND binds tighter."""
    clauses: list[Node] = []
    while i < len(tokens) and tokens[i][2] != ")":
        if tokens[i][1] == "OR":
            i += 1
            continue
        node, i = _every(tokens, i)
        clauses.append(node)
    if not clauses:
        raise QueryError("an empty bracket")
    return (clauses[0] if len(clauses) == 1 and not clauses[0].occur else Node("or", parts=clauses)), i


def _every(tokens: list, i: int) -> tuple[Node, int]:
    node, i = _clause(tokens, i)
    parts = [node]
    while i < len(tokens) and tokens[i][1] == "AND":
        node, i = _clause(tokens, i + 1)
        parts.append(node)
    return (parts[0] if len(parts) == 1 else Node("and", parts=parts)), i


def _clause(tokens: list, i: int) -> tuple[Node, int]:
    if i >= len(tokens):
        raise QueryError("the query ends early")
    m = tokens[i]
    occur = ""
    if m[2] in ("+", "-") or m[1] == "NOT":
        occur, i = ("-" if m[1] or m[2] == "-" else "+"), i + 1
        if i >= len(tokens):
            raise QueryError("the query ends early")
        m = tokens[i]
    if m[2] == "(":
        node, i = _any(tokens, i + 1)
        if i >= len(tokens) or tokens[i][2] != ")":
            raise QueryError("a bracket is not closed")
    elif m[7]:
        node = Node("all")
    elif m[6]:
        low, high = re.match(r"\[\s*(\S+)\s+TO\s+(\S+)\s*\]", m[6]).groups()
        node = Node("range", m[4], low, high)
    elif m[5] is not None:
        node = Node("term", m[4], re.sub(r"\\(.)", r"\1", m[5]))
    elif m[8]:
        node = Node("term", m[4], m[8])
    else:
        raise QueryError(f"unexpected {m[0].strip()!r}")
    i += 1
    if i < len(tokens) and tokens[i][3]:
        node.boost, i = float(tokens[i][3][1:]), i + 1
    if occur:
        node = Node("or", parts=[node], occur=occur) if node.occur else node
        node.occur = occur
    return node, i


class Compiler:
    """Conditions and scores against fields; default: the searched field of bare terms; arrays: fields that hold lists."""

    def __init__(self, default: str = "title", arrays: tuple[str, ...] = ("entity", "entitykey", "ngram"), texts: tuple[str, ...] = ("title", "summary", "body")):
        self.default, self.arrays, self.texts = default, arrays, texts

    def matches(self, node: Node) -> Column:
        if node.kind == "all":
            return F.lit(True)
        if node.kind == "term":
            name = node.name or self.default
            if name in self.arrays:
                return F.coalesce(F.array_contains(F.col(name), node.value), F.lit(False))
            if name in self.texts:
                return F.coalesce(F.concat(F.lit(" "), F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), F.lit(" ")).contains(" " + " ".join(re.findall("[a-z0-9]+", node.value.lower())) + " "), F.lit(False))
            return F.coalesce(F.col(name) == F.lit(node.value), F.lit(False))
        if node.kind == "range":
            c = F.col(node.name or self.default)
            out = c.isNotNull()
            for bound, holds in ((node.value, lambda x, y: x >= y), (node.upper, lambda x, y: x <= y)):
                if bound != "*":
                    out = out & self._bounded(c, bound, holds)
            return out
        must = [p for p in node.parts if p.occur == "+" or (node.kind == "and" and p.occur != "-")]
        never = [p for p in node.parts if p.occur == "-"]
        maybe = [p for p in node.parts if p not in must and p not in never]
        out = F.lit(True)
        for p in must:
            out = out & self.matches(p)
        for p in never:
            out = out & ~self.matches(p)
        if maybe and not must:
            some = self.matches(maybe[0])
            for p in maybe[1:]:
                some = some | self.matches(p)
            out = out & some
        return out

    def explained(self, node: Node, boost: float = 1.0) -> list[tuple[str, Column]]:
        """What score() adds up: each clause, as text, and what it adds."""
        if node.kind in ("all", "term", "range"):
            said = "*:*" if node.kind == "all" else f"[{node.value} TO {node.upper}]" if node.kind == "range" else node.value
            return [(f"{node.name}:{said}" if node.name else said, self.score(node) * boost)]
        return [x for p in node.parts if p.occur != "-" for x in self.explained(p, boost * node.boost)]

    @staticmethod
    def _bounded(c: Column, bound: str, holds) -> Column:
        """Whether a field's value keeps to a bound. Numbers in a text field are compared as numbers and what is none is
        outside; the type decides before the query runs, so on a number the plain comparison is pushed down."""
        if not _number(bound):
            return holds(c, F.lit(bound))
        number = c.try_cast("double")
        return F.when(F.typeof(c) == "string", number.isNotNull() & holds(number, F.lit(float(bound)))).otherwise(holds(c, F.lit(float(bound)) if "." in bound else F.lit(int(bound))))

    def score(self, node: Node) -> Column:
        """The sum of the boosts of the terms that match; what must not match adds nothing."""
        if node.kind in ("all", "term", "range"):
            return F.when(self.matches(node), F.lit(node.boost)).otherwise(0.0)
        total = F.lit(0.0)
        for p in node.parts:
            if p.occur != "-":
                total = total + self.score(p)
        return total * node.boost


def _number(s: str) -> bool:
    return bool(re.fullmatch(r"-?\d+(\.\d+)?", s))
