"""Join expressions: `table.column op table.column`, joined by AND."""

from __future__ import annotations

import re
from dataclasses import dataclass

_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_TOKEN = re.compile(rf"\s*(?:(?P<col>(?P<table>{_NAME})\.(?P<column>{_NAME}))|(?P<op>==|>=|<=|=|>|<)|(?P<word>{_NAME})|(?P<odd>\S))")
MIRRORED = {"=": "=", ">": "<", "<": ">", ">=": "<=", "<=": ">="}


def fold(name: str) -> str:
    """ASCII lower case, which is how names of the data and of the dictionary are compared."""
    return "".join(c.lower() if c.isascii() else c for c in name)


class JoinProblem(ValueError):
    """An expression that doesn't parse; at is the offset of what is wrong."""

    def __init__(self, message: str, at: int):
        super().__init__(message)
        self.at = at


@dataclass(frozen=True)
class JoinColumn:
    table: str
    column: str
    start: int = 0
    end: int = 0


@dataclass(frozen=True)
class Conjunct:
    left: JoinColumn
    op: str
    right: JoinColumn


@dataclass(frozen=True)
class Join:
    conjuncts: tuple[Conjunct, ...]

    @classmethod
    def parse(cls, text: str) -> Join:
        tokens = [m for m in _TOKEN.finditer(text) if m.lastgroup]
        out, i = [], 0

        def take(kind: str, said: str) -> re.Match:
            nonlocal i
            if i >= len(tokens) or not tokens[i][kind]:
                at = tokens[i].start(tokens[i].lastgroup) if i < len(tokens) else len(text)
                raise JoinProblem(f"{said} is expected", at)
            i += 1
            return tokens[i - 1]

        def column() -> JoinColumn:
            m = take("col", "a `table.column`")
            return JoinColumn(m["table"], m["column"], m.start("col"), m.end("col"))

        while True:
            left, op, right = column(), take("op", "a comparison")["op"], column()
            out.append(Conjunct(left, "=" if op == "==" else op, right))
            if i == len(tokens):
                return cls(tuple(out))
            word = take("word", "`AND`")
            if word["word"].lower() != "and":
                raise JoinProblem("`AND` is expected", word.start("word"))

    def columns(self) -> list[JoinColumn]:
        return [c for x in self.conjuncts for c in (x.left, x.right)]

    def tables(self) -> list[str]:
        """Each table once, as first met."""
        return list(dict.fromkeys(c.table for c in self.columns()))

    @property
    def is_equality(self) -> bool:
        return all(c.op == "=" for c in self.conjuncts)

    def sides(self, probe_left: bool) -> tuple[str, str]:
        """(probed table, counted table); the first conjunct says which is left."""
        pair = (self.conjuncts[0].left.table, self.conjuncts[0].right.table)
        return pair if probe_left else pair[::-1]

    def oriented(self, probe_left: bool) -> list[Conjunct]:
        """Conjuncts with the probed table's column first. In a self-join the written order stands."""
        left = fold(self.conjuncts[0].left.table)
        self_join = left == fold(self.conjuncts[0].right.table)
        out = []
        for c in self.conjuncts:
            if not self_join and fold(c.left.table) != left:
                c = Conjunct(c.right, MIRRORED[c.op], c.left)
            out.append(c if probe_left else Conjunct(c.right, MIRRORED[c.op], c.left))
        return out


#: Which sides are probed: rows there may match one row of the other at most.
PROBED = {"many-to-one": (True,), "one-to-many": (False,), "one-to-one": (True, False)}
