"""The dictionary: tables, columns, typedefs and relationships, each with its place in the file."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from .joins import Join

#: A list or map where a scalar is looked at.
COMPOUND = object()


@dataclass(frozen=True)
class Spot:
    """From line and column to line and column, from 0."""

    line: int
    column: int
    end_line: int
    end_column: int


@dataclass(frozen=True)
class At:
    """A value and its place."""

    value: Any
    spot: Spot | None = None


@dataclass
class Typedef:
    name: At
    body: At


@dataclass
class Column:
    name: At
    type: At | None = None
    constraints: list[At] = field(default_factory=list)
    label: str | None = None
    values: At | None = None
    range: At | None = None
    examples: At | None = None
    units: At | None = None
    time_zone: At | None = None

    def has(self, constraint: str) -> bool:
        return any(c.value == constraint for c in self.constraints)

    @property
    def unique(self) -> bool:
        return self.has("unique") or self.has("primary_key")

    @property
    def required(self) -> bool:
        return self.has("required") or self.has("primary_key")


@dataclass
class Table:
    name: At
    columns: list[Column] = field(default_factory=list)
    typedefs: list[Typedef] = field(default_factory=list)
    label: str | None = None
    description: Spot | None = None
    details: Spot | None = None
    parquet: At | None = None

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.value == name), None)


@dataclass
class Relationship:
    cardinality: At
    text: At
    join: Join | None = None
    conflicts: list[At] = field(default_factory=list)


@dataclass(frozen=True)
class Target:
    table: str
    column: str


@dataclass
class Dictionary:
    rich: bool = True
    tables: list[Table] = field(default_factory=list)
    relationships: list[Relationship] = field(default_factory=list)
    typedefs: list[Typedef] = field(default_factory=list)
    extensions: list[At] = field(default_factory=list)
    #: (kind, value): ("parquet", folder) or ("catalog", database) here; other kinds can't be read by Spark alone.
    source: At | None = None

    def table(self, name: str) -> Table | None:
        return next((t for t in self.tables if t.name.value == name), None)

    def foreign_key_targets(self, table: str, column: str) -> list[Target]:
        """Primary-key columns that an equality in a relationship pairs with a column; each pair once for each time it is declared."""
        out = []
        for r in self.relationships:
            for c in r.join.conjuncts if r.join else ():
                for own, other in ((c.left, c.right), (c.right, c.left)):
                    if c.op == "=" and (own.table, own.column) == (table, column):
                        target = self.table(other.table)
                        found = target.column(other.column) if target else None
                        if found and found.has("primary_key"):
                            out.append(Target(other.table, other.column))
        return out

    def aliases(self, table: Table | None = None) -> dict[str, str]:
        """Typedefs in scope: a table's own hide global ones of exactly the same name."""
        out = {t.name.value: t.body.value for t in self.typedefs}
        return out | {t.name.value: t.body.value for t in table.typedefs} if table else out
