"""Plans for synthetic tables: what each column's values must satisfy, from declared constraints alone.

Every generated value is a function of its row number, and keys and range bounds are made so that what refers to
them can compute them again; so no table is ever read back, and a foreign key needs no join.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from .joins import PROBED
from .model import Column, Dictionary, Relationship, Table, Target

#: A one-side row owns so many consecutive indices: its lower bound, what lies inside, its upper bound.
SLOT = 3


class GenerationProblem(ValueError):
    """A dictionary or options that no generated data can satisfy; kind says which refusal it is."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass(frozen=True)
class Options:
    rows: int = 10
    table_rows: Mapping[str, int] = field(default_factory=dict)
    seed: int = 0
    null_fraction: float = 0.25

    def of(self, table: str) -> int:
        return self.table_rows.get(table, self.rows)


@dataclass(frozen=True)
class Indexed:
    """Row i has the i-th value."""


@dataclass(frozen=True)
class Plain:
    """A hashed index's value."""


@dataclass(frozen=True)
class Draw:
    """The key of a target row: the same row's if each target is drawn once at most, else a hashed one's."""

    target: Target
    injective: bool


@dataclass(frozen=True)
class Bound:
    relationship: int
    upper: bool


@dataclass(frozen=True)
class Probe:
    """A value inside the interval of a one-side row."""

    relationship: int
    one_table: str
    injective: bool


@dataclass(frozen=True)
class Copy:
    """The value of a one-side row's column, the row being the probe's."""

    relationship: int
    one_table: str
    one_column: str
    injective: bool


Role = Indexed | Plain | Draw | Bound | Probe | Copy


@dataclass(frozen=True)
class ColumnPlan:
    column: str
    role: Role
    nullable: bool


@dataclass(frozen=True)
class TablePlan:
    table: str
    rows: int
    columns: tuple[ColumnPlan, ...]

    def column(self, name: str) -> ColumnPlan | None:
        return next((c for c in self.columns if c.column == name), None)


@dataclass(frozen=True)
class Plan:
    tables: tuple[TablePlan, ...]

    def table(self, name: str) -> TablePlan | None:
        return next((t for t in self.tables if t.table == name), None)

    def rows(self, table: str) -> int:
        found = self.table(table)
        return found.rows if found else 0


def make_plan(d: Dictionary, options: Options) -> Plan:
    """Tables in the order in which they can be filled, each with its columns' roles, or a refusal."""
    if not d.rich:
        raise GenerationProblem("legacy", "data is generated for the richer format only")
    if not 0 <= options.null_fraction <= 1:
        raise GenerationProblem("null_fraction", f"the share of nulls is {options.null_fraction}, not within 0 and 1")
    if unknown := sorted(set(options.table_rows) - {t.name.value for t in d.tables}):
        raise GenerationProblem("unknown_table", f"rows are given for `{unknown[0]}`, which the dictionary doesn't have")
    claims = _claims(d)
    targets = _targets(d)
    plans = []
    for t in _order(d, targets):
        name, rows, columns = t.name.value, options.of(t.name.value), []
        for c in t.columns:
            place = (name, c.name.value)
            role = claims.get(place) or _own_role(c, rows, place, targets, options)
            if isinstance(role, Probe | Copy):
                one = options.of(role.one_table)
                if rows and not one or role.injective and rows > one:
                    raise GenerationProblem("too_few_owners", f"`{name}.{c.name.value}` has {rows} rows to place in {one} of `{role.one_table}`")
            columns.append(ColumnPlan(c.name.value, role, not c.required and not isinstance(role, Bound | Probe | Copy)))
        plans.append(TablePlan(name, rows, tuple(columns)))
    return Plan(tuple(plans))


def _own_role(c: Column, rows: int, place: tuple[str, str], targets: dict, options: Options) -> Role:
    if not c.has("foreign_key"):
        return Indexed() if c.unique else Plain()
    target = targets[place]
    have = options.of(target.table)
    if rows and not have:
        raise GenerationProblem("empty_target", f"`{'.'.join(place)}` has values to draw from `{target.table}`, which has no rows")
    if c.unique and rows > have:
        raise GenerationProblem("too_few_targets", f"`{'.'.join(place)}` needs {rows} different values of the {have} of `{target.table}`")
    return Draw(target, c.unique)


def _claims(d: Dictionary) -> dict[tuple[str, str], Role]:
    """Roles that relationships by ranges give to columns; equality relationships must have a unique side already."""
    claims: dict[tuple[str, str], Role] = {}
    for i, r in enumerate(d.relationships):
        if r.join is None:
            raise GenerationProblem("join", f"`{r.text.value}` doesn't parse")
        if r.join.is_equality:
            for left in PROBED[r.cardinality.value]:
                one = r.join.sides(left)[1]
                names = [c.right.column for c in r.join.oriented(left)]
                if not any((t := d.table(one)) and (c := t.column(n)) and c.unique for n in names):
                    raise GenerationProblem("cardinality", f"`{r.text.value}`: no join column of `{one}` is unique")
            continue
        refusals = []
        for left in PROBED[r.cardinality.value]:
            try:
                found = _range_roles(d, i, r, left)
                break
            except GenerationProblem as e:
                refusals.append(e)
        else:
            raise refusals[0]  # the direction that is read first
        for place, role in found.items():
            _claim(claims, place, role)
    return claims


def _claim(claims: dict, place: tuple[str, str], role: Role) -> None:
    if claims.setdefault(place, role) != role:
        raise GenerationProblem("conflict", f"two relationships say what `{'.'.join(place)}` holds")


def _range_roles(d: Dictionary, i: int, r: Relationship, probe_left: bool) -> dict[tuple[str, str], Role]:
    """Roles in one direction: every probe column is either equal to one column, or between two columns, of the one side."""
    probe_table, one_table = r.join.sides(probe_left)
    injective, text = r.cardinality.value == "one-to-one", r.text.value
    column = lambda t, c: d.table(t) and d.table(t).column(c)
    by_probe: dict[str, dict[str, list[str]]] = {}
    for c in r.join.oriented(probe_left):
        side = {"=": "equal", ">": "lower", ">=": "lower", "<": "upper", "<=": "upper"}[c.op]
        by_probe.setdefault(c.left.column, {"equal": [], "lower": [], "upper": []})[side].append(c.right.column)
    out: dict[tuple[str, str], Role] = {}

    def refuse(why: str):
        raise GenerationProblem("range_shape", f"`{text}`: {why}")

    def not_foreign(t: str, c: str):
        if (found := column(t, c)) and found.has("foreign_key"):
            raise GenerationProblem("range_foreign_key", f"`{text}`: `{t}.{c}` is a foreign key too")

    def repeatable(c: str, unless: bool):
        if (found := column(probe_table, c)) and found.unique and not unless:
            raise GenerationProblem("range_unique", f"`{text}`: `{probe_table}.{c}` is unique, but its values would repeat")

    for name, sides in by_probe.items():
        if sides["equal"]:
            if sides["lower"] or sides["upper"]:
                refuse(f"`{name}` has an equality and a range")
            if len(sides["equal"]) > 1:
                refuse(f"`{name}` equals several columns")
            not_foreign(probe_table, name)
            source = column(one_table, sides["equal"][0])
            repeatable(name, unless=injective and bool(source) and source.unique)
            _claim(out, (probe_table, name), Copy(i, one_table, sides["equal"][0], injective))
            continue
        for side in ("lower", "upper"):
            if len(sides[side]) != 1:
                refuse(f"`{name}` needs one {side} bound, and has {len(sides[side])}")
        lower, upper = sides["lower"][0], sides["upper"][0]
        if lower == upper:
            refuse(f"both bounds of `{name}` are `{lower}`")
        for t, c in ((probe_table, name), (one_table, lower), (one_table, upper)):
            not_foreign(t, c)
        repeatable(name, unless=injective)
        _claim(out, (one_table, lower), Bound(i, False))
        _claim(out, (one_table, upper), Bound(i, True))
        _claim(out, (probe_table, name), Probe(i, one_table, injective))
    return out


def _targets(d: Dictionary) -> dict[tuple[str, str], Target]:
    out = {}
    for t in d.tables:
        for c in t.columns:
            if c.has("foreign_key"):
                found = list(dict.fromkeys(d.foreign_key_targets(t.name.value, c.name.value)))
                if len(found) != 1:
                    kind = "ambiguous_target" if found else "no_target"
                    raise GenerationProblem(kind, f"`{t.name.value}.{c.name.value}` is paired with {len(found)} primary keys, not one")
                out[t.name.value, c.name.value] = found[0]
    return out


def _order(d: Dictionary, targets: dict) -> list[Table]:
    """Targets before what draws from them, the document's order otherwise."""
    needs = {t.name.value: {target.table for (own, _), target in targets.items() if own == t.name.value} for t in d.tables}
    order, left = [], list(d.tables)
    while left:
        placed = {t.name.value for t in order}
        ready = next((t for t in left if needs[t.name.value] <= placed), None)
        if ready is None:
            raise GenerationProblem("cycle", "foreign keys go round in " + ", ".join(f"`{t.name.value}`" for t in left))
        order.append(ready)
        left.remove(ready)
    return order
