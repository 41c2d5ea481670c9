"""Rules that a dictionary keeps by itself, without any data (S01 to S20)."""

from __future__ import annotations

import datetime
import math
import re
from pathlib import Path

from .joins import fold
from .loader import Stop, entries, lower, noun, read_document, scalar, spot_of, within
from .model import COMPOUND, Column, Dictionary, Spot, Table
from .problems import Report

#: Areas of time zone names.
AREAS = ("Africa", "America", "Antarctica", "Arctic", "Asia", "Atlantic", "Australia", "Europe", "Indian", "Pacific", "Etc")
#: Types of the older format that are described by a range, and by examples.
RANGE_TYPES = ("number(ordinal)", "number(quantity)", "date", "datetime")
LEARN_MORE = "https://example.org/data-dictionaries"


def parse_date(s: str) -> datetime.date | None:
    try:
        return datetime.date.fromisoformat(s) if re.fullmatch(r"\d{4}-\d\d-\d\d", s) else None
    except ValueError:
        return None


def parse_time_point(s: str, zoned: bool) -> datetime.datetime | None:
    """A datetime with its own offset, or without one."""
    try:
        found = datetime.datetime.fromisoformat(s) if re.match(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d", s) else None
    except ValueError:
        return None
    return found if found and (found.tzinfo is not None) == zoned else None


def is_infinite(x) -> bool:
    return isinstance(x, float) and math.isinf(x)


def time_zone_ok(zone: str) -> bool:
    area, slash, location = zone.partition("/")
    return zone in ("naive", "UTC") or bool(slash) and area in AREAS and bool(re.fullmatch(r"[A-Za-z0-9_+\-/]+", location))


def is_version_number(s: str) -> bool:
    part = r"[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*"
    return bool(re.fullmatch(rf"\d+\.\d+\.\d+(-{part})?(\+{part})?", s, re.ASCII))


def descending(lo, hi, parse) -> bool:
    """Whether bounds run backwards; infinite ones only where they stand at the wrong end."""
    if is_infinite(lo) or is_infinite(hi):
        return (lo == math.inf and hi != math.inf) or (hi == -math.inf and lo != -math.inf)
    a, b = parse(lo), parse(hi)
    return a is not None and b is not None and a > b


def bound_parser(kind: str):
    """Reads a bound of a numeric, date, timestamp or timestamptz column; None where it isn't one."""
    if kind == "numeric":
        return lambda x: x if isinstance(x, float) else None
    if kind == "date":
        return lambda x: parse_date(x) if isinstance(x, str) else None
    return lambda x: parse_time_point(x, kind == "timestamptz") if isinstance(x, str) else None


#: What bounds look like, by kind.
BOUND_NOUNS = {"numeric": "a number", "date": "an ISO 8601 date", "timestamp": "an ISO 8601 datetime without a zone", "timestamptz": "an ISO 8601 datetime with an offset", "string": "a string"}


def check_document(path: str | Path) -> tuple[Report, Dictionary | None]:
    """The spec level: the report, and the dictionary if no error stops it."""
    try:
        report, root, version = read_document(path)
    except Stop as stop:
        return stop.args[0], None
    d = lower(root, version, report)
    check_dictionary(d, report)
    _learn_more(root, report)
    _version(root, report)
    report.sort()
    return report, d if report.status != "error" else None


def check_dictionary(d: Dictionary, report: Report) -> None:
    for r in d.relationships:
        _references(d, r, report)
    for r in d.relationships:
        if r.join and not 1 <= len(r.join.tables()) <= 2:
            report.spec("S04", "A `join` must refer to one table or two.", f"refers to {len(r.join.tables())} tables", r.text.spot)
    for r in d.relationships:
        _conflicts(d, r, report)
    for r in d.relationships:
        _cardinality(d, r, report)
    seen_tables: dict[str, Spot | None] = {}
    for t in d.tables:
        if not t.name.value:
            report.spec("S11", "A table must have a name.", "is empty", t.name.spot)
        elif (key := fold(t.name.value) if d.rich else t.name.value) in seen_tables:
            report.spec("S10", "Table names must be unique" + (", whatever their case." if d.rich else "."), "is duplicated", seen_tables[key], t.name.spot)
        else:
            seen_tables[key] = t.name.spot
        seen: dict[str, Spot | None] = {}
        for c in t.columns:
            _column(d, t, c, seen, report)
    if len(d.tables) == 1:
        for key, spot in (("description", d.tables[0].description), ("details", d.tables[0].details)):
            if spot:
                report.spec("S16", "A dictionary of one table describes the dataset at the top level.", f"the table has a `{key}`", d.tables[0].name.spot, spot, severity="warning")
    seen_extensions: dict[str, Spot | None] = {}
    for e in d.extensions:
        if not re.fullmatch(r"[a-z0-9_]+", e.value):
            report.spec("S19", "An extension's name is made of lower-case letters, digits and underscores.", "is empty" if not e.value else "has other characters", e.spot)
        if e.value in seen_extensions:
            report.spec("S20", "An extension is declared once.", f"`{e.value}` is declared again", seen_extensions[e.value], e.spot, severity="warning")
        seen_extensions.setdefault(e.value, e.spot)


def _references(d: Dictionary, r, report: Report) -> None:
    for q in r.join.columns() if r.join else ():
        table, spot = d.table(q.table), within(r.text.spot, r.text.value, q.start, q.end)
        if table is None:
            report.spec("S02", "A `join` must refer to tables of the dictionary.", f"table `{q.table}` isn't defined", spot)
        elif table.column(q.column) is None:
            report.spec("S03", "A `join` must refer to columns of the dictionary.", f"table `{q.table}` has no column `{q.column}`", spot)


def _conflicts(d: Dictionary, r, report: Report) -> None:
    tables = [t for name in (r.join.tables() if r.join else ()) if (t := d.table(name))]
    for c in r.conflicts:
        if lacking := [f"`{t.name.value}`" for t in tables if t.column(c.value) is None]:
            report.spec("S05", "A `conflicts` entry names a column of both sides.", f"`{c.value}` isn't a column of {' and '.join(lacking)}", r.text.spot, c.spot)


def _cardinality(d: Dictionary, r, report: Report) -> None:
    # What isn't there is reported elsewhere; of joins by ranges only data can tell.
    if not r.join or not r.join.is_equality or any((t := d.table(q.table)) is None or t.column(q.column) is None for q in r.join.columns()):
        return
    oriented = r.join.oriented(True)
    unique = [any(d.table(x.table).column(x.column).unique for x in side) for side in ([c.left for c in oriented], [c.right for c in oriented])]
    needed = {"one-to-one": (True, True), "one-to-many": (True, False), "many-to-one": (False, True)}[r.cardinality.value]
    if lacking := [f"`{name}`" for name, has, need in zip(r.join.sides(True), unique, needed, strict=True) if need and not has]:
        report.spec("S06", f"A `{r.cardinality.value}` join needs a `primary_key` or `unique` column on each side that is one.", f"no join column of {' or '.join(lacking)} is `primary_key` or `unique`", r.text.spot, r.cardinality.spot)


def _column(d: Dictionary, t: Table, c: Column, seen: dict, report: Report) -> None:
    at = lambda spot: (t.name.spot, c.name.spot, spot)
    if c.has("foreign_key") and not d.foreign_key_targets(t.name.value, c.name.value):
        report.spec("S01", "A `foreign_key` column needs a relationship to a `primary_key`.", "no relationship pairs it with a `primary_key`", *at(next(x.spot for x in c.constraints if x.value == "foreign_key")))
    if not d.rich:
        if _representation(t, c, report) and _value_types(t, c, report):
            _range_order(t, c, report)
        if c.units and (c.type is None or c.type.value != "number(quantity)"):
            report.spec("S08", "A column with `units` must have type `number(quantity)`.", f"has {f'type `{c.type.value}`' if c.type else 'no type'}", *at(c.units.spot))
        if c.time_zone and (c.type is None or c.type.value != "datetime"):
            report.spec("S14", "A column with `time_zone` must have type `datetime`.", f"has {f'type `{c.type.value}`' if c.type else 'no type'}", *at(c.time_zone.spot))
    if c.time_zone and not time_zone_ok(c.time_zone.value):
        report.spec("S15", "A `time_zone` is `naive`, `UTC` or an `Area/Location` name.", "isn't a time zone", *at(c.time_zone.spot))
    if not c.name.value:
        report.spec("S11", "A column must have a name.", "is empty", t.name.spot, c.name.spot)
    elif (key := fold(c.name.value) if d.rich else c.name.value) in seen:
        report.spec("S10", "A table's column names must be unique" + (", whatever their case." if d.rich else "."), "is duplicated", t.name.spot, seen[key], c.name.spot)
    else:
        seen[key] = c.name.spot


def _representation(t: Table, c: Column, report: Report) -> bool:
    """S07 of the older format: a type has its own way of describing values, and no other."""
    if c.type is None:
        return True
    kind = c.type.value
    own = {"enum": "values", "boolean": None}.get(kind, "range" if kind in RANGE_TYPES else "examples")
    have = {"values": c.values, "range": c.range, "examples": c.examples}
    ok = True
    if own and have[own] is None:
        report.spec("S07", f"A `{kind}` column is described by `{own}`.", f"lacks `{own}`", t.name.spot, c.name.spot, c.type.spot)
        ok = False
    for key, value in have.items():
        if key != own and value is not None:
            report.spec("S07", f"A `{kind}` column is described by `{own}`." if own else "A `boolean` column needs no description of values.", f"has type `{kind}` but uses `{key}`", t.name.spot, c.name.spot, value.spot)
            ok = False
    return ok


def _legacy_kind(c: Column) -> str:
    base = c.type.value.partition("(")[0]
    return {"number": "numeric", "datetime": "timestamp" if c.time_zone else "timestamptz"}.get(base, base)


def _value_types(t: Table, c: Column, report: Report) -> bool:
    """S12 of the older format."""
    if c.type is None or c.type.value in ("enum", "boolean"):
        return True
    kind = _legacy_kind(c)
    key, listed = ("range", c.range) if c.type.value in RANGE_TYPES else ("examples", c.examples)
    ok = True
    for v in listed.value if listed else ():
        fits = v.value is not COMPOUND if kind == "string" else kind != "numeric" and is_infinite(v.value) or bound_parser(kind)(v.value) is not None
        if not fits:
            report.spec("S12", f"Each of the `{key}` of a `{c.type.value}` column is {BOUND_NOUNS[kind]}.", f"is {noun(v.value)}", t.name.spot, c.name.spot, v.spot)
            ok = False
    return ok


def _range_order(t: Table, c: Column, report: Report) -> None:
    if c.type is None or c.type.value not in RANGE_TYPES or c.range is None or len(c.range.value) != 2:
        return
    lo, hi = c.range.value
    if descending(lo.value, hi.value, bound_parser(_legacy_kind(c))):
        report.spec("S13", "A range's minimum is at most its maximum.", "is greater than the maximum", t.name.spot, c.name.spot, lo.spot)


def _learn_more(root, report: Report) -> None:
    top = entries(root)
    if "$learn_more" not in top:
        spot = spot_of(top["$version"][0])
        p = report.spec("S09", "A document points readers to its format with `$learn_more`.", "`$learn_more` isn't set", spot, severity="warning")
        p.suggestion = {"title": "point readers to the format", "replacement": f"$learn_more: {LEARN_MORE}\n"}


def _version(root, report: Report) -> None:
    if "version" not in (top := entries(root)):
        return
    key, body = top["version"]
    kinds = list(entries(body).items())
    if len(kinds) != 1:
        said = "has none of them" if not kinds else f"`{kinds[0][0]}` is there already"
        report.spec("S17", "A `version` has one of `number`, `date` and `hash`.", said, spot_of(key), *([spot_of(kinds[0][1][0]), spot_of(kinds[-1][1][0])] if kinds else []))
        return
    (name, (_, node)) = kinds[0]
    text = node.value if isinstance(scalar(node), str) else ""
    if name == "number" and not is_version_number(text) or name == "date" and parse_date(text) is None:
        what = "three numbers with dots between, and a suffix perhaps" if name == "number" else "an ISO 8601 date"
        report.spec("S17", f"A version's `{name}` is {what}.", f"`{node.value}` isn't", spot_of(key), spot_of(node))
