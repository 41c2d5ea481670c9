"""Reading a dictionary: YAML with places, a closed schema for each format, and the model."""

from __future__ import annotations

import math
import re
from pathlib import Path
from typing import Any

from .joins import Join, JoinProblem
from .model import COMPOUND, At, Column, Dictionary, Relationship, Spot, Table, Typedef
from .problems import Report

try:
    import yaml
except ImportError:  # only dictionaries in files need it
    yaml = None

#: Format versions.
LEGACY, RICH = "0.1.0", "0.2.0"
CONSTRAINTS = ("primary_key", "foreign_key", "required", "unique")
CARDINALITIES = ("one-to-one", "one-to-many", "many-to-one")
LEGACY_TYPES = ("enum", "number", "number(id)", "number(ordinal)", "number(quantity)", "string", "boolean", "date", "datetime")


class Stop(Exception):
    """Loading can't go on; the report says why."""


def spot_of(node: yaml.Node) -> Spot:
    return Spot(node.start_mark.line, node.start_mark.column, node.end_mark.line, node.end_mark.column)


def scalar(node: yaml.Node) -> Any:
    """A node's value by the core rules, whatever its quotes: null, bool, float or str; COMPOUND for lists and maps."""
    if not isinstance(node, yaml.ScalarNode):
        return COMPOUND
    s = node.value
    if s in ("", "~", "null", "Null", "NULL"):
        return None
    if s in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return s[0] in "tT"
    if re.fullmatch(r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", s):
        return float(int(s, 0) if s[:2] in ("0o", "0x") else int(s))
    if re.fullmatch(r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?", s):
        return float(s)
    if re.fullmatch(r"[-+]?\.(inf|Inf|INF)", s):
        return -math.inf if s[0] == "-" else math.inf
    return math.nan if s in (".nan", ".NaN", ".NAN") else s


def noun(value: Any) -> str:
    if value is COMPOUND:
        return "a list or map"
    return "null" if value is None else {bool: "a boolean", float: "a number", str: "a string"}[type(value)]


# A schema is a function of (node, path) that raises Mismatch.


class Mismatch(Exception):
    def __init__(self, message: str, node: yaml.Node):
        super().__init__(message)
        self.node = node


def _kind(*kinds: type, what: str):
    def check(node, path):
        if type(scalar(node)) not in kinds:
            raise Mismatch(f"{path} must be {what}, not {noun(scalar(node))}", node)

    return check


_string = _kind(str, what="a string")
_number = _kind(float, what="a number")
_any_string = _kind(str, type(None), what="a string")
_scalar = _kind(str, float, bool, what="a scalar")


def _any(node, path):
    return None


def _one_of(*values: str):
    def check(node, path):
        if not isinstance(node, yaml.ScalarNode) or node.value not in values:
            raise Mismatch(f"{path} must be one of {', '.join(values)}", node)

    return check


def _either(*checks):
    def check(node, path):
        for i, c in enumerate(checks):
            try:
                return c(node, path)
            except Mismatch:
                if i == len(checks) - 1:
                    raise

    return check


def _list(item, length: int | None = None):
    def check(node, path):
        if not isinstance(node, yaml.SequenceNode):
            raise Mismatch(f"{path} must be a list", node)
        if length is not None and len(node.value) != length:
            raise Mismatch(f"{path} must have {length} items", node)
        for i, x in enumerate(node.value):
            item(x, f"{path}[{i}]")

    return check


def _map(value):
    def check(node, path):
        if not isinstance(node, yaml.MappingNode):
            raise Mismatch(f"{path} must be a map", node)
        for k, v in node.value:
            value(v, f"{path}.{k.value}")

    return check


def _closed(required: tuple[str, ...] = (), **keys):
    keys = {("$" + k[7:] if k.startswith("dollar_") else k): v for k, v in keys.items()}

    def check(node, path):
        if not isinstance(node, yaml.MappingNode):
            raise Mismatch(f"{path} must be a map", node)
        there = {}
        for k, v in node.value:
            name = k.value if isinstance(k, yaml.ScalarNode) else None
            if name not in keys:
                raise Mismatch(f"{path} has an unknown key `{name}`", k)
            there[name] = v
        for name in required:
            if name not in there:
                raise Mismatch(f"{path} lacks `{name}`", node)
        for name, v in there.items():
            keys[name](v, f"{path}.{name}" if path != "the document" else f"`{name}`")

    return check


_column = {
    "name": _any_string, "description": _string, "details": _string, "display": _one_of("restricted"), "units": _string, "time_zone": _string, "values": _either(_list(_scalar), _map(_string)),
    "range": _list(_either(_number, _string), 2), "constraints": _list(_one_of(*CONSTRAINTS)), "examples": _list(_any),
}
_relation = _closed(("cardinality", "join"), description=_string, cardinality=_one_of(*CARDINALITIES), join=_string, conflicts=_list(_string))
_top = {"dollar_learn_more": _string, "name": _string, "description": _string, "details": _string, "relationships": _list(_relation), "glossary": _map(_string), "version": _closed((), number=_either(_string, _number), date=_string, hash=_string)}
_text = {"description": _string, "details": _string}
SCHEMAS = {
    RICH: _closed(
        ("$version",), dollar_version=_any, typedef=_map(_string), duckdb=_closed(("extensions",), extensions=_list(_any_string)),
        source=_either(_closed(("parquet",), parquet=_closed(("dir",), dir=_string)), _closed(("catalog",), catalog=_closed(("database",), database=_string)), _closed(("duckdb",), duckdb=_closed(("file",), file=_string))),
        tables=_list(_closed(("name", "columns"), name=_any_string, label=_string, typedef=_map(_string), columns=_list(_closed(("name",), label=_string, type=_string, **_column)), **_text)), **_top,
    ),
    LEGACY: _closed(
        ("$version",), dollar_version=_any,
        tables=_list(_closed(("name", "columns"), name=_any_string, source=_closed(("parquet",), parquet=_string), columns=_list(_closed(("name",), type=_one_of(*LEGACY_TYPES), **_column)), **_text)), **_top,
    ),
}


def _loader():
    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {}
    return Loader


def _reject_repeated_keys(node: yaml.Node) -> None:
    if isinstance(node, yaml.MappingNode):
        seen = set()
        for k, v in node.value:
            if isinstance(k, yaml.ScalarNode):
                if k.value in seen:
                    raise Mismatch(f"the key `{k.value}` is repeated", k)
                seen.add(k.value)
            _reject_repeated_keys(v)
    elif isinstance(node, yaml.SequenceNode):
        for x in node.value:
            _reject_repeated_keys(x)


def entries(node: yaml.Node | None) -> dict[str, tuple[yaml.Node, yaml.Node]]:
    return {k.value: (k, v) for k, v in node.value if isinstance(k, yaml.ScalarNode)} if isinstance(node, yaml.MappingNode) else {}


def read_document(path: str | Path) -> tuple[Report, yaml.Node, str]:
    """(report, root, version), or Stop with the report's one pre-flight problem."""
    if yaml is None:
        raise ImportError("reading dictionaries needs PyYAML")
    report = Report(str(path))
    try:
        report.text = Path(path).read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError) as e:
        report.add("io", f"{path} can't be read: {e}")
        raise Stop(report) from e
    try:
        root = yaml.compose(report.text, Loader=_loader())
        _reject_repeated_keys(root)
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        report.add("parse", str(getattr(e, "problem", e)), mark and Spot(mark.line, mark.column, mark.line, mark.column + 1))
        raise Stop(report) from e
    except Mismatch as e:
        report.add("parse", str(e), spot_of(e.node))
        raise Stop(report) from e
    version = entries(root).get("$version")
    said = version[1].value if version and isinstance(version[1], yaml.ScalarNode) else None
    # Without a version the older schema says what is missing.
    if version and (said not in SCHEMAS or not isinstance(scalar(version[1]), str)):
        report.add("schema", f"unsupported version `{said}`; {LEGACY} and {RICH} are known", spot_of(version[1]))
        raise Stop(report)
    try:
        if root is None:
            raise Mismatch("the document is empty", yaml.ScalarNode("", "", yaml.Mark("", 0, 0, 0, None, 0), yaml.Mark("", 0, 0, 0, None, 0)))
        SCHEMAS[said or LEGACY](root, "the document")
    except Mismatch as e:
        report.add("schema", str(e), spot_of(e.node))
        raise Stop(report) from e
    return report, root, said


def _at(node: yaml.Node) -> At:
    return At(node.value, spot_of(node))


def _typedefs(node: yaml.Node | None, report: Report) -> list[Typedef]:
    out = []
    for k, v in node.value if isinstance(node, yaml.MappingNode) else ():
        if not isinstance(scalar(k), str):
            report.spec("S18", "A typedef's name must be a string.", f"is {noun(scalar(k))}", spot_of(k))
        elif isinstance(v, yaml.ScalarNode):
            out.append(Typedef(_at(k), _at(v)))
    return out


def _bounds(node: yaml.Node) -> At:
    return At([At(scalar(x), spot_of(x)) for x in node.value], spot_of(node))


def _lower_column(node: yaml.Node) -> Column:
    e = {k: v for k, (_, v) in entries(node).items()}
    text = lambda k: _at(e[k]) if k in e else None
    return Column(
        _at(e["name"]),
        text("type"),
        [_at(x) for x in e["constraints"].value] if "constraints" in e else [],
        e["label"].value if "label" in e else None,
        At(scalar(e["values"]), spot_of(e["values"])) if "values" in e else None,
        _bounds(e["range"]) if "range" in e else None,
        _bounds(e["examples"]) if "examples" in e else None,
        text("units"),
        text("time_zone"),
    )


def lower(root: yaml.Node, version: str, report: Report) -> Dictionary:
    """The model of a document that fits its schema. Joins that don't parse and odd typedef names are reported."""
    top = {k: v for k, (_, v) in entries(root).items()}
    d = Dictionary(rich=version == RICH, typedefs=_typedefs(top.get("typedef"), report))
    if "source" in top:
        kind, (_, body) = next(iter(entries(top["source"]).items()))
        _, value = next(iter(entries(body).values()))
        d.source = At((kind, value.value), spot_of(value))
    if "duckdb" in top:
        d.extensions = [_at(x) for x in entries(top["duckdb"])["extensions"][1].value]
    for node in top["tables"].value if "tables" in top else ():
        e = {k: v for k, (_, v) in entries(node).items()}
        keys = {k: spot_of(k_node) for k, (k_node, _) in entries(node).items()}
        d.tables.append(
            Table(
                _at(e["name"]), [_lower_column(c) for c in e["columns"].value], _typedefs(e.get("typedef"), report), e["label"].value if "label" in e else None,
                keys.get("description"), keys.get("details"), _at(entries(e["source"])["parquet"][1]) if "source" in e else None,
            )
        )
    for node in top["relationships"].value if "relationships" in top else ():
        e = {k: v for k, (_, v) in entries(node).items()}
        r = Relationship(_at(e["cardinality"]), _at(e["join"]), None, [_at(x) for x in e["conflicts"].value] if "conflicts" in e else [])
        try:
            r.join = Join.parse(r.text.value)
        except JoinProblem as p:
            report.spec("S04", "A `join` must be comparisons of `table.column` pairs, joined by AND.", f"{p} at character {p.at + 1}", within(r.text.spot, r.text.value, p.at, p.at + 1))
        d.relationships.append(r)
    return d


def within(spot: Spot | None, text: str, start: int, end: int) -> Spot | None:
    """A part of a scalar on one line, its quote left out; the whole scalar otherwise."""
    if spot is None or spot.line != spot.end_line:
        return spot
    quote = int(spot.end_column - spot.column == len(text) + 2)
    return Spot(spot.line, spot.column + quote + start, spot.line, spot.column + quote + end)


def find_dictionary(path: str | Path) -> Path:
    """A file itself; in a folder, the file `*dict.yaml` with the shortest name."""
    p = Path(path)
    found = sorted(p.glob("*dict.yaml"), key=lambda x: (len(x.name), x.name)) if p.is_dir() else []
    return found[0] if found else p
