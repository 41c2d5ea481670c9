"""Commands: python -m lexispark.cli COMMAND …"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import validate
from .plans.generation import GenerationProblem, Options
from .plans.loader import find_dictionary
from .plans.model import Dictionary
from .plans.spec_rules import check_document
from .sources import relations
from .sources.generated import DdlProblem, Generator, ddl, expand_typedefs

FORMAT = """\
A dictionary is a YAML map. $version ("0.2.0") is required; $learn_more, name, description, details, glossary and version (one of number, date, hash) describe it.
source names the data: {parquet: {dir: FOLDER}} with a <table>.parquet for each table, or {catalog: {database: NAME}}.
typedef maps names to type expressions; tables may have their own, which hide global ones.
duckdb: {extensions: [...]} lists type packs: json, spatial, icu, parquet.
tables is a list of maps with name and columns; columns have name, type, constraints (primary_key, foreign_key, required, unique), and values, range, examples, units, time_zone, display, label, description, details.
relationships is a list of maps with cardinality (one-to-one, one-to-many, many-to-one), join (t.a = u.b AND …, with = > < >= <=) and conflicts.
Version "0.1.0" has coarse types (enum, number, number(id), number(ordinal), number(quantity), string, boolean, date, datetime) and a source: {parquet: FILE} for each table."""


def session() -> SparkSession:
    return SparkSession.builder.appName("lexispark").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def table_of(headers: list[str], rows: list[list[str]]) -> str:
    widths = [max(map(len, column)) for column in zip(headers, *rows, strict=True)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in [headers, *rows])


def row_override(text: str) -> tuple[str, int]:
    name, equals, n = text.rpartition("=")
    if not equals or not name or not n.isdigit():
        raise argparse.ArgumentTypeError(f"`{text}` isn't TABLE=N")
    return name, int(n)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexispark", description="Data dictionaries for Spark.")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("validate-spec", "validate-meta", "validate-data", "resolve", "ddl", "dummy"):
        c = commands.add_parser(name)
        c.add_argument("path", nargs="?", default=".", help="a dictionary, or its folder")
        if name.startswith("validate"):
            c.add_argument("--json", action="store_true")
        if name in ("validate-meta", "validate-data"):
            c.add_argument("--table")
        if name == "dummy":
            c.add_argument("--out", help="a folder for Parquet tables")
            c.add_argument("--sql", action="store_true", help="print a script instead")
            c.add_argument("--force", action="store_true", help="replace the folder, once all is written")
            c.add_argument("--rows", type=int, default=10)
            c.add_argument("--rows-table", type=row_override, action="append", default=[], metavar="TABLE=N")
            c.add_argument("--seed", type=int, default=0)
            c.add_argument("--null-fraction", type=float, default=0.1)
    types = commands.add_parser("types").add_subparsers(dest="kind", required=True)
    types.add_parser("parquet").add_argument("file")
    source = types.add_parser("source")
    source.add_argument("place", help="a folder of Parquet tables, or catalog:DATABASE")
    commands.add_parser("spec")
    return p


def _lowered(path: str) -> Dictionary | None:
    report, d = check_document(find_dictionary(path))
    if d is None:
        print(report.to_text(), file=sys.stderr)
    return d


def main(arguments: list[str] | None = None) -> int:
    """0 if all is well but for warnings, 1 for errors."""
    a = parser().parse_args(arguments)
    if a.command == "spec":
        print(FORMAT)
        return 0
    if a.command.startswith("validate"):
        path = find_dictionary(a.path)
        report = validate.validate_spec(path) if a.command == "validate-spec" else (validate.validate_meta if a.command == "validate-meta" else validate.validate_data)(session(), path, a.table)
        print(report.to_json() if a.json else report.to_text() or "no problems")
        return report.exit_code
    if a.command == "types":
        if a.kind == "parquet":
            rows = [[str(i + 1), c.name, c.type, c.logical or "-", c.physical] for i, c in enumerate(relations.parquet_columns(a.file))]
            print(table_of(["#", "column", "dict type", "logical type", "physical type"], rows))
            return 0
        kind, _, database = a.place.partition("catalog:")
        found = relations.open_source(session(), "catalog" if database else "parquet", database or kind, Path())
        for name in found.names():
            print(name)
            print(table_of(["#", "column", "type"], [[str(i + 1), x.column, x.type] for i, x in enumerate(relations.describe(found, [name]))]))
        return 0
    d = _lowered(a.path)
    if d is None:
        return 1
    try:
        if a.command == "ddl":
            print(ddl(d), end="")
        elif a.command == "resolve":
            found = expand_typedefs(d)
            for e in found:
                print(f"{e.table + '.' if e.table else ''}{e.name}: {e.body} -> {e.expansion or 'error: ' + str(e.error)}")
            return int(any(e.error for e in found))
        else:
            made = Generator(d, Options(a.rows, dict(a.rows_table), a.seed, a.null_fraction))
            if a.sql or not a.out:
                print(made.script(session()), end="")
            else:
                made.write(session(), a.out, a.force)
    except (DdlProblem, GenerationProblem, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
