"""Validation of a dictionary and of data against it, at three levels: spec, meta and data."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.types import EXTENSIONS, LogicalType, TypeProblem, category, field_type, parse_type, same_type
from ..plans.loader import noun
from ..plans.model import Column, Dictionary, Table
from ..plans.joins import PROBED
from ..plans.problems import SAMPLE_ROWS, Report
from ..plans.spec_rules import BOUND_NOUNS, bound_parser, check_document, descending, is_infinite
from ..sources import relations
from ..sources.relations import Source, legacy_type, spelled
from . import data_checks


def validate_spec(path: str | Path) -> Report:
    return check_document(path)[0]


def validate_meta(spark: SparkSession, path: str | Path, table: str | None = None, source: Source | None = None) -> Report:
    """The spec level, then schemas. source stands in for the one that the dictionary names."""
    return _validate(spark, path, table, source, data=False)


def validate_data(spark: SparkSession, path: str | Path, table: str | None = None, source: Source | None = None) -> Report:
    """The spec and meta levels, then values."""
    return _validate(spark, path, table, source, data=True)


def _validate(spark: SparkSession, path: str | Path, table: str | None, source: Source | None, data: bool) -> Report:
    report, d = check_document(path)
    if d is not None:
        base = Path(path).parent
        if d.rich:
            check_rich(spark, d, report, base, table, source, data)
        else:
            check_legacy(spark, d, report, base, table, source, data)
    return report


def selected(d: Dictionary, table: str | None, report: Report) -> list[Table] | None:
    """The tables that a filter leaves; None, and a pre-flight problem, if it names none."""
    if table is None:
        return d.tables
    if d.table(table) is None:
        names = [t.name.value for t in d.tables]
        report.add("table_not_found", f"no table `{table}` in the dictionary; it has {', '.join(names)}", payload={"available": names})
        return None
    return [d.table(table)]


# --- types -------------------------------------------------------------


def resolve_types(d: Dictionary, report: Report | None = None, table: str | None = None) -> dict[tuple[int, int], LogicalType]:
    """Types of typed columns by (table, column) place. Typedefs (M08) and column types (M09) that don't resolve are reported; one bad column spares its neighbours."""
    out = {}
    for td in d.typedefs:
        _typedef(td, d.aliases(), report)
    for i, t in enumerate(d.tables):
        own = report if table in (None, t.name.value) else None
        scope = d.aliases(t)
        bad = {td.name.value for td in t.typedefs if not _typedef(td, scope, own)}
        for j, c in enumerate(t.columns):
            if c.type is None:
                continue
            try:
                out[i, j] = parse_type(c.type.value, scope)
            except TypeProblem as e:
                if own and c.type.value not in bad:
                    own.add("invalid_column_type", str(e), t.name.spot, c.name.spot, c.type.spot, expected="A column's type must resolve.", table=t.name.value, column=c.name.value)
                elif own:
                    own.add("invalid_column_type", f"the typedef `{c.type.value}` doesn't resolve", t.name.spot, c.name.spot, c.type.spot, expected="A column's type must resolve.", table=t.name.value, column=c.name.value)
    return out


def _typedef(td, scope: dict[str, str], report: Report | None) -> bool:
    try:
        parse_type(td.body.value, scope, (td.name.value.upper(),))
        return True
    except TypeProblem as e:
        if report:
            report.add("invalid_typedef", str(e), td.name.spot, td.body.spot, expected="A typedef must resolve.")
        return False


def load_extensions(d: Dictionary, report: Report) -> None:
    for e in d.extensions:
        if e.value not in EXTENSIONS:
            known = ", ".join(sorted(EXTENSIONS))
            report.add("unloadable_extension", f"this engine has no extension `{e.value}`; it has {known}", e.spot, expected="A declared extension must be there.")


def _descriptive(t: Table, c: Column, kind: LogicalType, report: Report) -> None:
    """S07, S08 and S12 to S14 of the richer format: nothing is required, but what is there must make sense for the type."""
    cat = category(kind)
    orderly = cat in ("numeric", "date", "timestamp", "timestamptz")
    at = lambda x: (t.name.spot, c.name.spot, x.spot)
    if cat == "boolean":
        for key, value in (("values", c.values), ("range", c.range), ("examples", c.examples)):
            if value:
                report.spec("S07", "A BOOLEAN column needs no description of values.", f"has type `{kind}` but uses `{key}`", *at(value))
    elif c.range and not orderly:
        report.spec("S07", f"A `{kind}` column has no range.", f"has type `{kind}` but uses `range`", *at(c.range))
    if c.units and cat != "numeric":
        report.spec("S08", "A column with `units` must have a numeric type.", f"has type `{kind}`", *at(c.units))
    if c.time_zone and cat not in ("timestamp", "timestamptz"):
        report.spec("S14", "A column with `time_zone` must have a timestamp type.", f"has type `{kind}`", *at(c.time_zone))
    if orderly and c.range:
        parse = bound_parser(cat)
        wrong = [b for b in c.range.value if not is_infinite(b.value) and parse(b.value) is None]
        for b in wrong:
            report.spec("S12", f"Each bound of a `{kind}` column is {BOUND_NOUNS[cat]}.", f"is {noun(b.value)}", *at(b))
        if not wrong and len(c.range.value) == 2 and descending(*(b.value for b in c.range.value), parse):
            report.spec("S13", "A range's minimum is at most its maximum.", "is greater than the maximum", *at(c.range.value[0]))


# --- the richer format -------------------------------------------------


def check_rich(spark: SparkSession, d: Dictionary, report: Report, base: Path, table: str | None = None, source: Source | None = None, data: bool = False) -> None:
    if selected(d, table, report) is None:
        return
    load_extensions(d, report)
    types = resolve_types(d, report, table)
    for i, t in enumerate(d.tables):
        if table in (None, t.name.value):
            for j, c in enumerate(t.columns):
                if (i, j) in types:
                    _descriptive(t, c, types[i, j], report)
    if source is None:
        if d.source is None:
            report.add("missing_source", "the dictionary names no `source`", expected="A dictionary that is checked against data names a `source`.")
            return
        try:
            source = relations.open_source(spark, *d.source.value, base)
            source.names()
        except Exception as e:  # whatever the file system or catalog raises
            report.add("unreadable_source", _reason(e), d.source.spot, expected="A dictionary's `source` must be readable.")
            return
    names = source.names()
    frames: dict[str, DataFrame] = {}

    def frame(name: str, spot) -> DataFrame | None:
        actual = spelled(name, names)
        if actual is not None and actual not in frames:
            try:
                frames[actual] = source.table(actual)
            except Exception as e:
                report.add("unreadable_source", _reason(e), spot, expected="A dictionary's `source` must be readable.", table=name)
                return None
        return frames.get(actual)

    for i, t in enumerate(d.tables):
        if table not in (None, t.name.value):
            continue
        if spelled(t.name.value, names) is None:
            report.add("missing_table", "is missing from the data", t.name.spot, expected="Each table of the dictionary must be in the data.", table=t.name.value)
        elif (df := frame(t.name.value, t.name.spot)) is not None:
            _diff(t, {j: k for (i2, j), k in types.items() if i2 == i}, df, report)
    if table is None:
        for name in names:
            if spelled(name, [t.name.value for t in d.tables]) is None:
                report.add("extra_table", f"`{name}` is in the data but not the dictionary", severity="warning", expected="Each table of the data should be described.", table=name)
    if data:
        for t in d.tables:
            if table in (None, t.name.value) and (df := frame(t.name.value, t.name.spot)) is not None:
                _table_values(d, t, df, lambda name: frame(name, None), report)
        _relationship_values(d, table, lambda name: frame(name, None), report)


def _reason(e: Exception) -> str:
    return str(e).split("\n")[0]


def _diff(t: Table, types: dict[int, LogicalType], df: DataFrame, report: Report) -> None:
    """M01 to M03."""
    fields = {f.name: f for f in df.schema.fields}
    for j, c in enumerate(t.columns):
        actual = spelled(c.name.value, list(fields))
        if actual is None:
            report.add("missing_in_data", "is missing from the data", t.name.spot, c.name.spot, expected="Each column of the dictionary must be in the data.", table=t.name.value, column=c.name.value)
        elif j in types and not same_type(types[j], fields[actual]):
            said, found = str(types[j]), str(field_type(fields[actual]))
            report.add("type_mismatch", f"the data is `{found}`", t.name.spot, c.name.spot, c.type.spot, expected="A column's data must have its declared type.", table=t.name.value, column=c.name.value, payload={"declared": said, "actual": found})
    for name, f in fields.items():
        if spelled(name, [c.name.value for c in t.columns]) is None:
            found = str(field_type(f))
            report.add("extra_in_data", f"`{name}` is in the data (`{found}`) but not the dictionary", severity="warning", expected="Each column of the data should be described.", table=t.name.value, column=name, payload={"actual": found})


def _plural(n: int, what: str) -> str:
    return f"{n} {what}{'' if n == 1 else 's'}"


def _table_values(d: Dictionary, t: Table, df: DataFrame, frame, report: Report) -> None:
    """D01 in one pass over the required columns, then D02, D03 and D04."""
    own = lambda c: spelled(c.name.value, df.columns)

    def counted(query) -> int:
        try:
            return query().first()[0]
        except Exception as e:
            report.add("unreadable_source", _reason(e), t.name.spot, expected="A dictionary's `source` must answer queries.", table=t.name.value)
            return 0

    required = [c for c in t.columns if c.required and own(c)]
    if required:
        try:
            nulls = list(data_checks.count_nulls(df, [own(c) for c in required]).first())
        except Exception as e:
            report.add("unreadable_source", _reason(e), t.name.spot, expected="A dictionary's `source` must answer queries.", table=t.name.value)
            nulls = [0] * len(required)
        for c, n in zip(required, nulls, strict=True):
            if n:
                why = next(x.spot for x in c.constraints if x.value in ("required", "primary_key"))
                report.add("nulls_in_required", f"has {_plural(n, 'null value')}", t.name.spot, c.name.spot, why, expected="A required column has no nulls.", table=t.name.value, column=c.name.value, payload={"count": n, "rows": []})
    key = [c for c in t.columns if c.has("primary_key")]
    if key and all(map(own, key)) and (n := counted(lambda: data_checks.duplicate_keys(df, [own(c) for c in key]))):
        report.add("duplicate_key", f"has {_plural(n, 'duplicated key value')}", t.name.spot, *(c.name.spot for c in key), expected="A primary key is unique.", table=t.name.value, payload={"count": n})
    for c in t.columns:
        if c.has("unique") and key != [c] and own(c) and (n := counted(lambda c=c: data_checks.duplicate_values(df, own(c)))):
            why = next(x.spot for x in c.constraints if x.value == "unique")
            report.add("duplicate_values", f"has {_plural(n, 'duplicated value')}", t.name.spot, c.name.spot, why, expected="A unique column has no value twice.", table=t.name.value, column=c.name.value, payload={"count": n})
    for c in t.columns:
        for target in d.foreign_key_targets(t.name.value, c.name.value) if c.has("foreign_key") and own(c) else ():
            pk = frame(target.table)
            pk_column = pk is not None and spelled(target.column, pk.columns)
            if pk_column and (n := counted(lambda c=c, pk=pk, pk_column=pk_column: data_checks.orphaned_values(df, own(c), pk, pk_column))):
                why = next(x.spot for x in c.constraints if x.value == "foreign_key")
                report.add("orphaned_values", f"has {_plural(n, 'value')} that `{target.table}.{target.column}` lacks", t.name.spot, c.name.spot, why, expected="A foreign key's values exist in its primary key.", table=t.name.value, column=c.name.value, payload={"count": n})


def _relationship_values(d: Dictionary, table: str | None, frame, report: Report) -> None:
    """D05, for each relationship and direction."""
    for r in d.relationships:
        if r.join is None or table is not None and table not in r.join.sides(True):
            continue
        for probe_left in PROBED[r.cardinality.value]:
            names = r.join.sides(probe_left)
            probe, other = map(frame, names)
            if probe is None or other is None:
                continue
            conjuncts = [(spelled(c.left.column, probe.columns), c.op, spelled(c.right.column, other.columns)) for c in r.join.oriented(probe_left)]
            if any(a is None or b is None for a, _, b in conjuncts):
                continue
            try:
                n = data_checks.overmatched_rows(probe, other, conjuncts).first()[0]
            except Exception as e:
                report.add("unreadable_source", _reason(e), r.text.spot, expected="A dictionary's `source` must answer queries.")
                continue
            if n:
                said = f"{_plural(n, f'`{names[0]}` row')} match{'es' if n == 1 else ''} more than one `{names[1]}` row (declared `{r.cardinality.value}`)"
                report.add("cardinality_violation", said, r.text.spot, r.cardinality.spot, expected="A relationship's cardinality holds in the data.", table=names[0], payload={"count": n})


# --- the older format --------------------------------------------------


def compatible(declared: str, actual: str) -> bool:
    """Whether an older type's category fits the data's; an enum may be text, numbers or an enum."""
    base = declared.partition("(")[0]
    return actual in ("string", "number", "enum") if base == "enum" else actual == base and base in ("number", "string", "boolean", "date", "datetime")


def check_legacy(spark: SparkSession, d: Dictionary, report: Report, base: Path, table: str | None = None, source: Source | None = None, data: bool = False) -> None:
    """Each table's own Parquet; a table that can't be read doesn't stop the others. Names are compared exactly."""
    for t in selected(d, table, report) or ():
        try:
            if source is not None:
                df = source.table(t.name.value)
            elif t.parquet is None:
                report.add("missing_source", "has no `source`", t.name.spot, expected="A table that is checked against data names a `source`.", table=t.name.value)
                continue
            else:
                df = spark.read.parquet(relations.resolve(t.parquet.value, base))
            fields = {f.name: f for f in df.schema.fields}
        except Exception as e:
            report.add("unreadable_source", _reason(e), t.name.spot, t.parquet.spot if t.parquet else None, expected="A table's `source` must be readable.", table=t.name.value)
            continue
        for c in t.columns:
            if c.name.value in fields and c.type and not compatible(c.type.value, found := legacy_type(fields[c.name.value].dataType)):
                report.add("type_mismatch", f"the data is `{found}`", t.name.spot, c.name.spot, c.type.spot, expected="A column's data must have its declared type.", table=t.name.value, column=c.name.value, payload={"declared": c.type.value, "actual": found})
        for c in t.columns:
            if c.name.value not in fields:
                report.add("missing_in_data", "is missing from the data", t.name.spot, c.name.spot, expected="Each column of the dictionary must be in the data.", table=t.name.value, column=c.name.value)
        for name, f in fields.items():
            if t.column(name) is None:
                found = legacy_type(f.dataType)
                report.add("extra_in_data", f"`{name}` is in the data (`{found}`) but not the dictionary", severity="warning", expected="Each column of the data should be described.", table=t.name.value, column=name, payload={"actual": found})
        checked = [c for c in t.columns if c.required and c.name.value in fields]
        if checked and data:
            _legacy_nulls(t, checked, df, base, report)


def _legacy_nulls(t: Table, checked: list[Column], df: DataFrame, base: Path, report: Report) -> None:
    """D01 in phases: the footer's verdict where there is one, then one scan for all columns that it leaves open, then their first rows."""
    known: dict[str, int | None] = {}
    if t.parquet is not None:
        try:
            known = {c.name: c.nulls for c in relations.parquet_columns(relations.resolve(t.parquet.value, base), df.sparkSession)}
        except Exception:  # footers that can't be read: only a scan can tell
            known = {}
    open_columns = [c.name.value for c in checked if known.get(c.name.value) is None]
    scanned = dict(zip(open_columns, data_checks.count_nulls(df, open_columns).first(), strict=True)) if open_columns else {}
    for c in checked:
        n = known.get(c.name.value) or scanned.get(c.name.value) or 0
        if not n:
            continue
        rows = [r["row"] for r in data_checks.null_rows(df, c.name.value, SAMPLE_ROWS).collect()] if c.name.value in scanned else []
        why = next(x.spot for x in c.constraints if x.value in ("required", "primary_key"))
        report.add("nulls_in_required", f"has {_plural(n, 'null value')}", t.name.spot, c.name.spot, why, expected="A required column has no nulls.", table=t.name.value, column=c.name.value, payload={"count": n, "rows": rows})
