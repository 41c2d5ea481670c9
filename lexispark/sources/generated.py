"""Synthetic tables from a dictionary: a lazy DataFrame for each, deterministic in the dictionary and the options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import METADATA_KEY, LogicalType, TypeProblem, capacity, orderable, spark_type
from ..functions.values import below_fraction, mix, nth, unsigned_mod, with_wrapping
from ..operators.data_checks import quoted
from ..operators.validate import resolve_types
from ..plans.generation import SLOT, Bound, ColumnPlan, Copy, Draw, GenerationProblem, Indexed, Options, Plain, Plan, Probe, TablePlan, make_plan
from ..plans.model import Dictionary
from ..plans.problems import Report


class Generator:
    """Refuses up front what can't be generated; then makes tables from row numbers alone."""

    def __init__(self, d: Dictionary, options: Options | None = None):
        self.options = options or Options()
        self.plan: Plan = make_plan(d, self.options)
        report = Report()
        found = resolve_types(d, report)
        if report.items:
            raise GenerationProblem("types", report.items[0].message)
        self.types: dict[str, dict[str, LogicalType]] = {t.name.value: {c.name.value: found[i, j] for j, c in enumerate(t.columns) if (i, j) in found} for i, t in enumerate(d.tables)}
        self._refuse_types()

    def _refuse_types(self) -> None:
        first: dict[int, LogicalType] = {}
        for t in self.plan.tables:
            for c in t.columns:
                kind, place = self.types[t.table].get(c.column), f"`{t.table}.{c.column}`"
                if kind is not None and not capacity(kind):
                    raise GenerationProblem("type", f"no values can be generated for {place}, {kind}")
                if kind is not None and isinstance(c.role, Indexed) and t.rows > capacity(kind):
                    raise GenerationProblem("capacity", f"{place}, {kind}, has {capacity(kind)} different values for {t.rows} rows")
                if isinstance(c.role, Copy):
                    source = self.types[c.role.one_table].get(c.role.one_column)
                    planned = self.plan.table(c.role.one_table).column(c.role.one_column)
                    again = planned is not None and (isinstance(planned.role, Indexed | Plain) or isinstance(planned.role, Draw) and planned.role.injective)
                    if kind is None or source is None or kind != source or not again:
                        raise GenerationProblem("range_copy", f"{place} can't copy `{c.role.one_table}.{c.role.one_column}`: both need one type, and the source a value that its row number tells")
                if isinstance(c.role, Bound | Probe):
                    rows = t.rows if isinstance(c.role, Bound) else self.plan.rows(c.role.one_table)
                    if kind is None or not orderable(kind) or first.setdefault(c.role.relationship, kind) != kind:
                        raise GenerationProblem("range_type", f"{place} needs an orderable type, and the same as its range join's other columns")
                    if SLOT * rows > capacity(kind):
                        raise GenerationProblem("range_capacity", f"{place}, {kind}, has too few values for {rows} intervals")

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """A table's rows, in as many partitions as Spark gives a range of that length; each cell depends on its row number only."""
        t = self.plan.table(name)

        def build() -> DataFrame:
            df = spark.range(t.rows)
            typed = [(c, self.types[name][c.column]) for c in t.columns if c.column in self.types[name]]
            made = df.select(*(self._cell(t, c, kind).cast(spark_type(kind)).alias(c.column, metadata={METADATA_KEY: str(kind)}) for c, kind in typed))
            made.schema  # analysed while arithmetic wraps
            return made

        return with_wrapping(spark, build)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {t.table: self.table(spark, t.table) for t in self.plan.tables}

    def _cell(self, t: TablePlan, c: ColumnPlan, kind: LogicalType) -> Column:
        value = self._value(t, c, kind, F.col("id"))
        if not c.nullable or not self.options.null_fraction:
            return value
        gone = below_fraction(mix(self.options.seed, f"null:{t.table}.{c.column}", F.col("id")), self.options.null_fraction)
        return F.when(~gone, value)

    def _value(self, t: TablePlan, c: ColumnPlan, kind: LogicalType, i: Column) -> Column:
        role = c.role
        if isinstance(role, Draw):
            k = i if role.injective else unsigned_mod(mix(self.options.seed, f"fk:{t.table}.{c.column}", i), max(1, self.plan.rows(role.target.table)))
            return self._stored(role.target.table, role.target.column, k)
        if isinstance(role, Bound):
            return nth(kind, i * SLOT + (SLOT - 1 if role.upper else 0))
        if isinstance(role, Probe | Copy):
            k = i if role.injective else unsigned_mod(mix(self.options.seed, f"range:{role.relationship}", i), max(1, self.plan.rows(role.one_table)))
            return nth(kind, k * SLOT + 1) if isinstance(role, Probe) else self._stored(role.one_table, role.one_column, k)
        return self._stored(t.table, c.column, i)

    def _stored(self, table: str, column: str, i: Column) -> Column:
        """What row i of a column has, nulls left aside: foreign keys lead to their target, and don't go round."""
        t = self.plan.table(table)
        c, kind = t.column(column), self.types[table].get(column)
        if kind is None:
            raise GenerationProblem("type", f"`{table}.{column}` has no type, so there is no value to draw")
        if isinstance(c.role, Plain):
            return nth(kind, unsigned_mod(mix(self.options.seed, f"fill:{table}.{column}", i), capacity(kind)))
        return nth(kind, i) if isinstance(c.role, Indexed) else self._value(t, c, kind, i)

    def write(self, spark: SparkSession, folder: str, force: bool = False) -> None:
        """A Parquet folder `<table>.parquet` for each table. A folder that exists is refused, or with force replaced once all is written."""
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        fs = path(folder).getFileSystem(conf)
        if fs.exists(path(folder)) and not force:
            raise FileExistsError(f"{folder} exists")
        temporary = f"{folder.rstrip('/')}.writing"
        fs.delete(path(temporary), True)
        for name, df in self.tables(spark).items():
            df.write.mode("errorifexists").parquet(f"{temporary}/{name}.parquet")
        old = f"{folder.rstrip('/')}.replaced"
        if fs.exists(path(folder)):
            fs.rename(path(folder), path(old))
        if not fs.rename(path(temporary), path(folder)):
            raise OSError(f"{temporary} couldn't be renamed to {folder}")
        fs.delete(path(old), True)

    def script(self, spark: SparkSession) -> str:
        """The tables as SQL: CREATE TABLE, then one INSERT of all rows. For small data; each row is text on the driver."""
        out = []
        for t in self.plan.tables:
            df = self.table(spark, t.table)
            if not df.columns:
                out.append(f"-- table {quoted(t.table)} skipped: no typed columns")
                continue
            out.append(create_table(t.table, self.types[t.table]))
            cells = df.select(*(_literal(F.col(quoted(f.name)), self.types[t.table][f.name]).alias(f"c{i}") for i, f in enumerate(df.schema.fields)))
            rows = [f"  ({', '.join(r)})" for r in cells.toLocalIterator()]
            if rows:
                out.append(f"INSERT INTO {quoted(t.table)} VALUES\n" + ",\n".join(rows) + ";")
        return "\n".join(out) + "\n"


def _literal(c: Column, kind: LogicalType) -> Column:
    """A value as SQL text."""
    stored = spark_type(kind).simpleString()
    if stored.startswith(("array", "struct", "map")):
        text = F.concat(F.lit("from_json('"), F.replace(F.replace(F.to_json(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit(f"', '{stored}')"))
    elif kind.name == "BLOB":
        text = F.concat(F.lit("X'"), F.hex(c), F.lit("'"))
    elif stored in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") or stored.startswith("decimal"):
        text = c.cast("string")
    else:
        quoted_text = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("\\'")), F.lit("'"))
        text = quoted_text if stored == "string" else F.concat(F.lit(stored.upper().replace("INTERVAL DAY TO SECOND", "") + " "), F.when(F.lit(kind.name == "INTERVAL"), c.cast("string")).otherwise(quoted_text))
    return F.coalesce(text, F.lit("NULL"))


# --- DDL ----------------------------------------------------------------


class DdlProblem(ValueError):
    pass


def create_table(name: str, types: dict[str, LogicalType]) -> str:
    lines = []
    for column, kind in types.items():
        stored = spark_type(kind).simpleString().upper() if not spark_type(kind).simpleString().startswith(("struct", "array", "map")) else spark_type(kind).simpleString()
        said = str(kind).replace("\\", "\\\\").replace("'", "\\'")
        lines.append(f"  {quoted(column)} {stored} COMMENT '{said}'")
    return f"CREATE TABLE {quoted(name)} (\n" + ",\n".join(lines) + "\n) USING parquet;"


def ddl(d: Dictionary) -> str:
    """CREATE TABLE statements of a dictionary. Typedefs are expanded in place, their expansions listed as comments; a column's comment is its canonical type. No constraints."""
    if not d.rich:
        raise DdlProblem("DDL is made for the richer format only")
    sites: dict[str, list[str]] = {}
    for where, typedefs in (("global", d.typedefs), *((t.name.value, t.typedefs) for t in d.tables)):
        for td in typedefs:
            sites.setdefault(td.name.value.lower(), []).append(where)
    if twice := {n: s for n, s in sites.items() if len(s) > 1}:
        raise DdlProblem("; ".join(f"the typedef `{n}` is defined in {', '.join(s)}" for n, s in twice.items()))
    report = Report()
    types = resolve_types(d, report)
    if report.items:
        raise DdlProblem("; ".join(p.message for p in report.items))
    out = [f"-- type {e.name} is {e.expansion}" for e in expand_typedefs(d)]
    for i, t in enumerate(d.tables):
        own = {c.name.value: types[i, j] for j, c in enumerate(t.columns) if (i, j) in types}
        out.append(create_table(t.name.value, own) if own else f"-- table {quoted(t.name.value)} skipped: no typed columns")
    return "\n".join(out) + "\n"


class Expansion:
    def __init__(self, table: str | None, name: str, body: str, expansion: str | None, error: str | None):
        self.table, self.name, self.body, self.expansion, self.error = table, name, body, expansion, error


def expand_typedefs(d: Dictionary) -> list[Expansion]:
    """What each typedef means: global ones, then each table's own, and global ones that mean something else there."""
    from ..functions.types import parse_type

    def expand(table, td, scope):
        try:
            return Expansion(table, td.name.value, td.body.value, str(parse_type(td.body.value, scope, (td.name.value.upper(),))), None)
        except TypeProblem as e:
            return Expansion(table, td.name.value, td.body.value, None, str(e))

    out = [expand(None, td, d.aliases()) for td in d.typedefs]
    known = {e.name: (e.expansion, e.error) for e in out}
    for t in d.tables:
        if t.typedefs:
            scope, hidden = d.aliases(t), {td.name.value for td in t.typedefs}
            out += [expand(t.name.value, td, scope) for td in t.typedefs]
            for td in d.typedefs:
                e = expand(t.name.value, td, scope)
                if td.name.value not in hidden and (e.expansion, e.error) != known[e.name]:
                    out.append(e)
    return out

