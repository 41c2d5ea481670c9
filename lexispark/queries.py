"""The queries of the data-dictionary engine over the driver's tables, and SQL that means the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rule_queries
from .functions.types import capacity, category, orderable, parse_type
from .functions.values import GOLDEN, STEP_1, STEP_2, mix, nth, salt_hash, unsigned_mod, with_wrapping, within_capacity
from .operators import data_checks as D
from .plans.generation import Options
from .plans.joins import Join
from .plans.model import At, Column, Dictionary, Relationship, Table, Typedef
from .plans.problems import Report
from .operators.validate import check_rich
from .plans.spec_rules import check_dictionary
from .sources.generated import Generator, ddl, expand_typedefs
from .sources.relations import Frames, describe, legacy_type, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Columns and their types of the driver's tables, as TESTDATA describes them.
TABLES = {
    "region": "r_regionkey INTEGER, r_name VARCHAR",
    "nation": "n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER",
    "customer": "c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR",
    "supplier": "s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR",
    "documents": "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding FLOAT[], label INTEGER",
    "pages": "page_id BIGINT, url VARCHAR, html VARCHAR",
    "benchmark": "item_id BIGINT, text VARCHAR",
    "labels": "doc_id BIGINT, quality INTEGER, toxic INTEGER",
    "conversations": "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR",
}
COLUMNS = {t: [tuple(c.split(" ", 1)) for c in body.split(", ")] for t, body in TABLES.items()}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


# --- D01 ------------------------------------------------------------------


@query("d01_null_counts_all_columns", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM {t}" for t, cs in COLUMNS.items() for c, _ in cs))
def _(spark, d):
    def one(t: str) -> DataFrame:
        df = read(spark, d, t)
        pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(df.columns)))
        return D.count_nulls(df, df.columns).select(F.lit(t).alias("table_name"), F.explode(pairs).alias("x")).select("table_name", "x.*")

    return reduce(DataFrame.unionByName, map(one, TABLES))


def _labelled(spark, d) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "text").join(read(spark, d, "labels"), "doc_id", "left")


@query("d01_labels_missing", "SELECT count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
def _(spark, d):
    return D.count_nulls(_labelled(spark, d), ["quality"]).select(F.col("n0").alias("n"))


@query(
    "d01_null_sample_rows",
    "SELECT row FROM (SELECT row_number() OVER (ORDER BY d.doc_id) AS row, l.quality FROM documents d LEFT JOIN (SELECT DISTINCT ON (doc_id) doc_id, quality FROM labels ORDER BY doc_id) l ON d.doc_id = l.doc_id) AS x WHERE quality IS NULL ORDER BY row LIMIT 5",
)
def _(spark, d):
    """The first rows without a label, of a table of several files in the order of doc_id."""
    labels = read(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = read(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left")
    path = shared_folder(spark)
    rows.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    return D.null_rows(spark.read.parquet(path), "quality")


# --- D02, D03 -------------------------------------------------------------


def _keys(name: str, table: str, columns: list[str]) -> None:
    by = ", ".join(columns)
    query(name, f"SELECT count(*) AS n FROM (SELECT 1 FROM {table} GROUP BY {by} HAVING count(*) > 1) AS g")(lambda spark, d: D.duplicate_keys(read(spark, d, table), columns))


def _values(name: str, table: str, column: str) -> None:
    query(name, f"SELECT count(*) AS n FROM (SELECT 1 FROM {table} WHERE {column} IS NOT NULL GROUP BY {column} HAVING count(*) > 1) AS g")(lambda spark, d: D.duplicate_values(read(spark, d, table), column))


for _name, _table, _columns in (
    ("d02_lineitem_key", "lineitem", ["l_orderkey", "l_linenumber"]), ("d02_conversations_key", "conversations", ["conv_id", "turn"]), ("d02_orders_key", "orders", ["o_orderkey"]), ("d02_customer_key", "customer", ["c_custkey"]),
):
    _keys(_name, _table, _columns)
for _name, _table, _column in (("d03_documents_text", "documents", "text"), ("d03_nation_region", "nation", "n_regionkey"), ("d03_pages_url", "pages", "url")):
    _values(_name, _table, _column)


@query("d02_null_key", "SELECT count(*) AS n FROM (SELECT 1 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality, l.toxic HAVING count(*) > 1) AS g")
def _(spark, d):
    return D.duplicate_keys(_labelled(spark, d), ["quality", "toxic"])


@query("d03_null_values", "SELECT count(*) AS n FROM (SELECT 1 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL GROUP BY l.quality HAVING count(*) > 1) AS g")
def _(spark, d):
    return D.duplicate_values(_labelled(spark, d), "quality")


# --- D04 ------------------------------------------------------------------


def _orphans(name: str, fk: str, fk_column: str, pk: str, pk_column: str) -> None:
    sql = f"SELECT count(DISTINCT f.{fk_column}) AS n FROM {fk} f WHERE f.{fk_column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {pk} p WHERE p.{pk_column} = f.{fk_column})"
    query(name, sql)(lambda spark, d: D.orphaned_values(read(spark, d, fk), fk_column, read(spark, d, pk), pk_column))


for _x in (
    ("d04_documents_labels", "documents", "doc_id", "labels", "doc_id"),
    ("d04_orders_lineitem", "orders", "o_orderkey", "lineitem", "l_orderkey"),
    ("d04_lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("d04_lineitem_part", "lineitem", "l_partkey", "part", "p_partkey"),
    ("d04_lineitem_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("d04_orders_customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("d04_customer_nation", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("d04_nation_region", "nation", "n_regionkey", "region", "r_regionkey"),
    ("d04_events_customer", "events", "user_id", "customer", "c_custkey"),
    ("d04_labels_documents", "labels", "doc_id", "documents", "doc_id"),
    ("d04_nation_self", "nation", "n_nationkey", "nation", "n_regionkey"),
):
    _orphans(*_x)


@query("d04_null_keys", "SELECT count(DISTINCT l.quality) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels p WHERE p.toxic = l.quality AND p.quality = 0)")
def _(spark, d):
    return D.orphaned_values(_labelled(spark, d), "quality", read(spark, d, "labels").where("quality = 0"), "toxic")


# --- D05 ------------------------------------------------------------------


def _cardinality(name: str, probe: str, other: str, *conjuncts: tuple[str, str, str], fast_sql: str | None = None) -> None:
    on = " AND ".join(f"p.{a} {op} o.{b}" for a, op, b in conjuncts)
    sql = fast_sql or f"SELECT count(*) AS n FROM {probe} p WHERE (SELECT count(*) FROM {other} o WHERE {on}) > 1"
    query(name, sql)(lambda spark, d: D.overmatched_rows(read(spark, d, probe), read(spark, d, other), conjuncts))


_cardinality("d05_orders_lineitem", "orders", "lineitem", ("o_orderkey", "=", "l_orderkey"))
_cardinality("d05_lineitem_orders", "lineitem", "orders", ("l_orderkey", "=", "o_orderkey"))
_cardinality("d05_documents_labels", "documents", "labels", ("doc_id", "=", "doc_id"))
_cardinality("d05_nation_self_left", "nation", "nation", ("n_regionkey", "=", "n_nationkey"))
_cardinality("d05_nation_self_right", "nation", "nation", ("n_nationkey", "=", "n_regionkey"))
_cardinality("d05_supplier_customer_mixed", "supplier", "customer", ("s_nationkey", "=", "c_nationkey"), ("s_acctbal", ">=", "c_acctbal"))
_cardinality("d05_supplier_customer_lt", "supplier", "customer", ("s_acctbal", "<", "c_acctbal"))
_cardinality("d05_supplier_customer_gt", "supplier", "customer", ("s_acctbal", ">", "c_acctbal"))
_cardinality("d05_events_orders_mixed", "events", "orders", ("user_id", "=", "o_custkey"), ("ts", ">=", "o_orderdate"))
_cardinality("d05_customer_part_range", "customer", "part", ("c_acctbal", ">=", "p_size"), ("c_acctbal", "<=", "p_retailprice"))
_cardinality("d05_supplier_part_open", "supplier", "part", ("s_acctbal", ">", "p_size"), ("s_acctbal", "<", "p_retailprice"))
_cardinality("d05_supplier_customer_two_columns", "supplier", "customer", ("s_nationkey", "=", "c_nationkey"), ("s_acctbal", ">=", "c_acctbal"), ("s_suppkey", "<=", "c_custkey"))


_cardinality("d05_two_ranges", "supplier", "customer", ("s_acctbal", ">=", "c_acctbal"), ("s_suppkey", "<=", "c_custkey"))
_cardinality("d05_two_ranges_strict", "customer", "supplier", ("c_acctbal", "<", "s_acctbal"), ("c_custkey", ">", "s_suppkey"))
_cardinality("d05_three_ranges", "supplier", "part", ("s_acctbal", ">=", "p_size"), ("s_acctbal", "<=", "p_retailprice"), ("s_suppkey", ">", "p_partkey"))
_cardinality("d05_texts", "customer", "supplier", ("c_name", ">=", "s_name"))
_NAN = {"p": ("supplier", "s_acctbal", "s_suppkey"), "o": ("customer", "c_acctbal", "c_custkey")}


def _with_nan(spark, d, side: str) -> DataFrame:
    """(x, k): amounts in hundreds, NaN where the key divides by seven and null where it divides by eleven."""
    table, x, k = _NAN[side]
    key, value = F.col(k), F.round(F.col(x) / 100)
    return read(spark, d, table).select(F.when(key % 11 == 0, F.lit(None)).when(key % 7 == 0, F.lit(float("nan"))).otherwise(value).alias("x"), key.alias("k"))


for _op, _word in (("=", "equal"), (">=", "at_least"), ("<", "below")):
    _sides = ", ".join(f"{side} AS (SELECT CASE WHEN {k} % 11 = 0 THEN NULL WHEN {k} % 7 = 0 THEN 'NaN'::DOUBLE ELSE round({x} / 100) END AS x, {k} AS k FROM {table})" for side, (table, x, k) in _NAN.items())
    query(f"d05_nan_{_word}", f"WITH {_sides} SELECT count(*) AS n FROM p WHERE (SELECT count(*) FROM o WHERE p.x {_op} o.x) > 1")(lambda spark, d, op=_op: D.overmatched_rows(_with_nan(spark, d, "p"), _with_nan(spark, d, "o"), [("x", op, "x")]))

query("d02_nan_key", f"WITH {_sides} SELECT count(*) AS n FROM (SELECT 1 FROM o GROUP BY x HAVING count(*) > 1) AS g")(lambda spark, d: D.duplicate_keys(_with_nan(spark, d, "o"), ["x"]))


# --- schemas --------------------------------------------------------------


def _rows(names: str, rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


def _described(tables) -> str:
    """The columns of tables as DuckDB describes them."""
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, column_type AS type FROM (DESCRIBE SELECT * FROM {t})" for t in tables)


@query("schema_columns", _described(TABLES))
def _(spark, d):
    found = describe(Frames({t: read(spark, d, t) for t in TABLES}))
    return spark.createDataFrame([(x.table, x.column, x.type) for x in found], "table_name string, column_name string, type string")


def _types(table: str) -> None:
    def run(spark, d):
        return spark.createDataFrame([(f.name, legacy_type(f.dataType)) for f in read(spark, d, table).schema.fields], "column_name string, type string")

    older = "CASE WHEN type LIKE '%[]' THEN 'list' WHEN type LIKE 'TIMESTAMP%' THEN 'datetime' WHEN type = 'DATE' THEN 'date' WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type IN ('VARCHAR', 'BLOB') THEN 'string' ELSE 'number' END"
    query(f"types_{table}", f"SELECT column_name, {older} AS type FROM ({_described([table])}) AS d")(run)


for _table in TABLES:
    _types(_table)


def dictionary(tables: dict[str, dict[str, tuple[str | None, tuple[str, ...]]]], relationships: list[tuple[str, str]] = ()) -> Dictionary:
    """A dictionary from Python: {table: {column: (type, constraints)}} and (cardinality, join)s."""
    return Dictionary(
        tables=[Table(At(t), [Column(At(c), At(k) if k else None, [At(x) for x in constraints]) for c, (k, constraints) in cs.items()]) for t, cs in tables.items()],
        relationships=[Relationship(At(c), At(j), Join.parse(j)) for c, j in relationships],
    )


_EXPECTED = [("orders", "o_orderkey", "BIGINT"), ("orders", "O_CUSTKEY", "INTEGER"), ("orders", "o_comment", None), ("invoices", "id", "BIGINT")]


@query(
    "m02_m03_schema_diff",
    f"""WITH expected AS ({_rows("t, c, type", _EXPECTED)}), found AS ({_described(TABLES)})
    SELECT 'M01' AS code, t AS table_name, lower(c) AS column_name FROM expected AS e JOIN found AS f ON f.table_name = e.t AND lower(f.column_name) = lower(e.c) WHERE e.type <> f.type
    UNION ALL SELECT 'M02', t, lower(c) FROM expected AS e WHERE t IN (SELECT table_name FROM found) AND NOT EXISTS (SELECT 1 FROM found AS f WHERE f.table_name = e.t AND lower(f.column_name) = lower(e.c))
    UNION ALL SELECT 'M03', table_name, lower(column_name) FROM found AS f WHERE table_name IN (SELECT t FROM expected) AND NOT EXISTS (SELECT 1 FROM expected AS e WHERE f.table_name = e.t AND lower(f.column_name) = lower(e.c))
    UNION ALL SELECT 'M06', t, NULL FROM (SELECT DISTINCT t FROM expected) AS e WHERE t NOT IN (SELECT table_name FROM found)
    UNION ALL SELECT 'M07', table_name, NULL FROM (SELECT DISTINCT table_name FROM found) AS f WHERE table_name NOT IN (SELECT t FROM expected)""",
)
def _(spark, d):
    expected = dictionary({t: {c: (k, ()) for t2, c, k in _EXPECTED if t2 == t} for t in ("orders", "invoices")})
    report = Report()
    check_rich(spark, expected, report, None, source=Frames({t: read(spark, d, t) for t in TABLES}))
    return report.to_df(spark).select("code", "table_name", F.lower("column_name").alias("column_name"))


# --- the driver's side: what is decided without data -----------------------------


def _literal(name: str, schema: str, rows: list[tuple], found: Callable[[], list[tuple]]) -> None:
    """A query of what the driver computes, against what it must be."""
    query(name, _rows(", ".join(c.split()[0] for c in schema.split(", ")), rows))(lambda spark, d: spark.createDataFrame(found(), schema))


_TYPES = [
    ("int4", "INTEGER", "numeric", 1 << 31, 1), ("NUMERIC", "DECIMAL(18,3)", "numeric", 10**15, 1), ("real[3]", "FLOAT[3]", "other", 1 << 24, 0), ("text[]", "VARCHAR[]", "other", None, 0), ("timestamptz", "TIMESTAMP WITH TIME ZONE", "timestamptz", 250_000_000_000, 1),
    ("datetime", "TIMESTAMP", "timestamp", 250_000_000_000, 1), ("bool", "BOOLEAN", "boolean", 2, 0), ("ENUM('b','a')", "ENUM('b', 'a')", "enum", 2, 0), ("STRUCT(a TINYINT, b DATE)", "STRUCT(a TINYINT, b DATE)", "other", 128, 0),
    ("MAP(VARCHAR, UTINYINT)", "MAP(VARCHAR, UTINYINT)", "other", 256, 0), ("UNION(n SMALLINT, s VARCHAR)", "UNION(n SMALLINT, s VARCHAR)", "other", 1 << 15, 0), ("uuid", "UUID", "other", 1 << 48, 0), ("TIMESTAMP_NS", "TIMESTAMP_NS", "timestamp", 0, 0),
]


def _type_rows() -> list[tuple]:
    kinds = [(text, parse_type(text)) for text, *_ in _TYPES]
    return [(text, str(k), category(k), capacity(k) if capacity(k) < 1 << 63 else None, int(orderable(k))) for text, k in kinds]


_CANONICAL = " UNION ALL ".join(f"SELECT '{text.replace(chr(39), chr(39) * 2)}' AS text, typeof(CAST(NULL AS {text})) AS canonical" for text, *_ in _TYPES)
_BITS = "CASE k WHEN 'TINYINT' THEN 7 WHEN 'SMALLINT' THEN 15 WHEN 'INTEGER' THEN 31 WHEN 'UTINYINT' THEN 8 WHEN 'FLOAT' THEN 24 WHEN 'BOOLEAN' THEN 1 WHEN 'UUID' THEN 48 END"
query(
    "type_language",
    f"""WITH told AS ({_CANONICAL}), parts AS (
        SELECT text, canonical, canonical LIKE '%]' OR regexp_matches(canonical, '^(STRUCT|MAP|UNION)') AS nested,
            list_transform(CASE WHEN canonical LIKE '%]' THEN [regexp_replace(canonical, '\\[\\d*\\]$', '')] WHEN canonical LIKE 'UNION%' THEN [regexp_extract(canonical, '\\w+ (\\w+)', 1)] WHEN canonical LIKE 'STRUCT%' THEN regexp_extract_all(canonical, '\\w+ (\\w+)', 1) WHEN canonical LIKE 'MAP%' THEN regexp_extract_all(substr(canonical, 4), '\\w+') ELSE [canonical] END, lambda x: x) AS kinds FROM told
    ), sizes AS (
        SELECT text, min(CASE WHEN k LIKE 'DECIMAL%' THEN CAST(power(10, CAST(regexp_extract(k, '(\\d+),', 1) AS INTEGER) - CAST(regexp_extract(k, ',(\\d+)', 1) AS INTEGER)) AS BIGINT) WHEN k LIKE 'ENUM%' THEN len(string_split(k, ',')) WHEN k IN ('TIMESTAMP', 'TIMESTAMP WITH TIME ZONE') THEN 250000000000 WHEN k = 'TIMESTAMP_NS' THEN 0 WHEN k = 'DATE' THEN 2890000 ELSE CAST(power(2, {_BITS}) AS BIGINT) END) AS capacity
        FROM (SELECT text, unnest(kinds) AS k FROM parts) AS u GROUP BY text
    )
    SELECT p.text, canonical, CASE WHEN nested THEN 'other' WHEN canonical LIKE 'ENUM%' THEN 'enum' WHEN canonical LIKE '%ZONE' THEN 'timestamptz' WHEN canonical LIKE 'TIMESTAMP%' THEN 'timestamp' WHEN canonical IN ('BOOLEAN', 'DATE') THEN lower(canonical) WHEN canonical IN ('UUID', 'VARCHAR') THEN 'other' ELSE 'numeric' END AS category,
        capacity, CAST(NOT nested AND (canonical LIKE 'DECIMAL%' OR canonical IN ('INTEGER', 'TIMESTAMP', 'TIMESTAMP WITH TIME ZONE')) AS BIGINT) AS orderable
    FROM parts AS p JOIN sizes AS s ON s.text = p.text""",
)(lambda spark, d: spark.createDataFrame(_type_rows(), "text string, canonical string, category string, capacity bigint, orderable bigint"))


def _scoped() -> Dictionary:
    d = dictionary({"plain": {"x": ("list", ())}, "own": {"x": ("list", ())}})
    d.typedefs = [Typedef(At("base"), At("INTEGER")), Typedef(At("list"), At("base[]")), Typedef(At("round"), At("round"))]
    d.tables[1].typedefs = [Typedef(At("base"), At("VARCHAR"))]
    return d


_literal("typedef_expansion", "table_name string, name string, expansion string", [(None, "base", "INTEGER"), (None, "list", "INTEGER[]"), (None, "round", None), ("own", "base", "VARCHAR"), ("own", "list", "VARCHAR[]")], lambda: [(e.table, e.name, e.expansion) for e in expand_typedefs(_scoped())])
_JOIN = "e.date >= p.start AND p.stop >= e.date AND e.cal == p.cal"
_PIECES = r"""SELECT row_number() OVER () AS i, regexp_extract(piece, '(\w+\.\w+) *(==|>=|<=|=|>|<) *(\w+\.\w+)', 1) AS l, replace(regexp_extract(piece, '(==|>=|<=|=|>|<)', 1), '==', '=') AS op, regexp_extract(piece, '(\w+\.\w+) *(==|>=|<=|=|>|<) *(\w+\.\w+)', 3) AS r FROM (SELECT unnest(string_split({join}, ' AND ')) AS piece) AS u"""
_MIRROR = "CASE op WHEN '>' THEN '<' WHEN '<' THEN '>' WHEN '>=' THEN '<=' WHEN '<=' THEN '>=' ELSE op END"
query(
    "join_orientation",
    f"""WITH pieces AS ({_PIECES.format(join=repr(_JOIN))}), head AS (SELECT split_part(arg_min(l, i), '.', 1) AS t FROM pieces), turned AS (
        SELECT CASE WHEN split_part(l, '.', 1) = t THEN l ELSE r END AS l, CASE WHEN split_part(l, '.', 1) = t THEN op ELSE {_MIRROR} END AS op, CASE WHEN split_part(l, '.', 1) = t THEN r ELSE l END AS r FROM pieces, head
    ) SELECT CAST(1 AS BIGINT) AS probe_left, l AS probe, op, r AS other FROM turned UNION ALL SELECT 0, r, {_MIRROR}, l FROM turned""",
)(lambda spark, d: spark.createDataFrame([(int(left), f"{c.left.table}.{c.left.column}", c.op, f"{c.right.table}.{c.right.column}") for left in (True, False) for c in Join.parse(_JOIN).oriented(left)], "probe_left bigint, probe string, op string, other string"))


@query(
    "fk_targets",
    f"""WITH keys AS (SELECT 'customer.c_custkey' AS k UNION ALL SELECT 'orders.o_orderkey' UNION ALL SELECT 'lineitem.l_orderkey' UNION ALL SELECT 'lineitem.l_linenumber'), pieces AS (
        {_PIECES.format(join="'orders.o_custkey = customer.c_custkey'")} UNION ALL {_PIECES.format(join="'orders.o_orderkey = lineitem.l_orderkey'")}
    ), ways AS (SELECT l, r FROM pieces WHERE op = '=' UNION ALL SELECT r, l FROM pieces WHERE op = '=')
    SELECT l AS column_name, r AS target FROM ways WHERE r IN (SELECT k FROM keys) AND l IN ('orders.o_custkey', 'orders.o_orderkey')""",
)
def _(spark, d):
    return spark.createDataFrame([(f"orders.{c}", f"{t.table}.{t.column}") for c in ("o_custkey", "o_orderkey") for t in report_dictionary().foreign_key_targets("orders", c)], "column_name string, target string")


_literal("generation_plan", "place bigint, table_name string, column_name string, role string, nullable bigint", [
    (0, "customers", "id", "Indexed", 0), (0, "customers", "email", "Indexed", 1), (0, "customers", "score", "Plain", 0), (0, "customers", "note", "Plain", 1), (1, "orders", "id", "Indexed", 0), (1, "orders", "customer_id", "Draw", 0), (1, "orders", "amount", "Plain", 1), (2, "profiles", "id", "Indexed", 0), (2, "profiles", "customer_id", "Draw", 0),
    (3, "windows", "id", "Indexed", 0), (3, "windows", "lo", "Bound", 0), (3, "windows", "hi", "Bound", 0), (4, "hits", "id", "Indexed", 0), (4, "hits", "at", "Probe", 0), (4, "hits", "window_id", "Copy", 0),
], lambda: [(i, t.table, c.column, type(c.role).__name__, int(c.nullable)) for i, t in enumerate(generator().plan.tables) for c in t.columns])


def _rule_rows() -> list[tuple]:
    d = dictionary({"a": {"id": ("BIGINT", ()), "ID": ("BIGINT", ())}, "b": {"ref": ("BIGINT", ("foreign_key",)), "": (None, ())}}, [("many-to-one", "b.ref = a.id"), ("one-to-one", "b.nothing = c.id")])
    report = Report()
    check_dictionary(d, report)
    return [(p.code, p.severity) for p in report.items]


_literal("spec_rules", "code string, severity string", [("S03", "error"), ("S02", "error"), ("S06", "error"), ("S10", "error"), ("S01", "error"), ("S11", "error")], _rule_rows)
_literal("ddl_tables", "statement string", [("CREATE TABLE `t` (\n  `id` BIGINT COMMENT 'BIGINT',\n  `kind` STRING COMMENT 'ENUM(\\'x\\')',\n  `tags` array<string> COMMENT 'VARCHAR[]'\n) USING parquet;\n-- table `u` skipped: no typed columns\n",)], lambda: [(ddl(dictionary({"t": {"id": ("BIGINT", ()), "kind": ("ENUM('x')", ()), "tags": ("TEXT[]", ())}, "u": {"x": (None, ())}})),)])


# --- generated values -----------------------------------------------------

ROWS = 1000


def _nth(name: str, type_text: str, sql: str, rows: int = ROWS) -> None:
    def run(spark, d):
        return spark.range(rows).select(F.col("id").alias("i"), nth(parse_type(type_text), F.col("id")).alias("v"))

    query(name, f"SELECT i, {sql} AS v FROM range({rows}) AS r(i)")(run)


for _name, _type, _sql, _n in (
    ("nth_boolean", "BOOLEAN", "i = 1", 2),
    ("nth_int", "INTEGER", "CAST(i AS INTEGER)", ROWS),
    ("nth_double", "DOUBLE", "CAST(i AS DOUBLE)", ROWS),
    ("nth_varchar", "VARCHAR", "'v' || lpad(CAST(i AS VARCHAR), 20, '0')", ROWS),
    ("nth_date", "DATE", "DATE '2000-01-01' + CAST(i AS INTEGER)", ROWS),
    ("nth_time", "TIME", "lpad(CAST(i // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(i % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(i % 60 AS VARCHAR), 2, '0')", 86_400),
    ("nth_timestamp", "TIMESTAMP", "TIMESTAMP '2000-01-01 00:00:00' + to_seconds(i)", ROWS),
    ("nth_decimal", "DECIMAL(12,2)", "CAST(i AS DECIMAL(12,2))", ROWS),
    ("nth_bit", "BIT", "lpad(bin(i), 64, '0')", ROWS),
    ("nth_enum", "ENUM('a','b','c')", "CASE i WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END", 3),
    ("nth_list", "VARCHAR[]", "['v' || lpad(CAST(i AS VARCHAR), 20, '0')]", ROWS),
    ("nth_array", "INTEGER[3]", "[CAST(i AS INTEGER), 0, 0]", ROWS),
    ("nth_struct", "STRUCT(a INTEGER, b VARCHAR)", "{'a': CAST(i AS INTEGER), 'b': 'v' || lpad(CAST(i AS VARCHAR), 20, '0')}", ROWS),
    ("nth_uuid", "UUID", "'00000000-0000-4000-8000-' || lpad(lower(hex(i)), 12, '0')", ROWS),
    ("nth_json", "JSON", "'{\"i\":' || CAST(i AS VARCHAR) || '}'", ROWS),
    ("nth_geometry", "GEOMETRY", "'POINT (' || CAST(i AS VARCHAR) || ' 0)'", ROWS),
):
    _nth(_name, _type, _sql, _n)



def _nth_parts(name: str, type_text: str, parts: dict[str, tuple[str, str]], rows: int = ROWS) -> None:
    """Like _nth(), by parts of the value: {column: (Spark expression of v, DuckDB expression of i)}."""

    def run(spark, d):
        return spark.range(rows).select(F.col("id").alias("i"), nth(parse_type(type_text), F.col("id")).alias("v")).selectExpr("i", *(f"{mine} AS {c}" for c, (mine, _) in parts.items()))

    query(name, f"SELECT i, {', '.join(f'{sql} AS {c}' for c, (_, sql) in parts.items())} FROM range({rows}) AS r(i)")(run)


_TEXT_SQL = "'v' || lpad(CAST(i AS VARCHAR), 20, '0')"
_nth_parts("nth_blob", "BLOB", {"v": ("lower(hex(v))", "lpad(lower(hex(i)), 16, '0')"), "n": ("octet_length(v)", "CAST(8 AS INTEGER)")})
_nth_parts("nth_timestamptz", "TIMESTAMPTZ", {"v": ("unix_seconds(v)", "CAST(epoch(TIMESTAMP '2000-01-01 00:00:00' + to_seconds(i)) AS BIGINT)")})
_nth_parts("nth_interval", "INTERVAL", {"v": ("unix_seconds(timestamp_seconds(0) + v)", "CAST(epoch(to_seconds(i)) AS BIGINT)")})
_nth_parts("nth_map", "MAP(VARCHAR, INTEGER)", {"k": ("map_keys(v)[0]", _TEXT_SQL), "v": ("map_values(v)[0]", "CAST(i AS INTEGER)"), "n": ("size(v)", "1")})
_nth_parts("nth_union", "UNION(n SMALLINT, s VARCHAR)", {"tag": ("v.tag", "'n'"), "n": ("v.n", "CAST(i AS SMALLINT)"), "s": ("v.s", "CAST(NULL AS VARCHAR)")})
for _name, _type, _sql in (("bigint", "BIGINT", "i"), ("smallint", "SMALLINT", "CAST(i AS SMALLINT)"), ("utinyint", "UTINYINT", "CAST(i AS SMALLINT)"), ("usmallint", "USMALLINT", "CAST(i AS INTEGER)"), ("uinteger", "UINTEGER", "i"), ("float", "FLOAT", "CAST(i AS FLOAT)")):
    _nth(f"nth_{_name}", _type, _sql, 256 if _type == "UTINYINT" else ROWS)
_CAPACITIES = {"BOOLEAN": 2, "TINYINT": 128, "ENUM('a','b','c')": 3, "TIME": 24 * 60 * 60, "DECIMAL(5,2)": 10**3, "STRUCT(a TINYINT, b BOOLEAN)": 2, "MAP(TINYINT, DATE)": 128, "TIMESTAMP_S": 0}


@query("nth_refusals", " UNION ALL ".join(f"SELECT '{t.replace(chr(39), chr(39) * 2)}' AS type, i, i >= {n} AS refused FROM (SELECT unnest([0, 1, 2, 3, 127, 128, 999, 1000, 86399, 86400]) AS i) AS r" for t, n in _CAPACITIES.items()))
def _(spark, d):
    places = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 127, 128, 999, 1000, 86399, 86400)], "i int")
    return reduce(DataFrame.unionByName, (places.select(F.lit(t).alias("type"), "i", (~within_capacity(parse_type(t), F.col("i").cast("long"))).alias("refused")) for t in _CAPACITIES))


_W = "18446744073709551616"


def _mul64(a: str, b: int) -> str:
    """a times a constant, modulo 2^64, in 128-bit unsigned arithmetic: the constant's high half meets the low half of a only."""
    hi, lo = b >> 32, b & 0xFFFFFFFF
    u = lambda x: f"CAST('{x}' AS UHUGEINT)"
    return f"(({a} * {u(lo)}) % {u(_W)} + ((({a} * {u(hi)}) % {u(1 << 32)}) * {u(1 << 32)})) % {u(_W)}"


def mix_sql(seed: int, salt: str, rows: int = ROWS, i: str = "i") -> str:
    """Rows (i, h): the hash as an unsigned 128-bit number below 2^64."""
    u = lambda x: f"CAST('{x}' AS UHUGEINT)"
    start = salt_hash(salt) ^ (seed * GOLDEN % (1 << 64))
    z1 = f"SELECT i, xor({u(start)}, (CAST({i} AS UHUGEINT) + {u(GOLDEN)}) % {u(_W)}) AS z FROM range({rows}) AS r(i)"
    z2 = f"SELECT i, xor(z, z // {u(1 << 30)}) AS z FROM ({z1}) AS a"
    z3 = f"SELECT i, {_mul64('z', STEP_1)} AS z FROM ({z2}) AS b"
    z4 = f"SELECT i, xor(z, z // {u(1 << 27)}) AS z FROM ({z3}) AS c"
    z5 = f"SELECT i, {_mul64('z', STEP_2)} AS z FROM ({z4}) AS d"
    return f"SELECT i, xor(z, z // {u(1 << 31)}) AS h FROM ({z5}) AS e"


@query("mix_hash", f"SELECT i, CAST(h % 1000003 AS BIGINT) AS h, CAST(h % CAST('18446744073709551615' AS UHUGEINT) AS VARCHAR) AS whole FROM ({mix_sql(7, 'fill:t.c')}) AS m")
def _(spark, d):
    def build():
        h = mix(7, "fill:t.c", F.col("id"))
        return spark.range(ROWS).select(F.col("id").alias("i"), unsigned_mod(h, 1000003).cast("bigint").alias("h"), unsigned_mod(h, (1 << 64) - 1).cast("string").alias("whole"))

    return with_wrapping(spark, lambda: _analysed(build()))


def _analysed(df: DataFrame) -> DataFrame:
    df.schema
    return df


def generated_dictionary() -> Dictionary:
    return dictionary(
        {
            "customers": {"id": ("INTEGER", ("primary_key",)), "email": ("VARCHAR", ("unique",)), "score": ("DECIMAL(6,2)", ("required",)), "note": ("VARCHAR", ())},
            "orders": {"id": ("BIGINT", ("primary_key",)), "customer_id": ("INTEGER", ("foreign_key", "required")), "amount": ("BIGINT", ())},
            "profiles": {"id": ("BIGINT", ("primary_key",)), "customer_id": ("INTEGER", ("foreign_key", "unique", "required"))},
            "windows": {"id": ("BIGINT", ("primary_key",)), "lo": ("BIGINT", ("unique",)), "hi": ("BIGINT", ())},
            "hits": {"id": ("BIGINT", ("primary_key",)), "at": ("BIGINT", ()), "window_id": ("BIGINT", ())},
        },
        [("many-to-one", "orders.customer_id = customers.id"), ("one-to-one", "profiles.customer_id = customers.id"), ("many-to-one", "hits.at >= windows.lo AND hits.at <= windows.hi AND hits.window_id = windows.id")],
    )


GENERATED = {"customers": 300, "orders": ROWS, "profiles": 200, "windows": 50, "hits": ROWS}


def generator() -> Generator:
    return Generator(generated_dictionary(), Options(rows=10, table_rows=GENERATED, seed=3, null_fraction=0.25))


def _generated(name: str, table: str, columns: list[str], sql: str) -> None:
    query(name, sql)(lambda spark, d: generator().table(spark, table).select(*columns))


_generated("gen_fk_draw", "orders", ["id", "customer_id"], f"SELECT i AS id, CAST(h % 300 AS INTEGER) AS customer_id FROM ({mix_sql(3, 'fk:orders.customer_id')}) AS m")
_generated("gen_fk_injective", "profiles", ["id", "customer_id"], "SELECT i AS id, CAST(i AS INTEGER) AS customer_id FROM range(200) AS r(i)")
_generated("gen_plain_fill", "customers", ["id", "score"], f"SELECT CAST(i AS INTEGER) AS id, CAST(h % 10000 AS DECIMAL(6,2)) AS score FROM ({mix_sql(3, 'fill:customers.score', 300)}) AS m")
_generated("gen_range_bounds", "windows", ["id", "lo", "hi"], "SELECT i AS id, 3 * i AS lo, 3 * i + 2 AS hi FROM range(50) AS r(i)")
_generated("gen_range_slots", "hits", ["id", "at"], f"SELECT i AS id, 3 * CAST(h % 50 AS BIGINT) + 1 AS at FROM ({mix_sql(3, 'range:2')}) AS m")
_generated("gen_slot_eq_copy", "hits", ["id", "window_id"], f"SELECT i AS id, CAST(h % 50 AS BIGINT) AS window_id FROM ({mix_sql(3, 'range:2')}) AS m")
_generated(
    "gen_null_fraction", "orders", ["id", "amount"],
    f"SELECT f.i AS id, CASE WHEN CAST(n.h AS DOUBLE) < 0.25 * 18446744073709551615.0 THEN NULL ELSE CAST(f.h % CAST('9223372036854775808' AS UHUGEINT) AS BIGINT) END AS amount FROM ({mix_sql(3, 'fill:orders.amount')}) AS f JOIN ({mix_sql(3, 'null:orders.amount')}) AS n ON f.i = n.i",
)


_CLEAN_SQL = f"""WITH customers AS (SELECT i AS id FROM range(300) AS r(i)), orders AS (SELECT i AS id, h % 300 AS customer_id FROM ({mix_sql(3, 'fk:orders.customer_id')}) AS m), windows AS (SELECT i AS id, 3 * i AS lo, 3 * i + 2 AS hi FROM range(50) AS r(i)),
    hits AS (SELECT i AS id, 3 * (h % 50) + 1 AS at, h % 50 AS window_id FROM ({mix_sql(3, 'range:2')}) AS m), counted AS (
    SELECT count(*) - count(DISTINCT id) AS n FROM orders UNION ALL SELECT count(*) - count(DISTINCT lo) FROM windows UNION ALL SELECT count(*) FROM orders WHERE customer_id NOT IN (SELECT id FROM customers)
    UNION ALL SELECT count(*) FROM hits AS x WHERE (SELECT count(*) FROM windows AS w WHERE x.at >= w.lo AND x.at <= w.hi AND x.window_id = w.id) > 1)
    SELECT CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS problems FROM counted"""


@query("gen_validates_clean", _CLEAN_SQL)
def _(spark, d):
    """The validator is the generator's oracle."""
    report = Report()
    check_rich(spark, generated_dictionary(), report, None, source=Frames(generator().tables(spark)), data=True)
    return spark.createDataFrame([(len(report.items),)], "problems bigint")


# --- the report -----------------------------------------------------------


def report_dictionary() -> Dictionary:
    return dictionary(
        {
            "customer": {"c_custkey": ("BIGINT", ("primary_key",)), "c_name": ("VARCHAR", ("unique",)), "c_nationkey": ("INTEGER", ("required",)), "c_acctbal": ("DOUBLE", ()), "c_mktsegment": ("VARCHAR", ())},
            "orders": {"o_orderkey": ("BIGINT", ("primary_key", "foreign_key")), "o_custkey": ("BIGINT", ("foreign_key", "required")), "o_orderstatus": ("VARCHAR", ("unique",)), "o_totalprice": ("DOUBLE", ()), "o_orderdate": ("TIMESTAMP", ()), "o_orderpriority": ("VARCHAR", ())},
            "lineitem": {"l_orderkey": ("BIGINT", ("primary_key",)), "l_linenumber": ("INTEGER", ("primary_key",))} | {c: (k, ()) for c, k in COLUMNS["lineitem"] if c not in ("l_orderkey", "l_linenumber")},
        },
        [("many-to-one", "orders.o_custkey = customer.c_custkey"), ("one-to-one", "orders.o_orderkey = lineitem.l_orderkey")],
    )


_REPORT_SQL = f"""
SELECT 'D02' AS code, 'error' AS severity, 'lineitem' AS table_name, CAST(NULL AS VARCHAR) AS column_name, n AS count FROM ({ORACLE['d02_lineitem_key']}) AS a
UNION ALL SELECT 'D03', 'error', 'orders', 'o_orderstatus', n FROM (SELECT count(*) AS n FROM (SELECT 1 FROM orders GROUP BY o_orderstatus HAVING count(*) > 1) AS g) AS b
UNION ALL SELECT 'D04', 'error', 'orders', 'o_orderkey', n FROM ({ORACLE['d04_orders_lineitem']}) AS c
UNION ALL SELECT 'D05', 'error', 'orders', NULL, n FROM ({ORACLE['d05_orders_lineitem']}) AS d
"""


@query("problem_report", f"SELECT * FROM ({_REPORT_SQL}) AS r WHERE count > 0")
def problem_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three levels over three tables; the result is the report as rows."""
    report = Report()
    check_rich(spark, report_dictionary(), report, None, source=Frames({t: read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem")}), data=True)
    return report.to_df(spark).select("code", "severity", "table_name", "column_name", "count")



QUERIES |= rule_queries.QUERIES
ORACLE |= rule_queries.ORACLE
