"""Queries of the rules: small dictionaries are checked here, and SQL works the same answers out from their content as rows."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators.validate import check_rich
from .plans.problems import Report
from .plans.spec_rules import check_document
from .sources.relations import Frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def col(name, *constraints, **more) -> dict:
    return {"name": name} | ({"constraints": list(constraints)} if constraints else {}) | more


def rich(tables: dict[str, list[dict]], *relationships: tuple, **more) -> dict:
    """A document of the richer format: tables, (cardinality, join, conflicts…) and other keys."""
    related = [{"cardinality": c, "join": j} | ({"conflicts": list(x)} if x else {}) for c, j, *x in relationships]
    return {"$version": "0.2.0", "$learn_more": "x", "tables": [{"name": t, "columns": cs} for t, cs in tables.items()], "relationships": related} | more


def old(*columns: dict, **more) -> dict:
    return {"$version": "0.1.0", "$learn_more": "x", "tables": [{"name": "t", "columns": list(columns)}]} | more


PK, FK, UQ = "primary_key", "foreign_key", "unique"
_AB = {"a": [col("id", PK), col("x"), col("u", UQ)], "b": [col("id", PK), col("a_id", FK), col("x"), col("y")]}
_GOOD = ("many-to-one", "b.a_id = a.id")
CASES: dict[str, dict] = {
    "clean": rich(_AB, _GOOD),
    "key_without_target": rich(_AB),
    "key_to_no_primary": rich(_AB, ("many-to-one", "b.a_id = a.u")),
    "key_by_range": rich(_AB, ("many-to-one", "b.a_id >= a.id AND b.x = a.x")),
    "key_written_backwards": rich(_AB, ("one-to-many", "a.id == b.a_id")),
    "unknown_table": rich(_AB, _GOOD, ("many-to-one", "b.x = c.id and B.y = a.id")),
    "unknown_column": rich(_AB, _GOOD, ("many-to-one", "b.nothing = a.id AND b.x = a.none")),
    "broken_join": rich(_AB, _GOOD, ("many-to-one", "b.x = "), ("many-to-one", "b.x a.id"), ("many-to-one", "b.x = a.id OR b.y = a.id"), ("many-to-one", "b.x = 3")),
    "three_tables": rich(_AB | {"c": [col("id", PK)]}, _GOOD, ("many-to-one", "b.x = a.id AND b.y = c.id")),
    "conflicts": rich(_AB, (*_GOOD, "x", "y", "u", "id")),
    "no_unique_side": rich(_AB, _GOOD, ("many-to-one", "b.x = a.x"), ("one-to-one", "a.x = b.x"), ("one-to-many", "a.u = b.y"), ("one-to-one", "b.y = a.id"), ("many-to-one", "b.x >= a.x"), ("many-to-one", "b.x = a.x AND b.y = a.u")),
    "self_join": rich({"s": [col("id", PK), col("boss", FK)]}, ("many-to-one", "s.boss = s.id"), ("many-to-one", "s.id = s.boss")),
    "same_columns": rich({"a": [col("x"), col("X"), col("y"), col("y"), col("y")], "A": [col("x")], "b": [col("z")]}),
    "same_columns_old": old(col("x"), col("X"), col("y"), col("y")),
    "empty_names": rich({"": [col("x"), col("")], "b": [col(""), col("")]}),
    "zones": rich({"a": [col("p", time_zone="UTC"), col("q", time_zone="naive"), col("r", time_zone="Europe/Berlin"), col("s", time_zone="Berlin"), col("t", time_zone="Mars/Base"), col("u", time_zone="Europe/"), col("v", time_zone="Etc/GMT+3"), col("w", time_zone="America/Argentina/Ushuaia"), col("z", time_zone="utc")], "b": [col("x")]}),
    "one_table_described": rich({"a": [col("x")]}) | {"tables": [{"name": "a", "columns": [col("x")], "description": "d", "details": "e"}]},
    "two_tables_described": rich({}) | {"tables": [{"name": "a", "columns": [col("x")], "description": "d"}, {"name": "b", "columns": [col("x")], "details": "d"}]},
    "nothing_to_learn": {k: v for k, v in rich(_AB, _GOOD).items() if k != "$learn_more"},
    **{f"version_{i}": rich(_AB, _GOOD, version=v) for i, v in enumerate(({"number": "1.2.3"}, {"number": "1.2"}, {"number": "1.2.3-rc.1+b5"}, {"number": "1.2.3-"}, {"date": "2024-02-29"}, {"date": "2023-02-29"}, {"date": "2024-2-3"}, {"hash": "abc"}, {}, {"hash": "a", "date": "2024-01-01"}))},
    "typedef_names": rich(_AB, _GOOD, typedef={"money": "DECIMAL(9,2)", "1": "INTEGER", "true": "INTEGER", "null": "INTEGER", "1.5": "INTEGER", "x1": "money"}),
    "extensions": rich(_AB, _GOOD, duckdb={"extensions": ["json", "spatial", "json", "Icu", "a-b", "", "json", "warp"]}),
    "old_described": old(
        col("a", type="enum", values=["p"]), col("b", type="enum", examples=["p"]), col("c", type="boolean", examples=["true"]), col("d", type="number(quantity)", range=[1, 2]), col("e", type="number(ordinal)"), col("f", type="string", examples=["x"], values=["y"]),
        col("g", type="number", range=[1, 2]), col("h", type="date", range=["2024-01-01", "2024-02-01"]), col("i"), col("j", values=["q"]), col("k", type="boolean"),
    ),
    "old_units": old(col("a", type="number(quantity)", range=[1, 2], units="kg"), col("b", type="number", examples=[1], units="kg"), col("c", units="kg"), col("d", type="string", examples=["x"])),
    "old_zones": old(col("a", type="datetime", range=["2024-01-01T00:00:00", "2024-01-02T00:00:00"], time_zone="UTC"), col("b", type="date", range=["2024-01-01", "2024-01-02"], time_zone="UTC"), col("c", time_zone="UTC")),
    "old_values": old(
        col("a", type="number(quantity)", range=["low", 2]), col("b", type="date", range=["2024-01-01", "2024-13-01"]), col("c", type="date", range=["2024-01-01", ".inf"]), col("d", type="number", examples=[1, "x", True]), col("e", type="string", examples=["x", 1, ["y"]]),
        col("f", type="number(ordinal)", range=["-.inf", ".inf"]), col("g", type="datetime", range=["2024-01-01T00:00:00Z", "2024-01-01T00:00:00"]), col("h", type="datetime", range=["2024-01-01T00:00:00", "2024-01-02"], time_zone="UTC"),
    ),
    "old_order": old(
        col("a", type="number(quantity)", range=[2, 1]), col("b", type="number(ordinal)", range=[1, 1]), col("c", type="date", range=["2024-02-01", "2024-01-01"]), col("d", type="number(quantity)", range=[".inf", 1]), col("e", type="number(quantity)", range=[1, "-.inf"]),
        col("f", type="number(quantity)", range=["-.inf", 1]), col("g", type="date", range=[".inf", "2024-01-01"]), col("h", type="date", range=["-.inf", ".inf"]), col("i", type="number(quantity)", range=["x", 1]),
    ),
    "typed": rich(
        {
            "t": [
                col("a", type="BOOLEAN", values=["x"], range=[1, 2], examples=["y"]), col("b", type="VARCHAR", range=["a", "b"], units="kg", time_zone="UTC"), col("c", type="int4", range=[5, 1], units="kg"), col("d", type="money", range=["x", 2]),
                col("e", type="DATE", range=["2024-02-01", "2024-01-01"], time_zone="UTC"), col("f", type="TIMESTAMP", time_zone="UTC", units="s"), col("g", type="NOPE"), col("h", type="broken"), col("i", type="round"), col("j", type="DOUBLE", range=["-.inf", ".inf"]), col("k", type="STRUCT(a)"), col("l", type="ENUM('a')", range=[1, 2]),
            ],
            "u": [col("x", type="DATE", range=["2024-01-01", 3])],
        },
        typedef={"money": "DECIMAL(9,2)", "broken": "NOPE", "round": "round"}, duckdb={"extensions": ["json", "warp"]},
    ),
}


def _problems(spark: SparkSession, document: dict) -> Report:
    """All problems of a dictionary by itself; where no error stops it, those of its types and descriptions too."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "dict.yaml")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(document, f)  # JSON is YAML
        report, d = check_document(path)
    if d is not None and d.rich:
        check_rich(spark, d, report, None, source=Frames({}))
    return report


# --- a dictionary's content as rows ---------------------------------------------


def _cell(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _table(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression; a row without a case comes first, so that no table is empty and every column has its type."""
    kinds = [c.split() for c in columns.split(", ")]
    first = "(" + ", ".join(f"CAST(NULL AS {k})" for _, k in kinds) + ")"
    return f"{name}({', '.join(c for c, _ in kinds)}) AS (SELECT * FROM (VALUES {', '.join([first, *('(' + ', '.join(map(_cell, r)) + ')' for r in rows)])}) AS v WHERE col0 IS NOT NULL)"


def _kind(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    return "number" if isinstance(v, int | float) or v in (".inf", "-.inf") else "string" if isinstance(v, str) else "list"


def facts() -> str:
    """WITH … of all cases: what their documents say, and joins taken apart by regular expressions."""
    tabs, cols, cons, rels, confl, exts, defs, tops, items = ([] for _ in range(9))
    for cs, d in CASES.items():
        tops += [(cs, k, None) for k in d if not isinstance(d[k], list | dict)] + [(cs, f"version.{k}", v) for k, v in d.get("version", {}).items()] + [(cs, "version", None)] * ("version" in d)
        defs += [(cs, k, v) for k, v in d.get("typedef", {}).items()]
        exts += [(cs, i, e) for i, e in enumerate(d.get("duckdb", {}).get("extensions", ()))]
        for i, r in enumerate(d.get("relationships", ())):
            rels.append((cs, i, r["cardinality"], r["join"]))
            confl += [(cs, i, j, c) for j, c in enumerate(r.get("conflicts", ()))]
        for i, t in enumerate(d["tables"]):
            tabs.append((cs, int(d["$version"] == "0.2.0"), i, t["name"], int("description" in t), int("details" in t)))
            for j, c in enumerate(t["columns"]):
                cols.append((cs, i, t["name"], j, c["name"], c.get("type"), c.get("units"), c.get("time_zone")))
                cons += [(cs, t["name"], c["name"], x) for x in c.get("constraints", ())]
                items += [(cs, i, j, key, n, _kind(v), str(v)) for key in ("values", "range", "examples") for n, v in enumerate(c.get(key, ()))]
    given = [
        _table("tabs", "cs VARCHAR, rich INTEGER, ti INTEGER, t VARCHAR, described INTEGER, detailed INTEGER", tabs),
        _table("cols", "cs VARCHAR, ti INTEGER, t VARCHAR, ci INTEGER, c VARCHAR, type VARCHAR, units VARCHAR, zone VARCHAR", cols),
        _table("cons", "cs VARCHAR, t VARCHAR, c VARCHAR, what VARCHAR", cons),
        _table("rels", "cs VARCHAR, r INTEGER, cardinality VARCHAR, j VARCHAR", rels),
        _table("confl", "cs VARCHAR, r INTEGER, i INTEGER, c VARCHAR", confl),
        _table("exts", "cs VARCHAR, i INTEGER, e VARCHAR", exts),
        _table("defs", "cs VARCHAR, name VARCHAR, body VARCHAR", defs),
        _table("tops", "cs VARCHAR, k VARCHAR, v VARCHAR", tops),
        _table("items", "cs VARCHAR, ti INTEGER, ci INTEGER, k VARCHAR, i INTEGER, kind VARCHAR, v VARCHAR", items),
    ]
    part = r"^\s*([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*(==|>=|<=|=|>|<)\s*([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*$"
    derived = rf"""
        pieces AS (SELECT cs, r, unnest(string_split_regex(j, '(?i)\s+and\s+')) AS piece, unnest(range(len(string_split_regex(j, '(?i)\s+and\s+')))) AS i FROM rels),
        parsed AS (SELECT cs, r, i, regexp_matches(piece, '{part}') AS ok, regexp_extract(piece, '{part}', 1) AS lt, regexp_extract(piece, '{part}', 2) AS lc, replace(regexp_extract(piece, '{part}', 3), '==', '=') AS op, regexp_extract(piece, '{part}', 4) AS rt, regexp_extract(piece, '{part}', 5) AS rc FROM pieces),
        broken AS (SELECT cs, r FROM parsed GROUP BY cs, r HAVING NOT bool_and(ok)),
        conj AS (SELECT * FROM parsed AS p WHERE NOT EXISTS (SELECT 1 FROM broken AS b WHERE b.cs = p.cs AND b.r = p.r)),
        refs AS (SELECT cs, r, lt AS t, lc AS c FROM conj UNION ALL SELECT cs, r, rt, rc FROM conj),
        pairs AS (SELECT cs, lt AS t, lc AS c, rt AS t2, rc AS c2 FROM conj WHERE op = '=' UNION ALL SELECT cs, rt, rc, lt, lc FROM conj WHERE op = '='),
        firsts AS (SELECT cs, r, arg_min(lt, i) AS lt, arg_min(rt, i) AS rt FROM conj GROUP BY cs, r),
        sided AS (SELECT f.cs, f.r, f.lt, f.rt, CASE WHEN c.lt = f.lt THEN c.lc ELSE c.rc END AS lc, CASE WHEN c.lt = f.lt THEN c.rc ELSE c.lc END AS rc, c.op FROM conj AS c JOIN firsts AS f ON f.cs = c.cs AND f.r = c.r),
        described AS (SELECT c.*, (SELECT rich FROM tabs AS t WHERE t.cs = c.cs LIMIT 1) AS rich, (SELECT count(*) FROM items AS x WHERE x.cs = c.cs AND x.ti = c.ti AND x.ci = c.ci AND x.k = 'values') AS n_values,
            (SELECT count(*) FROM items AS x WHERE x.cs = c.cs AND x.ti = c.ti AND x.ci = c.ci AND x.k = 'range') AS n_range, (SELECT count(*) FROM items AS x WHERE x.cs = c.cs AND x.ti = c.ti AND x.ci = c.ci AND x.k = 'examples') AS n_examples FROM cols AS c),
        olds AS (SELECT *, CASE WHEN type = 'enum' THEN 'values' WHEN type = 'boolean' THEN 'none' WHEN type IN ('number(ordinal)', 'number(quantity)', 'date', 'datetime') THEN 'range' WHEN type IS NOT NULL THEN 'examples' END AS own FROM described WHERE rich = 0),
        misfits AS (SELECT *, CASE WHEN own IS NULL THEN 0 ELSE (CASE own WHEN 'values' THEN n_values WHEN 'range' THEN n_range WHEN 'examples' THEN n_examples ELSE 1 END = 0)::INTEGER + (own <> 'values' AND n_values > 0)::INTEGER + (own <> 'range' AND n_range > 0)::INTEGER + (own <> 'examples' AND n_examples > 0)::INTEGER END AS n FROM olds),
        judged AS (SELECT x.*, o.type, o.zone, CASE
                WHEN o.type LIKE 'number%' THEN x.kind = 'number'
                WHEN o.type = 'string' THEN x.kind <> 'list'
                WHEN x.v IN ('.inf', '-.inf') THEN TRUE
                WHEN o.type = 'date' THEN x.kind = 'string' AND regexp_full_match(x.v, '\d{{4}}-\d\d-\d\d') AND try_cast(x.v AS DATE) IS NOT NULL
                ELSE x.kind = 'string' AND regexp_full_match(x.v, '\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d' || CASE WHEN o.zone IS NULL THEN '(Z|[+-]\d\d:\d\d)' ELSE '' END) END AS fits
            FROM items AS x JOIN misfits AS o ON o.cs = x.cs AND o.ti = x.ti AND o.ci = x.ci AND o.own = x.k AND o.n = 0 AND o.own IN ('range', 'examples')),
        bounds AS (SELECT cs, ti, ci, any_value(type) AS type, max(v) FILTER (WHERE i = 0) AS lo, max(v) FILTER (WHERE i = 1) AS hi FROM judged WHERE k = 'range' GROUP BY cs, ti, ci HAVING bool_and(fits)),
        scoped AS (SELECT c.*, coalesce((SELECT body FROM defs AS f WHERE f.cs = c.cs AND lower(f.name) = lower(c.type)), c.type) AS meant, EXISTS (SELECT 1 FROM defs AS f WHERE f.cs = c.cs AND lower(f.name) = lower(c.type) AND lower(f.body) = lower(f.name)) AS loops FROM described AS c WHERE rich = 1 AND type IS NOT NULL),
        typed AS (SELECT *, NOT loops AND (regexp_full_match(upper(meant), 'BOOLEAN|VARCHAR|INT4|INTEGER|BIGINT|DOUBLE|DATE|TIMESTAMP|DECIMAL\(\d+,\d+\)') OR regexp_full_match(meant, 'ENUM\(.*\)')) AS known,
            CASE WHEN meant = 'BOOLEAN' THEN 'boolean' WHEN regexp_full_match(upper(meant), 'INT4|INTEGER|BIGINT|DOUBLE|DECIMAL\(.*\)') THEN 'numeric' WHEN meant = 'DATE' THEN 'date' WHEN meant = 'TIMESTAMP' THEN 'timestamp' ELSE 'other' END AS category FROM scoped),
        ranged AS (SELECT x.*, t.category, CASE WHEN x.v IN ('.inf', '-.inf') THEN TRUE WHEN t.category = 'numeric' THEN x.kind = 'number' WHEN t.category = 'date' THEN x.kind = 'string' AND try_cast(x.v AS DATE) IS NOT NULL ELSE x.kind = 'string' END AS fits
            FROM items AS x JOIN typed AS t ON t.cs = x.cs AND t.ti = x.ti AND t.ci = x.ci AND t.known AND t.category IN ('numeric', 'date', 'timestamp') WHERE x.k = 'range'),
        spans AS (SELECT cs, ti, ci, any_value(category) AS type, max(v) FILTER (WHERE i = 0) AS lo, max(v) FILTER (WHERE i = 1) AS hi FROM ranged GROUP BY cs, ti, ci HAVING bool_and(fits))"""
    return "WITH " + ",\n        ".join(given) + "," + derived + "\n        "


_FACTS = facts()
#: An infinite bound only stands at its own end; others are compared as numbers or dates.
_BACKWARDS = "CASE WHEN lo IN ('.inf', '-.inf') OR hi IN ('.inf', '-.inf') THEN (lo = '.inf' AND hi <> '.inf') OR (hi = '-.inf' AND lo <> '-.inf') WHEN type = 'date' THEN try_cast(lo AS DATE) > try_cast(hi AS DATE) ELSE try_cast(lo AS DOUBLE) > try_cast(hi AS DOUBLE) END"


def rule(name: str, code: str, sql: str, only: tuple[str, ...] | None = None) -> None:
    """Registers the number of a code's problems in each case that has any; sql gives a row for each problem, with its case. `only` names the cases, if not all."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = [(cs, sum(p.code == code for p in _problems(spark, d).items)) for cs, d in CASES.items() if only is None or cs in only]
        return spark.createDataFrame([r for r in rows if r[1]], "document string, problems bigint")

    within = f"WHERE cs IN ({', '.join(map(_cell, only))})" if only else ""
    QUERIES[name] = run
    ORACLE[name] = f"{_FACTS}SELECT cs AS document, count(*) AS problems FROM ({sql}) AS found {within} GROUP BY cs"


_HAS = "EXISTS (SELECT 1 FROM cons AS k WHERE k.cs = {0}.cs AND k.t = {0}.{1} AND k.c = {0}.{2} AND k.what IN ({3}))"
_CLEAN = "NOT EXISTS (SELECT 1 FROM refs AS q WHERE q.cs = {0}.cs AND q.r = {0}.r AND NOT EXISTS (SELECT 1 FROM cols AS c WHERE c.cs = q.cs AND c.t = q.t AND c.c = q.c))"

rule("s01_foreign_key_target", "S01", f"SELECT k.cs FROM cons AS k WHERE k.what = 'foreign_key' AND NOT EXISTS (SELECT 1 FROM pairs AS p WHERE p.cs = k.cs AND p.t = k.t AND p.c = k.c AND {_HAS.format('p', 't2', 'c2', repr('primary_key'))})")
rule("s02_join_tables", "S02", "SELECT q.cs FROM refs AS q WHERE NOT EXISTS (SELECT 1 FROM tabs AS t WHERE t.cs = q.cs AND t.t = q.t)")
rule("s03_join_columns", "S03", "SELECT q.cs FROM refs AS q WHERE EXISTS (SELECT 1 FROM tabs AS t WHERE t.cs = q.cs AND t.t = q.t) AND NOT EXISTS (SELECT 1 FROM cols AS c WHERE c.cs = q.cs AND c.t = q.t AND c.c = q.c)")
rule("s04_join_grammar", "S04", "SELECT cs FROM broken", ("clean", "broken_join", "self_join", "key_written_backwards"))
rule("s04b_two_tables", "S04", "SELECT cs FROM refs GROUP BY cs, r HAVING count(DISTINCT t) > 2", ("clean", "three_tables", "self_join", "unknown_table"))
rule("s05_conflicts", "S05", "SELECT f.cs FROM confl AS f WHERE EXISTS (SELECT 1 FROM refs AS q JOIN tabs AS t ON t.cs = q.cs AND t.t = q.t WHERE q.cs = f.cs AND q.r = f.r AND NOT EXISTS (SELECT 1 FROM cols AS c WHERE c.cs = q.cs AND c.t = q.t AND c.c = f.c))")
rule(
    "s06_unique_sides", "S06",
    f"SELECT s.cs FROM sided AS s JOIN rels AS l ON l.cs = s.cs AND l.r = s.r WHERE {_CLEAN.format('s')} GROUP BY s.cs, s.r, l.cardinality HAVING bool_and(op = '=') AND ((l.cardinality IN ('one-to-one', 'one-to-many') AND NOT bool_or({_HAS.format('s', 'lt', 'lc', repr('primary_key') + ', ' + repr('unique'))})) OR (l.cardinality IN ('one-to-one', 'many-to-one') AND NOT bool_or({_HAS.format('s', 'rt', 'rc', repr('primary_key') + ', ' + repr('unique'))})))",
)
rule("s07_older_description", "S07", "SELECT cs FROM (SELECT cs, unnest(range(n)) FROM misfits WHERE n > 0) AS m", ("old_described", "old_units", "old_values", "old_order", "same_columns_old"))
rule("s08_older_units", "S08", "SELECT cs FROM olds WHERE units IS NOT NULL AND coalesce(type, '') <> 'number(quantity)'", ("old_described", "old_units", "old_zones"))
rule("s09_learn_more", "S09", "SELECT DISTINCT cs FROM tops WHERE cs NOT IN (SELECT cs FROM tops WHERE k = '$learn_more')")
rule("s10_column_names", "S10", "SELECT cs FROM (SELECT c.cs, unnest(range(count(*) - 1)) FROM cols AS c JOIN tabs AS t ON t.cs = c.cs AND t.ti = c.ti WHERE c.c <> '' GROUP BY c.cs, c.ti, CASE WHEN t.rich = 1 THEN lower(c.c) ELSE c.c END HAVING count(*) > 1 UNION ALL SELECT cs, unnest(range(count(*) - 1)) FROM tabs WHERE t <> '' GROUP BY cs, CASE WHEN rich = 1 THEN lower(t) ELSE t END HAVING count(*) > 1) AS d")
rule("s11_empty_names", "S11", "SELECT cs FROM tabs WHERE t = '' UNION ALL SELECT cs FROM cols WHERE c = ''")
rule("s12_older_values", "S12", "SELECT cs FROM judged WHERE NOT fits", ("old_described", "old_units", "old_zones", "old_values", "old_order"))
rule("s13_older_order", "S13", f"SELECT cs FROM bounds WHERE {_BACKWARDS}", ("old_described", "old_units", "old_zones", "old_values", "old_order"))
rule("s14_older_time_zone", "S14", "SELECT cs FROM olds WHERE zone IS NOT NULL AND coalesce(type, '') <> 'datetime'", ("old_described", "old_units", "old_zones"))
rule("s15_time_zones", "S15", r"SELECT cs FROM cols WHERE zone IS NOT NULL AND zone NOT IN ('naive', 'UTC') AND NOT regexp_full_match(zone, '(Africa|America|Antarctica|Arctic|Asia|Atlantic|Australia|Europe|Indian|Pacific|Etc)/[A-Za-z0-9_+/-]+')")
rule("s16_one_table", "S16", "SELECT cs FROM (SELECT cs, unnest(range(described + detailed)) FROM tabs AS t WHERE described + detailed > 0 AND (SELECT count(*) FROM tabs AS o WHERE o.cs = t.cs) = 1) AS d")
rule(
    "s17_version", "S17",
    r"SELECT v.cs FROM tops AS v LEFT JOIN tops AS o ON o.cs = v.cs AND o.k LIKE 'version.%' WHERE v.k = 'version' GROUP BY v.cs HAVING count(o.k) <> 1 OR bool_or(CASE o.k WHEN 'version.number' THEN NOT regexp_full_match(o.v, '\d+\.\d+\.\d+(-[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*)?(\+[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*)?') WHEN 'version.date' THEN NOT regexp_full_match(o.v, '\d{4}-\d\d-\d\d') OR try_cast(o.v AS DATE) IS NULL ELSE FALSE END)",
)
rule("s18_typedef_names", "S18", "SELECT cs FROM defs WHERE name IN ('', 'null', 'true', 'false') OR try_cast(name AS DOUBLE) IS NOT NULL")
rule("s19_extension_names", "S19", "SELECT cs FROM exts WHERE NOT regexp_full_match(e, '[a-z0-9_]+')")
rule("s20_extensions_once", "S20", "SELECT cs FROM (SELECT cs, unnest(range(count(*) - 1)) FROM exts GROUP BY cs, e HAVING count(*) > 1) AS d")
rule("s07_rich_description", "S07", "SELECT cs FROM (SELECT cs, unnest(range(CASE WHEN category = 'boolean' THEN (n_values > 0)::INTEGER + (n_range > 0)::INTEGER + (n_examples > 0)::INTEGER WHEN n_range > 0 AND category = 'other' THEN 1 ELSE 0 END)) FROM typed WHERE known) AS d", ("typed", "clean"))
rule("s08_rich_units", "S08", "SELECT cs FROM typed WHERE known AND units IS NOT NULL AND category <> 'numeric'", ("typed", "clean"))
rule("s12_rich_values", "S12", "SELECT cs FROM ranged WHERE NOT fits", ("typed", "clean"))
rule("s13_rich_order", "S13", f"SELECT cs FROM spans WHERE {_BACKWARDS}", ("typed", "clean"))
rule("s14_rich_time_zone", "S14", "SELECT cs FROM typed WHERE known AND zone IS NOT NULL AND category <> 'timestamp'", ("typed", "clean"))
rule("m06_missing_tables", "M06", "SELECT cs FROM tabs", ("typed", "clean"))
rule("m08_typedefs", "M08", r"SELECT cs FROM defs WHERE lower(body) = lower(name) OR NOT regexp_full_match(upper(body), 'BOOLEAN|VARCHAR|INT4|INTEGER|BIGINT|DOUBLE|DATE|TIMESTAMP|DECIMAL\(\d+,\d+\)')", ("typed", "clean"))
rule("m09_column_types", "M09", "SELECT cs FROM typed WHERE NOT known", ("typed", "clean"))
rule("m10_extensions", "M10", "SELECT cs FROM exts WHERE e NOT IN ('json', 'spatial', 'icu', 'parquet')", ("typed", "clean"))
