"""Meta and data levels, generated data, DDL and commands, end to end."""

import json

import pytest
from lexispark import cli
from lexispark.operators.validate import validate_data, validate_meta
from lexispark.plans.generation import GenerationProblem, Options, make_plan
from lexispark.plans.spec_rules import check_document
from lexispark.queries import dictionary, generated_dictionary, generator
from lexispark.sources import relations
from lexispark.sources.generated import DdlProblem, Generator, ddl, expand_typedefs
from lexispark.sources.relations import Frames, ParquetFolder
from pyspark.sql import functions as F

HEAD = '$version: "0.2.0"\n$learn_more: https://example.org\n'
ALL_FIVE = HEAD + """
source: {parquet: {dir: data}}
tables:
  - name: trades
    columns:
      - {name: id, type: BIGINT, constraints: [primary_key]}
      - {name: qty, type: BIGINT, constraints: [required]}
      - {name: ref, type: VARCHAR, constraints: [unique]}
      - {name: cat_id, type: BIGINT, constraints: [foreign_key]}
      - {name: ts, type: DATE}
  - name: categories
    columns:
      - {name: id, type: BIGINT, constraints: [primary_key]}
  - name: periods
    columns:
      - {name: start, type: DATE, constraints: [unique]}
      - {name: end, type: DATE}
relationships:
  - {cardinality: many-to-one, join: trades.cat_id = categories.id}
  - {cardinality: many-to-one, join: trades.ts >= periods.start AND trades.ts <= periods.end}
"""


def write(spark, folder, name, rows, schema):
    df = spark.createDataFrame(rows, schema)
    for f in df.schema.fields:
        if f.dataType.simpleString() == "string" and f.name in ("ts", "start", "end"):
            df = df.withColumn(f.name, F.col(f.name).cast("date"))
    df.write.parquet(str(folder / f"{name}.parquet"))


@pytest.fixture
def five(spark, tmp_path):
    def make(trades, categories=((1,),), periods=(("2024-01-01", "2024-01-31"), ("2024-01-04", "2024-01-10"))):
        (tmp_path / "a-dict.yaml").write_text(ALL_FIVE)
        write(spark, tmp_path / "data", "trades", trades, "id bigint, qty bigint, ref string, cat_id bigint, ts string")
        write(spark, tmp_path / "data", "Categories", list(categories), "ID bigint")
        write(spark, tmp_path / "data", "periods", list(periods), "start string, end string")
        return tmp_path / "a-dict.yaml"

    return make


BAD = [(1, 10, "ord-1", 1, "2024-01-05"), (1, None, "ord-1", 1, "2024-02-15"), (2, 20, "ord-2", 99, "2024-01-20")]


def test_all_five_rules(spark, five):
    report = validate_data(spark, five(BAD))
    assert [(p.code, p.payload["count"]) for p in report.items] == [("D01", 1), ("D02", 1), ("D03", 1), ("D04", 1), ("D05", 1)]
    assert report.exit_code == 1 and report.to_df(spark).where("level = 'data'").count() == 5


def test_clean_data_with_nulls(spark, five):
    rows = [(1, 10, None, None, None), (2, 20, None, None, None), (3, 5, "x", 1, "2024-01-20")]
    assert validate_data(spark, five(rows)).items == []


def test_one_table_only(spark, five):
    path = five(BAD)
    assert validate_data(spark, path, table="categories").codes() == ["D05"] or validate_data(spark, path, table="categories").codes() == []
    assert validate_data(spark, path, table="periods").codes() == ["D05"]
    report = validate_meta(spark, path, table="Trades")
    assert report.items[0].kind == "table_not_found" and report.items[0].payload["available"] == ["trades", "categories", "periods"]


META = HEAD + """
typedef: {money: 'DECIMAL(12,2)', broken: 'NOPE', round: round}
duckdb: {extensions: [json, warp]}
tables:
  - name: trades
    typedef: {money: VARCHAR}
    columns:
      - {name: QTY, type: INTEGER, range: [5, 1], units: kg}
      - {name: price, type: money}
      - {name: gone}
      - {name: odd, type: 'STRUCT(a)'}
      - {name: note, type: VARCHAR, range: [a, b], units: kg, time_zone: UTC}
      - {name: at, type: TIMESTAMP, range: [2024-01-01, '2024-01-01T00:00:00']}
      - {name: flag, type: BOOLEAN, values: [true], examples: [true]}
  - name: absent
    columns: [{name: x, type: INTEGER}]
"""


def test_metadata_rules(spark, tmp_path):
    (tmp_path / "d.yaml").write_text(META)
    frames = Frames({"Trades": spark.createDataFrame([], "qty bigint, price string, note string, at timestamp_ntz, flag boolean, odd int, extra array<int>"), "other": spark.range(1)})
    report = validate_meta(spark, tmp_path / "d.yaml", source=frames)
    assert report.codes() == ["M10", "M08", "M08", "M09", "S13", "S07", "S08", "S14", "S12", "S07", "S07", "M01", "M02", "M03", "M06", "M07"]
    mismatch = next(p for p in report.items if p.code == "M01")
    assert mismatch.payload == {"declared": "INTEGER", "actual": "BIGINT"}
    assert next(p for p in report.items if p.code == "M03").payload == {"actual": "INTEGER[]"}


def test_sources(spark, tmp_path):
    text = HEAD + "tables: [{name: t, columns: [{name: x}]}]\n"
    path = tmp_path / "d.yaml"
    path.write_text(text)
    assert validate_meta(spark, path).codes() == ["M04"]
    for source in ("{parquet: {dir: nowhere}}", "{catalog: {database: nowhere}}", "{duckdb: {file: a.db}}"):
        path.write_text(text + f"source: {source}\n")
        assert validate_meta(spark, path).codes() == ["M05"]
    assert not (tmp_path / "nowhere").exists()
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    spark.range(3).withColumnRenamed("id", "x").write.mode("overwrite").saveAsTable("shop.t")
    spark.sql("CREATE OR REPLACE VIEW shop.v AS SELECT 1 AS one")
    path.write_text(text + "source: {catalog: {database: shop}}\n")
    assert [(p.code, p.table) for p in validate_data(spark, path).items] == [("M07", "v")]
    assert [(x.table, x.column, x.type) for x in relations.describe(relations.CatalogDatabase(spark, "shop"))] == [("t", "x", "BIGINT"), ("v", "one", "INTEGER")]


def test_spec_errors_stop(spark, tmp_path):
    (tmp_path / "d.yaml").write_text(HEAD + "tables: [{name: t, columns: [{name: x, constraints: [foreign_key]}]}]\n")
    assert validate_data(spark, tmp_path / "d.yaml").codes() == ["S01"]


# --- the older format -----------------------------------------------------

OLD = """$version: "0.1.0"
$learn_more: https://example.org
tables:
  - name: animals
    source: {parquet: animals.parquet}
    columns:
      - {name: name, type: string, examples: [otter], constraints: [required]}
      - {name: weight, type: number, examples: [1], constraints: [required]}
      - {name: seen, type: datetime, range: ['2024-01-01T00:00:00Z', '2024-02-01T00:00:00Z']}
  - name: lost
    source: {parquet: lost.parquet}
    columns: [{name: x}]
  - name: homeless
    columns: [{name: x}]
"""


@pytest.mark.parametrize("statistics", [True, False])
def test_older_format(spark, tmp_path, statistics):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "d.yaml").write_text(OLD)
    t = pa.table({"name": ["otter", "seal", "eel"], "weight": [1.0, None, 2.0], "extra": [[1], [2], None]})
    pq.write_table(t, tmp_path / "animals.parquet", write_statistics=statistics)
    report = validate_data(spark, tmp_path / "d.yaml")
    assert report.codes() == ["M02", "M03", "D01", "M05", "M04"]
    assert report.items[2].payload == {"count": 1, "rows": [] if statistics else [2]}
    assert report.items[1].payload == {"actual": "list"}
    assert validate_meta(spark, tmp_path / "d.yaml").codes() == ["M02", "M03", "M05", "M04"]


def test_footers(spark, tmp_path):
    import datetime
    from decimal import Decimal

    import pyarrow as pa
    import pyarrow.parquet as pq

    t = pa.table(
        {
            "i": pa.array([1, None], pa.int32()), "u": pa.array([1, 2], pa.uint8()), "d": pa.array([Decimal("1.20"), None], pa.decimal128(9, 2)), "s": ["a", "b"], "b": [True, None], "day": [datetime.date(2024, 1, 1)] * 2,
            "ts": pa.array([0, 1], pa.timestamp("us", "UTC")), "tm": pa.array([0, 1], pa.time64("us")), "f": [1.5, 2.5], "bin": [b"x", b"y"], "l": [[1], []], "st": [{"a": 1}, None], "must": pa.array([1, 2], pa.int64()),
        }
    )
    t = t.cast(pa.schema([pa.field(f.name, f.type, nullable=f.name != "must") for f in t.schema]))
    pq.write_table(t, tmp_path / "x.parquet")
    got = {c.name: (c.type, c.logical, c.physical, c.nulls) for c in relations.parquet_columns(str(tmp_path / "x.parquet"))}
    assert got["i"] == ("number", None, "INT32", 1) and got["d"] == ("number", "Decimal(9,2)", "FIXED_LEN_BYTE_ARRAY", 1) and got["u"] == ("number", "Integer(u8)", "INT32", 0)
    assert got["ts"] == ("datetime", "Timestamp(us,UTC)", "INT64", 0) and got["tm"][0] == "number" and got["tm"][1].startswith("Time(us")
    assert [got[c][0] for c in ("s", "b", "day", "f", "bin", "l", "st")] == ["string", "boolean", "date", "number", "string", "list", "struct"] and got["must"][3] == 0
    pq.write_table(t.drop(["tm"]), tmp_path / "x.parquet")  # Spark can't read times of day
    counts = {r.column: r.nulls for r in relations.parquet_null_counts(spark.read.parquet(str(tmp_path / "x.parquet")).select("i", "d", "s", "st")).collect()}
    assert counts == {"i": 1, "d": 1, "s": 0, "st": 1}


def test_footers_of_many_files(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else str(i)) for i in range(40)], "i bigint, s string")
    df.repartition(3).write.parquet(str(tmp_path / "data" / "t.parquet"))
    for found in (relations.parquet_columns(f"file://{tmp_path}/data/t.parquet", spark), ParquetFolder(spark, f"file://{tmp_path}/data").columns("t")):
        assert {c.name: (c.type, c.physical, c.nulls) for c in found} == {"i": ("number", "INT64", 0), "s": ("string", "BYTE_ARRAY", 10)}


def test_values_end_at_the_capacity(spark):
    from lexispark.functions.types import parse_type
    from lexispark.functions.values import checked_nth

    values = lambda n: [r.v for r in spark.range(n).select(checked_nth(parse_type("BOOLEAN"), F.col("id")).alias("v")).collect()]
    assert values(2) == [False, True]
    with pytest.raises(Exception, match="BOOLEAN has no value number 2"):
        values(3)


# --- generation -----------------------------------------------------------


def test_generated_data_is_valid(spark, tmp_path):
    made = generator()
    made.write(spark, str(tmp_path / "out"))
    with pytest.raises(FileExistsError):
        made.write(spark, str(tmp_path / "out"))
    made.write(spark, str(tmp_path / "out"), force=True)
    folder = ParquetFolder(spark, str(tmp_path / "out"))
    assert folder.names() == sorted(t.table for t in made.plan.tables)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    again = generator().table(spark, "orders")
    assert again.exceptAll(folder.table("orders")).count() == 0
    assert 150 < again.where("amount is null").count() < 350
    assert Generator(generated_dictionary(), Options(null_fraction=1.0)).table(spark, "orders").where("amount is not null").count() == 0
    assert Generator(generated_dictionary(), Options(null_fraction=0.0)).table(spark, "orders").where("amount is null").count() == 0


K, U, R, FK = ("primary_key",), ("unique",), ("required",), ("foreign_key",)


@pytest.mark.parametrize(
    ("kind", "tables", "relations_", "options"),
    [
        ("null_fraction", {"t": {"x": ("INTEGER", ())}}, [], {"null_fraction": 1.5}),
        ("unknown_table", {"t": {"x": ("INTEGER", ())}}, [], {"table_rows": {"u": 1}}),
        ("no_target", {"t": {"x": ("INTEGER", FK)}}, [], {}),
        ("ambiguous_target", {"t": {"x": ("INTEGER", FK)}, "a": {"id": ("INTEGER", K)}, "b": {"id": ("INTEGER", K)}}, [("many-to-one", "t.x = a.id"), ("many-to-one", "t.x = b.id")], {}),
        ("cycle", {"t": {"id": ("INTEGER", K), "up": ("INTEGER", FK)}}, [("many-to-one", "t.up = t.id")], {}),
        ("empty_target", {"t": {"x": ("INTEGER", FK)}, "a": {"id": ("INTEGER", K)}}, [("many-to-one", "t.x = a.id")], {"table_rows": {"a": 0}}),
        ("too_few_targets", {"t": {"x": ("INTEGER", FK + U)}, "a": {"id": ("INTEGER", K)}}, [("one-to-one", "t.x = a.id")], {"table_rows": {"a": 3}}),
        ("cardinality", {"t": {"x": ("INTEGER", ())}, "a": {"id": ("INTEGER", ())}}, [("many-to-one", "t.x = a.id")], {}),
        ("range_shape", {"e": {"x": ("INTEGER", ())}, "w": {"lo": ("INTEGER", ()), "hi": ("INTEGER", ())}}, [("many-to-one", "e.x >= w.lo")], {}),
        ("range_shape", {"e": {"x": ("INTEGER", ())}, "w": {"lo": ("INTEGER", ()), "hi": ("INTEGER", ())}}, [("many-to-one", "e.x >= w.lo AND e.x <= w.lo")], {}),
        ("range_shape", {"e": {"x": ("INTEGER", ())}, "w": {"lo": ("INTEGER", ()), "hi": ("INTEGER", ())}}, [("many-to-one", "e.x >= w.lo AND e.x = w.hi")], {}),
        ("range_foreign_key", {"e": {"x": ("INTEGER", FK)}, "w": {"lo": ("INTEGER", K), "hi": ("INTEGER", ())}}, [("many-to-one", "e.x >= w.lo AND e.x <= w.hi")], {}),
        ("range_unique", {"e": {"x": ("INTEGER", U)}, "w": {"lo": ("INTEGER", ()), "hi": ("INTEGER", ())}}, [("many-to-one", "e.x >= w.lo AND e.x <= w.hi")], {}),
        ("conflict", {"e": {"x": ("INTEGER", ())}, "w": {"lo": ("INTEGER", ()), "hi": ("INTEGER", ())}}, [("many-to-one", "e.x >= w.lo AND e.x <= w.hi"), ("many-to-one", "e.x > w.lo AND e.x < w.hi")], {}),
        ("too_few_owners", {"e": {"x": ("INTEGER", ())}, "w": {"lo": ("INTEGER", ()), "hi": ("INTEGER", ())}}, [("one-to-one", "e.x >= w.lo AND e.x <= w.hi")], {"table_rows": {"w": 2}}),
        ("capacity", {"t": {"x": ("TINYINT", K)}}, [], {"rows": 200}),
        ("type", {"t": {"x": ("TIMESTAMP_S", ())}}, [], {}),
        ("types", {"t": {"x": ("NOPE", ())}}, [], {}),
        ("range_type", {"e": {"x": ("UUID", ())}, "w": {"lo": ("UUID", ()), "hi": ("UUID", ())}}, [("many-to-one", "e.x >= w.lo AND e.x <= w.hi")], {}),
        ("range_type", {"e": {"x": ("INTEGER", ())}, "w": {"lo": ("BIGINT", ()), "hi": ("BIGINT", ())}}, [("many-to-one", "e.x >= w.lo AND e.x <= w.hi")], {}),
        ("range_capacity", {"e": {"x": ("TINYINT", ())}, "w": {"lo": ("TINYINT", ()), "hi": ("TINYINT", ())}}, [("many-to-one", "e.x >= w.lo AND e.x <= w.hi")], {"rows": 50}),
        ("range_copy", {"e": {"x": ("INTEGER", ()), "c": ("BIGINT", ())}, "w": {"lo": ("INTEGER", ()), "hi": ("INTEGER", ()), "c": ("INTEGER", ())}}, [("many-to-one", "e.x >= w.lo AND e.x <= w.hi AND e.c = w.c")], {}),
    ],
)
def test_refusals(kind, tables, relations_, options):
    with pytest.raises(GenerationProblem) as e:
        Generator(dictionary(tables, relations_), Options(**options))
    assert e.value.kind == kind


def test_other_direction_is_tried():
    d = dictionary({"w": {"lo": ("INTEGER", ()), "hi": ("INTEGER", ())}, "e": {"x": ("INTEGER", U)}}, [("one-to-one", "w.lo <= e.x AND w.hi >= e.x")])
    assert {c.column: type(c.role).__name__ for t in make_plan(d, Options()).tables for c in t.columns} == {"lo": "Bound", "hi": "Bound", "x": "Probe"}


def test_legacy_is_refused(tmp_path):
    (tmp_path / "d.yaml").write_text(OLD)
    d = check_document(tmp_path / "d.yaml")[1]
    with pytest.raises(GenerationProblem):
        Generator(d)
    with pytest.raises(DdlProblem):
        ddl(d)


# --- typedefs, DDL, commands ----------------------------------------------

TYPED = HEAD + """
typedef: {base: INTEGER, list: 'base[]', bad: NOPE}
tables:
  - name: "odd_name"
    typedef: {base: VARCHAR}
    columns: [{name: x, type: list}, {name: y}]
  - name: empty
    columns: [{name: z}]
"""


def test_typedefs(tmp_path):
    (tmp_path / "d.yaml").write_text(TYPED)
    d = check_document(tmp_path / "d.yaml")[1]
    got = [(e.table, e.name, e.expansion) for e in expand_typedefs(d)]
    assert got == [(None, "base", "INTEGER"), (None, "list", "INTEGER[]"), (None, "bad", None), ("odd_name", "base", "VARCHAR"), ("odd_name", "list", "VARCHAR[]")]
    with pytest.raises(DdlProblem, match="base"):
        ddl(d)


def test_ddl_runs(spark, tmp_path):
    (tmp_path / "d.yaml").write_text(TYPED.replace(", bad: NOPE", "").replace("    typedef: {base: VARCHAR}\n", ""))
    script = ddl(check_document(tmp_path / "d.yaml")[1])
    assert "-- table `empty` skipped" in script and "-- type list is INTEGER[]" in script
    spark.sql("CREATE DATABASE IF NOT EXISTS made")
    spark.sql("USE made")
    for statement in filter(str.strip, "\n".join(x for x in script.split("\n") if not x.startswith("--")).split(";")):
        spark.sql(statement)
    assert spark.table("made.odd_name").schema.simpleString() == "struct<x:array<int>>"
    for statement in filter(str.strip, generator().script(spark).replace("\n", " ").split(";")):
        spark.sql(statement)
    assert spark.table("made.orders").exceptAll(generator().table(spark, "orders")).count() == 0
    spark.sql("USE default")


def test_commands(spark, five, tmp_path, capsys):
    path = str(five(BAD))
    assert cli.main(["validate-spec", path]) == 0 and "no problems" in capsys.readouterr().out
    assert cli.main(["validate-data", "--json", str(tmp_path)]) == 1
    assert [p["kind"] for p in json.loads(capsys.readouterr().out)["problems"]] == ["nulls_in_required", "duplicate_key", "duplicate_values", "orphaned_values", "cardinality_violation"]
    assert cli.main(["validate-meta", path, "--table", "nothing"]) == 1
    assert cli.main(["types", "source", str(tmp_path / "data")]) == 0 and "trades" in capsys.readouterr().out
    assert cli.main(["types", "parquet", str(next((tmp_path / "data" / "periods.parquet").glob("*.parquet")))]) == 0 and "physical type" in capsys.readouterr().out
    assert cli.main(["ddl", path]) == 0 and "CREATE TABLE `trades`" in capsys.readouterr().out
    assert cli.main(["resolve", path]) == 0
    assert cli.main(["dummy", path, "--out", str(tmp_path / "made"), "--rows", "5", "--rows-table", "trades=9", "--rows-table", "trades=20"]) == 0
    assert spark.read.parquet(str(tmp_path / "made" / "trades.parquet")).count() == 20
    assert cli.main(["dummy", path, "--out", str(tmp_path / "made")]) == 1 and cli.main(["dummy", path, "--out", str(tmp_path / "made"), "--force"]) == 0
    assert cli.main(["dummy", path, "--rows-table", "x=1"]) == 1 and cli.main(["dummy", path, "--sql"]) == 0 and "INSERT INTO" in capsys.readouterr().out
    assert cli.main(["spec"]) == 0 and cli.main(["validate-spec", str(tmp_path / "none.yaml")]) == 1
    with pytest.raises(SystemExit):
        cli.main(["dummy", path, "--rows-table", "x"])
