"""The type language and generated values."""

import pytest
from lexispark.functions.types import TypeProblem, capacity, category, field_type, logical_type, orderable, parse_type, same_type, spark_type
from lexispark.functions.values import mix, mix_value, nth, signed, unsigned_mod, with_wrapping
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANONICAL = {
    "int4": "INTEGER", "text": "VARCHAR", "NUMERIC": "DECIMAL(18,3)", "decimal(9)": "DECIMAL(9,0)", "real": "FLOAT", "datetime": "TIMESTAMP", "timestamptz": "TIMESTAMP WITH TIME ZONE", "FLOAT[768]": "FLOAT[768]", "varchar[][3]": "VARCHAR[][3]",
    "ENUM('a', 'it''s')": "ENUM('a', 'it''s')", 'STRUCT(x INTEGER, "y z" TEXT)[]': 'STRUCT(x INTEGER, "y z" VARCHAR)[]', "MAP(VARCHAR, INT)": "MAP(VARCHAR, INTEGER)", "UNION(a INT, b TEXT)": "UNION(a INTEGER, b VARCHAR)", "ENUM('a, b', '(')": "ENUM('a, b', '(')",
}


@pytest.mark.parametrize(("text", "said"), CANONICAL.items())
def test_canonical_spelling(text, said):
    assert str(parse_type(text)) == said
    assert parse_type(said) == parse_type(text)


@pytest.mark.parametrize("text", ["", "INET", "STRUCT(a)", "DECIMAL(50,2)", "ENUM(a)", "MAP(INT)", "STRUCT(a INT, A TEXT)", "a", "int)", "ENUM('a','a')"])
def test_refusals(text):
    with pytest.raises(TypeProblem):
        parse_type(text, {"a": "b", "b": "a"})


def test_aliases_compound_and_hide():
    scope = {"money": "DECIMAL(12,2)", "basket": "STRUCT(total MONEY, items money[])"}
    assert str(parse_type("basket", scope)) == "STRUCT(total DECIMAL(12,2), items DECIMAL(12,2)[])"


def test_categories():
    for text, kind in (("HUGEINT", "numeric"), ("DECIMAL(3,1)", "numeric"), ("BOOLEAN", "boolean"), ("ENUM('[')", "enum"), ("DATE", "date"), ("TIMESTAMP_NS", "timestamp"), ("TIMESTAMPTZ", "timestamptz"), ("INT[]", "other"), ("TIME", "other")):
        assert category(parse_type(text)) == kind


def test_stored_types_come_back():
    for text in ("TINYINT", "BIGINT", "DECIMAL(9,2)", "DOUBLE", "VARCHAR", "BLOB", "DATE", "TIMESTAMP", "TIMESTAMPTZ", "STRUCT(a INTEGER, b VARCHAR[])", "MAP(VARCHAR, DOUBLE)"):
        assert logical_type(spark_type(parse_type(text))) == parse_type(text)
    plain, told = T.StructField("c", T.StringType()), T.StructField("c", T.StringType(), metadata={"logical_type": "UUID"})
    assert same_type(parse_type("UUID"), plain) and same_type(parse_type("UUID"), told) and not same_type(parse_type("JSON"), told)
    assert str(field_type(told)) == "UUID" and str(field_type(plain)) == "VARCHAR"


GENERATED = "BOOLEAN TINYINT SMALLINT INTEGER BIGINT HUGEINT UTINYINT USMALLINT UINTEGER UBIGINT UHUGEINT FLOAT DOUBLE DECIMAL(9,2) VARCHAR BLOB BIT DATE TIME TIMESTAMP TIMESTAMPTZ INTERVAL UUID JSON GEOMETRY ENUM('x','y','z') INTEGER[] VARCHAR[4] STRUCT(a_INTEGER,b_VARCHAR) MAP(VARCHAR,INTEGER) UNION(n_INTEGER,s_VARCHAR)".split()


@pytest.mark.parametrize("text", [t.replace("_", " ") for t in GENERATED])
def test_values_differ_and_grow(spark, text):
    kind = parse_type(text)
    rows = min(120, capacity(kind))
    df = spark.range(rows).select("id", nth(kind, F.col("id")).alias("v"))
    assert T.StructType([T.StructField("v", spark_type(kind))]).simpleString() == df.select("v").schema.simpleString()
    key = F.to_json(F.struct("v"))
    assert df.select(key).distinct().count() == rows
    if orderable(kind):
        assert [r.id for r in df.orderBy("v").collect()] == list(range(rows))


def test_unsupported_values():
    assert capacity(parse_type("TIMESTAMP_S")) == 0 and not orderable(parse_type("TIMESTAMP_S"))
    with pytest.raises(TypeProblem):
        nth(parse_type("TIMESTAMP_S"), F.lit(1))


def test_hash(spark):
    def build():
        z = mix(9, "fk:a.b", F.col("id"))
        df = spark.range(500).select("id", z.alias("z"), unsigned_mod(z, 97).alias("m"), unsigned_mod(z, (1 << 63) + 5).alias("big"))
        df.schema
        return df

    for r in with_wrapping(spark, build).collect():
        v = mix_value(9, "fk:a.b", r.id)
        assert (r.z, r.m, int(r.big)) == (signed(v), v % 97, v % ((1 << 63) + 5))
