"""D01 to D05 on tiny tables whose answers are known, and against brute force."""

import datetime
import operator
import random
import re

import pytest
from lexispark.operators import data_checks as D


def n(df):
    return df.first()[0]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def day(text):
    return datetime.date.fromisoformat(text)


def test_nulls(spark):
    df = frame(spark, [(1, "a"), (None, "b"), (None, None)], "qty bigint, note string")
    assert tuple(D.count_nulls(df, ["qty", "note"]).first()) == (2, 1)
    with pytest.raises(Exception, match="nothing"):
        D.count_nulls(df, ["nothing"]).first()


def test_duplicate_keys(spark):
    assert n(D.duplicate_keys(frame(spark, [(x,) for x in (7, 7, 9, 9, 9, 1)], "id int"), ["id"])) == 2
    px = frame(spark, [("AAPL", day("2026-01-01")), ("AAPL", day("2026-01-02")), ("MSFT", day("2026-01-01")), ("MSFT", day("2026-01-01"))], "sym string, day date")
    assert n(D.duplicate_keys(px, ["sym", "day"])) == 1
    assert n(D.duplicate_keys(frame(spark, [(1,), (2,)], "id int"), ["id"])) == 0
    assert n(D.duplicate_keys(frame(spark, [(None,), (None,), (1,)], "id int"), ["id"])) == 1


def test_duplicate_values_leave_nulls_alone(spark):
    assert n(D.duplicate_values(frame(spark, [(x,) for x in "aabbbc"], "e string"), "e")) == 2
    assert n(D.duplicate_values(frame(spark, [(None,)] * 3 + [("a",)], "e string"), "e")) == 0


def test_orphans(spark):
    ids = lambda *x: frame(spark, [(i,) for i in x], "id int")
    assert n(D.orphaned_values(ids(1, 2, 5, 5, 7), "id", ids(1, 2), "id")) == 2
    assert n(D.orphaned_values(ids(1, None, None), "id", ids(1), "id")) == 0
    assert n(D.orphaned_values(ids(1, 9), "id", ids(1, None), "id")) == 1
    staff = frame(spark, [(1, None), (2, 1), (3, 99)], "id int, boss int")
    assert n(D.orphaned_values(staff, "boss", staff, "id")) == 1


def periods(spark, *rows):
    return frame(spark, [(i, day(a), day(b)) for i, (a, b) in enumerate(rows)], "id int, start date, end date")


BETWEEN = [("date", ">=", "start"), ("date", "<=", "end")]


def test_overlapping_ranges(spark):
    events = frame(spark, [(1, day("2020-01-10")), (2, day("2020-02-15"))], "id int, date date")
    assert n(D.overmatched_rows(events, periods(spark, ("2020-01-01", "2020-03-01"), ("2020-02-01", "2020-04-01")), BETWEEN)) == 1
    assert n(D.overmatched_rows(events, periods(spark, ("2020-01-01", "2020-01-31"), ("2020-02-01", "2020-02-29")), BETWEEN)) == 0


def test_equal_columns(spark):
    ids = lambda *x: frame(spark, [(i,) for i in x], "id int")
    same = [("id", "=", "id")]
    assert n(D.overmatched_rows(ids(1, 2, 99), ids(1, 1, 2), same)) == 1
    assert n(D.overmatched_rows(ids(None, None), ids(1, 1), same)) == 0
    assert n(D.overmatched_rows(ids(None, None), ids(None, None), same)) == 0
    staff = frame(spark, [(1, None), (1, None), (2, 1), (3, 2)], "id int, boss int")
    assert n(D.overmatched_rows(staff, staff, [("boss", "=", "id")])) == 1


def test_both_kinds_of_conjuncts(spark):
    calendars = frame(spark, [(1, day("2020-01-01"), day("2020-03-01")), (2, day("2020-02-01"), day("2020-04-01"))], "cal int, start date, end date")
    events = frame(spark, [(1, day("2020-02-15"))], "cal int, date date")
    assert n(D.overmatched_rows(events, calendars, [("cal", "=", "cal"), *BETWEEN])) == 0


def test_hostile_names_are_inert(spark):
    odd, worse = 'a"b`; DROP TABLE x', "c.d e"
    df = frame(spark, [(1, None), (1, 2), (5, 2)], f"id int, `{worse}` int").withColumnRenamed("id", odd)
    assert n(D.count_nulls(df, [worse])) == 1
    assert n(D.duplicate_keys(df, [odd])) == 1
    assert n(D.orphaned_values(df, odd, df, worse)) == 2
    assert n(D.overmatched_rows(df, df, [(odd, "=", odd)])) == 2


OPS = {"=": operator.eq, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}
SHAPES = [
    [("a", ">=", "x"), ("a", "<=", "y")], [("a", ">", "x"), ("a", "<", "y")], [("a", ">=", "x"), ("a", "<", "y")], [("a", ">", "x"), ("a", "<=", "y")],
    [("a", ">=", "x")], [("a", ">", "x")], [("a", "<", "y")], [("a", "<=", "y")], [("b", "=", "z"), ("a", ">=", "x"), ("a", "<", "y")], [("b", "=", "z"), ("a", "<", "y")], [("b", "=", "z"), ("a", ">", "x")],
    [("a", ">=", "x"), ("b", "<=", "z")], [("a", "=", "x"), ("b", "=", "z")],
]


@pytest.mark.parametrize("shape", SHAPES, ids=lambda s: " and ".join(map(" ".join, s)))
@pytest.mark.parametrize("kind", ["int", "double", "decimal(10,2)", "date", "string"])
def test_against_every_pair(spark, shape, kind):
    if kind in ("date", "string", "decimal(10,2)") and len(shape) == 1:
        pytest.skip("one kind of these is enough")
    rng = random.Random(str(shape) + kind)
    value = lambda: rng.choice([None, *range(8)])
    p, o = [(value(), value()) for _ in range(40)], [(value(), value(), value()) for _ in range(25)]
    expected = sum(sum(all(a is not None and b is not None and OPS[op](a, b) for a, op, b in ((dict(zip("ab", r, strict=True))[c], op, dict(zip("xyz", s, strict=True))[e]) for c, op, e in shape)) for s in o) > 1 for r in p)
    cast = lambda df: df.selectExpr(*(f"date_add(date'2020-01-01', {c} * 20) {c}" if kind == "date" else f"cast({c} as {kind}) {c}" for c in df.columns))
    got = n(D.overmatched_rows(cast(frame(spark, p, "a int, b int")), cast(frame(spark, o, "x int, y int, z int")), shape))
    assert got == expected


NAN = float("nan")


def test_nan_equals_itself_and_is_greatest(spark):
    p, o = frame(spark, [(NAN,), (1.0,)], "x double"), frame(spark, [(NAN,), (NAN,), (0.5,), (0.2,)], "x double")
    assert [n(D.overmatched_rows(p, o, [("x", op, "x")])) for op in ("=", ">=", ">", "<=", "<")] == [1, 2, 2, 2, 1]


@pytest.mark.parametrize("shape", [[("a", ">=", "x"), ("b", "<", "y")], [("a", "<", "x"), ("b", "<=", "y")], [("a", ">", "x"), ("b", ">=", "z"), ("a", "<=", "y")], [("b", "=", "z"), ("a", "<=", "x")]], ids=str)
def test_no_pairs_of_all_rows(spark, shape):
    rng = random.Random(str(shape))
    value = lambda: rng.choice([None, NAN, *map(float, range(9))])
    rank = lambda v: (v != v, 0 if v != v else v)
    p, o = [(value(), value()) for _ in range(50)], [(value(), value(), value()) for _ in range(30)]
    fits = lambda r, s: all(a is not None and b is not None and OPS[op](rank(a), rank(b)) for a, op, b in ((dict(zip("ab", r, strict=True))[c], op, dict(zip("xyz", s, strict=True))[e]) for c, op, e in shape))
    q = D.overmatched_rows(frame(spark, p, "a double, b double"), frame(spark, o, "x double, y double, z double"), shape)
    assert n(q) == sum(sum(fits(r, s) for s in o) > 1 for r in p)
    plan = q._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_rows_are_numbered_through_all_files(spark, tmp_path):
    for i, name in enumerate("cab"):
        rows = [(None if (i, j) in {(0, 1), (1, 3), (2, 0), (2, 4)} else j,) for j in range(5)]
        frame(spark, rows, "x int").coalesce(1).write.parquet(str(tmp_path / "t" / f"part={name}"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert [r.row for r in D.null_rows(df, "x").collect()] == [4, 6, 10, 12]
    assert [r.row for r in D.null_rows(df, "x", 2).collect()] == [4, 6]


def test_long_texts_are_told_apart(spark):
    long = "x" * 100
    df = frame(spark, [(long + "a",), (long + "a",), (long + "b",), ("short",), ("short",), (None,)], "t string")
    assert n(D.duplicate_values(df, "t")) == 2 and n(D.duplicate_values(df.selectExpr("cast(t AS binary) AS t"), "t")) == 2


def test_empty_tables(spark):
    empty = frame(spark, [], "id int, x int")
    assert tuple(D.count_nulls(empty, ["id"]).first()) == (0,)
    for q in (D.duplicate_keys(empty, ["id"]), D.duplicate_values(empty, "id"), D.orphaned_values(empty, "id", empty, "id"), *(D.overmatched_rows(empty, empty, s) for s in ([("id", "=", "id")], [("id", ">=", "x")], [("id", "<", "x")]))):
        assert n(q) == 0


MORE = [
    [("a", ">=", "x"), ("a", "<=", "y"), ("b", ">", "z")], [("a", "<", "x"), ("b", ">=", "y"), ("c", "<", "z")], [("c", "=", "w"), ("a", ">", "x"), ("b", "<", "y"), ("a", "<=", "z")],
    [("a", ">=", "x"), ("a", "<", "w"), ("b", "<=", "y"), ("b", ">", "x"), ("c", ">=", "z")],
]


@pytest.mark.parametrize("shape", MORE, ids=lambda s: " and ".join(map(" ".join, s)))
@pytest.mark.parametrize("numbers", [6, 1000])
def test_three_and_more_comparisons(spark, shape, numbers):
    """Few values, so many ties and equal rows, and many, so hardly any. No pairs are compared."""
    rng = random.Random(f"{shape} {numbers}")
    value = lambda: rng.choice([None, NAN, *[float(rng.randrange(numbers)) for _ in range(14)]])
    p, o = [tuple(value() for _ in "abc") for _ in range(150)], [tuple(value() for _ in "wxyz") for _ in range(60)]
    p, o = p + p[:20], o + o[:5]
    rank = lambda v: (v != v, 0 if v != v else v)
    fits = lambda r, s: all(a is not None and b is not None and OPS[op](rank(a), rank(b)) for a, op, b in ((r["abc".index(c)], op, s["wxyz".index(e)]) for c, op, e in shape))
    q = D.overmatched_rows(frame(spark, p, "a double, b double, c double"), frame(spark, o, "w double, x double, y double, z double"), shape)
    assert n(q) == sum(sum(fits(r, s) for s in o) > 1 for r in p)
    plan = q._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and not re.search(r"Join.*\bp\d#\w+ [<>]=? o\d#", plan)


def test_three_comparisons_of_larger_tables(spark):
    """Every pair fits the first comparison; kinds of numbers differ; matches that are told by one row twice, by two rows, or in different nodes."""
    size, rng = 1500, random.Random(5)
    p, o = [(i, rng.random() * 100, rng.randrange(size)) for i in range(size)], [(-rng.randrange(size), rng.randrange(90), rng.randrange(size)) for _ in range(size)]
    few = [(a, x, k) for a, x, k in o if k % 9 == 0]
    shape = [("a", ">=", "x"), ("b", "<=", "y"), ("c", ">", "z")]
    for other in (o, few[:3], few[:1] * 2):
        got = n(D.overmatched_rows(frame(spark, p, "a bigint, b double, c int"), frame(spark, other, "x int, y int, z bigint"), shape))
        assert got == sum(sum(b <= y and c > z for _, y, z in other) > 1 for _, b, c in p)
    empty = frame(spark, [], "x int, y int, z bigint")
    assert n(D.overmatched_rows(frame(spark, p, "a bigint, b double, c int"), empty, shape)) == 0
