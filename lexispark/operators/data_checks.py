"""The value checks D01 to D05, each a DataFrame with one row; counts are exact.

Names in arguments are the data's own; they are quoted, so any name is inert.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OPS: dict[str, Callable] = {"=": operator.eq, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def count_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """D01: nulls in each of the columns, in one pass over only them; columns n0, n1… in their order."""
    return df.agg(*(F.count_if(F.col(quoted(c)).isNull()).alias(f"n{i}") for i, c in enumerate(columns)))


def null_rows(df: DataFrame, column: str, limit: int = 5) -> DataFrame:
    """The first rows with a null, numbered from 1 through all of a table's Parquet files in the order of their paths.

    The first rows by file and place are found before files are counted, so only a few rows meet the files' numbers of rows, which footers tell.
    """
    place = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"), F.col(quoted(column)).isNull().alias("gone"))
    first = place.where("gone").select("file", "place").orderBy("file", "place").limit(limit)
    files = df.select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("rows"))
    before = files.select("file", (F.sum("rows").over(Window.orderBy("file")) - F.col("rows")).alias("before"))  # a row for each file
    return first.join(before, "file").select((F.col("before") + F.col("place") + 1).alias("row")).orderBy("row")


#: Longer texts are told apart by their SHA-256, so that whole texts needn't be shuffled.
_LONGEST_KEY = 64


def _key(df: DataFrame, column: str) -> Column:
    c, kind = F.col(quoted(column)), df.schema[column].dataType.typeName() if column in df.columns else ""
    if kind == "string":  # what stands for a long text is itself too long to be a text that stands for itself
        return F.when(F.octet_length(c) > _LONGEST_KEY, F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))).otherwise(c)
    if kind == "binary":
        return F.when(F.octet_length(c) > _LONGEST_KEY, F.concat(F.lit(b"sha256:"), F.sha2(c, 256).cast("binary"))).otherwise(c)
    return c


def duplicate_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """D02: different values of a key, of all its columns together, that more than one row has. Nulls are values and equal each other."""
    return df.groupBy(*(_key(df, c).alias(f"k{i}") for i, c in enumerate(columns))).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n"))


def duplicate_values(df: DataFrame, column: str) -> DataFrame:
    """D03: different values of a column, other than null, that more than one row has."""
    return duplicate_keys(df.where(F.col(quoted(column)).isNotNull()), [column])


def orphaned_values(fk: DataFrame, fk_column: str, pk: DataFrame, pk_column: str) -> DataFrame:
    """D04: different values of a column, other than null, that the other column lacks. Values meet once on either side, so hot keys don't."""
    have = fk.select(F.col(quoted(fk_column)).alias("fk")).where("fk is not null").distinct()
    known = pk.select(F.col(quoted(pk_column)).alias("pk")).distinct()
    return have.join(known, F.col("fk") == F.col("pk"), "left_anti").agg(F.count("*").alias("n"))


def overmatched_rows(probe: DataFrame, other: DataFrame, conjuncts: Sequence[tuple[str, str, str]]) -> DataFrame:
    """D05: probe rows that match more than one row of the other side under all of (probe column, op, other column).

    A null matches nothing; NaN equals NaN and is greater than any number. Both sides are first counted by their join values. Equalities then need no pairs of rows;
    one column's interval, closed, open or one-sided, is swept, and so are two comparisons of different columns; of more comparisons, all but two are split by halves before.
    """
    p_names, o_names = [f"p{i}" for i in range(len(conjuncts))], [f"o{i}" for i in range(len(conjuncts))]
    p, o = (_counted(df, columns, names, rows) for df, columns, names, rows in ((probe, [c for c, _, _ in conjuncts], p_names, "p_rows"), (other, [c for _, _, c in conjuncts], o_names, "o_rows")))
    ranges = [i for i, (_, op, _) in enumerate(conjuncts) if op != "="]
    equal = [i for i, (_, op, _) in enumerate(conjuncts) if op == "="]
    if not ranges:
        many = o.where("o_rows > 1")
        met = p.join(many, reduce(operator.and_, (F.col(f"p{i}") == F.col(f"o{i}") for i in equal)), "left_semi")
    elif swept := _sweepable(conjuncts, ranges):
        met = _swept(p, o, conjuncts, equal, *swept)
    elif len(ranges) == 2:
        met = _two_ranges(p, o, conjuncts, equal, *ranges)
    else:
        different = [df.agg(*(F.approx_count_distinct(F.col(quoted(conjuncts[i][at]))) for i in ranges)).first() for df, at in ((probe, 0), (other, 2))]
        met = _more_ranges(p, o, conjuncts, equal, [i for _, i in sorted((min(n), i) for i, *n in zip(ranges, *different, strict=True))])
    return met.agg(F.coalesce(F.sum("p_rows"), F.lit(0)).cast("bigint").alias("n"))


def _counted(df: DataFrame, columns: Sequence[str], names: list[str], rows: str) -> DataFrame:
    """Different values of columns without nulls, and how many rows have them."""
    kept = df.select(*(F.col(quoted(c)).alias(n) for c, n in zip(columns, names, strict=True))).where(reduce(operator.and_, (F.col(n).isNotNull() for n in names)))
    return kept.groupBy(*names).agg(F.count("*").alias(rows))


def _sweepable(conjuncts: Sequence[tuple[str, str, str]], ranges: list[int]) -> tuple[int | None, int | None] | None:
    """(lower, upper) conjunct of one probe column's interval, either of which may be missing; None for other shapes."""
    if len({conjuncts[i][0] for i in ranges}) != 1:
        return None
    lower = [i for i in ranges if conjuncts[i][1] in (">", ">=")]
    upper = [i for i in ranges if conjuncts[i][1] in ("<", "<=")]
    if len(lower) > 1 or len(upper) > 1:
        return None
    return (lower[0] if lower else None), (upper[0] if upper else None)


#: Ranges that an axis is cut into, at most, and values drawn for each cut.
MOST_RANGES, DRAWN = 256, 64


def _range_of(events: DataFrame, x: str = "x") -> Callable[[Column], Column]:
    """A function of an axis' values that grows with them: the number of the range they are in. Equal values never part.

    Cuts are quantiles of a draw by hash, of any type that can be ordered; at most MOST_RANGES * DRAWN values reach the driver.
    """
    n = min(MOST_RANGES, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    drawn = [r["x"] for r in events.select(F.col(x).alias("x"), F.xxhash64(x).alias("u")).orderBy("u").limit(n * DRAWN).select("x").orderBy("x").collect()] if n > 1 else []
    n = min(n, max(2, -(-len(drawn) // DRAWN)))  # few values need few ranges; of one, Spark would make a product with what is carried over
    cuts = [drawn[len(drawn) * i // n] for i in range(1, n)] if drawn else []
    kind = events.schema[x].dataType

    def tree(value: Column, lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value > F.lit(cuts[mid]).cast(kind), tree(value, mid + 1, hi)).otherwise(tree(value, lo, mid))

    return lambda value: tree(value, 0, len(cuts))


def _swept(p: DataFrame, o: DataFrame, conjuncts: Sequence[tuple[str, str, str]], equal: list[int], lower: int | None, upper: int | None) -> DataFrame:
    """Matches of each probe value as a running sum of intervals that have begun and not ended.

    Interval ends and probe values become events of one ordered axis for each value of the equalities. At one value, ends come before probes where
    the comparison is strict at the end, beginnings after them where it is strict at the beginning. The axis is cut into
    ranges, whose sums before them are carried over, so no task orders all of it, nor all of one value of the equalities.
    """
    at = lower if lower is not None else upper
    keys = [f"e{i}" for i in equal]
    key_p, key_o = [F.col(f"p{i}").alias(f"e{i}") for i in equal], [F.col(f"o{i}").alias(f"e{i}") for i in equal]
    lo, hi = F.col(f"o{lower}") if lower is not None else None, F.col(f"o{upper}") if upper is not None else None
    if lower is not None and upper is not None:  # an interval that ends before it begins holds nothing
        closed = conjuncts[lower][1] == ">=" and conjuncts[upper][1] == "<="
        o = o.where(lo <= hi if closed else lo < hi)
    # At one value, events go by rank: begin (closed) 0, end (strict) 1, probe 2, begin (strict) 3, end (closed) 4.
    events = p.select(*key_p, F.col(f"p{at}").alias("x"), F.lit(2).alias("rank"), F.lit(0).cast("bigint").alias("change"), F.col("p_rows"))
    none = F.lit(0).cast("bigint").alias("p_rows")
    if lower is not None:
        events = events.unionByName(o.select(*key_o, lo.alias("x"), F.lit(0 if conjuncts[lower][1] == ">=" else 3).alias("rank"), F.col("o_rows").alias("change"), none))
    if upper is not None:
        events = events.unionByName(o.select(*key_o, hi.alias("x"), F.lit(4 if conjuncts[upper][1] == "<=" else 1).alias("rank"), (-F.col("o_rows")).alias("change"), none))
    cut = events.withColumn("part", _range_of(events)(F.col("x")))
    sums = cut.groupBy(*keys, "part").agg(F.sum("change").alias("own"))  # a row for each range, and value of the equalities
    ordered = Window.partitionBy(*keys).orderBy("part")
    # Without a lower bound all intervals have begun before anything else.
    begun = -F.sum("own").over(Window.partitionBy(*keys)) if lower is None else F.lit(0)
    before = sums.select(*keys, "part", (F.sum("own").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("own") + begun).alias("before"))
    inside = F.sum("change").over(Window.partitionBy(*keys, "part").orderBy("x", "rank").rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("inside", inside).join(before, [*keys, "part"]).where((F.col("p_rows") > 0) & (F.col("inside") + F.col("before") > 1))


def _two_ranges(p: DataFrame, o: DataFrame, conjuncts: Sequence[tuple[str, str, str]], equal: list[int], first: int, second: int) -> DataFrame:
    """Probe values with two matches under two comparisons."""
    p, o = _keyed(p, o, equal)
    return _matches(p, o, conjuncts, [f"e{i}" for i in equal], first, second).where("matches > 1")


def _keyed(p: DataFrame, o: DataFrame, equal: list[int]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the values of equalities under the same names."""
    return p.select("*", *(F.col(f"p{i}").alias(f"e{i}") for i in equal)), o.select("*", *(F.col(f"o{i}").alias(f"e{i}") for i in equal))


def _matches(p: DataFrame, o: DataFrame, conjuncts: Sequence[tuple[str, str, str]], keys: list[str], first: int, second: int, kept: Sequence[str] = (), axis: DataFrame | None = None) -> DataFrame:
    """Probe values' matches (0, 1, or 2 for more) among what has the same keys, under two comparisons: in the order of the first one's values, the two best values of the other so far tell.

    When a value comes, the lesser of it and the best before it is what may become second best; so both are running maxima (or minima), which ranges carry over.
    The probe's columns in kept come along. Ranges are cut by the values x of axis, if given, and by all rows' otherwise.
    """
    up, large = conjuncts[first][1] in (">", ">="), conjuncts[second][1] in ("<", "<=")
    best, lesser, better = (F.max, F.least, F.greatest) if large else (F.min, F.greatest, F.least)
    kind = o.schema[f"o{second}"].dataType
    # At one value, what a closed comparison admits comes before probes, and after them what a strict one doesn't.
    rank = 0 if conjuncts[first][1] in (">=", "<=") else 2
    probes = p.select(*keys, *kept, F.col(f"p{first}").alias("x"), F.lit(1).alias("rank"), F.lit(None).cast(kind).alias("v"), F.col(f"p{second}").alias("y"), "p_rows")
    twice = F.explode(F.array_repeat(F.col(f"o{second}"), F.least(F.col("o_rows"), F.lit(2)).cast("int"))).alias("v")
    values = o.select(*keys, F.col(f"o{first}").alias("x"), F.lit(rank).alias("rank"), twice, F.lit(0).cast("bigint").alias("p_rows"))
    events = probes.unionByName(values, allowMissingColumns=True)
    part = _range_of(events if axis is None else axis)(F.col("x"))
    cut = events.withColumn("part", part if up else -part)
    x = F.col("x").asc() if up else F.col("x").desc()
    upto, earlier = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    both = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), lesser(a, b))
    inside = Window.partitionBy(*keys, "part").orderBy(x, "rank", "v")
    run = cut.withColumn("was", best("v").over(inside.rowsBetween(*earlier))).withColumn("m", best("v").over(inside.rowsBetween(*upto))).withColumn("next", both(F.col("was"), F.col("v")))
    run = run.withColumn("s", best("next").over(inside.rowsBetween(*upto)))
    ranges = run.groupBy(*keys, "part").agg(best("m").alias("rm"), best("s").alias("rs"))  # a row for each range, and value of the keys
    ordered = Window.partitionBy(*keys).orderBy("part")
    carried = ranges.withColumn("bm", best("rm").over(ordered.rowsBetween(*earlier))).withColumn("rs", better(F.col("rs"), both(F.col("rm"), F.col("bm"))))
    carried = carried.select(*keys, "part", "bm", best("rs").over(ordered.rowsBetween(*earlier)).alias("bs"))
    found = run.where("p_rows > 0").join(carried, [*keys, "part"])
    fits = lambda value: F.coalesce(_OPS[conjuncts[second][1]](F.col("y"), value), F.lit(False)).cast("int")
    return found.withColumn("matches", fits(better("m", "bm")) + fits(better(F.col("s"), F.col("bs"), both(F.col("m"), F.col("bm")))))


def _more_ranges(p: DataFrame, o: DataFrame, conjuncts: Sequence[tuple[str, str, str]], equal: list[int], ranges: list[int]) -> DataFrame:
    """Probe values with two matches under three or more comparisons, in the order of how many different values they have: all but two are split by halves, so a matching pair meets in one node of each, where the other two are swept.

    A row goes to half of a comparison's halvings on the average, of which there are as many as the number of its different values has binary digits. So those with
    the fewest are split. Of rows that differ in the comparison with the most only, the two best are as good as all.
    """
    p, o = _keyed(p, o, equal)
    *split, first, second = ranges
    axis = p.select(F.col(f"p{first}").alias("x")).union(o.select(f"o{first}")).distinct()
    v = F.col(f"o{second}")
    alike = Window.partitionBy(*(f"o{i}" for i in range(len(conjuncts)) if i != second)).orderBy(v.desc() if conjuncts[second][1] in ("<", "<=") else v.asc())
    o = o.withColumn("place", F.row_number().over(alike)).where("place <= 2").drop("place")
    placed = {i: _positions(p, o, conjuncts[i][1], i) for i in split}
    for i in split:
        p, o = (_halved(df, side, i, placed[i], (side == "p") == (conjuncts[i][1] in (">", ">="))) for df, side in ((p, "p"), (o, "o")))
    probe = [f"p{i}" for i in range(len(conjuncts))]
    met = _matches(p, o, conjuncts, [*(f"e{i}" for i in equal), *(f"d{i}" for i in split)], first, second, probe, axis)
    return met.where("matches > 0").groupBy(*probe, "p_rows").agg(F.sum("matches").alias("matches")).where("matches > 1")


def _positions(p: DataFrame, o: DataFrame, op: str, at: int) -> DataFrame:
    """A position for each value x of either side (probe tells which), and the number of binary digits that positions have: a pair fits if the position of the side that must be less is less.

    The values of both sides are put in an order in which the one that must be less comes before what it fits. A value's position is the number of values of the side with fewer
    that come before it; the later side's values count themselves.
    """
    up = op in (">", ">=")
    rank = 0 if up == (op in (">=", "<=")) else 2  # at one value, of the other side; 1 is the probe's
    values = p.select(F.col(f"p{at}").alias("x"), F.lit(1).alias("rank")).union(o.select(F.col(f"o{at}"), F.lit(rank))).distinct()
    cut = values.select("x", (F.col("rank") == 1).alias("probe"), "rank", _range_of(values)(F.col("x")).alias("part"))
    is_p, is_o = F.col("probe").cast("int"), (~F.col("probe")).cast("int")
    sums = cut.groupBy("part").agg(F.sum(is_p).alias("sp"), F.sum(is_o).alias("so"))  # a row for each range
    earlier, all_ranges = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    before = sums.select("part", *(F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"b{s}") for s in ("sp", "so")), *(F.sum(s).over(all_ranges).alias(f"a{s}") for s in ("sp", "so")))
    upto = Window.partitionBy("part").orderBy("x", "rank").rowsBetween(Window.unboundedPreceding, 0)
    run = cut.withColumns({"np": F.sum(is_p).over(upto), "no": F.sum(is_o).over(upto)}).join(before, "part")
    by_p = F.col("asp") < F.col("aso")
    n = F.when(by_p, F.col("np") + F.col("bsp")).otherwise(F.col("no") + F.col("bso"))
    first = F.col("probe") != F.lit(up)
    return run.select("x", "probe", (n - (first & (F.col("probe") == by_p)).cast("int")).alias("position"), F.length(F.bin(F.least("asp", "aso"))).alias("digits"))


def _halved(df: DataFrame, side: str, at: int, placed: DataFrame, greater: bool) -> DataFrame:
    """A side's rows, once for each node of a comparison's halvings that they go to (column d and its number): what fits meets in one node, what doesn't in none.

    The positions of a pair that fits differ first in one binary digit, which is 1 in the greater and 0 in the other: the node is that digit and what is before it.
    """
    mine = placed.where("probe" if side == "p" else "not probe")
    above = lambda b: F.call_function("shiftright", F.col("position"), b)
    its = F.filter(F.sequence(F.lit(0), F.col("digits") - 1), lambda b: above(b).bitwiseAND(F.lit(1)) == int(greater))
    node = F.explode(F.transform(its, lambda b: F.shiftleft(above(b + 1), 6).bitwiseOR(b.cast("bigint"))))
    return df.join(mine, F.col(f"{side}{at}") == F.col("x")).select(*df.columns, node.alias(f"d{at}"))
