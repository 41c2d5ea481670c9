"""Generated values as Spark expressions: the i-th value of a type, and a seeded hash of a row number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .types import INTEGER_BITS, LogicalType, TypeProblem, capacity, spark_type

#: The hash's constants.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
GOLDEN, STEP_1, STEP_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: The first day, and the head of generated UUIDs.
EPOCH_DAY, EPOCH_SECONDS, UUID_HEAD = "2000-01-01", 946684800, "00000000-0000-4000-8000-"
_WORD = (1 << 64) - 1


def signed(x: int) -> int:
    x &= _WORD
    return x - (1 << 64) if x >> 63 else x


def salt_hash(salt: str) -> int:
    h = FNV_OFFSET
    for b in salt.encode():
        h = ((h ^ b) * FNV_PRIME) & _WORD
    return h


def mix_value(seed: int, salt: str, i: int) -> int:
    """The hash of a row number, unsigned, computed here."""
    z = salt_hash(salt) ^ (seed * GOLDEN & _WORD) ^ ((i + GOLDEN) & _WORD)
    z = (z ^ (z >> 30)) * STEP_1 & _WORD
    z = (z ^ (z >> 27)) * STEP_2 & _WORD
    return z ^ (z >> 31)


def with_wrapping(spark: SparkSession, build: Callable[[], object]):
    """Runs build() while long arithmetic wraps; expressions keep that when they were analysed under it."""
    key, was = "spark.sql.ansi.enabled", spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set(key, "false")
    try:
        return build()
    finally:
        spark.conf.set(key, was)


def mix(seed: int, salt: str, i: Column) -> Column:
    """mix_value() of a long column, as the long with the same 64 bits; analyse it under with_wrapping()."""
    start = signed(salt_hash(salt) ^ (seed * GOLDEN & _WORD))
    z = F.lit(start).bitwiseXOR(i + F.lit(signed(GOLDEN)))
    z = z.bitwiseXOR(F.shiftrightunsigned(z, 30)) * F.lit(signed(STEP_1))
    z = z.bitwiseXOR(F.shiftrightunsigned(z, 27)) * F.lit(signed(STEP_2))
    return z.bitwiseXOR(F.shiftrightunsigned(z, 31))


def unsigned_mod(z: Column, n: int) -> Column:
    """z, read as unsigned, modulo n."""
    if n > (1 << 62):  # no halving below that bound: the wide type is exact
        wide = F.when(z < 0, z.cast("decimal(38,0)") + F.lit(str(1 << 64)).cast("decimal(38,0)")).otherwise(z.cast("decimal(38,0)"))
        return (wide % F.lit(str(n)).cast("decimal(38,0)")).cast("decimal(20,0)")
    half = F.pmod(F.shiftrightunsigned(z, 1), F.lit(n))
    return F.pmod(half * 2 + z.bitwiseAND(F.lit(1)), F.lit(n))


def below_fraction(z: Column, fraction: float) -> Column:
    """Whether z, read as unsigned, is below that fraction of the whole range; 1 and above are always, 0 never."""
    if fraction >= 1.0 or fraction <= 0.0:
        return F.lit(fraction >= 1.0)
    as_double = F.when(z >= 0, z.cast("double")).otherwise(z.cast("double") + F.lit(2.0**64))
    return as_double < F.lit(fraction * float(_WORD))


def within_capacity(t: LogicalType, i: Column) -> Column:
    """Whether a type has an i-th value: its index is below the capacity, which a long may not reach."""
    n = capacity(t)
    return (i >= 0) & (F.lit(True) if n >= 1 << 63 else i < F.lit(n))


def checked_nth(t: LogicalType, i: Column) -> Column:
    """nth(), but an index without a value is an error when it is met, and never wraps."""
    return F.when(within_capacity(t, i), nth(t, i)).otherwise(F.raise_error(F.concat(F.lit(f"{t} has no value number "), i.cast("string"))))


def nth(t: LogicalType, i: Column) -> Column:
    """The i-th value of a type: different for different i below its capacity, growing with i where the type is orderable."""
    if t.name in INTEGER_BITS or t.name in ("FLOAT", "DOUBLE", "DECIMAL"):
        return i.cast(spark_type(t))
    text = i.cast("string")
    if t.name in ("LIST", "ARRAY"):
        x = nth(t.children[0], i)
        if t.name == "LIST" or t.params[0] == 1:
            return F.array(x)
        return F.concat(F.array(x), F.array_repeat(nth(t.children[0], F.lit(0).cast("long")), t.params[0] - 1))
    if t.name == "STRUCT":
        return F.struct(*(nth(c, i).alias(n) for n, c in zip(t.names, t.children, strict=True)))
    if t.name == "UNION":
        rest = [F.lit(None).cast(spark_type(c)).alias(n) for n, c in list(zip(t.names, t.children, strict=True))[1:]]
        return F.struct(F.lit(t.names[0]).alias("tag"), nth(t.children[0], i).alias(t.names[0]), *rest)
    if t.name == "MAP":
        return F.create_map(nth(t.children[0], i), nth(t.children[1], i))
    made: dict[str, Callable[[], Column]] = {
        "BOOLEAN": lambda: i == 1,
        "VARCHAR": lambda: F.concat(F.lit("v"), F.lpad(text, 20, "0")),
        "BLOB": lambda: F.unhex(F.lpad(F.hex(i.cast("long")), 16, "0")),
        "BIT": lambda: F.lpad(F.bin(i.cast("long")), 64, "0"),
        "DATE": lambda: F.date_add(F.lit(EPOCH_DAY).cast("date"), i.cast("int")),
        "TIME": lambda: F.concat_ws(":", *(F.lpad(x.cast("long").cast("string"), 2, "0") for x in (F.floor(i / 3600), F.floor((i % 3600) / 60), i % 60))),
        "TIMESTAMP": lambda: F.expr(f"TIMESTAMP_NTZ'{EPOCH_DAY} 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), i.cast("decimal(18,6)")),
        "TIMESTAMP WITH TIME ZONE": lambda: F.timestamp_seconds(i + F.lit(EPOCH_SECONDS)),
        "INTERVAL": lambda: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), i.cast("decimal(18,6)")),
        "UUID": lambda: F.concat(F.lit(UUID_HEAD), F.lower(F.lpad(F.hex(i.cast("long")), 12, "0"))),
        "JSON": lambda: F.concat(F.lit('{"i":'), text, F.lit("}")),
        "GEOMETRY": lambda: F.concat(F.lit("POINT ("), text, F.lit(" 0)")),
        "ENUM": lambda: F.element_at(F.array(*map(F.lit, t.params)), (i + 1).cast("int")),
    }
    if t.name not in made or not capacity(t):
        raise TypeProblem(f"no values can be generated for {t}")
    return made[t.name]()

