"""The type language of dictionaries: parsing, canonical spelling, and what Spark stores for each type."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import types as T


class TypeProblem(ValueError):
    """A type expression that can't be resolved."""


@dataclass(frozen=True)
class LogicalType:
    """name is canonical and upper-case; params are numbers or labels; children are element, field, key and value or member types, with names where they have them."""

    name: str
    params: tuple = ()
    children: tuple[LogicalType, ...] = ()
    names: tuple[str, ...] = ()

    def __str__(self) -> str:
        if self.name == "LIST":
            return f"{self.children[0]}[]"
        if self.name == "ARRAY":
            return f"{self.children[0]}[{self.params[0]}]"
        if self.name == "DECIMAL":
            return f"DECIMAL({self.params[0]},{self.params[1]})"
        if self.name == "ENUM":
            return "ENUM(" + ", ".join(quote_label(v) for v in self.params) + ")"
        if self.name in ("STRUCT", "UNION"):
            return f"{self.name}(" + ", ".join(f"{quote_name(n)} {c}" for n, c in zip(self.names, self.children, strict=True)) + ")"
        if self.name == "MAP":
            return f"MAP({self.children[0]}, {self.children[1]})"
        return self.name


#: Canonical names of types without parameters, by the spellings that authors use.
SPELLINGS: dict[str, str] = {
    "BOOLEAN": "BOOLEAN", "BOOL": "BOOLEAN", "LOGICAL": "BOOLEAN",
    "TINYINT": "TINYINT", "INT1": "TINYINT",
    "SMALLINT": "SMALLINT", "INT2": "SMALLINT", "SHORT": "SMALLINT",
    "INTEGER": "INTEGER", "INT": "INTEGER", "INT4": "INTEGER", "SIGNED": "INTEGER",
    "BIGINT": "BIGINT", "INT8": "BIGINT", "LONG": "BIGINT",
    "HUGEINT": "HUGEINT", "INT128": "HUGEINT",
    "UTINYINT": "UTINYINT", "UINT8": "UTINYINT",
    "USMALLINT": "USMALLINT", "UINT16": "USMALLINT",
    "UINTEGER": "UINTEGER", "UINT32": "UINTEGER",
    "UBIGINT": "UBIGINT", "UINT64": "UBIGINT",
    "UHUGEINT": "UHUGEINT", "UINT128": "UHUGEINT",
    "FLOAT": "FLOAT", "REAL": "FLOAT", "FLOAT4": "FLOAT",
    "DOUBLE": "DOUBLE", "FLOAT8": "DOUBLE", "DOUBLE PRECISION": "DOUBLE",
    "VARCHAR": "VARCHAR", "TEXT": "VARCHAR", "STRING": "VARCHAR", "CHAR": "VARCHAR", "BPCHAR": "VARCHAR", "NVARCHAR": "VARCHAR",
    "BLOB": "BLOB", "BYTEA": "BLOB", "BINARY": "BLOB", "VARBINARY": "BLOB",
    "BIT": "BIT", "BITSTRING": "BIT",
    "DATE": "DATE", "TIME": "TIME", "TIME WITHOUT TIME ZONE": "TIME",
    "TIMESTAMP": "TIMESTAMP", "DATETIME": "TIMESTAMP", "TIMESTAMP_US": "TIMESTAMP", "TIMESTAMP WITHOUT TIME ZONE": "TIMESTAMP",
    "TIMESTAMP_S": "TIMESTAMP_S", "TIMESTAMP_MS": "TIMESTAMP_MS", "TIMESTAMP_NS": "TIMESTAMP_NS",
    "TIMESTAMP WITH TIME ZONE": "TIMESTAMP WITH TIME ZONE", "TIMESTAMPTZ": "TIMESTAMP WITH TIME ZONE",
    "INTERVAL": "INTERVAL", "UUID": "UUID", "GUID": "UUID", "JSON": "JSON", "GEOMETRY": "GEOMETRY",
}

#: Types that an extension brings, by extension; others in EXTENSIONS bring none that this engine knows.
EXTENSION_TYPES = {"json": {"JSON"}, "spatial": {"GEOMETRY"}}
EXTENSIONS = frozenset({"json", "spatial", "parquet", "icu"})


def quote_label(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quote_name(name: str) -> str:
    return name if re.fullmatch(r"[a-z_][a-z0-9_]*", name, re.I) else '"' + name.replace('"', '""') + '"'


def split_top(text: str) -> list[str]:
    """Parts at commas that no bracket or quote encloses."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote  # a doubled quote closes and opens again
        elif c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if depth < 0:
                raise TypeProblem(f"unbalanced brackets in `{text}`")
        elif c == "," and not depth:
            parts.append(text[start:i])
            start = i + 1
    if depth or quote:
        raise TypeProblem(f"unbalanced brackets or quotes in `{text}`")
    return [*parts, text[start:]]


def _field(text: str) -> tuple[str, str]:
    """A member's name, quoted or not, and its type's text."""
    text = text.strip()
    if m := re.match(r'"((?:[^"]|"")*)"\s*(.*)$', text, re.S):
        return m[1].replace('""', '"'), m[2]
    name, _, rest = text.partition(" ")
    if not rest.strip() or not re.fullmatch(r"\w+", name):
        raise TypeProblem(f"`{text}` isn't a name and a type")
    return name, rest


def parse_type(text: str, aliases: Mapping[str, str] | None = None, _open: tuple[str, ...] = ()) -> LogicalType:
    """The type that an expression means; aliases are typedefs in scope, matched without regard to case, and may use each other but not themselves."""
    text = " ".join(text.split()) if "'" not in text and '"' not in text else text.strip()
    if not text:
        raise TypeProblem("the type is empty")
    if m := re.fullmatch(r"(.*)\[\s*(\d*)\s*\]", text, re.S):  # the last brackets bind outermost
        inner = parse_type(m[1], aliases, _open)
        if m[2] and not 1 <= int(m[2]) <= 100_000:
            raise TypeProblem(f"an array can't have {m[2]} elements")
        return LogicalType("ARRAY", (int(m[2]),), (inner,)) if m[2] else LogicalType("LIST", (), (inner,))
    bare = text.strip('"').upper() if text.startswith('"') and text.endswith('"') else text.upper()
    for name, body in (aliases or {}).items():
        if name.upper() == bare:
            if bare in _open:
                raise TypeProblem(f"`{text}` is defined by itself")
            return parse_type(body, aliases, (*_open, bare))
    if m := re.fullmatch(r"([A-Za-z_ ]+?)\s*\((.*)\)", text, re.S):
        head, body = m[1].upper(), m[2]
        parts = [p.strip() for p in split_top(body)]
        if head in ("DECIMAL", "NUMERIC", "DEC"):
            if not all(re.fullmatch(r"\d+", p) for p in parts) or len(parts) > 2:
                raise TypeProblem(f"`{text}` needs a width and a scale")
            width, scale = int(parts[0]), int(parts[1]) if len(parts) == 2 else 0
            if not 1 <= width <= 38 or scale > width:
                raise TypeProblem(f"`{text}`: the width is 1 to 38, the scale at most the width")
            return LogicalType("DECIMAL", (width, scale))
        if head == "ENUM":
            labels = []
            for p in parts:
                if not re.fullmatch(r"'(?:[^']|'')*'", p, re.S):
                    raise TypeProblem(f"{p} isn't a quoted label")
                labels.append(p[1:-1].replace("''", "'"))
            if len(set(labels)) < len(labels):
                raise TypeProblem(f"`{text}` repeats a label")
            return LogicalType("ENUM", tuple(labels))
        if head in ("STRUCT", "ROW", "UNION"):
            fields = [_field(p) for p in parts]
            if len({n.lower() for n, _ in fields}) < len(fields):
                raise TypeProblem(f"`{text}` repeats a name")
            return LogicalType("UNION" if head == "UNION" else "STRUCT", (), tuple(parse_type(b, aliases, _open) for _, b in fields), tuple(n for n, _ in fields))
        if head == "MAP":
            if len(parts) != 2:
                raise TypeProblem(f"`{text}` needs a key and a value type")
            return LogicalType("MAP", (), tuple(parse_type(p, aliases, _open) for p in parts))
        if SPELLINGS.get(head) == "VARCHAR" and re.fullmatch(r"\s*\d+\s*", body):
            return LogicalType("VARCHAR")  # a length is no constraint
        raise TypeProblem(f"`{text}` is no type that this engine knows")
    if bare in ("DECIMAL", "NUMERIC", "DEC"):
        return LogicalType("DECIMAL", (18, 3))
    if bare in SPELLINGS:
        return LogicalType(SPELLINGS[bare])
    raise TypeProblem(f"`{text}` is no type that this engine knows")


INTEGER_BITS = {"TINYINT": (7, T.ByteType()), "SMALLINT": (15, T.ShortType()), "INTEGER": (31, T.IntegerType()), "BIGINT": (63, T.LongType()), "UTINYINT": (8, T.ShortType()), "USMALLINT": (16, T.IntegerType()), "UINTEGER": (32, T.LongType()), "HUGEINT": (127, T.DecimalType(38, 0)), "UBIGINT": (64, T.DecimalType(20, 0)), "UHUGEINT": (128, T.DecimalType(38, 0))}
_PLAIN = {
    "BOOLEAN": T.BooleanType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "VARCHAR": T.StringType(), "BLOB": T.BinaryType(), "BIT": T.StringType(), "DATE": T.DateType(),
    "TIME": T.StringType(), "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMP_S": T.TimestampNTZType(), "TIMESTAMP_MS": T.TimestampNTZType(), "TIMESTAMP_NS": T.TimestampNTZType(),
    "TIMESTAMP WITH TIME ZONE": T.TimestampType(), "INTERVAL": T.DayTimeIntervalType(0, 3), "UUID": T.StringType(), "JSON": T.StringType(), "GEOMETRY": T.StringType(), "ENUM": T.StringType(),
}


def spark_type(t: LogicalType) -> T.DataType:
    """What Spark stores. What it can't carry (labels, lengths, unsigned ranges…) is in the column's metadata as the canonical spelling."""
    if t.name in INTEGER_BITS:
        return INTEGER_BITS[t.name][1]
    if t.name == "DECIMAL":
        return T.DecimalType(*t.params)
    if t.name in ("LIST", "ARRAY"):
        return T.ArrayType(spark_type(t.children[0]))
    if t.name == "STRUCT":
        return T.StructType([T.StructField(n, spark_type(c)) for n, c in zip(t.names, t.children, strict=True)])
    if t.name == "UNION":
        return T.StructType([T.StructField("tag", T.StringType()), *(T.StructField(n, spark_type(c)) for n, c in zip(t.names, t.children, strict=True))])
    if t.name == "MAP":
        return T.MapType(spark_type(t.children[0]), spark_type(t.children[1]))
    return _PLAIN[t.name]


def logical_type(d: T.DataType) -> LogicalType:
    """The type that a Spark column without metadata has."""
    for name, (_, kept) in INTEGER_BITS.items():
        if d == kept and not isinstance(d, T.DecimalType):
            return LogicalType(name)
    if isinstance(d, T.DecimalType):
        return LogicalType("DECIMAL", (d.precision, d.scale))
    if isinstance(d, T.ArrayType):
        return LogicalType("LIST", (), (logical_type(d.elementType),))
    if isinstance(d, T.MapType):
        return LogicalType("MAP", (), (logical_type(d.keyType), logical_type(d.valueType)))
    if isinstance(d, T.StructType):
        return LogicalType("STRUCT", (), tuple(logical_type(f.dataType) for f in d.fields), tuple(f.name for f in d.fields))
    kinds = ((T.BooleanType, "BOOLEAN"), (T.FloatType, "FLOAT"), (T.DoubleType, "DOUBLE"), (T.StringType, "VARCHAR"), (T.BinaryType, "BLOB"), (T.DateType, "DATE"), (T.TimestampNTZType, "TIMESTAMP"), (T.TimestampType, "TIMESTAMP WITH TIME ZONE"), (T.DayTimeIntervalType, "INTERVAL"))
    for kind, name in kinds:
        if isinstance(d, kind):
            return LogicalType(name)
    return LogicalType(d.simpleString().upper())


METADATA_KEY = "logical_type"


def field_type(f: T.StructField) -> LogicalType:
    said = (f.metadata or {}).get(METADATA_KEY)
    return parse_type(said) if said else logical_type(f.dataType)


def same_type(expected: LogicalType, field: T.StructField) -> bool:
    """Whether a stored column has the expected type: exactly where its metadata says what it is, else as far as Spark's types tell."""
    if (field.metadata or {}).get(METADATA_KEY):
        return field_type(field) == expected
    return spark_type(expected) == _nullable(field.dataType)


def _nullable(d: T.DataType) -> T.DataType:
    if isinstance(d, T.ArrayType):
        return T.ArrayType(_nullable(d.elementType))
    if isinstance(d, T.MapType):
        return T.MapType(_nullable(d.keyType), _nullable(d.valueType))
    if isinstance(d, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in d.fields])
    return d


NUMERIC = frozenset(INTEGER_BITS) | {"FLOAT", "DOUBLE", "DECIMAL"}


def category(t: LogicalType) -> str:
    """boolean, numeric, enum, date, timestamp, timestamptz or other."""
    if t.name in NUMERIC:
        return "numeric"
    if t.name.startswith("TIMESTAMP"):
        return "timestamptz" if t.name.endswith("ZONE") else "timestamp"
    return t.name.lower() if t.name in ("BOOLEAN", "ENUM", "DATE") else "other"


MOST = (1 << 64) - 1


def capacity(t: LogicalType) -> int:
    """How many different values the generator can make; 0 for types it can't generate."""
    if t.name in INTEGER_BITS:
        return min(1 << INTEGER_BITS[t.name][0], MOST)
    if t.name == "DECIMAL":
        return min(10 ** (t.params[0] - t.params[1]), MOST)
    if t.name == "ENUM":
        return len(t.params)
    if t.name in ("LIST", "ARRAY", "UNION"):
        return capacity(t.children[0])
    if t.name in ("STRUCT", "MAP"):
        return min(map(capacity, t.children), default=0)
    # Days from 2000 within the calendar, seconds of a day, seconds within the calendar, exact integers of floats…
    fixed = {"BOOLEAN": 2, "FLOAT": 1 << 24, "DOUBLE": 1 << 53, "DATE": 2_890_000, "TIME": 86_400, "TIMESTAMP": 250_000_000_000, "TIMESTAMP WITH TIME ZONE": 250_000_000_000, "INTERVAL": 1 << 31, "UUID": 1 << 48}
    return fixed.get(t.name, MOST if t.name in ("VARCHAR", "BLOB", "BIT", "JSON", "GEOMETRY") else 0)


def orderable(t: LogicalType) -> bool:
    """Whether generated values grow with their index."""
    return t.name in NUMERIC or t.name in ("VARCHAR", "DATE", "TIME", "TIMESTAMP", "TIMESTAMP WITH TIME ZONE", "INTERVAL")
