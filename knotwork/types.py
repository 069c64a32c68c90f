"""Engine types, their names, and the Spark types that hold them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from knotwork.errors import BinderError


@dataclass(frozen=True)
class Ty:
    """A type: name, and for nested ones their parts."""

    name: str
    args: tuple = ()  # LIST, ARRAY: element; MAP: key, value; STRUCT, UNION: fields' types
    fields: tuple = ()
    size: int = 0  # ARRAY: length; DECIMAL: precision
    scale: int = 0

    def __str__(self) -> str:
        if self.name == "LIST":
            return f"{self.args[0]}[]"
        if self.name == "ARRAY":
            return f"{self.args[0]}[{self.size}]"
        if self.name == "MAP":
            return f"MAP({self.args[0]}, {self.args[1]})"
        if self.name in ("STRUCT", "UNION"):
            return f"{self.name}({', '.join(f'{f} {a}' for f, a in zip(self.fields, self.args, strict=True))})"
        if self.name == "DECIMAL":
            return f"DECIMAL({self.size}, {self.scale})"
        return self.name

    @property
    def integer(self) -> bool:
        return self.name in INTEGERS

    @property
    def floating(self) -> bool:
        return self.name in ("DOUBLE", "FLOAT")

    @property
    def numeric(self) -> bool:
        return self.integer or self.floating or self.name == "DECIMAL"

    @property
    def temporal(self) -> bool:
        return self.name == "DATE" or self.name.startswith("TIMESTAMP")

    @property
    def stamp(self) -> bool:
        return self.name.startswith("TIMESTAMP")

    @property
    def listy(self) -> bool:
        return self.name in ("LIST", "ARRAY")

    def field(self, name: str) -> Ty | None:
        return next((a for f, a in zip(self.fields, self.args, strict=True) if f.lower() == name.lower()), None)


#: Whole-number types by width; signed ones first.
SIGNED = ["INT8", "INT16", "INT32", "INT64", "INT128"]
UNSIGNED = ["UINT8", "UINT16", "UINT32", "UINT64", "UINT128"]
INTEGERS = frozenset([*SIGNED, *UNSIGNED, "SERIAL"])

ANY, BOOL, INT64, DOUBLE, STRING, DATE, TIMESTAMP, INT128, BLOB = (Ty(x) for x in ("ANY", "BOOL", "INT64", "DOUBLE", "STRING", "DATE", "TIMESTAMP", "INT128", "BLOB"))
INTERVAL, UUID, JSON, NODE, REL, PATH, INTERNAL_ID = (Ty(x) for x in ("INTERVAL", "UUID", "JSON", "NODE", "REL", "RECURSIVE_REL", "INTERNAL_ID"))


def list_of(t: Ty) -> Ty:
    return Ty("LIST", (t,))


_SPARK = {
    "BOOL": T.BooleanType(), "INT8": T.ByteType(), "INT16": T.ShortType(), "INT32": T.IntegerType(), "INT64": T.LongType(), "SERIAL": T.LongType(), "INT128": T.DecimalType(38, 0), "UINT8": T.ShortType(), "UINT16": T.IntegerType(),
    "UINT32": T.LongType(), "UINT64": T.DecimalType(20, 0), "UINT128": T.DecimalType(38, 0), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(), "STRING": T.StringType(), "JSON": T.StringType(), "UUID": T.StringType(), "BLOB": T.BinaryType(),
    "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMP_NS": T.TimestampNTZType(), "TIMESTAMP_MS": T.TimestampNTZType(), "TIMESTAMP_SEC": T.TimestampNTZType(), "TIMESTAMP_TZ": T.TimestampType(), "ANY": T.NullType(),
    "INTERVAL": T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())]),
    "INTERNAL_ID": T.StructType([T.StructField("table", T.LongType()), T.StructField("offset", T.LongType())]),
}

#: Inclusive bounds of the types whose Spark type is wider.
BOUNDS = {"UINT8": (0, 2**8 - 1), "UINT16": (0, 2**16 - 1), "UINT32": (0, 2**32 - 1), "UINT64": (0, 2**64 - 1), "UINT128": (0, 10**38 - 1)}


def spark_type(t: Ty) -> T.DataType:
    if t.listy:
        return T.ArrayType(spark_type(t.args[0]))
    if t.name == "MAP":
        return T.ArrayType(T.StructType([T.StructField("key", spark_type(t.args[0])), T.StructField("value", spark_type(t.args[1]))]))
    if t.name in ("STRUCT", "NODE", "REL", "RECURSIVE_REL"):
        return T.StructType([T.StructField(f, spark_type(a)) for f, a in zip(t.fields, t.args, strict=True)])
    if t.name == "UNION":
        return T.StructType([T.StructField("tag", T.StringType()), *[T.StructField(f, spark_type(a)) for f, a in zip(t.fields, t.args, strict=True)]])
    if t.name == "DECIMAL":
        return T.DecimalType(t.size, t.scale)
    return _SPARK[t.name]


def engine_type(s: T.DataType) -> Ty:
    """The engine type of a Spark column."""
    simple = {T.BooleanType: "BOOL", T.ByteType: "INT8", T.ShortType: "INT16", T.IntegerType: "INT32", T.LongType: "INT64", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT", T.StringType: "STRING", T.BinaryType: "BLOB", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMP_TZ", T.NullType: "ANY"}
    if type(s) in simple:
        return Ty(simple[type(s)])
    if isinstance(s, T.DecimalType):
        return INT128 if (s.precision, s.scale) == (38, 0) else Ty("UINT64") if (s.precision, s.scale) == (20, 0) else Ty("DECIMAL", size=s.precision, scale=s.scale)
    if isinstance(s, T.ArrayType):
        e = s.elementType
        if isinstance(e, T.StructType) and e.fieldNames() == ["key", "value"]:
            return Ty("MAP", (engine_type(e["key"].dataType), engine_type(e["value"].dataType)))
        return list_of(engine_type(e))
    if isinstance(s, T.MapType):
        return Ty("MAP", (engine_type(s.keyType), engine_type(s.valueType)))
    if isinstance(s, T.StructType):
        names = s.fieldNames()
        if names == ["months", "days", "micros"]:
            return INTERVAL
        if names == ["table", "offset"]:
            return INTERNAL_ID
        if names[:1] == ["tag"] and len(names) > 1:
            return Ty("UNION", tuple(engine_type(f.dataType) for f in s.fields[1:]), tuple(names[1:]))
        return Ty("STRUCT", tuple(engine_type(f.dataType) for f in s.fields), tuple(names))
    raise BinderError(f"No type for {s.simpleString()}.")


_ALIAS = {"INT": "INT32", "INTEGER": "INT32", "BIGINT": "INT64", "SMALLINT": "INT16", "TINYINT": "INT8", "BOOLEAN": "BOOL", "VARCHAR": "STRING", "BYTEA": "BLOB", "NUMERIC": "DECIMAL", "DURATION": "INTERVAL", "REAL": "FLOAT", "HUGEINT": "INT128"}


def _split(text: str) -> list[str]:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if c == "," and depth == 0:
            parts.append(text[at:i])
            at = i + 1
    return [p.strip() for p in [*parts, text[at:]] if p.strip()]


def parse_type(text: str, aliases: dict[str, Ty] | None = None) -> Ty:
    """The type that a name stands for."""
    s = text.strip()
    m = re.search(r"\[\s*(\d*)\s*\]$", s)
    if m:
        inner = parse_type(s[: m.start()], aliases)
        if m[1] == "0":
            raise BinderError("The number of elements in an array must be greater than 0.")
        return Ty("ARRAY", (inner,), size=int(m[1])) if m[1] else list_of(inner)
    m = re.match(r"(\w+)\s*\((.*)\)$", s, re.S)
    name = (m[1] if m else s).upper()
    name = _ALIAS.get(name, name)
    if m and name in ("STRUCT", "UNION"):
        fields = []
        for k, p in enumerate(_split(m[2])):
            f = re.match(r"`?(\w+)`?\s+(.*)$", p, re.S)
            fields.append((f[1], parse_type(f[2], aliases)) if f else (f"_{k}", parse_type(p, aliases)))
        return Ty(name, tuple(a for _, a in fields), tuple(f for f, _ in fields))
    if m and name == "MAP":
        k, v = _split(m[2])
        return Ty("MAP", (parse_type(k, aliases), parse_type(v, aliases)))
    if name == "DECIMAL":
        p, sc = map(int, _split(m[2])) if m else (18, 3)
        return Ty("DECIMAL", size=p, scale=sc)
    if aliases and name in aliases:
        return aliases[name]
    if name in _SPARK and name != "ANY" and not m:
        return Ty(name)
    raise BinderError(f"{text} is neither an internal type nor a user defined type.")


def common(a: Ty, b: Ty) -> Ty | None:
    """The type that both can be taken as without loss, or None."""
    if a == b or b.name == "ANY":
        return a
    if a.name == "ANY":
        return b
    if a.integer and b.integer:
        x, y = ("INT64" if t.name == "SERIAL" else t.name for t in (a, b))
        if (x in SIGNED) == (y in SIGNED):
            order = SIGNED if x in SIGNED else UNSIGNED
            return Ty(max(x, y, key=order.index))
        s, u = (x, y) if x in SIGNED else (y, x)
        return Ty(SIGNED[min(4, max(SIGNED.index(s), UNSIGNED.index(u) + 1))])
    if a.numeric and b.numeric:
        if "DOUBLE" in (a.name, b.name):
            return DOUBLE
        if "FLOAT" in (a.name, b.name):
            return Ty("FLOAT") if "DECIMAL" not in (a.name, b.name) else DOUBLE
        d, o = (a, b) if a.name == "DECIMAL" else (b, a)
        if o.integer:
            digits = {"INT8": 3, "INT16": 5, "INT32": 10, "UINT8": 3, "UINT16": 5, "UINT32": 10}.get(o.name, 19)
            return Ty("DECIMAL", size=min(38, max(d.size - d.scale, digits) + d.scale), scale=d.scale)
        scale = max(a.scale, b.scale)
        return Ty("DECIMAL", size=min(38, max(a.size - a.scale, b.size - b.scale) + scale), scale=scale)
    if a.temporal and b.temporal:
        return a if a.stamp else b if b.stamp else a
    if a.listy and b.listy:
        inner = common(a.args[0], b.args[0])
        return a if a == b else list_of(inner) if inner else None
    if a.name == b.name == "STRUCT" and [f.lower() for f in a.fields] == [f.lower() for f in b.fields]:
        inner = [common(x, y) for x, y in zip(a.args, b.args, strict=True)]
        return Ty("STRUCT", tuple(inner), a.fields) if all(inner) else None
    if a.name == b.name == "MAP":
        inner = [common(x, y) for x, y in zip(a.args, b.args, strict=True)]
        return Ty("MAP", tuple(inner)) if all(inner) else None
    return None
