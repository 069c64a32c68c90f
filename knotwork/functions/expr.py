"""Typed expressions, casts, arithmetic and comparison, as Spark columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from knotwork.errors import BinderError
from knotwork.types import ANY, BOOL, BOUNDS, DATE, DOUBLE, INT64, INTERVAL, STRING, TIMESTAMP, Ty, common, list_of, spark_type


@dataclass
class E:
    """A column and its engine type. const: the value of a literal; no_nan: a stored property known to hold no NaN."""

    col: Column
    ty: Ty
    const: Any = None
    is_const: bool = False
    no_nan: bool = False
    entity: Any = None  # the node, relationship or path that the expression stands for


def lit(v: Any, ty: Ty | None = None) -> E:
    if isinstance(v, bool):
        return E(F.lit(v), BOOL, v, True)
    if isinstance(v, int):
        if ty is None:
            ty = INT64 if -(2**63) <= v < 2**63 else Ty("INT128")
        return E(F.lit(str(v)).cast(spark_type(ty)) if ty.name == "INT128" else F.lit(v).cast(spark_type(ty)), ty, v, True)
    if isinstance(v, float):
        return E(F.lit(v), DOUBLE, v, True)
    if isinstance(v, str):
        return E(F.lit(v), STRING, v, True)
    if v is None:
        return E(F.lit(None), ANY, None, True)
    if isinstance(v, (list, tuple)):
        return make_list([lit(x) for x in v])
    if isinstance(v, dict):
        items = {k: lit(x) for k, x in v.items()}
        return struct_of(items)
    import datetime
    import decimal

    if isinstance(v, datetime.datetime):
        return E(F.lit(v).cast("timestamp_ntz"), TIMESTAMP, v, True)
    if isinstance(v, datetime.date):
        return E(F.lit(v), DATE, v, True)
    if isinstance(v, decimal.Decimal):
        digits = v.as_tuple()
        scale = max(0, -digits.exponent)
        return E(F.lit(v), Ty("DECIMAL", size=max(len(digits.digits), scale), scale=scale), v, True)
    if isinstance(v, bytes):
        return E(F.lit(bytearray(v)), Ty("BLOB"), v, True)
    raise BinderError(f"No type for a value of {type(v).__name__}.")


def struct_of(items: dict[str, E]) -> E:
    return E(F.struct(*[e.col.alias(k) for k, e in items.items()]), Ty("STRUCT", tuple(e.ty for e in items.values()), tuple(items)))


def common_of(es: list[E], what: str) -> Ty:
    out = ANY
    for e in es:
        t = common(out, e.ty)
        if t is None:
            raise BinderError(f"Cannot find a common type of {out} and {e.ty} in {what}.")
        out = t
    return out


def make_list(es: list[E]) -> E:
    t = common_of(es, "a list")
    if not es:
        return E(F.array(), list_of(ANY))
    return E(F.array(*[cast(e, t).col for e in es]), list_of(t), is_const=all(e.is_const for e in es), const=[e.const for e in es])


def null_if_any(cols: list[Column], then: Column) -> Column:
    cols = list(cols)
    if not cols:
        return then
    return F.when(reduce(lambda a, b: a | b, [c.isNull() for c in cols]), F.lit(None)).otherwise(then)


def micros(c: Column) -> Column:
    """Microseconds of an NTZ timestamp since the epoch."""
    return F.unix_micros(c.cast("timestamp"))


def interval(months: Any = 0, days: Any = 0, us: Any = 0) -> E:
    col = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
    return E(F.struct(col(months, "int").alias("months"), col(days, "int").alias("days"), col(us, "bigint").alias("micros")), INTERVAL)


def spark_interval(c: Column) -> Column:
    zero = F.lit(0)
    return F.make_interval(zero, c["months"], zero, c["days"], zero, zero, (c["micros"].cast("decimal(20,0)") / F.lit(1000000)).cast("decimal(18,6)"))


def interval_text(c: Column) -> Column:
    """Y years M months D days HH:MM:SS[.f]."""
    y, m = F.call_function("div", c["months"], F.lit(12)), c["months"] % 12
    part = lambda n, w: F.when(n != 0, F.concat(n.cast("string"), F.when(F.abs(n) == 1, f" {w}").otherwise(f" {w}s")))
    us = c["micros"]
    s = F.call_function("div", F.abs(us), F.lit(1000000))
    clock = F.concat(F.when(us < 0, "-").otherwise(""), F.format_string("%02d:%02d:%02d", F.call_function("div", s, F.lit(3600)), F.call_function("div", s, F.lit(60)) % 60, s % 60))
    clock = F.when(us % 1000000 != 0, F.concat(clock, F.lit("."), F.regexp_replace(F.lpad((F.abs(us) % 1000000).cast("string"), 6, "0"), "0+$", ""))).otherwise(clock)
    shown = F.when((us != 0) | ((c["months"] == 0) & (c["days"] == 0)), clock)
    return F.when(c.isNotNull(), F.concat_ws(" ", part(y, "year"), part(m, "month"), part(c["days"], "day"), shown))


def parse_interval(c: Column) -> Column:
    """'2 years 3 days 01:02:03.5' and the like."""
    amount = lambda *units: F.coalesce(F.regexp_extract(c, rf"(?i)(-?\d+)\s*(?:{'|'.join(units)})\b", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    clock = lambda k: F.coalesce(F.regexp_extract(c, r"(-?)(\d{1,3}):(\d{2}):(\d{2})(?:\.(\d{1,6}))?", k).try_cast("bigint"), F.lit(0).cast("bigint"))
    fraction = F.coalesce(F.rpad(F.regexp_extract(c, r"\d:\d{2}:\d{2}\.(\d{1,6})", 1), 6, "0").try_cast("bigint"), F.lit(0).cast("bigint"))
    sign = F.when(c.rlike(r"-\d{1,3}:\d{2}:\d{2}"), -1).otherwise(1)
    months = amount("years?", "yrs?", "y") * 12 + amount("months?", "mons?") + amount("decades?") * 120 + amount("centur(?:y|ies)") * 1200 + amount("quarters?") * 3
    days = amount("days?", "d") + amount("weeks?", "w") * 7
    us = amount("hours?", "hrs?", "h") * 3_600_000_000 + amount("minutes?", "mins?", "m") * 60_000_000 + amount("seconds?", "secs?", "s") * 1_000_000 + amount("milliseconds?", "ms") * 1000 + amount("microseconds?", "us")
    us = us + sign * (clock(2) * 3_600_000_000 + clock(3) * 60_000_000 + clock(4) * 1_000_000 + fraction)
    out = interval(months, days, us).col
    return F.when(c.isNull(), F.lit(None)).when(c.rlike(r"\d"), out).otherwise(F.raise_error(F.concat(F.lit("Conversion exception: Error occurred during parsing interval: "), c)))


def text_of(c: Column, t: Ty) -> Column:
    """A value as results show it."""
    if t.name == "BOOL":
        return F.when(c, "True").when(~c, "False")
    if t.floating:
        return F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").when(c.isNotNull(), F.format_string("%.6f", c))
    if t.listy:
        inside = F.transform(c, lambda x: F.coalesce(text_of(x, t.args[0]), F.lit("")))
        return F.when(c.isNotNull(), F.concat(F.lit("["), F.array_join(inside, ","), F.lit("]")))
    if t.name == "MAP":
        inside = F.transform(c, lambda x: F.concat(F.coalesce(text_of(x["key"], t.args[0]), F.lit("")), F.lit("="), F.coalesce(text_of(x["value"], t.args[1]), F.lit(""))))
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.array_join(inside, ", "), F.lit("}")))
    if t.name == "STRUCT":
        parts = [F.concat(F.lit(f"{f}: "), F.coalesce(text_of(c[f], a), F.lit(""))) for f, a in zip(t.fields, t.args, strict=True)]
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))
    if t.name == "UNION":
        out = F.lit(None).cast("string")
        for f, a in zip(t.fields, t.args, strict=True):
            out = F.when(c["tag"] == f, text_of(c[f], a)).otherwise(out)
        return out
    if t.name == "INTERVAL":
        return interval_text(c)
    if t.name == "INTERNAL_ID":
        return F.concat_ws(":", c["table"], c["offset"])
    if t.name == "BLOB":
        return F.when(c.isNotNull(), F.concat_ws("", F.transform(F.split(F.regexp_replace(F.hex(c), "(..)", "$1 "), " "), lambda h: F.when(h == "", "").otherwise(F.when(F.conv(h, 16, 10).cast("int").between(32, 126) & (h != "5C"), F.char(F.conv(h, 16, 10).cast("bigint"))).otherwise(F.concat(F.lit("\\x"), h))))))
    if t.name == "TIMESTAMP_TZ":
        return F.concat(F.regexp_replace(c.cast("string"), r"$", ""), F.lit("+00"))
    return c.cast("string")


def _bounded(c: Column, t: Ty) -> Column:
    low, high = BOUNDS[t.name]
    wide = c.cast("decimal(38,0)")
    problem = F.raise_error(F.concat(F.lit("Overflow exception: Value "), wide.cast("string"), F.lit(f" is not within {t.name} range")))
    return F.when((wide < F.lit(str(low)).cast("decimal(38,0)")) | (wide > F.lit(str(high)).cast("decimal(38,0)")), problem).otherwise(c.cast(spark_type(t)))


def cast(e: E, t: Ty, explicit: bool = False) -> E:
    """e as type t. explicit: by CAST, which does more than what is done unasked."""
    a, c = e.ty, e.col
    if a == t:
        return e
    st = spark_type(t)
    if a.name == "ANY":
        return E(F.lit(None).cast(st) if e.is_const else c.cast(st), t, None, e.is_const)
    keep = {"const": e.const, "is_const": e.is_const, "no_nan": e.no_nan}
    if t.name == "STRING":
        return E(text_of(c, a), t)
    if (a.name == "BOOL" and t.numeric) or (t.name == "BOOL" and a.numeric):
        raise BinderError(f"Unsupported casting function from {a} to {t}.")
    if t.integer:
        if a.floating:
            c = F.bround(c.cast("double"), 0)
            if t.name in ("INT128", "UINT64", "UINT128"):
                c = c.cast("decimal(38,0)")
        elif a.name == "DECIMAL":
            c = F.round(c, 0)
        elif a.name == "STRING":
            s = F.trim(c)
            c = F.when(s.rlike(r"^-?\d+$"), s).otherwise(F.raise_error(F.concat(F.lit('Conversion exception: Cast failed. Could not convert "'), c, F.lit(f'" to {t}.'))))
            c = c if t.name in BOUNDS or t.name == "INT128" else c.cast("decimal(38,0)")
            c = c.cast("decimal(38,0)")
        elif not a.integer:
            raise BinderError(f"Unsupported casting function from {a} to {t}.")
        return E(_bounded(c, t) if t.name in BOUNDS else c.cast(st), t, **keep)
    if t.floating:
        if not (a.numeric or a.name == "STRING"):
            raise BinderError(f"Unsupported casting function from {a} to {t}.")
        return E((F.trim(c) if a.name == "STRING" else c).cast(st), t, **keep)
    if t.name == "DECIMAL":
        return E(c.cast(st), t, **keep)
    if t.name == "BOOL":
        return E(F.trim(c).cast("boolean"), t)
    if t.name == "DATE":
        return E(c.cast("date"), t)
    if t.stamp:
        src = c.cast("timestamp") if a.name == "TIMESTAMP_TZ" else c
        out = src.cast("timestamp") if t.name == "TIMESTAMP_TZ" else src.cast("timestamp_ntz")
        unit = {"TIMESTAMP_MS": "MILLISECOND", "TIMESTAMP_SEC": "SECOND"}.get(t.name)
        if unit:
            out = F.date_trunc(unit, out.cast("timestamp")).cast("timestamp_ntz")
        return E(out, t)
    if t.name == "INTERVAL" and a.name == "STRING":
        return E(parse_interval(c), t)
    if t.name == "UUID" and a.name == "STRING":
        bare = F.lower(F.regexp_replace(c, "[-{}]", ""))
        made = F.regexp_replace(bare, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
        return E(F.when(c.isNull(), None).when(bare.rlike("^[0-9a-f]{32}$"), made).otherwise(F.raise_error(F.concat(F.lit("Conversion exception: Invalid UUID: "), c))), t)
    if t.name == "BLOB" and a.name == "STRING":
        parts = F.regexp_extract_all(c, F.lit(r"(\\x[0-9a-fA-F]{2}|[\s\S])"), F.lit(1))
        return E(F.unhex(F.array_join(F.transform(parts, lambda p: F.when(p.startswith("\\x") & (F.length(p) == 4), F.substring(p, 3, 2)).otherwise(F.hex(F.encode(p, "UTF-8")))), "")), t)
    if t.name == "JSON":
        return E(F.to_json(c) if a.name == "STRUCT" else F.when(c.isNull(), None).otherwise(c), t)
    if t.listy:
        if a.name == "STRING":
            inner = F.regexp_extract(c, r"^\s*\[([\s\S]*)\]\s*$", 1)
            if t.args[0].listy:
                return E(F.from_json(c, st.simpleString()), t)
            parts = F.when(F.trim(inner) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), F.trim))
            return E(F.when(c.isNotNull(), F.transform(parts, lambda x: cast(E(F.when(x != "", x), STRING), t.args[0], True).col)), t)
        if not a.listy:
            raise BinderError(f"Unsupported casting function from {a} to {t}.")
        out = F.transform(c, lambda x: cast(E(x, a.args[0]), t.args[0], explicit).col) if a.args[0] != t.args[0] else c
        if t.name == "ARRAY" and not (a.name == "ARRAY" and a.size == t.size):
            out = F.when(c.isNull(), None).when(F.size(c) == t.size, out).otherwise(F.raise_error(F.concat(F.lit(f"Conversion exception: Unsupported casting LIST with incorrect list entry to ARRAY. Expected: {t.size}, Actual: "), F.size(c).cast("string"))))
        return E(out, t)
    if t.name == "STRUCT" and a.name == "STRUCT" and len(a.fields) == len(t.fields) and all(x.lower() == y.lower() for x, y in zip(a.fields, t.fields, strict=True)):
        made = F.struct(*[cast(E(c[f], x), y, explicit).col.alias(g) for f, g, x, y in zip(a.fields, t.fields, a.args, t.args, strict=True)])
        return E(F.when(c.isNotNull(), made), t)
    if t.name == "STRUCT" and a.name == "STRING":
        return E(F.from_json(c, st.simpleString()), t)
    if t.name == "MAP" and a.name == "MAP":
        made = F.transform(c, lambda x: F.struct(cast(E(x["key"], a.args[0]), t.args[0], explicit).col.alias("key"), cast(E(x["value"], a.args[1]), t.args[1], explicit).col.alias("value")))
        return E(made, t)
    if t.name == "UNION":
        return E(_to_union(e, t), t)
    raise BinderError(f"Unsupported casting function from {a} to {t}.")


def _to_union(e: E, t: Ty) -> Column:
    """The member of the same type, else the first one that a string or a number can be read as."""
    def made(field: str, value: Column) -> Column:
        return F.struct(F.lit(field).alias("tag"), *[(value if f == field else F.lit(None)).cast(spark_type(a)).alias(f) for f, a in zip(t.fields, t.args, strict=True)])

    if e.ty.name == "UNION":
        out = F.lit(None)
        for f, a in zip(e.ty.fields, e.ty.args, strict=True):
            if t.field(f) is None:
                raise BinderError(f"Unsupported casting function from {e.ty} to {t}.")
            out = F.when(e.col["tag"] == f, made(f, cast(E(e.col[f], a), t.field(f)).col)).otherwise(out)
        return out
    for f, a in zip(t.fields, t.args, strict=True):
        if a == e.ty:
            return F.when(e.col.isNotNull(), made(f, e.col))
    if e.ty.name == "STRING":
        out = F.lit(None)
        for f, a in reversed(list(zip(t.fields, t.args, strict=True))):
            tried = e.col.try_cast(spark_type(a))
            if a.name in BOUNDS:
                tried = F.when(tried.between(*[F.lit(str(x)).cast("decimal(38,0)") for x in BOUNDS[a.name]]), tried)
            out = F.when(tried.isNotNull(), made(f, tried)).otherwise(out)
        return out
    for f, a in zip(t.fields, t.args, strict=True):
        if common(a, e.ty) == a:
            return F.when(e.col.isNotNull(), made(f, cast(e, a).col))
    raise BinderError(f"Unsupported casting function from {e.ty} to {t}.")


def _numbers(a: E, b: E, op: str) -> tuple[E, E, Ty]:
    t = common(a.ty, b.ty)
    if t is None or not (t.numeric or t.name == "ANY"):
        raise BinderError(f"Cannot match a built-in function for given function {op}({a.ty},{b.ty}).")
    t = INT64 if t.name in ("ANY", "SERIAL") else t
    return cast(a, t), cast(b, t), t


def arithmetic(op: str, a: E, b: E) -> E:
    x, y = a.ty, b.ty
    if op == "+":
        if x.name == "STRING" and y.name == "STRING":
            return E(F.concat(a.col, b.col), STRING)
        if x.listy and y.listy:
            t = common(list_of(x.args[0]), list_of(y.args[0]))
            if t is None:
                raise BinderError(f"Cannot match a built-in function for given function +({x},{y}).")
            return E(F.concat(cast(E(a.col, list_of(x.args[0])), t).col, cast(E(b.col, list_of(y.args[0])), t).col), t)
        if x.integer and y.temporal:
            return arithmetic("+", b, a)
        if x.name == "INTERVAL" and y.temporal:
            return arithmetic("+", b, a)
    if op in "+-":
        if x.name == "DATE" and y.integer:
            days = cast(b, Ty("INT32")).col
            return E(F.date_add(a.col, days if op == "+" else -days), DATE)
        if x.temporal and y.name == "INTERVAL":
            i = spark_interval(b.col)
            if x.name == "DATE":
                s = F.make_interval(F.lit(0), b.col["months"], F.lit(0), b.col["days"] + F.call_function("div", b.col["micros"], F.lit(86_400_000_000)).cast("int"))
                base = a.col.cast("timestamp_ntz")
                return E((base + s if op == "+" else base - s).cast("date"), DATE)
            return E(a.col + i if op == "+" else a.col - i, x)
        if op == "-" and x.name == "DATE" and y.name == "DATE":
            return E(F.datediff(a.col, b.col).cast("bigint"), INT64)
        if op == "-" and x.temporal and y.temporal:
            us = micros(a.col.cast("timestamp_ntz")) - micros(b.col.cast("timestamp_ntz"))
            day = F.lit(86_400_000_000)
            return E(F.when(us.isNotNull(), interval(0, F.call_function("div", us, day), us % day).col), INTERVAL)
        if x.name == "INTERVAL" and y.name == "INTERVAL":
            s = 1 if op == "+" else -1
            return E(F.when(a.col.isNotNull() & b.col.isNotNull(), interval(*[a.col[f] + b.col[f] * s for f in ("months", "days", "micros")]).col), INTERVAL)
    if op == "*" and x.integer and y.name == "INTERVAL":
        return arithmetic("*", b, a)
    if x.name == "INTERVAL" and y.integer and op in "*/":
        n = cast(b, INT64).col
        if op == "*":
            return E(F.when(a.col.isNotNull() & n.isNotNull(), interval(*[a.col[f] * n for f in ("months", "days", "micros")]).col), INTERVAL)
        div = lambda u, v: F.call_function("div", u, v)
        days = a.col["days"] + (a.col["months"] % n) * 30
        us = a.col["micros"] + (days % n) * F.lit(86_400_000_000)
        return E(F.when(a.col.isNotNull() & n.isNotNull(), interval(div(a.col["months"].cast("bigint"), n), div(days.cast("bigint"), n), div(us, n)).col), INTERVAL)
    if "STRING" in (x.name, y.name):
        raise BinderError(f"Cannot match a built-in function for given function {op}({x},{y}).")
    a, b, t = _numbers(a, b, op)
    if t.name == "DECIMAL":
        if op == "/":
            return arithmetic("/", cast(a, DOUBLE), cast(b, DOUBLE))
        if op == "*":
            if x.size + y.size + 1 > 38 and x.name == y.name == "DECIMAL":
                raise BinderError(f"Resulting precision of {x.size + y.size + 1} in decimal multiplication is out of range [1,38].")
            out = Ty("DECIMAL", size=min(38, t.size * 2 + 1), scale=min(37, t.scale * 2))
        else:
            out = Ty("DECIMAL", size=min(38, t.size + (op in "+-")), scale=t.scale)
        made = {"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col, "%": a.col % b.col}[op]
        return E(made.cast(spark_type(out)), out)
    st = spark_type(t)
    if op == "/":
        if t.integer:
            return E(F.call_function("div", a.col, b.col).cast(st), t)
        if b.is_const and b.const:
            return E((a.col / b.col).cast(st), t)
        special = F.when((a.col == 0) | F.isnan(a.col), float("nan")).when(a.col > 0, float("inf")).when(a.col < 0, float("-inf"))
        return E(F.when(b.col == 0, special).otherwise(F.try_divide(a.col, b.col)).cast(st), t)
    if op == "%" and t.floating and not (b.is_const and b.const):
        return E(F.when(b.col == 0, F.when(a.col.isNotNull(), float("nan"))).otherwise(a.col % b.col).cast(st), t)
    made = {"+": lambda: a.col + b.col, "-": lambda: a.col - b.col, "*": lambda: a.col * b.col, "%": lambda: a.col % b.col}[op]()
    return E(made.cast(st) if t.name in ("INT128", *BOUNDS) else made, t, no_nan=a.no_nan and b.no_nan)


def sort_key(c: Column, t: Ty) -> Column:
    """A column that orders as the language does: inside lists and structs, NULL is greatest; intervals by their length."""
    if t.listy and t.args[0].name not in ("NODE", "REL"):
        return F.transform(c, lambda x: F.struct(x.isNull().alias("n"), sort_key(x, t.args[0]).alias("v")))
    if t.name == "STRUCT":
        parts = [p for f, a in zip(t.fields, t.args, strict=True) for p in (c[f].isNull(), sort_key(c[f], a))]
        return F.when(c.isNotNull(), F.struct(*[p.alias(f"p{k}") for k, p in enumerate(parts)]))
    if t.name == "INTERVAL":
        return (c["months"].cast("decimal(38,0)") * 30 + c["days"]) * F.lit(86_400_000_000) + c["micros"]
    return c


def compare(op: str, a: E, b: E) -> E:
    """A comparison by the rules of the language: composites by their parts with NULL greatest, NaN less than anything."""
    x, y = a.ty, b.ty
    if a.entity is not None and b.entity is not None:
        return E(entity_equal(a, b) if op == "=" else ~entity_equal(a, b), BOOL)
    t = common(x, y)
    if t is None:
        if x.name == "STRING" and not (y.listy or y.name in ("STRUCT", "MAP", "UNION", "NODE", "REL")):
            a, t = cast(a, y), y
        elif y.name == "STRING" and not (x.listy or x.name in ("STRUCT", "MAP", "UNION", "NODE", "REL")):
            b, t = cast(b, x), x
        else:
            raise BinderError(f"Type Mismatch: Cannot compare types {x} and {y}.")
    a, b = cast(a, t), cast(b, t)
    p, q = a.col, b.col
    if t.name == "INTERVAL" or op not in ("=", "<>"):
        p, q = sort_key(p, t), sort_key(q, t)
    made = {"=": lambda: p == q, "<>": lambda: p != q, "<": lambda: p < q, "<=": lambda: p <= q, ">": lambda: p > q, ">=": lambda: p >= q}[op]()
    if t.floating:
        odd = [e.col for e in (a, b) if not e.no_nan and not (e.is_const and e.const == e.const)]
        if odd:
            nan = reduce(lambda u, v: u | v, [F.isnan(c) for c in odd])
            if op in ("<", "<=", "<>"):
                made = made | (nan & p.isNotNull() & q.isNotNull())
            else:
                made = made & ~nan
    return E(made, BOOL)


def entity_equal(a: E, b: E) -> Column:
    x, y = a.entity, b.entity
    same = x.off() == y.off()
    known = x.kind == "node" and y.kind == "node" and len(x.tables) == len(y.tables) == 1 and x.tables[0].id == y.tables[0].id
    return same if known else same & (x.tab() == y.tab())


def truth(e: E) -> Column:
    if e.ty.name not in ("BOOL", "ANY"):
        raise BinderError(f"A condition has type {e.ty} but BOOL was expected.")
    return e.col.cast("boolean") if e.ty.name == "ANY" else e.col
