"""The scalar functions: name -> builder of a typed column. Everything is a Spark expression but gamma and lgamma.

A builder takes the typed arguments and the translator (for settings, lambdas and named arguments). Results are NULL if an
argument is, unless a function says otherwise."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.errors import BinderError
from knotwork.functions import expr as X
from knotwork.functions.expr import E, cast, lit
from knotwork.types import ANY, BLOB, BOOL, DATE, DOUBLE, INT64, INT128, INTERNAL_ID, INTERVAL, STRING, TIMESTAMP, UUID, Ty, common, list_of, parse_type, spark_type

FUNCTIONS: dict[str, Callable] = {}


def register(*names: str):
    def keep(f: Callable) -> Callable:
        for n in names:
            FUNCTIONS[n] = f
        return f

    return keep


def need(args: list[E], low: int, name: str, high: int | None = None) -> None:
    if not low <= len(args) <= (low if high is None else high):
        raise BinderError(f"Function {name} expects {low} arguments but got {len(args)}.")


def simple(names: str, types: list[Ty | None], result: Ty | None, build: Callable) -> None:
    """Functions whose arguments are cast to fixed types (None: left as they are; result None: the first one's type)."""

    for name in names.split():
        def f(args, tr, name=name):
            need(args, len(types), name)
            made = [cast(a, t) if t and a.ty != t else a for a, t in zip(args, types, strict=True)]
            return E(build(*[m.col for m in made]), result or made[0].ty)

        FUNCTIONS[name] = f


div = lambda a, b: F.call_function("div", a, b)


# -- operators
for _op in "+-*/%":
    FUNCTIONS[_op] = (lambda op: lambda args, tr: X.arithmetic(op, *args))(_op)
for _name, _op in (("equals", "="), ("not_equals", "<>"), ("less_than", "<"), ("less_than_equals", "<="), ("greater_than", ">"), ("greater_than_equals", ">=")):
    FUNCTIONS[_name] = (lambda op: lambda args, tr: X.compare(op, *args))(_op)


@register("negate")
def _negate(args, tr):
    (a,) = args
    if a.ty.name == "INTERVAL":
        return X.arithmetic("*", a, lit(-1))
    if not (a.ty.numeric or a.ty.name == "ANY"):
        raise BinderError(f"Cannot match a built-in function for given function NEGATE({a.ty}).")
    return E(-a.col, a.ty)


# -- mathematics
for _names, _f in (("acos", F.acos), ("asin", F.asin), ("atan", F.atan), ("cbrt", F.cbrt), ("cos", F.cos), ("cot", F.cot), ("degrees", F.degrees), ("exp", F.exp), ("radians", F.radians), ("sin", F.sin), ("sqrt", F.sqrt), ("tan", F.tan)):
    simple(_names, [DOUBLE], DOUBLE, _f)
for _names, _f in (("ln", F.ln), ("log log10", F.log10), ("log2", F.log2)):
    simple(_names, [DOUBLE], DOUBLE, (lambda g: lambda x: F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(g(x)))(_f))
simple("atan2", [DOUBLE, DOUBLE], DOUBLE, F.atan2)
simple("pow power", [DOUBLE, DOUBLE], DOUBLE, F.pow)
simple("even", [DOUBLE], DOUBLE, lambda x: (F.ceil(F.abs(x) / 2) * 2 * F.when(x < 0, -1).otherwise(1)).cast("double"))
simple("bitwise_and", [INT64, INT64], INT64, lambda a, b: a.bitwiseAND(b))
simple("bitwise_or", [INT64, INT64], INT64, lambda a, b: a.bitwiseOR(b))
simple("bitwise_xor", [INT64, INT64], INT64, lambda a, b: a.bitwiseXOR(b))
simple("bitshift_left", [INT64, INT64], INT64, lambda a, b: F.call_function("shiftleft", a, b.cast("int")))
simple("bitshift_right", [INT64, INT64], INT64, lambda a, b: F.call_function("shiftright", a, b.cast("int")))
simple("factorial", [INT64], INT64, lambda n: F.when(n.between(0, 20), F.factorial(n.cast("int"))).when(n.isNotNull(), F.raise_error(F.lit("Overflow exception: Cannot take factorial of this number."))))
simple("sign", [DOUBLE], INT64, lambda x: F.signum(x).cast("bigint"))


@register("abs")
def _abs(args, tr):
    need(args, 1, "ABS")
    return E(F.abs(args[0].col), args[0].ty if args[0].ty.numeric else INT64)


def _rounding(f: Callable) -> Callable:
    def build(args, tr):
        need(args, 1, "CEIL")
        a = args[0]
        if a.ty.integer:
            return a
        if a.ty.name == "DECIMAL":
            t = Ty("DECIMAL", size=a.ty.size, scale=0)
            return E(f(a.col).cast(spark_type(t)), t)
        a = a if a.ty.floating else cast(a, DOUBLE)
        # whole numbers beyond 2 ** 53 and the special values are their own ceiling and floor
        return E(F.when(F.abs(a.col) < 2.0**53, f(a.col).cast(spark_type(a.ty))).otherwise(a.col), a.ty)

    return build


FUNCTIONS["ceil"] = FUNCTIONS["ceiling"] = _rounding(F.ceil)
FUNCTIONS["floor"] = _rounding(F.floor)


@register("round")
def _round(args, tr):
    need(args, 1, "ROUND", 2)
    a = args[0]
    if len(args) == 1:
        return a if a.ty.integer else E(F.round(a.col, 0), a.ty)
    digits = cast(args[1], Ty("INT32"))
    x = cast(a, DOUBLE).col
    return E(F.round(x, digits.const if digits.is_const else digits.col), DOUBLE)


@F.pandas_udf(T.DoubleType())
def _gamma(x: pd.Series) -> pd.Series:
    def one(v):
        try:
            return math.gamma(v)
        except ValueError:
            return math.inf if v == 0 else math.nan
        except OverflowError:
            return math.inf

    return x.map(one, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def _lgamma(x: pd.Series) -> pd.Series:
    def one(v):
        try:
            return math.lgamma(v)
        except ValueError:
            return math.inf

    return x.map(one, na_action="ignore")


simple("gamma", [DOUBLE], DOUBLE, lambda x: _gamma(x))
simple("lgamma", [DOUBLE], DOUBLE, lambda x: _lgamma(x))
FUNCTIONS["pi"] = lambda args, tr: E(F.pi(), DOUBLE)


def _extreme(f: Callable, name: str) -> Callable:
    def build(args, tr):
        t = X.common_of(args, name)
        cols = [cast(a, t).col for a in args]
        return E(cols[0] if len(cols) == 1 else X.null_if_any(cols, f(*cols)), t)

    return build


FUNCTIONS["greatest"], FUNCTIONS["least"] = _extreme(F.greatest, "GREATEST"), _extreme(F.least, "LEAST")


@register("random")
def _random(args, tr):
    return E(F.rand(tr.session.seed) if tr.session.seed is not None else F.rand(), DOUBLE)


@register("setseed")
def _setseed(args, tr):
    tr.session.seed = int(float(args[0].const) * 2**31)
    return E(F.lit(None).cast("double"), DOUBLE)


# -- NULLs and utilities
@register("coalesce", "ifnull")
def _coalesce(args, tr):
    t = X.common_of(args, "COALESCE")
    t = STRING if t.name == "ANY" else t
    return E(F.coalesce(*[cast(a, t).col for a in args]), t)


FUNCTIONS["constant_or_null"] = lambda args, tr: E(X.null_if_any([a.col for a in args[1:]], args[0].col), args[0].ty)
FUNCTIONS["nullif"] = lambda args, tr: E(F.when(F.coalesce(X.compare("=", *args).col, F.lit(False)), F.lit(None)).otherwise(args[0].col), args[0].ty)
FUNCTIONS["count_if"] = lambda args, tr: E(F.when(X.truth(args[0]), 1).otherwise(0).cast("smallint"), Ty("UINT8"))
FUNCTIONS["current_date"] = lambda args, tr: E(F.current_date(), DATE)
FUNCTIONS["current_timestamp"] = lambda args, tr: E(F.current_timestamp(), Ty("TIMESTAMP_TZ"))
FUNCTIONS["gen_random_uuid"] = lambda args, tr: E(F.uuid(), UUID)
FUNCTIONS["typeof"] = lambda args, tr: lit(str(args[0].ty))
simple("error", [STRING], STRING, lambda m: F.raise_error(F.concat(F.lit("Runtime exception: "), m)))
simple("md5", [STRING], STRING, lambda s: F.md5(F.encode(s, "UTF-8")))
simple("sha256", [STRING], STRING, lambda s: F.sha2(F.encode(s, "UTF-8"), 256))
FUNCTIONS["hash"] = lambda args, tr: E(F.when(args[0].col.isNull(), F.lit(str(2**64 - 1)).cast("decimal(20,0)")).otherwise(F.pmod(F.xxhash64(args[0].col).cast("decimal(20,0)"), F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(20,0)")), Ty("UINT64"))
FUNCTIONS["internal_id"] = lambda args, tr: E(F.struct(cast(args[0], INT64).col.alias("table"), cast(args[1], INT64).col.alias("offset")), INTERNAL_ID)
FUNCTIONS["current_setting"] = lambda args, tr: lit(str(tr.session.settings.get(str(args[0].const).lower(), "")))


# -- casts
def _to(name: str, t: Ty) -> None:
    def build(args, tr):
        need(args, 1, name)
        a = args[0]
        if a.ty.name == "BOOL" and t.numeric:  # these aliases go through text
            return E(a.col.cast("int").cast(spark_type(t)), t)
        if a.ty.numeric and t.name == "BOOL":
            return E(a.col.cast("boolean"), t)
        return cast(a, t, True)

    FUNCTIONS[name] = build


for _n in ("INT8", "INT16", "INT32", "INT64", "INT128", "UINT8", "UINT16", "UINT32", "UINT64", "UINT128", "SERIAL", "DOUBLE", "FLOAT", "BOOL", "DATE", "STRING", "UUID", "BLOB", "INTERVAL"):
    _to(f"to_{_n.lower()}", Ty(_n))
for _n, _t in (("date", DATE), ("timestamp", TIMESTAMP), ("string", STRING), ("uuid", UUID), ("blob", BLOB), ("interval", INTERVAL), ("duration", INTERVAL)):
    _to(_n, _t)


@register("cast")
def _cast(args, tr):
    return cast(args[0], parse_type(str(args[1].const), tr.catalog.types), True)


# -- text
def _text(args: list[E]) -> list[Column]:
    return [cast(a, STRING).col for a in args]


FUNCTIONS["concat"] = lambda args, tr: E(F.concat_ws("", *_text(args)), STRING) if not args or args[0].ty.name != "BLOB" else E(F.concat(*[a.col for a in args]), BLOB)


@register("concat_ws")
def _concat_ws(args, tr):
    sep, *parts = _text(args)
    out: list[Column] = []
    for k, p in enumerate(parts):  # no separator after a NULL
        out.append(F.when(p.isNull(), "").otherwise(p if k == 0 else F.concat(F.when(parts[k - 1].isNull(), "").otherwise(sep), p)))
    return E(F.when(sep.isNotNull(), F.concat(*out)), STRING)


simple("contains", [STRING, STRING], BOOL, lambda s, n: F.contains(s, n) & (n != ""))
simple("ends_with suffix", [STRING, STRING], BOOL, F.endswith)
simple("starts_with prefix", [STRING, STRING], BOOL, F.startswith)
simple("encode", [STRING], BLOB, lambda s: F.encode(s, "UTF-8"))
simple("decode", [BLOB], STRING, lambda b: F.decode(b, "UTF-8"))
simple("lower lcase tolower", [STRING], STRING, F.lower)
simple("upper ucase toupper", [STRING], STRING, lambda s: F.upper(F.replace(s, F.lit("ß"), F.lit("ẞ"))))
simple("initcap", [STRING], STRING, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 2**31 - 1))))
simple("levenshtein", [STRING, STRING], INT64, lambda a, b: F.levenshtein(a, b).cast("bigint"))
simple("octet_length", [None], INT64, lambda b: F.octet_length(b).cast("bigint"))
simple("repeat", [STRING, INT64], STRING, lambda s, n: F.repeat(s, n.cast("int")))
simple("replace", [STRING, STRING, STRING], STRING, lambda s, a, b: F.when(a == "", s).otherwise(F.replace(s, a, b)))
simple("left", [STRING, INT64], STRING, lambda s, n: F.substring(s, F.lit(1), F.when(n >= 0, n).otherwise(F.greatest(F.length(s) + n, F.lit(0))).cast("int")))
simple("right", [STRING, INT64], STRING, lambda s, n: F.when(n == 0, "").otherwise(F.substring(s, F.when(n > 0, F.greatest(F.length(s) - n + 1, F.lit(1))).otherwise(1 - n).cast("int"), F.lit(2**31 - 1))))
simple("ltrim", [STRING], STRING, lambda s: F.regexp_replace(s, r"^(?U:\s)+", ""))
simple("rtrim", [STRING], STRING, lambda s: F.regexp_replace(s, r"(?U:\s)+$", ""))
simple("trim", [STRING], STRING, lambda s: F.regexp_replace(s, r"^(?U:\s)+|(?U:\s)+$", ""))
simple("lpad", [STRING, INT64, STRING], STRING, lambda s, n, p: F.when(n <= 0, "").otherwise(F.lpad(s, n.cast("int"), p)))
simple("rpad", [STRING, INT64, STRING], STRING, lambda s, n, p: F.when(n <= 0, "").otherwise(F.rpad(s, n.cast("int"), p)))
simple("split_part", [STRING, STRING, INT64], STRING, lambda s, d, n: F.when(n < 1, "").when(d == "", F.substring(s, n.cast("int"), F.lit(1))).otherwise(F.split_part(s, d, F.when(n < 1, 1).otherwise(n).cast("int"))))


@register("substr", "substring")
def _substring(args, tr):
    need(args, 2, "SUBSTRING", 3)
    s, a = cast(args[0], STRING).col, cast(args[1], INT64).col
    n = cast(args[2], INT64).col if len(args) > 2 else F.lit(2**31 - 1)
    return E(F.when(a < 1, "").otherwise(F.substring(s, a.cast("int"), F.greatest(n, F.lit(0)).cast("int"))), STRING)


FUNCTIONS["array_extract"] = lambda args, tr: FUNCTIONS["list_extract"](args, tr) if args[0].ty.listy else E(_char(cast(args[0], STRING).col, cast(args[1], INT64).col), STRING)


def _char(s: Column, i: Column) -> Column:
    return F.when(i == 0, "").when(F.abs(i) > F.length(s), "").otherwise(F.substring(s, i.cast("int"), F.lit(1)))


@register("str_split", "string_split", "string_to_array")
def _split(args, tr):
    s, d = _text(args)
    parts = F.when(d == "", F.split(s, "")).otherwise(F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E")), -1))
    return E(F.filter(parts, lambda x, i: (x != "") | (i == F.size(parts) - 1)), list_of(STRING))


# -- regular expressions: ASCII classes as in Java; a constant pattern that isn't valid matches nothing
def _valid(e: E) -> bool:
    if not e.is_const or e.const is None:
        return True
    import regex

    try:
        regex.compile(str(e.const))
        return True
    except regex.error:
        return False


def _regexp(f: Callable, empty: Callable) -> Callable:
    def build(args, tr):
        s, *rest = _text(args[:2])
        if not _valid(args[1]):
            return empty(s)
        return f(s, rest[0], args[2:])

    return build


FUNCTIONS["regexp_matches"] = _regexp(lambda s, p, more: E(F.regexp_like(s, p), BOOL), lambda s: E(F.when(s.isNotNull(), False), BOOL))
FUNCTIONS["regexp_full_match"] = _regexp(lambda s, p, more: E(F.regexp_like(s, F.concat(F.lit("^(?:"), p, F.lit(")\\z"))), BOOL), lambda s: E(F.when(s.isNotNull(), False), BOOL))
FUNCTIONS["regexp_extract"] = _regexp(lambda s, p, more: E(F.call_function("regexp_extract", s, p, cast(more[0], Ty("INT32")).col if more else F.lit(0)), STRING), lambda s: E(F.when(s.isNotNull(), ""), STRING))
FUNCTIONS["regexp_extract_all"] = _regexp(lambda s, p, more: E(F.regexp_extract_all(s, p, cast(more[0], Ty("INT32")).col if more else F.lit(0)), list_of(STRING)), lambda s: E(F.when(s.isNotNull(), F.array().cast("array<string>")), list_of(STRING)))
FUNCTIONS["regexp_split_to_array"] = _regexp(lambda s, p, more: E(F.split(s, p, -1), list_of(STRING)), lambda s: E(F.array(s), list_of(STRING)))


@register("regexp_replace")
def _regexp_replace(args, tr):
    need(args, 3, "REGEXP_REPLACE", 4)
    s, p, r = _text(args[:3])
    if not _valid(args[1]):
        return E(s, STRING)
    r = F.regexp_replace(F.regexp_replace(r, r"\$", r"\\\\\$"), r"\\(\d)", r"\$$1") if not args[2].is_const else F.lit(__import__("re").sub(r"\\(\d)", r"$\1", str(args[2].const).replace("$", "\\$")))
    if len(args) == 4 and "g" in str(args[3].const):
        return E(F.regexp_replace(s, p, r), STRING)
    # the first match only: everything before it can't be matched, everything after it is kept
    whole = F.call_function("regexp_extract", s, p, F.lit(0))
    at = F.regexp_instr(s, p)
    made = F.concat(F.substring(s, F.lit(1), at - 1), F.regexp_replace(whole, p, r), F.substring(s, at + F.length(whole), F.lit(2**31 - 1)))
    return E(F.when(F.regexp_like(s, p) & (whole != ""), made).otherwise(s), STRING)


# -- lists
def _list(e: E, name: str) -> E:
    if not (e.ty.listy or e.ty.name == "ANY"):
        raise BinderError(f"Cannot match a built-in function for given function {name}({e.ty}).")
    return e if e.ty.listy else E(e.col.cast("array<void>"), list_of(ANY))


def _element(e: E) -> Ty:
    return e.ty.args[0]


def _same(l_: E, x: E) -> tuple[Column, Column, Ty]:
    t = common(_element(l_), x.ty)
    if t is None:
        raise BinderError(f"Cannot find a common type of {_element(l_)} and {x.ty}.")
    return cast(E(l_.col, list_of(_element(l_))), list_of(t)).col, cast(x, t).col, t


@register("list_append", "array_append", "array_push_back")
def _append(args, tr):
    a, x, t = _same(_list(args[0], "LIST_APPEND"), args[1])
    return E(F.when(x.isNotNull(), F.concat(a, F.array(x))), list_of(t))


@register("list_prepend", "array_prepend", "array_push_front")
def _prepend(args, tr):
    a, x, t = _same(_list(args[0], "LIST_PREPEND"), args[1])
    return E(F.when(x.isNotNull(), F.concat(F.array(x), a)), list_of(t))


FUNCTIONS["list_concat"] = FUNCTIONS["list_cat"] = FUNCTIONS["array_concat"] = FUNCTIONS["array_cat"] = lambda args, tr: X.arithmetic("+", _list(args[0], "LIST_CONCAT"), _list(args[1], "LIST_CONCAT"))


@register("list_contains", "list_has", "array_contains", "array_has")
def _contains(args, tr):
    l_ = _list(args[0], "LIST_CONTAINS")
    if args[1].ty.name == "ANY":
        return E(F.lit(None).cast("boolean"), BOOL)
    if args[1].entity is not None and args[1].ty.name == "NODE":
        x = args[1]
        return E(F.exists(l_.col, lambda v: v["_id"] == x.col["_id"]), BOOL)
    if _element(l_).name == "STRING" and args[1].ty.name != "STRING":
        l_ = cast(E(l_.col, list_of(STRING)), list_of(args[1].ty))
    a, x, _ = _same(l_, args[1])
    consts = l_.const if l_.is_const and isinstance(l_.const, list) else None
    if consts and all(isinstance(c, (int, str)) and not isinstance(c, bool) for c in consts):
        return E(args[1].col.isin(consts), BOOL)  # reaches the scan
    return E(F.when(a.isNotNull() & x.isNotNull(), F.coalesce(F.array_contains(a, x), F.lit(False))), BOOL)


@register("list_position", "list_indexof", "array_position", "array_indexof")
def _position(args, tr):
    a, x, _ = _same(_list(args[0], "LIST_POSITION"), args[1])
    return E(F.array_position(a, x), INT64)


def _keep_list(f: Callable) -> Callable:
    return lambda args, tr: E(f(_list(args[0], "LIST").col), list_of(_element(_list(args[0], "LIST"))))


FUNCTIONS["list_distinct"] = FUNCTIONS["array_distinct"] = _keep_list(lambda c: F.array_distinct(F.array_compact(c)))
FUNCTIONS["list_reverse"] = FUNCTIONS["array_reverse"] = _keep_list(F.reverse)
FUNCTIONS["reverse"] = lambda args, tr: FUNCTIONS["list_reverse"](args, tr) if args[0].ty.listy else E(F.reverse(cast(args[0], STRING).col), STRING)
FUNCTIONS["list_unique"] = lambda args, tr: E(F.size(F.array_distinct(F.array_compact(_list(args[0], "LIST_UNIQUE").col))).cast("bigint"), INT64)
FUNCTIONS["list_creation"] = lambda args, tr: X.make_list(args)
FUNCTIONS["array_value"] = lambda args, tr: E(X.make_list(args).col, Ty("ARRAY", X.make_list(args).ty.args, size=len(args)))


@register("list_any_value")
def _any_value(args, tr):
    l_ = _list(args[0], "LIST_ANY_VALUE")
    t = _element(l_)
    zero = F.lit(0).cast(spark_type(t)) if t.numeric else F.lit("") if t.name == "STRING" else F.lit(None)
    return E(F.when(l_.col.isNotNull(), F.coalesce(F.get(F.array_compact(l_.col), F.lit(0)), zero)), t)


@register("list_extract", "list_element")
def _extract(args, tr):
    a = args[0]
    i = cast(args[1], INT64).col if args[1].ty.name != "STRING" else None
    if a.ty.name == "STRING":
        return E(_char(a.col, i), STRING)
    if a.ty.name == "MAP":
        return FUNCTIONS["map_extract"](args, tr)
    if a.ty.name == "STRUCT" or i is None:
        return FUNCTIONS["struct_extract"](args, tr)
    l_ = _list(a, "LIST_EXTRACT")
    n = F.size(l_.col)
    bad = F.raise_error(F.concat(F.lit("Runtime exception: list_extract(list, index): index="), i.cast("string"), F.lit(" is out of range.")))
    return E(F.when(l_.col.isNull() | i.isNull(), F.lit(None)).when((i == 0) | (F.abs(i) > n), bad).otherwise(F.get(l_.col, F.when(i > 0, i - 1).otherwise(n + i).cast("int"))), _element(l_))


def slice_of(a: E, low: E | None, high: E | None) -> E:
    """1-based, both ends included, negative from the end; for lists and strings."""
    text = a.ty.name == "STRING"
    n = F.length(a.col) if text else F.size(a.col)
    place = lambda e, other: other if e is None else F.when(cast(e, INT64).col < 0, n + cast(e, INT64).col + 1).otherwise(cast(e, INT64).col)
    from_ = F.greatest(place(low, F.lit(1)), F.lit(1)).cast("int")
    to = F.least(place(high, n), n).cast("int")
    if high is not None and high.is_const and high.const == 0 and not text:
        to = n
    size = F.greatest(to - from_ + 1, F.lit(0))
    nulls = [a.col, *(e.col for e in (low, high) if e is not None)]
    return E(X.null_if_any(nulls, F.substring(a.col, from_, size) if text else F.slice(a.col, from_, size)), STRING if text else list_of(a.ty.args[0]))


FUNCTIONS["list_slice"] = FUNCTIONS["array_slice"] = lambda args, tr: slice_of(args[0], args[1], args[2])


def _sorting(down: bool) -> Callable:
    def build(args, tr):
        l_ = _list(args[0], "LIST_SORT")
        order = str(args[1].const).upper() if len(args) > 1 else ("DESC" if down else "ASC")
        nulls = str(args[2].const).upper() if len(args) > 2 else "NULLS FIRST"
        if order not in ("ASC", "DESC") or nulls not in ("NULLS FIRST", "NULLS LAST"):
            raise BinderError("Invalid sorting order or null order.")
        solid = F.sort_array(F.array_compact(l_.col), order == "ASC")
        empty = F.filter(l_.col, lambda x: x.isNull())
        return E(F.concat(empty, solid) if nulls == "NULLS FIRST" else F.concat(solid, empty), list_of(_element(l_)))

    return build


FUNCTIONS["list_sort"] = FUNCTIONS["array_sort"] = _sorting(False)
FUNCTIONS["list_reverse_sort"] = FUNCTIONS["array_reverse_sort"] = _sorting(True)
FUNCTIONS["list_to_string"] = FUNCTIONS["array_to_string"] = lambda args, tr: E(F.when(args[0].col.isNotNull(), F.array_join(F.transform(args[1].col, lambda x: X.text_of(x, _element(args[1]))), str(args[0].const)) if args[0].is_const else F.concat_ws("", F.array_join(F.transform(args[1].col, lambda x: X.text_of(x, _element(args[1]))), ","))), STRING)


@register("list_has_all")
def _has_all(args, tr):
    a, b = (_list(x, "LIST_HAS_ALL") for x in args)
    t = common(list_of(_element(a)), list_of(_element(b)))
    return E(F.size(F.array_except(F.array_compact(cast(E(b.col, list_of(_element(b))), t).col), cast(E(a.col, list_of(_element(a))), t).col)) == 0, BOOL)


@register("list_sum")
def _list_sum(args, tr):
    l_ = _list(args[0], "LIST_SUM")
    t = spark_type(_element(l_))
    return E(F.aggregate(l_.col, F.lit(0).cast(t), lambda a, x: (a + F.coalesce(x, F.lit(0).cast(t))).cast(t)), _element(l_))


@register("list_product")
def _list_product(args, tr):
    l_ = _list(args[0], "LIST_PRODUCT")
    t = spark_type(_element(l_))
    return E(F.aggregate(l_.col, F.lit(1).cast(t), lambda a, x: (a * F.coalesce(x, F.lit(1).cast(t))).cast(t)), _element(l_))


@register("range")
def _range(args, tr):
    need(args, 2, "RANGE", 3)
    a, b = cast(args[0], INT64).col, cast(args[1], INT64).col
    s = cast(args[2], INT64).col if len(args) > 2 else F.lit(1).cast("bigint")
    if len(args) > 2 and args[2].is_const and args[2].const == 0:
        raise BinderError("Step of range cannot be 0.")
    none = ((s > 0) & (a > b)) | ((s < 0) & (a < b))
    return E(F.when(none, F.array().cast("array<bigint>")).otherwise(F.sequence(a, b, s)), list_of(INT64))


def _vectors(build: Callable) -> Callable:
    def f(args, tr):
        t = X.common_of([E(a.col, _element(_list(a, "ARRAY"))) for a in args], "vectors")
        t = t if t.floating else DOUBLE
        a, b = (cast(E(x.col, list_of(_element(x))), list_of(DOUBLE)).col for x in args)
        even = F.when(F.size(a) == F.size(b), build(a, b)).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("Binder exception: arrays must have the same length."))))
        return E(even.cast(spark_type(t)), t)

    return f


def _total(a: Column, b: Column, f: Callable) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


_dot = lambda a, b: _total(a, b, lambda x, y: x * y)
_far = lambda a, b: _total(a, b, lambda x, y: (x - y) * (x - y))
FUNCTIONS["array_dot_product"] = FUNCTIONS["array_inner_product"] = _vectors(_dot)
FUNCTIONS["array_squared_distance"] = _vectors(_far)
FUNCTIONS["array_distance"] = _vectors(lambda a, b: F.sqrt(_far(a, b)))
FUNCTIONS["array_cosine_similarity"] = _vectors(lambda a, b: F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))))


@register("array_cross_product")
def _cross(args, tr):
    a, b = args
    g = lambda c, i: F.get(c, F.lit(i))
    t = _element(a)
    return E(F.array(*[g(a.col, i) * g(b.col, j) - g(a.col, j) * g(b.col, i) for i, j in ((1, 2), (2, 0), (0, 1))]), Ty("ARRAY", (t,), size=3))


@register("size", "cardinality")
def _size(args, tr):
    a = args[0]
    if a.ty.listy or a.ty.name == "MAP":
        return E(F.when(a.col.isNotNull(), F.size(a.col)).cast("bigint"), INT64)
    return E(F.length(cast(a, STRING).col).cast("bigint"), INT64)


# -- structs, maps, unions
@register("struct_extract")
def _struct_extract(args, tr):
    return field(args[0], str(args[1].const))


def field(e: E, name: str) -> E:
    t = e.ty.field(name) if e.ty.name in ("STRUCT", "UNION") else None
    if t is None:
        raise BinderError(f"Invalid struct field name: {name}.")
    real = next(f for f in e.ty.fields if f.lower() == name.lower())
    return E(e.col[real], t)


@register("map")
def _map(args, tr):
    k, v = (_list(a, "MAP") for a in args)
    made = F.zip_with(k.col, v.col, lambda a, b: F.struct(a.alias("key"), b.alias("value")))
    wrong = F.raise_error(F.lit("Runtime exception: Unaligned key list and value list."))
    return E(F.when(F.size(k.col) == F.size(v.col), made).when(k.col.isNotNull() & v.col.isNotNull(), wrong), Ty("MAP", (_element(k), _element(v))))


@register("map_extract", "element_at")
def _map_extract(args, tr):
    m, k = args
    if m.ty.name != "MAP":
        raise BinderError(f"Cannot match a built-in function for given function MAP_EXTRACT({m.ty}).")
    x = cast(k, m.ty.args[0]).col
    return E(F.when(x.isNotNull(), F.transform(F.filter(m.col, lambda e: e["key"] == x), lambda e: e["value"])), list_of(m.ty.args[1]))


FUNCTIONS["map_keys"] = lambda args, tr: E(F.transform(args[0].col, lambda e: e["key"]), list_of(args[0].ty.args[0]))
FUNCTIONS["map_values"] = lambda args, tr: E(F.transform(args[0].col, lambda e: e["value"]), list_of(args[0].ty.args[1]))
FUNCTIONS["union_tag"] = lambda args, tr: E(args[0].col["tag"], STRING)


@register("union_extract")
def _union_extract(args, tr):
    e = field(args[0], str(args[1].const))
    return E(F.when(args[0].col["tag"] == next(f for f in args[0].ty.fields if f.lower() == str(args[1].const).lower()), e.col), e.ty)


# -- dates and times
_PARTS = {"year": "year years y yr yrs", "month": "month months mon mons", "day": "day days d dayofmonth", "decade": "decade decades decs", "century": "century centuries cent c", "millennium": "millennium millennia millenium mil mils", "quarter": "quarter quarters", "microsecond": "microsecond microseconds us usec usecs", "millisecond": "millisecond milliseconds ms msec msecs", "second": "second seconds s sec secs", "minute": "minute minutes m min mins", "hour": "hour hours h hr hrs"}


def _part_name(text: str) -> str | None:
    return next((k for k, v in _PARTS.items() if text.lower() in v.split()), None)


def _date_part(name: str | None, a: E) -> Column:
    if a.ty.name == "INTERVAL":
        c = a.col
        y = div(c["months"], F.lit(12))
        us = c["micros"]
        return {"year": y, "month": c["months"] % 12, "day": c["days"], "decade": div(y, F.lit(10)), "century": div(y, F.lit(100)), "millennium": div(y, F.lit(1000)), "quarter": div(c["months"] % 12, F.lit(3)) + 1, "microsecond": us % 60_000_000, "millisecond": div(us % 60_000_000, F.lit(1000)), "second": div(us % 60_000_000, F.lit(1_000_000)), "minute": div(us % 3_600_000_000, F.lit(60_000_000)), "hour": div(us, F.lit(3_600_000_000))}.get(name, F.lit(0))
    c = a.col
    y = F.year(c)
    within = F.pmod(X.micros(c.cast("timestamp_ntz")), F.lit(60_000_000))
    return {"year": y, "month": F.month(c), "day": F.day(c), "decade": div(y, F.lit(10)), "century": div(y - 1, F.lit(100)) + 1, "millennium": div(y - 1, F.lit(1000)) + 1, "quarter": F.quarter(c), "microsecond": within, "millisecond": div(within, F.lit(1000)), "second": F.second(c), "minute": F.minute(c), "hour": F.hour(c)}.get(name, F.lit(0))


@register("date_part", "datepart")
def _part(args, tr):
    need(args, 2, "DATE_PART")
    return E(X.null_if_any([args[1].col], _date_part(_part_name(str(args[0].const)), args[1]).cast("bigint")), INT64)


@register("date_trunc", "datetrunc")
def _trunc(args, tr):
    need(args, 2, "DATE_TRUNC")
    a, name = args[1], _part_name(str(args[0].const)) or "day"
    ts = a.col.cast("timestamp_ntz")
    if name in ("decade", "century", "millennium"):
        n = {"decade": 10, "century": 100, "millennium": 1000}[name]
        out = F.make_date(F.floor(F.year(ts) / n).cast("int") * n, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    else:
        out = F.date_trunc(name, ts.cast("timestamp")).cast("timestamp_ntz")
    return E(out.cast("date"), DATE) if a.ty.name == "DATE" else E(out.cast(spark_type(a.ty)), a.ty)


simple("century", [None], INT64, lambda d: (div(F.year(d) - 1, F.lit(100)) + 1).cast("bigint"))
simple("dayname", [None], STRING, lambda d: F.date_format(d, "EEEE"))
simple("monthname", [None], STRING, lambda d: F.date_format(d, "MMMM"))
simple("last_day", [None], DATE, lambda d: F.last_day(d.cast("date")))
simple("make_date", [INT64, INT64, INT64], DATE, lambda y, m, d: F.make_date(y.cast("int"), m.cast("int"), d.cast("int")))
simple("epoch_ms", [INT64], TIMESTAMP, lambda n: F.timestamp_millis(n).cast("timestamp_ntz"))
simple("to_epoch_ms", [None], INT64, lambda t: div(X.micros(t.cast("timestamp_ntz")), F.lit(1000)))
simple("to_timestamp", [DOUBLE], TIMESTAMP, lambda x: F.timestamp_micros((x * 1e6).cast("bigint")).cast("timestamp_ntz"))
for _n, _m, _d, _u in (("to_years", 12, 0, 0), ("to_months", 1, 0, 0), ("to_days", 0, 1, 0), ("to_hours", 0, 0, 3_600_000_000), ("to_minutes", 0, 0, 60_000_000), ("to_seconds", 0, 0, 1_000_000), ("to_milliseconds", 0, 0, 1000), ("to_microseconds", 0, 0, 1)):
    simple(_n, [INT64], INTERVAL, (lambda m, d, u: lambda n: F.when(n.isNotNull(), X.interval(n * m, n * d, n * u).col))(_m, _d, _u))


def names() -> list[str]:
    special = "list_transform list_filter list_reduce all any none single struct_pack union_value label labels id offset rowid keys properties nodes rels relationships length start_node end_node cost is_trail is_acyclic nextval currval count_star count sum avg min max collect percentiledisc cast"
    return sorted({*FUNCTIONS, *special.split()})


def reduce_columns(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols)
