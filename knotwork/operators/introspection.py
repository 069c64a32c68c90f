"""Table functions over the catalog: their rows are made on the driver."""

from __future__ import annotations

import inspect

from pyspark.sql import functions as F

from knotwork.errors import BinderError, CatalogError
from knotwork.types import BOOL, INT64, STRING, Ty, spark_type

VERSION = "0.1.0"


def source(tr, c):
    """(df, bindings) of a table function; df None for calls that only act."""
    from pyspark.sql import types as T

    from knotwork.plans.translate import Value

    name = c.name.lower()
    args = [tr.expr(a, {}).const for a in c.args]
    if name == "clear_warnings":
        tr.session.warnings.clear()
        return None, {}
    if name == "_cache_array_column_locally":
        t = tr.catalog.node(args[0])
        if t.columns[t.column(args[1]) or ""].name != "ARRAY":
            raise BinderError(f"Column {args[1]} is not an array.")
        return None, {}
    f = FUNCTIONS.get(name)
    if f is None:
        raise CatalogError(f"function {c.name} does not exist.")
    try:
        columns, rows = f(tr, *args)
    except TypeError as error:
        if "argument" in str(error):
            raise BinderError(f"{c.name} got {len(args)} arguments but expects {len(inspect.signature(f).parameters) - 1}.") from None
        raise
    bindings, fields = {}, []
    for n, ty in columns.items():
        col = tr.fresh(n)
        bindings[n] = Value(col, ty)
        fields.append(T.StructField(col, spark_type(ty)))
    return tr.spark.createDataFrame([tuple(r) for r in rows], T.StructType(fields)), bindings


def strings(*names: str) -> dict[str, Ty]:
    return {n: STRING for n in names}


def show_tables(tr):
    rows = [(t.id, t.name, "NODE", "local", t.comment) for t in tr.catalog.nodes.values()] + [(min(t.ids.values(), default=0), t.name, "REL", "local", t.comment) for t in tr.catalog.rels.values()]
    return {"id": Ty("UINT64"), "name": STRING, "type": STRING, "database name": STRING, "comment": STRING}, [(__import__("decimal").Decimal(i), *rest) for i, *rest in rows]


def show_sequences(tr):
    return {"name": STRING, "database name": STRING, "start value": INT64, "increment": INT64, "min value": INT64, "max value": INT64, "cycle": BOOL}, [(s.name, "local", s.start, s.increment, s.low, s.high, s.cycle) for s in tr.catalog.sequences.values()]


def table_info(tr, name):
    t = tr.catalog.table(name)
    default = lambda c: "NULL" if t.defaults.get(c) is None else str(t.defaults[c][1])
    node = hasattr(t, "key")
    columns = {"property id": Ty("INT32"), "name": STRING, "type": STRING, "default expression": STRING} | ({"primary key": BOOL} if node else {"storage_direction": STRING})
    return columns, [(k, c, str(ty), default(c), c == t.key if node else t.direction) for k, (c, ty) in enumerate(t.columns.items())]


def show_macros(tr):
    return strings("name", "definition"), [(m["name"], m["text"]) for m in tr.catalog.macros.values()]


def show_functions(tr):
    from knotwork.functions.registry import names
    from knotwork.operators.algorithms import ALGORITHMS

    rows = [(n.upper(), "SCALAR FUNCTION", "") for n in names()] + [(n.upper(), "TABLE FUNCTION", "") for n in [*FUNCTIONS, *ALGORITHMS]] + [(n.upper(), "AGGREGATE FUNCTION", "") for n in ("count", "count_star", "sum", "avg", "min", "max", "collect", "percentiledisc")]
    rows += [(n.upper(), "SCALAR FUNCTION", u.signature) for n, u in tr.session.udfs.items()]
    return strings("name", "type", "signature"), sorted(set(rows))


def show_indexes(tr):
    return {"table_name": STRING, "index_name": STRING, "index_type": STRING, "property_names": Ty("LIST", (STRING,)), "extension_loaded": BOOL, "index_definition": STRING}, [(i["table"], i["name"], i["kind"], [i["prop"]], True, i["text"]) for i in tr.catalog.indexes]


def show_warnings(tr):
    return {"query_id": INT64, "message": STRING, "file_path": STRING, "line_number": INT64, "skipped_line_or_record": STRING}, [tuple(w) for w in tr.session.warnings]


def show_connection(tr, name):
    t = tr.catalog.rel(name)
    return strings("source table name", "destination table name", "source table primary key", "destination table primary key"), [(a, b, tr.catalog.node(a).key, tr.catalog.node(b).key) for a, b in t.pairs]


def stats_info(tr, name):
    t = tr.catalog.table(name)
    dfs = [t.df] if hasattr(t, "key") else list(t.pairs.values())
    df = dfs[0]
    for x in dfs[1:]:
        df = df.unionByName(x)
    plain = [c for c, ty in t.columns.items() if not ty.args]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(f"`{c}`").alias(f"d{k}") for k, c in enumerate(plain)]).first()
    return {"cardinality": INT64, **{f"{c}_distinct_count": INT64 for c in plain}}, [tuple(row)]


def current_setting(tr, key):
    if key.lower() not in tr.session.settings:
        raise BinderError(f"Invalid option name: {key}.")
    return {key: STRING}, [(str(tr.session.settings[key.lower()]),)]


FUNCTIONS = {
    "show_tables": show_tables,
    "show_sequences": show_sequences,
    "table_info": table_info,
    "show_macros": show_macros,
    "show_functions": show_functions,
    "db_version": lambda tr: (strings("version"), [(VERSION,)]),
    "show_official_extensions": lambda tr: (strings("name", "description"), []),
    "show_loaded_extensions": lambda tr: (strings("extension name", "extension source", "extension path"), []),
    "show_indexes": show_indexes,
    "show_warnings": show_warnings,
    "show_connection": show_connection,
    "storage_info": lambda tr, t: (tr.catalog.table(t) and strings("table_type", "node_group_id", "node_chunk_id", "residency", "column_name", "data_type", "start_page_idx", "num_pages", "num_values", "min", "max", "compression"), []),
    "stats_info": stats_info,
    "current_setting": current_setting,
    "bm_info": lambda tr: ({"mem_limit": INT64, "mem_usage": INT64}, [(tr.spark.sparkContext._jvm.Runtime.getRuntime().maxMemory(), tr.spark.sparkContext._jvm.Runtime.getRuntime().totalMemory())]),
}
