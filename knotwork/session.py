"""Session: statements in, DataFrames out."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.catalog import Catalog, NodeTable, RelTable, Sequence
from knotwork.errors import BinderError, CatalogError, ConfigurationError, ParserError, RuntimeFault, TransactionError
from knotwork.functions.expr import E, cast
from knotwork.operators import write
from knotwork.operators.storage import materialize
from knotwork.operators.storage import numbered as number_rows
from knotwork.plans import ast as A
from knotwork.plans.parser import parse
from knotwork.plans.translate import Translator, walk
from knotwork.sources import external
from knotwork.sources.files import read_files, write_file
from knotwork.types import INTEGERS, Ty, engine_type, parse_type, spark_type

#: Settings that CALL name = value takes, and what they are at first.
SETTINGS = {
    "threads": 0, "timeout": 0, "var_length_extend_max_depth": 30, "recursive_pattern_semantic": "walk", "recursive_pattern_factor": 100, "enable_multi_writes": False, "checkpoint_threshold": 16777216, "auto_checkpoint": True, "force_checkpoint_on_close": True,
    "home_directory": "", "file_search_path": "", "progress_bar": False, "warning_limit": 8192, "spill_to_disk": True, "enable_plan_optimizer": True, "enable_semi_mask": True, "disable_map_key_check": True, "enable_internal_catalog": False, "enable_zone_map": True, "enable_gds": True, "debug_enable_multi_writes": False,
}
KEY_TYPES = INTEGERS | {"STRING", "DATE", "DOUBLE", "FLOAT", "UUID", "BLOB", "TIMESTAMP", "TIMESTAMP_MS", "TIMESTAMP_NS", "TIMESTAMP_SEC", "TIMESTAMP_TZ", "DECIMAL", "INTERVAL", "BOOL"}


class Udf:
    """A scalar function of the user's: typed parameters, NULL in NULL out unless told otherwise."""

    def __init__(self, function: Callable, params: list[Ty], result: Ty, nulls: bool):
        self.params, self.result = params, result
        self.signature = f"({','.join(map(str, params))}) -> {result}"
        call = function if nulls else (lambda *a: None if any(x is None for x in a) else function(*a))
        self.udf = F.udf(call, spark_type(result), useArrow=True)  # batches go over in Arrow

    def __call__(self, args: list[E]) -> E:
        if len(args) != len(self.params):
            raise BinderError(f"The function expects {len(self.params)} arguments but got {len(args)}.")
        return E(self.udf(*[cast(a, t).col for a, t in zip(args, self.params, strict=True)]), self.result)


class Prepared:
    """A parsed statement, translated at each execution with its parameters."""

    def __init__(self, session: Session, text: str):
        self.session, self.statement = session, parse(text)

    @property
    def parameters(self) -> list[str]:
        found: list[str] = []

        def look(x):
            for e in walk(x):
                if e[0] == "param" and e[1] not in found:
                    found.append(e[1])

        def clauses(x):
            if isinstance(x, (list, tuple)):
                for y in x:
                    clauses(y)
                if isinstance(x, tuple):
                    look(x)
            elif hasattr(x, "__dataclass_fields__"):
                for k in x.__dataclass_fields__:
                    clauses(getattr(x, k))

        clauses(self.statement)
        return found

    def execute(self, **params: Any) -> DataFrame:
        return self.session.run(self.statement, params)


class Session:
    """Statements over named graphs. A graph is a catalog of DataFrames; `main` is there from the start."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.graphs: dict[str, Catalog] = {"main": Catalog()}
        self.graph = "main"
        self.settings = dict(SETTINGS)
        self.udfs: dict[str, Udf] = {}
        self.warnings: list[tuple] = []
        self.query_id = 0
        self.seed: int | None = None
        self.saved: tuple[dict[str, Catalog], bool] | None = None
        self.jobs = f"knotwork-{id(self)}"

    @property
    def catalog(self) -> Catalog:
        return self.graphs[self.graph]

    # -- API
    def execute(self, text: str, **params: Any) -> DataFrame:
        """Run statements; the result of the last."""
        self.spark.sparkContext.setJobGroup(self.jobs, text[:200], interruptOnCancel=True)
        return self.run(parse(text), params)

    def interrupt(self) -> None:
        """Cancel the session's running jobs, from another thread; a statement that was writing leaves the graphs as they were."""
        self.spark.sparkContext.cancelJobGroup(self.jobs)

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, text)

    def register_function(self, name: str, function: Callable, params: list[str], result: str, nulls: bool = False) -> None:
        from knotwork.functions.registry import names

        key = name.lower()
        if key in names() or key in self.catalog.macros or key in self.udfs:
            raise CatalogError(f"function {name} already exists.")
        self.udfs[key] = Udf(function, [parse_type(p, self.catalog.types) for p in params], parse_type(result, self.catalog.types), nulls)

    def unregister_function(self, name: str) -> None:
        self.udfs.pop(name.lower(), None)

    def import_arrow(self, table: str, data) -> None:
        """Rows of an Arrow table into a node table (its columns) or a relationship table (from key, to key, properties)."""
        self._copy(table, None, self.spark.createDataFrame(data), {})

    def run(self, statements: list, params: dict) -> DataFrame:
        out = self.spark.range(0).select()
        for s in statements:
            self.query_id += 1
            out = self._statement(s, params)
        return out

    def _statement(self, s, params: dict) -> DataFrame:
        if isinstance(s, A.Statement):
            if s.kind in ("begin", "commit", "rollback", "setting", "explain", "profile", "use_graph", "checkpoint"):
                return getattr(self, f"_{s.kind}")(s.parts, params) or self.spark.range(0).select()
            return self._atomic(lambda: getattr(self, f"_{s.kind}")(s.parts, params), writes=s.kind not in ("copy_to", "export"))
        if self._writes(s):
            return self._atomic(lambda: materialize(Translator(self, self.catalog, params).union(s)), True)
        return Translator(self, self.catalog, params).union(s)

    def room_for_warnings(self) -> int:
        """How many more warnings the statement may keep."""
        return max(0, int(self.settings["warning_limit"]) - sum(w[0] == self.query_id for w in self.warnings))

    def warn(self, message: str, file: str = "", line: int = 0, record: str = "") -> None:
        """Keep what IGNORE_ERRORS skipped, for show_warnings()."""
        if self.room_for_warnings():
            self.warnings.append((self.query_id, message, file, line, record))

    @staticmethod
    def _writes(q) -> bool:
        qs = q.queries if isinstance(q, A.Union) else [q]
        return any(isinstance(c, (A.Create, A.Merge, A.SetItems, A.Delete)) for x in qs for c in x.clauses)

    def _atomic(self, work: Callable, writes: bool) -> DataFrame:
        """All of a statement or nothing: on an error the graphs are what they were."""
        if writes and self.saved and self.saved[1]:
            raise TransactionError("Can not execute a write query inside a read-only transaction.")
        before = {k: c.snapshot() for k, c in self.graphs.items()}
        try:
            return work() or self.spark.range(0).select()
        except Exception:
            self.graphs = before
            raise

    # -- transactions, settings, plans
    def _begin(self, p, params):
        if self.saved:
            raise TransactionError("Connection already has an active transaction.")
        self.saved = ({k: c.snapshot() for k, c in self.graphs.items()}, p["read_only"])

    def _commit(self, p, params):
        if not self.saved:
            raise TransactionError("No active transaction for COMMIT.")
        self.saved = None

    def _rollback(self, p, params):
        if not self.saved:
            raise TransactionError("No active transaction for ROLLBACK.")
        self.graphs, self.saved = self.saved[0], None

    def _checkpoint(self, p, params):
        return None

    def _setting(self, p, params):
        k = p["name"].lower()
        if k not in self.settings:
            raise ConfigurationError(f"Invalid option name: {p['name']}.")
        if k == "recursive_pattern_semantic" and str(p["value"]).lower() not in ("walk", "trail", "acyclic"):
            raise ConfigurationError(f"Cannot parse {p['value']} as a path semantic.")
        self.settings[k] = p["value"]

    def _explain(self, p, params):
        df = self._statement(p["inner"], params)
        text = self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return self.spark.createDataFrame([(text,)], "`explain result` string")

    def _profile(self, p, params):
        df = self._statement(p["inner"], params)
        df.count()
        text = self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return self.spark.createDataFrame([(text,)], "`profile result` string")

    def _use_graph(self, p, params):
        if p["name"] not in self.graphs:
            raise CatalogError(f"Graph {p['name']} does not exist.")
        self.graph = p["name"]

    def _create_graph(self, p, params):
        if p["name"] in self.graphs:
            if p["quiet"]:
                return
            raise CatalogError(f"Graph {p['name']} already exists.")
        c = Catalog()
        if p["any"]:  # schemaless: nodes and edges with JSON data
            nodes = {"id": Ty("SERIAL"), "label": Ty("LIST", (Ty("STRING"),)), "data": Ty("JSON")}
            c.nodes["_nodes"] = NodeTable("_nodes", c.new_id(), c.empty(self.spark, nodes, False), "id", nodes)
            c.sequences["_nodes_id_serial"] = Sequence("_nodes_id_serial", 0, 1, 0)
            edges = {"label": Ty("STRING"), "data": Ty("JSON")}
            c.rels["_edges"] = RelTable("_edges", {("_nodes", "_nodes"): c.new_id()}, {("_nodes", "_nodes"): c.empty(self.spark, edges, True)}, edges)
        self.graphs[p["name"]] = c

    # -- definitions
    def _columns(self, cols: list) -> tuple[dict[str, Ty], dict]:
        out, defaults = {}, {}
        for n, t, d in cols:
            if n.lower() in {x.lower() for x in out}:
                raise BinderError(f"Duplicated column name: {n}, column name must be unique.")
            out[n] = parse_type(t, self.catalog.types)
            if d is not None:
                defaults[n] = d
        return out, defaults

    def _taken(self, name: str, quiet: bool) -> bool:
        if self.catalog.has(name):
            if quiet:
                return True
            raise BinderError(f"{name} already exists in catalog.")
        return False

    def _create_node(self, p, params):
        if self._taken(p["name"], p["quiet"]):
            return
        columns, defaults = self._columns(p["columns"])
        key = next((c for c in columns if p["key"] and c.lower() == p["key"].lower()), None)
        if key is None:
            raise BinderError("Primary key is not found in the node table's columns.")
        if columns[key].name not in KEY_TYPES:
            raise BinderError(f"Primary key {key} is of type {columns[key]} which is not allowed.")
        c = self.catalog
        if p["storage"]:
            df = external.nodes(self.spark, p["name"], columns, p["storage"])
            c.nodes[p["name"]] = NodeTable(p["name"], c.new_id(), df, key, columns, external=True)
            return
        c.nodes[p["name"]] = NodeTable(p["name"], c.new_id(), c.empty(self.spark, columns, False), key, columns, defaults)
        for col, t in columns.items():
            if t.name == "SERIAL":
                c.sequences[f"{p['name']}_{col}_serial"] = Sequence(f"{p['name']}_{col}_serial", 0, 1, 0)

    def _create_node_as(self, p, params):
        if self._taken(p["name"], p["quiet"]):
            return
        t = Translator(self, self.catalog, params)
        df = t.union(p["query"])
        columns = dict(zip(df.columns, t.types, strict=True))
        c, key = self.catalog, df.columns[0]
        if columns[key].name not in KEY_TYPES:
            raise BinderError(f"Primary key {key} is of type {columns[key]} which is not allowed.")
        c.nodes[p["name"]] = NodeTable(p["name"], c.new_id(), c.empty(self.spark, columns, False), key, columns)
        self._copy(p["name"], None, df, {})

    def _create_rel(self, p, params):
        if self._taken(p["name"], p["quiet"]):
            return
        if not p["pairs"]:
            raise BinderError("A relationship table needs at least one FROM-TO pair.")
        columns, defaults = self._columns(p["columns"])
        c = self.catalog
        pairs = []
        for a, b in p["pairs"]:
            pair = (c.node(a).name, c.node(b).name)
            if pair in pairs:
                raise BinderError(f"Found duplicate FROM-TO {a}-{b} pairs.")
            pairs.append(pair)
        if p["storage"]:
            a, b = c.node(pairs[0][0]), c.node(pairs[0][1])
            if len(pairs) > 1 or not (a.external and b.external):
                raise BinderError("An external relationship table needs one pair of external node tables.")
            df = external.relationships(self.spark, p["name"], columns, p["storage"], a.df.count())
            c.rels[p["name"]] = RelTable(p["name"], {pairs[0]: c.new_id()}, {pairs[0]: df}, columns, {}, p["many"] or "MANY_MANY", external=True)
            return
        if any(c.node(x).external for pair in pairs for x in pair):
            raise BinderError("Only an external relationship table can have external node tables.")
        query = None
        if p["query"] is not None:
            t = Translator(self, c, params)
            query = t.union(p["query"])
            columns = dict(list(zip(query.columns, t.types, strict=True))[2:])
        c.rels[p["name"]] = RelTable(p["name"], {x: c.new_id() for x in pairs}, {x: c.empty(self.spark, columns, True) for x in pairs}, columns, defaults, p["many"] or "MANY_MANY", str(p["direction"] or "both").lower())
        if query is not None:
            self._copy(p["name"], None, query, {})

    def _create_sequence(self, p, params):
        c = self.catalog
        if p["name"] in c.sequences:
            if p["quiet"]:
                return
            raise CatalogError(f"{p['name']} already exists in catalog.")
        up = p.get("increment", 1)
        if up == 0:
            raise BinderError("INCREMENT must be non-zero.")
        low = p.get("min", 1 if up > 0 else -(2**63))
        high = p.get("max", 2**63 - 1 if up > 0 else -1)
        start = p.get("start", low if up > 0 else high)
        if up > 0 and "min" not in p:
            low = min(low, start)
        if up < 0 and "max" not in p:
            high = max(high, start)
        if low >= high and "min" in p and "max" in p or not low <= start <= high:
            raise BinderError("SEQUENCE START, MINVALUE and MAXVALUE do not fit together.")
        c.sequences[p["name"]] = Sequence(p["name"], start, up, low, high, p["cycle"])

    def _create_type(self, p, params):
        if p["name"].upper() in self.catalog.types:
            raise CatalogError(f"Duplicated type name: {p['name']}.")
        self.catalog.types[p["name"].upper()] = parse_type(p["type"], self.catalog.types)

    def _create_macro(self, p, params):
        from knotwork.functions.registry import names

        key = p["name"].lower()
        if key in self.catalog.macros or key in names() or key in self.udfs:
            if p["quiet"] and key in self.catalog.macros:
                return
            raise CatalogError(f"Macro {p['name']} already exists.")
        self.catalog.macros[key] = p

    def _create_index(self, p, params):
        t = self.catalog.node(p["table"])
        if t.key.lower() != p["prop"].lower():
            raise BinderError("An index can only be created over a primary key.")
        name = p["name"] or f"{t.name}_{t.key}_index"
        if any(i["name"] == name for i in self.catalog.indexes):
            if p["quiet"]:
                return
            raise CatalogError(f"Index {name} already exists.")
        self.catalog.indexes.append({"table": t.name, "name": name, "kind": p["kind"], "prop": t.key, "text": f"CREATE {p['kind']} INDEX {name} FOR (n:{t.name}) ON (n.{t.key})"})

    def expand(self, macro: dict, args: list, named: dict) -> tuple:
        """The macro's body with the arguments in place of its parameters."""
        needed = [n for n, d in macro["params"] if d is None]
        if len(args) < len(needed) - len(named) or len(args) > len(macro["params"]):
            raise BinderError(f"Invalid number of arguments for macro {macro['name']}.")
        values = {n: d for n, d in macro["params"]}
        values |= dict(zip([n for n, _ in macro["params"]], args, strict=False)) | named

        def swap(e):
            if isinstance(e, tuple):
                if len(e) == 2 and e[0] == "var" and e[1] in values:
                    return values[e[1]]
                return tuple(swap(x) for x in e)
            return [swap(x) for x in e] if isinstance(e, list) else {k: swap(v) for k, v in e.items()} if isinstance(e, dict) else e

        return swap(macro["body"])

    def _drop(self, p, params):
        c, name = self.catalog, p["name"]
        where = {"sequence": c.sequences, "macro": c.macros, "type": c.types, "graph": self.graphs}.get(p["what"])
        if p["what"] == "index":
            found = [i for i in c.indexes if i["name"] == name]
            c.indexes = [i for i in c.indexes if i["name"] != name]
        elif where is not None:
            k = name.lower() if p["what"] == "macro" else name.upper() if p["what"] == "type" else name
            if p["what"] == "graph" and k == self.graph:
                raise CatalogError("Cannot drop the graph in use.")
            found = where.pop(k, None)
        else:
            found = c.has(name) and c.table(name)
            if found:
                used = [r.name for r in c.rels.values() if any(found.name in pair for pair in r.pairs)]
                if isinstance(found, NodeTable) and used:
                    raise BinderError(f"Cannot delete node table {found.name} because it is referenced by relationship table {used[0]}.")
                (c.nodes if isinstance(found, NodeTable) else c.rels).pop(found.name)
                for s in [s for s in c.sequences if s.startswith(f"{found.name}_") and s.endswith("_serial")]:
                    c.sequences.pop(s)
        if not found and not p["quiet"]:
            raise (BinderError if p["what"] == "table" else CatalogError)(f"{p['what'].capitalize()} {name} does not exist.")

    def _each(self, t, f: Callable) -> None:
        write.changeable(t)
        if isinstance(t, NodeTable):
            t.df = f(t.df)
        else:
            t.pairs = {k: f(df) for k, df in t.pairs.items()}

    def _alter_add(self, p, params):
        t = self.catalog.table(p["table"])
        if t.column(p["column"]):
            if p["quiet"]:
                return
            raise BinderError(f"{t.name} table already has property {p['column']}.")
        ty = parse_type(p["type"], self.catalog.types)
        tr = Translator(self, self.catalog, params)

        def add(df: DataFrame) -> DataFrame:
            from knotwork.plans.translate import Frame

            if p["default"] is None:
                return df.withColumn(p["column"], F.lit(None).cast(spark_type(ty)))
            tr.frame = Frame(df, {"row": None})
            e = cast(tr.expr(p["default"], {"row": None}), ty)
            return materialize(tr.frame.df.withColumn(p["column"], e.col).select(*df.columns, p["column"]))

        self._each(t, add)
        t.columns = {**t.columns, p["column"]: ty}
        if p["default"] is not None:
            t.defaults = {**t.defaults, p["column"]: p["default"]}

    def _alter_drop(self, p, params):
        t = self.catalog.table(p["table"])
        c = t.column(p["column"])
        if c is None:
            if p["quiet"]:
                return
            raise BinderError(f"{t.name} table does not have property {p['column']}.")
        if isinstance(t, NodeTable) and c == t.key:
            raise BinderError(f"Cannot drop property {c} in table {t.name} because it is used as primary key.")
        self._each(t, lambda df: df.drop(c))
        t.columns = {k: v for k, v in t.columns.items() if k != c}

    def _alter_rename(self, p, params):
        c, t = self.catalog, self.catalog.table(p["table"])
        if c.has(p["to"]):
            raise BinderError(f"{p['to']} already exists in catalog.")
        where = c.nodes if isinstance(t, NodeTable) else c.rels
        where.pop(t.name)
        if isinstance(t, NodeTable):
            for r in c.rels.values():
                new = lambda pair, t=t: tuple(p["to"] if x == t.name else x for x in pair)
                r.pairs, r.ids = {new(k): v for k, v in r.pairs.items()}, {new(k): v for k, v in r.ids.items()}
        t.name = p["to"]
        where[t.name] = t

    def _alter_rename_column(self, p, params):
        t = self.catalog.table(p["table"])
        c = t.column(p["column"])
        if c is None:
            raise BinderError(f"{t.name} table does not have property {p['column']}.")
        if t.column(p["to"]):
            raise BinderError(f"{t.name} table already has property {p['to']}.")
        self._each(t, lambda df: df.withColumnRenamed(c, p["to"]))
        t.columns = {p["to"] if k == c else k: v for k, v in t.columns.items()}
        if isinstance(t, NodeTable) and t.key == c:
            t.key = p["to"]

    def _alter_add_pair(self, p, params):
        t = self.catalog.rel(p["table"])
        pair = tuple(self.catalog.node(x).name for x in p["pair"])
        if pair in t.pairs:
            if p["quiet"]:
                return
            raise BinderError(f"{pair[0]}-{pair[1]} already exists in {t.name}.")
        t.pairs[pair], t.ids[pair] = self.catalog.empty(self.spark, t.columns, True), self.catalog.new_id()

    def _alter_drop_pair(self, p, params):
        t = self.catalog.rel(p["table"])
        pair = tuple(p["pair"])
        if pair not in t.pairs:
            if p["quiet"]:
                return
            raise BinderError(f"{pair[0]}-{pair[1]} does not exist in {t.name}.")
        t.pairs.pop(pair)
        t.ids.pop(pair)

    def _comment(self, p, params):
        self.catalog.table(p["table"]).comment = p["text"]

    # -- bulk movement
    def _copy_from(self, p, params):
        t = self.catalog.table(p["table"])
        options = dict(p["options"])
        if "query" in p:
            tr = Translator(self, self.catalog, params)
            df = tr.union(p["query"])
        else:
            columns = [t.column(c) or c for c in p["columns"]] if p["columns"] else [c for c, ty in t.columns.items() if ty.name != "SERIAL"]
            if isinstance(t, RelTable):
                a, b = self._pair(t, options)
                ends = [("_from", self.catalog.node(a)), ("_to", self.catalog.node(b))]
                wanted = [(n, x.columns[x.key]) for n, x in ends] + [(c, t.columns[c]) for c in columns]
            else:
                wanted = [(c, t.columns[c]) for c in columns]
            df, _ = read_files(self, p["files"], options, wanted)
        self._copy(t.name, p["columns"], df, options)

    @staticmethod
    def _pair(t: RelTable, options: dict) -> tuple[str, str]:
        if "FROM" in options:
            return str(options["FROM"]), str(options["TO"])
        if len(t.pairs) > 1:
            raise BinderError(f"The table {t.name} has multiple FROM and TO pairs: FROM and TO options are needed.")
        return next(iter(t.pairs))

    def _copy(self, name: str, columns: list[str] | None, df: DataFrame, options: dict) -> None:
        """Rows of df by position into a table. Relationship rows begin with the keys of both ends."""
        t = self.catalog.table(name)
        write.changeable(t)
        tr = Translator(self, self.catalog)
        lead = [] if isinstance(t, NodeTable) else ["_from", "_to"]
        names = [t.column(c) or c for c in columns] if columns else [c for c, ty in t.columns.items() if ty.name != "SERIAL" or len(df.columns) == len(t.columns)]
        if len(df.columns) != len(lead) + len(names):
            raise BinderError(f"Number of columns mismatch. Expected {len(lead) + len(names)} but got {len(df.columns)}.")
        have = [engine_type(f.dataType) for f in df.schema]
        df = df.toDF(*lead, *names)
        place, n = number_rows(df, "_place")
        from knotwork.plans.translate import Frame

        tr.frame = Frame(place, {"row": None})
        given = {c: E(F.col(f"`{c}`"), ty) for c, ty in zip(names, have[len(lead) :], strict=True)}
        values = write.defaults(tr, t, given, {"row": None})
        rows = tr.frame.df
        if isinstance(t, NodeTable):
            made = rows.select(*[e.col.alias(c) for c, e in values.items()])
            made = materialize(made.select(write.key_place(t, E(F.col(f"`{t.key}`"), t.columns[t.key])).alias("_off"), "*"))
            if options.get("IGNORE_ERRORS"):
                key = F.col(f"`{t.key}`")
                new = made.filter(key.isNotNull()).join(t.df.select("_off"), "_off", "left_anti")
                new = materialize(new.groupBy("_off").agg(F.min(F.struct(*[c for c in new.columns if c != "_off"])).alias("_one")).select("_off", "_one.*"))
                kept = new.select("_off", F.lit(True).alias("_kept"))
                left = made.groupBy(key.cast("string").alias("k"), "_off").count().join(kept, "_off", "left").filter("_kept IS NULL OR count > 1")
                for r in left.limit(self.room_for_warnings()).collect():  # a bounded number
                    null = "Found NULL, which violates the non-null constraint of the primary key column."
                    self.warn("Runtime exception: " + (null if r["k"] is None else f"Found duplicated primary key value {r['k']}, which violates the uniqueness constraint of the primary key column."), record=r["k"] or "")
                made = new
            write.add_nodes(t, made)
            return
        a, b = self._pair(t, options)
        x, y = self.catalog.node(a), self.catalog.node(b)
        ends = [write.key_place(z, cast(E(F.col(c), ty), z.columns[z.key])).alias(o) for z, c, ty, o in ((x, "_from", have[0], "_src"), (y, "_to", have[1], "_dst"))]
        made = materialize(rows.select(*ends, (F.lit(t.next_off) + F.col("_place")).alias("_off"), "_from", "_to", *[e.col.alias(c) for c, e in values.items()]))
        for z, col, key in ((x, "_src", "_from"), (y, "_dst", "_to")):
            lost = made.join(z.df.select(F.col("_off").alias(col)), col, "left_anti")
            if options.get("IGNORE_ERRORS"):
                for r in lost.select(F.col("_from").cast("string").alias("a"), F.col("_to").cast("string").alias("b"), F.col(key).cast("string").alias("k")).limit(self.room_for_warnings()).collect():
                    self.warn(f"Runtime exception: Unable to find primary key value {r['k']}.", record=f"{r['a']},{r['b']}")
                made = materialize(made.join(z.df.select(F.col("_off").alias(col)), col, "left_semi"))
            elif (bad := lost.select(F.col(key).cast("string").alias("k")).first()) is not None:
                raise RuntimeFault(f"Unable to find primary key value {bad['k']}.")
        write.add_rels(t, (x.name, y.name), made, n)

    def _copy_to(self, p, params):
        t = Translator(self, self.catalog, params)
        df = t.union(p["query"])
        write_file(df, t.types, p["file"], p["options"])

    def _export(self, p, params):
        """The graph as Parquet tables and statements that make it again."""
        folder, c = p["folder"].rstrip("/"), self.catalog
        os.makedirs(folder, exist_ok=True)
        schema, copies = [], []
        for n, t in c.types.items():
            schema.append(f"CREATE TYPE {n} AS {t};")
        for s in c.sequences.values():
            if not s.name.endswith("_serial"):
                schema.append(f"CREATE SEQUENCE {s.name} START {s.start} INCREMENT {s.increment} MINVALUE {s.low} MAXVALUE {s.high}{' CYCLE' if s.cycle else ''};")
        for t in c.nodes.values():
            cols = ", ".join(f"`{k}` {ty}" for k, ty in t.columns.items())
            schema.append(f"CREATE NODE TABLE `{t.name}`({cols}, PRIMARY KEY(`{t.key}`));")
            t.df.select(*[F.col(f"`{k}`") for k in t.columns]).write.mode("overwrite").parquet(f"{folder}/{t.name}.parquet")
            copies.append({"table": t.name, "file": f"{t.name}.parquet", "columns": list(t.columns)})
        for r in c.rels.values():
            pairs = ", ".join(f"FROM `{a}` TO `{b}`" for a, b in r.pairs)
            cols = "".join(f", `{k}` {ty}" for k, ty in r.columns.items())
            schema.append(f"CREATE REL TABLE `{r.name}`({pairs}{cols}, {r.many});")
            for (a, b), df in r.pairs.items():
                x, y = c.node(a), c.node(b)
                ends = df.join(x.df.select(F.col("_off").alias("_src"), F.col(f"`{x.key}`").alias("_from")), "_src").join(y.df.select(F.col("_off").alias("_dst"), F.col(f"`{y.key}`").alias("_to")), "_dst")
                ends.select("_from", "_to", *[F.col(f"`{k}`") for k in r.columns]).write.mode("overwrite").parquet(f"{folder}/{r.name}_{a}_{b}.parquet")
                copies.append({"table": r.name, "file": f"{r.name}_{a}_{b}.parquet", "columns": list(r.columns), "from": a, "to": b})
        for m in c.macros.values():
            params_ = ", ".join(n for n, _ in m["params"])
            schema.append(f"CREATE MACRO {m['name']}({params_}) AS {m['text']};")
        schema += [f"{i['text']};" for i in c.indexes]
        with open(f"{folder}/schema.cypher", "w") as f:
            f.write("\n".join(schema))
        with open(f"{folder}/copy.json", "w") as f:
            json.dump(copies, f)

    def _import(self, p, params):
        folder, c = p["folder"].rstrip("/"), self.catalog
        if c.nodes or c.rels:
            raise BinderError("Cannot import into a graph that isn't empty.")
        with open(f"{folder}/schema.cypher") as f:
            statements = parse(f.read())
        for s in [s for s in statements if s.kind != "create_index"]:
            getattr(self, f"_{s.kind}")(s.parts, params)
        with open(f"{folder}/copy.json") as f:
            for x in json.load(f):
                options = {"FROM": x["from"], "TO": x["to"]} if "from" in x else {}
                self._copy(x["table"], x["columns"], self.spark.read.parquet(f"{folder}/{x['file']}"), options)
        for s in [s for s in statements if s.kind == "create_index"]:
            self._create_index(s.parts, params)


__all__ = ["ParserError", "Prepared", "Session", "Udf", "reduce"]
