"""From syntax trees to DataFrames.

A clause turns a frame (a DataFrame and what its columns stand for) into the next one. Patterns become equi-joins on node
places; Catalyst plans them. What Catalyst can't do is done here: tables of nodes that are only passed through aren't joined,
counts over branches that nothing else reads are aggregated before they are joined, OPTIONAL MATCH and subqueries become
left, semi and anti joins."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.catalog import Catalog, NodeTable, RelTable
from knotwork.errors import BinderError, CatalogError, UnsupportedError
from knotwork.functions import expr as X
from knotwork.functions import registry as R
from knotwork.functions.expr import E, cast, lit
from knotwork.plans import ast as A
from knotwork.types import BOOL, DOUBLE, INT64, INT128, INTERNAL_ID, STRING, Ty, common, list_of, parse_type, spark_type

AGGREGATES = {"count", "count_star", "sum", "avg", "min", "max", "collect", "percentiledisc"}
#: Functions that read a node or relationship without its properties.
BARE = {"id", "label", "labels", "offset", "rowid", "count", "length", "cost"}


def merged(tables: list, where: str) -> dict[str, Ty]:
    """The properties of several tables, by their first spelling, with types wide enough for all."""
    out: dict[str, Ty] = {}
    for t in tables:
        for c, ty in t.columns.items():
            have = next((k for k in out if k.lower() == c.lower()), None)
            if have is None:
                out[c] = ty
            else:
                wide = common(out[have], ty)
                if wide is None:
                    raise BinderError(f"Expected the same data type for property {c} but found {ty} and {out[have]}.")
                out[have] = wide
    return out


@dataclass
class Node:
    """A node variable: columns <prefix>__off, <prefix>__tab (several tables) and <prefix>__p_<property>."""

    prefix: str
    tables: list[NodeTable]
    columns: dict[str, Ty]
    many: bool
    loaded: bool = False
    loads: dict[str, str] = field(default_factory=dict)  # property -> column

    kind = "node"

    def off(self) -> Column:
        return F.col(f"{self.prefix}__off")

    def tab(self) -> Column:
        return F.col(f"{self.prefix}__tab") if self.many else F.lit(self.tables[0].id if self.tables else -1)

    def key_columns(self) -> list[Column]:
        return [self.off(), F.col(f"{self.prefix}__tab")] if self.many else [self.off()]

    def own(self) -> list[str]:
        return [f"{self.prefix}__off", *([f"{self.prefix}__tab"] if self.many else []), *self.loads.values()]

    def id(self) -> Column:
        return F.when(self.off().isNotNull(), F.struct(self.tab().cast("bigint").alias("table"), self.off().alias("offset")))

    def label(self) -> Column:
        if not self.many:
            return F.when(self.off().isNotNull(), F.lit(self.tables[0].name if self.tables else None))
        return reduce(lambda c, t: c.when(self.tab() == t.id, F.lit(t.name)), self.tables, F.when(F.lit(False), F.lit("")))

    def prop(self, name: str) -> E:
        c = next((k for k in self.columns if k.lower() == name.lower()), None)
        if c is None and "data" in self.loads and self.columns["data"].name == "JSON":  # of a schemaless graph
            return E(F.get_json_object(F.col(self.loads["data"]), f"$.{name}"), Ty("JSON"))
        if c is None:
            raise BinderError(f"Cannot find property {name} for {self.prefix.split('_', 1)[-1]}.")
        if c not in self.loads:
            raise BinderError(f"Property {name} was not loaded.")
        return E(F.col(self.loads[c]), self.columns[c], no_nan=all((t[0] if isinstance(t, tuple) else t).no_nan for t in self.tables))

    def value(self) -> E:
        fields = {"_id": INTERNAL_ID, "_label": STRING, **{c: t for c, t in self.columns.items() if c in self.loads}}
        made = F.struct(self.id().alias("_id"), self.label().alias("_label"), *[F.col(self.loads[c]).alias(c) for c in fields if c in self.loads])
        return E(F.when(self.off().isNotNull(), made), Ty("NODE", tuple(fields.values()), tuple(fields)), entity=self)


@dataclass
class Rel:
    prefix: str
    tables: list[tuple[RelTable, tuple[str, str]]]
    columns: dict[str, Ty]
    loads: dict[str, str] = field(default_factory=dict)
    src: Node | None = None
    dst: Node | None = None

    kind = "rel"

    def off(self) -> Column:
        return F.col(f"{self.prefix}__off")

    def tab(self) -> Column:
        return F.col(f"{self.prefix}__tab")

    def key_columns(self) -> list[Column]:
        return [self.off(), self.tab()]

    def own(self) -> list[str]:
        return [f"{self.prefix}__{x}" for x in ("off", "tab", "src", "dst", "stab", "dtab")] + list(self.loads.values())

    def id(self) -> Column:
        return F.when(self.off().isNotNull(), F.struct(self.tab().cast("bigint").alias("table"), self.off().alias("offset")))

    def label(self) -> Column:
        return reduce(lambda c, t: c.when(self.tab() == t[0].ids[t[1]], F.lit(t[0].name)), self.tables, F.when(F.lit(False), F.lit("")))

    prop = Node.prop

    def value(self) -> E:
        end = lambda x, t: F.struct(F.col(f"{self.prefix}__{t}").cast("bigint").alias("table"), F.col(f"{self.prefix}__{x}").alias("offset"))
        fields = {"_src": INTERNAL_ID, "_dst": INTERNAL_ID, "_id": INTERNAL_ID, "_label": STRING, **{c: t for c, t in self.columns.items() if c in self.loads}}
        made = F.struct(end("src", "stab").alias("_src"), end("dst", "dtab").alias("_dst"), self.id().alias("_id"), self.label().alias("_label"), *[F.col(self.loads[c]).alias(c) for c in fields if c in self.loads])
        return E(F.when(self.off().isNotNull(), made), Ty("REL", tuple(fields.values()), tuple(fields)), entity=self)


@dataclass
class Route:
    """A recursive relationship or a named path: columns <prefix>__len, and nodes, rels, cost where they are read."""

    prefix: str
    node_ty: Ty | None = None
    rel_ty: Ty | None = None
    ends: bool = False  # nodes holds the ends too
    cost: bool = False
    kind = "route"

    def own(self) -> list[str]:
        return [f"{self.prefix}__len", *([f"{self.prefix}__nodes", f"{self.prefix}__rels"] if self.node_ty else []), *([f"{self.prefix}__cost"] if self.cost else [])]

    def part(self, name: str) -> Column:
        return F.col(f"{self.prefix}__{name}")

    def value(self) -> E:
        if not self.node_ty:
            raise BinderError("The path was not loaded.")
        made = F.struct(self.part("nodes").alias("_nodes"), self.part("rels").alias("_rels"))
        return E(F.when(self.part("len").isNotNull(), made), Ty("RECURSIVE_REL", (list_of(self.node_ty), list_of(self.rel_ty)), ("_nodes", "_rels")), entity=self)


@dataclass
class Value:
    column: str
    ty: Ty
    kind = "value"

    def own(self) -> list[str]:
        return [self.column]


@dataclass
class Frame:
    df: DataFrame | None
    scope: dict[str, Any]
    mult: str | None = None  # a column with how many rows each row stands for


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def walk(e: Any):
    """All expression tuples below e."""
    if isinstance(e, tuple):
        if e and isinstance(e[0], str):
            yield e
        for x in e:
            yield from walk(x)
    elif isinstance(e, (list, dict)):
        for x in e.values() if isinstance(e, dict) else e:
            yield from walk(x)
    elif isinstance(e, A.PathPattern):
        for p in e.parts:
            yield from walk([v for _, v in p.props])
            if isinstance(p, A.RelPattern) and p.step:
                yield from walk(p.step[2])


def has_aggregate(e: Any) -> bool:
    return any(x[0] == "call" and x[1] in AGGREGATES for x in walk(e))


class Needs:
    """Which properties of which variables a query reads: names, or * for all."""

    def __init__(self):
        self.of: dict[str, set[str]] = {}
        self.links: list[tuple[str, str]] = []

    def add(self, var: str, prop: str) -> None:
        self.of.setdefault(var, set()).add(prop.lower())

    def expr(self, e: Any) -> None:
        if isinstance(e, A.PathPattern):  # of a subquery: what it shares with the outside is read by identity
            for part in e.parts:
                if part.var:
                    self.add(part.var, "=")
            self.path(e)
        elif isinstance(e, (list,)):
            for x in e:
                self.expr(x)
        elif isinstance(e, dict):
            for x in e.values():
                self.expr(x)
        elif isinstance(e, tuple) and e:
            if e[0] == "prop" and isinstance(e[1], tuple) and e[1][0] == "var":
                self.add(e[1][1], e[2])
            elif e[0] == "var" and len(e) == 2 and isinstance(e[1], str):
                self.add(e[1], "*")
            elif e[0] == "lit":
                return
            elif e[0] == "call" and e[1] in ("start_node", "end_node") and e[2] and e[2][0][0] == "var":
                self.add(e[2][0][1], "*ends")
            elif e[0] == "call" and e[1] in BARE and len(e[2]) == 1 and e[2][0][0] == "var":
                self.add(e[2][0][1], "-")
            elif e[0] == "cmp" and e[2][0] == "var" and e[3][0] == "var":
                self.add(e[2][1], "=")
                self.add(e[3][1], "=")
            else:
                for x in e:
                    self.expr(x)

    def path(self, p: A.PathPattern) -> None:
        for part in p.parts:
            for k, v in part.props:
                if part.var:
                    self.add(part.var, k)
                self.expr(v)
            if isinstance(part, A.RelPattern) and part.step and part.step[2]:
                self.expr(part.step[2])

    def query(self, q: A.Query) -> None:
        for c in q.clauses:
            if isinstance(c, A.Match):
                for p in c.paths:
                    self.path(p)
                self.expr(c.where)
            elif isinstance(c, A.Unwind):
                self.expr(c.expr)
            elif isinstance(c, (A.With, A.Return)):
                for i in c.body.items:
                    if isinstance(c, A.With) and i.expr[0] == "var":
                        self.links.append((i.expr[1], i.alias or i.expr[1]))
                    else:
                        self.expr(i.expr)
                if c.body.star and isinstance(c, A.Return):
                    self.of["*"] = {"*"}
                for e, _ in c.body.order:
                    self.expr(e)
                if isinstance(c, A.With):
                    self.expr(c.where)
            elif isinstance(c, A.Call):
                self.expr(c.args)
                self.expr(c.where)
            elif isinstance(c, A.LoadFrom):
                self.expr(c.where)
            elif isinstance(c, (A.Create, A.Merge)):
                for p in c.paths:
                    self.path(p)
                for s in [*getattr(c, "on_create", []), *getattr(c, "on_match", [])]:
                    self.of.setdefault(s[1], set()).add("*")
                    self.expr(s[3] if s[0] == "prop" else s[2])
            elif isinstance(c, A.SetItems):
                for s in c.items:
                    self.of.setdefault(s[1], set()).add("*")
                    self.expr(s[3] if s[0] == "prop" else s[2])
            elif isinstance(c, A.Delete):
                self.expr(c.vars)
        for _ in self.links:
            for a, b in self.links:
                self.of.setdefault(a, set()).update(self.of.get(b, set()))

    def __call__(self, var: str | None) -> set[str]:
        return (self.of.get(var, set()) if var else set()) | self.of.get("*", set())


class Translator:
    def __init__(self, session, catalog: Catalog, params: dict | None = None):
        self.session, self.spark, self.catalog, self.params = session, session.spark, catalog, params or {}
        self.count = 0
        self.needs = Needs()
        self.aggregates: dict | None = None  # while an aggregation is built: its results by syntax tree
        self.extra: list[Column] = []
        self.frame: Frame | None = None

    def fresh(self, name: str = "") -> str:
        self.count += 1
        return f"v{self.count}_{''.join(c if c.isalnum() or c == '_' else '_' for c in name)}"

    # ------------------------------------------------------------ queries
    def union(self, q) -> DataFrame:
        if isinstance(q, A.Query):
            return self.query(q)
        parts = []
        for x in q.queries:
            t = Translator(self.session, self.catalog, self.params)
            parts.append((t.query(x), t.types))
        width = {len(ty) for _, ty in parts}
        if len(width) > 1:
            raise BinderError("The number of columns to union/union all must be the same.")
        names, out = parts[0][0].columns, None
        wanted = []
        for k in range(width.pop()):
            t = parts[0][1][k]
            for _, ty in parts[1:]:
                t = common(t, ty[k]) if "ANY" in (t.name, ty[k].name) or t == ty[k] else None
                if t is None:
                    raise BinderError(f"{names[k]} has different data types in the queries of a union.")
            wanted.append(t)
        for df, ty in parts:
            safe = df.toDF(*[f"c{k}" for k in range(len(ty))])
            cols = [cast(E(F.col(f"c{k}"), ty[k]), wanted[k]).col.alias(f"c{k}") if ty[k] != wanted[k] else F.col(f"c{k}") for k in range(len(ty))]
            safe = safe.select(*cols)
            out = safe if out is None else out.union(safe)
        self.types = wanted
        out = out if q.all else out.distinct()
        return out.toDF(*names)

    def query(self, q: A.Query) -> DataFrame:
        self.needs = Needs()
        self.needs.query(q)
        frame = Frame(None, {})
        result = None
        for k, c in enumerate(q.clauses):
            following = q.clauses[k + 1] if k + 1 < len(q.clauses) else None
            if isinstance(c, A.Match):
                frame = self.match(frame, c, following)
            elif isinstance(c, A.Unwind):
                frame = self.unwind(frame, c)
            elif isinstance(c, A.With):
                frame = self.with_(frame, c)
            elif isinstance(c, A.Return):
                result = self.project(frame, c.body, final=True)
            elif isinstance(c, A.Call):
                frame = self.call(frame, c)
            elif isinstance(c, A.LoadFrom):
                frame = self.load(frame, c)
            else:
                from knotwork.operators.write import write_clause

                frame = write_clause(self, frame, c)
        if result is None:
            self.types = []
            return self.spark.range(0).select()
        return result

    def start(self, frame: Frame) -> DataFrame:
        return frame.df if frame.df is not None else self.spark.range(1).select()

    def unwind(self, frame: Frame, c: A.Unwind) -> Frame:
        if c.var in frame.scope:
            raise BinderError(f"Variable {c.var} already exists.")
        e = self.expr(c.expr, frame.scope)
        name = self.fresh(c.var)
        if e.ty.name == "ANY" or not e.ty.listy:
            ty = e.ty.args[0] if e.ty.listy else e.ty
            df = self.start(frame).filter(F.lit(False)).withColumn(name, F.lit(None))
        else:
            ty = e.ty.args[0]
            df = self.start(frame).select("*", F.explode(e.col).alias(name))
        return Frame(df, {**frame.scope, c.var: Value(name, ty)}, frame.mult)

    # ------------------------------------------------------------ projection
    def items(self, frame: Frame, p: A.Projection) -> list[A.Item]:
        out = []
        if p.star:
            if not frame.scope:
                raise BinderError("RETURN or WITH * is not allowed when there are no variables in scope.")
            out += [A.Item(("var", v), None, v) for v in frame.scope]
        for i in p.items:
            if i.expr[0] == "spread":
                b = frame.scope.get(i.expr[1][1])
                if b is None:
                    raise BinderError(f"Variable {i.expr[1][1]} is not in scope.")
                names = list(b.columns) if b.kind in ("node", "rel") else [f for f in b.ty.fields if not f.startswith("_")]
                out += [A.Item(("prop", i.expr[1], n), None, f"{i.expr[1][1]}.{n}") for n in names]
            else:
                out.append(i)
        return out

    def with_(self, frame: Frame, c: A.With) -> Frame:
        for i in c.body.items:
            if i.alias is None and i.expr[0] not in ("var", "spread"):
                raise BinderError("Expression in WITH must be aliased (use AS).")
        if c.body.order and c.body.skip is None and c.body.limit is None:
            raise BinderError("In WITH clause, ORDER BY must be followed by SKIP or LIMIT.")
        out = self.project(frame, c.body, final=False)
        return self.where(out, c.where) if c.where is not None else out

    def amount(self, e: tuple | None, what: str) -> int | None:
        if e is None:
            return None
        x = self.expr(e, {})
        if not x.is_const or not isinstance(x.const, int) or isinstance(x.const, bool):
            raise BinderError(f"The number of rows to {what} must be a parameter or a literal of type INT64.")
        if x.const < 0:
            from knotwork.errors import RuntimeFault

            raise RuntimeFault(f"The number of rows to {what} must be a non-negative integer.")
        return x.const

    def project(self, frame: Frame, p: A.Projection, final: bool):
        items = self.items(frame, p)
        names = [i.alias or (i.expr[1] if i.expr[0] == "var" else i.text) for i in items]
        if not final and len({n for n in names}) < len(names):
            raise BinderError("Multiple result columns with the same name are not supported.")
        if any(has_aggregate(i.expr) for i in items):
            frame, results = self.aggregate(frame, items)
        else:
            results = None
        self.frame = frame
        df, scope, out = self.start(frame), {}, []
        added: dict[str, Column] = {}
        for i, n in zip(items, names, strict=True):
            bound = frame.scope.get(i.expr[1]) if i.expr[0] == "var" else None
            if results is not None and id(i) in results:
                bound = results[id(i)]
            if bound is not None and not isinstance(bound, E) and bound.kind != "value":
                scope[n] = bound
                out.append(bound)
                continue
            self.frame = Frame(df, frame.scope, frame.mult)
            e = bound if bound is not None else self.expr(i.expr, frame.scope)
            df = self.frame.df if self.frame.df is not None else df
            if isinstance(e, Value):
                scope[n] = e
                out.append(e)
                continue
            col = self.fresh(n)
            added[col] = e.col
            scope[n] = Value(col, e.ty)
            out.append(scope[n])
        if added:
            df = df.withColumns(added)
        if p.distinct:
            keys = [c for b in out for c in (self.key_names(b))]
            df = df.dropDuplicates(keys) if keys else df.limit(1)
            frame = Frame(df, frame.scope, None)
        if p.order:
            visible = {**({} if results is not None or p.distinct else frame.scope), **scope}
            keys = []
            for e, down in p.order:
                match = next((k for k, i in enumerate(items) if i.expr == e), None)
                x = self.binding(out[match]) if match is not None else self.expr(e, visible)
                if x.ty.name in ("RECURSIVE_REL", "MAP", "UNION"):
                    raise BinderError(f"Cannot order by a value of type {x.ty}.")
                c = x.col["_id"] if x.ty.name in ("NODE", "REL") else X.sort_key(x.col, x.ty)
                keys.append(c.desc_nulls_first() if down else c.asc_nulls_last())
            df = df.orderBy(*keys)
        skip, limit = self.amount(p.skip, "skip"), self.amount(p.limit, "limit")
        if skip:
            df = df.offset(skip)
        if limit is not None:
            df = df.limit(limit)
        if final:
            cols = [self.binding(b) for b in out]
            if frame.mult and results is None:
                df = self.repeat(df, frame.mult)
            self.types = [c.ty for c in cols]
            return df.select(*[self.outward(c).alias(n) for c, n in zip(cols, names, strict=True)])
        keep = [F.col(c) for c in dict.fromkeys(c for b in scope.values() for c in b.own())]
        if frame.mult and results is None:
            keep.append(F.col(frame.mult))
        return Frame(df.select(*keep), scope, frame.mult if results is None else None)

    @staticmethod
    def outward(e: E) -> Column:
        return e.col.cast(spark_type(e.ty)) if e.ty.name == "ANY" else e.col

    @staticmethod
    def repeat(df: DataFrame, mult: str) -> DataFrame:
        return df.withColumn("_again", F.explode(F.array_repeat(F.lit(1), F.col(mult).cast("int")))).drop("_again")

    @staticmethod
    def key_names(b) -> list[str]:
        return [b.column] if b.kind == "value" else ([f"{b.prefix}__off", *([f"{b.prefix}__tab"] if b.kind == "rel" or b.many else [])] if b.kind != "route" else b.own())

    def binding(self, b) -> E:
        return E(F.col(b.column), b.ty) if b.kind == "value" else b.value()

    # ------------------------------------------------------------ aggregation
    def aggregate(self, frame: Frame, items: list[A.Item]) -> tuple[Frame, dict]:
        """The grouped frame and what the items that are keys or lone aggregates are bound to."""
        df = self.start(frame)
        keys, firsts, results = [], [], {}
        self.frame = Frame(df, frame.scope, frame.mult)
        scope: dict[str, Any] = {}
        for i in items:
            if has_aggregate(i.expr):
                continue
            b = frame.scope.get(i.expr[1]) if i.expr[0] == "var" else None
            if b is not None:
                names = self.key_names(b)
                keys += [F.col(c) for c in names]
                firsts += [F.first(c).alias(c) for c in b.own() if c not in names]
                results[id(i)] = b
                scope[i.expr[1]] = b
            else:
                e = self.expr(i.expr, frame.scope)
                col = self.fresh("key")
                self.frame.df = self.frame.df.withColumn(col, e.col)
                keys.append(F.col(col))
                results[id(i)] = Value(col, e.ty)
        calls: dict[str, tuple[Column, Ty]] = {}
        found: dict = {}
        for i in items:
            for x in walk(i.expr):
                if x[0] == "call" and x[1] in AGGREGATES and repr(x) not in found:
                    if any(has_aggregate(a) for a in x[2]):
                        raise BinderError("Nested aggregates are not supported.")
                    name = self.fresh("agg")
                    col, ty = self.one_aggregate(x, frame)
                    calls[name] = (col, ty)
                    found[repr(x)] = E(F.col(name), ty)
        df = self.frame.df
        made = [c.alias(n) for n, (c, _) in calls.items()] + firsts
        df = df.groupBy(*keys).agg(*made) if keys else df.agg(*made)
        self.aggregates = found
        out = Frame(df, {**scope})
        for i in items:
            if has_aggregate(i.expr):
                self.frame = out
                key_scope = {**scope}
                e = self.expr(i.expr, key_scope)
                results[id(i)] = e
        self.aggregates = None
        return out, results

    def one_aggregate(self, x: tuple, frame: Frame) -> tuple[Column, Ty]:
        _, name, args, distinct, _ = x
        m = F.col(frame.mult) if frame.mult else None
        if name == "count_star":
            return (F.coalesce(F.sum(m), F.lit(0)).cast("bigint") if m is not None else F.count(F.lit(1)), INT64)
        e = self.expr(args[0], frame.scope)
        if e.entity is not None and name in ("count",):
            c = e.entity.part("len") if e.entity.kind == "route" else e.entity.off()
            if distinct:
                keys = e.entity.key_columns()
                return (F.count_distinct(*keys), INT64)
            return (F.coalesce(F.sum(F.when(c.isNotNull(), m)), F.lit(0)).cast("bigint") if m is not None else F.count(c), INT64)
        c = e.col
        if name == "count":
            if distinct:
                n = F.count_distinct(c)
                if e.ty.floating and not e.no_nan:  # each NaN counts
                    n = F.count_distinct(F.when(~F.isnan(c), c)) + F.count(F.when(F.isnan(c), 1))
                return (n, INT64)
            return (F.coalesce(F.sum(F.when(c.isNotNull(), m)), F.lit(0)).cast("bigint") if m is not None else F.count(c), INT64)
        if name in ("sum", "avg"):
            if not (e.ty.integer or e.ty.floating or e.ty.name == "ANY"):
                raise BinderError(f"Cannot match a built-in function for given function {name.upper()}({e.ty}).")
            wide = c.cast("decimal(38,0)") if e.ty.integer else c.cast("double")
            if name == "avg":  # sums of whole numbers are exact
                if m is not None and not distinct:
                    return (F.sum(wide * m).cast("double") / F.sum(F.when(c.isNotNull(), m)), DOUBLE)
                if not e.ty.integer and not distinct:
                    return (F.avg(wide), DOUBLE)
                total, n = (F.sum_distinct(wide), F.count_distinct(wide)) if distinct else (F.sum(wide), F.count(wide))
                return (F.try_divide(total.cast("double"), n.cast("double")), DOUBLE)
            if m is not None and not distinct:
                wide = wide * m
            total = F.sum_distinct(wide) if distinct else F.sum(wide)
            if e.ty.integer:
                return (total.cast("decimal(38,0)"), INT128 if not e.ty.name.startswith("U") else Ty("UINT128"))
            return (total, DOUBLE)
        if name in ("min", "max"):
            return ((F.min if name == "min" else F.max)(c), e.ty)
        if name == "collect":
            if e.ty.name == "ANY":
                return (F.collect_list(c.cast("string")), list_of(e.ty))
            return ((F.collect_set if distinct else F.collect_list)(c), list_of(e.ty))
        p = self.expr(args[1], {})
        if not p.is_const:
            raise BinderError("percentileDisc needs a constant percentile.")
        rank = min(1.0, max(0.0, float(p.const)))
        if e.ty.numeric and not distinct and e.ty.name not in ("INT128", "UINT64", "UINT128", "DECIMAL"):
            # the value at ceil(p * n), from counts of values that are merged before the shuffle
            name = self.fresh("rank")
            self.frame.df = self.frame.df.withColumn(name, c.cast("double") if e.ty.floating else c)
            near = F.expr(f"percentile_disc({rank}) WITHIN GROUP (ORDER BY {name})").cast(spark_type(e.ty))
            if e.ty.name != "INT64" and e.ty.name != "SERIAL":
                return (near, e.ty)
            # it comes as a double: beyond 2 ** 53 the value is taken by its place among those that are as large
            huge, n = F.sort_array(F.collect_list(F.when(F.abs(c) >= 2**53, c))), F.count(c)
            place = F.greatest(F.ceil(F.lit(rank) * n), F.lit(1)).cast("int")
            below = F.size(F.filter(huge, lambda x: x < 0))
            exact = F.when(place <= below, F.get(huge, place - 1)).when(n - place < F.size(huge) - below, F.get(huge, (F.size(huge) - 1 - (n - place)).cast("int"))).otherwise(near)
            return (F.when(n > 0, exact), e.ty)
        values = F.sort_array(F.collect_set(c) if distinct else F.collect_list(c))
        return (F.get(values, F.greatest(F.ceil(F.lit(rank) * F.size(values)) - 1, F.lit(0)).cast("int")), e.ty)

    # ------------------------------------------------------------ filters
    def conjuncts(self, e: tuple) -> list[tuple]:
        return [*self.conjuncts(e[1]), *self.conjuncts(e[2])] if e[0] == "and" else [e]

    def where(self, frame: Frame, e: tuple) -> Frame:
        plain = []
        for c in self.conjuncts(e):
            inner, anti = (c[1], True) if c[0] == "not" else (c, False)
            if inner[0] == "exists":
                frame = self.exists(frame, inner, anti)
            else:
                plain.append(c)
        self.frame = Frame(self.start(frame), frame.scope, frame.mult)
        conds = [X.truth(self.expr(c, frame.scope)) for c in plain]
        df = self.frame.df
        keep = df.columns
        for c in conds:
            df = df.filter(c)
        marks = [x for x in keep if x.startswith("mark_")]
        return Frame(df.drop(*marks) if marks else df, frame.scope, frame.mult)

    def inner_needs(self, paths: list, where: tuple | None) -> Needs:
        n = Needs()
        for p in paths:
            n.path(p)
        n.expr(where)
        return n

    def correlation(self, frame: Frame, paths: list, where: tuple | None) -> tuple[list[str], bool]:
        """Names of outer variables that a subquery reads, and whether it can be worked out for all nodes at once."""
        inside = {p.var for path in paths for p in path.parts if p.var}
        read = {v for v in self.inner_needs(paths, where).of} | inside
        outer = [v for v in frame.scope if v in read]
        free = all(frame.scope[v].kind == "node" and v in {p.var for path in paths for p in path.parts if isinstance(p, A.NodePattern)} for v in outer)
        hops = sum(len(path.parts) // 2 for path in paths)
        recursive = any(isinstance(p, A.RelPattern) and p.hops for path in paths for p in path.parts)
        return outer, free and bool(outer) and not recursive and (hops <= 1 or len(outer) == 1)

    def subquery(self, frame: Frame, paths: list, where: tuple | None, closed: bool = False) -> tuple[Frame, list[tuple[Column, str]]]:
        """The frame of a subquery's matches, and pairs of an outer column and the inner column that must equal it.

        closed: nothing outside reads what the subquery binds."""
        outer, free = self.correlation(frame, paths, where)
        hold = self.needs
        self.needs = self.inner_needs(paths, where)
        for v, props in hold.of.items():
            if not (free and v in outer) and (v in frame.scope or not closed):  # worked out for all nodes at once: of those it reads only what it names itself
                self.needs.of.setdefault(v, set()).update(props)
        try:
            if free:
                inner = Frame(None, {})
                self.bound_tables = {v: frame.scope[v].tables for v in outer}
                got = self.match(inner, A.Match(False, paths, where), None)
                self.bound_tables = {}
                pairs = []
                for v in outer:
                    a, b = frame.scope[v], got.scope[v]
                    pairs.append((a.off(), f"{b.prefix}__off"))
                    if a.many or b.many:
                        df = got.df.withColumn(t := self.fresh("t"), b.tab())
                        got = Frame(df, got.scope)
                        pairs.append((a.tab(), t))
                return got, pairs
            names = [c for v in outer for c in frame.scope[v].own()]
            renamed = {c: self.fresh("k") for c in names}
            keys = self.start(frame).select(*[F.col(c) for c in names], *[F.col(c).alias(r) for c, r in renamed.items()]).distinct() if names else self.spark.range(1).select()
            got = self.match(Frame(keys, {v: frame.scope[v] for v in outer}), A.Match(False, paths, where), None)
            return got, [(F.col(c), r) for c, r in renamed.items()]
        finally:
            self.needs = hold

    bound_tables: dict[str, list] = {}

    @staticmethod
    def joined_on(df: DataFrame, pairs: list[tuple[Column, str]], safe: bool) -> Column:
        conds = [(a.eqNullSafe(F.col(b)) if safe else a == F.col(b)) for a, b in pairs]
        return reduce(lambda x, y: x & y, conds) if conds else F.lit(True)

    def keyed(self, frame: Frame, paths: list, where: tuple | None) -> tuple[DataFrame, list[tuple[Column, str]]]:
        got, pairs = self.subquery(frame, paths, where, True)
        fresh = {b: self.fresh("j") for _, b in pairs}
        inner = got.df.select(*[F.col(b).alias(fresh[b]) for b in fresh], *([F.lit(1).alias("_one")] if not fresh else []))
        return inner, [(a, fresh[b]) for a, b in pairs]

    def exists(self, frame: Frame, e: tuple, anti: bool) -> Frame:
        inner, pairs = self.keyed(frame, e[1], e[2])
        df = self.start(frame)
        safe = not self.correlation(frame, e[1], e[2])[1]
        if not pairs:
            any_row = inner.limit(1)
            df = df.join(F.broadcast(any_row), F.lit(True), "left_anti" if anti else "left_semi")
        else:
            df = df.join(inner, self.joined_on(df, pairs, safe), "left_anti" if anti else "left_semi")
        return Frame(df, frame.scope, frame.mult)

    def mark(self, e: tuple, scope: dict) -> E:
        """EXISTS or COUNT inside an expression: a column added to the frame by a left join."""
        frame = self.frame
        inner, pairs = self.keyed(frame, e[1], e[2])
        name = f"mark_{self.fresh('m')}"
        df = self.start(frame)
        keys = [b for _, b in pairs]
        agg = (F.count(F.lit(1)) if e[0] == "count" else F.lit(True)).alias(name)
        safe = not self.correlation(frame, e[1], e[2])[1]
        if keys:
            one = inner.groupBy(*keys).agg(agg) if e[0] == "count" else inner.select(*keys).distinct().withColumn(name, F.lit(True))
            df = df.join(one, self.joined_on(df, pairs, safe), "left").drop(*keys)
        else:
            df = df.crossJoin(F.broadcast(inner.agg((F.count(F.lit(1)) if e[0] == "count" else F.count(F.lit(1)) > 0).alias(name))))
        self.frame.df = df
        return E(F.coalesce(F.col(name), F.lit(0 if e[0] == "count" else False)), INT64 if e[0] == "count" else BOOL)

    # ------------------------------------------------------------ patterns
    def node_tables(self, labels: list[str], var: str | None = None) -> list[NodeTable]:
        if not labels:
            return list(self.bound_tables.get(var) or self.catalog.nodes.values())
        out = []
        free = self.catalog.nodes.get("_nodes")
        for x in labels:
            try:
                t = self.catalog.node(x)
            except CatalogError:
                if free is not None:
                    return [free]  # a schemaless graph: labels are data
                raise BinderError(f"Table {x} does not exist.") from None
            if t not in out:
                out.append(t)
        if var in self.bound_tables:
            out = [t for t in out if t in self.bound_tables[var]]
        return out

    def wanted(self, var: str | None, columns: dict[str, Ty]) -> list[str]:
        need = self.needs(var)
        return list(columns) if "*" in need else [c for c in columns if c.lower() in need]

    def scan(self, prefix: str, tables: list[NodeTable], columns: dict[str, Ty], props: list[str], many: bool) -> DataFrame:
        parts = []
        for t in tables:  # as text: a column at a time is a call to the JVM for each step
            cols = [f"_off AS `{prefix}__off`"]
            if many:
                cols.append(f"{t.id} AS `{prefix}__tab`")
            later = {}
            for c in props:
                own, name = t.column(c), f"{prefix}__p_{c}"
                if own and t.columns[own] == columns[c]:
                    cols.append(f"{quoted(own)} AS {quoted(name)}")
                elif own:
                    cols.append(f"{quoted(own)} AS {quoted(name)}")
                    later[name] = cast(E(F.col(quoted(name)), t.columns[own]), columns[c]).col.cast(spark_type(columns[c]))
                else:
                    cols.append(f"CAST(NULL AS {spark_type(columns[c]).simpleString()}) AS {quoted(name)}")
            part = t.df.selectExpr(*cols)
            parts.append(part.withColumns(later) if later else part)
        if not parts:
            raise BinderError("No node table exists in database.")
        return reduce(lambda a, b: a.unionByName(b), parts)

    def candidates(self, r: A.RelPattern) -> list[tuple[RelTable, tuple[str, str]]]:
        if r.types:
            tables = []
            for x in r.types:
                try:
                    tables.append(self.catalog.rel(x))
                except CatalogError:
                    if "_edges" not in self.catalog.rels:
                        raise BinderError(f"Table {x} does not exist.") from None
                    tables.append(self.catalog.rels["_edges"])
        else:
            tables = list(self.catalog.rels.values())
        return [(t, pair) for t in dict.fromkeys(map(id, tables)) for t in [next(x for x in tables if id(x) == t)] for pair in t.pairs]

    def steps(self, r: A.RelPattern, left: list[NodeTable], right: list[NodeTable]) -> list[tuple[RelTable, tuple[str, str], bool]]:
        """(table, pair, forward): how the pattern can go from left to right."""
        ln, rn = {t.name for t in left}, {t.name for t in right}
        out = []
        for t, (a, b) in self.candidates(r):
            if r.direction in ("out", "both") and a in ln and b in rn:
                out.append((t, (a, b), True))
            if r.direction in ("in", "both") and b in ln and a in rn:
                out.append((t, (a, b), False))
        return out

    def rel_frame(self, steps: list, prefix: str, columns: dict[str, Ty], props: list[str], from_left: bool = True, whole: bool = True) -> DataFrame:
        """Columns <prefix>__a, __at (left end and its table), __b, __bt (right end), and the relationship's own."""
        parts = []
        for t, (x, y), forward in steps:
            xi, yi = self.catalog.node(x).id, self.catalog.node(y).id
            a, b, ai, bi = ("_src", "_dst", xi, yi) if forward else ("_dst", "_src", yi, xi)
            cols = [f"{a} AS `{prefix}__a`", f"{ai} AS `{prefix}__at`", f"{b} AS `{prefix}__b`", f"{bi} AS `{prefix}__bt`"]
            if whole:
                cols += [f"_off AS `{prefix}__off`", f"{t.ids[x, y]} AS `{prefix}__tab`", f"_src AS `{prefix}__src`", f"_dst AS `{prefix}__dst`", f"{xi} AS `{prefix}__stab`", f"{yi} AS `{prefix}__dtab`"]
            later = {}
            for c in props:
                own, name = t.column(c), f"{prefix}__p_{c}"
                if own:
                    cols.append(f"{quoted(own)} AS {quoted(name)}")
                    if t.columns[own] != columns[c]:
                        later[name] = cast(E(F.col(quoted(name)), t.columns[own]), columns[c]).col.cast(spark_type(columns[c]))
                else:
                    cols.append(f"CAST(NULL AS {spark_type(columns[c]).simpleString()}) AS {quoted(name)}")
            part = t.pairs[x, y].selectExpr(*cols)
            parts.append(part.withColumns(later) if later else part)
        if not parts:
            empty = self.spark.range(0).select(*[F.lit(None).cast("bigint").alias(f"{prefix}__{x}") for x in ("a", "at", "b", "bt", *(("off", "tab", "src", "dst", "stab", "dtab") if whole else ()))], *[F.lit(None).cast(spark_type(columns[c])).alias(f"{prefix}__p_{c}") for c in props])
            return empty
        return reduce(lambda a, b: a.unionByName(b), parts)

    def match(self, frame: Frame, m: A.Match, following) -> Frame:
        if m.optional and (frame.df is not None or frame.scope):
            return self.optional(frame, m)
        if m.optional:
            base = Frame(self.spark.range(1).select(), {})
            return self.optional(base, m)
        return self.pattern(frame, m, self.weights(following))

    def weights(self, following) -> bool:
        """Whether the next clause can take rows with a multiplicity."""
        if not isinstance(following, (A.With, A.Return)):
            return False
        items = following.body.items
        calls = [x for i in items for x in walk(i.expr) if x[0] == "call" and x[1] in AGGREGATES]
        return bool(calls) and not following.body.star and all(x[1] in ("count_star", "count", "sum", "min", "max", "avg") for x in calls)

    def optional(self, frame: Frame, m: A.Match) -> Frame:
        got, pairs = self.subquery(frame, m.paths, m.where)
        new = {v: b for v, b in got.scope.items() if v not in frame.scope}
        keep = list(dict.fromkeys(c for b in new.values() for c in b.own()))
        fresh = {b: self.fresh("o") for _, b in pairs}
        if not keep:
            keep = []
        inner = got.df.select(*[F.col(b).alias(n) for b, n in fresh.items()], *[F.col(c) for c in keep])
        df = self.start(frame)
        free = self.correlation(frame, m.paths, m.where)[1]
        conds = [(a, fresh[b]) for a, b in pairs]
        if conds:
            df = df.join(inner, self.joined_on(df, conds, not free), "left").drop(*fresh.values())
        else:
            df = df.join(inner, F.lit(True), "left")
        return Frame(df, {**frame.scope, **new}, frame.mult)

    def pattern(self, frame: Frame, m: A.Match, weigh: bool) -> Frame:
        from knotwork.operators import paths as routes

        nodes: dict[str, list] = {}  # name -> patterns
        edges: list[dict] = []
        named: list[tuple[str, list]] = []
        for path in m.paths:
            names = []
            for k, p in enumerate(path.parts):
                if isinstance(p, A.NodePattern):
                    v = p.var or f"_n{self.fresh()}"
                    nodes.setdefault(v, []).append(p)
                    names.append(v)
                else:
                    v = p.var or f"_r{self.fresh()}"
                    if v in frame.scope or any(e["name"] == v for e in edges):
                        raise BinderError(f"Bind relationship {v} to relationship with same name is not supported.")
                    edges.append({"name": v, "rel": p, "left": names[-1], "right": None})
                    names.append(v)
                if k and isinstance(p, A.NodePattern):
                    edges[-1]["right"] = names[-1]
            if path.var:
                named.append((path.var, names))
        tables: dict[str, list[NodeTable]] = {}
        for v, ps in nodes.items():
            b = frame.scope.get(v)
            if b is not None and b.kind == "value" and b.ty.name == "NODE":
                frame = self.rebind(frame, v)
                b = frame.scope[v]
            if b is not None and b.kind != "node":
                raise BinderError(f"{v} has data type {getattr(b, 'ty', b.kind)} but NODE was expected.")
            labels = [x for p in ps for x in p.labels]
            t = self.node_tables(labels, v)
            tables[v] = [x for x in b.tables if not labels or x in t] if b is not None else t
        for _ in range(2):  # ends narrow each other
            for e in edges:
                if e["rel"].hops:
                    continue
                s = self.steps(e["rel"], tables[e["left"]], tables[e["right"]])
                ends = {(a if f else b) for _, (a, b), f in s}, {(b if f else a) for _, (a, b), f in s}
                for v, keep in zip((e["left"], e["right"]), ends, strict=True):
                    if v not in frame.scope and s:
                        tables[v] = [t for t in tables[v] if t.name in keep]
        in_paths = {x for v, names in named if self.needs(v) - {"-"} for x in names}
        where_needs = self.needs

        ended = {v for e in edges if "*ends" in self.needs(e["name"]) for v in (e["left"], e["right"])}

        if "_nodes" in self.catalog.nodes:  # labels and properties of a schemaless graph are data
            ended |= {*nodes, *(e["name"] for e in edges)}

        def read(v: str) -> set[str]:
            return where_needs(v) | ({"*"} if v in ended else set()) | ({"*"} if v in in_paths else set()) | {k.lower() for p in nodes.get(v, []) for k, _ in p.props}

        messages: dict[str, list[DataFrame]] = {}
        pending = list(edges)
        if weigh:
            pending = self.fold(frame, nodes, pending, tables, read, messages)
        state = {"df": frame.df, "scope": dict(frame.scope), "mult": frame.mult}

        def bind(v: str, join_from: DataFrame | None, many: bool, off: str | None) -> None:
            """Make v a bound node: by a scan, or by places that a relationship gave (off)."""
            columns = merged(tables[v], v)
            props = list(columns) if "*" in read(v) else [c for c in columns if c.lower() in read(v)]
            node = Node(off or self.fresh(v), tables[v], columns, many, True, {})
            node.loads = {c: f"{node.prefix}__p_{c}" for c in props}
            state["scope"][v] = node
            if off is None:
                lone = messages.get(v) and not props
                if lone:
                    first = messages[v].pop(0)
                    scan = first.select(F.col(first.columns[0]).alias(f"{node.prefix}__off"), *([F.col("_t").alias(f"{node.prefix}__tab")] if many else []), F.col("_w").alias(w := self.fresh("w")))
                    state["mult_new"] = w
                else:
                    scan = self.scan(node.prefix, tables[v], columns, props, many)
                state["df"] = scan if state["df"] is None else state["df"].crossJoin(scan)
                if lone:
                    weigh_by(w)
            elif props:
                s = self.scan(t := self.fresh("s"), tables[v], columns, props, many)
                cond = F.col(f"{node.prefix}__off") == F.col(f"{t}__off")
                if many:
                    cond = cond & (F.col(f"{node.prefix}__tab") == F.col(f"{t}__tab"))
                state["df"] = state["df"].join(s, cond).drop(f"{t}__off", f"{t}__tab").withColumnsRenamed({f"{t}__p_{c}": f"{node.prefix}__p_{c}" for c in props})
            attach(v)
            inline(v)

        def weigh_by(w: str) -> None:
            if state["mult"] is None:
                state["mult"] = w
            else:
                n = self.fresh("w")
                state["df"] = state["df"].withColumn(n, F.col(state["mult"]) * F.col(w)).drop(w)
                state["mult"] = n

        def attach(v: str) -> None:
            node = state["scope"][v]
            for msg in messages.pop(v, []):
                k, t, w = self.fresh("k"), self.fresh("t"), self.fresh("w")
                msg = msg.select(F.col(msg.columns[0]).alias(k), F.col("_t").alias(t), F.col("_w").alias(w))
                cond = node.off() == F.col(k)
                if node.many:
                    cond = cond & (node.tab() == F.col(t))
                state["df"] = state["df"].join(msg, cond).drop(k, t)
                weigh_by(w)

        def inline(v: str) -> None:
            free = [x for p in nodes.get(v, []) for x in p.labels if x != "_nodes"] if any(t.name == "_nodes" for t in tables[v]) else []
            if free:
                labels = F.col(state["scope"][v].loads["label"])
                state["df"] = state["df"].filter(reduce(lambda x, y: x | y, [F.array_contains(labels, x) for x in free]))
            for p in nodes.get(v, []):
                for k, x in p.props:
                    state["df"] = state["df"].filter(X.compare("=", state["scope"][v].prop(k), self.expr(x, state["scope"])).col)

        bound = lambda v: v in state["scope"]
        for v in nodes:
            if bound(v):
                node = state["scope"][v]
                if len(tables[v]) < len(node.tables):
                    state["df"] = state["df"].filter(node.tab().isin([t.id for t in tables[v]]) if tables[v] else F.lit(False))
                attach(v)
                inline(v)
        while pending:
            ready = [e for e in pending if bound(e["left"]) or bound(e["right"])]
            if not ready:
                ends = dict.fromkeys(x for e in pending for x in (e["left"], e["right"]))
                worth = {v: self.worth(v, nodes, tables, m.where, 0) for v in ends}
                widest = {v: max(self.closure(e, pending, tables) for e in pending if v in (e["left"], e["right"])) for v in ends}
                start = max(ends, key=lambda v: (worth[v], widest[v]))
                # a start that only passes rows on needs no scan: the relationship that leads furthest without fan-out names it
                near = [e for e in pending if start in (e["left"], e["right"]) and not e["rel"].hops]
                e = max(near, key=lambda e: self.closure(e, pending, tables)) if near else None
                if e is not None and state["df"] is None and not messages.get(start):
                    pending.remove(e)
                    self.first_edge(state, e, start, tables, read, bind)
                    self.rel_inline(state, e)
                    continue
                bind(start, None, len(tables[start]) > 1, None)
                continue
            single = lambda e: self.functional(e, e["left"] if bound(e["left"]) else e["right"], tables)
            ready.sort(key=lambda e: (not (bound(e["left"]) and bound(e["right"])), bool(e["rel"].hops), not single(e)))
            e = ready[0]
            if not (bound(e["left"]) and bound(e["right"])) and not single(e) and not e["rel"].hops:
                pair = self.closing_pair(e, ready, bound, tables)
                if pair:
                    self.extend_pair(state, pair, tables, read, bind)
                    for x in pair:
                        pending.remove(x)
                        self.rel_inline(state, x)
                    continue
            pending.remove(e)
            if e["rel"].hops:
                routes.extend(self, state, e, tables, read, bind, in_paths)
            else:
                self.extend(state, e, tables, read, bind)
            self.rel_inline(state, e)
        for v in nodes:
            if not bound(v) and v not in self.folded:
                bind(v, None, len(tables[v]) > 1, None)
        out = Frame(state["df"], state["scope"], state["mult"])
        for v, names in named:
            out = routes.assemble(self, out, v, names)
        if m.where is not None:
            out = self.where(out, m.where)
        hidden = {v for v in out.scope if v.startswith(("_n", "_r")) and v not in frame.scope}
        return Frame(out.df, {v: b for v, b in out.scope.items() if v not in hidden}, out.mult)

    folded: set[str] = set()

    def rel_inline(self, state: dict, e: dict) -> None:
        free = [x for x in e["rel"].types if x != "_edges"]
        if free and "_edges" in self.catalog.rels and not e["rel"].hops:
            state["df"] = state["df"].filter(F.col(state["scope"][e["name"]].loads["label"]).isin(free))
        if e["rel"].props and not e["rel"].hops:
            for k, x in e["rel"].props:
                state["df"] = state["df"].filter(X.compare("=", state["scope"][e["name"]].prop(k), self.expr(x, state["scope"])).col)

    def rebind(self, frame: Frame, v: str) -> Frame:
        """A node value (of UNWIND) as a node variable."""
        b = frame.scope[v]
        node = Node(self.fresh(v), list(self.catalog.nodes.values()), {f: t for f, t in zip(b.ty.fields, b.ty.args, strict=True) if not f.startswith("_")}, True, True)
        node.loads = {c: f"{node.prefix}__p_{c}" for c in node.columns}
        c = F.col(b.column)
        df = frame.df.withColumns({f"{node.prefix}__off": c["_id"]["offset"], f"{node.prefix}__tab": c["_id"]["table"], **{x: c[p] for p, x in node.loads.items()}})
        return Frame(df, {**frame.scope, v: node}, frame.mult)

    def worth(self, v: str, nodes: dict, tables: dict, where: tuple | None, degree: int) -> tuple:
        """How good a node is to start from: fixed by its key, by a property, by a condition; then the most connected one."""
        equal, near = 0, 0
        for p in nodes[v]:
            for k, _ in p.props:
                equal = max(equal, 2 if any(t.key.lower() == k.lower() for t in tables[v]) else 1)
        for c in self.conjuncts(where) if where is not None else []:
            own = [x for x in walk(c) if x[0] == "prop" and x[1] == ("var", v)]
            if own and c[0] == "cmp" and (c[2][0] == "lit" or c[3][0] == "lit"):
                key = any(t.key.lower() == own[0][2].lower() for t in tables[v])
                equal, near = max(equal, (2 if key else 1) if c[1] == "=" else 0), 1
        return equal, near, degree

    def functional(self, e: dict, v: str, tables: dict) -> bool:
        """Whether each node of v has one such relationship at most, by the tables' multiplicity."""
        if e["rel"].hops or e["left"] == e["right"]:
            return False
        steps = self.steps(e["rel"], tables[e["left"]], tables[e["right"]])
        from_left = v == e["left"]
        seen = [((pair[0] if forward else pair[1]) if from_left else (pair[1] if forward else pair[0])) for _, pair, forward in steps]
        one = all(t.many.split("_")[1 if forward == from_left else 0] == "ONE" for t, _, forward in steps)
        return one and len(set(seen)) == len(seen)

    def closure(self, e: dict, pending: list[dict], tables: dict) -> int:
        """How many nodes a relationship leads to without fan-out."""
        if e["rel"].hops:
            return 0
        known, grown = {e["left"], e["right"]}, True
        while grown:
            grown = False
            for x in pending:
                for v, w in ((x["left"], x["right"]), (x["right"], x["left"])):
                    if v in known and w not in known and self.functional(x, v, tables):
                        known.add(w)
                        grown = True
        return len(known)

    def closing_pair(self, e: dict, ready: list[dict], bound, tables: dict) -> list[dict] | None:
        """Two relationships from one new node to nodes that are bound, of which one is single for the new node: joined with
        each other first (no more rows than the other one has), they meet the rest by both bound ends at once."""
        new = e["right"] if bound(e["left"]) else e["left"]
        both = [x for x in ready if not x["rel"].hops and new in (x["left"], x["right"]) and x["left"] != x["right"]]
        if len(both) == 2 and any(self.functional(x, new, tables) for x in both):
            return both
        return None

    def extend_pair(self, state: dict, pair: list[dict], tables: dict, read, bind) -> None:
        rels, frames, ends = [], [], []
        new = next(v for v in (pair[0]["left"], pair[0]["right"]) if v not in state["scope"])
        for e in pair:
            steps = self.steps(e["rel"], tables[e["left"]], tables[e["right"]])
            rel = self.make_rel(e, steps, read)
            rels.append(rel)
            frames.append(self.rel_frame(steps, rel.prefix, rel.columns, list(rel.loads)))
            ends.append(("a", "b") if e["left"] == new else ("b", "a"))  # the new node's side, the bound one's
        (n0, b0), (n1, b1) = ends
        p, q = rels[0].prefix, rels[1].prefix
        many = len(tables[new]) > 1
        cond = F.col(f"{p}__{n0}") == F.col(f"{q}__{n1}")
        if many:
            cond = cond & (F.col(f"{p}__{n0}t") == F.col(f"{q}__{n1}t"))
        both = frames[0].join(frames[1], cond)
        conds = []
        for e, rel, side in zip(pair, rels, (b0, b1), strict=True):
            node = state["scope"][e["right"] if e["left"] == new else e["left"]]
            conds.append(node.off() == F.col(f"{rel.prefix}__{side}"))
            conds.append(node.tab() == F.col(f"{rel.prefix}__{side}t"))
        state["df"] = state["df"].join(both, reduce(lambda x, y: x & y, conds))
        prefix = self.fresh(new)
        state["df"] = state["df"].withColumns({f"{prefix}__off": F.col(f"{p}__{n0}"), **({f"{prefix}__tab": F.col(f"{p}__{n0}t")} if many else {})})
        bind(new, None, many, prefix)
        for e, rel in zip(pair, rels, strict=True):
            self.settle(state, rel, e)

    def first_edge(self, state: dict, e: dict, start: str, tables: dict, read, bind) -> None:
        """Begin with a relationship table itself: both its ends come from it."""
        steps = self.steps(e["rel"], tables[e["left"]], tables[e["right"]])
        rel = self.make_rel(e, steps, read)
        state["df"] = self.rel_frame(steps, rel.prefix, rel.columns, list(rel.loads))
        same = e["left"] == e["right"]
        if same:
            state["df"] = state["df"].filter((F.col(f"{rel.prefix}__a") == F.col(f"{rel.prefix}__b")) & (F.col(f"{rel.prefix}__at") == F.col(f"{rel.prefix}__bt")))
        ends = [(e["left"], "a"), (e["right"], "b")][: 1 if same else 2]
        for v, x in ends:
            many = len(tables[v]) > 1
            prefix = self.fresh(v)
            state["df"] = state["df"].withColumn(f"{prefix}__off", F.col(f"{rel.prefix}__{x}"))
            if many:
                state["df"] = state["df"].withColumn(f"{prefix}__tab", F.col(f"{rel.prefix}__{x}t"))
            bind(v, None, many, prefix)
        self.settle(state, rel, e)

    def make_rel(self, e: dict, steps: list, read) -> Rel:
        known = [(t, p) for t, p, _ in steps] or self.candidates(e["rel"])
        columns = merged([t for t, _ in known], e["name"])
        rel = Rel(self.fresh(e["name"]), list({(t.name, p): (t, p) for t, p in known}.values()), columns)
        need = read(e["name"]) | {k.lower() for k, _ in e["rel"].props}
        rel.loads = {c: f"{rel.prefix}__p_{c}" for c in columns if "*" in need or c.lower() in need}
        return rel

    def settle(self, state: dict, rel: Rel, e: dict) -> None:
        state["df"] = state["df"].drop(*[f"{rel.prefix}__{x}" for x in ("a", "at", "b", "bt")])
        out = e["rel"].direction != "in"
        rel.src, rel.dst = (state["scope"].get(e["left" if out else "right"]), state["scope"].get(e["right" if out else "left"]))
        state["scope"][e["name"]] = rel

    def extend(self, state: dict, e: dict, tables: dict, read, bind) -> None:
        steps = self.steps(e["rel"], tables[e["left"]], tables[e["right"]])
        rel = self.make_rel(e, steps, read)
        right = self.rel_frame(steps, rel.prefix, rel.columns, list(rel.loads))
        conds = []
        for v, x in ((e["left"], "a"), (e["right"], "b")):
            node = state["scope"].get(v)
            if node is not None:
                conds.append(node.off() == F.col(f"{rel.prefix}__{x}"))
                if node.many or len({(p[0] if (x == "a") == f else p[1]) for _, p, f in steps}) > 1:
                    conds.append(node.tab() == F.col(f"{rel.prefix}__{x}t"))
        state["df"] = state["df"].join(right, reduce(lambda p, q: p & q, conds))
        for v, x in ((e["left"], "a"), (e["right"], "b")):
            if v not in state["scope"]:
                many = len(tables[v]) > 1
                prefix = self.fresh(v)
                state["df"] = state["df"].withColumn(f"{prefix}__off", F.col(f"{rel.prefix}__{x}"))
                if many:
                    state["df"] = state["df"].withColumn(f"{prefix}__tab", F.col(f"{rel.prefix}__{x}t"))
                bind(v, None, many, prefix)
        self.settle(state, rel, e)

    def fold(self, frame: Frame, nodes: dict, pending: list[dict], tables: dict, read, messages: dict) -> list[dict]:
        """Leaves that nothing reads become counts by the node they hang on, aggregated before any join, leaf by leaf."""
        self.folded = set()
        pending = list(pending)
        changed = True
        while changed:
            changed = False
            for e in pending:
                r = e["rel"]
                if r.hops or r.props or read(e["name"]) - {"-"} or (read(e["name"]) and "-" in read(e["name"])):
                    continue
                for leaf, other, leaf_right in ((e["right"], e["left"], True), (e["left"], e["right"], False)):
                    degree = sum(leaf in (x["left"], x["right"]) for x in pending)
                    if leaf == other or degree != 1 or leaf in frame.scope or read(leaf) or any(p.props for p in nodes[leaf]):
                        continue
                    if len(pending) == 1 and other not in frame.scope and not read(other) and not any(p.props for p in nodes[other]) and not messages.get(other) and not messages.get(leaf) and frame.df is None:
                        continue  # a lone relationship: its rows are the count
                    steps = self.steps(r, tables[e["left"]], tables[e["right"]])
                    p = self.fresh("f")
                    df = self.rel_frame(steps, p, {}, [], whole=False)
                    near, far = ("a", "b") if leaf_right else ("b", "a")
                    weight = None
                    for msg in messages.pop(leaf, []):
                        k, t, w = self.fresh("k"), self.fresh("t"), self.fresh("w")
                        msg = msg.select(F.col(msg.columns[0]).alias(k), F.col("_t").alias(t), F.col("_w").alias(w))
                        df = df.join(msg, (F.col(f"{p}__{far}") == F.col(k)) & (F.col(f"{p}__{far}t") == F.col(t)) if len(tables[leaf]) > 1 else F.col(f"{p}__{far}") == F.col(k))
                        weight = F.col(w) if weight is None else weight * F.col(w)
                    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
                    grouped = df.groupBy(F.col(f"{p}__{near}").alias("_k"), F.col(f"{p}__{near}t").alias("_t")).agg(total.alias("_w"))
                    messages.setdefault(other, []).append(grouped)
                    pending.remove(e)
                    self.folded.add(leaf)
                    changed = True
                    break
                if changed:
                    break
        return pending

    # ------------------------------------------------------------ other sources
    def call(self, frame: Frame, c: A.Call) -> Frame:
        from knotwork.operators import algorithms, introspection

        name = c.name.lower()
        if name in algorithms.ALGORITHMS:
            df, bindings = algorithms.source(self, c)
        else:
            df, bindings = introspection.source(self, c)
            if df is None:
                return frame
        wanted = c.items or [(k, k) for k in bindings]
        scope = dict(frame.scope)
        for col, alias in wanted:
            b = next((v for k, v in bindings.items() if k.lower() == col.lower()), None)
            if b is None:
                raise BinderError(f"Unknown yield variable name: {col}.")
            scope[alias] = b
        got = df if frame.df is None else frame.df.crossJoin(df)
        out = Frame(got, scope, frame.mult)
        for v, b in list(out.scope.items()):
            if b.kind == "node" and not b.loaded:
                out = self.load_node(out, v)
        if c.where is not None:
            out = self.where(out, c.where)
        return out

    def load_node(self, frame: Frame, v: str) -> Frame:
        b = frame.scope[v]
        props = self.wanted(v, b.columns)
        node = Node(b.prefix, b.tables, b.columns, b.many, True, {c: f"{b.prefix}__p_{c}" for c in props})
        df = frame.df
        if props:
            s = self.scan(t := self.fresh("s"), b.tables, b.columns, props, b.many)
            cond = F.col(f"{b.prefix}__off") == F.col(f"{t}__off")
            if b.many:
                cond = cond & (F.col(f"{b.prefix}__tab") == F.col(f"{t}__tab"))
            df = df.join(s, cond).drop(f"{t}__off", f"{t}__tab").withColumnsRenamed({f"{t}__p_{c}": f"{b.prefix}__p_{c}" for c in props})
        return Frame(df, {**frame.scope, v: node}, frame.mult)

    def load(self, frame: Frame, c: A.LoadFrom) -> Frame:
        from knotwork.sources.files import read_files

        columns = [(n, parse_type(t, self.catalog.types)) for n, t in c.columns] if c.columns else None
        df, types = read_files(self.session, c.files, c.options, columns)
        scope = dict(frame.scope)
        renamed = {}
        for n, ty in types.items():
            renamed[n] = self.fresh(n)
            scope[n] = Value(renamed[n], ty)
        df = df.withColumnsRenamed(renamed)
        out = Frame(df if frame.df is None else frame.df.crossJoin(df), scope, frame.mult)
        return self.where(out, c.where) if c.where is not None else out

    # ------------------------------------------------------------ expressions
    def expr(self, e: tuple, scope: dict) -> E:
        if self.aggregates is not None and e[0] == "call" and repr(e) in self.aggregates:
            return self.aggregates[repr(e)]
        return getattr(self, f"e_{e[0]}")(e, scope)

    def e_lit(self, e, scope) -> E:
        return lit(e[1])

    def e_param(self, e, scope) -> E:
        if e[1] not in self.params:
            raise BinderError(f"Parameter {e[1]} not found.")
        return lit(self.params[e[1]])

    def e_var(self, e, scope) -> E:
        b = scope.get(e[1]) or next((v for k, v in scope.items() if k.lower() == e[1].lower()), None)
        if b is None:
            raise BinderError(f"Variable {e[1]} is not in scope.")
        return b if isinstance(b, E) else self.binding(b)

    def e_prop(self, e, scope) -> E:
        base, name = e[1], e[2]
        if base[0] == "var":
            b = scope.get(base[1])
            if b is not None and not isinstance(b, E) and b.kind in ("node", "rel"):
                if name.lower() in ("_id", "_label"):
                    return E(b.id(), INTERNAL_ID) if name.lower() == "_id" else E(b.label(), STRING)
                return b.prop(name)
        x = self.expr(base, scope)
        if x.ty.name in ("NODE", "REL"):
            t = x.ty.field(name)
            if t is None:
                raise BinderError(f"Cannot find property {name}.")
            return E(x.col[next(f for f in x.ty.fields if f.lower() == name.lower())], t)
        if x.ty.name == "STRUCT":
            return R.field(x, name)
        if x.ty.name == "MAP":
            got = R.FUNCTIONS["map_extract"]([x, lit(name)], self)
            return E(F.get(got.col, F.lit(0)), x.ty.args[1])
        if x.ty.name == "UNION":
            return R.FUNCTIONS["union_extract"]([x, lit(name)], self)
        if x.ty.name == "JSON":
            return E(F.get_json_object(x.col, f"$.{name}"), Ty("JSON"))
        raise BinderError(f"{base} has data type {x.ty} but NODE, REL or STRUCT was expected.")

    def e_and(self, e, scope) -> E:
        return E(X.truth(self.expr(e[1], scope)) & X.truth(self.expr(e[2], scope)), BOOL)

    def e_or(self, e, scope) -> E:
        return E(X.truth(self.expr(e[1], scope)) | X.truth(self.expr(e[2], scope)), BOOL)

    def e_xor(self, e, scope) -> E:
        return E(X.truth(self.expr(e[1], scope)) != X.truth(self.expr(e[2], scope)), BOOL)

    def e_not(self, e, scope) -> E:
        return E(~X.truth(self.expr(e[1], scope)), BOOL)

    def e_cmp(self, e, scope) -> E:
        return X.compare(e[1], self.expr(e[2], scope), self.expr(e[3], scope))

    def e_isnull(self, e, scope) -> E:
        x = self.expr(e[1], scope)
        return E(x.col.isNull() if e[2] else x.col.isNotNull(), BOOL)

    def e_list(self, e, scope) -> E:
        return X.make_list([self.expr(x, scope) for x in e[1]])

    def e_struct(self, e, scope) -> E:
        items = {}
        for k, v in e[1]:
            if k.lower() in {x.lower() for x in items}:
                raise BinderError(f"Duplicate field {k} in a struct.")
            items[k] = self.expr(v, scope)
        return X.struct_of(items)

    def e_cast(self, e, scope) -> E:
        return cast(self.expr(e[1], scope), parse_type(e[2], self.catalog.types), True)

    def e_slice(self, e, scope) -> E:
        return R.slice_of(self.expr(e[1], scope), *[self.expr(x, scope) if x is not None else None for x in e[2:4]])

    def e_case(self, e, scope) -> E:
        _, operand, whens, otherwise = e
        results = [self.expr(t, scope) for _, t in whens]
        last = otherwise and self.expr(otherwise, scope)
        t = next((r.ty for r in reversed(results) if r.ty.name != "ANY"), last.ty if last else Ty("ANY"))
        out = None
        x = self.expr(operand, scope) if operand is not None else None
        for (w, _), r in zip(whens, results, strict=True):
            v = self.expr(w, scope)
            if x is None:
                cond = X.truth(v)
            elif v.is_const and v.const is None:
                cond = F.lit(True)  # a NULL always matches
            else:
                cond = F.coalesce(X.compare("=", x, v).col, F.lit(False)) if v.is_const else v.col.isNull() | F.coalesce(X.compare("=", x, v).col, F.lit(False))
            value = cast(r, t, True).col if r.ty != t else r.col
            out = F.when(cond, value) if out is None else out.when(cond, value)
        if last is not None:
            out = out.otherwise(cast(last, t, True).col if last.ty != t else last.col)
        return E(out, t)

    def e_exists(self, e, scope) -> E:
        return self.mark(e, scope)

    def e_count(self, e, scope) -> E:
        return self.mark(e, scope)

    def apply(self, body: tuple, scope: dict, name: str, ty: Ty):
        """A Python function of a column, for a lambda."""
        return lambda c: self.expr(body, {**scope, name: E(c, ty)})

    def lambda_list(self, e: tuple, scope: dict) -> E:
        x = self.expr(e, scope)
        if x.ty.name == "ANY":
            return E(F.array(), list_of(Ty("ANY")))
        if not x.ty.listy:
            raise BinderError(f"{x.ty} is not a list.")
        return x

    def filtered(self, l_: E, name: str, body: tuple, scope: dict) -> E:
        f = self.apply(body, scope, name, l_.ty.args[0])
        return E(F.filter(l_.col, lambda c: F.coalesce(X.truth(f(c)), F.lit(False))), list_of(l_.ty.args[0]))

    def transformed(self, l_: E, name: str, body: tuple, scope: dict) -> E:
        f = self.apply(body, scope, name, l_.ty.args[0])
        seen: list[Ty] = []

        def one(c: Column) -> Column:
            x = f(c)
            seen.append(x.ty)
            return x.col

        col = F.transform(l_.col, one)
        return E(col, list_of(seen[0]))

    def e_comprehension(self, e, scope) -> E:
        _, name, l_, where, out = e
        x = self.lambda_list(l_, scope)
        if where is not None:
            x = self.filtered(x, name, where, scope)
        return self.transformed(x, name, out, scope) if out is not None else x

    def e_quantifier(self, e, scope) -> E:
        _, kind, name, l_, p = e
        x = self.lambda_list(l_, scope)
        n = F.size(self.filtered(x, name, p, scope).col)
        made = {"all": n == F.size(x.col), "any": n > 0, "none": n == 0, "single": n == 1}[kind]
        return E(F.when(x.col.isNotNull(), made), BOOL)

    def e_call(self, e, scope) -> E:
        _, name, args, distinct, named = e
        if name in AGGREGATES:
            raise BinderError(f"Aggregate {name} is not allowed here.")
        special = getattr(self, f"f_{name}", None)
        if special:
            return special(args, named, scope)
        macro = self.catalog.macros.get(name)
        if macro:
            return self.expr(self.session.expand(macro, args, named), scope)
        made = [self.expr(a, scope) for a in args]
        udf = self.session.udfs.get(name)
        if udf:
            return udf(made)
        f = R.FUNCTIONS.get(name)
        if f is None:
            raise CatalogError(f"function {name.upper()} does not exist.")
        return f(made, self)

    # lambdas and named arguments
    def f_list_transform(self, args, named, scope) -> E:
        return self.transformed(self.lambda_list(args[0], scope), args[1][1][0], args[1][2], scope)

    def f_list_filter(self, args, named, scope) -> E:
        return self.filtered(self.lambda_list(args[0], scope), args[1][1][0], args[1][2], scope)

    def f_list_reduce(self, args, named, scope) -> E:
        x = self.lambda_list(args[0], scope)
        (a, b), body, t = args[1][1], args[1][2], x.ty.args[0]
        step = lambda p, q: cast(self.expr(body, {**scope, a: E(p, t), b: E(q, t)}), t, True).col
        rest = F.slice(x.col, F.lit(2), F.greatest(F.size(x.col) - 1, F.lit(0)))
        empty = F.raise_error(F.lit("Runtime exception: Cannot execute list_reduce on an empty list."))
        return E(F.when(F.size(x.col) > 0, F.reduce(rest, F.get(x.col, F.lit(0)), step)).when(x.col.isNotNull(), empty), t)

    f_any = f_all = f_none = f_single = None

    def f_struct_pack(self, args, named, scope) -> E:
        items = {k: self.expr(v, scope) for k, v in named.items()}
        for a in args:
            items[a[2] if a[0] == "prop" else a[1]] = self.expr(a, scope)
        return X.struct_of(items)

    def f_union_value(self, args, named, scope) -> E:
        (k, v), = named.items()
        x = self.expr(v, scope)
        return E(F.struct(F.lit(k).alias("tag"), x.col.alias(k)), Ty("UNION", (x.ty,), (k,)))

    # graph functions
    def entity(self, args, scope):
        x = self.expr(args[0], scope)
        return x, x.entity

    def f_id(self, args, named, scope) -> E:
        x, b = self.entity(args, scope)
        return E(b.id() if b is not None and b.kind != "route" else x.col["_id"], INTERNAL_ID)

    def f_label(self, args, named, scope) -> E:
        x, b = self.entity(args, scope)
        if x.ty.name not in ("NODE", "REL"):
            raise BinderError(f"Cannot match a built-in function for given function LABEL({x.ty}).")
        return E(b.label() if b is not None else x.col["_label"], STRING)

    f_labels = f_label

    def f_offset(self, args, named, scope) -> E:
        x = self.expr(args[0], scope)
        return E(x.col["offset"], INT64)

    def f_rowid(self, args, named, scope) -> E:
        x, b = self.entity(args, scope)
        return E(b.off() if b is not None else x.col["_id"]["offset"], INT64)

    def f_keys(self, args, named, scope) -> E:
        x, b = self.entity(args, scope)
        names = list(b.columns) if b is not None else [f for f in x.ty.fields if not f.startswith("_")]
        return X.make_list([lit(n) for n in names])

    def f_length(self, args, named, scope) -> E:
        x = self.expr(args[0], scope) if not (args[0][0] == "var" and getattr(scope.get(args[0][1]), "kind", "") == "route") else None
        if x is None:
            return E(scope[args[0][1]].part("len").cast("bigint"), INT64)
        if x.ty.name == "RECURSIVE_REL":
            return E(F.size(x.col["_rels"]).cast("bigint"), INT64)
        return R.FUNCTIONS["size"]([x], self)

    def f_nodes(self, args, named, scope) -> E:
        x = self.expr(args[0], scope)
        if x.ty.name != "RECURSIVE_REL":
            raise BinderError(f"Cannot match a built-in function for given function NODES({x.ty}).")
        return E(x.col["_nodes"], x.ty.args[0])

    def f_rels(self, args, named, scope) -> E:
        x = self.expr(args[0], scope)
        if x.ty.name != "RECURSIVE_REL":
            raise BinderError(f"Cannot match a built-in function for given function RELS({x.ty}).")
        return E(x.col["_rels"], x.ty.args[1])

    f_relationships = f_rels

    def f_properties(self, args, named, scope) -> E:
        x, key = self.expr(args[0], scope), self.expr(args[1], scope)
        t = x.ty.args[0].field(str(key.const))
        if t is None:
            raise BinderError(f"Invalid property name: {key.const}.")
        real = next(f for f in x.ty.args[0].fields if f.lower() == str(key.const).lower())
        return E(F.transform(x.col, lambda v: v[real]), list_of(t))

    def f_cost(self, args, named, scope) -> E:
        b = scope.get(args[0][1]) if args[0][0] == "var" else None
        if getattr(b, "kind", "") != "route" or not b.cost:
            raise BinderError("COST is only defined for weighted shortest paths.")
        return E(b.part("cost").cast("double"), DOUBLE)

    def f_is_trail(self, args, named, scope) -> E:
        x = self.expr(args[0], scope)
        ids = F.transform(x.col["_rels"], lambda r: r["_id"])
        return E(F.size(ids) == F.size(F.array_distinct(ids)), BOOL)

    def f_is_acyclic(self, args, named, scope) -> E:
        x = self.expr(args[0], scope)
        ids = F.transform(x.col["_nodes"], lambda r: r["_id"])
        return E(F.size(ids) == F.size(F.array_distinct(ids)), BOOL)

    def endpoint(self, args, scope, which: str) -> E:
        b = scope.get(args[0][1]) if args[0][0] == "var" else None
        if getattr(b, "kind", "") == "rel":
            node = getattr(b, which)
            if node is not None:
                return node.value()
        x = self.expr(args[0], scope)
        if x.ty.name == "REL":
            c = x.col["_src" if which == "src" else "_dst"]
            return E(F.struct(c.alias("_id")), Ty("NODE", (INTERNAL_ID,), ("_id",)))
        return E(F.element_at(x.col["_nodes"], 1 if which == "src" else -1), x.ty.args[0].args[0])

    def f_start_node(self, args, named, scope) -> E:
        return self.endpoint(args, scope, "src")

    def f_end_node(self, args, named, scope) -> E:
        return self.endpoint(args, scope, "dst")

    # sequences: numbers are taken on the driver, as many as there are rows
    def sequence(self, args) -> Any:
        name = args[0][1]
        s = self.catalog.sequences.get(name)
        if s is None:
            raise CatalogError(f"{name} does not exist in catalog.")
        return s

    def f_currval(self, args, named, scope) -> E:
        s = self.sequence(args)
        if s.value is None:
            raise CatalogError(f'currval: sequence "{s.name}" is not yet defined. To define the sequence, call nextval first.')
        return lit(s.value)

    def f_nextval(self, args, named, scope) -> E:
        s = self.sequence(args)
        if self.frame is None or self.frame.df is None or not scope:
            return lit(s.take()[0])
        from knotwork.operators.write import numbered

        df, place, n = numbered(self, self.frame.df)
        self.frame.df = df
        first = s.take()[0] if n else 0
        room, again, turn = s.rooms(first)
        row = F.col(place)
        made = F.lit(first) + row * s.increment
        if n > room:
            if not s.cycle:
                s.value = first + (room - 1) * s.increment
                s.take()  # tells that the end is reached
            made = F.when(row < room, made).otherwise(F.lit(again) + F.pmod(row - room, F.lit(turn)) * s.increment)
            s.value = again + (n - 1 - room) % turn * s.increment
        elif n:
            s.value = first + (n - 1) * s.increment
        return E(made.cast("bigint"), INT64)


def unsupported(what: str) -> UnsupportedError:
    return UnsupportedError(f"{what} is not supported.")
