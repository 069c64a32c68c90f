"""Recursive relationships and path values.

Paths are worked out for the distinct starts of a frame, hop by hop: the frontier joins the relationship table, grouped by
start and place. Beyond LAZY_HOPS hops, or where what was seen before counts, each hop is written to the shared folder, so
plans stay small and the loop ends when the frontier is empty. Arrays of nodes and relationships are carried only where the
query reads them or the mode needs them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.errors import BinderError, RuntimeFault
from knotwork.functions import expr as X
from knotwork.functions.expr import E
from knotwork.operators.storage import materialize
from knotwork.plans import ast as A
from knotwork.types import INTERNAL_ID, STRING, Ty, common, list_of, spark_type

LAZY_HOPS = 4


def node_type(tables: list) -> Ty:
    columns: dict[str, Ty] = {}
    for t in tables:
        for c, ty in t.columns.items():
            have = next((k for k in columns if k.lower() == c.lower()), None)
            if have is None:
                columns[c] = ty
            elif common(columns[have], ty) is not None:
                columns[have] = common(columns[have], ty)
    return Ty("NODE", (INTERNAL_ID, STRING, *columns.values()), ("_id", "_label", *columns))


def rel_type(tables: list) -> Ty:
    columns: dict[str, Ty] = {}
    for t in tables:
        columns |= {c: ty for c, ty in t.columns.items() if c not in columns}
    return Ty("REL", (INTERNAL_ID, INTERNAL_ID, INTERNAL_ID, STRING, *columns.values()), ("_src", "_dst", "_id", "_label", *columns))


def shaped(c, have: Ty, want: Ty):
    """A struct column with want's fields: those it has, and NULLs."""
    out = []
    for f, t in zip(want.fields, want.args, strict=True):
        own = next((x for x in have.fields if x.lower() == f.lower()), None)
        if own is None:
            out.append(F.lit(None).cast(spark_type(t)).alias(f))
        else:
            out.append((c[own] if have.field(own) == t else X.cast(E(c[own], have.field(own)), t).col).alias(f))
    return F.when(c.isNotNull(), F.struct(*out))


def _edges(tr, e: dict, name: str, steps: list, values: bool, weight: str | None) -> DataFrame:
    """Columns at, a, bt, b, and rel (a value) or only rid (its identity), w: the weight."""
    from knotwork.plans.translate import Rel, merged

    r = e["rel"]
    tables = list({t.name: t for t, _, _ in steps}.values())
    columns = merged(tables, name)
    rel = Rel(tr.fresh("e"), [(t, p) for t, p, _ in steps], columns)
    rel.loads = {c: f"{rel.prefix}__p_{c}" for c in columns}
    df = tr.rel_frame(steps, rel.prefix, columns, list(columns))
    scope = {}
    if r.step:
        scope[r.step[0]] = rel
    if r.var:
        scope.setdefault(r.var, rel)
    for k, x in r.props:
        df = df.filter(X.compare("=", rel.prop(k), tr.expr(x, {})).col)
    if r.step and r.step[2] is not None:
        for c in tr.conjuncts(r.step[2]):
            if not _reads(c, r.step[1]):
                df = df.filter(X.truth(tr.expr(c, scope)))
    p = rel.prefix
    cols = [F.col(f"{p}__at").cast("bigint").alias("at"), F.col(f"{p}__a").alias("a"), F.col(f"{p}__bt").cast("bigint").alias("bt"), F.col(f"{p}__b").alias("b"), F.struct(rel.tab().cast("bigint").alias("table"), rel.off().alias("offset")).alias("rid")]
    if values:
        cols.append(shaped(rel.value().col, rel.value().ty, rel_type(tables)).alias("rel"))
    if weight:
        w = rel.prop(weight)
        if not (w.ty.floating or (w.ty.integer and w.ty.name not in ("INT128", "UINT128"))):
            raise BinderError(f"{w.ty} weight type is not supported for weighted shortest path.")
        cols.append(w.col.cast("double").alias("w"))
    return df.select(*cols)


def _reads(e, var: str) -> bool:
    from knotwork.plans.translate import walk

    return any(x == ("var", var) for x in walk(e))


def _reversed(steps: list) -> list:
    return [(t, p, not f) for t, p, f in steps]


def extend(tr, state: dict, e: dict, tables: dict, read, bind, in_paths: set) -> None:
    from knotwork.plans.translate import Route

    r = e["rel"]
    low, high = r.hops
    low = 1 if low is None else low
    cap = int(tr.session.settings["var_length_extend_max_depth"])
    high = cap if high is None else high
    if high < low or high > cap and r.hops[1] is not None and high > cap:
        raise BinderError(f"Lower bound of rel {e['name']} is greater than upper bound, or the bound exceeds {cap}.")
    mode = r.mode or str(tr.session.settings["recursive_pattern_semantic"]).upper()
    if "SHORTEST" in mode and low != 1:
        raise BinderError("Lower bound of shortest/all_shortest path must be 1.")
    forward = e["left"] in state["scope"]
    start, end = (e["left"], e["right"]) if forward else (e["right"], e["left"])
    every = list(tr.catalog.nodes.values())
    steps = tr.steps(r, every, every)
    if not forward:
        steps = _reversed(steps)
    values = e["name"] in in_paths or bool(read(e["name"]) - {"-"})
    involved = list({n: tr.catalog.node(n) for _, p, _ in steps for n in p}.values()) or every
    nty, rty = node_type(involved), rel_type(list({t.name: t for t, _, _ in steps}.values()))
    edges = _edges(tr, e, e["name"], steps, values, r.weight)
    s = state["scope"][start]
    starts = state["df"].select(s.tab().cast("bigint").alias("st"), s.off().alias("so")).filter("so IS NOT NULL").distinct()
    people = None
    if values or (r.step and r.step[2] is not None and any(_reads(c, r.step[1]) for c in tr.conjuncts(r.step[2]))):
        from knotwork.plans.translate import Node

        columns = dict(zip(nty.fields[2:], nty.args[2:], strict=True))
        node = Node(tr.fresh("m"), involved, columns, True, True, {})
        node.loads = {c: f"{node.prefix}__p_{c}" for c in columns}
        scan = tr.scan(node.prefix, involved, columns, list(columns), True)
        gate = F.lit(True)
        if r.step and r.step[2] is not None:
            for c in tr.conjuncts(r.step[2]):
                if _reads(c, r.step[1]):
                    gate = gate & X.truth(tr.expr(c, {r.step[1]: node}))
        people = scan.select(node.tab().cast("bigint").alias("nt"), node.off().alias("no"), gate.alias("gate"), *([shaped(node.value().col, node.value().ty, nty).alias("node")] if values else []))
    gated = people is not None and r.step is not None and r.step[2] is not None
    found = _Walk(tr, starts, edges, people if (values or gated) else None, values, gated, spark_type(nty), spark_type(rty)).run(mode, low, high)
    prefix = tr.fresh(e["name"])
    cols = [F.col("st").alias(a := tr.fresh("a")), F.col("so").alias(b := tr.fresh("b")), F.col("ct").alias(ct := tr.fresh("c")), F.col("co").alias(co := tr.fresh("c")), F.col("len").cast("bigint").alias(f"{prefix}__len")]
    route = Route(prefix, nty if values else None, rty if values else None, cost="WSHORTEST" in mode)
    if values:
        turn = (lambda c: c) if forward else F.reverse
        cols += [turn(F.col("nodes")).alias(f"{prefix}__nodes"), turn(F.col("rels")).alias(f"{prefix}__rels")]
    if route.cost:
        cols.append(F.col("cost").alias(f"{prefix}__cost"))
    found = found.select(*cols)
    cond = (s.tab().cast("bigint") == F.col(a)) & (s.off() == F.col(b)) if s.many else s.off() == F.col(b)
    t = state["scope"].get(end)
    if t is not None:
        cond = cond & (t.off() == F.col(co)) & (t.tab().cast("bigint") == F.col(ct))
    else:
        found = found.filter(F.col(ct).isin([x.id for x in tables[end]]))
    state["df"] = state["df"].join(found, cond).drop(a, b)
    if t is None:
        many = len(tables[end]) > 1
        p = tr.fresh(end)
        state["df"] = state["df"].withColumns({f"{p}__off": F.col(co), **({f"{p}__tab": F.col(ct)} if many else {})}).drop(co, ct)
        bind(end, None, many, p)
    else:
        state["df"] = state["df"].drop(co, ct)
    state["scope"][e["name"]] = route


class _Walk:
    def __init__(self, tr, starts, edges, people, values, gated, node_type_, rel_type_):
        self.tr, self.starts, self.edges, self.people, self.values, self.gated, self.nt, self.rt = tr, starts, edges, people, values, gated, node_type_, rel_type_

    def first(self, rids: bool, inner: bool) -> DataFrame:
        df = self.starts.select("st", "so", F.col("st").alias("ct"), F.col("so").alias("co"), F.lit(0).alias("len"))
        if self.values:
            df = df.withColumns({"nodes": F.array().cast(list_type(self.nt)), "rels": F.array().cast(list_type(self.rt))})
        if rids:
            df = df.withColumn("rids", F.array().cast("array<struct<table:bigint,offset:bigint>>"))
        if inner:
            df = df.withColumn("seen", F.array().cast("array<struct<table:bigint,offset:bigint>>"))
        return df

    def step(self, cur: DataFrame, hop: int, rids: bool, inner: bool, cost: bool = False) -> DataFrame:
        """One more hop. From the second on, the place reached so far becomes an intermediate node."""
        if hop > 1 and self.people is not None:
            cur = cur.join(self.people, (F.col("ct") == F.col("nt")) & (F.col("co") == F.col("no")))
            if self.gated:
                cur = cur.filter("gate")
        nxt = cur.join(self.edges, (F.col("ct") == F.col("at")) & (F.col("co") == F.col("a")))
        place = F.struct(F.col("ct").alias("table"), F.col("co").alias("offset"))
        out = {"st": F.col("st"), "so": F.col("so"), "ct": F.col("bt"), "co": F.col("b"), "len": F.col("len") + 1}
        if rids:
            nxt = nxt.filter(~F.array_contains("rids", F.col("rid")))
            out["rids"] = F.array_append("rids", F.col("rid"))
        if inner:
            if hop > 1:
                nxt = nxt.filter(~F.array_contains("seen", place))
                out["seen"] = F.array_append("seen", place)
            else:
                out["seen"] = F.col("seen")
        if self.values:
            out["nodes"] = F.array_append("nodes", F.col("node")) if hop > 1 else F.col("nodes")
            out["rels"] = F.array_append("rels", F.col("rel"))
        if cost:
            out["cost"] = F.col("cost") + F.col("w")
            out["via"] = place
        return nxt.select(*[c.alias(k) for k, c in out.items()])

    def run(self, mode: str, low: int, high: int) -> DataFrame:
        if mode in ("WALK", "TRAIL", "ACYCLIC"):
            return self.walks(mode, low, high)
        if mode in ("SHORTEST", "ALL SHORTEST"):
            return self.shortest(mode.startswith("ALL"), high)
        return self.weighted(mode.startswith("ALL"), high)

    def walks(self, mode: str, low: int, high: int) -> DataFrame:
        rids, inner = mode == "TRAIL", mode == "ACYCLIC"
        eager = high > LAZY_HOPS
        cur = self.first(rids, inner)
        cur = materialize(cur) if eager else cur
        parts = [cur] if low == 0 else []
        for hop in range(1, high + 1):
            cur = self.step(cur, hop, rids, inner)
            if eager:
                cur = materialize(cur)
                if cur.isEmpty():
                    break
            if hop >= low:
                parts.append(cur)
        keep = ["st", "so", "ct", "co", "len", *(["nodes", "rels"] if self.values else [])]
        return reduce(lambda a, b: a.unionByName(b), [p.select(*keep) for p in parts]) if parts else cur.select(*keep).limit(0)

    def shortest(self, every: bool, high: int) -> DataFrame:
        cur = materialize(self.first(False, False))
        seen = cur.select("st", "so", "ct", "co")
        parts = []
        for hop in range(1, high + 1):
            nxt = self.step(cur, hop, False, False)
            nxt = nxt.join(seen, ["st", "so", "ct", "co"], "left_anti")
            if not every:
                key = ["st", "so", "ct", "co"]  # one of the shortest, the same in each run
                nxt = nxt.groupBy(*key).agg(F.min(F.struct(*[c for c in nxt.columns if c not in key])).alias("_one")).select(*key, "_one.*")
            cur = materialize(nxt)
            if cur.isEmpty():
                break
            parts.append(cur)
            seen = seen.unionByName(cur.select("st", "so", "ct", "co").distinct())
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else cur.limit(0)

    def weighted(self, every: bool, high: int) -> DataFrame:
        if self.edges.filter("w < 0").limit(1).count():
            raise RuntimeFault("Found negative weight in weighted shortest path.")
        key = ["st", "so", "ct", "co"]
        first = self.first(False, False).withColumns({"cost": F.lit(0.0), "via": F.struct(F.col("ct").alias("table"), F.col("co").alias("offset"))})
        cur = materialize(first)
        best = cur
        by = W.partitionBy(*key).orderBy("cost", "len", "via")
        for hop in range(1, high + 1):
            nxt = self.step(cur, hop, False, False, cost=True)
            nxt = nxt.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")
            old = best.select(*key, F.col("cost").alias("_c"))
            better = materialize(nxt.join(old, key, "left").filter("_c IS NULL OR cost < _c").drop("_c"))
            if better.isEmpty():
                break
            best = materialize(better.unionByName(best.join(better.select(*key), key, "left_anti")))
            cur = better
        best = best.filter("NOT (st = ct AND so = co)")
        if not every:
            return best.drop("via")
        goal = materialize(best.select(*key, F.col("cost").alias("_c")).unionByName(self.starts.select("st", "so", F.col("st").alias("ct"), F.col("so").alias("co"), F.lit(0.0).alias("_c"))))
        cur, parts = materialize(self.first(False, False).withColumns({"cost": F.lit(0.0), "via": F.struct(F.col("ct").alias("table"), F.col("co").alias("offset"))})), []
        for hop in range(1, high + 1):  # only along hops that keep every prefix cheapest
            cur = materialize(self.step(cur, hop, False, False, cost=True).join(goal, key).filter(F.abs(F.col("cost") - F.col("_c")) <= 1e-9 * F.greatest(F.lit(1.0), F.col("_c"))).drop("_c"))
            if cur.isEmpty():
                break
            parts.append(cur)
        out = reduce(lambda a, b: a.unionByName(b), parts) if parts else cur.limit(0)
        return out.filter("NOT (st = ct AND so = co)").drop("via")


def list_type(t) -> str:
    return f"array<{t.simpleString()}>"


def assemble(tr, frame, var: str, names: list[str]):
    """The named path over nodes, relationships and recursive parts of a pattern."""
    from knotwork.plans.translate import Frame, Route

    parts = [frame.scope[n] for n in names]
    prefix = tr.fresh(var)
    hops = reduce(lambda a, b: a + b, [p.part("len") if p.kind == "route" else F.when(p.off().isNotNull(), 1) for p in parts[1::2]], F.lit(0)) if len(parts) > 1 else F.when(parts[0].off().isNotNull(), 0)
    route = Route(prefix, cost=any(p.kind == "route" and p.cost for p in parts))
    made = {f"{prefix}__len": hops.cast("bigint")}
    if tr.needs(var) - {"-"}:
        nty = node_type([t for p in parts if p.kind == "node" for t in p.tables])
        for p in parts:
            if p.kind == "route" and p.node_ty:
                nty = Ty("NODE", *_union(nty, p.node_ty))
        rty = rel_type([t for p in parts if p.kind == "rel" for t, _ in p.tables])
        for p in parts:
            if p.kind == "route" and p.rel_ty:
                rty = Ty("REL", *_union(rty, p.rel_ty))
        nodes, rels = [], []
        for p in parts:
            if p.kind == "node":
                v = p.value()
                nodes.append(F.array(shaped(v.col, v.ty, nty)))
            elif p.kind == "rel":
                v = p.value()
                rels.append(F.array(shaped(v.col, v.ty, rty)))
            else:
                nodes.append(F.transform(p.part("nodes"), _shaper(p.node_ty, nty)))
                rels.append(F.transform(p.part("rels"), _shaper(p.rel_ty, rty)))
        made[f"{prefix}__nodes"] = F.concat(*nodes)
        made[f"{prefix}__rels"] = F.concat(*rels) if rels else F.array().cast(list_type(spark_type(rty)))
        route.node_ty, route.rel_ty, route.ends = nty, rty, True
    if route.cost:
        made[f"{prefix}__cost"] = next(p.part("cost") for p in parts if p.kind == "route" and p.cost)
    return Frame(frame.df.withColumns(made), {**frame.scope, var: route}, frame.mult)


def _shaper(have: Ty, want: Ty):
    return lambda x: shaped(x, have, want)


def _union(a: Ty, b: Ty) -> tuple[tuple, tuple]:
    fields = dict(zip(a.fields, a.args, strict=True))
    for f, t in zip(b.fields, b.args, strict=True):
        have = next((k for k in fields if k.lower() == f.lower()), None)
        if have is None:
            fields[f] = t
        else:
            fields[have] = common(fields[have], t) or fields[have]
    return tuple(fields.values()), tuple(fields)


__all__ = ["A", "assemble", "extend", "list_of"]
