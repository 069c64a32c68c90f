"""CREATE, MERGE, SET and DELETE: each makes new versions of the tables' DataFrames from the frame's rows.

A frame is written to the shared folder before it changes anything, so what is read later in the statement is what was
matched. New rows are written too; a table is the union of what it was and what is new."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.catalog import NodeTable, RelTable
from knotwork.errors import BinderError, RuntimeFault
from knotwork.functions import expr as X
from knotwork.functions.expr import E, cast, lit
from knotwork.operators.storage import materialize
from knotwork.operators.storage import numbered as number_rows
from knotwork.plans import ast as A
from knotwork.types import Ty, spark_type


def numbered(tr, df: DataFrame) -> tuple[DataFrame, str, int]:
    place = tr.fresh("row")
    made, n = number_rows(df, place)
    return made, place, n


def changeable(t) -> None:
    if t.external:
        raise RuntimeFault(f"Table {t.name} is external and can only be read.")


def write_clause(tr, frame, c):
    if isinstance(c, A.Create):
        return create(tr, frame, c.paths)
    if isinstance(c, A.Merge):
        return merge(tr, frame, c)
    if isinstance(c, A.SetItems):
        return set_items(tr, frame, c.items)
    return delete(tr, frame, c)


def _frame(tr, df, scope):
    from knotwork.plans.translate import Frame

    return Frame(df, scope)


def key_place(t: NodeTable, key: E):
    return key.col.cast("bigint") if t.columns[t.key].integer else F.xxhash64(key.col)


def defaults(tr, t, given: dict[str, E], scope: dict) -> dict[str, E]:
    """A value for each column: the given one, its default, a SERIAL number, or NULL."""
    out = {}
    for c, ty in t.columns.items():
        own = next((e for k, e in given.items() if k.lower() == c.lower()), None)
        if own is None and ty.name == "SERIAL":
            own = tr.f_nextval([("lit", f"{t.name}_{c}_serial")], {}, {"row": 1} | scope)
        elif own is None and t.defaults.get(c) is not None:
            own = tr.expr(t.defaults[c], {"row": None, **scope} if scope else scope)
        out[c] = cast(own if own is not None else lit(None), ty)
    return out


def check_keys(t: NodeTable, new: DataFrame) -> None:
    """Keys of new rows (columns _off and the key) must be there, and new."""
    if new.filter(F.col(f"`{t.key}`").isNull()).limit(1).count():
        raise RuntimeFault("Found NULL, which violates the non-null constraint of the primary key column.")
    twice = new.groupBy(f"`{t.key}`").count().filter("count > 1").select(F.col(f"`{t.key}`").cast("string").alias("k")).unionByName(new.join(t.df.select("_off"), "_off", "left_semi").select(F.col(f"`{t.key}`").cast("string").alias("k"))).first()
    if twice:
        raise RuntimeFault(f"Found duplicated primary key value {twice['k']}, which violates the uniqueness constraint of the primary key column.")


def check_many(t: RelTable, df: DataFrame) -> None:
    left, right = t.many.split("_")
    for limit, col, what in ((right, "_src", "outgoing"), (left, "_dst", "incoming")):
        if limit == "ONE" and df.groupBy(col).count().filter("count > 1").limit(1).count():
            raise RuntimeFault(f"Node has more than one {what} relationship in table {t.name}, which violates the rel multiplicity constraint.")


def add_nodes(t: NodeTable, new: DataFrame) -> None:
    changeable(t)
    new = materialize(new.select("_off", *[F.col(f"`{c}`") for c in t.columns]))
    check_keys(t, new)
    t.df = t.df.unionByName(new)


def add_rels(t: RelTable, pair: tuple[str, str], new: DataFrame, n: int) -> None:
    changeable(t)
    new = materialize(new.select("_src", "_dst", "_off", *[F.col(f"`{c}`") for c in t.columns]))
    t.pairs[pair] = t.pairs[pair].unionByName(new)
    t.next_off += n
    if t.many != "MANY_MANY":
        check_many(t, t.pairs[pair])


def as_data(t, labels: list[str], props: list) -> list:
    """Properties of a node or relationship of a schemaless graph, as those of its hidden table."""
    if t.name not in ("_nodes", "_edges") or labels[0] == t.name:
        return props
    label = ("list", [("lit", x) for x in labels]) if t.name == "_nodes" else ("lit", labels[0])
    return [("label", label), ("data", ("cast", ("struct", props), "JSON") if props else ("lit", "{}"))]


def create(tr, frame, paths):
    from knotwork.plans.translate import Node, Rel

    df, place, n = numbered(tr, tr.start(frame))
    scope = dict(frame.scope)

    def evaluate(t, props: list) -> dict[str, E]:
        for k, _ in props:
            if t.column(k) is None:
                raise BinderError(f"Cannot find property {k} for {t.name}.")
        tr.frame = _frame(tr, df, scope or {"row": None})
        return defaults(tr, t, {k: tr.expr(v, scope) for k, v in props}, scope)

    for path in paths:
        names = []
        for k in range(0, len(path.parts), 2):
            p = path.parts[k]
            v = p.var or f"_n{tr.fresh()}"
            names.append(v)
            if v in scope:
                if scope[v].kind != "node":
                    raise BinderError(f"{v} is not a node.")
                continue
            if len(p.labels) != 1 and "_nodes" not in tr.catalog.nodes:
                raise BinderError(f"Create node {v} expects a single node label.")
            tables = tr.node_tables(p.labels)
            t = tables[0]
            values = evaluate(t, as_data(t, p.labels, p.props))
            df = tr.frame.df
            node = Node(tr.fresh(v), [t], t.columns, False, True)
            node.loads = {c: f"{node.prefix}__p_{c}" for c in t.columns}
            df = df.withColumns({node.loads[c]: e.col for c, e in values.items()})
            df = df.withColumn(f"{node.prefix}__off", key_place(t, E(F.col(node.loads[t.key]), t.columns[t.key])))
            df = materialize(df)
            add_nodes(t, df.select(F.col(f"{node.prefix}__off").alias("_off"), *[F.col(node.loads[c]).alias(c) for c in t.columns]))
            scope[v] = node
        for k in range(1, len(path.parts), 2):
            p = path.parts[k]
            a, b = names[k // 2], names[k // 2 + 1]
            if p.direction == "in":
                a, b = b, a
            if len(p.types) != 1 or p.direction == "both":
                raise BinderError("Create relationship expects a single label and a direction.")
            t = tr.catalog.rels["_edges"] if "_edges" in tr.catalog.rels else tr.catalog.rel(p.types[0])
            x, y = scope[a], scope[b]
            pairs = [q for q in t.pairs if any(s.name == q[0] for s in x.tables) and any(s.name == q[1] for s in y.tables)]
            if not pairs:
                raise BinderError(f"Relationship {t.name} has no pair from {a} to {b}.")
            values = evaluate(t, as_data(t, p.types, p.props))
            df = tr.frame.df
            v = p.var or f"_r{tr.fresh()}"
            rel = Rel(tr.fresh(v), [(t, q) for q in pairs], t.columns)
            rel.loads = {c: f"{rel.prefix}__p_{c}" for c in t.columns}
            pick = lambda f, q=pairs, s=x, u=y: reduce(lambda c, pr: c.when((s.tab() == tr.catalog.node(pr[0]).id) & (u.tab() == tr.catalog.node(pr[1]).id), F.lit(f(pr))), q, F.when(F.lit(False), F.lit(0)))
            df = df.withColumns({**{rel.loads[c]: e.col for c, e in values.items()}, f"{rel.prefix}__off": F.lit(t.next_off) + F.col(place), f"{rel.prefix}__tab": pick(lambda pr: t.ids[pr]), f"{rel.prefix}__src": x.off(), f"{rel.prefix}__dst": y.off(), f"{rel.prefix}__stab": pick(lambda pr: tr.catalog.node(pr[0]).id), f"{rel.prefix}__dtab": pick(lambda pr: tr.catalog.node(pr[1]).id)})
            df = materialize(df)
            for q in pairs:
                new = df.filter((F.col(f"{rel.prefix}__tab") == t.ids[q]) & x.off().isNotNull() & y.off().isNotNull())
                add_rels(t, q, new.select(x.off().alias("_src"), y.off().alias("_dst"), F.col(f"{rel.prefix}__off").alias("_off"), *[F.col(rel.loads[c]).alias(c) for c in t.columns]), n if q == pairs[-1] else 0)
            rel.src, rel.dst = x, y
            scope[v] = rel
    return _frame(tr, df.drop(place), {v: b for v, b in scope.items() if not v.startswith(("_n", "_r"))})


def merge(tr, frame, c):
    from knotwork.plans.translate import Frame

    base, place, _ = numbered(tr, tr.start(frame))
    scope = {**frame.scope}
    from knotwork.plans.translate import Value
    from knotwork.types import INT64

    scope["_place"] = Value(place, INT64)
    got = tr.pattern(Frame(base, scope), A.Match(False, c.paths, None), False)
    matched = materialize(got.df)
    missing = base.join(matched.select(place).distinct(), place, "left_anti")
    # rows that would create the same thing create it once
    tr.frame = Frame(missing, frame.scope)
    keys = {}
    for path in c.paths:
        for p in path.parts:
            for k, v in p.props:
                keys[tr.fresh(k)] = tr.expr(v, frame.scope)
            if p.var in frame.scope and frame.scope[p.var].kind == "node":
                for col in frame.scope[p.var].key_columns():
                    keys[tr.fresh("id")] = E(col, Ty("INT64"))
    missing = materialize(missing.withColumns({k: e.col for k, e in keys.items()}) if keys else missing)
    once = missing.dropDuplicates(list(keys)) if keys else missing.limit(1)
    out = Frame(matched.drop(place), {v: b for v, b in got.scope.items() if v != "_place"})
    if c.on_match and not matched.isEmpty():
        out = set_items(tr, out, c.on_match)
    if missing.isEmpty():
        return out
    made = create(tr, Frame(once, frame.scope), c.paths)
    if c.on_create:
        made = set_items(tr, made, c.on_create)
    # the other rows see what the first of them made
    if keys:
        own = [x for v, b in made.scope.items() if v not in frame.scope for x in b.own()]
        right = made.df.select(*[F.col(k).alias(f"{k}_") for k in keys], *own)
        cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
        rows = missing.join(right, cond).drop(*[f"{k}_" for k in keys])
    else:
        rows = made.df
    both = _aligned(tr, out, Frame(rows, made.scope))
    return both


def _aligned(tr, a, b):
    """The rows of two frames with the same variables, as one."""
    from knotwork.plans.translate import Frame, Node, Rel

    scope, left, right = {}, [], []
    for v, x in a.scope.items():
        y = b.scope.get(v)
        if y is None:
            continue
        if x.kind == "value":
            scope[v] = x
            left.append(F.col(x.column))
            right.append(F.col(y.column).alias(x.column))
            continue
        names = list(dict.fromkeys([*x.loads, *y.loads]))
        prefix = tr.fresh(v)
        parts = ("off", "tab") if x.kind == "node" else ("off", "tab", "src", "dst", "stab", "dtab")
        if x.kind == "node":
            made = Node(prefix, list({t.name: t for t in [*x.tables, *y.tables]}.values()), x.columns | y.columns, True, True)
        else:
            made = Rel(prefix, list({(t.name, p): (t, p) for t, p in [*x.tables, *y.tables]}.values()), x.columns | y.columns)
        made.loads = {c: f"{prefix}__p_{c}" for c in names}
        scope[v] = made
        for s, cols in ((x, left), (y, right)):
            for p in parts:
                cols.append((s.tab() if p == "tab" else F.col(f"{s.prefix}__{p}")).alias(f"{prefix}__{p}"))
            for c in names:
                cols.append((F.col(s.loads[c]) if c in s.loads else F.lit(None).cast(spark_type(made.columns[c]))).alias(made.loads[c]))
    for v, x in scope.items():
        if x.kind == "rel":
            src, dst = a.scope[v].src, a.scope[v].dst
            x.src = next((scope[k] for k, b_ in a.scope.items() if b_ is src and k in scope), None)
            x.dst = next((scope[k] for k, b_ in a.scope.items() if b_ is dst and k in scope), None)
    return Frame(materialize(a.df.select(*left).unionByName(b.df.select(*right))), scope)


def set_items(tr, frame, items):
    df = materialize(tr.start(frame))
    for item in items:
        var = item[1]
        b = frame.scope.get(var)
        if b is None or b.kind not in ("node", "rel"):
            raise BinderError(f"Cannot set expression {var}: it is not a node or a relationship.")
        tr.frame = _frame(tr, df, frame.scope)
        if item[0] == "prop":
            given = {item[2]: tr.expr(item[3], frame.scope)}
        else:
            if item[2][0] != "struct":
                raise BinderError("SET of a map needs a literal of properties.")
            given = {k: tr.expr(v, frame.scope) for k, v in item[2][1]}
            if not item[3]:
                tables = b.tables if b.kind == "node" else [t for t, _ in b.tables]
                keys = {t.key.lower() for t in b.tables} if b.kind == "node" else set()
                for t in tables:
                    for c in t.columns:
                        if c.lower() not in {k.lower() for k in given} | keys:
                            given[c] = lit(None)
            if b.kind == "node":
                given = {k: e for k, e in given.items() if k.lower() not in {t.key.lower() for t in b.tables}}
        values = {}
        for k, e in given.items():
            c = next((x for x in b.columns if x.lower() == k.lower()), None)
            if c is None:
                raise BinderError(f"Cannot find property {k} for {var}.")
            e2 = e if e.ty == b.columns[c] else (E(e.col.try_cast(spark_type(b.columns[c])), b.columns[c]) if e.ty.name == "STRING" and b.columns[c].name not in ("STRING",) and not b.columns[c].listy else cast(e, b.columns[c]))
            values[c] = (tr.fresh(c), e2)
        df = materialize(tr.frame.df.withColumns({n: e.col for n, e in values.values()}))
        new = df.filter(b.off().isNotNull()).select(b.off().alias("_o"), b.tab().alias("_t"), *[F.col(n) for n, _ in values.values()])
        # several rows may set one property: the greatest values stay, together, so that reruns agree
        new = new.groupBy("_o", "_t").agg(F.max(F.struct(*[n for n, _ in values.values()])).alias("_v")).select("_o", "_t", "_v.*")
        new = materialize(new)
        targets = [(t, None) for t in b.tables] if b.kind == "node" else b.tables
        for t, pair in targets:
            changeable(t)
            tid = t.id if pair is None else t.ids[pair]
            mine = new.filter(F.col("_t") == tid)
            if b.kind == "node" and any(c.lower() == t.key.lower() for c in values):
                _move_key(tr, t, mine, values, b)
                continue
            old = t.df if pair is None else t.pairs[pair]
            here = {t.column(c): (n, e) for c, (n, e) in values.items() if t.column(c)}
            joined = old.join(mine, F.col("_off") == F.col("_o"), "left")
            cols = [F.when(F.col("_o").isNotNull(), F.col(here[c][0]).cast(spark_type(t.columns[c]))).otherwise(F.col(f"`{c}`")).alias(c) if c in here else F.col(f"`{c}`") for c in t.columns]
            made = materialize(joined.select(*[c for c in ("_src", "_dst", "_off") if c in old.columns], *cols))
            if pair is None:
                t.df = made
            else:
                t.pairs[pair] = made
        df = df.withColumns({b.loads[c]: F.col(n) for c, (n, _) in values.items() if c in b.loads})
    return _frame(tr, df, frame.scope)


def _move_key(tr, t: NodeTable, mine: DataFrame, values: dict, b) -> None:
    """A new key moves the node to another place: its relationships move with it."""
    here = {t.column(c): n for c, (n, _) in values.items() if t.column(c)}
    joined = t.df.join(mine, F.col("_off") == F.col("_o"), "left")
    cols = {c: (F.when(F.col("_o").isNotNull(), F.col(here[c]).cast(spark_type(t.columns[c]))).otherwise(F.col(f"`{c}`")) if c in here else F.col(f"`{c}`")) for c in t.columns}
    made = materialize(joined.select(F.col("_off").alias("_was"), *[x.alias(c) for c, x in cols.items()]))
    made = materialize(made.withColumn("_off", key_place(t, E(F.col(f"`{t.key}`"), t.columns[t.key]))))
    if made.groupBy("_off").count().filter("count > 1").limit(1).count():
        raise RuntimeFault("Found duplicated primary key value, which violates the uniqueness constraint of the primary key column.")
    moved = materialize(made.filter("_was <> _off").select("_was", F.col("_off").alias("_new")))
    t.df = made.select("_off", *[F.col(f"`{c}`") for c in t.columns])
    for r in tr.catalog.rels.values():
        for pair, df in r.pairs.items():
            for side, col in zip(pair, ("_src", "_dst"), strict=True):
                if side == t.name:
                    df = df.join(moved, F.col(col) == F.col("_was"), "left").withColumn(col, F.coalesce("_new", col)).drop("_was", "_new")
            r.pairs[pair] = materialize(df)


def delete(tr, frame, c):
    df = materialize(tr.start(frame))
    bound = []
    for v in c.vars:
        if v[0] != "var" or v[1] not in frame.scope or frame.scope[v[1]].kind not in ("node", "rel"):
            raise BinderError("Cannot delete an expression that is not a node or a relationship.")
        bound.append(frame.scope[v[1]])
    for b in [x for x in bound if x.kind == "rel"]:
        gone = df.filter(b.off().isNotNull()).select(b.off().alias("_off"), b.tab().alias("_t")).distinct()
        for t, pair in b.tables:
            changeable(t)
            t.pairs[pair] = materialize(t.pairs[pair].join(gone.filter(F.col("_t") == t.ids[pair]).select("_off"), "_off", "left_anti").select(t.pairs[pair].columns))
    for b in [x for x in bound if x.kind == "node"]:
        gone = materialize(df.filter(b.off().isNotNull()).select(b.off().alias("_off"), b.tab().alias("_t")).distinct())
        for t in b.tables:
            changeable(t)
            mine = gone.filter(F.col("_t") == t.id).select("_off")
            for r in tr.catalog.rels.values():
                for pair, rows in r.pairs.items():
                    for side, col in zip(pair, ("_src", "_dst"), strict=True):
                        if side != t.name:
                            continue
                        if c.detach:
                            rows = rows.join(mine.select(F.col("_off").alias(col)), col, "left_anti").select(rows.columns)
                        elif rows.join(mine.select(F.col("_off").alias(col)), col, "left_semi").limit(1).count():
                            raise RuntimeFault(f"Node has connected edges in table {r.name}, which cannot be deleted. Please delete the edges first or try DETACH DELETE.")
                    if c.detach:
                        r.pairs[pair] = materialize(rows)
            t.df = materialize(t.df.join(mine, "_off", "left_anti").select(t.df.columns))
    return _frame(tr, df, frame.scope)


__all__ = ["X", "add_nodes", "add_rels", "numbered", "write_clause"]
