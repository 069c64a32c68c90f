"""Whole-graph algorithms as loops of joins and aggregations; every round is written to the shared folder.

A vertex is a struct (table, offset). Edges keep their multiplicity. What ends a loop are counts; no list of vertices, edges
or components comes to the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.errors import BinderError, RuntimeFault
from knotwork.operators.storage import materialize, numbered


def topological_levels(v: DataFrame, e: DataFrame) -> DataFrame:
    """(v, level): Kahn's layers; a cycle is an error."""
    left, edges, level, parts = materialize(v), materialize(e), 0, []
    while not left.isEmpty():
        front = materialize(left.join(edges.select(F.col("b").alias("v")).distinct(), "v", "left_anti"))
        if front.isEmpty():
            raise RuntimeFault("The graph has a cycle: topological levels are not defined.")
        parts.append(front.withColumn("level", F.lit(level).cast("bigint")))
        left = materialize(left.join(front, "v", "left_anti"))
        edges = materialize(edges.join(front.select(F.col("v").alias("a")), "a", "left_anti"))
        level += 1
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else v.withColumn("level", F.lit(0).cast("bigint"))


def _compact(found: DataFrame, name: str) -> DataFrame:
    """(v, name): ids from 0 in the order of each group's least member (column root)."""
    least = found.groupBy("root").agg(F.min("v").alias("least"))
    ordered, _ = numbered(least.orderBy("least"), name)
    return found.join(ordered.select("root", name), "root").select("v", F.col(name).cast("bigint").alias(name))


def roots(v: DataFrame, e: DataFrame) -> DataFrame:
    """(v, root): the least vertex of the weak component, by large and small stars."""
    now = materialize(e.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("w").alias("u"), F.col("u").alias("w")))
        low = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.filter("w > u").join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("w")).filter("u <> w").distinct())
        least = large.groupBy("u").agg(F.min("w").alias("m"))
        now = materialize(large.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("w")).unionByName(least.select("u", F.col("m").alias("w"))).filter("u <> w").distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
        if seen == mark:
            return v.join(now.select(F.col("u").alias("v"), F.col("w").alias("root")), "v", "left").withColumn("root", F.coalesce("root", "v"))
        mark = seen


def weakly_connected_components(v: DataFrame, e: DataFrame) -> DataFrame:
    return _compact(roots(v, e), "component_id")


def strongly_connected_components(v: DataFrame, e: DataFrame) -> DataFrame:
    """Trim vertices without a way in or out; colour forward with the greatest vertex; what reaches its colour's root is a component."""
    left, edges, parts = materialize(v), materialize(e.filter("a <> b").distinct()), []
    while not left.isEmpty():
        while True:
            core = materialize(left.join(edges.select(F.col("a").alias("v")).distinct(), "v", "left_semi").join(edges.select(F.col("b").alias("v")).distinct(), "v", "left_semi"))
            alone = materialize(left.join(core, "v", "left_anti"))
            if alone.isEmpty():
                break
            parts.append(alone.select("v", F.col("v").alias("root")))
            left = core
            edges = _inside(edges, left)
        if left.isEmpty():
            break
        colour, n = materialize(left.withColumn("c", F.col("v"))), -1
        while n:
            better = edges.join(colour.select(F.col("v").alias("a"), "c"), "a").groupBy(F.col("b").alias("v")).agg(F.max("c").alias("m"))
            new = materialize(colour.join(better, "v", "left").select("v", F.greatest("c", "m").alias("c"), (F.col("m") > F.col("c")).alias("up")))
            n = new.filter("up").count()
            colour = new.drop("up")
        same = materialize(edges.join(colour.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b").filter("ca = cb").select("a", "b"))
        reached = front = materialize(colour.filter("v = c"))
        while not front.isEmpty():
            nxt = same.join(front.select(F.col("v").alias("b"), "c"), "b").select(F.col("a").alias("v"), "c").distinct().join(reached.select("v"), "v", "left_anti")
            front = materialize(nxt)
            reached = materialize(reached.unionByName(front))
        parts.append(reached.select("v", F.col("c").alias("root")))
        left = materialize(left.join(reached.select("v"), "v", "left_anti"))
        edges = _inside(edges, left)
    out = reduce(lambda a, b: a.unionByName(b), parts) if parts else v.withColumn("root", F.col("v"))
    return _compact(out, "component_id")


def _inside(edges: DataFrame, left: DataFrame) -> DataFrame:
    return materialize(edges.join(left.select(F.col("v").alias("a")), "a", "left_semi").join(left.select(F.col("v").alias("b")), "b", "left_semi").select("a", "b"))


def page_rank(v: DataFrame, e: DataFrame, damping: float = 0.85, tolerance: float = 1e-7, max_iterations: int = 20, normalize_initial: bool = True) -> DataFrame:
    """(v, score). Sums of in-edges are aggregated before they meet their vertex; the total of dangling ones is one number."""
    v = materialize(v)
    n = v.count()
    if not n:
        return v.withColumn("score", F.lit(0.0))
    first = 1.0 / n if normalize_initial else 1.0
    degree = materialize(e.groupBy("a").agg(F.count(F.lit(1)).alias("d")))
    links = materialize(e.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m")).join(degree, "a").select("a", "b", (F.col("m") / F.col("d")).alias("share")))
    dangling = materialize(v.join(degree.select(F.col("a").alias("v")), "v", "left_anti"))
    score = materialize(v.withColumn("score", F.lit(first)))
    for _ in range(max_iterations - 1):
        lost = dangling.join(score, "v").agg(F.sum("score")).first()[0] or 0.0
        into = links.join(score.select(F.col("v").alias("a"), "score"), "a").groupBy(F.col("b").alias("v")).agg(F.sum(F.col("score") * F.col("share")).alias("s"))
        new = materialize(score.join(into, "v", "left").select("v", F.col("score").alias("old"), (damping * (F.coalesce("s", F.lit(0.0)) + lost / n) + (1 - damping) * first).alias("score")))
        moved = new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
        score = new.select("v", "score")
        if moved < tolerance:
            break
    return score


def _numbers(v: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """v and e with one whole number for each vertex where tables and offsets fit into it, and the vertex of a number v."""
    t0, t1, low, high = v.agg(F.min("v.table"), F.max("v.table"), F.min("v.offset"), F.max("v.offset")).first()
    if low is None or (high - low + 1) * (t1 - t0 + 1) >= 2**63:
        return v, e, F.col("v")
    wide = F.lit(t1 - t0 + 1).cast("bigint")
    number = lambda c: F.when(F.col(f"{c}.offset").between(low, high) & F.col(f"{c}.table").between(t0, t1), (F.col(f"{c}.offset") - low) * wide + F.col(f"{c}.table") - t0).alias(c)
    back = F.struct((F.col("v") % wide + t0).alias("table"), (F.floor(F.col("v") / wide) + low).cast("bigint").alias("offset"))
    return v.select(number("v")), e.select(number("a"), number("b")), back


def k_core_decomposition(v: DataFrame, e: DataFrame) -> DataFrame:
    """(v, core): each vertex's bound, at first its degree, falls to the h-index of its neighbours' bounds until none moves.
    Self-loops add 2.

    A vertex falls only if fewer edges than its bound lead to bounds as high. Those edges are counted once and then lessened by
    what falls, so a round reads the edges of the vertices that fall in it and no others."""
    nodes, links, back = _numbers(v, e)
    links = materialize(links)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy(F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("core"))
    now = materialize(nodes.join(degree, "v"))
    ends = links.join(now.select(F.col("v").alias("a"), F.col("core").alias("ca")), "a").join(now.select(F.col("v").alias("b"), F.col("core").alias("cb")), "b")
    held = ends.select(F.inline(F.array(F.struct(F.col("a").alias("v"), (F.col("cb") >= F.col("ca")).alias("up")), F.struct(F.col("b").alias("v"), (F.col("ca") >= F.col("cb")).alias("up")))))
    now = materialize(now.join(held.filter("up").groupBy("v").agg(F.count(F.lit(1)).alias("held")), "v", "left").select("v", "core", F.coalesce("held", F.lit(0)).alias("held")))
    down = W.partitionBy("v").orderBy(F.col("k").desc()).rowsBetween(W.unboundedPreceding, 0)
    while not (weak := materialize(now.filter("held < core").select("v", "core"))).isEmpty():
        ways = materialize(both.join(weak.select(F.col("v").alias("a"), F.col("core").alias("ca")), "a").join(now.select(F.col("v").alias("b"), F.col("core").alias("cb")), "b"))
        counted = ways.groupBy(F.col("a").alias("v"), F.least("ca", "cb").alias("k")).agg(F.count(F.lit(1)).alias("m"))
        counted = counted.select("v", "k", F.sum("m").over(down).alias("m")).withColumn("h", F.max(F.least("k", "m")).over(W.partitionBy("v")))
        h = counted.filter("k >= h").groupBy("v").agg(F.max("h").alias("h"), F.max("m").alias("up"))
        fell = materialize(weak.join(h, "v", "left").select("v", F.coalesce("h", F.lit(0)).alias("h"), F.coalesce("up", F.lit(0)).alias("up")))
        left = ways.join(fell.select(F.col("v").alias("a"), "h"), "a").filter("h < cb").join(fell.select(F.col("v").alias("b"), F.col("h").alias("hb")), "b", "left").withColumn("cb", F.coalesce("hb", "cb"))
        lost = left.filter("h < cb AND cb <= ca").groupBy(F.col("b").alias("v")).agg(F.count(F.lit(1)).alias("lost"))
        now = materialize(now.join(fell, "v", "left").join(lost, "v", "left").select("v", F.coalesce("h", "core").alias("core"), (F.coalesce("up", "held") - F.coalesce("lost", F.lit(0))).alias("held")))
    return v.join(now.select(back.alias("v"), "core"), "v", "left").select("v", F.coalesce("core", F.lit(0)).cast("bigint").alias("core"))


def louvain(v: DataFrame, e: DataFrame, max_iterations: int = 20, max_phases: int = 20) -> DataFrame:
    """(v, community_id): synchronous sweeps that move every vertex to the neighbouring community of greatest gain (ties to the
    lower one; two single vertices move to the lower one only), then communities become vertices, until nothing is gained."""
    both = e.unionByName(e.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = materialize(both.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w")))
    total = links.agg(F.sum("w")).first()[0]
    member = materialize(v.withColumn("root", F.col("v")))
    if not total:
        return _compact(member, "community_id")
    for _ in range(max_phases):
        weight = materialize(links.groupBy(F.col("a").alias("x")).agg(F.sum("w").alias("k")))
        now = materialize(weight.select("x", F.col("x").alias("c"), "k"))
        score = _modularity(links, now, total)
        for _ in range(max_iterations):
            sums = now.groupBy("c").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("size"))
            near = links.filter("a <> b").join(now.select(F.col("x").alias("b"), F.col("c").alias("to")), "b").groupBy(F.col("a").alias("x"), "to").agg(F.sum("w").alias("w"))
            own = now.join(sums, "c").select("x", "c", "k", F.col("tot").alias("own_tot"), F.col("size").alias("own_size"))
            ways = near.join(own, "x").join(sums.select(F.col("c").alias("to"), "tot", "size"), "to")
            base = ways.filter("to = c").select("x", F.col("w").alias("own_w"))
            ways = ways.filter("to <> c").join(base, "x", "left")
            gain = (F.col("w") - F.coalesce("own_w", F.lit(0.0))) - F.col("k") * (F.col("tot") - (F.col("own_tot") - F.col("k"))) / total
            ways = ways.withColumn("gain", gain).filter("gain > 1e-12").filter("NOT (own_size = 1 AND size = 1 AND to > c)")
            best = ways.groupBy("x").agg(F.max(F.struct("gain")).alias("g"))
            best = ways.join(best, "x").filter("gain >= g.gain").groupBy("x").agg(F.min("to").alias("to"))
            new = materialize(now.join(best, "x", "left").select("x", F.coalesce("to", "c").alias("c"), "k"))
            better = _modularity(links, new, total)
            if better - score <= 1e-6:
                break
            now, score = new, better
        moved = now.filter("x <> c").limit(1).count()
        member = materialize(member.join(now.select(F.col("x").alias("root"), "c"), "root", "left").select("v", F.coalesce("c", "root").alias("root")))
        if not moved:
            break
        links = materialize(links.join(now.select(F.col("x").alias("a"), F.col("c").alias("ca")), "a").join(now.select(F.col("x").alias("b"), F.col("c").alias("cb")), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
    return _compact(member, "community_id")


def _modularity(links: DataFrame, now: DataFrame, total: float) -> float:
    inside = links.join(now.select(F.col("x").alias("a"), F.col("c").alias("ca")), "a").join(now.select(F.col("x").alias("b"), F.col("c").alias("cb")), "b").filter("ca = cb").agg(F.sum("w")).first()[0] or 0.0
    squares = now.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0.0
    return inside / total - squares / total**2


ALGORITHMS = {
    "topological_levels": (topological_levels, "level", {}),
    "weakly_connected_components": (weakly_connected_components, "component_id", {}),
    "strongly_connected_components": (strongly_connected_components, "component_id", {}),
    "page_rank": (page_rank, "score", {"damping": float, "tolerance": float, "max_iterations": int, "normalize_initial": bool}),
    "k_core_decomposition": (k_core_decomposition, "core", {}),
    "louvain": (louvain, "community_id", {"max_iterations": int, "max_phases": int}),
}


def source(tr, c):
    """The rows of CALL algorithm(nodes, rels, ...), and what its outputs are bound to."""
    from knotwork.plans.translate import Node, Value, merged
    from knotwork.types import engine_type

    f, output, options = ALGORITHMS[c.name.lower()]
    if len(c.args) < 2:
        raise BinderError(f"{c.name} needs a list of node tables and a list of relationship tables.")
    lists = []
    for a in c.args[:2]:
        x = tr.expr(a, {})
        if not x.is_const or not isinstance(x.const, list) or not all(isinstance(n, str) for n in x.const):
            raise BinderError(f"{c.name} needs constant lists of table names.")
        if len({n.lower() for n in x.const}) < len(x.const):
            raise BinderError("A table is listed twice.")
        lists.append(x.const)
    from knotwork.errors import CatalogError

    try:
        nodes, rels = [tr.catalog.node(n) for n in lists[0]], [tr.catalog.rel(n) for n in lists[1]]
    except CatalogError as error:
        raise BinderError(str(error).split(": ", 1)[-1]) from None
    given = dict(zip(options, c.args[2:], strict=False))
    if len(c.args) - 2 > len(options) or any(k.lower() not in options for k in c.named):
        raise BinderError(f"{c.name} has no such option.")
    given |= {k.lower(): v for k, v in c.named.items()}
    settings = {}
    for k, v in given.items():
        x = tr.expr(v, {})
        wanted = options[k]
        fits = x.is_const and (isinstance(x.const, bool) if wanted is bool else isinstance(x.const, (int, float)) and not isinstance(x.const, bool) and (wanted is float or isinstance(x.const, int)))
        if not fits or (wanted is not bool and x.const < 0) or (k == "damping" and x.const >= 1):
            raise BinderError(f"Option {k} has no valid value.")
        settings[k] = wanted(x.const)
    point = lambda t, col: F.struct(F.lit(t.id).cast("bigint").alias("table"), F.col(col).alias("offset"))
    spark = tr.spark
    kind = "struct<table:bigint,offset:bigint>"
    v = reduce(lambda a, b: a.unionByName(b), [t.df.select(point(t, "_off").alias("v")) for t in nodes], spark.range(0).select(F.lit(None).cast(kind).alias("v")))
    e = spark.range(0).select(F.lit(None).cast(kind).alias("a"), F.lit(None).cast(kind).alias("b"))
    names = {t.name: t for t in nodes}
    for r in rels:
        for (a, b), df in r.pairs.items():
            if a not in names or b not in names:
                raise BinderError(f"Relationship table {r.name} has an endpoint that isn't among the node tables.")
            e = e.unionByName(df.select(point(names[a], "_src").alias("a"), point(names[b], "_dst").alias("b")))
    out = f(v, e, **settings)
    prefix, value = tr.fresh("node"), tr.fresh(output)
    df = materialize(out.select(F.col("v.offset").alias(f"{prefix}__off"), F.col("v.table").alias(f"{prefix}__tab"), F.col(output).alias(value)))
    node = Node(prefix, nodes, merged(nodes, "node") if nodes else {}, True)
    return df, {"node": node, output: Value(value, engine_type(df.schema[value].dataType))}
