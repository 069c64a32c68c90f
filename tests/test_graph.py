"""Patterns, paths, writes and algorithms on random graphs, against brute force in Python."""

import collections
import itertools
import random

import pytest

from knotwork.errors import BinderError, RuntimeFault
from knotwork.session import Session

FLAGS = ["gr", "no", "pa"]


class World:
    """Harbours, ships, routes between harbours (some twice, some in a ring) and calls of ships at harbours."""

    def __init__(self, spark, seed: int):
        r = random.Random(seed)
        self.harbours = {f"h{i:02d}": (r.randrange(5, 30), r.choice(FLAGS)) for i in range(9)}
        self.ships = {100 + i: r.randrange(1, 90) for i in range(5)}
        codes = sorted(self.harbours)
        self.routes = [(*r.sample(codes, 2), r.randrange(1, 9)) for _ in range(13)] + [(codes[0], codes[0], 3)]
        self.routes.append(self.routes[0])
        self.calls = [(r.choice(sorted(self.ships)), r.choice(codes)) for _ in range(8)]
        s = self.session = Session(spark)
        s.catalog.add_nodes("Harbour", spark.createDataFrame([(k, *v) for k, v in self.harbours.items()], "code string, depth long, flag string"), "code")
        s.catalog.add_nodes("Ship", spark.createDataFrame(list(self.ships.items()), "num long, tons long"), "num")
        s.catalog.add_rels("ROUTE", {("Harbour", "Harbour"): (spark.createDataFrame(self.routes, "a string, b string, days long"), "a", "b")})
        s.catalog.add_rels("CALLS", {("Ship", "Harbour"): (spark.createDataFrame(self.calls, "a long, b string"), "a", "b")})

    def rows(self, q, **p):
        return sorted((tuple(r) for r in self.session.execute(q, **p).collect()), key=str)

    def walks(self, most, keep=lambda walk, edge: True):
        """Walks of 1 to most routes, as lists of places in self.routes; keep(walk, edge): whether a walk may go on along an edge."""
        now = [[e] for e in range(len(self.routes)) if keep([], e)]
        for _ in range(most):
            yield from now
            now = [[*w, e] for w in now for e in range(len(self.routes)) if self.routes[e][0] == self.routes[w[-1]][1] and keep(w, e)]


@pytest.fixture(scope="module", params=[11, 12])
def w(request, spark):
    return World(spark, request.param)


def count(items):
    return sorted(collections.Counter(items).items(), key=str)


def flat(pairs):
    return sorted(((*k, n) if isinstance(k, tuple) else (k, n) for k, n in pairs), key=str)


def test_hops(w):
    assert w.rows("MATCH (x:Harbour)-[e:ROUTE]->(y:Harbour) RETURN x.code, e.days, y.depth") == sorted(((a, d, w.harbours[b][0]) for a, b, d in w.routes), key=str)
    both = [(a, b) for a, b, _ in w.routes] + [(b, a) for a, b, _ in w.routes]
    assert w.rows("MATCH (x:Harbour)-[:ROUTE]-(y:Harbour) RETURN x.code, count(*)") == flat(count(a for a, _ in both))
    assert w.rows("MATCH (x:Harbour)-[e:ROUTE]->(y:Harbour) RETURN x.flag, y.flag, count(*), count(DISTINCT e)") == sorted(((*k, n, n) for k, n in count((w.harbours[a][1], w.harbours[b][1]) for a, b, _ in w.routes)), key=str)
    assert w.rows("MATCH (x:Harbour)-[:ROUTE]->(x) RETURN x.code") == sorted((a,) for a, b, _ in w.routes if a == b)
    rings = [(a, b, d) for a, b, _ in w.routes for c, d, _ in w.routes if c == b for e, f, _ in w.routes if e == d and f == a]
    assert w.rows("MATCH (x:Harbour)-[:ROUTE]->(y:Harbour)-[:ROUTE]->(z:Harbour)-[:ROUTE]->(x) RETURN x.code, y.code, z.code") == sorted(rings)


def test_optional_and_subqueries(w):
    out = lambda k: [(b, d) for a, b, d in w.routes if a == k]
    deep = lambda k: [b for b, _ in out(k) if w.harbours[b][0] > 15]
    assert w.rows("MATCH (x:Harbour) OPTIONAL MATCH (x)-[:ROUTE]->(y:Harbour) WHERE y.depth > 15 RETURN x.code, y.code") == sorted(((k, b) for k in w.harbours for b in deep(k) or [None]), key=str)
    assert w.rows("MATCH (x:Harbour) WHERE NOT EXISTS { MATCH (x)-[:ROUTE]->(y:Harbour) WHERE y.depth > 15 } RETURN x.code") == sorted((k,) for k in w.harbours if not deep(k))
    assert w.rows("MATCH (x:Harbour) RETURN x.code, COUNT { MATCH (x)-[:ROUTE]->(:Harbour) }, EXISTS { MATCH (:Ship)-[:CALLS]->(x) }") == sorted(((k, len(out(k)), any(h == k for _, h in w.calls)) for k in w.harbours), key=str)
    lower = lambda d: sum(v[0] < d for v in w.harbours.values())
    assert w.rows("MATCH (x:Harbour) RETURN x.code, COUNT { MATCH (y:Harbour) WHERE y.depth < x.depth }") == sorted(((k, lower(v[0])) for k, v in w.harbours.items()), key=str)


def test_labels(w):
    assert w.rows("MATCH (n) RETURN label(n), count(*)") == [("Harbour", len(w.harbours)), ("Ship", len(w.ships))]
    assert w.rows("MATCH (a)-[e]->(b) RETURN label(a), label(e), label(b), count(*)") == [("Harbour", "ROUTE", "Harbour", len(w.routes)), ("Ship", "CALLS", "Harbour", len(w.calls))]
    assert w.rows("MATCH (n:Harbour:Ship) WHERE coalesce(n.depth, n.tons) > 20 RETURN coalesce(n.code, to_string(n.num))") == sorted([(k,) for k, v in w.harbours.items() if v[0] > 20] + [(str(k),) for k, v in w.ships.items() if v > 20])


def test_walks_trails_and_acyclic_paths(w):
    ends = lambda p: (w.routes[p[0]][0], w.routes[p[-1]][1], len(p))
    ask = "MATCH (x:Harbour)-[e:ROUTE* {} 1..3]->(y:Harbour) RETURN x.code, y.code, length(e), count(*)"
    assert w.rows(ask.format("")) == flat(count(map(ends, w.walks(3))))
    assert w.rows(ask.format("TRAIL")) == flat(count(map(ends, w.walks(3, lambda p, e: e not in p))))
    w.session.execute("CALL recursive_pattern_semantic = 'trail'")
    assert w.rows(ask.format("")) == w.rows(ask.format("TRAIL")) != w.rows(ask.format("WALK"))
    w.session.execute("CALL recursive_pattern_semantic = 'walk'")
    # the inner places differ; a path may end where it has been
    assert w.rows(ask.format("ACYCLIC")) == flat(count(map(ends, w.walks(3, lambda p, e: w.routes[e][0] not in [w.routes[x][0] for x in p[1:]]))))
    quick = w.walks(3, lambda p, e: w.routes[e][2] < 6 and (not p or w.harbours[w.routes[e][0]][0] > 8))
    assert w.rows("MATCH (x:Harbour)-[e:ROUTE*1..3 (r, n | WHERE r.days < 6 AND n.depth > 8)]->(y:Harbour) RETURN x.code, y.code, length(e), count(*)") == flat(count(map(ends, quick)))


def test_shortest_and_cheapest_paths(w):
    ends = lambda p: (w.routes[p[0]][0], w.routes[p[-1]][1])
    walks = [p for p in w.walks(4) if ends(p)[0] != ends(p)[1]]
    hops, cost = {}, {}
    for p in walks:
        c = sum(w.routes[x][2] for x in p)
        hops[ends(p)] = min(len(p), hops.get(ends(p), 99))
        cost[ends(p)] = min(c, cost.get(ends(p), 10**6))
    assert w.rows("MATCH (x:Harbour)-[e:ROUTE* SHORTEST 1..4]->(y:Harbour) WHERE x.code <> y.code RETURN x.code, y.code, length(e)") == sorted(((*k, n) for k, n in hops.items()), key=str)
    every = count(ends(p) for p in walks if len(p) == hops[ends(p)])
    assert w.rows("MATCH (x:Harbour)-[e:ROUTE* ALL SHORTEST 1..4]->(y:Harbour) WHERE x.code <> y.code RETURN x.code, y.code, count(*)") == flat(every)
    assert w.rows("MATCH (x:Harbour)-[e:ROUTE* WSHORTEST(days) 1..4]->(y:Harbour) RETURN x.code, y.code, cost(e)") == sorted(((*k, float(n)) for k, n in cost.items()), key=str)
    again = w.rows("MATCH p = (x:Harbour)-[e:ROUTE* SHORTEST 1..4]->(y:Harbour) RETURN x.code, y.code, properties(nodes(p), 'code')")
    assert again == w.rows("MATCH p = (x:Harbour)-[e:ROUTE* SHORTEST 1..4]->(y:Harbour) RETURN x.code, y.code, properties(nodes(p), 'code')")


def test_values_of_nodes_and_paths(w):
    first = w.routes[3]
    x, e, y = w.session.execute("MATCH (x:Harbour)-[e:ROUTE]->(y:Harbour) WHERE x.code = $a AND y.code = $b AND e.days = $d RETURN x, e, y LIMIT 1", a=first[0], b=first[1], d=first[2]).first()
    assert (x["_label"], x["depth"], e["days"], e["_src"], e["_dst"]) == ("Harbour", w.harbours[first[0]][0], first[2], x["_id"], y["_id"])
    got = w.rows("MATCH p = (x:Harbour)-[:ROUTE*2..2]->(y:Harbour) RETURN properties(nodes(p), 'code'), properties(rels(p), 'days'), is_trail(p), is_acyclic(p)")
    want = []
    for a, b in (p for p in w.walks(2) if len(p) == 2):
        places = [w.routes[a][0], w.routes[a][1], w.routes[b][1]]
        want.append((places, [w.routes[a][2], w.routes[b][2]], a != b, len(set(places)) == 3))
    assert got == sorted(want, key=str)
    assert w.rows("MATCH (h:Harbour) WITH collect(h) AS l UNWIND l AS h MATCH (h)<-[:CALLS]-(s:Ship) RETURN h.code, s.num") == sorted(((h, s) for s, h in w.calls), key=str)


def test_statements_that_cannot_be_bound(w):
    for q in ("MATCH (x:Ghost) RETURN x", "MATCH (x:Harbour) RETURN x.ghost", "MATCH (x)-[e:ROUTE]->(y)-[e:ROUTE]->(z) RETURN x", "MATCH (x:Harbour)-[e:ROUTE* SHORTEST 2..3]->(y) RETURN x", "MATCH (x:Harbour)-[e:ROUTE*3..1]->(y) RETURN x", "MATCH (x:Harbour) RETURN cost(x)"):
        with pytest.raises(BinderError):
            w.session.execute(q)


def test_folded_counts_equal_joins(w):
    """Counts over branches that nothing reads give what the same pattern gives when everything is read."""
    for pattern, read in (("(x:Harbour)-[:ROUTE]->(y:Harbour)-[:ROUTE]->(z:Harbour)", "y.flag AS p, z.flag AS q"), ("(x:Harbour)<-[:ROUTE]-(y:Harbour), (x)-[:ROUTE]->(z:Harbour)", "y.flag AS p, z.flag AS q"), ("(x:Harbour)-[:ROUTE]-(y:Harbour)-[:ROUTE]-(z:Harbour)", "y.flag AS p, z.flag AS q"), ("(y:Harbour)-[:ROUTE]->(x:Harbour)<-[:CALLS]-(z:Ship)", "y.flag AS p, z.tons AS q")):
        assert w.rows(f"MATCH {pattern} RETURN count(*)") == w.rows(f"MATCH {pattern} WITH x.code AS i, {read} RETURN count(*)")
        for lone in ("NOT EXISTS { MATCH (y)-[:ROUTE]->(h:Harbour) WHERE h.depth < 12 }", "COUNT { MATCH (y)<-[:CALLS]-(:Ship) } > 0"):  # reads a branch's end
            assert w.rows(f"MATCH {pattern} WHERE {lone} RETURN count(*)") == w.rows(f"MATCH {pattern} WHERE {lone} WITH x.code AS i, {read} RETURN count(*)")
        assert w.rows(f"MATCH {pattern} RETURN x.code, count(*), sum(x.depth), avg(x.depth)") == w.rows(f"MATCH {pattern} WITH x.code AS i, x.depth AS t, {read} RETURN i, count(*), sum(t), avg(t)")


def test_a_sequence_of_writes(spark):
    """Random writes to a table and to a dictionary end alike."""
    r = random.Random(5)
    s = Session(spark)
    ask = lambda q, **p: sorted(tuple(x) for x in s.execute(q, **p).collect())
    s.execute("CREATE NODE TABLE Jar(code STRING, volume INT64 DEFAULT 3, PRIMARY KEY(code)); CREATE REL TABLE ABOVE(FROM Jar TO Jar, gap INT64)")
    jars, above = {}, collections.Counter()
    for _ in range(4):
        new = [c for c in r.sample("abcdefghij", 3) if c not in jars]
        ask("UNWIND $l AS c CREATE (:Jar {code: c})", l=new)
        jars |= {c: 3 for c in new}
        some = r.sample("abcdefghij", 3)
        ask("UNWIND $l AS c MERGE (j:Jar {code: c}) ON MATCH SET j.volume = j.volume + 1 ON CREATE SET j.volume = 50", l=some)
        jars |= {c: jars[c] + 1 if c in jars else 50 for c in some}
        a, b = r.sample(sorted(jars), 2)
        ask("MATCH (x:Jar {code: $a}), (y:Jar {code: $b}) CREATE (x)-[:ABOVE {gap: 4}]->(y)", a=a, b=b)
        above[a, b] += 1
        gone = r.choice(sorted(jars))
        ask("MATCH (j:Jar {code: $c}) DETACH DELETE j", c=gone)
        jars.pop(gone)
        above = collections.Counter({k: n for k, n in above.items() if gone not in k})
        assert ask("MATCH (j:Jar) RETURN j.code, j.volume") == sorted(jars.items())
        assert ask("MATCH (x:Jar)-[e:ABOVE]->(y:Jar) RETURN x.code, y.code, count(*)") == sorted((*k, n) for k, n in above.items())


def test_writes_that_break_a_rule_change_nothing(spark):
    s = Session(spark)
    s.execute("CREATE NODE TABLE Jar(code STRING, volume INT64, PRIMARY KEY(code)); CREATE REL TABLE LID(FROM Jar TO Jar, MANY_ONE); UNWIND ['q', 'r', 's'] AS c CREATE (:Jar {code: c, volume: 1})")
    s.execute("MATCH (x:Jar {code: 'q'}), (y:Jar {code: 'r'}) CREATE (x)-[:LID]->(y)")
    for q in ("MATCH (x:Jar {code: 'q'}), (y:Jar {code: 's'}) CREATE (x)-[:LID]->(y)", "CREATE (:Jar {code: 's'})", "CREATE (:Jar {volume: 2})", "MATCH (j:Jar {code: 'q'}) DELETE j", "MATCH (j:Jar {code: 'q'}) SET j.code = 'r'"):
        with pytest.raises(RuntimeFault):
            s.execute(q)
        assert sorted(tuple(x) for x in s.execute("MATCH (j:Jar) RETURN j.code, j.volume").collect()) == [("q", 1), ("r", 1), ("s", 1)]
        assert s.execute("MATCH (x:Jar)-[:LID]->(y:Jar) RETURN x.code, y.code").collect() == [("q", "r")]
    s.execute("MATCH (j:Jar {code: 'r'}) SET j.code = 'z'")
    assert s.execute("MATCH (x:Jar)-[:LID]->(y:Jar) RETURN x.code, y.code").collect() == [("q", "z")]
    s.execute("MATCH (j:Jar {code: 's'}) UNWIND [4, 9, 2] AS v SET j.volume = v")
    assert s.execute("MATCH (j:Jar {code: 's'}) RETURN j.volume").collect() == [(9,)]


def edges(seed, n, m):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


@pytest.fixture(scope="module", params=[(1, 14, 16), (2, 20, 34)])
def net(request, spark):
    seed, n, m = request.param
    e = edges(seed, n, m)
    s = Session(spark)
    s.catalog.add_nodes("N", spark.createDataFrame([(i,) for i in range(n)], "id long"), "id")
    s.catalog.add_rels("E", {("N", "N"): (spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(e)], "a long, b long, k long"), "a", "b")}, "k")
    return s, n, e


def rows(s, q):
    return [tuple(r) for r in s.execute(q).collect()]


def call(s, name, out, more=""):
    return dict(rows(s, f"CALL {name}(['N'], ['E']{more}) YIELD node, {out} RETURN node.id, {out}"))


def compact(groups, n):
    ids = {}
    return {v: ids.setdefault(groups[v], len(ids)) for v in range(n)}


def reach(n, e):
    out = [[a == b or (a, b) in e for b in range(n)] for a in range(n)]
    for k, i in itertools.product(range(n), range(n)):
        if out[i][k]:
            out[i] = [x or y for x, y in zip(out[i], out[k], strict=True)]
    return out


def test_components(net):
    s, n, e = net
    both = reach(n, {*e, *((b, a) for a, b in e)})
    assert call(s, "weakly_connected_components", "component_id") == compact([min(j for j in range(n) if both[i][j]) for i in range(n)], n)
    r = reach(n, set(e))
    assert call(s, "strongly_connected_components", "component_id") == compact([min(j for j in range(n) if r[i][j] and r[j][i]) for i in range(n)], n)


def test_page_rank(net):
    s, n, e = net
    score = [1 / n] * n
    out = [sum(a == v for a, _ in e) for v in range(n)]
    for _ in range(19):
        lost = sum(score[v] for v in range(n) if not out[v]) / n
        new = [0.85 * (sum(score[a] / out[a] for a, b in e if b == v) + lost) + 0.15 / n for v in range(n)]
        done = sum(abs(x - y) for x, y in zip(score, new, strict=True)) < 1e-7
        score = new
        if done:
            break
    got = call(s, "page_rank", "score")
    assert all(abs(got[v] - score[v]) < 1e-9 for v in range(n))


def test_k_core(net):
    s, n, e = net
    core, left, k = {}, set(range(n)), 0
    while left:
        degree = {v: sum((a == v) + (b == v) for a, b in e if a in left and b in left) for v in left}
        low = [v for v in left if degree[v] <= k]
        if low:
            core |= {v: k for v in low}
            left -= set(low)
        else:
            k += 1
    assert call(s, "k_core_decomposition", "core") == core


@pytest.mark.parametrize("far", [1, 2**58])
def test_k_core_reads_the_edges_of_falling_vertices_only(spark, monkeypatch, far):
    """Offsets that fit a number with their table, and such that don't; an edge that leads nowhere; the rows of each round."""
    from pyspark.sql import functions as F

    from knotwork.operators import algorithms

    r, point = random.Random(5), lambda t, k: (t, (k - 9) * far)
    n = {point(t, k) for t in (3, 7) for k in range(20)}
    e = [(point(3, r.randrange(20)), point(7, r.randrange(1, 20))) for _ in range(90)] + [(point(3, 1), point(3, 1))] * 2
    kind = "struct<table:bigint,offset:bigint>"
    v = spark.createDataFrame([(x,) for x in sorted(n)], f"v {kind}")
    edges = spark.createDataFrame([*e, (point(3, 2), (7, 900))], f"a {kind}, b {kind}")
    core = {x: sum((a == x) + (b == x) for a, b in [*e, (point(3, 2), None)]) for x in n}
    read, near = 0, {x: [b for a, b in e if a == x] + [a for a, b in e if b == x] for x in n}
    while True:
        h = {x: max((k for k in range(1, core[x] + 1) if sum(core[y] >= k for y in near[x]) >= k), default=0) for x in n}
        fell = [x for x in n if h[x] < core[x]]
        if not fell:
            break
        read += sum(len(near[x]) for x in fell)
        core |= {x: h[x] for x in fell}
    rows, kept = [], algorithms.materialize
    monkeypatch.setattr(algorithms, "materialize", lambda df: rows.append((df.columns, (out := kept(df)).count())) or out)
    got = algorithms.k_core_decomposition(v, edges).select(F.col("v.table").alias("t"), F.col("v.offset").alias("o"), "core").collect()
    assert {(x["t"], x["o"]): x["core"] for x in got} == core and len(got) == len(n)
    assert sum(k for c, k in rows if {"ca", "cb"} <= set(c)) == read < 2 * len(e) * 3


def test_levels_and_cycles(spark):
    s = Session(spark)
    s.catalog.add_nodes("N", spark.createDataFrame([(i,) for i in range(6)], "id long"), "id")
    s.catalog.add_rels("E", {("N", "N"): (spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3), (2, 3)], "a long, b long"), "a", "b")})
    assert call(s, "topological_levels", "level") == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 0}
    s.execute("MATCH (a:N {id: 3}), (b:N {id: 0}) CREATE (a)-[:E]->(b)")
    with pytest.raises(RuntimeFault):
        call(s, "topological_levels", "level")
    for bad in ("CALL page_rank(['N','N'], ['E']) YIELD node RETURN node", "CALL page_rank(['X'], []) YIELD node RETURN node", "CALL page_rank(['N'], ['E'], damping := 2.0) YIELD node RETURN node"):
        with pytest.raises(BinderError):
            s.execute(bad)


def test_louvain_finds_cliques(spark):
    s = Session(spark)
    pairs = [*itertools.combinations(range(4), 2), *itertools.combinations(range(4, 8), 2), (3, 4)]
    s.catalog.add_nodes("N", spark.createDataFrame([(i,) for i in range(8)], "id long"), "id")
    s.catalog.add_rels("E", {("N", "N"): (spark.createDataFrame(pairs, "a long, b long"), "a", "b")})
    assert call(s, "louvain", "community_id") == {v: v // 4 for v in range(8)}
    assert call(s, "louvain", "community_id", ", max_phases := 0") == {v: v for v in range(8)}
