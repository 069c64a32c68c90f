"""Queries over the graph view of the driver's tables, and the SQL that gives the same rows.

Each entry: name -> (statement, SQL or None). All run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.family_queries import FAMILIES, FAMILY_OTHERS
from knotwork.session import Session

NODES = {
    "Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Orders": ("orders", "o_orderkey"),
    "Event": ("events", "event_id"), "Document": ("documents", "doc_id"), "Vector": ("embeddings", "vec_id"),
}


def graph(spark: SparkSession, sf_dir: str) -> Session:
    """The driver's tables as nodes and relationships. Nothing is read but the schemas."""
    s = Session(spark)
    t = {x: spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in {v[0] for v in NODES.values()} | {"lineitem", "conversations"}}
    c = s.catalog
    for label, (table, key) in NODES.items():
        c.add_nodes(label, t[table], key, no_nan=True)
    turns = t["conversations"].select((F.col("conv_id") * 1000000 + F.col("turn")).alias("id"), "conv_id", "turn", "role", "text")
    c.add_nodes("Turn", turns, "id")
    c.add_rels("IN_REGION", {("Nation", "Region"): (t["nation"].select("n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey")}, "n_nationkey", many="MANY_ONE")
    c.add_rels("IN_NATION", {("Customer", "Nation"): (t["customer"].select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey"), ("Supplier", "Nation"): (t["supplier"].select("s_suppkey", "s_nationkey"), "s_suppkey", "s_nationkey")}, many="MANY_ONE", unique=True)
    c.add_rels("PLACED", {("Customer", "Orders"): (t["orders"].select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderkey")}, "o_orderkey", many="ONE_MANY")
    line = t["lineitem"].select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    c.add_rels("CONTAINS", {("Orders", "Part"): (line, "l_orderkey", "l_partkey")}, "l_orderkey * 64 + l_linenumber", no_nan=True)
    c.add_rels("SUPPLIED", {("Supplier", "Part"): (t["lineitem"].select("l_suppkey", "l_partkey").distinct(), "l_suppkey", "l_partkey")}, unique=True)
    step = turns.filter("turn > 0").select((F.col("id") - 1).alias("prior"), F.col("id").alias("next"))
    c.add_rels("REPLIES", {("Turn", "Turn"): (step.join(turns.select(F.col("id").alias("prior")), "prior", "left_semi"), "prior", "next")}, "next", many="ONE_ONE")
    return s


_STEPS = "(SELECT conv_id*1000000+turn AS id FROM conversations)"
_REPLIES = "replies AS (SELECT a.conv_id*1000000+a.turn AS s, b.conv_id*1000000+b.turn AS d FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn=a.turn+1)"
#: Nation-region edges in both directions, for paths.
_BOTH = "edges AS (SELECT 'n'||n_nationkey AS a, 'r'||n_regionkey AS b, n_nationkey AS e FROM nation UNION ALL SELECT 'r'||n_regionkey, 'n'||n_nationkey, n_nationkey FROM nation)"

QUERIES: dict[str, tuple[str, str | None]] = {
    # scans, projections, filters
    "scan_filter_project": ("MATCH (o:Orders) WHERE o.o_totalprice > 200000 RETURN o.o_orderkey AS k, o.o_totalprice AS p", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 200000"),
    "pk_lookup": ("MATCH (c:Customer {c_custkey: 42}) RETURN c.c_name AS n, c.c_acctbal AS b", "SELECT c_name AS n, c_acctbal AS b FROM customer WHERE c_custkey = 42"),
    "multi_label_scan": ("MATCH (n:Customer:Supplier) RETURN label(n) AS l, count(*) AS c", "SELECT 'Customer' AS l, count(*) AS c FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier"),
    "multi_label_properties": ("MATCH (n:Customer:Supplier) WHERE coalesce(n.c_acctbal, n.s_acctbal) < 0 RETURN label(n) AS l, coalesce(n.c_name, n.s_name) AS name", "SELECT 'Customer' AS l, c_name AS name FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'Supplier', s_name FROM supplier WHERE s_acctbal < 0"),
    "property_spread": ("MATCH (r:Region) RETURN r.*", 'SELECT r_regionkey AS "r.r_regionkey", r_name AS "r.r_name" FROM region'),
    # traversal
    "extend_1hop": ("MATCH (c:Customer)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 100000 RETURN c.c_mktsegment AS seg, count(*) AS n ORDER BY seg", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer JOIN orders ON c_custkey=o_custkey WHERE o_totalprice > 100000 GROUP BY 1"),
    "extend_2hop": ("MATCH (c:Customer)-[:PLACED]->(o:Orders)-[e:CONTAINS]->(p:Part) RETURN p.p_brand AS brand, count(*) AS n, CAST(round(sum(e.l_quantity), 2) AS DOUBLE) AS q", "SELECT p_brand AS brand, count(*) AS n, round(sum(l_quantity),2) AS q FROM customer JOIN orders ON c_custkey=o_custkey JOIN lineitem ON l_orderkey=o_orderkey JOIN part ON p_partkey=l_partkey GROUP BY 1"),
    "extend_reverse": ("MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN n.n_name AS name, count(s) AS c", "SELECT n_name AS name, count(*) AS c FROM nation JOIN supplier ON s_nationkey=n_nationkey GROUP BY 1"),
    "extend_undirected": ("MATCH (a:Nation)-[:IN_REGION]-(b) RETURN a.n_name AS a, label(b) AS l, count(*) AS n", "SELECT n_name AS a, 'Region' AS l, count(*) AS n FROM nation GROUP BY 1"),
    "undirected_same_label": ("MATCH (a:Turn)-[:REPLIES]-(b:Turn) RETURN a.role AS a, b.role AS b, count(*) AS n", f"WITH {_REPLIES}, both_ AS (SELECT s,d FROM replies UNION ALL SELECT d,s FROM replies), t AS (SELECT conv_id*1000000+turn AS id, role FROM conversations) SELECT x.role AS a, y.role AS b, count(*) AS n FROM both_ JOIN t x ON x.id=s JOIN t y ON y.id=d GROUP BY 1,2"),
    "multi_type_rel": ("MATCH (c:Customer)-[e:PLACED|:IN_NATION]->(x) RETURN label(e) AS l, label(x) AS t, count(*) AS n", "SELECT 'PLACED' AS l, 'Orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'IN_NATION', 'Nation', count(*) FROM customer"),
    "unlabelled_rel": ("MATCH (s:Supplier)-[e]->(x) RETURN label(e) AS l, count(*) AS n", "SELECT 'IN_NATION' AS l, count(*) AS n FROM supplier UNION ALL SELECT 'SUPPLIED', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)"),
    "cycle_close": ("MATCH (s:Supplier)-[:SUPPLIED]->(p:Part)<-[:CONTAINS]-(o:Orders)<-[:PLACED]-(c:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s) RETURN count(*) AS n", "SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey sk, l_partkey pk FROM lineitem) x JOIN lineitem l ON l.l_partkey=x.pk JOIN orders ON o_orderkey=l.l_orderkey JOIN customer ON c_custkey=o_custkey JOIN supplier ON s_suppkey=x.sk WHERE c_nationkey=s_nationkey"),
    "repeated_node_filter": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (n)-[:IN_REGION]->(r:Region {r_name: 'ASIA'}) RETURN n.n_name AS name, count(*) AS c", "SELECT n_name AS name, count(*) AS c FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE r_name='ASIA' GROUP BY 1"),
    "linear_path_count": ("MATCH (:Region)<-[:IN_REGION]-(:Nation)<-[:IN_NATION]-(:Customer)-[:PLACED]->(:Orders)-[:CONTAINS]->(:Part)<-[:SUPPLIED]-(:Supplier) RETURN count(*) AS n", "SELECT CAST(sum(k) AS BIGINT) AS n FROM lineitem JOIN (SELECT l_partkey pk, count(DISTINCT l_suppkey) k FROM lineitem GROUP BY 1) ON pk=l_partkey"),
    "factorized_star_count": ("MATCH (o:Orders)-[:CONTAINS]->(p:Part), (o)<-[:PLACED]-(c:Customer) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders JOIN lineitem ON l_orderkey=o_orderkey"),
    "factorized_star_grouped": ("MATCH (p:Part)<-[:CONTAINS]-(:Orders), (p)<-[:SUPPLIED]-(:Supplier) RETURN p.p_brand AS b, count(*) AS n", "SELECT p_brand AS b, CAST(sum(a*c) AS BIGINT) AS n FROM part JOIN (SELECT l_partkey k, count(*) a, count(DISTINCT l_suppkey) c FROM lineitem GROUP BY 1) ON k=p_partkey GROUP BY 1"),
    # joins
    "cross_product": ("MATCH (a:Region), (b:Nation) RETURN a.r_name AS r, b.n_name AS n", "SELECT r_name AS r, n_name AS n FROM region, nation"),
    "value_hash_join": ("MATCH (s:Supplier), (c:Customer) WHERE s.s_nationkey = c.c_nationkey AND c.c_acctbal > 9000 RETURN s.s_name AS s, count(*) AS n", "SELECT s_name AS s, count(*) AS n FROM supplier JOIN customer ON s_nationkey=c_nationkey WHERE c_acctbal>9000 GROUP BY 1"),
    "theta_join": ("MATCH (a:Nation), (b:Region) WHERE a.n_regionkey < b.r_regionkey RETURN a.n_name AS n, b.r_name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey < r_regionkey"),
    "optional_match": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) RETURN c.c_custkey AS k, count(o) AS n", "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey=o_custkey GROUP BY 1"),
    "optional_where": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 300000 RETURN c.c_custkey AS k, o.o_orderkey AS o", "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON c_custkey=o_custkey AND o_totalprice>300000"),
    "optional_outer_condition": ("MATCH (c:Customer) WITH c, c.c_acctbal * 50 AS cap OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > cap RETURN c.c_custkey AS k, count(o) AS n", "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey=o_custkey AND o_totalprice > c_acctbal*50 GROUP BY 1"),
    "optional_chain": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders {o_orderpriority: '1-URGENT'}) OPTIONAL MATCH (o)-[:CONTAINS]->(p:Part) RETURN count(*) AS n, count(o) AS o, count(p) AS p", "SELECT count(*) AS n, count(o_orderkey) AS o, count(l_partkey) AS p FROM customer LEFT JOIN orders ON c_custkey=o_custkey AND o_orderpriority='1-URGENT' LEFT JOIN lineitem ON l_orderkey=o_orderkey"),
    "exists_subquery": ("MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 350000 } RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>350000)"),
    "not_exists": ("MATCH (c:Customer) WHERE NOT EXISTS { MATCH (c)-[:PLACED]->(o:Orders) } RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey)"),
    "not_exists_pair": ("MATCH (s:Supplier)-[:IN_NATION]->(n:Nation), (p:Part) WHERE p.p_size = 1 AND n.n_regionkey = 2 AND NOT EXISTS { MATCH (s)-[:SUPPLIED]->(p) } RETURN s.s_suppkey AS s, p.p_partkey AS p", "SELECT s_suppkey AS s, p_partkey AS p FROM supplier JOIN nation ON s_nationkey=n_nationkey, part WHERE p_size=1 AND n_regionkey=2 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey=s_suppkey AND l_partkey=p_partkey)"),
    "count_subquery": ("MATCH (c:Customer) RETURN c.c_custkey AS k, COUNT { MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_orderstatus = 'F' } AS n", "SELECT c_custkey AS k, (SELECT count(*) FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='F') AS n FROM customer"),
    "nested_exists": ("MATCH (n:Nation) WHERE EXISTS { MATCH (n)<-[:IN_NATION]-(c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 400000 } } RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer JOIN orders ON o_custkey=c_custkey WHERE o_totalprice>400000)"),
    "pattern_predicate": ("MATCH (c:Customer) WHERE c.c_acctbal > 5000 AND (c)-[:PLACED]->(:Orders) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_acctbal>5000 AND c_custkey IN (SELECT o_custkey FROM orders)"),
    "exists_or": ("MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(:Orders {o_orderpriority: '1-URGENT'}) } OR c.c_acctbal < 0 RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_acctbal<0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority='1-URGENT')"),
    # aggregation
    "agg_global": ("MATCH (o:Orders) RETURN count(*) AS n, round(sum(o.o_totalprice), 0) AS s, min(o.o_orderdate) AS lo, max(o.o_orderdate) AS hi, round(avg(o.o_totalprice), 3) AS a", "SELECT count(*) AS n, round(sum(o_totalprice),0) AS s, min(o_orderdate) AS lo, max(o_orderdate) AS hi, round(avg(o_totalprice),3) AS a FROM orders"),
    "agg_grouped": ("MATCH ()-[e:CONTAINS]->() RETURN e.l_returnflag AS f, e.l_linestatus AS s, round(sum(e.l_quantity), 2) AS q, round(avg(e.l_discount), 6) AS d, count(*) AS n", "SELECT l_returnflag AS f, l_linestatus AS s, round(sum(l_quantity),2) AS q, round(avg(l_discount),6) AS d, count(*) AS n FROM lineitem GROUP BY 1,2"),
    "agg_integer_sum": ("MATCH (p:Part) RETURN p.p_brand AS b, CAST(sum(p.p_size) AS INT64) AS s, avg(p.p_size) AS a", "SELECT p_brand AS b, CAST(sum(p_size) AS BIGINT) AS s, avg(p_size) AS a FROM part GROUP BY 1"),
    "agg_distinct": ("MATCH (c:Customer)-[:PLACED]->(o:Orders)-[:CONTAINS]->(p:Part) RETURN c.c_mktsegment AS seg, count(DISTINCT p) AS parts, count(DISTINCT o.o_orderpriority) AS pr", "SELECT c_mktsegment AS seg, count(DISTINCT l_partkey) AS parts, count(DISTINCT o_orderpriority) AS pr FROM customer JOIN orders ON o_custkey=c_custkey JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1"),
    "agg_collect": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, list_sort(collect(n.n_name)) AS names", "SELECT r_name AS r, list_sort(list(n_name)) AS names FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY 1"),
    "agg_percentile": ("MATCH (c:Customer) RETURN c.c_mktsegment AS s, percentileDisc(c.c_acctbal, 0.9) AS p", "SELECT c_mktsegment AS s, percentile_disc(0.9) WITHIN GROUP (ORDER BY c_acctbal) AS p FROM customer GROUP BY 1"),
    "agg_empty_input": ("MATCH (c:Customer) WHERE c.c_custkey < 0 RETURN count(*) AS n, sum(c.c_acctbal) AS s, size(collect(c.c_name)) AS l", "SELECT 0::BIGINT AS n, NULL::DOUBLE AS s, 0::BIGINT AS l"),
    "agg_by_node": ("MATCH (c:Customer)-[:PLACED]->(o:Orders) WITH c, count(*) AS n, max(o.o_totalprice) AS top WHERE n > 15 RETURN c.c_name AS name, n, top", "SELECT c_name AS name, count(*) AS n, max(o_totalprice) AS top FROM customer JOIN orders ON o_custkey=c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 15"),
    "having_with": ("MATCH (o:Orders)-[:CONTAINS]->() WITH o.o_orderpriority AS pr, count(*) AS n WHERE n > 100 RETURN pr, n", "SELECT o_orderpriority AS pr, count(*) AS n FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1 HAVING count(*)>100"),
    "agg_expression": ("MATCH (o:Orders) RETURN o.o_orderstatus AS s, count(*) + 1 AS n, round(max(o.o_totalprice) - min(o.o_totalprice), 2) AS d", "SELECT o_orderstatus AS s, count(*)+1 AS n, round(max(o_totalprice)-min(o_totalprice),2) AS d FROM orders GROUP BY 1"),
    # distinct, order, limits, unions, unwind
    "distinct": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN DISTINCT c.c_mktsegment AS s, n.n_regionkey AS r", "SELECT DISTINCT c_mktsegment AS s, n_regionkey AS r FROM customer JOIN nation ON c_nationkey=n_nationkey"),
    "order_nulls": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 400000 RETURN c.c_custkey AS k, o.o_totalprice AS p ORDER BY p DESC, k", "SELECT c_custkey AS k, o_totalprice AS p FROM customer LEFT JOIN orders ON o_custkey=c_custkey AND o_totalprice>400000 ORDER BY p DESC NULLS FIRST, k"),
    "skip_limit": ("MATCH (o:Orders) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k SKIP 10 LIMIT 20", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 20 OFFSET 10"),
    "topk": ("MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN c.c_custkey AS k, round(sum(o.o_totalprice), 1) AS s ORDER BY s DESC, k LIMIT 10", "SELECT c_custkey AS k, round(sum(o_totalprice),1) AS s FROM customer JOIN orders ON o_custkey=c_custkey GROUP BY 1 ORDER BY s DESC, k LIMIT 10"),
    "with_where_after_limit": ("MATCH (o:Orders) WITH o ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 100 WHERE o.o_orderstatus = 'F' RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) WHERE o_orderstatus='F'"),
    "union_all": ("MATCH (c:Customer) RETURN c.c_nationkey AS k UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "union_distinct": ("MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "unwind_list": ("UNWIND ['ASIA', 'EUROPE', NULL] AS name MATCH (r:Region) WHERE r.r_name = name RETURN name, r.r_regionkey AS k", "SELECT r_name AS name, r_regionkey AS k FROM region WHERE r_name IN ('ASIA','EUROPE')"),
    "unwind_range": ("UNWIND range(1, 10, 3) AS x RETURN x, x * x AS y", "SELECT x, x*x AS y FROM (SELECT unnest(generate_series(1::BIGINT,10,3)) AS x)"),
    "unwind_collect": ("MATCH (n:Nation) WITH n.n_regionkey AS r, collect(n) AS l UNWIND l AS x RETURN r, x.n_name AS name", "SELECT n_regionkey AS r, n_name AS name FROM nation"),
    # expressions
    "case_simple_null": ("MATCH (o:Orders) RETURN o.o_orderkey AS k, CASE o.o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS c, CASE nullif(o.o_orderstatus, 'O') WHEN NULL THEN 'any' ELSE 'none' END AS d", "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 1::BIGINT WHEN 'O' THEN 2 ELSE 0 END AS c, 'any' AS d FROM orders"),
    "case_searched": ("MATCH (c:Customer) RETURN CASE WHEN c.c_acctbal < 0 THEN 'neg' WHEN c.c_acctbal < 5000 THEN 'low' ELSE 'high' END AS b, count(*) AS n", "SELECT CASE WHEN c_acctbal<0 THEN 'neg' WHEN c_acctbal<5000 THEN 'low' ELSE 'high' END AS b, count(*) AS n FROM customer GROUP BY 1"),
    "in_list": ("MATCH (o:Orders) WHERE o.o_orderpriority IN ['1-URGENT', '2-HIGH'] AND NOT o.o_orderstatus IN ['P'] RETURN count(*) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH') AND o_orderstatus NOT IN ('P')"),
    "string_ops": ("MATCH (c:Customer) RETURN c.c_custkey AS k, upper(c.c_mktsegment) AS u, left(c.c_name, 4) AS l, right(c.c_name, 3) AS r, substring(c.c_name, 2, 3) AS s, lpad(to_string(c.c_custkey), 6, '0') AS p, reverse(c.c_mktsegment) AS v, initcap(c.c_mktsegment) AS i, concat(c.c_mktsegment, NULL, '-') AS x, size(c.c_name) AS z", "SELECT c_custkey AS k, upper(c_mktsegment) AS u, left(c_name,4) AS l, right(c_name,3) AS r, substring(c_name,2,3) AS s, lpad(c_custkey::VARCHAR,6,'0') AS p, reverse(c_mktsegment) AS v, upper(left(c_mktsegment,1))||lower(substring(c_mktsegment,2)) AS i, c_mktsegment||'-' AS x, length(c_name) AS z FROM customer"),
    "string_tests": ("MATCH (p:Part) WHERE p.p_type STARTS WITH 'S' AND p.p_type CONTAINS 'A' AND NOT p.p_name ENDS WITH '1' RETURN p.p_partkey AS k, levenshtein(p.p_brand, 'Brand#1') AS d, string_split(p.p_type, ' ') AS w, split_part(p.p_type, ' ', 1) AS f", "SELECT p_partkey AS k, levenshtein(p_brand,'Brand#1') AS d, string_split(p_type,' ') AS w, split_part(p_type,' ',1) AS f FROM part WHERE p_type LIKE 'S%' AND p_type LIKE '%A%' AND p_name NOT LIKE '%1'"),
    "regex_ops": ("MATCH (c:Customer) RETURN c.c_custkey AS k, regexp_matches(c.c_name, '[0-9]{3}$') AS m, c.c_name =~ 'Customer.*' AS f, regexp_replace(c.c_name, '0', 'x') AS one, regexp_replace(c.c_name, '0', 'x', 'g') AS every, regexp_extract(c.c_name, '([a-z]+)', 1) AS e", "SELECT c_custkey AS k, regexp_matches(c_name,'[0-9]{3}$') AS m, regexp_full_match(c_name,'Customer.*') AS f, regexp_replace(c_name,'0','x') AS one, regexp_replace(c_name,'0','x','g') AS every, regexp_extract(c_name,'([a-z]+)',1) AS e FROM customer"),
    "math_ops": ("MATCH (p:Part) RETURN p.p_partkey AS k, abs(-p.p_size) AS a, ceil(p.p_retailprice) AS c, floor(p.p_retailprice) AS f, round(sqrt(p.p_retailprice), 6) AS s, round(log(p.p_retailprice), 6) AS l, round(ln(p.p_retailprice), 6) AS n, sign(p.p_size) AS g, p.p_size ^ 2 AS w, p.p_size % 7 AS m", "SELECT p_partkey AS k, abs(-p_size) AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(sqrt(p_retailprice),6) AS s, round(log10(p_retailprice),6) AS l, round(ln(p_retailprice),6) AS n, sign(p_size)::BIGINT AS g, pow(p_size,2) AS w, (p_size % 7)::BIGINT AS m FROM part"),
    "bit_ops": ("MATCH (p:Part) RETURN p.p_partkey AS k, p.p_partkey & 6 AS a, p.p_partkey | 9 AS o, bitwise_xor(p.p_partkey, 5) AS x, p.p_partkey << 2 AS l, p.p_partkey >> 1 AS r", "SELECT p_partkey AS k, p_partkey & 6 AS a, p_partkey | 9 AS o, xor(p_partkey,5) AS x, p_partkey << 2 AS l, p_partkey >> 1 AS r FROM part"),
    "int_division": ("MATCH (p:Part) RETURN p.p_partkey AS k, p.p_partkey / 7 AS d, -p.p_partkey / 7 AS e, p.p_retailprice / 7 AS f", "SELECT p_partkey AS k, p_partkey // 7 AS d, -(p_partkey // 7) AS e, p_retailprice / 7 AS f FROM part"),
    "null_rules": ("MATCH (p:Part) WITH p, nullif(p.p_size, 5) AS x RETURN p.p_partkey AS k, greatest(x, 10) AS g, least(x, 10) AS l, coalesce(x, 0) AS c, x IS NULL AS n, x = 5 AS e, (x > 20) XOR true AS r", "SELECT p_partkey AS k, CASE WHEN x IS NULL THEN NULL ELSE greatest(x,10) END::BIGINT AS g, CASE WHEN x IS NULL THEN NULL ELSE least(x,10) END::BIGINT AS l, coalesce(x,0)::BIGINT AS c, x IS NULL AS n, x=5 AS e, NOT (x>20) AS r FROM (SELECT p_partkey, nullif(p_size,5) AS x FROM part)"),
    "cast_rounding": ("MATCH (p:Part) RETURN p.p_partkey AS k, CAST(p.p_size / 2.0 AS INT64) AS h, CAST(p.p_size AS STRING) AS s, CAST('12' AS INT32) AS i", "SELECT p_partkey AS k, CAST(round_even(p_size/2.0, 0) AS BIGINT) AS h, p_size::VARCHAR AS s, 12::INTEGER AS i FROM part"),
    "date_ops": ("MATCH (o:Orders) WHERE o.o_orderdate >= timestamp('1996-01-01 00:00:00') RETURN o.o_orderkey AS k, CAST(o.o_orderdate AS DATE) AS d, dayname(o.o_orderdate) AS n, monthname(o.o_orderdate) AS m, last_day(o.o_orderdate) AS l, CAST(o.o_orderdate AS DATE) - date('1996-01-01') AS days", "SELECT o_orderkey AS k, o_orderdate::DATE AS d, dayname(o_orderdate) AS n, monthname(o_orderdate) AS m, last_day(o_orderdate::DATE) AS l, o_orderdate::DATE - DATE '1996-01-01' AS days FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'"),
    "date_part": ("MATCH (e:Event) RETURN e.event_id AS k, date_part('year', e.ts) AS y, date_part('quarter', e.ts) AS q, date_part('hour', e.ts) AS h, date_part('second', e.ts) AS s, date_part('decade', e.ts) AS d, century(e.ts) AS c", "SELECT event_id AS k, date_part('year',ts) AS y, date_part('quarter',ts) AS q, date_part('hour',ts) AS h, date_part('second',ts) AS s, date_part('decade',ts) AS d, date_part('century',ts) AS c FROM events"),
    "date_trunc": ("MATCH (e:Event) RETURN date_trunc('month', e.ts) AS m, date_trunc('decade', e.ts) AS d, count(*) AS n", "SELECT date_trunc('month',ts)::TIMESTAMP AS m, date_trunc('decade',ts)::TIMESTAMP AS d, count(*) AS n FROM events GROUP BY 1,2"),
    "interval_add": ("MATCH (o:Orders) RETURN o.o_orderkey AS k, o.o_orderdate + interval('1 month 2 days') AS a, o.o_orderdate - to_days(30) AS b, CAST(o.o_orderdate AS DATE) + 10 AS c, CAST(o.o_orderdate AS DATE) + to_months(1) AS d", "SELECT o_orderkey AS k, o_orderdate + INTERVAL '1 month' + INTERVAL '2 days' AS a, o_orderdate - INTERVAL '30 days' AS b, o_orderdate::DATE + 10 AS c, (o_orderdate::DATE + INTERVAL '1 month')::DATE AS d FROM orders"),
    "list_lambda": ("MATCH (d:Document) WITH d.doc_id AS k, string_split(d.text, ' ') AS w RETURN k, list_transform(w, x -> size(x)) AS z, list_filter(w, x -> size(x) > 4) AS f, list_reduce(list_transform(w, x -> size(x)), (a, b) -> a + b) AS t", "SELECT k, list_transform(w, lambda x: length(x)) AS z, list_filter(w, lambda x: length(x)>4) AS f, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS t FROM (SELECT doc_id AS k, CASE WHEN len(p)=0 THEN p ELSE list_concat(list_filter(p[:-2], lambda x: x<>''), p[-1:]) END AS w FROM (SELECT doc_id, string_split(text,' ') AS p FROM documents))"),
    "list_comprehension": ("MATCH (p:Part) RETURN p.p_partkey AS k, [x IN range(1, 5) WHERE x > 2 | x * p.p_size] AS l, [x IN [1, 2, 3]] AS m", "SELECT p_partkey AS k, [(3*p_size)::BIGINT,(4*p_size)::BIGINT,(5*p_size)::BIGINT] AS l, [1::BIGINT,2,3] AS m FROM part"),
    "list_quantifiers": ("MATCH (p:Part) WITH p.p_partkey AS k, [p.p_size, 10, NULL] AS l RETURN k, any(x IN l WHERE x > 20) AS a, all(x IN l WHERE x > 5) AS b, none(x IN l WHERE x > 40) AS c, single(x IN l WHERE x = 10) AS d", "SELECT p_partkey AS k, p_size>20 AS a, false AS b, NOT p_size>40 AS c, p_size<>10 AS d FROM part"),
    "list_sort_slice": ("MATCH (p:Part) WITH p.p_partkey AS k, [p.p_size, 30, 10, 20] AS l RETURN k, list_sort(l) AS s, list_reverse_sort(l) AS r, l[2:3] AS m, l[-1] AS z, list_contains(l, 30) AS c, list_position(l, 20) AS p, list_distinct(l + [30]) AS u, list_sum(l) AS t", "SELECT k, list_sort(l) AS s, list_reverse_sort(l) AS r, l[2:3] AS m, l[-1] AS z, true AS c, list_position(l,20::BIGINT)::BIGINT AS p, CASE WHEN l[1] IN (30,10,20) THEN list_filter([l[1],30,10,20], lambda x, i: i=1 OR x<>l[1]) ELSE l END AS u, list_sum(l)::BIGINT AS t FROM (SELECT p_partkey AS k, [p_size::BIGINT,30,10,20] AS l FROM part)"),
    "struct_map": ("MATCH (p:Part) WITH p.p_partkey AS k, {size: p.p_size, brand: p.p_brand} AS s, map(['a', 'b', 'a'], [1, p.p_size, 3]) AS m RETURN k, s.size AS z, struct_extract(s, 'brand') AS b, map_extract(m, 'a') AS a, element_at(m, 'x') AS e, map_keys(m) AS ks, size(m) AS n", "SELECT p_partkey AS k, p_size AS z, p_brand AS b, [1::BIGINT,3] AS a, []::BIGINT[] AS e, ['a','b','a'] AS ks, 3::BIGINT AS n FROM part"),
    "union_value": ("MATCH (p:Part) WITH p.p_partkey AS k, union_value(num := p.p_size) AS u RETURN k, union_tag(u) AS t, union_extract(u, 'num') AS v", "SELECT p_partkey AS k, 'num' AS t, p_size AS v FROM part"),
    "vector_similarity": ("MATCH (a:Vector), (b:Vector) WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id RETURN a.vec_id AS k, count(*) AS n, CAST(sum(CASE WHEN array_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.1 THEN 1 ELSE 0 END) AS INT64) AS near, CAST(sum(CASE WHEN array_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) < 1.3 THEN 1 ELSE 0 END) AS INT64) AS close, CAST(sum(CASE WHEN array_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) < 0.0 THEN 1 ELSE 0 END) AS INT64) AS away", "SELECT a.vec_id AS k, count(*) AS n, sum((list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.1)::INT)::BIGINT AS near, sum((list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < 1.3)::INT)::BIGINT AS close, sum((list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < 0)::INT)::BIGINT AS away FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id GROUP BY 1"),
    "json_props": ("MATCH (e:Event) WITH e.event_id AS k, CAST(e.props AS JSON) AS j RETURN k, CAST(CAST(j.k AS STRING) AS INT64) AS v, j.nothing IS NULL AS x", "SELECT event_id AS k, json_extract_string(props, '$.k')::BIGINT AS v, true AS x FROM events"),
    "hash_functions": ("MATCH (c:Customer) RETURN c.c_custkey AS k, md5(c.c_name) AS m, sha256(c.c_name) AS s", "SELECT c_custkey AS k, md5(c_name) AS m, sha256(c_name) AS s FROM customer"),
    # recursive paths
    "var_walk": ("MATCH (a:Turn)-[e:REPLIES*1..3]->(b:Turn) RETURN length(e) AS l, count(*) AS n", f"WITH RECURSIVE {_REPLIES}, w AS (SELECT s, d, 1 AS l FROM replies UNION ALL SELECT w.s, r.d, l+1 FROM w JOIN replies r ON r.s=w.d WHERE l<3) SELECT l::BIGINT AS l, count(*) AS n FROM w GROUP BY 1"),
    "var_walk_undirected": ("MATCH (a:Region)-[e:IN_REGION*1..3]-(b) RETURN a.r_name AS r, length(e) AS l, count(*) AS n", f"WITH RECURSIVE {_BOTH}, w AS (SELECT a AS s, b, 1 AS l FROM edges WHERE a LIKE 'r%' UNION ALL SELECT s, e.b, l+1 FROM w JOIN edges e ON e.a=w.b WHERE l<3) SELECT r_name AS r, l::BIGINT AS l, count(*) AS n FROM w JOIN region ON s='r'||r_regionkey GROUP BY 1,2"),
    "var_trail": ("MATCH (a:Region)-[e:IN_REGION* TRAIL 1..4]-(b) RETURN a.r_name AS r, length(e) AS l, count(*) AS n", f"WITH RECURSIVE {_BOTH}, w AS (SELECT a AS s, b, 1 AS l, [e] AS p FROM edges WHERE a LIKE 'r%' UNION ALL SELECT s, x.b, l+1, list_append(p, x.e) FROM w JOIN edges x ON x.a=w.b WHERE l<4 AND NOT list_contains(p, x.e)) SELECT r_name AS r, l::BIGINT AS l, count(*) AS n FROM w JOIN region ON s='r'||r_regionkey GROUP BY 1,2"),
    "var_acyclic": ("MATCH (a:Nation)-[e:IN_REGION* ACYCLIC 1..4]-(b) RETURN length(e) AS l, count(*) AS n", f"WITH RECURSIVE {_BOTH}, w AS (SELECT a AS s, b, 1 AS l, []::VARCHAR[] AS p FROM edges WHERE a LIKE 'n%' UNION ALL SELECT s, x.b, l+1, list_append(p, x.a) FROM w JOIN edges x ON x.a=w.b WHERE l<4 AND NOT list_contains(p, x.a)) SELECT l::BIGINT AS l, count(*) AS n FROM w GROUP BY 1"),
    "var_zero_lower": ("MATCH (a:Turn)-[e:REPLIES*0..1]->(b:Turn) RETURN length(e) AS l, count(*) AS n", f"WITH {_REPLIES} SELECT 0::BIGINT AS l, count(*) AS n FROM conversations UNION ALL SELECT 1, count(*) FROM replies"),
    "var_lambda_filter": ("MATCH (a:Turn)-[e:REPLIES*1..3 (r, n | WHERE n.role = 'user')]->(b:Turn) RETURN length(e) AS l, count(*) AS n", f"WITH RECURSIVE {_REPLIES}, t AS (SELECT conv_id*1000000+turn AS id, role FROM conversations), w AS (SELECT s, d, 1 AS l FROM replies UNION ALL SELECT w.s, r.d, l+1 FROM w JOIN t ON t.id=w.d AND role='user' JOIN replies r ON r.s=w.d WHERE l<3) SELECT l::BIGINT AS l, count(*) AS n FROM w GROUP BY 1"),
    "shortest": ("MATCH (a:Turn {turn: 0})-[e:REPLIES* SHORTEST 1..10]->(b:Turn) RETURN a.conv_id AS c, max(length(e)) AS l, count(*) AS n", "SELECT conv_id AS c, max(turn)::BIGINT AS l, count(*) AS n FROM conversations WHERE turn BETWEEN 1 AND 10 GROUP BY 1"),
    "all_shortest": ("MATCH (a:Nation)-[e:IN_NATION|:PLACED|:CONTAINS* ALL SHORTEST 1..3]-(b:Part) RETURN a.n_nationkey AS a, b.p_partkey AS b, length(e) AS l, count(*) AS n", "SELECT c_nationkey AS a, l_partkey AS b, 3::BIGINT AS l, count(*) AS n FROM lineitem JOIN orders ON o_orderkey=l_orderkey JOIN customer ON c_custkey=o_custkey GROUP BY 1,2"),
    "wshortest": ("MATCH (a:Orders)-[e:CONTAINS* WSHORTEST(l_quantity) 1..1]->(b:Part) RETURN a.o_orderkey AS o, b.p_partkey AS p, cost(e) AS c", "SELECT l_orderkey AS o, l_partkey AS p, min(l_quantity) AS c FROM lineitem GROUP BY 1, 2"),
    "wshortest_turns": ("CREATE REL TABLE STEP(FROM Turn TO Turn, w INT64); COPY STEP FROM (MATCH (a:Turn)-[e:REPLIES*1..2]->(b:Turn) RETURN a.id, b.id, length(e) * 2 + a.turn % 3); MATCH (a:Turn)-[e:STEP* WSHORTEST(w) 1..3]->(b:Turn) RETURN a.conv_id AS k, count(*) AS n, sum(cost(e)) AS c, max(length(e)) AS l", f"WITH RECURSIVE {_REPLIES}, step AS (SELECT s, d, 2 + s % 1000000 % 3 AS w FROM replies UNION ALL SELECT x.s, y.d, 4 + x.s % 1000000 % 3 FROM replies x JOIN replies y ON y.s = x.d), ways AS (SELECT s, d, w AS c, 1 AS l FROM step UNION ALL SELECT x.s, y.d, c + y.w, l + 1 FROM ways x JOIN step y ON y.s = x.d WHERE l < 3), best AS (SELECT s, d, min(struct_pack(c := c, l := l)) AS b FROM ways GROUP BY 1, 2) SELECT s // 1000000 AS k, count(*) AS n, sum(b.c)::DOUBLE AS c, max(b.l)::BIGINT AS l FROM best GROUP BY 1"),
    "path_functions": ("MATCH p = (a:Turn {turn: 0})-[:REPLIES*2..2]->(b:Turn) RETURN a.conv_id AS c, length(p) AS l, properties(nodes(p), 'turn') AS t, is_trail(p) AS r, is_acyclic(p) AS y", "SELECT a.conv_id AS c, 2::BIGINT AS l, [0::BIGINT,1,2] AS t, true AS r, true AS y FROM conversations a JOIN conversations b ON b.conv_id=a.conv_id AND b.turn=2 WHERE a.turn=0"),
    # algorithms
    "algo_levels": ("CALL topological_levels(['Turn'], ['REPLIES']) YIELD node, level RETURN level, count(*) AS n, count(node.text) AS t", "SELECT turn AS level, count(*) AS n, count(text) AS t FROM conversations GROUP BY 1"),
    "algo_wcc": ("CALL weakly_connected_components(['Turn'], ['REPLIES']) YIELD node, component_id RETURN node.conv_id AS c, component_id AS i, count(*) AS n", "SELECT conv_id AS c, dense_rank() OVER (ORDER BY conv_id)-1 AS i, count(*) AS n FROM conversations GROUP BY conv_id"),
    "algo_scc": ("CALL strongly_connected_components(['Turn'], ['REPLIES']) YIELD node, component_id RETURN count(DISTINCT component_id) AS n, min(component_id) AS lo, max(component_id) AS hi", "SELECT count(*) AS n, 0::BIGINT AS lo, count(*)-1 AS hi FROM conversations"),
    "algo_pagerank": ("CALL page_rank(['Nation', 'Region'], ['IN_REGION'], max_iterations := 2) YIELD node, score RETURN label(node) AS l, node.n_nationkey AS n, node.r_regionkey AS r, round(score, 7) AS s", "WITH v AS (SELECT (SELECT count(*) FROM nation)+(SELECT count(*) FROM region) AS n) SELECT 'Nation' AS l, n_nationkey AS n, NULL::INTEGER AS r, round(0.85*((SELECT count(*) FROM region)/v.n/v.n)+0.15/v.n,7) AS s FROM nation, v UNION ALL SELECT 'Region', NULL, r_regionkey, round(0.85*((SELECT count(*) FROM nation WHERE n_regionkey=r_regionkey)/v.n+(SELECT count(*) FROM region)/v.n/v.n)+0.15/v.n,7) FROM region, v"),
    "algo_kcore": ("CALL k_core_decomposition(['Nation', 'Region'], ['IN_REGION']) YIELD node, core RETURN core, count(*) AS n", "SELECT core, count(*) AS n FROM (SELECT 1::BIGINT AS core FROM nation UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_regionkey=r_regionkey) THEN 1 ELSE 0 END FROM region) GROUP BY 1"),
    "algo_louvain": ("CALL louvain(['Nation', 'Region'], ['IN_REGION']) YIELD node, community_id RETURN community_id AS c, count(*) AS n", None),
    # functions of the catalog
    "show_tables": ("CALL show_tables() RETURN name, type", "SELECT * FROM (VALUES ('Region','NODE'),('Nation','NODE'),('Customer','NODE'),('Supplier','NODE'),('Part','NODE'),('Orders','NODE'),('Event','NODE'),('Document','NODE'),('Vector','NODE'),('Turn','NODE'),('IN_REGION','REL'),('IN_NATION','REL'),('PLACED','REL'),('CONTAINS','REL'),('SUPPLIED','REL'),('REPLIES','REL')) t(name, type)"),
    "macro_call": ("CREATE MACRO net(p, d := 0) AS p * (1 - d); MATCH ()-[e:CONTAINS]->() RETURN e.l_returnflag AS f, round(sum(net(e.l_extendedprice, e.l_discount)), 0) AS s", "SELECT l_returnflag AS f, round(sum(l_extendedprice*(1-l_discount)),0) AS s FROM lineitem GROUP BY 1"),
    "create_merge_set_delete": ("CREATE NODE TABLE Tag(name STRING, n INT64 DEFAULT 0, PRIMARY KEY(name)); CREATE REL TABLE HAS(FROM Nation TO Tag, w INT64); MATCH (n:Nation) MERGE (t:Tag {name: left(n.n_name, 1)}) ON CREATE SET t.n = 1; MATCH (n:Nation), (t:Tag) WHERE left(n.n_name, 1) = t.name CREATE (n)-[:HAS {w: n.n_nationkey}]->(t); MATCH (t:Tag) WHERE t.name IN ['A', 'B', 'C'] SET t.n = 7; MATCH (t:Tag {name: 'U'}) DETACH DELETE t; MATCH (n:Nation)-[h:HAS]->(t:Tag) RETURN t.name AS t, t.n AS v, count(*) AS n, CAST(sum(h.w) AS INT64) AS w", "SELECT left(n_name,1) AS t, CASE WHEN left(n_name,1) IN ('A','B','C') THEN 7 ELSE 1 END::BIGINT AS v, count(*) AS n, sum(n_nationkey)::BIGINT AS w FROM nation WHERE left(n_name,1) <> 'U' GROUP BY 1,2"),
    "sequence_default": ("CREATE SEQUENCE sq START 5 INCREMENT 2; CREATE NODE TABLE Seq(id INT64, s INT64 DEFAULT nextval('sq'), PRIMARY KEY(id)); MATCH (r:Region) CREATE (:Seq {id: r.r_regionkey}); MATCH (x:Seq) RETURN count(*) AS n, min(x.s) AS lo, max(x.s) AS hi", "SELECT count(*) AS n, 5::BIGINT AS lo, 5+2*(count(*)-1) AS hi FROM region"),
}

QUERIES |= FAMILIES


def local_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, as a path of the driver's file system."""
    import os
    import re
    import uuid

    from knotwork.operators.storage import shared_dir

    folder = f"{re.sub('^file:/+', '/', shared_dir(spark))}/{name}-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def run(name: str):
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return graph(spark, sf_dir).execute(QUERIES[name][0])

    return call


def csv_load_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY TO CSV, then LOAD FROM with a sniffed dialect."""
    from knotwork.operators.storage import shared_dir

    s = graph(spark, sf_dir)
    path = f"{shared_dir(spark)}/nation-{s.catalog.next_id}-{abs(hash(sf_dir))}.csv"
    s.execute(f"COPY (MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name, n.n_regionkey AS r) TO '{path}' (HEADER=true)")
    return s.execute(f"LOAD FROM '{path}' (HEADER=true) WHERE r > 0 RETURN k, name, r")


def parquet_copy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY TO Parquet, then COPY FROM into node and relationship tables."""
    from knotwork.operators.storage import shared_dir

    s = graph(spark, sf_dir)
    base = f"{shared_dir(spark)}/copies-{abs(hash(sf_dir))}"
    s.execute(f"COPY (MATCH (n:Nation) RETURN n.n_nationkey, n.n_name) TO '{base}-n.parquet' (COMPRESSION='zstd')")
    s.execute(f"COPY (MATCH (n:Nation) RETURN n.n_nationkey AS a, n.n_regionkey AS b, n.n_name AS name) TO '{base}-e.parquet'")
    s.execute("CREATE NODE TABLE N2(id INT64, name STRING, PRIMARY KEY(id)); CREATE REL TABLE E2(FROM N2 TO Region, name STRING)")
    s.execute(f"COPY N2 FROM '{base}-n.parquet'")
    s.execute(f"COPY E2 FROM '{base}-e.parquet'")
    return s.execute("MATCH (n:N2)-[e:E2]->(r:Region) WHERE n.name = e.name RETURN r.r_name AS r, count(*) AS n")


def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar function of the user's."""
    s = graph(spark, sf_dir)
    s.register_function("vowels", lambda x: sum(c in "AEIOU" for c in x), ["STRING"], "INT64")
    return s.execute("MATCH (n:Nation) RETURN n.n_name AS name, vowels(n.n_name) AS v")


OTHERS = {
    "csv_load_roundtrip": (csv_load_roundtrip, "SELECT n_nationkey::BIGINT AS k, n_name AS name, n_regionkey::BIGINT AS r FROM nation WHERE n_regionkey > 0"),
    "parquet_copy_roundtrip": (parquet_copy_roundtrip, "SELECT r_name AS r, count(*) AS n FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY 1"),
    "udf_scalar": (udf_scalar, "SELECT n_name AS name, length(regexp_replace(n_name,'[^AEIOU]','','g')) AS v FROM nation"),
} | FAMILY_OTHERS


def queries() -> dict:
    return {k: run(k) for k in QUERIES} | {k: f for k, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql} | {k: sql for k, (_, sql) in OTHERS.items()}
