"""Queries that call every function of a family, and statements that define, change and move data; with their SQL.

As in queries.py: name -> (statement, SQL or None), over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Nations of one region are near each other, with a weight; every way between them is a cycle.
_NEAR = "CREATE REL TABLE NEAR(FROM Nation TO Nation, w INT64); MATCH (a:Nation), (b:Nation) WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey CREATE (a)-[:NEAR {w: (a.n_nationkey * 7 + b.n_nationkey * 13) % 11 + 1}]->(b); "
_NEAR_SQL = "near AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, (a.n_nationkey * 7 + b.n_nationkey * 13) % 11 + 1 AS w FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)"
#: All ways of up to four steps, and the cheapest.
_WAYS = f"{_NEAR_SQL}, ways AS (SELECT a, b, w AS c, 1 AS l FROM near UNION ALL SELECT x.a, n.b, x.c + n.w, l + 1 FROM ways x JOIN near n ON n.a = x.b WHERE l < 4), best AS (SELECT a, b, min(c) AS c FROM ways WHERE a <> b GROUP BY 1, 2)"


def _pagerank_sql(rounds: int = 19) -> str:
    """The default sweeps over suppliers and the parts they supply, one after the other."""
    out = "WITH e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), v AS (SELECT 's' || s_suppkey AS k FROM supplier UNION ALL SELECT 'p' || p_partkey FROM part), n AS (SELECT count(*)::DOUBLE AS n FROM v), d AS (SELECT a, count(*) AS d FROM e GROUP BY 1), r0 AS (SELECT k, 1 / n AS r FROM v, n)"
    for i in range(rounds):
        out += f", l{i} AS (SELECT coalesce(sum(r), 0) / max(n) AS l FROM r{i}, n WHERE k NOT IN (SELECT a FROM d)), g{i} AS (SELECT b, sum(r / d) AS g FROM r{i} JOIN e ON e.a = k JOIN d ON d.a = k GROUP BY 1)"
        out += f", r{i + 1} AS MATERIALIZED (SELECT k, 0.85 * (coalesce(g, 0) + l) + 0.15 / n AS r FROM v LEFT JOIN g{i} ON b = k, l{i}, n)"
    return out + f" SELECT left(k, 1) AS t, substr(k, 2)::BIGINT AS k, round(r, 8) AS s FROM r{rounds}"


FAMILIES: dict[str, tuple[str, str | None]] = {
    # functions by family
    "fn_trigonometry": (
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_size / 100.0 AS x RETURN k, round(acos(x), 6) AS a, round(asin(x), 6) AS b, round(atan(x), 6) AS c, round(atan2(x, 0.5), 6) AS d, round(cos(x), 6) AS e, round(cot(x), 6) AS f, round(degrees(x), 6) AS g, round(radians(x), 6) AS h, round(sin(x), 6) AS i, round(tan(x), 6) AS j, round(pi() * x, 6) AS l",
        "SELECT k, round(acos(x),6) AS a, round(asin(x),6) AS b, round(atan(x),6) AS c, round(atan2(x,0.5),6) AS d, round(cos(x),6) AS e, round(cot(x),6) AS f, round(degrees(x),6) AS g, round(radians(x),6) AS h, round(sin(x),6) AS i, round(tan(x),6) AS j, round(pi()*x,6) AS l FROM (SELECT p_partkey AS k, p_size/100.0::DOUBLE AS x FROM part)",
    ),
    "fn_powers": (
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_size AS n, p.p_size / 10.0 AS x RETURN k, round(cbrt(x), 6) AS a, round(exp(x), 4) AS b, round(log10(x), 6) AS c, round(log2(x), 6) AS d, round(pow(x, 2.5), 4) AS e, round(power(x, 0.5), 6) AS f, round(x ^ 1.5, 5) AS g, ceiling(x) AS h, even(x) AS i, even(-x) AS j, factorial(n % 16) AS l, round(gamma(x), 3) AS m, round(lgamma(x), 5) AS o, negate(n) AS q",
        "SELECT k, round(cbrt(x),6) AS a, round(exp(x),4) AS b, round(log10(x),6) AS c, round(log2(x),6) AS d, round(pow(x,2.5),4) AS e, round(power(x,0.5),6) AS f, round(x^1.5,5) AS g, ceiling(x) AS h, even(x) AS i, even(-x) AS j, factorial(n%16)::BIGINT AS l, round(gamma(x),3) AS m, round(lgamma(x),5) AS o, -n AS q FROM (SELECT p_partkey AS k, p_size AS n, p_size/10.0::DOUBLE AS x FROM part)",
    ),
    "fn_bits_and_comparisons": (
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_size AS n RETURN k, bitwise_and(k, 12) AS a, bitwise_or(k, 12) AS b, bitshift_left(k, 3) AS c, bitshift_right(k, 2) AS d, equals(n, 7) AS e, not_equals(n, 7) AS f, less_than(n, 7) AS g, less_than_equals(n, 7) AS h, greater_than(n, 7) AS i, greater_than_equals(n, 7) AS j",
        "SELECT p_partkey AS k, p_partkey & 12 AS a, p_partkey | 12 AS b, p_partkey << 3 AS c, p_partkey >> 2 AS d, p_size=7 AS e, p_size<>7 AS f, p_size<7 AS g, p_size<=7 AS h, p_size>7 AS i, p_size>=7 AS j FROM part",
    ),
    "fn_nulls_and_utilities": (
        "MATCH (p:Part) WITH p.p_partkey AS k, nullif(p.p_size, 5) AS n RETURN k, ifnull(n, -1) AS a, constant_or_null('c', n) AS b, CAST(count_if(n > 20) AS INT64) AS c, typeof(n) AS d, typeof('x') AS e, hash(k) = hash(k) AS f, current_date() > date('2020-01-01') AS g, current_timestamp() > CAST('2020-01-01 00:00:00' AS TIMESTAMP_TZ) AS h, size(to_string(gen_random_uuid())) AS i, random() < 1.0 AS j, offset(internal_id(3, k)) AS l",
        "SELECT k, coalesce(n,-1)::BIGINT AS a, CASE WHEN n IS NULL THEN NULL ELSE 'c' END AS b, CASE WHEN n>20 THEN 1::BIGINT ELSE 0 END AS c, 'INT32' AS d, 'STRING' AS e, true AS f, true AS g, true AS h, 36::BIGINT AS i, true AS j, k AS l FROM (SELECT p_partkey AS k, nullif(p_size,5) AS n FROM part)",
    ),
    "fn_to_numbers": (
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_size AS n, to_string(p.p_size) AS t RETURN k, CAST(to_int8(t) AS INT64) AS a, CAST(to_int16(n) AS INT64) AS b, CAST(to_int32(t) AS INT64) AS c, to_int64(t) AS d, CAST(to_int128(t) AS INT64) AS e, CAST(to_uint8(n) AS INT64) AS f, CAST(to_uint16(t) AS INT64) AS g, CAST(to_uint32(n) AS INT64) AS h, CAST(to_uint64(t) AS INT64) AS i, CAST(to_uint128(n) AS INT64) AS j, to_serial(n) AS l, to_double(t) AS m, CAST(to_float(n) AS DOUBLE) AS o, to_bool('true') AS q, string(n) AS r",
        "SELECT p_partkey AS k, p_size::BIGINT AS a, p_size::BIGINT AS b, p_size::BIGINT AS c, p_size::BIGINT AS d, p_size::BIGINT AS e, p_size::BIGINT AS f, p_size::BIGINT AS g, p_size::BIGINT AS h, p_size::BIGINT AS i, p_size::BIGINT AS j, p_size::BIGINT AS l, p_size::DOUBLE AS m, p_size::DOUBLE AS o, true AS q, p_size::VARCHAR AS r FROM part",
    ),
    "fn_to_others": (
        "MATCH (o:Orders) WITH o.o_orderkey AS k, o.o_orderdate AS t RETURN k, to_date(left(to_string(t), 10)) AS a, octet_length(blob('abc')) AS b, octet_length(to_blob('abcd')) AS c, to_string(uuid('A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11')) AS d, to_string(to_uuid('a0eebc999c0b4ef8bb6d6bb9bd380a11')) AS e, t + duration('3 days') AS f, t + to_interval('2 hours') AS g, t - interval('1 year') AS h, t + interval('10 days') / 5 AS i",
        "SELECT o_orderkey AS k, o_orderdate::DATE AS a, 3::BIGINT AS b, 4::BIGINT AS c, 'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11' AS d, 'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11' AS e, o_orderdate + INTERVAL 3 DAY AS f, o_orderdate + INTERVAL 2 HOUR AS g, o_orderdate - INTERVAL 1 YEAR AS h, o_orderdate + INTERVAL 2 DAY AS i FROM orders",
    ),
    "cast_matrix": (
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_size AS n, p.p_retailprice AS x RETURN k, to_int64(n > 20) AS a, to_bool(n % 2) AS b, CAST('false' AS BOOL) AS c, CAST(CAST(x AS DECIMAL(18, 1)) AS DOUBLE) AS d, CAST('[1, 2, 3]' AS INT64[]) AS e, CAST([n, 2] AS STRING[]) AS f, CAST({v: n} AS STRUCT(v STRING)).v AS g, CAST(x AS INT32) AS h, cast(n, 'DOUBLE') AS i, CAST(CAST(n AS INT16) AS STRING) AS j, CAST(NULL AS STRING) AS l, CAST(CAST('2020-02-03' AS DATE) AS STRING) AS m",
        "SELECT p_partkey AS k, (p_size>20)::BIGINT AS a, (p_size%2)::BOOLEAN AS b, false AS c, p_retailprice::DECIMAL(18,1)::DOUBLE AS d, [1::BIGINT,2,3] AS e, [p_size::VARCHAR,'2'] AS f, p_size::VARCHAR AS g, round_even(p_retailprice,0)::INTEGER AS h, p_size::DOUBLE AS i, p_size::VARCHAR AS j, NULL::VARCHAR AS l, '2020-02-03' AS m FROM part",
    ),
    "fn_text_shape": (
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_name AS s, p.p_type AS t RETURN k, concat_ws('-', s, t, 'z') AS a, lcase(t) AS b, lower(t) AS c, tolower(t) AS d, ucase(s) AS e, toupper(s) AS f, ltrim(concat('  ', s)) AS g, rtrim(concat(s, '  ')) AS h, trim(concat(' ', s, ' ')) AS i, octet_length(encode(s)) AS j, decode(encode(t)) AS l, repeat(left(s, 2), 3) AS m, replace(t, 'A', 'xy') AS n, rpad(left(t, 3), 6, '*') AS o, substr(t, 2, 4) AS q, right(t, 2) AS r",
        "SELECT k, concat_ws('-',s,t,'z') AS a, lower(t) AS b, lower(t) AS c, lower(t) AS d, upper(s) AS e, upper(s) AS f, ltrim('  '||s) AS g, rtrim(s||'  ') AS h, trim(' '||s||' ') AS i, strlen(s)::BIGINT AS j, t AS l, repeat(left(s,2),3) AS m, replace(t,'A','xy') AS n, rpad(left(t,3),6,'*') AS o, substr(t,2,4) AS q, right(t,2) AS r FROM (SELECT p_partkey AS k, p_name AS s, p_type AS t FROM part)",
    ),
    "fn_text_search": (
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_brand AS s, p.p_type AS t RETURN k, contains(t, 'A') AS a, starts_with(t, 'S') AS b, prefix(t, 'PROMO') AS c, ends_with(s, '3') AS d, suffix(s, '23') AS e, str_split(t, 'A') AS f, string_to_array(concat(s, '/', t), '/') AS g, regexp_extract_all(t, '[A-M]+') AS h, regexp_full_match(s, 'Brand#[0-9]+') AS i, regexp_split_to_array(concat(s, '1', t), '[0-9]') AS j, array_extract(t, 2) AS l",
        "SELECT k, contains(t,'A') AS a, starts_with(t,'S') AS b, prefix(t,'PROMO') AS c, suffix(s,'3') AS d, suffix(s,'23') AS e, CASE WHEN len(f)=0 THEN f ELSE list_concat(list_filter(f[:-2], lambda x: x<>''), f[-1:]) END AS f, string_split(s||'/'||t,'/') AS g, regexp_extract_all(t,'[A-M]+') AS h, regexp_full_match(s,'Brand#[0-9]+') AS i, string_split_regex(s||'1'||t,'[0-9]') AS j, array_extract(t,2) AS l FROM (SELECT p_partkey AS k, p_brand AS s, p_type AS t, string_split(p_type,'A') AS f FROM part)",
    ),
    "fn_list_growth": (
        "MATCH (p:Part) WITH p.p_partkey AS k, [p.p_partkey, 2, 3] AS l RETURN k, list_append(l, 9) AS a, array_append(l, 9) AS b, array_push_back(l, 9) AS c, list_prepend(l, 9) AS d, array_prepend(l, 9) AS e, array_push_front(l, 9) AS f, list_concat(l, [4]) AS g, list_cat(l, [4]) AS h, array_concat(l, [4]) AS i, array_cat(l, [4]) AS j, list_creation(k, 1) AS m, array_value(k, 5) AS n",
        "SELECT k, list_append(l,9) AS a, list_append(l,9) AS b, list_append(l,9) AS c, list_prepend(9,l) AS d, list_prepend(9,l) AS e, list_prepend(9,l) AS f, l||[4] AS g, l||[4] AS h, l||[4] AS i, l||[4] AS j, [k,1] AS m, [k,5] AS n FROM (SELECT p_partkey AS k, [p_partkey,2,3] AS l FROM part)",
    ),
    "fn_list_search": (
        "MATCH (p:Part) WITH p.p_partkey AS k, [p.p_partkey, 20, 30, 20] AS l RETURN k, array_contains(l, 7) AS a, array_has(l, 7) AS b, list_has(l, 30) AS c, list_has_all(l, [20, 30]) AS d, array_position(l, 20) AS e, array_indexof(l, 30) AS f, list_indexof(l, 30) AS g, list_unique(l) AS h, list_any_value(l) AS i, list_element(l, 2) AS j, list_extract(l, -1) AS m, array_extract(l, 1) AS n, array_slice(l, 2, 3) AS o, list_slice(l, 1, 2) AS q, cardinality(l) AS r",
        "SELECT k, k=7 AS a, k=7 AS b, true AS c, true AS d, list_position(l,20)::BIGINT AS e, list_position(l,30)::BIGINT AS f, list_position(l,30)::BIGINT AS g, list_unique(l)::BIGINT AS h, k AS i, 20::BIGINT AS j, 20::BIGINT AS m, k AS n, [20::BIGINT,30] AS o, [k,20] AS q, 4::BIGINT AS r FROM (SELECT p_partkey AS k, [p_partkey,20,30,20] AS l FROM part)",
    ),
    "fn_list_order": (
        "MATCH (p:Part) WITH p.p_partkey AS k, [p.p_size, 20, 30] AS l RETURN k, array_sort(l) AS a, array_reverse(l) AS b, list_reverse(l) AS c, list_to_string(',', l) AS d, array_to_string('-', l) AS e, list_product([k % 10, 2, 3]) AS f, size(array_distinct([k % 2, 1, 1])) AS g",
        "SELECT k, list_sort(l) AS a, list_reverse(l) AS b, list_reverse(l) AS c, array_to_string(l,',') AS d, array_to_string(l,'-') AS e, (k%10)*6 AS f, CASE WHEN k%2=1 THEN 1::BIGINT ELSE 2 END AS g FROM (SELECT p_partkey AS k, [p_size::BIGINT,20,30] AS l FROM part)",
    ),
    "fn_vectors": (
        "MATCH (p:Part) WITH p.p_partkey AS k, [p.p_retailprice, 1.5, 2.5] AS a, [3.5, 4.5, p.p_retailprice] AS b RETURN k, array_cross_product(a, b) AS x, round(array_squared_distance(a, b), 3) AS d, round(array_inner_product(a, b), 4) AS i",
        "SELECT p_partkey AS k, [1.5*r-2.5*4.5, 2.5*3.5-r*r, r*4.5-1.5*3.5] AS x, round((r-3.5)*(r-3.5)+9+(2.5-r)*(2.5-r),3) AS d, round(r*3.5+1.5*4.5+2.5*r,4) AS i FROM (SELECT p_partkey, p_retailprice AS r FROM part)",
    ),
    "fn_maps_and_structs": (
        "MATCH (p:Part) WITH p.p_partkey AS k, map(['a', 'b'], [p.p_size, 2]) AS m, struct_pack(x := p.p_brand, y := p.p_size) AS s RETURN k, map_values(m) AS v, s.x AS x, s.y AS y, CASE WHEN s.y > 25 THEN s.x END AS z",
        "SELECT p_partkey AS k, [p_size::BIGINT, 2] AS v, p_brand AS x, p_size AS y, CASE WHEN p_size>25 THEN p_brand END AS z FROM part",
    ),
    "fn_dates": (
        "MATCH (e:Event) WITH e.event_id AS k, e.ts AS t RETURN k, datepart('month', t) AS a, datetrunc('day', t) AS b, make_date(2020, date_part('month', t), 5) AS c, to_epoch_ms(t) AS d, epoch_ms(k * 1000) AS e, to_timestamp(k + 0.5) AS f, t + to_years(1) AS g, t + to_hours(5) AS h, t + to_minutes(7) AS i, t + to_seconds(9) AS j, t + to_milliseconds(11) AS l, t + to_microseconds(13) AS m",
        "SELECT event_id AS k, month(ts)::BIGINT AS a, date_trunc('day',ts)::TIMESTAMP AS b, make_date(2020,month(ts),5) AS c, epoch_us(ts) // 1000 AS d, epoch_ms(event_id*1000)::TIMESTAMP AS e, TIMESTAMP '1970-01-01' + to_milliseconds(event_id*1000+500) AS f, ts + INTERVAL 1 YEAR AS g, ts + INTERVAL 5 HOUR AS h, ts + INTERVAL 7 MINUTE AS i, ts + INTERVAL 9 SECOND AS j, ts + INTERVAL 11 MILLISECOND AS l, ts + INTERVAL 13 MICROSECOND AS m FROM events",
    ),
    "fn_graph": (
        "MATCH (n:Nation)-[e:IN_REGION]->(r:Region) RETURN n.n_nationkey AS k, offset(id(n)) AS a, rowid(r) AS b, labels(n) AS c, keys(r) AS d, id(start_node(e)) = id(n) AS e, id(end_node(e)) = id(r) AS f, id(n) = id(r) AS g, label(e) AS h",
        "SELECT n_nationkey AS k, n_nationkey::BIGINT AS a, n_regionkey::BIGINT AS b, 'Nation' AS c, ['r_regionkey','r_name'] AS d, true AS e, true AS f, false AS g, 'IN_REGION' AS h FROM nation",
    ),
    "fn_paths": (
        "MATCH p = (a:Turn)-[:REPLIES*2..2]->(b:Turn) RETURN a.id AS k, size(rels(p)) AS r, size(relationships(p)) AS s, size(nodes(p)) AS n",
        "SELECT a.conv_id*1000000+a.turn AS k, 2::BIGINT AS r, 2::BIGINT AS s, 3::BIGINT AS n FROM conversations a JOIN conversations m ON m.conv_id=a.conv_id AND m.turn=a.turn+1 JOIN conversations b ON b.conv_id=a.conv_id AND b.turn=a.turn+2",
    ),
    # whole numbers beyond 2 ** 53, sequences, equal parallel relationships
    "agg_large_integers": (
        "MATCH (o:Orders) WITH o.o_orderstatus AS s, o.o_orderkey + 9007199254740993 AS x, o.o_orderkey AS k RETURN s, avg(k) AS a, CAST(sum(x) AS STRING) AS t, percentileDisc(x, 0.5) AS m, percentileDisc(x, 0.0) AS lo, percentileDisc(x, 1.0) AS hi, count(DISTINCT x) AS n",
        "SELECT o_orderstatus AS s, avg(o_orderkey) AS a, sum(o_orderkey+9007199254740993)::VARCHAR AS t, percentile_disc(0.5) WITHIN GROUP (ORDER BY o_orderkey+9007199254740993) AS m, min(o_orderkey)+9007199254740993 AS lo, max(o_orderkey)+9007199254740993 AS hi, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1",
    ),
    "sequence_cycle": (
        "CREATE SEQUENCE round3 MAXVALUE 3 CYCLE; MATCH (n:Nation) WITH n.n_nationkey AS k, nextval('round3') AS v RETURN v, count(*) AS n",
        "SELECT v, count(*) AS n FROM (SELECT (row_number() OVER () - 1) % 3 + 1 AS v FROM nation) GROUP BY 1",
    ),
    "sequence_currval": ("CREATE SEQUENCE s1 START 10 INCREMENT -3 MINVALUE -100 MAXVALUE 20; RETURN nextval('s1') AS a; RETURN nextval('s1') AS a; RETURN currval('s1') AS a", "SELECT 7::BIGINT AS a"),
    "parallel_relationships": (
        "CREATE REL TABLE SEEN(FROM Region TO Region, w INT64); MATCH (a:Region), (b:Region) WHERE a.r_regionkey + 1 = b.r_regionkey UNWIND [5, 5] AS w CREATE (a)-[:SEEN {w: w}]->(b); MATCH (a:Region)-[e:SEEN* TRAIL 1..4]-(b:Region) RETURN length(e) AS l, count(*) AS n",
        "WITH RECURSIVE s AS (SELECT a.r_regionkey AS a, b.r_regionkey AS b, a.r_regionkey * 2 + i AS e FROM region a JOIN region b ON a.r_regionkey + 1 = b.r_regionkey, (SELECT unnest([0, 1]) AS i)), u AS (SELECT * FROM s UNION ALL SELECT b, a, e FROM s), w AS (SELECT a, b, 1 AS l, [e] AS p FROM u UNION ALL SELECT w.a, u.b, l + 1, list_append(p, u.e) FROM w JOIN u ON u.a = w.b WHERE l < 4 AND NOT list_contains(p, u.e)) SELECT l::BIGINT AS l, count(*) AS n FROM w GROUP BY 1",
    ),
    # clauses
    "return_star": ("MATCH (c:Customer) WITH c.c_custkey AS k, c.c_name AS n RETURN *", "SELECT c_custkey AS k, c_name AS n FROM customer"),
    "with_star": ("MATCH (c:Customer) WITH c.c_custkey AS k, c.c_acctbal AS b WITH *, b > 0 AS p WHERE p RETURN k, b", "SELECT c_custkey AS k, c_acctbal AS b FROM customer WHERE c_acctbal>0"),
    "index_join": ("MATCH (o:Orders) MATCH (c:Customer) WHERE c.c_custkey = o.o_custkey RETURN c.c_mktsegment AS s, count(*) AS n", "SELECT c_mktsegment AS s, count(*) AS n FROM orders JOIN customer ON c_custkey=o_custkey GROUP BY 1"),
    "join_hint": ("MATCH (c:Customer)-[e:PLACED]->(o:Orders) HINT (c JOIN e) JOIN o RETURN o.o_orderstatus AS s, count(*) AS n", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1"),
    "unwind_struct": ("MATCH (n:Nation) WITH n.n_regionkey AS r, collect({k: n.n_nationkey, s: n.n_name}) AS l UNWIND l AS x RETURN r, x.k AS k, x.s AS s", "SELECT n_regionkey AS r, n_nationkey AS k, n_name AS s FROM nation"),
    "count_aggregates": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) RETURN c.c_nationkey AS n, count(o.o_orderkey) AS a, count(DISTINCT o.o_orderstatus) AS b, sum(DISTINCT c.c_nationkey) + 0.5 AS s, avg(DISTINCT o.o_orderkey % 5) AS v, size(collect(DISTINCT o.o_orderpriority)) AS p", "SELECT c_nationkey AS n, count(o_orderkey) AS a, count(DISTINCT o_orderstatus) AS b, c_nationkey + 0.5::DOUBLE AS s, avg(DISTINCT o_orderkey % 5) AS v, count(DISTINCT o_orderpriority) AS p FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1"),
    # definitions and changes
    "ctas_nodes": ("CREATE NODE TABLE Rich AS MATCH (c:Customer) WHERE c.c_acctbal > 5000 RETURN c.c_custkey AS id, c.c_acctbal AS b, c.c_mktsegment AS s; MATCH (r:Rich) RETURN r.s AS s, count(*) AS n, min(r.b) AS lo", "SELECT c_mktsegment AS s, count(*) AS n, min(c_acctbal) AS lo FROM customer WHERE c_acctbal>5000 GROUP BY 1"),
    "ctas_relationships": ("CREATE REL TABLE BIG(FROM Customer TO Orders) AS MATCH (c:Customer)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 200000 RETURN c.c_custkey, o.o_orderkey, o.o_totalprice AS p; MATCH (c:Customer)-[b:BIG]->(o:Orders) RETURN c.c_mktsegment AS s, count(*) AS n, max(b.p) AS hi", "SELECT c_mktsegment AS s, count(*) AS n, max(o_totalprice) AS hi FROM customer JOIN orders ON o_custkey=c_custkey WHERE o_totalprice>200000 GROUP BY 1"),
    "alter_columns": ("CREATE NODE TABLE T1 AS MATCH (p:Part) RETURN p.p_partkey AS id, p.p_size AS z, p.p_brand AS b; ALTER TABLE T1 ADD extra INT64 DEFAULT 7; ALTER TABLE T1 DROP b; ALTER TABLE T1 RENAME z TO width; MATCH (t:T1) RETURN t.id AS k, t.width AS w, t.extra AS e", "SELECT p_partkey AS k, p_size AS w, 7::BIGINT AS e FROM part"),
    "alter_table": ("CREATE REL TABLE LINK(FROM Nation TO Region, w INT64); ALTER TABLE LINK ADD FROM Region TO Region; MATCH (n:Nation)-[:IN_REGION]->(r:Region) CREATE (n)-[:LINK {w: 1}]->(r); MATCH (r:Region) CREATE (r)-[:LINK {w: 2}]->(r); ALTER TABLE LINK RENAME TO JOINED; COMMENT ON TABLE JOINED IS 'two pairs'; MATCH (a)-[j:JOINED]->(r:Region) RETURN label(a) AS l, count(*) AS n, CAST(sum(j.w) AS INT64) AS w", "SELECT 'Nation' AS l, count(*) AS n, count(*)::BIGINT AS w FROM nation UNION ALL SELECT 'Region', count(*), 2*count(*) FROM region"),
    "drop_and_make_again": ("CREATE NODE TABLE T2(id INT64 PRIMARY KEY); CREATE (:T2 {id: 1}); DROP TABLE T2; CREATE NODE TABLE IF NOT EXISTS T2(id INT64 PRIMARY KEY, s STRING DEFAULT 'd'); MATCH (r:Region) CREATE (:T2 {id: r.r_regionkey}); DROP TABLE IF EXISTS Ghost; MATCH (t:T2) RETURN t.id AS k, t.s AS s", "SELECT r_regionkey::BIGINT AS k, 'd' AS s FROM region"),
    "user_types": ("CREATE TYPE Money AS DECIMAL(12, 2); CREATE NODE TABLE T3(id INT64 PRIMARY KEY, m Money); MATCH (c:Customer) CREATE (:T3 {id: c.c_custkey, m: c.c_acctbal}); MATCH (t:T3) RETURN t.id AS k, CAST(t.m AS DOUBLE) AS m", "SELECT c_custkey AS k, c_acctbal::DECIMAL(12,2)::DOUBLE AS m FROM customer"),
    "serial_keys": ("CREATE NODE TABLE T4(id SERIAL PRIMARY KEY, n STRING); MATCH (n:Nation) CREATE (:T4 {n: n.n_name}); MATCH (t:T4) RETURN min(t.id) AS lo, max(t.id) AS hi, count(DISTINCT t.n) AS n", "SELECT 0::BIGINT AS lo, count(*)-1 AS hi, count(DISTINCT n_name) AS n FROM nation"),
    "transactions": ("CREATE NODE TABLE T5(id INT64 PRIMARY KEY); BEGIN TRANSACTION; MATCH (n:Nation) CREATE (:T5 {id: n.n_nationkey}); ROLLBACK; BEGIN TRANSACTION; MATCH (r:Region) CREATE (:T5 {id: r.r_regionkey}); COMMIT; CHECKPOINT; BEGIN TRANSACTION READ ONLY; MATCH (t:T5) RETURN count(*) AS n, max(t.id) AS hi", "SELECT count(*) AS n, max(r_regionkey)::BIGINT AS hi FROM region"),
    "merge_on_match": ("CREATE NODE TABLE T6(id INT64 PRIMARY KEY, n INT64, s STRING); UNWIND [0, 2, 4] AS i CREATE (:T6 {id: i, n: 1}); MATCH (r:Region) MERGE (t:T6 {id: r.r_regionkey}) ON MATCH SET t.n = 10, t.s = 'old' ON CREATE SET t.s = 'new'; MATCH (t:T6) RETURN t.id AS k, t.n AS n, t.s AS s", "SELECT r_regionkey::BIGINT AS k, CASE WHEN r_regionkey IN (0,2,4) THEN 10::BIGINT END AS n, CASE WHEN r_regionkey IN (0,2,4) THEN 'old' ELSE 'new' END AS s FROM region"),
    "merge_relationships": ("CREATE REL TABLE ONCE(FROM Nation TO Region, n INT64); MATCH (n:Nation)-[:IN_REGION]->(r:Region) MERGE (n)-[o:ONCE]->(r) ON CREATE SET o.n = 1; MATCH (n:Nation)-[:IN_REGION]->(r:Region) MERGE (n)-[o:ONCE]->(r) ON MATCH SET o.n = 2; MATCH (:Nation)-[o:ONCE]->(r:Region) RETURN r.r_name AS r, count(*) AS c, CAST(sum(o.n) AS INT64) AS n", "SELECT r_name AS r, count(*) AS c, (2*count(*))::BIGINT AS n FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY 1"),
    "set_and_delete": ("CREATE NODE TABLE T7 AS MATCH (n:Nation) RETURN n.n_nationkey AS id, n.n_name AS s, n.n_regionkey AS r; MATCH (t:T7) WHERE t.r = 1 SET t.s = lower(t.s), t.r = t.r + 10; MATCH (t:T7) WHERE t.id % 5 = 0 SET t += {s: 'x'}; MATCH (t:T7 {r: 2}) DELETE t; MATCH (t:T7) RETURN t.id AS k, t.s AS s, t.r AS r", "SELECT n_nationkey AS k, CASE WHEN n_nationkey%5=0 THEN 'x' WHEN n_regionkey=1 THEN lower(n_name) ELSE n_name END AS s, CASE WHEN n_regionkey=1 THEN 11 ELSE n_regionkey END AS r FROM nation WHERE n_regionkey<>2"),
    "delete_relationships": ("CREATE REL TABLE TMP(FROM Nation TO Region, w INT64); MATCH (n:Nation)-[:IN_REGION]->(r:Region) CREATE (n)-[:TMP {w: n.n_nationkey}]->(r); MATCH (:Nation)-[t:TMP]->(:Region) WHERE t.w < 10 DELETE t; MATCH (:Nation)-[t:TMP]->(r:Region) RETURN r.r_name AS r, count(*) AS n", "SELECT r_name AS r, count(*) AS n FROM nation JOIN region ON n_regionkey=r_regionkey WHERE n_nationkey>=10 GROUP BY 1"),
    "settings": ("CALL var_length_extend_max_depth = 2; MATCH (a:Turn)-[e:REPLIES*]->(b:Turn) RETURN length(e) AS l, count(*) AS n", "SELECT 1::BIGINT AS l, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn=a.turn+1 UNION ALL SELECT 2, count(*) FROM conversations a JOIN conversations m ON a.conv_id=m.conv_id AND m.turn=a.turn+1 JOIN conversations b ON a.conv_id=b.conv_id AND b.turn=a.turn+2"),
    "named_graphs": ("CREATE GRAPH other; USE GRAPH other; CREATE NODE TABLE X(id INT64 PRIMARY KEY); UNWIND range(1, 4) AS i CREATE (:X {id: i}); USE GRAPH main; MATCH (r:Region) RETURN count(*) AS n", "SELECT count(*) AS n FROM region"),
    # introspection
    "table_info": ("CALL table_info('Region') RETURN name, type", "SELECT * FROM (VALUES ('r_regionkey','INT32'),('r_name','STRING')) t(name, type)"),
    "show_sequences": ("CREATE SEQUENCE s2 START 3 INCREMENT 2; CALL show_sequences() RETURN name, increment AS i, cycle AS c", "SELECT 's2' AS name, 2::BIGINT AS i, false AS c"),
    "show_macros": ("CREATE MACRO plus1(x) AS x + 1; CALL show_macros() RETURN name", "SELECT 'plus1' AS name"),
    "show_connection": ("CALL show_connection('IN_NATION') RETURN *", 'SELECT * FROM (VALUES (\'Customer\',\'Nation\',\'c_custkey\',\'n_nationkey\'),(\'Supplier\',\'Nation\',\'s_suppkey\',\'n_nationkey\')) t("source table name","destination table name","source table primary key","destination table primary key")'),
    "show_indexes": ("CREATE NODE TABLE T8(id INT64 PRIMARY KEY); CREATE INDEX by_id FOR (t:T8) ON (t.id); CALL show_indexes() RETURN table_name, index_name", "SELECT 'T8' AS table_name, 'by_id' AS index_name"),
    "stats_info": ("CALL stats_info('Customer') RETURN cardinality AS n", "SELECT count(*) AS n FROM customer"),
    "current_setting": ("CALL warning_limit = 5; CALL current_setting('warning_limit') RETURN *", "SELECT '5' AS warning_limit"),
    # shapes of the published workload: a long path, cycles, stars, fan-outs, optional and absent branches
    "shape_path": (
        "MATCH (:Region)<-[:IN_REGION]-(:Nation)<-[:IN_NATION]-(:Customer)-[:PLACED]->(:Orders)-[:CONTAINS]->(:Part)<-[:SUPPLIED]-(:Supplier)-[:IN_NATION]->(:Nation)-[:IN_REGION]->(:Region)<-[:IN_REGION]-(:Nation) RETURN count(*) AS n",
        "SELECT CAST(sum(k) AS BIGINT) AS n FROM lineitem JOIN (SELECT pk, sum(m) AS k FROM (SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem) JOIN supplier ON s_suppkey=sk JOIN nation ON n_nationkey=s_nationkey JOIN (SELECT n_regionkey AS r, count(*) AS m FROM nation GROUP BY 1) ON r=n_regionkey GROUP BY 1) ON pk=l_partkey",
    ),
    "shape_two_paths": ("MATCH (c:Customer)-[:PLACED]->(o:Orders)-[:CONTAINS]->(p:Part), (c)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s:Supplier)-[:SUPPLIED]->(p) RETURN count(*) AS n", "SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey AS sk, l_partkey AS pk FROM lineitem) JOIN supplier ON s_suppkey=sk JOIN lineitem l ON l.l_partkey=pk JOIN orders ON o_orderkey=l.l_orderkey JOIN customer ON c_custkey=o_custkey WHERE c_nationkey=s_nationkey"),
    "shape_ring": ("MATCH (a:Supplier)-[:SUPPLIED]->(p:Part)<-[:SUPPLIED]-(b:Supplier)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(a) RETURN count(*) AS n", "WITH x AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p, s_nationkey AS n FROM lineitem JOIN supplier ON s_suppkey=l_suppkey) SELECT count(*) AS n FROM x JOIN x y ON x.p=y.p AND x.n=y.n"),
    "shape_star": ("MATCH (n:Nation)<-[:IN_NATION]-(x:Customer:Supplier), (n)-[:IN_REGION]->(:Region), (n)<-[:IN_NATION]-(:Supplier) RETURN count(*) AS n", "SELECT CAST(sum((c+s)*s) AS BIGINT) AS n FROM (SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey=n_nationkey) AS c, (SELECT count(*) FROM supplier WHERE s_nationkey=n_nationkey) AS s FROM nation)"),
    "shape_wide_star": ("MATCH (o:Orders)-[:CONTAINS]->(:Part), (o)-[:CONTAINS]->(:Part), (o)<-[:PLACED]-(:Customer)-[:IN_NATION]->(:Nation) RETURN count(*) AS n", "SELECT CAST(sum(k*k) AS BIGINT) AS n FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey)"),
    "shape_fan_out": ("MATCH (a:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(b:Customer)-[:PLACED]->(o:Orders) RETURN count(*) AS n", "SELECT CAST(sum(m) AS BIGINT) AS n FROM orders JOIN customer ON c_custkey=o_custkey JOIN (SELECT c_nationkey AS k, count(*) AS m FROM customer GROUP BY 1) ON k=c_nationkey"),
    "shape_optional": ("MATCH (o:Orders) OPTIONAL MATCH (o)-[:CONTAINS]->(p:Part) OPTIONAL MATCH (o)<-[:PLACED]-(c:Customer {c_mktsegment: 'BUILDING'}) RETURN count(*) AS n, count(p) AS p, count(c) AS c", "SELECT count(*) AS n, count(l_partkey) AS p, count(c_custkey) AS c FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey LEFT JOIN customer ON c_custkey=o_custkey AND c_mktsegment='BUILDING'"),
    "shape_absent": ("MATCH (s:Supplier)-[:SUPPLIED]->(p:Part) WHERE NOT EXISTS { MATCH (p)<-[:CONTAINS]-(o:Orders) WHERE o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'P' } RETURN count(*) AS n", "SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x WHERE NOT EXISTS (SELECT 1 FROM lineitem y JOIN orders ON o_orderkey=y.l_orderkey WHERE y.l_partkey=x.l_partkey AND o_orderpriority='1-URGENT' AND o_orderstatus='P')"),
    "shape_absent_fan_out": ("MATCH (a:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(b:Customer)-[:PLACED]->(o:Orders) WHERE NOT EXISTS { MATCH (a)-[:PLACED]->(:Orders {o_orderpriority: '1-URGENT'}) } RETURN count(*) AS n", "SELECT CAST(sum(m) AS BIGINT) AS n FROM orders JOIN customer ON c_custkey=o_custkey JOIN (SELECT c_nationkey AS k, count(*) AS m FROM customer x WHERE NOT EXISTS (SELECT 1 FROM orders y WHERE y.o_custkey=x.c_custkey AND o_orderpriority='1-URGENT') GROUP BY 1) ON k=c_nationkey"),
    # paths with weights and cycles, whole-graph algorithms over graphs that grow
    "wshortest_cycles": (_NEAR + "MATCH (a:Nation)-[e:NEAR* WSHORTEST(w) 1..4]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b, cost(e) AS c", f"WITH RECURSIVE {_WAYS} SELECT a, b, c::DOUBLE AS c FROM best"),
    "all_wshortest_cycles": (_NEAR + "MATCH (a:Nation)-[e:NEAR* ALL WSHORTEST(w) 1..4]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b, cost(e) AS c, count(*) AS n", f"WITH RECURSIVE {_WAYS} SELECT a, b, c::DOUBLE AS c, count(*) AS n FROM ways JOIN best USING (a, b, c) GROUP BY 1, 2, 3"),
    "all_shortest_cycles": (_NEAR + "MATCH (a:Nation)-[e:NEAR* ALL SHORTEST 1..4]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b, length(e) AS l, count(*) AS n", f"WITH {_NEAR_SQL} SELECT a, b, 1::BIGINT AS l, count(*) AS n FROM near GROUP BY 1, 2"),
    "algo_scc_cycles": ("CREATE REL TABLE BACK(FROM Turn TO Turn); COPY BACK FROM (MATCH (a:Turn)-[:REPLIES]->(b:Turn) RETURN b.id, a.id); CALL strongly_connected_components(['Turn'], ['REPLIES', 'BACK']) YIELD node, component_id RETURN node.conv_id AS c, component_id AS i, count(*) AS n", "SELECT conv_id AS c, dense_rank() OVER (ORDER BY conv_id)-1 AS i, count(*) AS n FROM conversations GROUP BY conv_id"),
    "algo_pagerank_supply": ("CALL page_rank(['Supplier', 'Part'], ['SUPPLIED'], tolerance := 0.0) YIELD node, score RETURN CASE WHEN label(node) = 'Part' THEN 'p' ELSE 's' END AS t, coalesce(node.p_partkey, node.s_suppkey) AS k, round(score, 8) AS s", _pagerank_sql()),
    "algo_wcc_supply": ("CALL weakly_connected_components(['Supplier', 'Part'], ['SUPPLIED']) YIELD node, component_id RETURN label(node) AS l, component_id AS i, count(*) AS n", None),
    "algo_kcore_orders": ("CALL k_core_decomposition(['Orders', 'Part'], ['CONTAINS']) YIELD node, core RETURN label(node) AS l, core AS c, count(*) AS n", None),
    "algo_louvain_turns": ("CALL louvain(['Turn'], ['REPLIES']) YIELD node, community_id RETURN node.conv_id AS c, count(DISTINCT community_id) AS k, count(*) AS n", None),
}


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prepared statement with typed parameters."""
    from knotwork.queries import graph

    return graph(spark, sf_dir).prepare("MATCH (c:Customer) WHERE c.c_acctbal > $low AND c.c_mktsegment IN $segments RETURN c.c_custkey AS k, $tag AS t").execute(low=1000.0, segments=["BUILDING", "MACHINERY"], tag="x")


def export_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPORT DATABASE, then IMPORT DATABASE into another graph."""
    from knotwork.queries import graph, local_folder
    from knotwork.session import Session

    folder = local_folder(spark, "export")
    s = Session(spark)
    full = graph(spark, sf_dir)
    for table in ("Region", "Nation"):
        s.catalog.nodes[table] = full.catalog.nodes[table]
    s.catalog.rels["IN_REGION"] = full.catalog.rels["IN_REGION"]
    s.execute(f"CREATE MACRO shown(x) AS lower(x); EXPORT DATABASE '{folder}'")
    other = Session(spark)
    other.execute(f"IMPORT DATABASE '{folder}'")
    return other.execute("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN shown(n.n_name) AS n, r.r_name AS r")


def arrow_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrow tables into node and relationship tables, and a result as Arrow."""
    from knotwork.session import Session

    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").toArrow()
    s = Session(spark)
    s.execute("CREATE NODE TABLE N(id INT64, name STRING, r INT64, PRIMARY KEY(id)); CREATE NODE TABLE R(id INT64, name STRING, PRIMARY KEY(id)); CREATE REL TABLE I(FROM N TO R)")
    nation = read("nation")
    s.import_arrow("N", nation)
    s.import_arrow("R", read("region"))
    s.import_arrow("I", nation.select(["n_nationkey", "n_regionkey"]))
    return spark.createDataFrame(s.execute("MATCH (n:N)-[:I]->(r:R) RETURN r.name AS r, count(*) AS n, min(n.name) AS lo").toArrow())


def npy_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of NPY files into a table."""
    import numpy as np

    from knotwork.queries import local_folder
    from knotwork.session import Session

    folder = local_folder(spark, "npy")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").toPandas()
    for c in nation:
        np.save(f"{folder}/{c}.npy", nation[c].to_numpy(np.int64))
    s = Session(spark)
    s.execute("CREATE NODE TABLE N(id INT64, r INT64, PRIMARY KEY(id))")
    s.execute(f"COPY N FROM ['{folder}/n_nationkey.npy', '{folder}/n_regionkey.npy'] BY COLUMN")
    return s.execute("MATCH (n:N) RETURN n.r AS r, count(*) AS n, max(n.id) AS hi")


def csv_skipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file with a note above its header and a row that doesn't fit: read with SKIP, HEADER and IGNORE_ERRORS, and warned of."""
    from knotwork.queries import graph, local_folder

    s = graph(spark, sf_dir)
    path = f"{local_folder(spark, 'csv')}/nation.csv"
    with open(path, "w") as f:
        f.write("a note\nkey,name\n")
        for r in s.execute("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS n ORDER BY k").collect():
            f.write(f"{r['k']},{r['n']}\nbad,{r['n']}\n")
    s.execute("CREATE NODE TABLE N3(id INT64, name STRING, PRIMARY KEY(id))")
    s.execute(f"COPY N3 FROM '{path}' (HEADER=true, SKIP=1, IGNORE_ERRORS=true)")
    return s.execute("MATCH (n:N3) RETURN n.id AS k, n.name AS s UNION ALL CALL show_warnings() RETURN line_number AS k, skipped_line_or_record AS s")


FAMILY_OTHERS = {
    "parameters": (parameters, "SELECT c_custkey AS k, 'x' AS t FROM customer WHERE c_acctbal>1000 AND c_mktsegment IN ('BUILDING','MACHINERY')"),
    "export_import": (export_import, "SELECT lower(n_name) AS n, r_name AS r FROM nation JOIN region ON n_regionkey=r_regionkey"),
    "arrow_import": (arrow_import, "SELECT r_name AS r, count(*) AS n, min(n_name) AS lo FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY 1"),
    "npy_load": (npy_load, "SELECT n_regionkey::BIGINT AS r, count(*) AS n, max(n_nationkey)::BIGINT AS hi FROM nation GROUP BY 1"),
    "csv_skipped_rows": (csv_skipped_rows, "SELECT n_nationkey::BIGINT AS k, n_name AS s FROM nation UNION ALL SELECT 2*(row_number() OVER (ORDER BY n_nationkey))+2, 'bad,'||n_name FROM nation"),
}
