"""Expressions and statements against expected values."""

import datetime
import decimal

import pytest

from knotwork.errors import BinderError, CatalogError, ParserError, RuntimeFault, TransactionError
from knotwork.plans.parser import parse
from knotwork.session import Session

D = datetime.date
CASES = [
    ("7/2, -7/2, 7.0/2, 1.0/0, -1.0/0, 7%3, 2^3^2", (3, -3, 3.5, float("inf"), float("-inf"), 1, 64.0)),
    ("'a'+'b', [1,2]+[3], date('2020-01-31') + interval('1 month'), date('2020-03-01') - date('2020-02-01')", ("ab", [1, 2, 3], D(2020, 2, 29), 29)),
    ("cast(interval('1 year 2 months 3 days 04:05:06.5') AS STRING), cast(interval('0 days') AS STRING)", ("1 year 2 months 3 days 04:05:06.5", "00:00:00")),
    ("abs(-3), ceil(2.1), floor(-2.1), round(2.5), round(1234.567, 2), even(3.2), factorial(5), sign(-2.5), ln(0), log(100), log2(8)", (3, 3.0, -3.0, 3.0, 1234.57, 4.0, 120, -1, float("-inf"), 2.0, 3.0)),
    ("greatest(1, NULL, 3), greatest(1, 2.5), least(3, 2), coalesce(NULL, 2), nullif(1,1), ifnull(NULL, 'x'), count_if(true)", (None, 2.5, 2, 2, None, "x", 1)),
    ("typeof(1), typeof('a'), typeof([1]), typeof({a: 1}), typeof(array_value(1,2))", ("INT64", "STRING", "INT64[]", "STRUCT(a INT64)", "INT64[2]")),
    ("concat('a', NULL, 'b'), concat_ws('-', 'a', 'b', NULL, 'c'), contains('abc', ''), initcap('hELLO world'), left('abc', -1), right('abc', -1)", ("ab", "a-bc", False, "Hello world", "ab", "bc")),
    ("lpad('a', 3, 'x'), substring('hello', 0, 2), substring('hello', 2, 3), upper('ß'), split_part('a-b', '-', 5), string_split('a  b', ' ')", ("xxa", "", "ell", "ẞ", "", ["a", "b"])),
    ("regexp_replace('aaa', 'a', 'b'), regexp_replace('aaa', 'a', 'b', 'g'), regexp_matches('abc', '['), regexp_extract('foobar', 'o+'), 'abc' =~ 'a.*', 'xabc' =~ 'a.*'", ("baa", "bbb", False, "oo", True, False)),
    ("[1,2,3][1], [1,2,3][-1], 'hello'[2], [1,2,3,4][2:3], 'hello'[2:3], [1,2,3][2:], size('héllo')", (1, 3, "e", [2, 3], "el", [2, 3], 5)),
    ("list_sort([3,1,NULL,2]), list_sort([3,1,2], 'DESC'), list_sort([3,NULL,1], 'ASC', 'NULLS LAST'), list_distinct([1,1,NULL,2]), list_any_value([NULL, 3])", ([None, 1, 2, 3], [3, 2, 1], [1, 3, None], [1, 2], 3)),
    ("range(1,3), range(5,1), range(5,1,-2), list_contains([1,NULL], 2), 3 IN [1,2,3], NOT 3 IN [1], list_position([1,2],3)", ([1, 2, 3], [], [5, 3, 1], False, True, True, 0)),
    ("list_transform([1,2], x -> x * 10), list_reduce([1,2,3], (x, y) -> x + y), [x IN [1,2,3] WHERE x > 1 | x * 2], [x IN [1,2] | [y IN [x, x+1] WHERE y > 1 | y * 10]]", ([10, 20], 6, [4, 6], [[20], [20, 30]])),
    ("any(x IN [1,2] WHERE x = 2), all(x IN [1,2] WHERE x > 1), none(x IN [1] WHERE x = 2), single(x IN [1,2] WHERE x = 1)", (True, False, True, True)),
    ("{a: 1, b: 'x'}.a, map_extract(map([1,1],['a','b']), 1), element_at(map([1],['a']), 5), map_keys(map(['k'],[1])), union_tag(union_value(a := 1))", (1, ["a", "b"], [], ["k"], "a")),
    ("date_part('year', date('2020-05-06')), date_part('week', date('2020-05-06')), date_trunc('month', date('2020-05-06')), dayname(date('2020-05-06')), century(date('2001-01-01'))", (2020, 0, D(2020, 5, 1), "Wednesday", 21)),
    ("cast(3.5 AS INT64), cast(2.5 AS INT64), cast(true AS STRING), cast(1.5 AS STRING), cast([1,2] AS STRING), cast({a: 1, b: 'x'} AS STRING), cast('[1,2]' AS INT64[])", (4, 2, "True", "1.500000", "[1,2]", "{a: 1, b: x}", [1, 2])),
    ("CASE 1 WHEN 1 THEN 5 WHEN 2 THEN 9.9 END, CASE NULL WHEN NULL THEN 'n' ELSE 'm' END, CASE WHEN false THEN 1 END, 1 = 1.0, true XOR true, 3 IS NULL", (5.0, "n", None, True, False, False)),
    ("5!, 1 << 3, 6 & 3, 6 | 1, 10 - 2 - 3, 2 + 3 * 4, NOT true OR true, -(-3)", (120, 8, 2, 7, 5, 14, True, 3)),
    ("array_distance([1.0,2.0],[4.0,6.0]), array_cross_product([1.0,0.0,0.0],[0.0,1.0,0.0]), hash(NULL)", (5.0, [0.0, 0.0, 1.0], decimal.Decimal(2**64 - 1))),
    ("[3,4] > [3,NULL], [3,4] < [3,NULL], [1,2] < [1,3], interval('2 days') < interval('1 month')", (False, True, True, True)),
    ("sum(1), count(*), avg(2), min('a'), collect(1)", (decimal.Decimal(1), 1, 2.0, "a", [1])),
    ("union_extract(cast('7', 'UNION(n INT64, s STRING)'), 's'), union_tag(cast('-5', 'UNION(u UINT8, i INT64)'))", ("7", "i")),
]


@pytest.fixture
def s(spark):
    return Session(spark)


@pytest.mark.parametrize("text,want", CASES)
def test_values(s, text, want):
    got = tuple(s.execute(f"RETURN {text}").first())
    assert [list(x) if isinstance(x, list) else x for x in got] == list(want)


@pytest.mark.parametrize("text,kind", [("RETURN 1 = 2 = 3", ParserError), ("MATCH (a) RETURN", ParserError), ("RETURN x", BinderError), ("RETURN foo(1)", CatalogError), ("RETURN cast(true AS INT64)", BinderError), ("RETURN 'a' + 1", BinderError), ("RETURN sum(sum(1))", BinderError), ("WITH 1 + 1 RETURN 2", BinderError), ("UNWIND [1] AS x WITH x AS y, x AS y RETURN y", BinderError), ("RETURN $p", BinderError), ("RETURN 1 AS x UNION ALL RETURN 'a' AS x", BinderError), ("RETURN 1 AS x UNION RETURN 1 AS x UNION ALL RETURN 1 AS x", ParserError), ("RETURN 1 LIMIT -1", RuntimeFault), ("MATCH (a)-[r]->(b) RETURN [(a)-->(b) | 1]", ParserError)])
def test_errors(s, text, kind):
    with pytest.raises(kind) as error:
        s.execute(text).collect()
    assert str(error.value).startswith(f"{kind.category} exception: ")


def test_runtime_errors(s):
    for text in ("RETURN 1/0", "RETURN factorial(21)", "RETURN [1,2][5]", "RETURN cast('+5' AS INT64)", "RETURN to_uint8(300)", "RETURN list_reduce(list_filter([1], x -> x > 1), (a, b) -> a + b)"):
        with pytest.raises(Exception):  # noqa: B017
            s.execute(text).collect()


def test_pipeline(s):
    rows = lambda q, **p: [tuple(r) for r in s.execute(q, **p).collect()]
    assert rows("UNWIND [1,2,NULL] AS x RETURN x ORDER BY x DESC") == [(None,), (2,), (1,)]
    assert rows("UNWIND [1,2,NULL] AS x RETURN x ORDER BY x") == [(1,), (2,), (None,)]
    assert rows("UNWIND [3,1,2] AS x WITH x ORDER BY x LIMIT 2 RETURN collect(x)") == [([1, 2],)]
    assert rows("UNWIND [1,2,2] AS x RETURN DISTINCT x ORDER BY x") == [(1,), (2,)]
    assert rows("UNWIND [1,2,3] AS x WITH x WHERE x > $low RETURN sum(x)", low=1) == [(decimal.Decimal(5),)]
    assert rows("UNWIND range(1, 6) AS x WITH x % 2 AS k, count(*) AS n, sum(x) AS t WHERE t > 9 RETURN k, n") == [(0, 3)]
    assert rows("RETURN 1 AS x UNION ALL RETURN 1 AS x") == [(1,), (1,)]
    assert rows("RETURN 1 AS x UNION RETURN 1 AS x") == [(1,)]
    assert rows("UNWIND [] AS x RETURN x") == []
    assert s.prepare("RETURN $a + $b").parameters == ["a", "b"]
    assert s.prepare("RETURN $a AS x").execute(a=[1, "é"][0]).first()["x"] == 1


def test_catalog_statements(s):
    one = lambda q: s.execute(q).first()[0]
    s.execute("CREATE SEQUENCE q START 5 INCREMENT 2 MAXVALUE 9")
    assert tuple(s.execute("RETURN nextval('q'), currval('q')").first()) == (5, 5)
    assert [one("RETURN nextval('q')") for _ in range(2)] == [7, 9]
    with pytest.raises(RuntimeFault):
        s.execute("RETURN nextval('q')")
    s.execute("CREATE MACRO add(a, b := 3) AS a + b")
    assert tuple(s.execute("RETURN add(2), add(2, b := 10)").first()) == (5, 12)
    s.execute("CREATE TYPE POINT AS STRUCT(x INT64, y INT64)")
    s.execute("CREATE NODE TABLE T(id SERIAL, p POINT, tags STRING[], d DECIMAL(10,2) DEFAULT 1.5, PRIMARY KEY(id))")
    s.execute("CREATE (:T {p: {x: 1, y: 2}, tags: ['a']}); CREATE (:T {p: {x: 3, y: 4}})")
    assert [tuple(r) for r in s.execute("MATCH (t:T) RETURN t.id, t.p.x, t.d ORDER BY t.id").collect()] == [(0, 1, decimal.Decimal("1.50")), (1, 3, decimal.Decimal("1.50"))]
    s.execute("ALTER TABLE T ADD n INT64 DEFAULT 7; ALTER TABLE T RENAME n TO m; ALTER TABLE T RENAME TO T2")
    assert one("MATCH (t:T2) RETURN sum(t.m)") == 14
    s.execute("BEGIN TRANSACTION; MATCH (t:T2) DELETE t")
    assert one("MATCH (t:T2) RETURN count(*)") == 0
    s.execute("ROLLBACK")
    assert one("MATCH (t:T2) RETURN count(*)") == 2
    s.execute("BEGIN TRANSACTION READ ONLY")
    with pytest.raises(TransactionError):
        s.execute("MATCH (t:T2) DELETE t")
    s.execute("COMMIT; COMMENT ON TABLE T2 IS 'hello'")
    assert one("CALL show_tables() WHERE name = 'T2' RETURN comment") == "hello"
    s.execute("CREATE HASH INDEX i FOR (t:T2) ON (t.id)")
    assert one("CALL show_indexes() RETURN index_name") == "i"
    s.execute("CALL threads = 4")
    assert one("CALL current_setting('threads') RETURN *") == "4"
    assert one("CALL show_functions() RETURN count(*)") > 240
    assert "Physical Plan" in one("EXPLAIN MATCH (t:T2) RETURN t.id")
    with pytest.raises(BinderError):
        s.execute("ALTER TABLE T2 DROP id")
    s.execute("CREATE GRAPH other; USE GRAPH other")
    with pytest.raises(BinderError):
        s.execute("MATCH (t:T2) RETURN t")
    s.execute("USE GRAPH main; DROP GRAPH other; DROP TABLE T2")
    with pytest.raises(BinderError):
        s.execute("DROP TABLE T2")
    s.execute("DROP TABLE IF EXISTS T2")


def test_functions_of_the_user(s):
    s.register_function("twice", lambda x: x * 2, ["INT64"], "INT64")
    s.register_function("shown", lambda x: "none" if x is None else str(x), ["INT64"], "STRING", nulls=True)
    assert tuple(s.execute("RETURN twice(4), twice(NULL), shown(NULL)").first()) == (8, None, "none")
    with pytest.raises(CatalogError):
        s.register_function("abs", abs, ["INT64"], "INT64")
    s.unregister_function("twice")
    with pytest.raises(CatalogError):
        s.execute("RETURN twice(4)")


def test_parser_shapes():
    q = parse("MATCH (a:P|Q)-[e:K* TRAIL 1..3]->(b) WHERE NOT (a)-[:K]->(b) HINT a JOIN (e JOIN b) RETURN *")[0]
    assert q.clauses[0].paths[0].parts[0].labels == ["P", "Q"] and q.clauses[0].paths[0].parts[1].mode == "TRAIL"
    assert q.clauses[0].hint is not None
    assert parse("RETURN `odd name`")[0].clauses[0].body.items[0].expr == ("var", "odd name")
    assert parse("RETURN 'it''s'" if False else "RETURN 'it\\'s' // note")[0].clauses[0].body.items[0].expr == ("lit", "it's")
