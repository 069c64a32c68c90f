"""Loading, copying, exporting and streaming."""

import datetime

import numpy as np
import pyarrow as pa
import pytest

from knotwork.errors import BinderError, RuntimeFault
from knotwork.session import Session
from knotwork.streaming import stream_into


@pytest.fixture
def s(spark):
    return Session(spark)


def rows(s, q, **p):
    return [tuple(r) for r in s.execute(q, **p).collect()]


def test_csv_is_sniffed(s, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('id|name|when|ok|tags\n1|"a|b"|2020-01-02|true|[1,2]\n2||2021-03-04|false|[3]\n')
    df = s.execute(f"LOAD FROM '{f}' RETURN *")
    assert df.columns == ["id", "name", "when", "ok", "tags"]
    assert [tuple(r) for r in df.collect()] == [(1, "a|b", datetime.date(2020, 1, 2), True, [1, 2]), (2, None, datetime.date(2021, 3, 4), False, [3])]
    assert rows(s, f"LOAD WITH HEADERS (a INT64, b STRING, c STRING, d BOOL, e STRING) FROM '{f}' (HEADER=true, DELIM='|') WHERE a > 1 RETURN a, d") == [(2, False)]
    with pytest.raises(BinderError):
        s.execute(f"LOAD FROM '{f}' (NOPE=1) RETURN *")
    with pytest.raises(BinderError):
        s.execute(f"LOAD FROM '{tmp_path}/missing.csv' RETURN *")


def test_copy_nodes_and_relationships(s, tmp_path):
    (tmp_path / "p.csv").write_text("1,ann\n2,bob\n3,\n")
    (tmp_path / "k.csv").write_text("1,2,7\n2,3,8\n")
    s.execute("CREATE NODE TABLE P(id INT64, name STRING, PRIMARY KEY(id)); CREATE REL TABLE K(FROM P TO P, w INT64)")
    s.execute(f"COPY P FROM '{tmp_path}/p.csv'; COPY K FROM '{tmp_path}/k.csv'")
    assert rows(s, "MATCH (a:P)-[k:K]->(b:P) RETURN a.name, k.w, b.name ORDER BY k.w") == [("ann", 7, "bob"), ("bob", 8, None)]
    with pytest.raises(RuntimeFault):
        s.execute(f"COPY P FROM '{tmp_path}/p.csv'")
    s.execute(f"COPY P FROM '{tmp_path}/p.csv' (IGNORE_ERRORS=true)")
    (tmp_path / "bad.csv").write_text("1,99,7\n")
    with pytest.raises(RuntimeFault):
        s.execute(f"COPY K FROM '{tmp_path}/bad.csv'")
    s.execute(f"COPY K FROM '{tmp_path}/bad.csv' (IGNORE_ERRORS=true)")
    assert rows(s, "MATCH ()-[k:K]->() RETURN count(*)") == [(2,)]
    s.execute("COPY P FROM (UNWIND range(10, 12) AS i RETURN i, to_string(i))")
    assert rows(s, "MATCH (p:P) RETURN count(*)") == [(6,)]


def test_parquet_npy_arrow_and_export(s, tmp_path):
    s.execute("CREATE NODE TABLE P(id INT64, name STRING, PRIMARY KEY(id)); CREATE REL TABLE K(FROM P TO P, w DOUBLE)")
    s.import_arrow("P", pa.table({"id": [1, 2], "name": ["a", "b"]}))
    s.import_arrow("K", pa.table({"from": [1], "to": [2], "w": [0.5]}))
    s.execute(f"COPY (MATCH (p:P) RETURN p.id AS id, p.name AS name) TO '{tmp_path}/p.parquet' (COMPRESSION='zstd')")
    assert sorted(rows(s, f"LOAD FROM '{tmp_path}/p.parquet' RETURN id, name")) == [(1, "a"), (2, "b")]
    s.execute(f"COPY (MATCH (p:P) RETURN p.id AS id, p.name AS name) TO '{tmp_path}/p.csv' (HEADER=true)")
    assert sorted(rows(s, f"LOAD FROM '{tmp_path}/p.csv' (HEADER=true) RETURN id, name")) == [(1, "a"), (2, "b")]
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float64).reshape(3, 2))
    assert sorted(rows(s, f"LOAD FROM '{tmp_path}/v.npy' RETURN column0")) == [([0.0, 1.0],), ([2.0, 3.0],), ([4.0, 5.0],)]
    s.execute(f"CREATE MACRO inc(x) AS x + 1; EXPORT DATABASE '{tmp_path}/db'; CREATE GRAPH copy; USE GRAPH copy; IMPORT DATABASE '{tmp_path}/db'")
    assert rows(s, "MATCH (a:P)-[k:K]->(b:P) RETURN a.name, k.w, b.name, inc(a.id)") == [("a", 0.5, "b", 2)]
    assert s.execute("MATCH (p:P) RETURN p.id AS id").toArrow().num_rows == 2


def test_skipped_lines_and_warnings(s, tmp_path):
    for k in range(2):  # each file has its own lines to skip
        (tmp_path / f"d{k}.csv").write_text(f"note {k}\nkey,word\n{k},ab\nx{k},cd\n\n{k + 5},ef,gh\n{k + 7},ij\n")
    s.execute("CREATE NODE TABLE W(key INT64, word STRING, PRIMARY KEY(key))")
    s.execute(f"COPY W FROM '{tmp_path}/d*.csv' (HEADER=true, SKIP=1, IGNORE_ERRORS=true)")
    assert sorted(rows(s, "MATCH (w:W) RETURN w.key, w.word")) == [(0, "ab"), (1, "ab"), (7, "ij"), (8, "ij")]
    got = rows(s, "CALL show_warnings() RETURN file_path, line_number, skipped_line_or_record ORDER BY file_path, line_number")
    assert got == [(f"{tmp_path}/d{k}.csv", n, x) for k in range(2) for n, x in ((4, f"x{k},cd"), (6, f"{k + 5},ef,gh"))]
    s.execute(f"CALL clear_warnings(); CALL warning_limit = 1; LOAD WITH HEADERS (key INT64, word STRING) FROM '{tmp_path}/d0.csv' (HEADER=true, SKIP=1, IGNORE_ERRORS=true, PARALLEL=false) RETURN *")
    assert [r[1:] for r in rows(s, "CALL show_warnings() RETURN query_id, line_number, skipped_line_or_record")] == [(4, "x0,cd")]


def test_any_graph(s):
    s.execute("CREATE GRAPH free ANY; USE GRAPH free")
    s.execute("CREATE (:A {x: 5, n: 'q'})-[:R {w: 3}]->(:B {x: 7}); CREATE (:A {x: 9})")
    assert rows(s, "MATCH (n:A) RETURN n.x AS x, n.label ORDER BY x") == [("5", ["A"]), ("9", ["A"])]
    assert rows(s, "MATCH (a:A)-[e:R]->(b:B) RETURN a.x, e.w, b.x") == [("5", "3", "7")]
    assert rows(s, "MATCH (a:A)-[e:S]->(b:B) RETURN count(*)") == [(0,)]
    assert rows(s, "MATCH (n:A:B) RETURN count(*)") == [(3,)]


def test_streaming(spark, s, tmp_path):
    s.execute("CREATE NODE TABLE P(id INT64, name STRING, PRIMARY KEY(id))")
    for k in range(2):
        spark.createDataFrame([(k * 2, "a"), (k * 2 + 1, "b")], "id long, name string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, name string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream_into(s, stream, "P", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert rows(s, "MATCH (p:P) RETURN count(*), min(p.id), max(p.id)") == [(4, 0, 3)]


def test_external_tables(spark, s, tmp_path):
    put = lambda name, cols: __import__("pyarrow.parquet").parquet.write_table(pa.table(cols), f"{tmp_path}/{name}.parquet")
    put("nodes_p", {"id": pa.array([10, 20, 30], pa.int64()), "name": ["a", "b", "c"]})
    put("indices_k", {"target": pa.array([1, 2, 2], pa.int64()), "w": pa.array([5, 6, 7], pa.int64())})
    put("indptr_k", {"offset": pa.array([0, 2, 3, 3], pa.int64())})
    put("flat", {"s": pa.array([2], pa.int64()), "t": pa.array([0], pa.int64())})
    s.execute(f"CREATE NODE TABLE P(id INT64, name STRING, PRIMARY KEY(id)) WITH (storage='{tmp_path}', format='csr')")
    s.execute(f"CREATE REL TABLE K(FROM P TO P, w INT64) WITH (storage='{tmp_path}', format='csr')")
    s.execute(f"CREATE REL TABLE F(FROM P TO P) WITH (storage='{tmp_path}/flat.parquet', format='csr')")
    assert rows(s, "MATCH (a:P)-[k:K]->(b:P) RETURN a.id, k.w, b.name ORDER BY k.w") == [(10, 5, "b"), (10, 6, "c"), (20, 7, "c")]
    assert rows(s, "MATCH (a:P)-[:F]->(b:P) RETURN a.name, b.name") == [("c", "a")]
    with pytest.raises(RuntimeFault):
        s.execute("CREATE (:P {id: 1})")
    with pytest.raises(RuntimeFault):
        s.execute(f"CREATE NODE TABLE Q(id STRING, PRIMARY KEY(id)) WITH (storage='{tmp_path}', format='csr')")
    put("indptr_k", {"offset": pa.array([0, 2, 1, 3], pa.int64())})
    with pytest.raises(RuntimeFault):
        s.execute(f"DROP TABLE K; CREATE REL TABLE K(FROM P TO P, w INT64) WITH (storage='{tmp_path}', format='csr')")


def test_rendering(s):
    from knotwork.sources.render import render

    s.execute("CREATE NODE TABLE P(id INT64, d DOUBLE, PRIMARY KEY(id)); CREATE REL TABLE K(FROM P TO P); CREATE (:P {id: 1, d: 0.5})-[:K]->(:P {id: 2})")
    df = s.execute("MATCH (a:P)-[k:K]->(b:P) RETURN a, k, b.d AS d, true AS t, [1, NULL] AS l, map(['x'], [1]) AS m, {q: 'z'} AS s")
    assert render(df, "tsv").splitlines()[1] == "{_ID: 0:1, _LABEL: P, id: 1, d: 0.500000}\t(0:1)-{_ID: 1:0, _LABEL: K}->(0:2)\t\tTrue\t[1,]\t{x=1}\t{q: z}"
    assert render(s.execute("RETURN 1 AS a, 'x' AS b"), "markdown") == "| a | b |\n|---|---|\n| 1 | x |"
    assert render(s.execute("RETURN 1 AS a"), "json") == '[{"a": 1}]'
    assert render(s.execute("RETURN 1 AS a"), "line") == "a = 1"


def test_interrupt(s):
    import threading
    import time

    s.register_function("slow", lambda x: time.sleep(0.2) or x, ["INT64"], "INT64")
    threading.Timer(3, s.interrupt).start()
    began = time.time()
    with pytest.raises(Exception):  # noqa: B017
        s.execute("UNWIND range(1, 2000) AS x RETURN sum(slow(x))").collect()
    assert time.time() - began < 60
