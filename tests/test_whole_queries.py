"""Queries over whole tables against brute force in Python."""

import os

import pytest

from knotwork import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_words_after_the_80th_character(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert max(map(len, text.values())) > 80
    got = {r["k"]: r for r in Q.queries()["list_lambda"](spark, SF).collect()}
    assert got.keys() == text.keys()
    for k, t in text.items():
        *words, last = t.split(" ")
        words = [*filter(None, words), last]
        assert got[k]["z"] == [len(w) for w in words] and got[k]["f"] == [w for w in words if len(w) > 4]
        assert got[k]["t"] == sum(len(w) for w in words)


def test_every_hundredth_vector_meets_all(spark):
    ids = [r["vec_id"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()]
    got = {r["k"]: r["n"] for r in Q.queries()["vector_similarity"](spark, SF).collect()}
    assert got == {i: len(ids) - 1 for i in ids if i % 100 == 0} and len(got) > 1


def test_vectors_at_the_limits_are_compared_as_doubles(spark, tmp_path):
    """A distance just over 1.3 and a cosine just under 0.1, both on the other side when rounded to FLOAT."""
    rows = [(0, [0.0, 0.0]), (1, [1.0277025699615479, 0.7961328029632568]), (100, [1.0, 0.0]), (102, [0.07235656678676605, 0.7199387550354004])]
    for name in os.listdir(SF):
        os.symlink(f"{SF}/{name}", tmp_path / name)
    os.unlink(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["k"]: r for r in Q.queries()["vector_similarity"](spark, str(tmp_path)).collect()}
    assert (got[0]["n"], got[0]["close"], got[0]["away"]) == (3, 2, 0)
    assert (got[100]["n"], got[100]["near"], got[100]["close"]) == (3, 1, 3)
