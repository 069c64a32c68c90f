"""N-gram Jaccard join against brute force."""

import random

import numpy as np
import pytest

from knotwork.llm import ngram_join
from knotwork.llm.components import components


def shingle_set(t):
    w = (t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    classes = {}
    for k in range(len(rows)):
        classes.setdefault(root(k), []).append(rows[k][0])
    return sorted((rows[k][0], min(classes[root(k)]), len(classes[root(k)]), links[k]) for k in range(len(rows)))


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(500)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    rows = [None, "", " \n ", "one", "one", "two words", "two  words", "a b c d e"]
    base = say(200)
    for _ in range(40):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append(" ".join(w))
    rows += [" ".join(base), "\n".join(base)]
    for _ in range(15):
        w = say(r.randint(3, 300))
        rows.append(" ".join(w))
        for _ in range(r.randint(0, 3)):
            v = list(w)
            v[r.randrange(len(v))] = r.choice(words)
            rows.append(" ".join(v))
    return list(enumerate(rows))


@pytest.mark.parametrize("chunk", [256, 5])
def test_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rows = corpus(chunk)
    docs = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, sig binary").repartition(3)
    got = sorted(tuple(x) for x in ngram_join.join(docs).select("doc_id", "class_id", "class_size", "n_links").collect())
    assert got == brute(rows)


def test_keep_one(spark):
    rows = [*corpus(7), (3, "one"), (3, "one")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, id string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(r["doc_id"] for r in kept.collect())
    empty = [i for i, t in rows if not shingle_set(t)]
    assert got == sorted({c for _, c, _, _ in brute(rows)} | set(empty))


def test_empty_table(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, k) for k in range(6000, 6200)]
    parent = {}

    def root(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {v: root(v) for a, b in edges if a != b for v in (a, b)}
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def test_posterior_table():
    assert ngram_join.needed()[-1] <= np.ceil(0.8 * ngram_join.HASHES)
    assert all(a <= b for a, b in zip(ngram_join.needed(), ngram_join.needed()[1:], strict=False))
