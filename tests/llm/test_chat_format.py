"""Chat formatting: chunked Viterbi against brute force, markers, held-out accuracy."""

import itertools
import random

import numpy as np
import pytest

from knotwork.llm import chat_format as c


def test_segments():
    t = "User: hi there\nAssistant: hello\nhow are you?\nQ: fine\n<|system|>\nbe kind\n[bot] ok\nNote: no marker"
    assert [m for m, _ in c.segments(t)] == [2, 3, 2, 1, 3]
    assert [x.strip() for _, x in c.segments(t)] == ["hi there", "hello\nhow are you?", "fine", "be kind", "ok\nNote: no marker"]
    assert c.segments(None) == [(0, "")]
    assert c.segments("plain") == [(0, "plain")]
    assert c.rendered("user", " a <|end|> ") == "<|user|>\na < |end|>\n<|end|>\n"


def test_viterbi_is_exact():
    r = np.random.default_rng(1)
    model = {"start": np.log(r.dirichlet([1] * 3)), "step": np.log(r.dirichlet([1] * 3, 3))}
    for _ in range(30):
        e = np.log(r.random((6, 3)))
        score = lambda s: model["start"][s[0]] + e[0][s[0]] + sum(model["step"][a, b] + e[k][b] for k, (a, b) in enumerate(zip(s, s[1:], strict=False), 1))  # noqa: E731, B023
        best = max(itertools.product(range(3), repeat=6), key=score)
        assert tuple(c.decode(model, e, -1, -1)) == best
        m = c.chunk_matrix(model, e[:3], True)[0][:, None] + c.chunk_matrix(model, e[3:], False)
        assert np.isclose(m.max(), score(best))


def talk(seed, conversations=120, long=90):
    r = random.Random(seed)
    rows = []
    for conv in range(conversations):
        n = long if conv == 0 else r.randint(1, 8)
        who = ["system"] if r.random() < 0.3 else []
        who += ["user" if k % 2 == 0 else "assistant" for k in range(n)]
        for turn, role in enumerate(who):
            words = {"system": 12, "user": 25, "assistant": 160}[role]
            rows.append((conv, turn, role, "w " * r.randint(words // 2, words) + ("?" if role == "user" and r.random() < 0.5 else ".")))
    return rows


@pytest.mark.parametrize("chunk", [4096, 3])
def test_held_out_roles(spark, monkeypatch, chunk):
    monkeypatch.setattr(c, "CHUNK", chunk)
    rows = talk(5)
    table = spark.createDataFrame([(*x, "z") for x in rows], "conv_id long, turn long, role string, text string, segment string").repartition(3)
    got = c.recover(table).collect()
    assert len(got) == len(rows)
    assert np.mean([x["role"] == x["given"] for x in got]) > 0.97
    if chunk == 3:
        monkeypatch.setattr(c, "CHUNK", 4096)
        whole = {(x["conv_id"], x["turn"]): x["role"] for x in c.recover(table).collect()}
        assert {(x["conv_id"], x["turn"]): x["role"] for x in got} == whole


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "tool", ""), (1, 1, "user", "x"), (1, 1, "user", "x"), (2, None, None, "User: a\nAssistant: b")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = c.recover(table).collect()
    assert len(got) == 6
    assert [x["role"] for x in sorted((x for x in got if x["conv_id"] == 2), key=lambda x: x["segment"])] == ["user", "assistant"]
    assert c.recover(table.limit(0)).count() == 0
