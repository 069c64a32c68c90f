"""Suffix-array dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from knotwork.llm import suffix_arrays, suffix_dedup


def brute(texts):
    seen = {}
    for d, t in enumerate(texts):
        raw = (t or "").encode()
        for i in range(len(raw) - 199):
            seen.setdefault(raw[i : i + 200], []).append((d, i))
    marks = [bytearray(len((t or "").encode())) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                marks[d][i : i + 200] = b"\1" * 200
    out = []
    for t, m in zip(texts, marks, strict=True):
        raw = (t or "").encode()
        kept = bytes(c for c, x in zip(raw, m, strict=True) if not x)
        spans = sum(1 for i, x in enumerate(m) if x and (i == 0 or not m[i - 1]))
        out.append((len(raw), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, license_ = say(90), say(45)
    texts = [None, "", "short", say(60), say(60), "x" * 199, "x" * 200, "x" * 201, "ab" * 400, "the end " * 80]
    base = say(400)
    texts += [base, base, base]
    for _ in range(30):
        w = base.split(" ")
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w))
    for _ in range(40):
        texts.append(f"{say(r.randint(0, 40))} {r.choice([passage, license_])} {say(r.randint(0, 40))}")
    texts.append(f"{passage} {say(10)} {passage}")
    texts += [say(r.randint(1, 200)) for _ in range(20)]
    return texts


@pytest.mark.parametrize(("seed", "shard"), [(1000, 1 << 20), (3, 2000), (4, 500)])
def test_brute_force(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)  # small: groups are cut at all widths
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i] == want[i], (i, texts[i] and texts[i][:60])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(docs).count() == 0


def test_very_long_texts(spark):
    """Over a segment of 1 MiB: one symbol, a short period, and a passage on both sides of a segment's border."""
    r = random.Random(9)
    n = 1 << 20
    say = lambda k: "".join(r.choice("abcdefghij klmnop") for _ in range(k))
    own, passage = say(n + 5000), say(500)
    own = own[: n - 300] + passage + own[n + 200 :]
    texts = ["x" * (n + 700), "xyz" * ((n + 700) // 3), own, say(50) + passage + say(50), "x" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {row["doc_id"]: tuple(row)[1:] for row in suffix_dedup.remove_repeats(docs).collect()}
    for i in (0, 1, 4):
        assert got[i] == (len(texts[i]), len(texts[i]), 1, hashlib.sha256(b"").hexdigest())
    assert got[2] == (len(own), 500, 1, hashlib.sha256((own[: n - 300] + own[n + 200 :]).encode()).hexdigest())
    assert got[3] == (600, 500, 1, hashlib.sha256((texts[3][:50] + texts[3][-50:]).encode()).hexdigest())


def test_suffix_arrays():
    r = np.random.default_rng(5)
    for trial in range(400):
        t = np.append(np.repeat(r.integers(1, 4 + trial % 40, r.integers(1, 40 + trial)), 1 + trial % 4), 0)
        listed = t.tolist()
        want = sorted(range(len(t)), key=lambda i: listed[i:])
        sa = suffix_arrays.suffix_array(t)
        assert sa.tolist() == want
        prior, length = suffix_arrays.common_prefixes(t, sa, 6)
        for a, b in zip(want[1:], want, strict=False):
            n = next(k for k in range(len(t)) if listed[a + k] != listed[b + k])
            assert prior[a] == b and min(length[a], 6) == min(n, 6)
