"""Pigeonhole edit matching against brute force."""

import random

import pytest

from knotwork.llm import decontaminate as d


def sellers(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def brute(items, text):
    t = f" {d.folded(text)} "
    out = []
    for i, raw in items:
        p = d.folded(raw)
        if not p:
            continue
        k = d.edits(len(p))
        if k == 0:
            if f" {p} " in t:
                out.append((i, 0))
        elif (n := sellers(p, t)) <= k:
            out.append((i, n))
    return sorted(out)


def cases(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(80)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, say(r.randint(1, 40)).capitalize() + ".") for k in range(25)] + [(90, ""), (91, "..."), (92, "ab"), (93, None)]
    items.append((94, items[3][1]))
    docs = [None, "", "ab", "x ab y", "abx"]
    for _ in range(60):
        t = list(r.choice(items[:25])[1])
        for _ in range(r.randint(0, 9)):
            k = r.randrange(max(1, len(t)))
            op = r.random()
            if op < 0.4:
                t[k : k + 1] = [r.choice("abcd ")]
            elif op < 0.7:
                t[k:k] = [r.choice("abcd ")]
            else:
                del t[k : k + 1]
        docs.append(f"{say(r.randint(0, 30))} {''.join(t)}, {say(r.randint(0, 30))}")
    return items, docs


def test_myers_is_exact():
    r = random.Random(1)
    for _ in range(300):
        p, t = ("".join(r.choice("ab") for _ in range(r.randint(1, 20))) for _ in range(2))
        assert d.least_distance(d.masks(p), len(p), t, 100) == min(sellers(p, t), len(p))


@pytest.mark.parametrize("shard", [10**6, 700])
def test_brute_force(spark, shard):
    items, docs = cases(shard)
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: list(zip(r["items"], r["item_edits"], strict=True)) for r in d.find(table, bench, shard_chars=shard).collect()}
    for i, t in enumerate(docs):
        assert got[i] == brute([(k, x or "") for k, x in items], t), (i, t)
    kept = d.clean(table, bench, shard_chars=shard)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(docs)) if not got[i]]
    assert {r["items"] for r in kept.collect()} == {"x"}


def test_repeated_phrases():
    """Pieces that also occur elsewhere in the item are hit misaligned before the aligned piece."""
    r = random.Random(5)
    found = 0
    for case in range(2000):
        words = ["go", "left", "now", "turn", "back", "up"][: r.randint(2, 6)]
        phrase = " ".join(r.choice(words) for _ in range(r.randint(2, 4)))
        item = d.folded(f"{phrase} {' '.join(r.choice(words) for _ in range(r.randint(0, 5)))} {phrase} {phrase if r.random() < 0.3 else ''}")
        t = list(item)
        for _ in range(r.randint(0, d.edits(len(item)) + 1)):
            k, op = r.randrange(len(t)), r.random()
            if op < 0.4:
                t[k] = r.choice("xyz")
            elif op < 0.7:
                t.insert(k, r.choice("xyz"))
            else:
                del t[k]
        text = f"{' '.join(r.choice(words) for _ in range(r.randint(0, 6)))} {''.join(t)} {' '.join(r.choice(words) for _ in range(r.randint(0, 6)))}"
        got = d.Matcher([(1, item)]).search(text)
        assert got == brute([(1, item)], text), (case, item, text)
        found += bool(got)
    assert found > 1000


def test_empty_tables(spark):
    table = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.find(table, none).first()["items"] == []
    assert d.find(table.limit(0), none).count() == 0
