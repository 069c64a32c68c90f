"""The pipeline against brute force on a small fixture, and the operators' defined results for odd rows."""

import hashlib
import random
import re

import duckdb
import pytest

import corpus_pipeline
from knotwork.llm import decontaminate, lang_id, mixing, quality_model, quality_rules, secrets
from tests.llm.test_decontaminate import brute as brute_items
from tests.llm.test_ngram_join import brute as brute_classes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def corpus():
    r = random.Random(9)
    words = ["".join(r.choice(["th", "er", "on", "an", "re", "ti"]) for _ in range(r.randint(1, 3))) for _ in range(900)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, say(30).capitalize() + ".") for k in range(5)]
    rows = []
    for k in range(150):
        text = say(r.randint(60, 150))
        kind = k % 10
        if kind == 1:
            text = " ".join(f"{w}###" for w in text.split())
        elif kind == 2:
            text += f' token = "{hashlib.md5(str(k).encode()).hexdigest()}" and {say(3)}'
        elif kind == 3:
            text = f"{text} {items[k % 5][1]} {say(10)}"
        elif kind == 4 and k > 20:
            w = rows[k - 7][1].split(" ")
            w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 5:
            text = say(10)
        elif kind == 6:
            text = "again and again " * 40
        rows.append((k, text, r.choice(["en", "de", None]), r.choice(["a", "b", "c", None, "é"]), len(text)))
    rows += [(900, None, None, None, None), (901, "", "en", "a", 0), (902, " \n ", "en", "a", 3), rows[0], rows[0]]
    return rows, items


def base_spans(t):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def redacted(t):
    out, at = [], 0
    for a, _, b in base_spans(t):
        if a >= at:
            out += [t[at:a], secrets.REDACTED]
        at = max(at, b)
    return "".join(out) + t[at:]


def brute_repeats(t):
    w = (t or "").encode().split()
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    return len({i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)})


def test_pipeline(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, by_stage = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if stage is not corpus_pipeline.mixture:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        by_stage[name] = sorted(map(tuple, docs.collect()), key=str)
    # rules: the fixture's metrics stay under the fences but for symbols
    good = [x for x in rows if x[1] and len(x[1].split()) >= 50 and brute_repeats(x[1]) * 2 <= len(x[1].split()) and "###" not in x[1]]
    assert by_stage["quality rules"] == sorted(good, key=str)
    keep = {c for _, c, _, _ in brute_classes([(x[0], x[1]) for x in good])}
    once = sorted({x for x in good if x[0] in keep}, key=str)
    assert by_stage["n-gram Jaccard join"] == once
    clean = [x for x in once if not brute_items(items, x[1])]
    assert by_stage["benchmark decontamination"] == clean and len(clean) < len(once)
    safe = [(i, redacted(t), lang, source, len(redacted(t)) if base_spans(t) else n) for i, t, lang, source, n in clean]
    assert by_stage["secret scans"] == sorted(safe, key=str) and safe != clean
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/secret scans/*.parquet'")
    want = con.execute(mixing.ORACLE_SQL.format(documents="documents")).fetchall()
    got = [(x[0], x[2], x[3], x[4], x[5]) for x in by_stage["source mixing"]]
    assert sorted(got) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == by_stage["source mixing"]


@pytest.fixture(scope="module")
def odd(spark):
    rows, _ = corpus()
    names = SCHEMA + ", score double, kept string, size long, spans string, items long, held_out boolean"
    return spark.createDataFrame([(*x, 1.0, "mine", 2, "s", 3, True) for x in [*rows, (None, "token: abcdef123 " + "x" * 300_000, None, "a", 1)]], names)


def test_base_rules(spark, odd):
    got = quality_rules.quality_rules(odd, keep=["doc_id", "kept"]).collect()
    assert len(got) == odd.count()
    text = {x["doc_id"]: x["text"] for x in odd.collect()}
    for x in got:
        t = text[x["doc_id"]] or ""
        w = t.encode().split()
        lines = [y for y in t.split("\n") if y.strip(" \t\n\r\x0b\x0c")]
        want = (len(w), sum(len(y.decode()) for y in w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), brute_repeats(t))
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want
        assert x["base_failed"] == (len(w) < 50 or 100 * want[4] > 50 * len(w))
    assert quality_rules.quality_rules(odd.limit(0), keep=["doc_id"]).count() == 0


def test_sketch_quantiles_are_within_the_error(spark):
    docs = spark.createDataFrame([(i, "w " * 60 + "#" * i, "en", "a", 1) for i in range(1, 200)], SCHEMA)
    counted = quality_rules.with_counts(docs, "text", ["lang", "source"])
    half = [quality_rules.sketch(counted.filter(f"n_symbols % 2 = {k}"), "lang", "source") for k in (0, 1)]
    merged = quality_rules.quantiles(half[0].unionByName(half[1]), ["lang", "source"], {"q": 0.5}).filter("metric = 'symbol_ratio'").first()
    assert merged["n_group"] == 199
    assert abs(merged["q"] / (100 / 61) - 1) <= 2 * quality_rules.ERROR


def test_groups_decide_their_thresholds(spark):
    """The same values are outliers in one source and ordinary in another."""
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    say = lambda n, sizes, tail="": " ".join(word(r.choice(sizes)) + (tail if r.random() < 0.5 else "") for _ in range(n))
    rows = [(k, say(80, [4, 5, 6]), "en", "prose", 1) for k in range(150)]
    rows += [(k, say(80, [8, 9, 10], "|" * r.randint(0, 2)), "en", "code", 1) for k in range(200, 350)]
    rows += [(k, say(80, [9]), "en", source, 1) for k, source in ((900, "prose"), (901, "code"))]
    table = " ".join(["|", "|", "|", "|", *say(76, [5]).split()])  # 0.05 symbols a word
    rows += [(902, table, "en", "prose", 1), (903, table, "en", "code", 1)]
    again = say(6, [5])
    some = [(k, f"{say(74, [4, 5, 6])} {again[:17]} {again[:17]}", "en", "prose", 1) for k in range(400, 520)]
    some.append((904, f"{say(64, [4, 5, 6])} {again} {say(4, [5])} {again}", "en", "prose", 1))
    got = {x["doc_id"]: x for x in quality_rules.quality_rules(spark.createDataFrame(rows + some, SCHEMA), keep=["doc_id"]).collect()}
    assert not any(x["base_failed"] for x in got.values())
    for k in ("symbol_ratio", "mean_word"):
        assert got[0][f"t_{k}"] < got[200][f"t_{k}"]
    reasons = {i: x["reasons"] for i, x in got.items() if x["reasons"]}
    assert reasons == {900: ["mean_word"], 902: ["symbol_ratio"], 904: ["repeat_ratio"]}


def test_secrets(spark, odd):
    model = secrets.train(odd)
    extra = spark.createDataFrame([(7777, 'key zX9+kQ2/vB7mN4pL8sD1wF6hJ3 and ghp_A8fK2mQ9zX4vB7nL1pR6tY3w"', None, None, None)], SCHEMA)
    wide = odd.unionByName(extra, allowMissingColumns=True)
    text = {x["doc_id"]: x["text"] or "" for x in wide.collect()}
    for x in secrets.report(wide, model, keep=["doc_id"]).collect():
        spans = base_spans(text[x["doc_id"]])
        listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert x["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [x["n_assign"], x["n_access"], x["n_hex"]] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert set(filter(None, listed.split(","))) <= set(x["spans"].split(","))
        if x["doc_id"] == 7777:
            assert x["n_markov"] >= 1
        elif x["doc_id"] is not None:
            assert x["n_markov"] == 0
    assert secrets.report(odd.limit(0), model, keep=["doc_id"]).count() == 0


def test_many_matches(spark):
    """Positions over more than one block of running sums."""
    t = " ".join(f"é{'0123456789abcdef' * 2} token=abcdef{i}" for i in range(700))
    model = secrets.train(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    x = secrets.report(spark.createDataFrame([(1, t)], "doc_id long, text string"), model).first()
    listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base_spans(t))
    assert x["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()


def test_mixing_rules(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= x["taken"] <= 3 * x["size"] for x in rows)
    sizes, taken, target = {}, {}, {}
    for x in rows:
        sizes[x["source"]] = sizes.get(x["source"], 0) + x["size"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
        target[x["source"]] = x["target"]
    for s in sizes:
        assert target[s] <= 3 * sizes[s] and abs(taken[s] - target[s]) <= 1
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(odd).collect()), key=str)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_language_and_quality(spark):
    r = random.Random(4)
    sounds = {"xx": ["ka", "ki", "ko"], "yy": ["zö", "ßu", "vä"]}
    rows = []
    for k in range(400):
        lang = r.choice(["xx", "yy"])
        bad = r.random() < 0.4
        words = ["".join(r.choice(sounds[lang]) for _ in range(r.randint(1, 4))) + ("***" if bad else "") for _ in range(r.randint(20, 60))]
        rows.append((k, " ".join(words), lang, "s", 1, 0 if bad else 1))
    rows += [(1000, None, None, None, None, None), (1001, "123 !!", "xx", None, None, 1), (None, "ka ki", None, None, None, None), (0, rows[0][1], "xx", "s", 1, 0)]
    docs = spark.createDataFrame(rows, SCHEMA + ", quality int")
    out = lang_id.predict(docs, lang_id.fit(docs), keep=["doc_id", "lang"]).collect()
    assert len(out) == len(rows)
    assert all(x["lang_pred"] == "und" and x["score"] == 0 for x in out if x["doc_id"] in (1000, 1001))
    known = [x for x in out if x["doc_id"] is not None and 0 < x["doc_id"] < 1000]
    assert sum(x["lang_pred"] == x["lang"] for x in known) / len(known) > 0.98
    nothing = lang_id.fit(docs.filter("lang IS NULL"))
    assert {x["lang_pred"] for x in lang_id.predict(docs, nothing, keep=["doc_id"]).collect()} == {"und"}
    model = quality_model.fit(docs, docs.select("doc_id", "quality"))
    scored = quality_model.score(docs, model, keep=["doc_id", "quality"]).collect()
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) for x in scored)
    known = [x for x in scored if x["doc_id"] is not None and 0 < x["doc_id"] < 1000]
    assert sum(x["predicted"] == x["quality"] for x in known) / len(known) > 0.95
    empty = quality_model.fit(docs, docs.select("doc_id", "quality").limit(0))
    assert {x["score"] for x in quality_model.score(docs, empty, keep=["doc_id"]).collect()} == {0.5}


def test_decontamination_keeps_clashing_columns(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    kept = decontaminate.clean(odd, none)
    assert kept.columns == odd.columns and kept.count() == odd.count()
