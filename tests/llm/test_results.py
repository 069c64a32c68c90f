"""Results of queries over whole small tables against independent computations, and odd inputs."""

import hashlib
import os
import zlib

import numpy as np
import pytest
import zstandard

from knotwork.llm import chat_format, html_extract, lang_id, quality_model, quality_rules
from knotwork.llm import queries as Q

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def read(spark, name, *columns):
    return spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).toPandas()


@tables
def test_quality_rules_by_exact_quantiles(spark):
    """Kept or not, by exact quantiles of each group, drawn to wider groups; near a fence the sketch's error may decide."""
    docs = read(spark, "documents", "doc_id", "text", "lang", "source")
    names = list(quality_rules.COUNTS)
    docs[names] = [quality_rules.counts_of(t) for t in docs.text]
    ratio = lambda a, b: docs[a] / np.maximum(docs[b], 1)
    metrics = {"symbol_ratio": ratio("n_symbols", "n_words"), "repeat_ratio": ratio("n_repeat_words", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "mean_word": ratio("word_chars", "n_words"), "upper_ratio": ratio("n_upper", "n_letters"), "bang_ratio": ratio("n_bangs", "n_words")}
    failed = (docs.n_words < 50) | (100 * docs.n_repeat_words > 50 * docs.n_words)

    def fence(x):
        x = np.sort(x)
        if not len(x):
            return 0, 0.0
        low, high = (x[int(np.ceil(r * len(x))) - 1] for r in (0.25, 0.75))
        return len(x), high + max(4 * (high - low), 0.02 + 0.02 * high)

    mix = lambda own, wider: (own[0] * own[1] + quality_rules.PRIOR * wider) / (own[0] + quality_rules.PRIOR)
    got = {r["doc_id"]: r["kept"] for r in Q.op8_quality_rules(spark, SF).collect()}
    sure = rejected = 0
    limits = set()
    for (lang, source), part in docs.fillna({"lang": "-", "source": "-"}).groupby(["lang", "source"]):
        over, near = np.zeros(len(part), bool), np.zeros(len(part), bool)
        for k, m in metrics.items():
            good = m[~failed & ((m > 0) | (k not in quality_rules.AMONG_REPEATS))]
            every = fence(good)
            widest = mix(every, 1.0) if k in quality_rules.AMONG_REPEATS else every[1]
            of_lang = fence(good[docs.lang.fillna("-")[good.index] == lang])
            own = fence(good[good.index.isin(part.index)])
            t = mix(own, mix(of_lang, widest))
            limits.add((k, round(t, 6)))
            over |= (m[part.index] > t).to_numpy()
            near |= (np.abs(m[part.index] / t - 1) < 0.05).to_numpy()
        for i, o, n, f in zip(part.doc_id, over, near, failed[part.index], strict=True):
            if f or not n:
                assert got[i] == (not f and not o), i
                sure += 1
                rejected += o and not f
    assert sure > 0.9 * len(docs) and rejected > 20
    assert len(limits) > 60  # groups have thresholds of their own


@tables
def test_quality_scores_again(spark):
    """Scores from the model by plain compression of every block; the labels of held-out rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = quality_model.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    again = quality_model.fit(docs.repartition(7), spark.read.parquet(f"{SF}/labels.parquet"))
    assert model["good"] == again["good"] and model["bad"] == again["bad"] and np.allclose(model["c"], again["c"])
    labels = dict(read(spark, "labels", "doc_id", "quality").itertuples(index=False))
    plain = {k: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(model[k]), level=3, write_content_size=False, write_checksum=False, write_dict_id=False) for k in ("good", "bad")}
    right = seen = 0
    rows = quality_model.score(docs, model, keep=["doc_id"]).collect()
    texts = dict(read(spark, "documents", "doc_id", "text").itertuples(index=False))
    for i, s, p, d in rows[::7]:
        raw = (texts[i] or "").encode()
        if raw:
            size = {k: sum(len(c.compress(raw[a : a + 1024])) for a in range(0, len(raw), 1024)) for k, c in plain.items()}
            assert abs(d - (size["bad"] - size["good"]) / len(raw)) <= 0.02
            z = model["c"] @ np.array([1, 10 * d, max(0, 10 * d)])
            assert abs(s - 1 / (1 + np.exp(-z))) < 1e-9 and p == (s >= 0.3)
    for i, _, p, _ in rows:
        if zlib.crc32(str(i).encode()) % 5 == 0 and labels.get(i) in (0, 1):
            seen += 1
            right += p == labels[i]
    assert seen > 40 and right / seen > 0.93


@tables
def test_languages_of_held_out_rows(spark):
    lang = dict(read(spark, "documents", "doc_id", "lang").itertuples(index=False))
    rows = Q.op10_language_id(spark, SF).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97


def test_odd_rows_of_both_classifiers(spark):
    """Null ids teach nothing; columns that clash are replaced; long, empty and null texts; an empty table."""
    words = {"aa": "lorem ipsum dolor sit amet ", "bb": "zwölf große krüge über öl "}
    rows = [(i, words["aa" if i % 2 else "bb"] * 5, "aa" if i % 2 else "bb", "x", 1.5) for i in range(60)]
    rows += [(None, words["aa"] * 5, "bb", "x", 1.5)] * 60 + [(1001, words["aa"] * 60_000, None, "x", 1.5), (1002, "", "aa", "x", 1.5), (1003, None, "bb", "x", 1.5), (1003, None, "bb", "x", 1.5), (1004, "12 34 !", "aa", "x", 1.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, SCORE double")
    got = lang_id.predict(docs, lang_id.fit(docs)).collect()
    assert got[0].__fields__ == ["doc_id", "lang", "lang_pred", "score", "rejected"] and len(got) == len(rows)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert (by[1], by[2], by[None], by[1001], by[1002], by[1003], by[1004]) == ("aa", "bb", "aa", "aa", "und", "und", "und")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 0)] * 9 + [(1, None), (2, 7)], "doc_id long, quality int")
    scored = quality_model.score(docs, quality_model.fit(docs, labels)).collect()
    assert len(scored) == len(rows) and scored[0].__fields__ == ["doc_id", "lang", "lang_pred", "score", "predicted", "difference"]
    value = {r["doc_id"]: r["score"] for r in scored}
    assert value[1] > 0.5 > value[2] and value[1001] > value[2] and value[1002] == value[1003]
    none = docs.limit(0)
    assert lang_id.predict(none, lang_id.fit(none)).count() == 0
    assert quality_model.score(none, quality_model.fit(none, labels.limit(0))).count() == 0


def test_turns_do_not_depend_on_how_they_are_read(spark):
    r = np.random.default_rng(3)
    rows = [(int(c), int(t), ["user", "assistant"][t % 2], f"text {c} {t} {'?' if t % 2 == 0 else 'well, ' * 20}", "role") for c in range(30) for t in range(int(r.integers(1, 9)))]
    rows += [(5, 2, "user", "again", "x"), (5, 2, "user", "and again", "x"), (5, None, None, "late", "x"), (None, 1, "user", None, "x"), (7, 3, "assistant", "User: hi\nAssistant: " + "ho " * 400_000, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    want = sorted(map(str, chat_format.recover(turns).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert sorted(map(str, chat_format.recover(turns.orderBy("text").repartition(3)).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(want) == len(rows) + 1
    assert chat_format.recover(turns.limit(0)).count() == 0
    model = chat_format.fit(chat_format.ordered(turns))
    assert all(np.allclose(np.exp(e).sum(axis=1), 1) for e in model["emit"].values())  # each a distribution


def test_deep_and_unclosed_pages():
    deep = html_extract.Page("<div>" * 60_000 + "text" + "</div>" * 60_000)
    assert len(deep.parent) == 60_001 and deep.text[60_000] == (60_000, "text")
    assert html_extract.Page("<textarea>" * 30_000 + "x").text[-1][1] == "x"
    assert html_extract.Page("<p>a<p>b<table><tr><td>c<td>d</table><b>e<div>f</b>g").tag == ["html", "p", "p", "table", "tr", "td", "td", "div"]


@tables
def test_spans_that_the_secret_models_add(spark):
    """Each span is one of the base kinds' or the models'; base ones are counted and hashed by themselves."""
    texts = dict(read(spark, "documents", "doc_id", "text").itertuples(index=False))
    kinds = set()
    for r in Q.op5_secret_scans(spark, SF).collect():
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        kinds |= {k for k, _, _ in spans}
        base = [x for x in spans if x[0] in ("assign", "access", "hex")]
        assert len(base) == r["n_assign"] + r["n_access"] + r["n_hex"]
        assert hashlib.sha256(",".join(":".join(x) for x in base).encode()).hexdigest() == r["base_sha256"]
        n = len(texts[r["doc_id"]] or "")
        assert all(0 <= int(a) < int(b) <= n for _, a, b in spans)
        assert [int(a) for _, a, _ in spans] == sorted(int(a) for _, a, _ in spans)
    assert {"assign", "hex"} <= kinds
