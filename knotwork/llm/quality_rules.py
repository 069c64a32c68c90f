"""Quality rules: fixed base rules, then adaptive thresholds per language and source from mergeable quantile sketches.

The sketch is a table of counts by logarithmic bucket: a value x > 0 falls into bucket ceil(log(x) / log(g)) with
g = (1 + e) / (1 - e), so any quantile is known within a relative error e. Two sketches merge by adding counts, in any
order and with the same result, which makes reruns agree, lets every task pre-aggregate before the shuffle, and keeps
the rows of a group bounded by the number of buckets, however many documents it has.

A threshold is a fence over the values of a group's documents that pass the base rules: q75 + FENCE * (q75 - q25). No
fixed cutoff takes part but GUARD, a least width for groups without spread. Most documents repeat nothing, and those that
do are ordinary; so the repeat metrics (AMONG_REPEATS) have their fences over the documents that have any repeat.

Defined results: a null text has no words; a document without words fails the base rule n_words < 50. Null languages
and sources form groups of their own. A group's fence is drawn towards its language's, and that towards the one of all
documents, by the number of values: a fence over n values weighs n against PRIOR. The fence of a repeat metric over all
documents is drawn towards 1, its greatest value, likewise. Rows aren't merged: a repeated row is counted and judged like
any other. An empty table gives an empty result. A text may be of any length. Input columns that have the name of an added one are replaced by it.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import broadcast_up_to, fresh, map_columns, materialize, packed

#: Relative error of the sketches.
ERROR = 0.01
#: How many values a wider group's fence counts for against a group's own.
PRIOR = 20
#: A value is an outlier above q75 + FENCE * (q75 - q25) ...
FENCE = 4.0
#: ... and at least GUARD, and twice the sketch's error, above q75, for groups whose values are all alike.
GUARD = 0.02
METRICS = ["symbol_ratio", "repeat_ratio", "dup_line_ratio", "mean_word", "upper_ratio", "bang_ratio"]
AMONG_REPEATS = ["repeat_ratio", "dup_line_ratio"]
COUNTS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_lines": "long", "n_upper": "long", "n_letters": "long", "n_bangs": "long"}
#: More groups than this aren't broadcast.
BROADCAST_GROUPS = 50_000

_SYMBOLS = bytes.maketrans(b"", b"")
_DROP_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_CONTINUED = bytes(range(0x80, 0xC0))
_BLANK = re.compile(rb"[\x20\x09-\x0D]*\Z")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    pairs = a[:-1] * len(ids) + a[1:]
    if len(ids) > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    if not twice.any():
        return 0
    hit = np.zeros(n, bool)
    hit[:-2] |= twice
    hit[1:-1] |= twice
    hit[2:] |= twice
    return int(hit.sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    size = len(raw)
    # UTF-8 continuation bytes are never ASCII, so counting bytes counts code points
    joined = b"".join(words)
    word_chars = len(joined) - (0 if joined.isascii() else len(joined) - len(joined.translate(None, _CONTINUED)))
    symbols = size - len(raw.translate(None, _DROP_SYMBOLS))
    upper = size - len(raw.translate(None, _UPPER))
    lower = size - len(raw.translate(None, _LOWER))
    lines = [x for x in raw.split(b"\n") if not _BLANK.match(x)]
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), upper, upper + lower, raw.count(b"!")


def with_counts(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return map_columns(docs, text, keep, COUNTS, lambda: lambda texts: [counts_of(x) for x in texts])


def _metrics() -> dict:
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "mean_word": ratio("word_chars", "n_words"),
        "upper_ratio": ratio("n_upper", "n_letters"),
        "bang_ratio": ratio("n_bangs", "n_words"),
    }


def _base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketch(counted: DataFrame, lang: str, source: str, where=None) -> DataFrame:
    """Sketch rows (lang, source, metric, bucket, n); those of parts of the input merge by adding n.

    where: the rows that n counts; groups without any stay, with n = 0."""
    bucket = lambda c: F.when(c > 0, F.ceil(F.log(c) / math.log((1 + ERROR) / (1 - ERROR))).cast("int"))
    each = F.array(*[F.struct(F.lit(k).alias("metric"), bucket(c).alias("bucket")) for k, c in _metrics().items()])
    return (
        counted.select(F.col(lang).alias("lang"), F.col(source).alias("source"), (F.lit(True) if where is None else where).alias("counts"), F.inline(each))
        .groupBy("lang", "source", "metric", "bucket")
        .agg(F.count_if("counts").alias("n"))
    )


def quantiles(sketches: DataFrame, keys: list[str], ranks: dict[str, float]) -> DataFrame:
    """The quantiles of each metric for each group of keys, and n_group. A group has no more rows than buckets."""
    from pyspark.sql import Window as W

    merged = sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    every = W.partitionBy(*keys, "metric")
    upto = every.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    g = (1 + ERROR) / (1 - ERROR)
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(g), F.col("bucket")) / (g + 1))
    seen = merged.select(*keys, "metric", value.alias("v"), F.sum("n").over(upto).alias("c"), F.sum("n").over(every).alias("n_group"))
    return seen.groupBy(*keys, "metric").agg(F.first("n_group").alias("n_group"), *[F.min(F.when(F.col("c") >= r * F.col("n_group"), F.col("v"))).alias(k) for k, r in ranks.items()])


def thresholds(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row for each (lang, source): t_<metric>, above which a document is rejected."""
    sketches = materialize(sketch(counted, lang, source, ~_base_failed()))
    idle = F.col("metric").isin(AMONG_REPEATS) & F.col("bucket").isNull()
    sketches = sketches.withColumn("n", F.when(idle, 0).otherwise(F.col("n")))

    def fences(keys: list[str], p: str) -> DataFrame:
        """For each metric, p_n_<metric> and p_<metric>: the number of values and the fence."""
        q = quantiles(sketches, keys, {"q25": 0.25, "q75": 0.75})
        width = F.greatest(FENCE * (F.col("q75") - F.col("q25")), GUARD + 2 * ERROR * F.col("q75"))
        of = lambda k, c: F.max(F.when(F.col("metric") == k, c))
        return q.groupBy(*keys).agg(*[of(k, F.col("n_group")).alias(f"{p}_n_{k}") for k in METRICS], *[of(k, F.col("q75") + width).alias(f"{p}_{k}") for k in METRICS])

    own, by_lang, every = fences(["lang", "source"], "a"), fences(["lang"], "b"), fences([], "c")
    by_lang = by_lang.withColumnRenamed("lang", "lang_b")
    table = own.join(by_lang, F.col("lang").eqNullSafe(F.col("lang_b")), "left").crossJoin(F.broadcast(every))  # every: one row

    def drawn(p: str, k: str, wider):
        own, n = F.col(f"{p}_{k}"), F.coalesce(F.col(f"{p}_n_{k}"), F.lit(0))
        return F.coalesce((n * own + PRIOR * wider) / (n + PRIOR), own, wider)

    widest = lambda k: drawn("c", k, F.lit(1.0)) if k in AMONG_REPEATS else F.col(f"c_{k}")
    return table.select("lang", "source", *[drawn("a", k, drawn("b", k, widest(k))).alias(f"t_{k}") for k in METRICS])


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None, narrow: bool = True) -> DataFrame:
    """keep's columns (all but text by default), COUNTS, metrics, thresholds t_*, base_failed, reasons and kept.

    narrow: the counts are written once to the shared folder and read by both passes; else (wide rows kept whole, as in
    a filter of whole documents) both passes count for themselves."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    own = {x: fresh(docs, f"_{x}") for x in ("lang", "source")}
    docs = docs.withColumns({own["lang"]: docs[lang], own["source"]: docs[source]})
    keys = list(own.values())
    counted = with_counts(docs, text, [*keep, *keys])
    if narrow:
        counted = materialize(counted)
        limits = thresholds(counted, *keys)
    else:
        limits = thresholds(with_counts(docs, text, keys), *keys)
    limits = broadcast_up_to(materialize(limits), BROADCAST_GROUPS).withColumnsRenamed({"lang": "_t_lang", "source": "_t_source"})
    joined = counted.join(limits, F.col(keys[0]).eqNullSafe(F.col("_t_lang")) & F.col(keys[1]).eqNullSafe(F.col("_t_source")), "left")
    out = joined.withColumns(_metrics()).withColumn("base_failed", _base_failed())
    reasons = F.array_compact(F.array(*[F.when(F.col(k) > F.col(f"t_{k}"), F.lit(k)) for k in METRICS]))
    return out.withColumn("reasons", reasons).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0)).drop(*keys, "_t_lang", "_t_source")


def passing(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs, with their columns, that the rules keep."""
    rows, name = packed(docs, text, lang, source)
    return quality_rules(rows, text, lang, source, keep=[name], narrow=False).filter("kept").select(f"{name}.*")
