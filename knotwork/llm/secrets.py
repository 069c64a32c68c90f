"""Secret scans with DataFrame functions only.

Base kinds are fixed patterns. The method adds spans of kind `markov`: two character Markov models, one of random strings
and one of ordinary identifiers and words, score every token of TOKEN_LENGTH or more characters of the token alphabet by
the log-likelihood ratio of its character pairs; a token above both MIN_RATIO and RATE per pair that overlaps no base
span is a secret. The models are trained from labelled samples: what the base kinds find (random) and the other tokens
(ordinary), in documents drawn by a hash of the text, about FIT_DOCS of each sort at most (that bound is a parameter).
The random sample is filled up with RANDOM_PAIRS pairs of even strings over each of RANDOM_ALPHABETS, in the expected
numbers, so that keys of kinds that the base patterns don't know are recognised too.
The counts are a table of character pairs, whatever the input's size; the score table reaches the scan as one row.

Positions are code points, ends exclusive. A text's matches and the pieces between them come from one pattern each; a
running sum of their lengths, in blocks, gives the positions in time linear in the text.

Defined results: a null text counts as empty and has no spans (sha256 of the empty string). Overlaps between kinds are
kept. Repeated rows count each, an empty table gives an empty result, and input columns named like an added one are
replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import fresh, materialize, quoted, without

# Fixed values of the base kinds.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN_LENGTH = 20
TOKEN = r"[A-Za-z0-9+/_=-]{%d,}"
MIN_RATIO = 10.0
RATE = 0.5
FIT_DOCS = 4000
SMOOTHING = 0.5
BACK_OFF = 20.0
RANDOM_PAIRS = 100_000
RANDOM_ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64])
REDACTED = "[REDACTED]"
_WIDTH = len(ALPHABET) + 1
_BLOCK = 256


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(pieces: Column, matches: Column) -> Column:
    """The start of each match: running sums of the lengths of pieces and matches, in blocks."""
    steps = F.zip_with(pieces, matches, lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))

    def of(lengths: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: F.aggregate(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda a, x: a + x))

        def running(s: Column) -> Column:
            def block(b: Column) -> Column:
                offset = F.aggregate(F.slice(s, F.lit(1), b), F.lit(0), lambda a, x: a + x)
                first = F.struct(offset.alias("at"), F.array().cast("array<int>").alias("out"))
                step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
                return F.aggregate(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)), first, step, lambda a: a["out"])

            return F.flatten(F.transform(blocks, block))

        return let(sums, running)

    # where a step starts, the piece before the match still lies ahead
    return F.zip_with(let(steps, of), pieces, lambda at, p: at + F.length(p))


def _spans(text: Column, maybe: str, pattern: str, rank: int, wanted) -> Column:
    """array<struct<start, rank, end, match>> of the matches of pattern for which wanted(match, group) holds; texts without `maybe` are passed over."""
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,match:string>>")
    group = 1 if rank == 0 else 0

    def found(parts: Column) -> Column:
        starts = _starts(parts["pieces"], parts["matches"])
        rows = F.zip_with(F.zip_with(starts, parts["matches"], lambda s, m: F.struct(s.alias("s"), m.alias("m"))), parts["groups"], lambda x, g: F.struct(x["s"].alias("s"), x["m"].alias("m"), g.alias("g")))
        good = F.filter(rows, lambda x: x["m"].isNotNull() & wanted(x["m"], x["g"]))
        return F.transform(good, lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), (x["s"] + F.length(x["m"])).alias("end"), x["m"].alias("match")))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.struct(F.split(text, pattern, -1).alias("pieces"), matches.alias("matches"), (F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if group else matches).alias("groups"))
    return F.when(text.rlike(maybe), let(parts, found)).otherwise(empty)


def base_spans(text: Column) -> list[Column]:
    return [
        _spans(text, ASSIGN, ASSIGN, 0, lambda m, g: F.length(g) >= 6),
        _spans(text, "AKIA[A-Z0-9]{16}", ACCESS, 1, lambda m, g: F.length(m) >= 20),
        # runs of 24 or more are the maximal runs that pass: shorter ones needn't be listed
        _spans(text, HEX[:-1] + "{24}", HEX[:-1] + "{24,}", 2, lambda m, g: F.length(m) >= 24),
    ]


def with_base(docs: DataFrame, text: str, name: str) -> DataFrame:
    t = F.coalesce(docs[quoted(text)], F.lit(""))
    return docs.withColumn(name, F.flatten(F.array(*base_spans(t))))


def _codes(token: str) -> str:
    """SQL: the alphabet positions of token's characters (0: none)."""
    return f"transform(split({token}, ''), c -> locate(c, '{ALPHABET}'))"


def _conditional(counts: list[float]) -> list[float]:
    """P(second | first) for each pair: counts with BACK_OFF of the symbol's own share, which is smoothed by SMOOTHING."""
    second = [SMOOTHING + sum(counts[b :: _WIDTH]) for b in range(_WIDTH)]
    total = sum(second)
    out = []
    for a in range(_WIDTH):
        row = counts[a * _WIDTH : (a + 1) * _WIDTH]
        size = sum(row) + BACK_OFF
        out += [(n + BACK_OFF * s / total) / size for n, s in zip(row, second, strict=True)]
    return out


def train(docs: DataFrame, text: str = "text", fit_docs: int = FIT_DOCS) -> DataFrame:
    """The score table, one row: weights, an array over character pairs of log P(pair | random) - log P(pair | ordinary)."""
    spark = docs.sparkSession
    texts = docs.select(docs[quoted(text)].alias("text"))
    drawn = F.xxhash64(F.lit("secrets"), "text").bitwiseAND(F.lit(0xFFFFFF)) / float(1 << 24)
    bearing = texts.filter(F.col("text").rlike(f"{ASSIGN}|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}"))
    sizes = texts.agg(F.count(F.lit(1)).alias("n")).crossJoin(bearing.agg(F.count(F.lit(1)).alias("b"))).first()  # one row
    random = with_base(bearing.filter(drawn < fit_docs / max(1, sizes["b"])), "text", "spans")
    value = F.expr("transform(spans, s -> if(s.rank = 0, regexp_extract(s.match, '[A-Za-z0-9+/_.=-]+$', 0), s.match))")
    random = random.select(F.lit(1).alias("y"), F.explode(F.array_distinct(value)).alias("token"))
    ordinary = texts.filter(drawn < fit_docs / max(1, sizes["n"])).filter(~F.col("text").rlike(f"{ASSIGN}|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}"))
    ordinary = ordinary.select(F.lit(0).alias("y"), F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("token"))
    pairs = F.expr(f"transform(sequence(0, size(codes) - 2), i -> codes[i] * {_WIDTH} + codes[i + 1])")
    tokens = random.unionByName(ordinary).filter(F.length("token") > 1).withColumn("codes", F.expr(_codes("token")))
    counted = tokens.select("y", F.explode(pairs).alias("pair")).groupBy("y", "pair").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 * _WIDTH ** 2 rows
    n = [[0.0] * (_WIDTH * _WIDTH) for _ in range(2)]
    for r in counted:
        n[r["y"]][r["pair"]] += r["n"]
    for alphabet in RANDOM_ALPHABETS:
        codes = [ALPHABET.index(c) + 1 for c in alphabet]
        for a in codes:
            for b in codes:
                n[1][a * _WIDTH + b] += RANDOM_PAIRS / len(codes) ** 2
    chances = [_conditional(k) for k in n]
    weights = [math.log(x) - math.log(y) for x, y in zip(chances[1], chances[0], strict=True)]
    listed = ",".join(f"{w:.4f}" for w in weights)
    return materialize(spark.range(1).select(F.split(F.lit(listed), ",").cast("array<double>").alias("weights")))


def scan(docs: DataFrame, model: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """docs with column `name`: array<struct<start, rank, end>> by start, then kind (rank is the place in KINDS)."""
    t, base, weights = (fresh(docs, x) for x in ("_text", "_base", "_weights"))
    own = docs.withColumn(t, F.coalesce(docs[quoted(text)], F.lit("")))
    own = with_base(own, t, base).withColumn(weights, model.select("weights").scalar())
    ratio = f"""aggregate(transform(array({_codes('x.match')}), d -> transform(sequence(0, size(d) - 2), i -> {weights}[d[i] * {_WIDTH} + d[i + 1]]))[0], 0D, (a, w) -> a + w)"""
    tokens = _spans(F.col(t), TOKEN % TOKEN_LENGTH, TOKEN % TOKEN_LENGTH, 3, lambda m, g: F.length(m) >= TOKEN_LENGTH)
    free = fresh(own, "_tokens")
    own = own.withColumn(free, tokens)
    scored = F.expr(
        f"""if(size({free}) = 0, {free}, filter({free}, x -> NOT exists({base}, b -> b.start < x.end AND x.start < b.end)
        AND {ratio} > greatest({MIN_RATIO}D, {RATE} * (length(x.match) - 1))))"""
    )
    ordered = F.array_sort(F.transform(F.concat(F.col(base), scored), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"))))
    return own.select(*[own[quoted(c)] for c in without(docs, [name])], ordered.alias(name))


def _listed(spans: str) -> Column:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(array({kinds})[x.rank], ':', x.start, ':', x.end)), ',')")


def report(docs: DataFrame, model: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns (all but text by default), n_assign, n_access, n_hex, n_markov, base_sha256 and spans."""
    added = ["n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"]
    keep = [c for c in (docs.columns if keep is None else keep) if c in without(docs, added) and (keep is not None or c != text)]
    name = fresh(docs, "_spans")
    found = scan(docs, model, text, name)
    number = [F.expr(f"size(filter({name}, x -> x.rank = {k}))").cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    base = fresh(docs, "_only_base")
    found = found.withColumn(base, F.filter(F.col(name), lambda x: x["rank"] < 3))
    return found.select(*[F.col(quoted(c)) for c in keep], *number, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(name).alias("spans"))


def redact(docs: DataFrame, model: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """docs with every span (overlapping ones together) of the text replaced by REDACTED, and column `length`, if there is
    one, brought up to date in the rows that change; the columns stay as they are."""
    name = fresh(docs, "_spans")
    found = scan(docs, model, text, name)
    cut = F.expr(
        f"""aggregate({name}, named_struct('at', 0, 'out', cast(array() as array<string>)),
        (a, x) -> named_struct('at', greatest(a.at, x.end), 'out', if(x.start >= a.at, concat(a.out, array(substring({quoted(text)}, a.at + 1, x.start - a.at), '{REDACTED}')), a.out)),
        a -> concat(array_join(a.out, ''), substring({quoted(text)}, a.at + 1)))"""
    )
    changed = F.size(name) > 0
    found = found.withColumn(text, F.when(changed, cut).otherwise(F.col(quoted(text))))
    if length in docs.columns:
        found = found.withColumn(length, F.when(changed, F.length(F.col(quoted(text))).cast(docs.schema[length].dataType)).otherwise(F.col(quoted(length))))
    return found.select(*[quoted(c) for c in docs.columns])
