"""Quality classifier by compression: zstandard dictionaries built from good and bad labelled text.

A text is compressed in blocks of BLOCK bytes with either dictionary; the difference of the compressed sizes, normalised
by the size of the text, becomes a probability of label 1 by logistic calibration, of which it is the only input. Blocks
keep the dictionaries in play over the whole of a long text.

Fitting takes at most about FIT_ROWS labelled texts of each label, drawn by a hash of doc_id: the bound is a parameter. Of
two thirds of them, blocks drawn by hash from anywhere in the texts (about FIT_BYTES for each label) make the dictionaries;
the others, of any length, are measured where they are and calibrate. Only those blocks and a number for each text come
to the driver. Scoring covers every row and the whole text.

Defined results: a null text counts as empty; an empty text scores the fitted share of label 1. A label that is null or
neither 0 nor 1 isn't learned from, nor is a row with a null doc_id. With too little to learn from, every row scores 0.5.
Repeated rows count each. An empty table gives an empty result. A text may be of any length: it is compressed block by
block. Input columns named like an added one are replaced.
"""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import broadcast_up_to, map_columns, materialize, quoted
from knotwork.llm.lang_id import held_out

FIT_ROWS = 1500
FIT_BYTES = 8 << 20
DICTIONARY = 64 << 10
BLOCK = 1024
LEVEL = 3
CUT = 0.3


def difference(raw: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """The normalised difference (bad - good) / size, above 0 if the good dictionary fits better."""
    blocks = [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
    return sum(len(bad.compress(x)) - len(good.compress(x)) for x in blocks) / len(raw) if raw else 0.0


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def dictionary(parts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A zstandard dictionary trained from blocks, or for few blocks their own text."""
    try:
        return zstandard.train_dictionary(size, parts, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:size] or b" " * 8


def drawn_blocks(text: str, rate: float) -> list[bytes]:
    """The blocks of a whole text that a hash of their bytes draws at the rate."""
    raw = text.encode("utf-8", "surrogatepass")
    blocks = (raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK))
    return [b for b in blocks if xxhash.xxh3_64_intdigest(b) < rate * 2**64]


def terms(x: np.ndarray) -> np.ndarray:
    """A line with a bend at 0, so that either side has its own slope."""
    return np.stack([np.ones_like(x), 10 * x, np.maximum(0, 10 * x)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Weighted ridge logistic regression on terms() by Newton steps."""
    t = terms(x)
    c = np.zeros(t.shape[1])
    keep = ridge * np.eye(len(c))
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(t @ c, -30, 30)))
        step = np.linalg.solve(t.T @ (t * (weight * p * (1 - p))[:, None]) + keep, t.T @ (weight * (y - p)) - keep @ c)
        c += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return c


def probability(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(terms(x) @ c, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", rows: int = FIT_ROWS) -> dict:
    known = labels.select(labels[quoted(doc_id)].alias("id"), labels[quoted(label)].cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    share = F.when(F.col("y") == 1, min(1.0, rows / max(1, counts.get(1, 0)))).otherwise(min(1.0, rows / max(1, counts.get(0, 0))))
    drawn = known.filter(F.xxhash64(F.lit("quality"), "id").bitwiseAND(F.lit(0xFFFFFF)) / float(1 << 24) < share)
    texts = docs.select(docs[quoted(doc_id)].alias("id"), docs[quoted(text)].alias("text"))
    drawn = materialize(drawn.distinct())
    lot = F.pmod(F.xxhash64(F.lit("third"), "id"), F.lit(3))
    got = materialize(texts.join(broadcast_up_to(drawn, 8 * rows), "id").filter(F.length("text") > 0).select("y", "text", (lot == 2).alias("third")))
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    known_y = {(r["y"], r["third"]): r["n"] for r in got.groupBy("y", "third").agg(F.sum(F.octet_length("text").cast("long")).alias("n")).collect()}  # four rows
    if len(known_y) < 4:
        return {"good": b"", "bad": b"", "c": None, "prior": 0.5}
    parts: dict = {0: [], 1: []}
    for y in (0, 1):
        rate = min(1.0, FIT_BYTES / known_y[y, False])
        blocks = map_columns(got.filter((F.col("y") == y) & ~F.col("third")), "text", [], {"blocks": "array<binary>"}, lambda rate=rate: lambda some: [(drawn_blocks(t, rate),) for t in some])
        parts[y] = sorted(r["b"] for r in blocks.select(F.explode("blocks").alias("b")).collect())  # about FIT_BYTES
    good, bad = dictionary(parts[1]), dictionary(parts[0])

    def measured():
        g, b = compressor(good), compressor(bad)
        return lambda some: [(difference(t.encode("utf-8", "surrogatepass"), g, b),) for t in some]

    seen = sorted(tuple(r) for r in map_columns(got.filter("third"), "text", ["y"], {"d": "double"}, measured).collect())  # about rows / 3 of each label
    x, y = np.array([r[1] for r in seen]), np.array([r[0] for r in seen], float)
    # the classes were drawn at different rates: weights put them back to their shares of all labels
    weight = np.where(y == 1, prior / y.sum(), (1 - prior) / (1 - y).sum()) * len(y)
    return {"good": good, "bad": bad, "c": logistic(x, y, weight), "prior": prior}


def score(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns (all but text by default), score, predicted and difference."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY bytes

    def work():
        m = shared.value
        if m["c"] is not None:
            g, b = compressor(m["good"]), compressor(m["bad"])

        def of(texts: list) -> list[tuple]:
            out = []
            for t in texts:
                raw = (t or "").encode("utf-8", "surrogatepass")
                d = difference(raw, g, b) if m["c"] is not None and raw else 0.0
                s = float(probability(np.array([d]), m["c"])[0]) if m["c"] is not None and raw else m["prior"]
                out.append((s, int(s >= CUT), d))
            return out

        return of

    keep = [c for c in docs.columns if c != text] if keep is None else keep
    return map_columns(docs, text, keep, {"score": "double", "predicted": "int", "difference": "double"}, work)
