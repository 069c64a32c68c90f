"""Language identification by the nearest of several clustered centroids per language.

A text is folded to lower case, ASCII characters that aren't letters become spaces, and its UTF-8 bytes are counted as
hashed 3- and 4-grams in DIMENSIONS slots; the vector is weighted by log(1 + count) * idf and normalised. Spherical
k-means gives CENTROIDS centroids per language; the nearest one by cosine is the prediction, and a text whose distance
exceeds its centroid's radius (the RADIUS_RANK quantile of the fitted members' distances, times RADIUS_SLACK) is marked
as rejected.

Fitting takes at most about FIT_PER_LANG texts of each language, drawn by a hash of doc_id: the bound is this parameter.
Prediction covers every row and the whole text. Each language is fitted in a task of its own, over a bounded sample.

Defined results: a null text or one without a letter gives `und`, score 0.0, rejected. Rows with a null language are
predicted but not learned from, and so are rows with a null doc_id, which belong to neither side. With nothing to learn
from, all rows give `und`. Repeated rows count each. Ties between centroids go to the language first in code-point order.
An empty table gives an empty result. A text may be of any length: its n-grams are counted piece by piece, in DIMENSIONS
slots. Input columns named like an added one are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import map_columns, materialize, quoted

DIMENSIONS = 4096
FIT_PER_LANG = 600
CENTROIDS = 3
RADIUS_RANK = 0.99
RADIUS_SLACK = 1.25
_CHUNK = 1 << 20
_FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def held_out(doc_id) -> F.Column:
    """Whether a row is held out of what is learned; a null id is not, but isn't learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the whole text, in slots; long texts are taken in pieces that overlap."""
    raw = (" " + text.lower() + " ").encode("utf-8", "surrogatepass").translate(_FOLD)
    counts = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, max(1, len(raw) - 3), _CHUNK):
        b = np.frombuffer(raw[at : at + _CHUNK + 3], np.uint8).astype(np.uint32)
        if len(b) < 4:
            break
        three = (b[:-3] << np.uint32(16)) ^ (b[1:-2] << np.uint32(8)) ^ b[2:-1]
        four = (three << np.uint32(8)) ^ b[3:] ^ np.uint32(0x5BD1E995)
        for code in (three, four):
            counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1)


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first starts: centroids and the member's distances' radius each."""
    centroids = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        centroids.append(x[np.argmin(np.max(x @ np.array(centroids).T, axis=1))])
    c = np.array(centroids)
    for _ in range(rounds):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        near = np.argmax(x @ c.T, axis=1)
        c = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
    c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    similar = x @ c.T
    near, best = np.argmax(similar, axis=1), np.max(similar, axis=1)
    return c, np.array([np.quantile(1 - best[near == i], RADIUS_RANK) if (near == i).any() else 0.0 for i in range(len(c))])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_lang: int = FIT_PER_LANG) -> dict:
    """The model: idf and the centroids, their languages and radii; bounded by the number of languages."""
    rows = docs.select(docs[quoted(doc_id)].alias("id"), docs[quoted(lang)].alias("lang"), docs[quoted(text)].alias("text")).filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = (F.xxhash64(F.lit("lang"), "id").bitwiseAND(F.lit(0xFFFFFF)) / float(1 << 24)) * F.col("n") < per_lang
    sample = rows.join(F.broadcast(counts), "lang").filter(draw)  # counts: a row for each language

    def vectors() -> object:
        def of(texts: list) -> list[tuple]:
            out = []
            for t in texts:
                v = grams(t) if has_letter(t) else np.zeros(DIMENSIONS, np.int64)
                slots = np.flatnonzero(v)
                out.append((slots.tolist(), v[slots].tolist()))
            return out

        return of

    made = materialize(map_columns(sample, "text", ["lang"], {"slots": "array<int>", "counts": "array<int>"}, vectors).filter(F.size("slots") > 0))
    df = made.select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("df")).collect()  # at most DIMENSIONS rows
    n = made.count()
    idf = np.full(DIMENSIONS, np.log1p(n), np.float32)
    for r in df:
        idf[r["slot"]] = np.log((1 + n) / (1 + r["df"])) + 0.05

    def centroids(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["counts", "slots"], key=lambda s: s.map(lambda v: (len(v), sum(v))))
        x = np.zeros((len(part), DIMENSIONS), np.int64)
        for i, (s, c) in enumerate(zip(part["slots"], part["counts"], strict=True)):
            x[i, s] = c
        c, radius = clusters(weighted(x, idf), CENTROIDS)
        return pd.DataFrame({"lang": part["lang"].iloc[0], "vector": list(c.astype(np.float32)), "radius": radius})

    found = made.groupBy("lang").applyInPandas(centroids, "lang string, vector array<float>, radius double").collect()  # CENTROIDS rows for each language
    found.sort(key=lambda r: (r["lang"], r["radius"]))
    return {"idf": idf, "langs": [r["lang"] for r in found], "vectors": np.array([r["vector"] for r in found], np.float32).reshape(len(found), DIMENSIONS), "radius": np.array([r["radius"] for r in found])}


def predict(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns (all but text by default), lang_pred, score (the cosine, 0 to 1) and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids for each language

    def work():
        m = shared.value

        def of(texts: list) -> list[tuple]:
            out: list[tuple] = [("und", 0.0, True)] * len(texts)
            if not m["langs"]:
                return out
            known = [i for i, t in enumerate(texts) if has_letter(t)]
            for at in range(0, len(known), 128):
                part = known[at : at + 128]
                similar = weighted(np.array([grams(texts[i]) for i in part]), m["idf"]) @ m["vectors"].T
                best = np.argmax(similar, axis=1)
                for i, b, s in zip(part, best.tolist(), similar[np.arange(len(part)), best].tolist(), strict=True):
                    out[i] = (m["langs"][b], min(1.0, max(0.0, float(s))), bool(1 - s > m["radius"][b] * RADIUS_SLACK))
            return out

        return of

    keep = [c for c in docs.columns if c != text] if keep is None else keep
    return map_columns(docs, text, keep, {"lang_pred": "string", "score": "double", "rejected": "boolean"}, work)
