"""N-gram Jaccard join: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of THRESHOLD or more.

1. Texts with equal shingle sets are one set (told apart by 128 bits of hash), with the number of its texts.
2. Each set has HASHES MinHash values. Sets that agree in one of BANDS bands of ROWS values meet under that band's hash.
   A pair at the threshold is missed with probability (1 - THRESHOLD ** ROWS) ** BANDS, under 1e-6.
3. A band hash with m sets is dealt in blocks: its sets are split by hash into chunks of about CHUNK, and a block is a pair
   of chunks. So no task holds more than two chunks of it, however many near copies there are. In a block, MinHash values
   are compared STEP at a time, and a pair goes when the posterior probability of reaching the threshold (uniform prior)
   falls below TOLERANCE. A pair belongs to the first band in which it agrees, and is looked at in that one only.
4. What is left is verified exactly in its block, with whole texts: the sizes of all intersections are a matrix product
   over the shingles that several sets of the block hold.
5. A block returns, for each set, the number of linked texts, and a spanning forest of its links: no more rows than it got.
   Connected components of the forests are the classes.

Words are runs without ASCII white space. A text of fewer than five words is one shingle.

Defined results: a null text or one without words has no shingles, links with nothing and is a class of its own. Equal
rows link with each other. class_id is the least doc_id of the class, n_links the number of other rows at the threshold or
above. Null doc_ids count as links but name no class unless all are null. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import map_columns, materialize, packed, quoted
from knotwork.llm.components import components
from knotwork.llm.shingles import mixed, shingles

THRESHOLD = 0.8
HASHES = 64
BANDS, ROWS = 21, 3
CHUNK = 256
STEP = 8
TOLERANCE = 1e-7
_A = mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_C = mixed(np.arange(1001, HASHES + 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def minhash(s: np.ndarray) -> np.ndarray:
    """HASHES MinHash values (32 bits) of a set."""
    best = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 4096):
            h = _A[:, None] * s[None, at : at + 4096] + _C[:, None]
            best = np.minimum(best, (h >> np.uint64(32)).min(axis=1))
    return best.astype(np.uint32)


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b""


def needed(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """The least number of equal values among the first STEP, 2 * STEP, ... that keeps a pair.

    With a uniform prior, P(J >= t | m of k equal) = P(Binomial(k + 1, t) <= m)."""
    out = []
    for k in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def owned(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Pairs (rows of a and b) that agree in no band before this one."""
    ok = np.ones(len(a), bool)
    for k in range(band):
        live = np.flatnonzero(ok)
        if not len(live):
            break
        part = slice(k * ROWS, k * ROWS + ROWS)
        ok[live[(a[live, part] == b[live, part]).all(axis=1)]] = False
    return ok


def pairs_of(chunk: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    if i == j:
        return np.triu_indices(len(chunk), 1)
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    return np.repeat(left, len(right)), np.tile(right, len(left))


def surviving(sig: np.ndarray, chunk: np.ndarray, i: int, j: int, band: int) -> np.ndarray:
    """Whether each set of a block is in a pair that this band owns and the incremental comparison keeps."""
    x, y = pairs_of(chunk, i, j)
    keep = owned(sig[x], sig[y], band) if band else np.ones(len(x), bool)
    x, y = x[keep], y[keep]
    equal = np.zeros(len(x), np.int64)
    for step, least in enumerate(needed()):
        part = slice(step * STEP, step * STEP + STEP)
        equal += (sig[x, part] == sig[y, part]).sum(axis=1)
        keep = equal >= least
        x, y, equal = x[keep], y[keep], equal[keep]
        if not len(x):
            break
    hit = np.zeros(len(sig), bool)
    hit[x] = hit[y] = True
    return hit


def linked(sets: list[np.ndarray], sig: np.ndarray, chunk: np.ndarray, i: int, j: int, band: int, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a block that this band owns and whose exact Jaccard similarity reaches the threshold."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    several = count[column] > 1  # shingles of one set only meet no other
    names = np.cumsum(count > 1) - 1
    row, column = row[several], names[column[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        common += m @ m.T
    x, y = pairs_of(chunk, i, j)
    both = common[x, y].astype(np.float64)
    keep = both >= threshold * (sizes[x] + sizes[y] - both) - 1e-9
    x, y = x[keep], y[keep]
    mine = owned(sig[x], sig[y], band) if band else np.ones(len(x), bool)
    return x[mine], y[mine]


def forest(n: int, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    parent = list(range(n))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            out.append((a, b))
            if len(out) == n - 1:
                break
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, dict]]:
    """Rows sorted by their first columns, as (key, columns) for each key; a block is small."""
    key, held = None, []
    for batch in batches:
        lists = [c.to_pylist() for c in batch.columns]
        for row in zip(*lists, strict=True):
            if row[:keys] != key:
                if held:
                    yield key, list(zip(*held, strict=True))
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, list(zip(*held, strict=True))


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(len(column), HASHES)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["bh", "i", "j", "band", "chunk", "id", "n", "sig"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    out: list[tuple] = []
    for (bh, i, j, band), (chunk, ids, n, sig) in _grouped(batches, 4):
        if len(ids) > 1:
            hit = surviving(_signatures(sig), np.array(chunk), i, j, band)
            out += [(bh, i, j, band, c, a, m, s) for c, a, m, s, h in zip(chunk, ids, n, sig, hit.tolist(), strict=True) if h]
        if len(out) > 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, other, links): a row for each set with links in a block (other null), and one for each edge of the forest (links null)."""
    kinds = [pa.binary(), pa.binary(), pa.int64()]
    out: list[tuple] = []
    for (_, i, j, band), (chunk, ids, n, sig, texts) in _grouped(batches, 4):
        if len(ids) > 1:
            x, y = linked([shingles(t) for t in texts], _signatures(sig), np.array(chunk), i, j, band)
            n = np.array(n, np.int64)
            links = np.bincount(x, n[y], len(ids)) + np.bincount(y, n[x], len(ids))
            out += [(ids[k], None, int(links[k])) for k in np.flatnonzero(links).tolist()]
            out += [(ids[a], ids[b], None) for a, b in forest(len(ids), x, y)]
        if len(out) > 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "other", "links"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "other", "links"])


def with_key(docs: DataFrame, text: str, name: str, keep: list[str]) -> DataFrame:
    """keep's columns and the key of the text's shingle set (empty: no words)."""
    return map_columns(docs, text, keep, {name: "binary"}, lambda: lambda texts: [(set_key(shingles(t)),) for t in texts])


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """(id, text), each set once in a task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                ids, texts = [], []
                for t in whole.column(0).slice(at, 1024).to_pylist():
                    k = set_key(shingles(t))
                    if k and k not in seen:
                        seen.add(k)
                        ids.append(k)
                        texts.append(t)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["id", "text"])

    return docs.select(docs[quoted(text)].alias("text")).mapInArrow(run, "id binary, text string")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(members, sets): doc_id and id for each row; id, root (the class), class_id and n_links for each set with words."""

    def work():
        def of(texts: list) -> list[tuple]:
            out = []
            for t in texts:
                s = shingles(t)
                out.append((set_key(s), minhash(s).tobytes() if len(s) else b""))
            return out

        return of

    named = docs.select(docs[quoted(doc_id)].alias("doc_id"), docs[quoted(text)].alias("text"))
    members = materialize(map_columns(named, "text", ["doc_id"], {"id": "binary", "sig": "binary"}, work))
    sets = materialize(members.filter(F.length("id") > 0).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max("sig").alias("sig")))
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    bands = sets.select("id", F.explode(F.array(*[F.struct(F.lit(b).cast("long").alias("band"), F.xxhash64(F.lit(b), F.substring("sig", b * ROWS * 4 + 1, ROWS * 4)).alias("bh")) for b in range(BANDS)])).alias("x")).select("id", "x.*")
    crowded = bands.groupBy("bh").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    met = bands.join(crowded, "bh").withColumn("c", F.ceil(F.col("m") / CHUNK).cast("long")).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("c")))
    dealt = met.select("bh", "band", "chunk", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("o"))
    blocks = dealt.select("bh", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "band", "chunk", "id").join(sets.select("id", "n", "sig"), "id")
    names = ["bh", "i", "j", "band", "chunk", "id", "n", "sig"]
    kinds = "bh long, i long, j long, band long, chunk long, id binary, n long, sig binary"
    blocks = blocks.select(*names).repartition(parallel, "bh", "i", "j").sortWithinPartitions("bh", "i", "j", "band", "id")
    found = materialize(blocks.mapInArrow(_candidates, kinds))
    full = found.join(_texts(docs, text), "id").select(*names, "text")
    # a set's text may come from several tasks: a block takes it once
    full = full.repartition(parallel, "bh", "i", "j").sortWithinPartitions("bh", "i", "j", "band", "id")
    verified = materialize(full.mapInArrow(_once, kinds + ", text string").mapInArrow(_verified, "id binary, other binary, links long"))
    edges = verified.filter("other IS NOT NULL").select(F.col("id").alias("u"), F.col("other").alias("v"))
    roots = components(edges).withColumnRenamed("node", "id")
    links = verified.filter("links IS NOT NULL").groupBy("id").agg(F.sum("links").alias("links"))
    rooted = sets.select("id", "n", "least").join(roots, "id", "left").join(links, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    return members.select("doc_id", "id"), materialize(rooted.join(least, "root").select("id", "root", "class_id", "class_size", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows without those that repeat the block and set of the row before."""
    last = None
    for batch in batches:
        keep = []
        for key in zip(*[batch.column(k).to_pylist() for k in (0, 1, 2, 5)], strict=True):
            keep.append(key != last)
            last = key
        yield batch.filter(pa.array(keep, pa.bool_()))


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, class_id, class_size and n_links for each row."""
    members, sets = classes(docs, text, doc_id)
    out = members.join(sets, "id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, with their columns, of which one of each class stays: the one of least doc_id."""
    _, sets = classes(docs, text, doc_id)
    rows, name = packed(docs, text)
    keyed = with_key(rows, text, "id", [name])
    info = sets.filter("class_size > 1").select("id", "root", F.col("class_id").alias("least"))
    joined = keyed.join(info, "id", "left")
    alone = joined.filter(F.col("root").isNull())
    # a class's least doc_id can stand in several rows: one of them stays
    chosen = joined.filter(F.col("root").isNotNull() & F.col("least").eqNullSafe(F.col(name)[doc_id])).dropDuplicates(["root"])
    return alone.select(f"{name}.*").unionByName(chosen.select(f"{name}.*"))
