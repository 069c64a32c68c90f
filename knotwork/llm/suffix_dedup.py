"""Removal of every byte covered by a string of LENGTH bytes that also starts anywhere else, by suffix arrays over shards.

1. Each window of LENGTH bytes is keyed by a minimizer: of the hashes of its GRAM-byte pieces, the least. Equal windows
   have equal minimizers, so they meet under one key. Neighbouring windows mostly share theirs: a maximal run of windows
   with one minimizer is an anchor (key, place, number of windows), about one for every 85 bytes.
2. Keys with one anchor, which doesn't repeat inside itself, can't hold a repeated window and go. So do most bytes.
3. Anchors are cut into pieces: windows with one minimizer, about as far before it (bands of WIDTHS[0] offsets). Equal windows
   have equal offsets, so they are in the same band; and all windows of a band share a core of bytes around the minimizer.
   So equal windows only meet in pieces of one group (core, band). Pieces found twice are covered whole; one of each sort
   goes on, and only if its group holds another sort and one that isn't covered yet.
4. Groups go to shards of about SHARD_BYTES. A shard's suffix array is made by induced sorting (suffix_arrays.py), and
   permuted common prefixes of LENGTH or more mark the repeated windows.
5. A group larger than a shard is cut again, by the next of WIDTHS: narrower bands share longer cores, so the group falls
   apart. At width 1 a core is the window itself, and a group has one sort. So no shard grows with a frequent passage.
   All counts are aggregated before the shuffle, and rows meet aggregates only in joins with one row for each sort.
6. Ranges go back to their texts. Texts found twice and of LENGTH bytes or more are covered whole.

Nothing is dropped, capped or sampled. Texts are told apart by 128 bits of hash, pieces by 64 bits within their group.

Defined results: a null text counts as empty; texts shorter than LENGTH lose nothing (their sha256 is that of all their
bytes). Repeated rows are copies of each other and so covered, whatever their ids. An empty table gives an empty result.
Only doc_id (any type) and the text are read; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import bounded_batches, discard, materialize, quoted
from knotwork.llm.shingles import mixed, power_tables
from knotwork.llm.suffix_arrays import common_prefixes, suffix_array

LENGTH = 200
GRAM = 32
SHARD_BYTES = 1 << 20
#: Bands of offsets, from one level of cutting to the next; the last must be 1.
WIDTHS = (85, 13, 1)
_FAR = LENGTH - GRAM
_SEGMENT = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)
_B = 0x9E3779B97F4A7C15
_EMPTY = hashlib.sha256(b"").hexdigest()


def least(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each window of raw: the place of its leftmost least piece, and that piece's hash. raw: under 2**21 bytes."""
    h = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    size, factor = 1, _B
    with np.errstate(over="ignore"):
        while size < GRAM:
            h = h[:-size] * np.uint64(factor) + h[size:]
            factor = factor * factor & 0xFFFFFFFFFFFFFFFF
            size *= 2
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    m = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, size = LENGTH - GRAM + 1, 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
    place = (m & _PLACE).astype(np.int64)
    return place, h[place]


def anchors(raw: bytes) -> list[np.ndarray]:
    """Keys (int64) and packed anchors: first window << 30 | windows - 1 << 9 | offset of the first << 1 | whether the least piece moves."""
    keys, packed = [], []
    windows = len(raw) - LENGTH + 1
    for at in range(0, max(0, windows), _SEGMENT):
        place, value = least(raw[at : min(at + _SEGMENT, windows) + LENGTH - 1])
        change = np.concatenate(([True], value[1:] != value[:-1]))
        first = np.flatnonzero(change)
        count = np.diff(np.append(first, len(value)))
        moved = np.concatenate(([0], np.cumsum(place[1:] != place[:-1])))
        moves = moved[first + count - 1] > moved[first]
        keys.append(value[first].view(np.int64))
        packed.append((at + first) << 30 | (count - 1) << 9 | (place[first] - first) << 1 | moves)
    return [np.concatenate(keys), np.concatenate(packed)] if keys else [np.zeros(0, np.int64)] * 2


def runs(raw: bytes, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and offset of the first, of the runs of windows with one least piece in the anchors."""
    start, count, offset = packed >> 30, ((packed >> 9) & ((1 << 21) - 1)) + 1, (packed >> 1) & 255
    still = (packed & 1) == 0
    parts = [(start[still], count[still], offset[still])]
    for s, n in zip(start[~still].tolist(), count[~still].tolist(), strict=True):
        place, _ = least(raw[s : s + n - 1 + LENGTH])
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        parts.append((s + first, np.diff(np.append(first, n)), place[first] - first))
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True))


def split(start: np.ndarray, count: np.ndarray, offset: np.ndarray, width: int) -> list[np.ndarray]:
    """Runs cut at the borders of bands: first window, number of windows, offset of the first, band."""
    high = offset // width
    parts = high - (offset - count + 1) // width + 1
    which = np.repeat(np.arange(len(start)), parts)
    band = high[which] - (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts))
    top = np.minimum(offset[which], band * width + width - 1)
    bottom = np.maximum((offset - count + 1)[which], band * width)
    return [start[which] + offset[which] - top, top - bottom + 1, top, band]


def packed_pieces(start: np.ndarray, count: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return start << 20 | (count - 1) << 10 | offset


def unpacked(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return q >> 20, ((q >> 10) & 1023) + 1, q & 1023


def pieces(raw: bytes, start: np.ndarray, count: np.ndarray, offset: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed pieces of the runs, the hash of each one's group (core and band), and the hash of its bytes."""
    start, count, offset, band = split(start, count, offset, width)
    order = np.argsort(start, kind="stable")
    start, count, offset, band = start[order], count[order], offset[order], band[order]
    low = start + offset - band * width  # the core's bytes
    high = start + offset - np.minimum(band * width + width - 1, _FAR) + LENGTH
    group = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        salt = (band.astype(np.uint64) * np.uint64(256) + np.uint64(width)) * np.uint64(0xD6E8FEB86659FD93)
        for at in range(0, len(raw), _SEGMENT):
            a, b = np.searchsorted(start, [at, at + _SEGMENT])
            if a == b:
                continue
            part = np.frombuffer(raw, np.uint8, min(len(raw) - at, _SEGMENT + 2 * LENGTH), at)
            power, inverse = power_tables(len(part))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)])))
            x, y = low[a:b] - at, high[a:b] - at
            group[a:b] = mixed((sums[y] - sums[x]) * inverse[x] + salt[a:b])
    end = start + count - 1 + LENGTH
    own = np.fromiter((xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))
    return packed_pieces(start, count, offset), group.view(np.int64), own.view(np.int64)


def repeated_windows(found: list[bytes]) -> list[np.ndarray]:
    """For each piece, whether each of its windows is also found elsewhere in the list, by suffix array."""
    sizes = np.array([len(x) for x in found])
    t = np.frombuffer(b"\0".join(found) + b"\0\0", np.uint8).astype(np.int32) + 1
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    separators = begin[1:] - 1
    t[separators] = 1  # one separator symbol, below all bytes (which start at 1 + 1)
    t += 1
    t[separators] = 1
    t[-2] = 1
    t[-1] = 0
    sa = suffix_array(t)
    prior, length = common_prefixes(t, sa, LENGTH)
    room = np.repeat(begin + sizes, sizes + 1) - np.arange(int((sizes + 1).sum()))
    starts_window = np.zeros(len(t), bool)
    starts_window[: len(room)] = room >= LENGTH
    pairs = np.flatnonzero((length >= LENGTH) & starts_window)
    twice = np.zeros(len(t), bool)
    twice[pairs] = True
    twice[prior[pairs]] = True
    twice &= starts_window
    return [twice[b : b + s - LENGTH + 1] for b, s in zip(begin.tolist(), sizes.tolist(), strict=True)]


def ranges(flags: np.ndarray) -> list[int]:
    """Covered bytes of a piece, as flat starts and ends, from flags for its windows."""
    step = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    first, last = np.flatnonzero(step > 0), np.flatnonzero(step < 0)
    return np.stack([first, last - 1 + LENGTH], axis=1).ravel().tolist()


def _rows(names: list[str], kinds: list, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _bytes(value: str) -> bytes:
    return value.encode("utf-8", "surrogatepass")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set = set()  # copies in this task's own rows
    for batch in batches:
        out: list[list] = [[], [], [], []]
        held = 0
        for i in range(batch.num_rows):
            key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
            if key in seen:
                continue
            seen.add(key)
            k, p = anchors(_bytes(batch.column(2)[i].as_py()))
            out[0].append(np.full(len(k), key[0]))
            out[1].append(np.full(len(k), key[1]))
            out[2].append(k)
            out[3].append(p)
            held += len(k)
            if held > 200_000:
                yield _rows(["k1", "k2", "h", "p"], [pa.int64()] * 4, [np.concatenate(c) for c in out])
                out, held = [[], [], [], []], 0
        if held:
            yield _rows(["k1", "k2", "h", "p"], [pa.int64()] * 4, [np.concatenate(c) for c in out])


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key (two columns) wasn't seen before in the task."""
    seen: set = set()
    for batch in batches:
        keep = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keep.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ranges (by start, ends too) as maximal ones."""
    if not len(start):
        return start, end
    first = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return start[first], end[np.append(first[1:], len(end)) - 1]


_PIECES = "k1 long, k2 long, q long, g long, f long, twice boolean, a long, b long"
_KINDS = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 2


def _pieces_at(width: int, cut):
    """A function of batches (k1, k2, text, found): rows of _PIECES, for each sort of piece of a text one (a, b null), and one
    for each maximal range of what a text's repeated pieces cover (only k1, k2, a, b)."""

    def of(raw: bytes, found: np.ndarray) -> list[pa.Array]:
        q, g, f = pieces(raw, *cut(raw, found), width)
        with np.errstate(over="ignore"):
            sort = g.view(np.uint64) * np.uint64(_B) + f.view(np.uint64)
        _, first, which, times = np.unique(sort, return_index=True, return_inverse=True, return_counts=True)
        start, count, _ = unpacked(q[times[which] > 1])
        a, b = merged(start, start + count - 1 + LENGTH)
        none = [pa.nulls(len(first), pa.int64())] * 2
        here = [q[first], g[first], f[first], times > 1]
        return [pa.concat_arrays([pa.array(x), pa.nulls(len(a), k)]) for x, k in zip(here, _KINDS[2:6], strict=True)] + [pa.concat_arrays([n, pa.array(x)]) for n, x in zip(none, (a, b), strict=True)]

    names = [x.split(" ")[0] for x in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[pa.Array]] = [[] for _ in names]
            held = 0
            for i in range(batch.num_rows):
                k1, k2, text = (batch.column(c)[i].as_py() for c in range(3))
                made = of(_bytes(text), batch.column(3)[i].values.to_numpy(zero_copy_only=False))
                n = len(made[0])
                for c, x in zip(out, [pa.array(np.full(n, k1)), pa.array(np.full(n, k2)), *made], strict=True):
                    c.append(x)
                held += n
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in out], names=names)
                    out, held = [[] for _ in names], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in out], names=names)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, g, q, lone, bytes) for each wanted piece of each text."""
    names, kinds = ["k1", "k2", "g", "q", "lone", "bytes"], [pa.int64()] * 4 + [pa.bool_(), pa.binary()]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for i in range(batch.num_rows):
            k1, k2, text, wanted = (c[i].as_py() for c in batch.columns)
            raw = _bytes(text)
            for x in wanted:
                start = x["q"] >> 20
                for c, v in zip(out, (k1, k2, x["g"], x["q"], x["lone"], raw[start : start + ((x["q"] >> 10) & 1023) + LENGTH]), strict=True):
                    c.append(v)
            if len(out[0]) > 20_000:
                yield _rows(names, kinds, out)
                out = [[] for _ in names]
        yield _rows(names, kinds, out)


def _sorted_shard(shard: pa.Table) -> pa.Table:
    """(k1, k2, a, b) of a shard: groups are put together up to SHARD_BYTES, and one suffix array is made of those at a time.

    Only pieces found once (lone) have ranges to tell: the others are covered already, and stand here as their partners."""
    groups, raws, lone = shard["g"].to_pylist(), shard["bytes"].to_pylist(), shard["lone"].to_pylist()
    places = list(zip(shard["k1"].to_pylist(), shard["k2"].to_pylist(), shard["q"].to_pylist(), strict=True))
    out: list[list[int]] = [[], [], [], []]
    batch: list[int] = []
    held = 0

    def work() -> None:
        for i, flags in zip(batch, repeated_windows([raws[i] for i in batch]), strict=True):
            if lone[i] and flags.any():
                k1, k2, q = places[i]
                found = ranges(flags)
                for a, b in zip(found[::2], found[1::2], strict=True):
                    for c, v in zip(out, (k1, k2, (q >> 20) + a, (q >> 20) + b), strict=True):
                        c.append(v)

    order = sorted(range(len(groups)), key=lambda i: (groups[i], places[i]))
    for at, i in enumerate(order):
        if held > SHARD_BYTES and groups[i] != groups[order[at - 1]]:
            work()
            batch, held = [], 0
        batch.append(i)
        held += len(raws[i])
    if batch:
        work()
    return pa.table([pa.array(c, pa.int64()) for c in out], names=["k1", "k2", "a", "b"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, n_removed, n_spans, kept_sha256) for each text and its covered ranges."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256).to_pydict()
            out: list[list] = [[] for _ in range(5)]
            for k1, k2, text, covered in zip(part["k1"], part["k2"], part["text"], part["covered"], strict=True):
                raw, kept, upto, spans = _bytes(text), hashlib.sha256(), 0, 0
                removed = last = 0
                last = -1
                for a, b in sorted((x["a"], x["b"]) for x in covered):
                    if a > last:
                        kept.update(raw[upto:a])
                        spans += 1
                        removed += b - a
                        last = upto = b
                    elif b > last:
                        removed += b - last
                        last = upto = b
                kept.update(raw[upto:])
                for c, v in zip(out, (k1, k2, removed, spans, kept.hexdigest()), strict=True):
                    c.append(v)
            yield _rows(["k1", "k2", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()], out)


def _level(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the pieces of one level: ranges (k1, k2, a, b) of those found twice; and those wanted (k1, k2, q, g, lone), one of
    each sort of a group that holds several and one that isn't covered: of groups that fit into a shard, and of larger ones."""
    place = F.xxhash64("k1", "k2", "q")
    size = F.shiftright("q", 10).bitwiseAND(1023) + LENGTH
    only = [F.min(c).alias(c) for c in ("k1", "k2", "q")]  # the place, where there is one
    sorts = rows.groupBy("g", "f").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.max("twice").alias("twice"), F.max(size).alias("size"), *only)
    sorts = materialize(sorts.select("g", "f", "x", ((F.col("x") != F.col("y")) | F.col("twice")).alias("many"), "size", "k1", "k2", "q"))
    groups = sorts.groupBy("g").agg(F.count(F.lit(1)).alias("sorts"), F.count_if(~F.col("many")).alias("lone"), F.sum("size").alias("bytes"))
    groups = materialize(groups.filter("sorts > 1 AND lone > 0").select("g", (F.col("bytes") > SHARD_BYTES).alias("large")))
    sorts = materialize(sorts.join(groups, "g", "left").filter("many OR large IS NOT NULL"))
    again = materialize(rows.select("k1", "k2", "q", "g", "f").join(sorts.filter("many").select("g", "f", "x", "large"), ["g", "f"]))
    start, end = F.shiftright("q", 20), F.shiftright("q", 20) + F.shiftright("q", 10).bitwiseAND(1023) + LENGTH
    whole = again.select("k1", "k2", start.alias("a"), end.alias("b"))
    wanted = sorts.filter("NOT many").select("k1", "k2", "q", "g", F.lit(True).alias("lone"), "large")
    wanted = wanted.unionByName(again.filter(F.col("large").isNotNull() & (F.col("x") == place)).select("k1", "k2", "q", "g", F.lit(False).alias("lone"), "large"))
    return whole, wanted.filter("NOT large").drop("large"), wanted.filter("large").drop("large")


def _shards(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(k1, k2, a, b): what the suffix arrays of the wanted pieces tell."""
    listed = wanted.groupBy("k1", "k2").agg(F.collect_set(F.struct("g", "q", "lone")).alias("wanted"))
    cut = texts.select("k1", "k2", "text").join(listed, ["k1", "k2"]).select("k1", "k2", "text", "wanted")
    cut = materialize(cut.mapInArrow(_cut, "k1 long, k2 long, g long, q long, lone boolean, bytes binary"))
    total = cut.agg(F.sum(F.length("bytes")).alias("n")).first()["n"] or 0  # one number
    shards = max(1, -(-total // SHARD_BYTES))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(shards)))
    return materialize(dealt.groupBy("shard").applyInArrow(lambda t: _sorted_shard(t), "k1 long, k2 long, a long, b long"))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 for each row."""
    bounded_batches(docs.sparkSession)
    t = F.coalesce(docs[quoted(text)], F.lit(""))
    keyed = docs.select(docs[quoted(doc_id)].alias("doc_id"), t.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    narrow = materialize(keyed.select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    long = keyed.filter(F.octet_length("text") >= LENGTH).select("k1", "k2", "text")

    prints = materialize(long.mapInArrow(_fingerprints, "k1 long, k2 long, h long, p long"))
    place = F.xxhash64("k1", "k2", "p")
    several = materialize(prints.groupBy("h").agg(F.min(place).alias("x"), F.max(place.bitwiseXOR(F.col("p").bitwiseAND(1))).alias("y")).filter("x <> y").select("h"))
    suspects = prints.join(several, "h", "left_semi").groupBy("k1", "k2").agg(F.collect_set("p").alias("found"))
    texts = long.mapInArrow(_first_of_task, "k1 long, k2 long, text string").join(suspects, ["k1", "k2"])
    texts = materialize(texts.dropDuplicates(["k1", "k2"]))
    discard(prints, several)

    covered, source, cut = [], texts, runs
    for width in WIDTHS:
        rows = materialize(source.select("k1", "k2", "text", "found").mapInArrow(_pieces_at(width, cut), _PIECES))
        covered.append(rows.filter("q IS NULL").select("k1", "k2", "a", "b"))
        whole, wanted, large = _level(rows.filter("q IS NOT NULL"))
        covered += [whole, _shards(wanted, texts)]
        large = materialize(large.groupBy("k1", "k2").agg(F.collect_set("q").alias("found")))
        if large.isEmpty():
            break
        source, cut = texts.select("k1", "k2", "text").join(large, ["k1", "k2"]), lambda raw, q: unpacked(q)

    every = covered[0]
    for more in covered[1:]:
        every = every.unionByName(more)
    by_text = every.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("covered"))
    kept = texts.select("k1", "k2", "text").join(by_text, ["k1", "k2"]).mapInArrow(_kept, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string")
    kept = kept.select("k1", "k2", F.col("n_removed").alias("r"), F.col("n_spans").alias("s"), F.col("kept_sha256").alias("kept"))
    copies = narrow.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
    found = materialize(copies.join(kept, ["k1", "k2"], "left"))
    out = narrow.join(found, ["k1", "k2"], "left")
    all_of_it = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(all_of_it, F.col("n_bytes")).otherwise(F.coalesce("r", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_of_it, 1).otherwise(F.coalesce("s", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_of_it, F.lit(_EMPTY)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
