"""Benchmark decontamination: approximate occurrences of test items in documents, by pigeonhole matching.

Text is folded (lower case; every run of characters that are neither letters nor digits becomes one space). An item of n
folded characters may be found with up to k = n // ERROR_EVERY edits. It is split into k + 1 pieces; an occurrence with at
most k edits holds at least one piece unchanged, so all exact hits of pieces (one pass of an Aho-Corasick automaton over the
whole document) are the candidates, and Myers' bit-parallel distance verifies the text around each.

The automaton of a shard of at most SHARD_CHARS item characters is broadcast; a larger benchmark takes several passes over
the documents, one shard after the other, so what is broadcast has a fixed bound.

Defined results: null texts and items count as empty; an item without letters or digits is found nowhere. Equal items are
all reported. An item under ERROR_EVERY characters must be found exactly, as whole words. A null item_id is no item. Repeated
rows count each. Empty tables give no hits. Input columns named like an added one are replaced.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import fresh, map_columns, materialize, packed, quoted

ERROR_EVERY = 16
SHARD_CHARS = 1_000_000
_OTHER = re.compile(r"[\W_]+")


def folded(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def edits(n: int) -> int:
    return n // ERROR_EVERY


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece): item in edits + 1 pieces of nearly equal length."""
    k = edits(len(item)) + 1
    cuts = [len(item) * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def least_distance(pattern: dict[str, int], m: int, text: str, limit: int) -> int:
    """The least edit distance between the pattern (m characters, as masks) and any part of text, or limit + 1 if above limit.

    Myers' bit vectors, the pattern in one integer; a match may start anywhere."""
    plus, minus, score, best = (1 << m) - 1, 0, m, m
    last, full = 1 << (m - 1), (1 << m) - 1
    for c in text:
        eq = pattern.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(xh | plus) & full
        down = plus & xh
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        if score < best:
            best = score
        up = up << 1
        plus = (down << 1 | ~(xv | up)) & full
        minus = up & xv & full
    return min(best, limit + 1)


class Matcher:
    """The items of a shard, ready to search."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t, masks(t)) for i, t in items if t]
        found: dict[str, list[tuple[int, int]]] = {}
        for at, (_, text, _) in enumerate(self.items):
            if edits(len(text)):
                for offset, piece in pieces(text):
                    found.setdefault(piece, []).append((at, offset))
            else:
                found.setdefault(f" {text} ", []).append((at, -1))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def search(self, text: str | None) -> list[tuple[int, int]]:
        """(item_id, edits) of the items found, by id."""
        if self.empty or not text:
            return []
        t = f" {folded(text)} "
        best: dict[int, int] = {}
        tried: dict[int, tuple[int, int]] = {}
        for end, (length, places) in self.automaton.iter(t):
            start = end + 1 - length
            for at, offset in places:
                item, pattern, bits = self.items[at]
                k = edits(len(pattern))
                if best.get(at, k + 1) == 0:
                    continue
                if offset < 0:
                    best[at] = 0
                    continue
                from_ = start - offset
                if from_ >= 0 and t.startswith(pattern, from_):
                    best[at] = 0
                    continue
                # from_ may fall from hit to hit: only a stretch that holds all of this alignment was verified for it
                least, most = max(0, from_ - k), from_ + len(pattern) + k
                low, high = tried.get(at, (0, -1))
                if low <= least and most <= high:
                    continue
                low, high = least, most + k
                tried[at] = low, high
                d = least_distance(bits, len(pattern), t[low:high], k)
                if d <= k:
                    best[at] = min(best.get(at, k + 1), d)
        return sorted((self.items[at][0], d) for at, d in best.items())


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item: str = "text", keep: list[str] | None = None, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """keep's columns (all but text by default), items (ids found, in order) and item_edits."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    added = {"items": "array<long>", "item_edits": "array<long>"}
    keep = [c for c in keep if c.lower() not in added]
    tests = benchmark.select(benchmark[quoted(item_id)].cast("long").alias("id"), F.coalesce(benchmark[quoted(item)], F.lit("")).alias("t")).filter("id IS NOT NULL")
    total = tests.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    shards = max(1, -(-2 * total // shard_chars)) if total > shard_chars else 1
    source, before = fresh(docs, "_text"), fresh(docs, "_items")
    out = docs.select(*[docs[quoted(c)] for c in keep], docs[quoted(text)].alias(source))
    for shard in range(shards):
        part = tests.filter(F.pmod(F.xxhash64("id", "t"), F.lit(shards)) == shard).collect()  # of bounded size
        shared = spark.sparkContext.broadcast(sorted((r["id"], folded(r["t"])) for r in part))

        def work(shared=shared):
            matcher = Matcher(shared.value)

            def of(texts: list) -> list[tuple]:
                hits = [matcher.search(t) for t in texts]
                return [([i for i, _ in h], [d for _, d in h]) for h in hits]

            return of

        last = shard == shards - 1
        if shard == 0:
            out = map_columns(out, source, keep if last else [*keep, source], added, work)
        else:
            prior = {c: fresh(out, f"{before}{k}") for k, c in enumerate(added)}
            out = out.withColumnsRenamed(prior)
            out = map_columns(out, source, [*keep, *prior.values()] if last else [*keep, source, *prior.values()], added, work)
            both = F.array_sort(F.arrays_zip(*[F.concat(prior[c], F.col(c)).alias(c) for c in added]))
            zipped = fresh(out, "_zipped")
            out = out.withColumn(zipped, both)
            out = out.withColumns({c: F.col(zipped)[c] for c in added}).drop(zipped, *prior.values())
        if not last:
            out = materialize(out)
            shared.unpersist()
    return out.select(*[out[quoted(c)] for c in keep], *added)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs, with their columns, in which no item is found."""
    rows, name = packed(docs, text)
    return find(rows, benchmark, text, keep=[name], **options).filter(F.size("items") == 0).select(f"{name}.*")
