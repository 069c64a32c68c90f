"""Mixing sources to target weights, with DataFrame functions only.

Sources in code-point order (null last) get the weights 5, 2, 1, repeating. The targets share the whole size of the
input by weight; a target stops at MAX_REPEATS times its source's size and the excess is shared by weight among the
others until none is above (water filling: target = min(cap, level * weight)). Inside a source, documents are ordered
by a hash-random key; a distributed prefix sum of sizes then cuts at the source's exact budget: whole epochs first, and
the rest from the front of the order, the last document in part.

The prefix sum has two levels: keys are dealt into ranges of about max(200, sqrt(documents)) documents inside each
source (the keys are uniform, so fixed ranges are even, whatever the source's share of all rows), one window sums inside
a range and another over the ranges' totals. Only the table of sources, one row each, is seen as a whole.

Defined results: a null text has size 0 and takes 0; a null doc_id is a key of its own; repeated rows count each; rows of
equal key are ordered by size, and rows equal in both are interchangeable. A source of size 0 has target 0. An empty
table gives an empty result. Input columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.llm.common import broadcast_up_to, materialize, quoted

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix"
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sized: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row for each source: source, sid, n_docs, source_size, target, epochs, rest."""
    sums = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    ranked = sums.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")).cast("long")
    capped = ranked.withColumns({"w": weight, "cap": max_repeats * F.col("source_size")})
    order = W.orderBy(F.col("cap") / F.col("w"), "sid")
    every, before = W.partitionBy(), order.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    levels = capped.withColumns({"level": level, "pos": F.row_number().over(order)})
    open_at = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("pos", "level"))).over(every)
    full = levels.withColumn("at", open_at)
    target = F.when(F.col("pos") < F.col("at.pos"), F.col("cap").cast("double")).otherwise(F.least(F.col("at.level") * F.col("w"), F.col("cap").cast("double")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    out = full.withColumn("target", target).withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    return out.select("source", "sid", "n_docs", "source_size", "target", "epochs", "rest")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = SEED, **options) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words of the document that the mix takes, repeats counted)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[quoted(doc_id)].cast("string"), F.lit("null"))))
    size = F.coalesce(F.regexp_count(docs[quoted(text)], F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialize(docs.select(docs[quoted(doc_id)].alias("doc_id"), docs[quoted(source)].alias("source"), size.alias("size"), key.alias("key")))
    sources = broadcast_up_to(materialize(targets(sized, **options).coalesce(1)), BROADCAST_SOURCES).withColumnRenamed("source", "_source")
    each = sized.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    ranges = F.ceil(F.col("n_docs") / F.greatest(F.lit(200.0), F.sqrt("n_docs")))
    dealt = each.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2**32 * ranges).cast("long"))
    inside = W.partitionBy("sid", "range").orderBy("key", "size").rowsBetween(W.unboundedPreceding, 0)
    totals = dealt.groupBy("sid", "range").agg(F.sum("size").alias("sum"))
    offset = F.coalesce(F.sum("sum").over(W.partitionBy("sid").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("sid", "range", offset.alias("offset"))
    cut = dealt.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["sid", "range"])
    before = F.col("offset") + F.col("upto") - F.col("size")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    return cut.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


#: DuckDB SQL of the same mix over documents.
ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM {documents}),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sums),
capped AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM ranked),
levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, sid) AS pos,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM capped),
first_open AS (SELECT pos AS open_pos, level AS open_level FROM levels WHERE level * w <= cap ORDER BY pos LIMIT 1),
targets AS (
  SELECT *, CASE WHEN pos < open_pos THEN CAST(cap AS DOUBLE) ELSE least(open_level * w, CAST(cap AS DOUBLE)) END AS target
  FROM levels, first_open),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM targets),
ordered AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized)
SELECT o.doc_id, o.size, b.source_size, b.target,
  CAST(b.epochs * o.size + greatest(0, least(o.size, CAST(floor(b.target) AS BIGINT) - b.epochs * b.source_size - o.before)) AS BIGINT) AS taken
FROM ordered o JOIN budgets b ON o.source IS NOT DISTINCT FROM b.source
"""
