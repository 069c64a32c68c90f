"""Read-only tables over Parquet files that stay where they are: CREATE ... TABLE ... WITH (storage='folder', format='...').

A node table t is nodes_t.parquet, and a node's place is its row number. A relationship table r is either one flat file
(storage ends in .parquet: places of both ends, then properties) or indices_r.parquet (place of the far end, then properties)
with indptr_r.parquet, whose row i says where node i's relationships begin and whose last row is their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.errors import RuntimeFault
from knotwork.types import Ty, spark_type

#: Relationships of a node are counted out in stretches of this many.
STRETCH = 65_536
WHOLE = ("tinyint", "smallint", "int", "bigint")


def _read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as error:
        raise RuntimeFault(f"Cannot open {path}: {type(error).__name__}.") from None


def _checked(df: DataFrame, columns: dict[str, Ty], lead: int, path: str) -> list[str]:
    """The names of df's columns after the leading places, which must be those of the table."""
    names = df.columns
    if len(names) != lead + len(columns) or any(dict(df.dtypes)[n] not in WHOLE for n in names[:lead]):
        raise RuntimeFault(f"File {path} has {len(names)} columns, expected {lead + len(columns)}.")
    for n, (c, t) in zip(names[lead:], columns.items(), strict=True):
        if n.lower() != c.lower() or df.schema[n].dataType != spark_type(t):
            raise RuntimeFault(f"File {path} column {n} has type {df.schema[n].dataType.simpleString()}, expected {c} {t}.")
    return names


def nodes(spark: SparkSession, name: str, columns: dict[str, Ty], folder: str) -> DataFrame:
    path = f"{folder.rstrip('/')}/nodes_{name.lower()}.parquet"
    df = _read(spark, path)
    names = _checked(df, columns, 0, path)
    return df.select(F.col("_metadata.row_index").cast("bigint").alias("_off"), *[F.col(f"`{n}`").alias(c) for n, c in zip(names, columns, strict=True)])


def relationships(spark: SparkSession, name: str, columns: dict[str, Ty], storage: str, sources: int) -> DataFrame:
    place = F.col("_metadata.row_index").cast("bigint")
    if storage.lower().endswith(".parquet"):
        df = _read(spark, storage)
        names = _checked(df, columns, 2, storage)
        ends = [F.col(f"`{names[0]}`").cast("bigint").alias("_src"), F.col(f"`{names[1]}`").cast("bigint").alias("_dst"), place.alias("_off")]
        return df.select(*ends, *[F.col(f"`{n}`").alias(c) for n, c in zip(names[2:], columns, strict=True)])
    folder = storage.rstrip("/")
    path = f"{folder}/indices_{name.lower()}.parquet"
    df = _read(spark, path)
    names = _checked(df, columns, 1, path)
    starts_path = f"{folder}/indptr_{name.lower()}.parquet"
    starts = _read(spark, starts_path)
    if len(starts.columns) != 1:
        raise RuntimeFault(f"File {starts_path} must contain one integer column.")
    starts = starts.select(place.alias("i"), F.col(f"`{starts.columns[0]}`").cast("bigint").alias("s"))
    ranges = starts.join(starts.select((F.col("i") - 1).alias("i"), F.col("s").alias("e")), "i")
    seen = starts.agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("top"), F.min("s").alias("low")).first()
    if seen["n"] != sources + 1:
        raise RuntimeFault(f"File {starts_path} has {seen['n']} rows, expected {sources + 1} for its source node table.")
    if seen["low"] != 0 or ranges.filter("e < s").limit(1).count():
        raise RuntimeFault(f"File {starts_path} is not a rising vector of offsets that starts at zero.")
    if seen["top"] != df.count():
        raise RuntimeFault(f"Files {starts_path} and {path} disagree on the number of relationships.")
    parts = ranges.filter("e > s").select("i", "e", F.explode(F.sequence(F.col("s"), F.col("e") - 1, F.lit(STRETCH).cast("bigint"))).alias("p"))
    each = parts.select(F.col("i").alias("_src"), F.explode(F.sequence(F.col("p"), F.least(F.col("p") + STRETCH, F.col("e")) - 1)).alias("_off"))
    rows = df.select(place.alias("_off"), F.col(f"`{names[0]}`").cast("bigint").alias("_dst"), *[F.col(f"`{n}`").alias(c) for n, c in zip(names[1:], columns, strict=True)])
    return rows.join(each, "_off").select("_src", "_dst", "_off", *[F.col(f"`{c}`") for c in columns])
