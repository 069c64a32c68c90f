"""Tables written to the folder that driver and executors share, to cut lineage between rounds and keep writes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knotwork.errors import ConfigurationError


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset and there are no other machines."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ConfigurationError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        folder = tempfile.mkdtemp(prefix="knotwork-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """df as a Parquet table: computed once, read back as often as needed, whatever executor is lost. Names are kept."""
    path = f"{shared_dir(df.sparkSession)}/knotwork-{uuid.uuid4().hex}"
    safe = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    safe = safe.withColumns({f"c{k}": F.col(f"c{k}").cast("string") for k, f in enumerate(df.schema) if f.dataType.simpleString() == "void"})
    if not df.columns:
        return df.sparkSession.range(df.count()).select()
    safe.write.parquet(path)
    return df.sparkSession.read.schema(safe.schema).parquet(path).toDF(*df.columns)


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """df, materialized, with a column of the row's number from 0, and the number of rows.

    Each partition numbers its own rows, and a table with a row for each partition tells how many come before."""
    own = materialize(df.withColumn(name, F.monotonically_increasing_id()))
    counts = materialize(own.groupBy(F.shiftright(name, 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n")))
    parts, total = counts.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if parts <= 1:
        return own.withColumn(name, F.col(name).bitwiseAND((1 << 33) - 1)), total or 0
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    joined = own.withColumn("_part", F.shiftright(name, 33)).join(before, "_part")
    return joined.withColumn(name, F.col("_before") + F.col(name).bitwiseAND((1 << 33) - 1)).select(*own.columns), total
