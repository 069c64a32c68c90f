"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrow types of the fields that operators add.
ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}


ROWS_PER_BATCH = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode, where there are no other machines,
    a folder of our own takes its place if it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="knotwork-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, **options) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors, is reused without work."""
    path = f"{shared_dir(df.sparkSession)}/knotwork-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._knotwork_path = path
    return made


def discard(*made: DataFrame) -> None:
    """Delete what materialize() wrote for these; nothing that is still to run may read them."""
    for df in made:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._knotwork_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def broadcast_up_to(df: DataFrame, max_rows: int) -> DataFrame:
    """df (materialized, so that counting is cheap), marked for broadcast only if it has at most max_rows rows; else Spark joins it by a shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def without(df: DataFrame, added: list[str]) -> list[str]:
    """df's columns but those whose names clash (in any case) with added ones, which take their place."""
    taken = {x.lower() for x in added}
    return [c for c in df.columns if c.lower() not in taken]


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores put before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def map_columns(df: DataFrame, source: str, keep: list[str], added: dict[str, str], work: Callable[[], Callable[[list], list[tuple]]]) -> DataFrame:
    """keep's columns of df and the added fields, which a Python function makes from column `source`.

    work() runs once in each task and returns the function that takes a list of values and returns a tuple per value.
    Rows are handed over in small slices, so that long texts don't pile up in the worker."""
    bounded_batches(df.sparkSession)
    names = [c for c in keep if c.lower() not in {a.lower() for a in added}]
    hidden = fresh(df, "_in")
    got = df.select(*[df[quoted(c)] for c in names], df[quoted(source)].alias(hidden))
    schema = T.StructType([got.schema[c] for c in names] + [T.StructField(k, T._parse_datatype_string(v)) for k, v in added.items()])
    kinds = [ARROW[v] for v in added.values()]
    keys = list(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = work()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                part = whole.slice(at, 1024)
                made = function(part.column(len(names)).to_pylist())
                columns = list(zip(*made, strict=True)) if made else [()] * len(keys)
                arrays = [part.column(i) for i in range(len(names))] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names + keys)

    return got.mapInArrow(run, schema)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of ROWS_PER_BATCH rows at most in this session: 10,000 long texts at once are too much for a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def packed(docs: DataFrame, *needed: str) -> tuple[DataFrame, str]:
    """docs as one struct column beside the needed ones, so that no column of docs can clash with an added one; and its name."""
    name = "_row"
    return docs.select(F.struct(*[docs[quoted(c)] for c in docs.columns]).alias(name), *[docs[quoted(c)] for c in needed]), name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
