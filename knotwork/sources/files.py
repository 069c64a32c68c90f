"""LOAD FROM and COPY FROM files, and COPY TO.

Files are read by Spark's readers, so any store that Spark reads will do; local patterns and search paths are resolved on
the driver. Only a sample of a CSV file is looked at to find its dialect and types."""

from __future__ import annotations

import csv
import glob
import io
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.errors import BinderError, CopyError, IOFault
from knotwork.functions.expr import E, cast
from knotwork.types import BOOL, DATE, DOUBLE, INT64, STRING, TIMESTAMP, Ty, engine_type, spark_type

OPTIONS = {"HEADER", "DELIM", "DELIMITER", "QUOTE", "ESCAPE", "SKIP", "AUTODETECT", "AUTO_DETECT", "PARALLEL", "IGNORE_ERRORS", "LIST_UNBRACED", "NULL_STRINGS", "SAMPLE_SIZE", "FILE_FORMAT", "FROM", "TO"}


def resolve(session, files: list[str]) -> list[str]:
    """Patterns, ~ and the search path made into paths; paths with a scheme are Spark's own."""
    out = []
    for f in files:
        if "://" in f:
            out.append(f)
            continue
        f = os.path.expanduser(f)
        tries = [f, *(os.path.join(d, f) for d in str(session.settings.get("file_search_path", "")).split(",") if d)]
        found = next((sorted(glob.glob(x)) for x in tries if glob.glob(x)), [])
        if not found:
            raise BinderError(f"No file found that matches the pattern: {f}.")
        out += found
    return out


def format_of(path: str, options: dict) -> str:
    if "FILE_FORMAT" in options:
        return str(options["FILE_FORMAT"]).lower()
    base = path[:-3] if path.endswith(".gz") else path
    ext = os.path.splitext(base)[1].lower().lstrip(".")
    return {"tsv": "csv", "txt": "csv"}.get(ext, ext)


def read_files(session, files: list[str], options: dict, columns: list[tuple[str, Ty]] | None) -> tuple[DataFrame, dict[str, Ty]]:
    unknown = {k for k in options} - OPTIONS
    if unknown:
        raise BinderError(f"Unrecognized csv parsing option: {sorted(unknown)[0]}.")
    paths = resolve(session, files)
    kind = format_of(paths[0], options)
    if kind == "parquet":
        return _named(session.spark.read.parquet(*paths), columns)
    if kind == "npy":
        return _named(read_npy(session, paths), columns)
    if kind in ("json", "jsonl", "ndjson"):
        return _named(session.spark.read.option("multiLine", kind == "json").json(paths), columns)
    if kind != "csv":
        raise BinderError(f"Cannot load from file type {kind}.")
    return read_csv(session, paths, options, columns)


def _named(df: DataFrame, columns: list[tuple[str, Ty]] | None) -> tuple[DataFrame, dict[str, Ty]]:
    have = {f.name: engine_type(f.dataType) for f in df.schema}
    if columns is None:
        return df, have
    if len(columns) != len(have):
        raise BinderError(f"Number of columns mismatch. Expected {len(columns)} but got {len(have)}.")
    made = [cast(E(F.col(f"`{a}`"), have[a]), t, True).col.alias(n) for a, (n, t) in zip(have, columns, strict=True)]
    return df.select(*made), dict(columns)


def _kind_of(values: list[str]) -> Ty:
    """The narrowest type that all sampled values have."""
    def all_(f) -> bool:
        try:
            return all(f(v) is not False for v in values)
        except (ValueError, TypeError):
            return False

    import datetime

    if not values:
        return STRING
    if all(re.fullmatch(r"-?(0|[1-9]\d{0,18})", v) for v in values):
        return INT64
    if all_(float) and not any(v.lower() in ("nan", "inf") or "_" in v for v in values):
        return DOUBLE
    if all(v.lower() in ("true", "false") for v in values):
        return BOOL
    if all(re.fullmatch(r"\d{4}-\d{1,2}-\d{1,2}", v) for v in values) and all_(lambda v: datetime.date(*map(int, v.split("-")))):
        return DATE
    if all(re.fullmatch(r"\d{4}-\d\d-\d\d[ T]\d\d:\d\d(:\d\d(\.\d+)?)?", v) for v in values):
        return TIMESTAMP
    if all(re.fullmatch(r"\[.*\]", v, re.S) for v in values):
        inner = [x.strip() for v in values for x in v[1:-1].split(",") if x.strip()]
        return Ty("LIST", (_kind_of(inner),))
    return STRING


def read_csv(session, paths: list[str], options: dict, columns: list[tuple[str, Ty]] | None) -> tuple[DataFrame, dict[str, Ty]]:
    spark = session.spark
    sample_size = int(options.get("SAMPLE_SIZE", 256)) or 256
    skip = int(options.get("SKIP", 0))
    head = [r[0] for r in spark.read.text(paths[0]).limit(sample_size + skip + 1).collect()][skip:]  # a bounded sample
    detect = options.get("AUTO_DETECT", options.get("AUTODETECT", True))
    delim, quote, escape = options.get("DELIM", options.get("DELIMITER")), options.get("QUOTE"), options.get("ESCAPE")
    if delim is None:
        delim = "," if not detect or not head else max(",|;\t", key=lambda d: (min((_width(x, d) for x in head), default=1), -",|;\t".index(d)))
    delim = delim.replace("\\t", "\t")
    quote = '"' if quote is None else quote
    escape = escape if escape is not None else ('"' if any('""' in x for x in head) else "\\")
    rows = list(csv.reader(io.StringIO("\n".join(head)), delimiter=delim, quotechar=quote or None, doublequote=escape == '"', escapechar=None if escape == '"' else escape))
    rows = [r for r in rows if r]
    if options.get("HEADER"):  # each part of a folder has its own
        rows = rows[:1] + [r for r in rows[1:] if r != rows[0]]
    width = max((len(r) for r in rows), default=len(columns or []))
    nulls = options.get("NULL_STRINGS", [""])
    nulls = [nulls] if isinstance(nulls, str) else nulls
    sampled = [_kind_of([r[k] for r in rows[1:] if k < len(r) and r[k] not in nulls]) for k in range(width)]
    header = options.get("HEADER")
    if header is None:
        header = False
        if detect and len(rows) > 1 and columns is None:
            header = any(t.name != "STRING" and _kind_of([v]).name == "STRING" for t, v in zip(sampled, rows[0], strict=False))
        elif detect and columns is not None and rows:
            header = any(t.name != "STRING" and t.numeric and _kind_of([v]).name == "STRING" for (_, t), v in zip(columns, rows[0], strict=False))
    if columns is not None:
        if rows and width != len(columns) and not options.get("IGNORE_ERRORS"):
            raise CopyError(f"Number of columns mismatch. Expected {len(columns)} but got {width}.")
        wanted = list(columns)
    else:
        names = rows[0] if header else [f"column{k}" for k in range(width)]
        if not header:
            sampled = [_kind_of([r[k] for r in rows if k < len(r) and r[k] not in nulls]) for k in range(width)]
        wanted = list(zip(names, sampled, strict=False))
    raw = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(wanted))])
    lenient, whole = bool(options.get("IGNORE_ERRORS")), not options.get("PARALLEL", True)
    parsing = {"sep": delim, "quote": quote, "escape": escape, "mode": "PERMISSIVE" if lenient else "FAILFAST", "columnNameOfCorruptRecord": "_bad", "nullValue": "\u0000none", "emptyValue": ""}
    if whole and (skip or lenient):
        df = _whole_rows(spark, paths, skip + bool(header), delim, quote, escape, len(wanted), lenient)
    elif skip or lenient:  # line by line, for places in files count
        lines = numbered_lines(spark, paths).filter((F.col("_line") > skip + bool(header)) & (F.trim("value") != ""))
        shape = raw.add("_bad", T.StringType()) if lenient else raw
        df = lines.withColumn("_row", F.from_csv("value", shape.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), parsing)).select("_file", "_line", "value", "_row.*")
    else:
        df = spark.read.schema(raw).options(header=bool(header), multiLine=whole, enforceSchema=True, **parsing).csv(paths)
    made, bad, why = [], F.lit(False), F.lit(None).cast("string")
    for k, (n, t) in enumerate(wanted):
        c = F.col(f"c{k}")
        c = F.when(~c.isin(*nulls) if nulls else F.lit(True), c)
        e = cast(E(c, STRING), t, True)
        if options.get("IGNORE_ERRORS") and not t.args and t.name not in ("STRING", "INTERVAL", "UUID", "BLOB", "JSON"):
            tried = F.trim(c).try_cast(spark_type(t))
            wrong = c.isNotNull() & tried.isNull()
            bad = bad | wrong
            why = F.coalesce(why, F.when(wrong, F.concat(F.lit('Conversion exception: Cast failed. Could not convert "'), c, F.lit(f'" to {t}.'))))
            e = E(tried, t)
        made.append(e.col.alias(n))
    if lenient:
        good = F.col("_bad").isNull() & ~bad
        found = df.filter(~good).select(F.when(F.col("_bad").isNull(), why).alias("why"), "_file", "_line", "value")
        for r in found.orderBy("_file", "_line").limit(session.room_for_warnings()).collect():  # a bounded number
            message = r["why"] or f"Copy exception: expected {len(wanted)} values per row, but got {n if (n := _width(r['value'], delim)) < len(wanted) else 'more'}."
            session.warn(message, re.sub("^file:/+", "/", r["_file"]), r["_line"], r["value"])
        df = df.filter(good)
    return df.select(*made), dict(wanted)


def numbered_lines(spark, paths: list[str]) -> DataFrame:
    """(value, _file, _line): the lines of files with their numbers from 1. Blocks of a file are read by as many tasks as ever; a
    table with a row for each block tells how many lines come before."""
    from pyspark.sql import Window as W

    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_file").orderBy("_block")) - F.col("_n") - F.col("_first") + 1
    return lines.join(blocks.select("_file", "_block", before.alias("_shift")), ["_file", "_block"]).select("value", "_file", (F.col("_id") + F.col("_shift")).alias("_line"))


def _whole_rows(spark, paths: list[str], skip: int, delim: str, quote: str, escape: str, width: int, lenient: bool) -> DataFrame:
    """Rows of files whose cells may hold line breaks (PARALLEL=false), a file to a task, without the first lines."""
    names = [f"c{k}" for k in range(width)] + ["_bad", "_file", "_line", "value"]

    def rows(batches):
        import pandas as pd

        for batch in batches:
            for text, file in zip(batch["value"], batch["_file"], strict=True):
                kept = text.splitlines(keepends=True)[skip:]
                reader = csv.reader(kept, delimiter=delim, quotechar=quote or None, doublequote=escape == '"', escapechar=None if escape == '"' else escape)
                out, at = [], 0
                for r in reader:
                    value = "".join(kept[at : reader.line_num]).rstrip("\r\n")
                    if r:
                        fits = len(r) == width
                        if not (fits or lenient):
                            raise ValueError(f"Copy exception: expected {width} values per row, but got {len(r)}.")
                        out.append([*(r + [None] * width)[:width], None if fits else value, file, skip + at + 1, value])
                    at = reader.line_num
                    if len(out) >= 10_000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                yield pd.DataFrame(out, columns=names)

    texts = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("_file"))
    return texts.mapInPandas(rows, ", ".join(f"{n} {'bigint' if n == '_line' else 'string'}" for n in names))


def _width(line: str, delim: str) -> int:
    try:
        return len(next(csv.reader([line], delimiter=delim)))
    except (StopIteration, csv.Error):
        return 1


def read_npy(session, paths: list[str]) -> DataFrame:
    """Each file is a column: numbers, or arrays of them. Blocks of rows are read from the file in the tasks."""
    import numpy as np

    out = None
    for k, p in enumerate(paths):
        a = np.load(p, mmap_mode="r")
        if a.dtype.name not in ("int16", "int32", "int64", "float32", "float64"):
            raise IOFault(f"Type {a.dtype.name} of {p} is not supported.")
        base = {"int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double"}[a.dtype.name]
        kind = base if a.ndim == 1 else f"array<{base}>"
        n, step = len(a), 100_000

        def rows(batches, p=p, n=n, step=step):
            import pandas as pd

            own = np.load(p, mmap_mode="r")
            for b in batches:
                for i in b["id"]:
                    part = own[i * step : min(n, (i + 1) * step)]
                    yield pd.DataFrame({"_row": np.arange(i * step, i * step + len(part)), "v": list(part.reshape(len(part), -1)) if part.ndim > 1 else part})

        df = session.spark.range(0, -(-n // step), 1, max(1, min(64, -(-n // step)))).mapInPandas(rows, f"_row bigint, v {kind}").withColumnRenamed("v", f"column{k}")
        out = df if out is None else out.join(df, "_row")
    return out.drop("_row")


def write_file(df: DataFrame, types: list[Ty], path: str, options: dict) -> None:
    """COPY (query) TO: CSV as one file by name, or Parquet as a folder of parts by name."""
    kind = format_of(path, {})
    if path.endswith(".gz"):
        raise BinderError("Writing compressed CSV is not supported.")
    if kind == "parquet":
        codec = str(options.get("COMPRESSION", "snappy")).lower()
        if codec not in ("uncompressed", "snappy", "zstd", "gzip", "lz4_raw"):
            raise BinderError(f"Unrecognized parquet compression option: {codec}.")
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return
    if kind != "csv":
        raise BinderError(f"Cannot copy to file type {kind}.")
    from knotwork.functions.expr import text_of

    named = df.toDF(*[f"c{k}" for k in range(len(types))])
    shown = named.select(*[(F.col(f"c{k}") if t.numeric and not t.floating or t.name in ("STRING",) else F.col(f"c{k}").cast("string") if t.floating else text_of(F.col(f"c{k}"), t)).alias(n) for k, (t, n) in enumerate(zip(types, df.columns, strict=True))])
    shown.write.mode("overwrite").options(header=bool(options.get("HEADER", False)), sep=str(options.get("DELIM", ",")), quote=str(options.get("QUOTE", '"')), escape=str(options.get("ESCAPE", '"')), emptyValue='""', nullValue="").csv(path)
