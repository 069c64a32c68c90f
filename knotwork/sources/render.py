"""Results as text, for people and other programs: what a client shows of rows that it has collected."""

from __future__ import annotations

import csv
import datetime
import decimal
import io
import json
from typing import Any

from pyspark.sql import DataFrame, Row

FORMATS = ("table", "box", "markdown", "line", "csv", "tsv", "json", "jsonl", "trash")


def text(v: Any) -> str:
    """A value as results show it: NULL is empty, doubles have six places, nodes and relationships their ids and labels."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "True" if v else "False"
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, (bytes, bytearray)):
        return "".join(chr(b) if 32 <= b < 127 and b != 92 else f"\\x{b:02X}" for b in v)
    if isinstance(v, Row):
        d = v.asDict()
        if list(d) == ["table", "offset"]:
            return f"{d['table']}:{d['offset']}"
        if list(d) == ["key", "value"]:
            return f"{text(d['key'])}={text(d['value'])}"
        if "_src" in d:
            inner = {k: x for k, x in d.items() if k not in ("_src", "_dst")}
            return f"({text(d['_src'])})-{_fields(inner)}->({text(d['_dst'])})"
        if next(iter(d), "") == "tag":
            return text(d.get(d["tag"]))
        return _fields(d)
    if isinstance(v, (list, tuple)):
        maps = v and all(isinstance(x, Row) and list(x.asDict()) == ["key", "value"] for x in v)
        return ("{" + ", ".join(map(text, v)) + "}") if maps else "[" + ",".join(map(text, v)) + "]"
    return str(v)


def _fields(d: dict) -> str:
    graph = "_id" in d or "_nodes" in d
    shown = {(k.upper() if k in ("_id", "_label", "_nodes", "_rels") else k): x for k, x in d.items() if not (graph and x is None)}
    return "{" + ", ".join(f"{k}: {text(x)}" for k, x in shown.items()) + "}"


def plain(v: Any) -> Any:
    """A value for JSON."""
    if isinstance(v, Row):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return text(v) if isinstance(v, (bytes, bytearray)) else v


def render(df: DataFrame, form: str = "table", limit: int = 1000) -> str:
    """The first rows of a result in one of FORMATS."""
    if form not in FORMATS:
        raise ValueError(f"There is no format {form}.")
    rows, names = df.limit(limit).collect(), df.columns
    if form == "trash":
        return ""
    if form in ("json", "jsonl"):
        made = [dict(zip(names, map(plain, r), strict=True)) for r in rows]
        return json.dumps(made, ensure_ascii=False) if form == "json" else "\n".join(json.dumps(x, ensure_ascii=False) for x in made)
    cells = [[text(v) for v in r] for r in rows]
    if form in ("csv", "tsv"):
        out = io.StringIO()
        csv.writer(out, delimiter="," if form == "csv" else "\t", lineterminator="\n").writerows([names, *cells])
        return out.getvalue()
    if form == "line":
        return "\n\n".join("\n".join(f"{n} = {c}" for n, c in zip(names, r, strict=True)) for r in cells)
    wide = [max(len(x) for x in column) for column in zip(names, *cells, strict=True)]
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)) + " |"
    if form == "markdown":
        return "\n".join([line(names), "|" + "|".join("-" * (w + 2) for w in wide) + "|", *map(line, cells)])
    edge = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    return "\n".join([edge, line(names), edge, *map(line, cells), edge])
