"""Syntax trees. An expression is a tuple: its kind, then its parts; clauses and statements are dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class NodePattern:
    var: str | None
    labels: list[str]
    props: list[tuple[str, tuple]]


@dataclass
class RelPattern:
    var: str | None
    types: list[str]
    props: list[tuple[str, tuple]]
    direction: str  # "out", "in", "both"
    hops: tuple[int | None, int | None] | None = None
    mode: str = "WALK"
    weight: str | None = None
    step: tuple | None = None  # (rel var, node var, predicate or None)


@dataclass
class PathPattern:
    var: str | None
    parts: list  # node, rel, node, ...


@dataclass
class Match:
    optional: bool
    paths: list[PathPattern]
    where: tuple | None
    hint: object = None


@dataclass
class Unwind:
    expr: tuple
    var: str


@dataclass
class Item:
    expr: tuple
    alias: str | None
    text: str


@dataclass
class Projection:
    items: list[Item]
    star: bool
    distinct: bool
    order: list[tuple[tuple, bool]] = field(default_factory=list)  # (expression, descending)
    skip: tuple | None = None
    limit: tuple | None = None


@dataclass
class With:
    body: Projection
    where: tuple | None


@dataclass
class Return:
    body: Projection


@dataclass
class Call:
    name: str
    args: list[tuple]
    named: dict[str, tuple]
    items: list[tuple[str, str]] | None  # YIELD column, alias
    where: tuple | None


@dataclass
class LoadFrom:
    columns: list[tuple[str, str]] | None
    files: list[str]
    options: dict[str, object]
    where: tuple | None


@dataclass
class Create:
    paths: list[PathPattern]


@dataclass
class Merge:
    paths: list[PathPattern]
    on_create: list
    on_match: list


@dataclass
class SetItems:
    items: list[tuple]  # ("prop", var, name, expr) or ("map", var, expr, whether added to)


@dataclass
class Delete:
    vars: list[tuple]
    detach: bool


@dataclass
class Query:
    clauses: list


@dataclass
class Union:
    queries: list[Query]
    all: bool


@dataclass
class Statement:
    """Any other statement: its kind and its parts by name."""

    kind: str
    parts: dict
