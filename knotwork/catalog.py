"""Graphs: node and relationship tables over DataFrames, sequences, macros, types. Snapshots are cheap copies."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.errors import CatalogError
from knotwork.types import Ty, engine_type, spark_type


@dataclass
class NodeTable:
    """df holds _off (BIGINT, the node's place in its table) and the properties."""

    name: str
    id: int
    df: DataFrame
    key: str
    columns: dict[str, Ty]
    defaults: dict = field(default_factory=dict)
    next_off: int = 0
    comment: str = ""
    no_nan: bool = False
    external: bool = False
    #: of streams into this table: their checkpoint and the numbers of the batches that are in
    batches: dict = field(default_factory=dict)

    def column(self, name: str) -> str | None:
        return next((c for c in self.columns if c.lower() == name.lower()), None)


@dataclass
class RelTable:
    """pairs: (from, to) -> df of _src, _dst, _off and the properties."""

    name: str
    ids: dict[tuple[str, str], int]
    pairs: dict[tuple[str, str], DataFrame]
    columns: dict[str, Ty]
    defaults: dict = field(default_factory=dict)
    many: str = "MANY_MANY"
    direction: str = "both"
    next_off: int = 0
    comment: str = ""
    no_nan: bool = False
    external: bool = False
    batches: dict = field(default_factory=dict)

    column = NodeTable.column


@dataclass
class Sequence:
    name: str
    start: int = 1
    increment: int = 1
    low: int = 1
    high: int = 2**63 - 1
    cycle: bool = False
    value: int | None = None

    def rooms(self, first: int) -> tuple[int, int, int]:
        """How many values there are from first on, where a cycle begins again, and how many values it has."""
        up = self.increment > 0
        again = self.low if up else self.high
        left = lambda v: ((self.high - v) if up else (v - self.low)) // abs(self.increment) + 1
        return left(first), again, left(again)

    def take(self, n: int = 1) -> list[int]:
        out = []
        for _ in range(n):
            v = self.start if self.value is None else self.value + self.increment
            if not self.low <= v <= self.high:
                if not self.cycle:
                    from knotwork.errors import RuntimeFault

                    raise RuntimeFault(f"nextval: reached {'maximum' if self.increment > 0 else 'minimum'} value of sequence \"{self.name}\" {self.high if self.increment > 0 else self.low}")
                v = self.low if self.increment > 0 else self.high
            self.value = v
            out.append(v)
        return out


@dataclass
class Catalog:
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    rels: dict[str, RelTable] = field(default_factory=dict)
    sequences: dict[str, Sequence] = field(default_factory=dict)
    macros: dict[str, dict] = field(default_factory=dict)
    types: dict[str, Ty] = field(default_factory=dict)
    indexes: list[dict] = field(default_factory=list)
    next_id: int = 0

    def snapshot(self) -> Catalog:
        return Catalog({k: copy.copy(v) for k, v in self.nodes.items()}, {k: self._rel(v) for k, v in self.rels.items()}, {k: copy.copy(v) for k, v in self.sequences.items()}, dict(self.macros), dict(self.types), list(self.indexes), self.next_id)

    @staticmethod
    def _rel(v: RelTable) -> RelTable:
        out = copy.copy(v)
        out.ids, out.pairs, out.columns = dict(v.ids), dict(v.pairs), dict(v.columns)
        return out

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def node(self, name: str) -> NodeTable:
        for k, t in self.nodes.items():
            if k.lower() == name.lower():
                return t
        raise CatalogError(f"Table {name} does not exist.")

    def rel(self, name: str) -> RelTable:
        for k, t in self.rels.items():
            if k.lower() == name.lower():
                return t
        raise CatalogError(f"Table {name} does not exist.")

    def table(self, name: str) -> NodeTable | RelTable:
        for k, t in [*self.nodes.items(), *self.rels.items()]:
            if k.lower() == name.lower():
                return t
        raise CatalogError(f"Table {name} does not exist.")

    def has(self, name: str) -> bool:
        return any(k.lower() == name.lower() for k in [*self.nodes, *self.rels])

    def add_nodes(self, name: str, df: DataFrame, key: str, no_nan: bool = False) -> NodeTable:
        """A DataFrame as a node table. A whole-number key is the node's place itself; else it is a 64-bit hash of the key."""
        if self.has(name):
            raise CatalogError(f"{name} already exists in catalog.")
        columns = {f.name: engine_type(f.dataType) for f in df.schema}
        off = F.col(key).cast("bigint") if columns[key].integer else F.xxhash64(key)
        made = df.select(off.alias("_off"), *[F.col(c) for c in df.columns])
        self.nodes[name] = NodeTable(name, self.new_id(), made, key, columns, no_nan=no_nan)
        return self.nodes[name]

    def add_rels(self, name: str, pairs: dict[tuple[str, str], tuple[DataFrame, str, str]], key: Column | str | None = None, no_nan: bool = False, many: str = "MANY_MANY", unique: bool = False) -> RelTable:
        """DataFrames as a relationship table: (from, to) -> (df, column of the from key, column of the to key). Other columns are properties.

        key: an expression that tells the relationships of a pair apart; without one, a hash of the row does, with the row's
        number among equal ones (made only where a query needs identity). unique: no two rows are equal, so none is needed.
        many: how many relationships a node has (MANY_ONE: one going out, ONE_MANY: one coming in); the planner trusts it."""
        if self.has(name):
            raise CatalogError(f"{name} already exists in catalog.")
        made, ids, columns = {}, {}, {}
        for (a, b), (df, src, dst) in pairs.items():
            place = lambda c, t: F.col(c).cast("bigint") if t.columns[t.key].integer else F.xxhash64(c)
            props = [c for c in df.columns if c not in (src, dst)]
            row = F.xxhash64(*df.columns)
            if key is None and not unique:
                row = F.xxhash64(row, F.row_number().over(Window.partitionBy(row).orderBy(F.lit(1))))
            off = row if key is None else F.expr(key) if isinstance(key, str) else key
            made[a, b] = df.select(place(src, self.node(a)).alias("_src"), place(dst, self.node(b)).alias("_dst"), off.alias("_off"), *props)
            ids[a, b] = self.new_id()
            columns |= {c: engine_type(df.schema[c].dataType) for c in props}
        self.rels[name] = RelTable(name, ids, made, columns, many=many, no_nan=no_nan)
        return self.rels[name]

    def empty(self, spark, columns: dict[str, Ty], rel: bool) -> DataFrame:
        from pyspark.sql import types as T

        lead = ["_src", "_dst", "_off"] if rel else ["_off"]
        schema = T.StructType([T.StructField(c, T.LongType()) for c in lead] + [T.StructField(c, spark_type(t)) for c, t in columns.items()])
        return spark.createDataFrame([], schema)
