"""Graph events: the four-verb mutation IR, graph definitions and typed constructors.

An event is a row: op, kind, id (nodes) or from/to endpoints (edges), props as JSON text, valid_from,
valid_to, clear_valid_to. Decoders are DataFrame -> DataFrame functions that return such rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.errors import ConstraintError

NODE_UPSERT, EDGE_UPSERT, EDGE_REMOVE, NODE_REMOVE = "node.upsert", "edge.upsert", "edge.remove", "node.remove"
#: Inside a change, effects apply in this order; events of one op keep their own order.
OP_RANK = {NODE_UPSERT: 0, EDGE_UPSERT: 1, EDGE_REMOVE: 2, NODE_REMOVE: 3}
EVENT_TYPE = "struct<op:string,kind:string,id:string,from_kind:string,from_id:string,to_kind:string,to_id:string,props:string,valid_from:timestamp,valid_to:timestamp,clear_valid_to:boolean>"
FIELDS = ("op", "kind", "id", "from_kind", "from_id", "to_kind", "to_id", "props", "valid_from", "valid_to", "clear_valid_to")
KEYS = ("kind", "id", "from_kind", "from_id", "to_kind", "to_id")
RESERVED = {"id", "kind", "meta"}


@dataclass
class NodeKind:
    name: str
    props: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)
    enums: dict[str, list[str]] = field(default_factory=dict)
    unique: str | None = None


@dataclass
class EdgeKind:
    name: str
    from_kinds: list[str]
    to_kinds: list[str]
    props: dict[str, str] = field(default_factory=dict)
    cardinality: str = "many"
    defaults: dict[str, object] = field(default_factory=dict)


class Graph:
    """Declared node and edge kinds; names of properties that rows use themselves are refused."""

    def __init__(self, nodes: list[NodeKind], edges: list[EdgeKind] = ()):
        self.nodes, self.edges = {n.name: n for n in nodes}, {e.name: e for e in edges}
        for k in (*nodes, *edges):
            if bad := RESERVED & set(k.props):
                raise ValueError(f"{k.name}: reserved property names {sorted(bad)}")
        for e in edges:
            for end in (*e.from_kinds, *e.to_kinds):
                if end not in self.nodes:
                    raise ValueError(f"{e.name}: unknown endpoint kind {end}")


def _event(op: str, **given) -> Column:
    values = {"op": F.lit(op), **given}
    return F.struct(*[F.coalesce(values[f], F.lit(None)).alias(f) if f in values else F.lit(None).alias(f) for f in FIELDS]).cast(EVENT_TYPE)


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def valid(start=None, end=None, clear: bool = False) -> dict[str, Column]:
    """Valid-time statement of an upsert; an end and its clearing exclude each other."""
    if end is not None and clear:
        raise ValueError("an event either ends its window or reopens it")
    out = {}
    if start is not None:
        out["valid_from"] = _lit(start).cast("timestamp")
    if end is not None:
        out["valid_to"] = _lit(end).cast("timestamp")
    if clear:
        out["clear_valid_to"] = F.lit(True)
    return out


class NodeEmitter:
    def __init__(self, kind: NodeKind):
        self.kind = kind

    def upsert(self, id, props: dict[str, object], window: dict[str, Column] | None = None) -> Column:
        if extra := set(props) - set(self.kind.props):
            raise ValueError(f"{self.kind.name} has no property {sorted(extra)}")
        full = {p: _lit(props[p]) if p in props else F.lit(self.kind.defaults.get(p)) for p in self.kind.props}
        full = {p: F.coalesce(c, F.lit(self.kind.defaults[p])) if self.kind.defaults.get(p) is not None else c for p, c in full.items()}
        for p, allowed in self.kind.enums.items():
            bad = full[p].isNotNull() & ~full[p].isin(allowed)
            full[p] = F.when(bad, F.raise_error(F.concat(F.lit(f"{self.kind.name}.{p} cannot be "), full[p].cast("string"))).cast("string")).otherwise(full[p])
        text = F.to_json(F.struct(*[c.cast(self.kind.props[p]).alias(p) for p, c in full.items()])) if full else F.lit("{}")
        return _event(NODE_UPSERT, kind=F.lit(self.kind.name), id=_lit(id), props=text, **(window or {}))

    def remove(self, id) -> Column:
        return _event(NODE_REMOVE, kind=F.lit(self.kind.name), id=_lit(id))


class EdgeEmitter:
    def __init__(self, kind: EdgeKind):
        self.kind = kind

    def _ends(self, start: tuple[str, object], end: tuple[str, object]) -> dict[str, Column]:
        if start[0] not in self.kind.from_kinds or end[0] not in self.kind.to_kinds:
            raise ValueError(f"{self.kind.name} does not join {start[0]} to {end[0]}")
        return {"from_kind": F.lit(start[0]), "from_id": _lit(start[1]), "to_kind": F.lit(end[0]), "to_id": _lit(end[1])}

    def upsert(self, start, end, props: dict[str, object] | None = None, window: dict[str, Column] | None = None) -> Column:
        props = props or {}
        if extra := set(props) - set(self.kind.props):
            raise ValueError(f"{self.kind.name} has no property {sorted(extra)}")
        given = {p: F.coalesce(*[_lit(x) for x in (props.get(p), self.kind.defaults.get(p)) if x is not None]) for p in self.kind.props if props.get(p) is not None or self.kind.defaults.get(p) is not None}
        text = F.to_json(F.struct(*[c.cast(self.kind.props[p]).alias(p) for p, c in given.items()])) if given else F.lit("{}")
        return _event(EDGE_UPSERT, kind=F.lit(self.kind.name), props=text, **self._ends(start, end), **(window or {}))

    def remove(self, start, end) -> Column:
        return _event(EDGE_REMOVE, kind=F.lit(self.kind.name), **self._ends(start, end))


class Emitter:
    """Typed event constructors by declared kind: emit.nodes["Person"].upsert(...)."""

    def __init__(self, graph: Graph):
        self.nodes = {k: NodeEmitter(v) for k, v in graph.nodes.items()}
        self.edges = {k: EdgeEmitter(v) for k, v in graph.edges.items()}


Decoder = Callable[[DataFrame], DataFrame]


def decode(changes: DataFrame, *rules: tuple[Column, list[Column]], passing: tuple[str, ...] = ("tx", "change_ix", "tx_wall")) -> DataFrame:
    """Changes to event rows: each rule is (condition, events); events that are null are left out."""
    lists = [F.when(cond, F.array(*events)).otherwise(F.array().cast(f"array<{EVENT_TYPE}>")) for cond, events in rules]
    every = F.filter(F.flatten(F.array(*lists)), lambda e: e.isNotNull())
    return changes.select(*passing, F.posexplode(every).alias("event_ix", "event")).select(*passing, "event_ix", "event.*")


def event_problems(events: DataFrame) -> DataFrame:
    """Adds `problem`: that an event both ends and reopens its window, or what it lacks; null if it is valid."""
    node = F.col("op").isin(NODE_UPSERT, NODE_REMOVE)
    both = F.col("valid_to").isNotNull() & F.coalesce("clear_valid_to", F.lit(False))
    ends = F.col("from_id").isNull() | F.col("to_id").isNull()
    return events.withColumn("problem", F.when(both, "ends and reopens").when(node & F.col("id").isNull(), "no id").when(~node & ends, "no endpoints"))


def check_events(events: DataFrame) -> None:
    """Raise on the first invalid event."""
    rows = event_problems(events).filter("problem is not null").limit(1).collect()
    if rows:
        raise ConstraintError(f"invalid event: {rows[0].asDict()}")
