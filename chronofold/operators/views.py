"""Bitemporal read modes and lookups over folded versions.

A view is the version table under a conjunction of interval predicates, so filters reach the scan.
Intervals are half-open: [from, to).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.shared import checkpoint


def _ts(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("timestamp")


def recorded_at(tx) -> Column:
    """Versions that were recorded at transaction tx."""
    t = tx if isinstance(tx, Column) else F.lit(tx)
    return (F.col("tx_from") <= t) & (F.col("tx_to").isNull() | (F.col("tx_to") > t))


def valid_at(instant) -> Column:
    t = _ts(instant)
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))


class View:
    """Versions of nodes and edges pinned on valid time, recorded time or both.

    mode: current (valid at `valid` or now), ended (any window), tombstones (deleted rows too).
    A recorded pin alone also pins valid time to that transaction's wall clock (`recorded_wall`)."""

    def __init__(self, versions: DataFrame, valid=None, recorded: int | None = None, recorded_wall=None, mode: str = "current"):
        if mode not in ("current", "ended", "tombstones"):
            raise ValueError("mode is current, ended or tombstones")
        self.mode = mode
        df = versions.filter(recorded_at(recorded)) if recorded is not None else versions.filter("tx_to is null")
        if mode != "tombstones":
            df = df.filter("not deleted")
        if mode == "current":
            at = valid if valid is not None else recorded_wall if recorded is not None and recorded_wall is not None else F.current_timestamp()
            df = df.filter(valid_at(at))
        elif valid is not None:
            df = df.filter(valid_at(valid))
        self.df = df

    def nodes(self, kind: str) -> DataFrame:
        return self.df.filter((F.col("kind") == kind) & F.col("id").isNotNull())

    def edges(self, kind: str) -> DataFrame:
        return self.df.filter((F.col("kind") == kind) & F.col("from_id").isNotNull())

    def node(self, kind: str, id: str) -> DataFrame:
        return self.nodes(kind).filter(F.col("id") == id)

    def edge(self, kind: str, start: tuple[str, str], end: tuple[str, str]) -> DataFrame:
        df = self.edges(kind)
        return df.filter((F.col("from_kind") == start[0]) & (F.col("from_id") == start[1]) & (F.col("to_kind") == end[0]) & (F.col("to_id") == end[1]))

    def page(self, kind: str, after: str | None, n: int) -> DataFrame:
        """Keyset page by id, with `has_next`: one row more is read than shown."""
        df = self.nodes(kind)
        df = df.filter(F.col("id") > after) if after is not None else df
        top = df.orderBy("id").limit(n + 1)
        more = top.agg((F.count(F.lit(1)) > n).alias("has_next"))
        return top.orderBy("id").limit(n).crossJoin(F.broadcast(more))

    def neighbours(self, edge: str, kind: str) -> DataFrame:
        """(id, n) of live edges from each node of a kind."""
        return self.edges(edge).filter(F.col("from_kind") == kind).groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))

    def subgraph(self, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes with (kind, id) in ids and the edges between them."""
        nodes = self.df.join(ids, ["kind", "id"], "left_semi")
        a = ids.select(F.col("kind").alias("from_kind"), F.col("id").alias("from_id"))
        b = ids.select(F.col("kind").alias("to_kind"), F.col("id").alias("to_id"))
        return nodes, self.df.filter("from_id is not null").join(a, ["from_kind", "from_id"], "left_semi").join(b, ["to_kind", "to_id"], "left_semi")

    def match(self, kind: str, alias: str) -> "Match":
        return Match(self, self._named(self.nodes(kind), alias, kind), [alias])

    @staticmethod
    def _named(df: DataFrame, alias: str, kind: str) -> DataFrame:
        return df.select(F.struct(F.col("id"), F.lit(kind).alias("kind"), F.col("props"), F.col("valid_from"), F.col("valid_to"), F.col("deleted")).alias(alias))


class Match:
    """A pattern: start kind, then hops over edges. Each hop is two equi-joins; Catalyst orders them. The
    result has one struct column per alias; `prop(alias, name)` reads a property."""

    def __init__(self, view: View, df: DataFrame, aliases: list[str]):
        self.view, self.df, self.aliases = view, df, aliases

    def where(self, condition: Column) -> "Match":
        return Match(self.view, self.df.filter(condition), self.aliases)

    def traverse(self, edge: str, edge_alias: str, kind: str, alias: str, source: str | None = None, reverse: bool = False) -> "Match":
        source = source or self.aliases[-1]
        e = self.view.edges(edge)
        near, far = ("to", "from") if reverse else ("from", "to")
        e = e.filter(F.col(f"{far}_kind") == kind).select(F.col(f"{near}_kind").alias("_nk"), F.col(f"{near}_id").alias("_ni"), F.col(f"{far}_id").alias("_fi"), F.struct("props", "valid_from", "valid_to", "deleted").alias(edge_alias))
        target = View._named(self.view.nodes(kind), alias, kind)
        df = self.df.join(e, (F.col(f"{source}.id") == F.col("_ni")) & (F.col(f"{source}.kind") == F.col("_nk")))
        df = df.join(target, F.col("_fi") == F.col(f"{alias}.id")).drop("_nk", "_ni", "_fi")
        return Match(self.view, df, [*self.aliases, edge_alias, alias])

    def select(self, **columns: Column) -> DataFrame:
        return self.df.select(*[c.alias(n) for n, c in columns.items()])

    def group_by(self, *columns: Column):
        return self.df.groupBy(*columns)

    def count(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("n"))


def prop(alias: str, name: str) -> Column:
    return F.get_json_object(F.col(f"{alias}.props"), f"$.{name}")


def collect_ordered(record: Column, *order: Column) -> Column:
    """Records of a group as an array in the order of the given columns."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], record.alias("r")))), lambda x: x["r"])


def batch_once(view: View, queries: dict[str, object]) -> dict[str, DataFrame]:
    """Several queries over one snapshot, which is folded once and written to the shared folder."""
    pinned = View.__new__(View)
    pinned.mode, pinned.df = view.mode, checkpoint(view.df, "snapshot")
    return {name: q(pinned) for name, q in queries.items()}
