"""What of a store's history a batch of new events needs.

Folding a row needs the events of its own key. Rules need a little more: an edge the events of its
endpoints, a node removal the edges that touch it, an edge of a kind with cardinality one its source's
other edges, a unique value the nodes that ever had it. Each need is a token; history is filtered by one
semi-join on tokens, so a commit shuffles the touched part of history and not all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.plans.events import EDGE_UPSERT, KEYS, NODE_REMOVE, NODE_UPSERT

EVENT_ID = ("tx", "change_ix", "event_ix")


def _token(tag: str, *parts) -> Column:
    return F.concat_ws("|", F.lit(tag), *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("\u0000")) for p in parts])


def _node(kind, id) -> Column:
    none = F.lit("\u0000")
    return _token("k", kind, id, none, none, none, none)


def _unique(graph) -> Column:
    out = F.lit(None).cast("string")
    for n in graph.nodes.values() if graph is not None else ():
        if n.unique:
            value = F.lower(F.get_json_object("props", f"$.{n.unique}"))
            out = F.when((F.col("op") == NODE_UPSERT) & (F.col("kind") == n.name) & value.isNotNull(), _token("u", "kind", value)).otherwise(out)
    return out


def _present(*tokens: Column) -> Column:
    return F.array_compact(F.array(*tokens))


def relevant(history: DataFrame, rows: DataFrame, graph=None) -> DataFrame:
    """The events of history that folding and checking `rows` can depend on."""
    edge = F.col("from_id").isNotNull()
    ones = [e.name for e in graph.edges.values() if e.cardinality == "one"] if graph is not None else []
    one = edge & F.col("kind").isin(ones) if ones else F.lit(False)
    own = _token("k", *KEYS)
    mine = _present(own, F.when(edge, _token("i", "from_kind", "from_id")), F.when(edge, _token("i", "to_kind", "to_id")), F.when(one, _token("c", "kind", "from_kind", "from_id")), _unique(graph))
    up = F.col("op") == EDGE_UPSERT
    gone = F.col("op") == NODE_REMOVE
    wants = _present(own, F.when(up, _node("from_kind", "from_id")), F.when(up, _node("to_kind", "to_id")), F.when(gone, _token("i", "kind", "id")), F.when(one, _token("c", "kind", "from_kind", "from_id")), _unique(graph))
    wanted = rows.select(F.explode(wants).alias("token")).distinct()
    each = history.withColumn("token", F.explode(mine))
    if graph is not None and any(n.unique for n in graph.nodes.values()):
        holders = each.filter(F.col("token").startswith("u|")).join(wanted, "token", "left_semi").select(own.alias("token"))
        wanted = wanted.unionByName(holders).distinct()
    return each.join(wanted, "token", "left_semi").drop("token").dropDuplicates(list(EVENT_ID))
