"""Graph constraints as set queries over events and versions; reports and raising checks.

Existence and counts at a sequence point are running sums over one sorted stream per key (sweep line),
not interval self joins. The streams are summed by slices of transactions, so the edges of a hub spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.errors import ConstraintError
from chronofold.functions.positions import STEP, in_steps, running
from chronofold.plans.events import EDGE_UPSERT, NODE_REMOVE, NODE_UPSERT
from chronofold.plans.fold import op_rank, states

ORDER = ("tx", "change_ix", "op_rank", "event_ix")


def _swept(rows: DataFrame, by: list[str], name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the sum of `change` of their key up to their place in the stream; rows of one place by `ties`."""
    return running(in_steps(rows, "tx", STEP), by, [*ORDER, *ties], F.col("change"), name)


def inverted_windows(versions: DataFrame) -> DataFrame:
    """Versions whose window ends before it starts."""
    return versions.filter("valid_to < valid_from")


def missing_endpoints(events: DataFrame) -> DataFrame:
    """Edge upserts at whose place in the stream an endpoint does not exist: (kind, from_id, to_id, tx,
    missing). Each node key is swept once: its own events switch it on and off, edges look at it."""
    df = events.withColumn("op_rank", op_rank())
    own = Window.partitionBy("kind", "id").orderBy(*ORDER)
    on = (F.col("op") == NODE_UPSERT).cast("int")
    node = df.filter(F.col("op").isin(NODE_UPSERT, NODE_REMOVE)).withColumn("change", on - F.coalesce(F.lag(on).over(own), F.lit(0)))
    node = node.select(F.col("kind").alias("nk"), F.col("id").alias("nid"), *ORDER, "change", *[F.lit(None).cast("string").alias(c) for c in ("kind", "from_id", "to_id")])
    ends = []
    for side in ("from", "to"):
        ends.append(df.filter(F.col("op") == EDGE_UPSERT).select(F.col(f"{side}_kind").alias("nk"), F.col(f"{side}_id").alias("nid"), *ORDER, F.lit(0).alias("change"), "kind", "from_id", "to_id"))
    swept = _swept(node.unionByName(ends[0]).unionByName(ends[1]), ["nk", "nid"], "live")
    bad = swept.filter("kind is not null and live = 0")
    return bad.select("kind", "from_id", "to_id", "tx", F.concat_ws("/", "nk", "nid").alias("missing"))


def restricted_deletes(events: DataFrame) -> DataFrame:
    """Node removals while a live edge touches the node: (kind, id, tx, live_edges)."""
    s = states(events)
    step = Window.partitionBy("kind", "id", "from_kind", "from_id", "to_kind", "to_id").orderBy(*ORDER)
    change = F.col("up").cast("int") - F.coalesce(F.lag("up").over(step).cast("int"), F.lit(0))
    s = s.withColumn("change", change)
    edge = s.filter("from_id is not null")
    ends = edge.select(F.col("from_kind").alias("nk"), F.col("from_id").alias("nid"), *ORDER, "change", F.lit(False).alias("removal")).unionByName(edge.filter("from_id <> to_id or from_kind <> to_kind").select(F.col("to_kind").alias("nk"), F.col("to_id").alias("nid"), *ORDER, "change", F.lit(False).alias("removal")))
    gone = s.filter("id is not null and not up and change = -1").select(F.col("kind").alias("nk"), F.col("id").alias("nid"), *ORDER, F.lit(0).alias("change"), F.lit(True).alias("removal"))
    swept = _swept(ends.unionByName(gone), ["nk", "nid"], "live_edges")
    return swept.filter("removal and live_edges > 0").select(F.col("nk").alias("kind"), F.col("nid").alias("id"), "tx", "live_edges")


def cardinality_violations(events: DataFrame, kinds: list[str]) -> DataFrame:
    """Edge births that give a source more than one live edge of a kind with cardinality one. An edge with
    an ended window frees its source. Edges of one place in the stream are born by target, so that reruns agree."""
    s = states(events.filter(F.col("kind").isin(kinds)))
    step = Window.partitionBy("kind", "id", "from_kind", "from_id", "to_kind", "to_id").orderBy(*ORDER)
    live = F.col("up") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("tx_wall")))
    s = s.withColumn("live", live.cast("int"))
    s = s.withColumn("change", F.col("live") - F.coalesce(F.lag("live").over(step), F.lit(0)))
    s = s.select("kind", "from_kind", "from_id", "id", "to_kind", "to_id", *ORDER, "change")
    return _swept(s, ["kind", "from_kind", "from_id"], "n_live", ("to_kind", "to_id", "id")).filter("change > 0 and n_live > 1").select("kind", "from_id", "to_id", "tx", "n_live")


def unique_violations(current: DataFrame, kind: str, value) -> DataFrame:
    """Case-insensitive unique values that several live nodes of a kind share: (value, n, first_id)."""
    df = current.filter(F.col("kind") == kind).select("id", F.lower(value).alias("value")).filter("value is not null")
    return df.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def audit(events: DataFrame, versions: DataFrame, graph, after_tx: int | None = None, unique: bool = True) -> DataFrame:
    """All violations as (rule, kind, subject); empty if clean. Nothing is changed. With `after_tx` only
    those that later transactions made: events may then be the part of history these can depend on."""
    new = lambda df, tx="tx": df if after_tx is None else df.filter(F.col(tx) > after_tx)
    say = lambda df, rule, kind, subject: df.select(F.lit(rule).alias("rule"), kind.alias("kind"), subject.alias("subject"))
    parts = [
        say(new(inverted_windows(versions), "tx_from"), "window", F.col("kind"), F.coalesce("id", F.concat_ws("->", "from_id", "to_id"))),
        say(new(missing_endpoints(events)), "endpoint", F.col("kind"), F.concat_ws("->", "from_id", "to_id")),
        say(new(restricted_deletes(events)), "restricted", F.col("kind"), F.col("id")),
    ]
    ones = [e.name for e in graph.edges.values() if e.cardinality == "one"]
    if ones:
        parts.append(say(new(cardinality_violations(events, ones)), "cardinality", F.col("kind"), F.concat_ws("->", "from_id", "to_id")))
    current = versions.filter("tx_to is null and not deleted")
    for n in graph.nodes.values():
        if n.unique and unique:
            parts.append(say(unique_violations(current, n.name, F.get_json_object("props", f"$.{n.unique}")), "unique", F.lit(n.name), F.col("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check(events: DataFrame, versions: DataFrame, graph, after_tx: int = 0, unique: bool = True) -> None:
    """Raise with the first violation that transactions after `after_tx` made."""
    bad = audit(events, versions, graph, after_tx, unique).orderBy("rule", "kind", "subject").limit(1).collect()
    if bad:
        raise ConstraintError(f"{bad[0]['rule']}: {bad[0]['kind']} {bad[0]['subject']}")
