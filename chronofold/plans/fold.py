"""The fold: ordered graph events to bitemporal versions, as one pass of windows over one exchange.

Row keys are independent, so events are partitioned by key and sorted by (tx, change, op rank, event).
Every state column is a running aggregate over that one window; then each key keeps its last state per
transaction and drops states equal to the one before (null-safe). No UDF, no self join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.plans.events import EDGE_UPSERT, KEYS, NODE_UPSERT, OP_RANK


def op_rank(op: str = "op") -> Column:
    c = F.lit(9)
    for name, rank in OP_RANK.items():
        c = F.when(F.col(op) == name, rank).otherwise(c)
    return c


def states(events: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Each event with the state of its key after it: incarnation, props, window, deleted."""
    order = ["tx", "change_ix", "op_rank", "event_ix"]
    w = Window.partitionBy(*keys).orderBy(*order)
    df = events.withColumn("op_rank", op_rank()).withColumn("up", F.col("op").isin(NODE_UPSERT, EDGE_UPSERT))
    df = df.withColumn("birth", F.col("up") & ~F.coalesce(F.lag("up").over(w), F.lit(False)))
    ended = F.col("valid_to").isNotNull() & (F.col("valid_to") <= F.col("tx_wall"))
    start = F.when(F.col("valid_from").isNotNull(), F.col("valid_from")).when(~ended | F.col("valid_to").isNull(), F.col("tx_wall"))
    end = F.when(F.col("birth") | F.col("valid_to").isNotNull(), F.struct(F.col("valid_to").alias("v"))).when(F.coalesce("clear_valid_to", F.lit(False)), F.struct(F.lit(None).cast("timestamp").alias("v")))
    return df.select(
        *keys, *order, "up", "birth", "tx_wall",
        F.sum(F.col("birth").cast("bigint")).over(w).alias("incarnation"),
        F.last(F.when(F.col("birth"), F.struct(start.alias("v"))), ignorenulls=True).over(w)["v"].alias("valid_from"),
        F.last(F.when(F.col("up"), end), ignorenulls=True).over(w)["v"].alias("valid_to"),
        F.last(F.when(F.col("up"), F.col("props")), ignorenulls=True).over(w).alias("props"),
        (~F.col("up")).alias("deleted"),
        F.coalesce(F.lead("tx").over(w) != F.col("tx"), F.lit(True)).alias("last_in_tx"),
    )


def fold(events: DataFrame, keys: tuple[str, ...] = KEYS, coalesce: bool = True) -> DataFrame:
    """Versions: keys, incarnation, props, valid_from, valid_to, deleted, tx_from, tx_to (null: current).
    Without `coalesce` unchanged re-deliveries make versions too."""
    w = Window.partitionBy(*keys).orderBy("tx")
    df = states(events, keys).filter("incarnation > 0 and last_in_tx")
    state = F.struct("props", "valid_from", "valid_to", "deleted")
    before = F.lag(state).over(w)
    same = state.eqNullSafe(before) if coalesce else F.lit(False)
    same = same | (F.col("deleted") & F.coalesce(before["deleted"], F.lit(True)))
    df = df.withColumn("same", same).filter("not same")
    return df.select(*keys, "incarnation", "props", "valid_from", "valid_to", "deleted", "tx_wall", F.col("tx").alias("tx_from"), F.lead("tx").over(w).alias("tx_to"))


def captured_transactions(versions: DataFrame, transactions: DataFrame, empty_store: bool = True) -> DataFrame:
    """Transactions with whether they captured a change; the first of an empty store always does."""
    hit = versions.select(F.col("tx_from").alias("tx")).distinct().withColumn("hit", F.lit(True))
    out = transactions.join(hit, "tx", "left").withColumn("captured", F.coalesce("hit", F.lit(False))).drop("hit")
    if empty_store:
        first = transactions.agg(F.min("tx").alias("first_tx"))
        out = out.join(F.broadcast(first), F.lit(True), "left").withColumn("captured", F.col("captured") | (F.col("tx") == F.col("first_tx"))).drop("first_tx")
    return out


def revisions(captured: DataFrame, prior: int = 0, slice_rows: int = 100_000) -> DataFrame:
    """Adds `revision`: the last revision at or before each transaction (its own if it captured). Counts
    run per slice of transactions and over slices, so no window holds all transactions."""
    part = F.floor(F.col("tx") / slice_rows)
    df = captured.withColumn("slice", part)
    per = df.groupBy("slice").agg(F.sum(F.col("captured").cast("bigint")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("slice", before.alias("before"))
    inside = F.sum(F.col("captured").cast("bigint")).over(Window.partitionBy("slice").orderBy("tx"))
    return df.join(per, "slice").withColumn("revision", F.lit(prior) + F.col("before") + inside).drop("slice", "before")


def repair_windows(versions: DataFrame) -> DataFrame:
    """Inverted windows become "ended then, start unknown"."""
    return versions.withColumn("valid_from", F.when(F.col("valid_from") <= F.col("valid_to"), F.col("valid_from")).when(F.col("valid_to").isNull(), F.col("valid_from")))


def effective_writes(events: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Write intents per change: upserts and node removals always count; removing an edge that is not
    there does not."""
    df = states(events, keys)
    w = Window.partitionBy(*keys).orderBy("tx", "change_ix", "op_rank", "event_ix")
    live = F.coalesce(F.lag("up").over(w), F.lit(False))
    counts = F.col("up") | (F.col("op_rank") == OP_RANK["node.remove"]) | live
    return df.withColumn("writes", counts.cast("bigint")).groupBy("tx", "change_ix").agg(F.sum("writes").alias("writes"))
