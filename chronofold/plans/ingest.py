"""Consumption of change logs: transactions, checkpoints, anchors, drops and the batch driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.errors import DroppedChangeError
from chronofold.functions.offsets import check_formats, offset_ord
from chronofold.functions.positions import in_ranges, in_steps, numbered, running
from chronofold.plans import constraints, events as ev, fold as folding, incremental
from chronofold.sources.logs import check_changes

MAX_BATCH = 1000


def check_max_batch(n) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError(f"max_batch_size must be a positive whole number, not {n!r}")
    return n


def transactions(changes: DataFrame, max_batch: int = MAX_BATCH) -> DataFrame:
    """Changes with tx (1, 2, ... per stream) and their place in it. A run is the changes of one offset; a
    run of n makes ceil(n / max_batch) transactions. As the log is sorted, a run is a group, and only
    the table of transactions is numbered, by ranges of offsets (which runs a job)."""
    check_max_batch(max_batch)
    df = changes if "ord" in changes.columns else changes.withColumn("ord", offset_ord("offset"))
    at = F.row_number().over(Window.partitionBy("stream", "ord").orderBy("arrival_ix"))
    df = df.withColumn("slice", F.floor((at - 1) / max_batch))
    tx = df.groupBy("stream", "ord", "slice").agg(F.count(F.lit(1)).alias("n_changes"), F.min_by("offset", "arrival_ix").alias("first_offset"))
    last = F.col("slice") == F.max("slice").over(Window.partitionBy("stream", "ord"))
    tx = numbered(in_ranges(tx.withColumn("ends_run", last), "stream", "ord", "slice"), ["stream"], ["ord", "slice"], "tx")
    return df.join(tx, ["stream", "ord", "slice"]).withColumn("change_ix", F.col("arrival_ix"))


def transaction_table(changes: DataFrame) -> DataFrame:
    """One row per transaction of `transactions()`: stream, tx, first_offset, n_changes, ends_run."""
    return changes.select("stream", "tx", "first_offset", "n_changes", "ends_run", "ord").distinct()


def stop_after(changes: DataFrame, n: int) -> DataFrame:
    """The transactions up to the first at whose end n changes or more are applied; a run that is cut is
    not checkpointed, as its last transaction is missing."""
    per = running(in_steps(transaction_table(changes), "tx"), ["stream"], ["tx"], F.col("n_changes"), "upto")
    kept = per.filter(F.col("upto") - F.col("n_changes") < n).select("stream", "tx")
    return changes.join(kept, ["stream", "tx"], "left_semi")


def checkpoints(revised: DataFrame) -> DataFrame:
    """Checkpoint rows at complete runs: stream, offset (of the last slice's first change), revision."""
    return revised.filter("ends_run").select("stream", F.col("first_offset").alias("offset"), "revision", "tx")


def last_offsets(points: DataFrame) -> DataFrame:
    """The high-water mark of each stream; it never goes back."""
    return points.groupBy("stream").agg(F.max_by("offset", F.struct(offset_ord("offset"), "revision")).alias("last_offset"))


def dropped_changes(changes: DataFrame, writes: DataFrame) -> DataFrame:
    """Changes that are no deletes and led to no write."""
    hit = writes.filter("writes > 0").select("tx", "change_ix")
    return changes.filter("operation <> 'delete'").join(hit, ["tx", "change_ix"], "left_anti")


@dataclass
class Consumed:
    processed: int
    from_offset: str | None
    last_offset: str | None


def consume(source, store, decode: ev.Decoder, stop: int | None = None, max_batch_size: int = MAX_BATCH, tx_wall=None) -> Consumed:
    """Resume, read, batch, decode, fold, validate, publish. Data files, revisions, cursors and checkpoint
    rows are published as one manifest, so a crash leaves all or nothing and a rerun continues.

    `tx_wall` is the commit instant (default: now); every transaction of a batch shares it."""
    check_max_batch(max_batch_size)
    store.require_history()
    head = store.head()
    start = head.cursors.get(source.name)
    changes = source.read(start)
    wall = F.lit(tx_wall).cast("timestamp") if tx_wall is not None else F.current_timestamp()
    changes = transactions(changes, max_batch_size).withColumn("tx_wall", wall)
    if stop is not None:
        changes = stop_after(changes, stop)
    changes = store.stage(changes, "changes")
    processed = changes.count()
    if not processed:
        return Consumed(0, start, start)
    check_formats(changes)
    check_changes(changes, source.name)
    base = head.last_tx
    changes = changes.withColumn("tx", F.col("tx") + base)
    rows = store.stage(decode(changes), "events")
    ev.check_events(rows)
    history = store.events()
    every = rows if history is None else incremental.relevant(history, rows, store.graph).unionByName(rows)
    lost = dropped_changes(changes, folding.effective_writes(every)).orderBy("tx", "change_ix").limit(1).collect()
    if lost:
        r = lost[0]
        raise DroppedChangeError(f"stream {source.name!r}, offset {r['offset']!r}: {r['operation']} of {r['shape']} {r['key']!r} wrote nothing")
    versions = folding.fold(every)
    if store.graph is not None:
        constraints.check(every, versions, store.graph, after_tx=base, unique=store.unique)
    table = transaction_table(changes)
    captured = folding.captured_transactions(versions.filter(F.col("tx_from") > base), table, head.revision == 0)
    revised = store.stage(folding.revisions(captured, head.revision), "revisions")
    points = checkpoints(revised)
    top = revised.agg(F.max("revision").alias("r"), F.max("tx").alias("t")).first()
    mark = points.groupBy("stream").agg(F.max_by("offset", "tx").alias("offset")).collect()
    cursors = {**head.cursors, **{r["stream"]: r["offset"] for r in mark}}
    store.publish(head, events=rows, revisions=revised.select("tx", "revision", "captured"), points=points, cursors=cursors, revision=max(head.revision, top["r"]), last_tx=top["t"])
    return Consumed(processed, start, cursors.get(source.name))
