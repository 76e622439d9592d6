"""Change logs from files and tables.

A change log has the columns stream, arrival_ix, offset, shape, key, operation, value (any type). Each
source keeps its own rule for offsets; `read(after)` returns what lies strictly after a cursor, in order.
Sources are lazy DataFrames; checks that must fail a read run as one aggregate before the data are used.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold import errors
from chronofold.functions import offsets as O
from chronofold.functions.positions import in_ranges, in_steps, numbered, running

LOG_COLUMNS = ("stream", "arrival_ix", "offset", "shape", "key", "operation", "value")
OPERATIONS = ("insert", "update", "delete")


class LogSource:
    """A named, ordered change log."""

    def __init__(self, df: DataFrame, name: str, resume: Callable[[DataFrame, str | None], DataFrame] | None = None, position: Callable[[str | None], str | None] | None = None):
        self.df, self.name, self._resume, self._position = df, name, resume, position

    def read(self, after: str | None = None) -> DataFrame:
        """Changes strictly after the cursor; order columns are `ord` and `arrival_ix`."""
        after = self._position(after) if self._position else after
        df = self._resume(self.df, after) if self._resume else self.df
        df = df.withColumn("ord", O.offset_ord("offset"))
        if after is not None:
            df = df.filter(F.col("ord") > O.offset_ord(F.lit(after)))
        return df


def log_source(df: DataFrame, name: str) -> LogSource:
    """In-memory or file log: rows sorted by offset, ties by arrival."""
    return LogSource(df.withColumn("stream", F.lit(name)), name)


def narrow_changes(df: DataFrame) -> DataFrame:
    """Adds `problem`: why a row is no valid change, or null. Logs without a column `value` have their payload
    in columns of their own."""
    empty = F.col("value").isNull() if "value" in df.columns else F.lit(False)
    ok = F.col("operation").isin(*OPERATIONS)
    return df.withColumn("problem", F.when(F.col("operation").isNull() | ~ok, F.concat(F.lit("unsupported operation "), F.coalesce("operation", F.lit("null")))).when(F.col("key").isNull(), "missing key").when((F.col("operation") != "delete") & empty, "missing value"))


def check_changes(df: DataFrame, stream: str) -> DataFrame:
    """The rows if all are valid changes; raises with the first problem by offset."""
    bad = narrow_changes(df).filter("problem is not null").orderBy(O.offset_ord("offset"), "arrival_ix").limit(1).collect()
    if bad:
        raise errors.SourceError(bad[0]["problem"], stream, bad[0]["offset"])
    return df


def read_outcomes(frames: DataFrame) -> DataFrame:
    """(stream, outcome) of reading each stream: must-refetch, error or sentinel (changes under an offset that
    marks no place) fail it, other control frames do not matter: ok."""
    flag = lambda c: F.max(F.coalesce(c, F.lit(False)))
    refetch, error = flag(F.col("control") == "must-refetch"), flag(F.col("control") == "error")
    sentinel = flag(F.col("control").isNull() & F.col("batch_offset").isin("-1", "now"))
    return frames.groupBy("stream").agg(F.when(refetch, "must-refetch").when(error, "error").when(sentinel, "sentinel").otherwise("ok").alias("outcome"))


def within(spark: SparkSession, seconds: float, action: Callable, late: Exception):
    """The action's result; its Spark jobs are cancelled and `late` is raised if it takes longer."""
    if seconds == float("inf"):
        return action()
    context, tag = spark.sparkContext, f"deadline-{uuid.uuid4().hex}"
    passed = threading.Event()

    def stop() -> None:
        passed.set()
        context.cancelJobsWithTag(tag)

    clock = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    clock.start()
    try:
        out = action()
    except Exception as e:
        if passed.is_set():
            raise late from e
        raise
    finally:
        clock.cancel()
        context.removeJobTag(tag)
    if passed.is_set():
        raise late
    return out


FAILURES = {
    "must-refetch": (errors.MustRefetchError, "the log asks for a full read"),
    "error": (errors.ControlError, "the log reported an error"),
    "sentinel": (errors.SourceError, "changes under a sentinel offset"),
}


def batch_offset_source(frames: DataFrame, name: str, timeout_s: float = 30.0, handle: str | None = None, on_handle: Callable[[str], None] | None = None) -> LogSource:
    """Shape log: frames with batch, ix, control, batch_offset and change columns. Every change gets the
    last offset of its batch. `up-to-date` ends a batch; `must-refetch` and `error` fail; other control
    frames are ignored; changes under a sentinel offset fail; the read has a deadline. It resumes from a cursor
    only with the shape's handle; `on_handle` hears the handle of the last frame that has one."""

    def resume(df: DataFrame, after: str | None) -> DataFrame:
        late = errors.CatchUpTimeout("not caught up", name, after)
        outcome = within(df.sparkSession, timeout_s, lambda: read_outcomes(df).first(), late)
        if outcome is not None and outcome["outcome"] in FAILURES:
            kind, said = FAILURES[outcome["outcome"]]
            raise kind(said, name, after)
        if on_handle is not None and "handle" in df.columns:
            last = df.filter("handle is not null").agg(F.max_by("handle", F.struct("batch", "ix")).alias("h")).first()["h"]
            if last is not None:
                on_handle(last)
        return stamp_batches(df)

    return LogSource(frames.withColumn("stream", F.lit(name)), name, resume, lambda after: after if handle is not None else None)


def stamp_batches(frames: DataFrame) -> DataFrame:
    """Every change of a batch under the batch's last offset; control frames go."""
    last = F.max_by("batch_offset", F.struct("batch", "ix")).over(Window.partitionBy("stream", "batch"))
    return frames.withColumn("offset", last).filter("control is null").withColumn("arrival_ix", F.col("ix"))


def resume_position(offset: Column, handle: Column) -> Column:
    """A shape log resumes from an offset only with its handle; else it is read in full (null)."""
    return F.when(handle.isNotNull(), offset)


def cursor_problem(cursor: Column, retained_from: Column) -> Column:
    """Why a durable stream cannot resume from a cursor: it is not composite, or its append is gone."""
    p = O.parse_composite(cursor)
    old = retained_from.isNotNull() & (p["base"] != O.STREAM_START) & (O.base_key(p["base"]) < O.base_key(retained_from))
    return F.when(cursor.isNull(), F.lit(None).cast("string")).when(p.isNull(), "foreign cursor").when(old, "not retained")


def mapped(messages: DataFrame, name: str, mapper: Column, raw: str = "raw") -> DataFrame:
    """Messages with `value` = mapper; a message that it cannot map raises, naming stream and offset."""
    out = messages.withColumn("value", mapper)
    bad = mapper_failures(out, raw).orderBy(O.offset_ord("offset")).limit(1).collect()
    if bad:
        raise errors.MapperError(f"the mapper failed on {bad[0][raw]!r}", name, bad[0]["offset"])
    return out


def mapper_failures(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """Messages that have content, but no value."""
    return messages.filter(F.col(raw).isNotNull() & F.col("value").isNull())


def message_offsets(messages: DataFrame, granularity: str = "message") -> DataFrame:
    """Durable stream: messages with stream, append_base, append_end, ix (0-based in the append). The last
    message of an append is `<end>,0`, the others `<base>,<i + 1>`; granularity `append` puts all of an
    append under `<end>,0`. Batches of a read may be cut anywhere: only the append counts."""
    if granularity not in ("message", "append"):
        raise ValueError("granularity is message or append")
    end = O.compose_offset("append_end", F.lit(0))
    if granularity == "append":
        return messages.withColumn("offset", end)
    last = F.col("ix") == F.max("ix").over(Window.partitionBy("stream", "append_base"))
    return messages.withColumn("offset", F.when(last, end).otherwise(O.compose_offset("append_base", F.col("ix") + 1)))


def append_source(messages: DataFrame, name: str, granularity: str = "message", retained_from: str | None = None) -> LogSource:
    """Durable stream source. A cursor must be composite; `<base>,<n>` re-reads from base and drops n."""

    def resume(df: DataFrame, after: str | None) -> DataFrame:
        if after is not None:
            problem = df.sparkSession.range(1).select(cursor_problem(F.lit(after), F.lit(retained_from)).alias("p")).first()["p"]
            if problem == "foreign cursor":
                raise errors.OffsetFormatError(f"cursor {after!r} is not one of stream {name!r}")
            if problem is not None:
                raise errors.RetentionError("the cursor is older than what the log retains", name, after)
        return message_offsets(df, granularity)

    return LogSource(messages.withColumn("stream", F.lit(name)), name, resume)


def skip_consumed(messages: DataFrame, base: str, consumed: int) -> DataFrame:
    """Mid-append resume: messages of appends from base on, without the first `consumed`."""
    rest = messages.filter(O.base_key("append_base") >= O.base_key(F.lit(base)))
    first = (F.col("append_base") == base) & (F.col("ix") < consumed)
    return rest.filter(~first)


def is_change(operation: str = "operation", key: str = "key") -> Column:
    """A typed record is a change if it has a key and an operation; control frames have neither."""
    return F.col(key).isNotNull() & F.col(operation).isNotNull()


def state_changes(records: DataFrame, types: list[str] | None = None) -> DataFrame:
    """State protocol: {type, key, value, operation, txid} to changes. `upsert` becomes `update`, a missing
    value an empty object, control frames go; optionally only some types."""
    df = records.filter(is_change())
    if types is not None:
        df = df.filter(F.col("type").isin(*types))
    op = F.when(F.col("operation") == "upsert", "update").otherwise(F.col("operation"))
    return df.withColumns({"shape": F.col("type"), "operation": op, "value": F.coalesce("value", F.lit("{}"))})


def reset_streams(records: DataFrame) -> DataFrame:
    """(stream) of the logs that were reset: what was built from them is void."""
    return records.filter("control = 'reset'").select("stream").distinct()


def check_reset(records: DataFrame, name: str) -> None:
    if not reset_streams(records).isEmpty():
        raise errors.ResetError("the stream was reset", name)


def transaction_offsets(changes: DataFrame) -> DataFrame:
    """Granularity `transaction`: each run of neighbours with one txid gets its last change's offset; a
    null txid keeps its own. Streams are independent; within one the runs are counted by slices, whose first
    rows look at the last row of the slice before."""
    rows = in_steps(changes, "arrival_ix")
    ends = rows.groupBy("stream", "_slice").agg(F.max_by(F.struct("txid"), "arrival_ix").alias("_end"))
    before = F.lag("_end").over(Window.partitionBy("stream").orderBy("_slice"))
    ends = ends.select(F.col("stream").alias("_s"), F.col("_slice").alias("_at"), before["txid"].alias("_prior"))
    rows = rows.join(ends, F.col("stream").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_at"))).drop("_s", "_at")
    w = Window.partitionBy("stream", "_slice").orderBy("arrival_ix")
    prior = F.coalesce(F.lag(F.struct("txid")).over(w), F.struct(F.col("_prior").alias("txid")))["txid"]
    rows = rows.withColumn("_new", F.when(F.col("txid").isNull() | ~F.col("txid").eqNullSafe(prior), 1).otherwise(0)).drop("_prior")
    runs = running(rows, ["stream"], ["arrival_ix"], F.col("_new"), "_run").drop("_slice", "_new")
    last = F.max_by("offset", "arrival_ix").over(Window.partitionBy("stream", "_run"))
    return runs.withColumn("offset", last).drop("_run")


def state_source(records: DataFrame, name: str, types: list[str] | None = None, granularity: str = "message") -> LogSource:
    def resume(df: DataFrame, after: str | None) -> DataFrame:
        check_reset(df, name)
        changes = state_changes(df, types)
        return transaction_offsets(changes) if granularity == "transaction" else changes

    return LogSource(records.withColumn("stream", F.lit(name)), name, resume)


def padded(n: Column, width: int) -> Column:
    """A position as text of at least `width` digits; longer ones stay whole (lpad would cut them)."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def jsonl_lines(lines: DataFrame) -> DataFrame:
    """Lines (line_no from 1, text) of a JSONL log: blank lines go, offsets are padded line numbers."""
    df = lines.withColumn("text", F.trim("text")).filter("text <> ''")
    return df.withColumn("offset", padded(F.col("line_no"), 4))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSONL file (or folder) as typed rows with file, line_no and offset; malformed lines raise."""
    text = spark.read.option("wholetext", False).text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    # the upper bits of the id are the split, and splits of a file rise with their place in it
    lines = numbered(text.withColumn("_slice", F.shiftright("at", 33)), ["file"], ["at"], "line_no")
    df = jsonl_lines(lines.select("file", "line_no", F.col("value").alias("text")))
    return df.select("file", "line_no", "offset", F.from_json("text", schema, {"mode": "FAILFAST"}).alias("row"))


def filtered_offsets(messages: DataFrame, keep: Column, order: str, width: int = 4) -> DataFrame:
    """Offsets are given after the filter, so unmodelled messages leave no gaps and no dropped changes."""
    rows = numbered(in_ranges(messages.filter(keep), "stream", order), ["stream"], [order], "_n")
    return rows.withColumn("offset", padded(F.col("_n"), width)).drop("_n")


def export_spans(spans: DataFrame) -> DataFrame:
    """Spans to a change log: flat records, padded positions per stream, peer name by preference."""
    peer = F.coalesce("service_peer_name", "peer_service")
    rows = numbered(in_steps(spans, "arrival_ix"), ["stream"], ["arrival_ix"], "_n")
    return rows.withColumns({"offset": padded(F.col("_n"), 4), "peer": peer, "operation": F.lit("insert"), "shape": F.lit("span"), "key": F.col("span_id")}).drop("_n")


def hr_time(seconds, nanos) -> Column:
    """[seconds, nanoseconds] to a timestamp of milliseconds."""
    ms = F.floor((F.col(seconds) * F.lit(1_000_000_000).cast("bigint") + F.col(nanos)) / 1_000_000).cast("bigint")
    return F.timestamp_millis(ms)


def snapshot_stream(rows: DataFrame, key: str, offsets_before: int = 0, width: int = 4) -> DataFrame:
    """A collection snapshot as a stream: sorted by key, numbered from offsets_before + 1."""
    out = numbered(in_ranges(rows, "stream", key), ["stream"], [key], "_n")
    return out.withColumn("offset", padded(F.col("_n") + offsets_before, width)).drop("_n")


def http_batches(batches: DataFrame, cursor: int) -> DataFrame:
    """Posted batches {seq, events[]}: seq is the offset; batches at or before the cursor process nothing."""
    fresh = batches.filter(F.col("seq") > cursor)
    return fresh.select("seq", F.posexplode("events").alias("event_ix", "event"))


def table_events(df: DataFrame, required: dict[str, list[str]], type_col: str = "event_type") -> DataFrame:
    """Append-only event table: adds `problem` where a field that the row's type needs is null."""
    problem = F.lit(None).cast("string")
    for kind, fields in required.items():
        for f in fields:
            problem = F.when((F.col(type_col) == kind) & F.col(f).isNull(), F.lit(f"{kind} needs {f}")).otherwise(problem)
    return df.withColumn("problem", problem)
