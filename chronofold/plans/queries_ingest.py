"""Queries on consumption, the fold and read modes, over events taken as a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions.offsets import encode_offset
from chronofold.operators.views import View, recorded_at, valid_at
from chronofold.plans import constraints, fold as folding, ingest
from chronofold.plans.events import FIELDS
from chronofold.plans.registry import query, table


def node_events(df: DataFrame, tx, op, props, valid_from=None, valid_to=None, clear=None, wall=None) -> DataFrame:
    """Rows to graph events on User nodes."""
    none = F.lit(None)
    values = {
        "op": op, "kind": F.lit("User"), "id": F.col("user_id").cast("string"), "props": props,
        "valid_from": valid_from if valid_from is not None else none.cast("timestamp"),
        "valid_to": valid_to if valid_to is not None else none.cast("timestamp"),
        "clear_valid_to": clear if clear is not None else F.lit(False),
    }
    cols = [values.get(f, none.cast("string")).alias(f) for f in FIELDS]
    return df.select(tx.cast("bigint").alias("tx"), F.col("event_id").alias("change_ix"), F.lit(0).alias("event_ix"), (wall if wall is not None else F.col("ts").cast("timestamp")).alias("tx_wall"), *cols)


def plain_events(spark, sf) -> DataFrame:
    """One transaction per event: errors remove the user, others set floor(value)."""
    df = table(spark, sf, "events")
    op = F.when(F.col("event_type") == "error", "node.remove").otherwise("node.upsert")
    return node_events(df, F.col("event_id"), op, F.floor("value").cast("bigint").cast("string"))


def versions(spark, sf) -> DataFrame:
    return folding.fold(plain_events(spark, sf))


_FOLD = """with e as (
  select event_id, user_id, event_type = 'error' as deleted, case when event_type <> 'error' then floor(value)::bigint end as v from events
), s as (
  select *, lag(deleted) over w as pd, lag(v) over w as pv, row_number() over w as rn,
    last_value(v ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as props from e window w as (partition by user_id order by event_id)
), c as (
  select * from s where not (deleted and (rn = 1 or pd)) and not (not deleted and rn > 1 and not pd and v = pv)
), ver as (
  select user_id::varchar as id, props::varchar as props, deleted, event_id as tx_from, lead(event_id) over (partition by user_id order by event_id) as tx_to from c
)"""


@query(_FOLD + " select * from ver")
def history_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded intervals of every user's coalesced versions."""
    return versions(spark, sf).select("id", "props", "deleted", "tx_from", "tx_to")


@query(_FOLD + " select id, props from ver where not deleted and tx_from <= 5000 and (tx_to is null or tx_to > 5000)")
def asof_recorded(spark, sf):
    """What was believed when the stream stood at event 5000."""
    return versions(spark, sf).filter(recorded_at(5000)).filter("not deleted").select("id", "props")


@query(_FOLD + " select (select count(*) from e)::bigint as n_events, count(*)::bigint as n_versions, sum(deleted::int)::bigint as n_tombstones from ver")
def coalesced_versions(spark, sf):
    v = versions(spark, sf).agg(F.count(F.lit(1)).alias("n_versions"), F.sum(F.col("deleted").cast("bigint")).alias("n_tombstones"))
    return v.crossJoin(F.broadcast(table(spark, sf, "events").agg(F.count(F.lit(1)).alias("n_events"))))


@query(_FOLD + """, t as (select event_id as tx, exists(select 1 from ver where tx_from = event_id) or event_id = (select min(event_id) from events) as captured from events)
select tx, captured, sum(captured::int) over (order by tx)::bigint as revision from t""")
def recorded_revisions(spark, sf):
    """Dense revisions of capturing transactions, carried forward over the others."""
    tx = table(spark, sf, "events").select(F.col("event_id").alias("tx"))
    return folding.revisions(folding.captured_transactions(versions(spark, sf), tx)).select("tx", "captured", "revision")


def valid_events(spark, sf) -> DataFrame:
    """signup states a start one day before, error ends the window at ts, view reopens it, the rest set
    properties; the wall clock of a transaction is its ts."""
    df = table(spark, sf, "events")
    kind, ts = F.col("event_type"), F.col("ts").cast("timestamp")
    return node_events(df, F.col("event_id"), F.lit("node.upsert"), F.floor(F.col("value") / 10).cast("bigint").cast("string"), F.when(kind == "signup", ts - F.expr("interval 1 day")), F.when(kind == "error", ts), kind == "view")


_VALID = """with e as (
  select event_id, user_id, ts, event_type, floor(value / 10)::bigint as v, row_number() over (partition by user_id order by event_id) as rn from events
), s as (
  select *, case when rn = 1 then case when event_type = 'signup' then ts - interval 1 day when event_type = 'error' then null else ts end end as start,
    case when rn = 1 or event_type in ('error', 'view') then event_id end as end_at from e
), f as (
  select *, first_value(start) over (partition by user_id order by event_id) as valid_from,
    last_value(end_at ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as end_id from s
), g as (
  select f.*, case when x.event_type = 'error' then x.ts end as valid_to from f join e x on x.event_id = f.end_id
), h as (
  select *, lag(v) over w as pv, lag(valid_to) over w as pt from g window w as (partition by user_id order by event_id)
), c as (
  select * from h where rn = 1 or v is distinct from pv or valid_to is distinct from pt
), ver as (
  select user_id::varchar as id, v::varchar as props, valid_from, valid_to, event_id as tx_from, lead(event_id) over (partition by user_id order by event_id) as tx_to from c
)"""


def _ntz(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def valid_versions(spark, sf) -> DataFrame:
    return folding.fold(valid_events(spark, sf))


@query(_VALID + " select * from ver")
def valid_windows(spark, sf):
    """Valid windows: first start kept, ends set and cleared."""
    return _ntz(valid_versions(spark, sf).select("id", "props", "valid_from", "valid_to", "tx_from", "tx_to"))


@query(_VALID + ", m as (select max(ts) - interval 2 day as t from events) select id, props from ver, m where tx_to is null and (valid_from is null or valid_from <= t) and (valid_to is null or valid_to > t)")
def asof_valid(spark, sf):
    """Current beliefs about an instant two days before the last event."""
    t = table(spark, sf, "events").agg((F.max("ts") - F.expr("interval 2 day")).cast("timestamp").alias("t"))
    return valid_versions(spark, sf).filter("tx_to is null").join(F.broadcast(t), valid_at(F.col("t"))).select("id", "props")


@query(_VALID + ", m as (select max(ts) - interval 2 day as t from events) select id, props from ver, m where tx_from <= 6000 and (tx_to is null or tx_to > 6000) and (valid_from is null or valid_from <= t) and (valid_to is null or valid_to > t)")
def bitemporal_composed(spark, sf):
    """Both axes pinned: what event 6000 knew about that instant."""
    t = table(spark, sf, "events").agg((F.max("ts") - F.expr("interval 2 day")).cast("timestamp").alias("t"))
    return valid_versions(spark, sf).filter(recorded_at(6000)).join(F.broadcast(t), valid_at(F.col("t"))).select("id", "props")


@query(_VALID + " select id, props, valid_to is not null as ended from ver where tx_to is null")
def include_ended(spark, sf):
    return View(valid_versions(spark, sf), mode="ended").nodes("User").select("id", "props", F.col("valid_to").isNotNull().alias("ended"))


@query(_FOLD + " select id, props, deleted from ver where tx_to is null")
def include_tombstones(spark, sf):
    return View(versions(spark, sf), mode="tombstones").nodes("User").select("id", "props", "deleted")


@query(_VALID + " select id, props, valid_from, valid_to from ver where valid_from is null")
def born_ended(spark, sf):
    """Rows first stated with a past end and no start: their start is unknown."""
    return _ntz(valid_versions(spark, sf).filter("valid_from is null").select("id", "props", "valid_from", "valid_to"))


@query(_VALID + " select id, props, case when valid_to is null or valid_from <= valid_to then valid_from end as valid_from, valid_to from ver where tx_to is null")
def repaired_windows(spark, sf):
    """Inverted windows normalised to "ended, start unknown"."""
    return _ntz(folding.repair_windows(valid_versions(spark, sf)).filter("tx_to is null").select("id", "props", "valid_from", "valid_to"))


@query("select event_id::varchar as id from events where event_id % 6 = 0")
def inverted_windows(spark, sf):
    """Every third version ends a day after it starts; half of these are written the wrong way round."""
    day, i = F.expr("interval 1 day"), F.col("event_id")
    df = table(spark, sf, "events").select(i.cast("string").alias("id"), F.col("ts").cast("timestamp").alias("at"), i)
    end = F.when(i % 6 == 0, F.col("at") - day).when(i % 3 == 0, F.col("at") + day)
    return constraints.inverted_windows(df.select("id", F.col("at").alias("valid_from"), end.alias("valid_to"))).select("id")


def log(spark, sf) -> DataFrame:
    """Events as a log of runs of five changes under one offset."""
    df = table(spark, sf, "events")
    return df.select(F.lit("events").alias("stream"), F.col("event_id").alias("arrival_ix"), encode_offset(F.floor(F.col("event_id") / 5)).alias("offset"), F.col("event_type").alias("shape"), F.col("user_id").cast("string").alias("key"), F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("operation"), "event_id", "user_id", "value", "ts")


_TX = """with t as (select event_id, event_id // 5 as run, (event_id % 5) // 2 as slice, event_id // 5 * 3 + (event_id % 5) // 2 + 1 as tx from events)"""


@query(_TX + " select event_id, tx::bigint as tx from t")
def tx_batches(spark, sf):
    """Runs of five in transactions of at most two."""
    return ingest.transactions(log(spark, sf), 2).select("event_id", "tx")


@query(_TX + " select event_id, tx::bigint as tx from t where tx <= 100")
def stop_after_n(spark, sf):
    """Stop once 167 changes are applied: at the edge of the transaction that gets there."""
    return ingest.stop_after(ingest.transactions(log(spark, sf), 2), 167).select("event_id", "tx")


def _revised(spark, sf) -> DataFrame:
    changes = ingest.transactions(log(spark, sf), 2)
    op = F.when(F.col("operation") == "delete", "node.remove").otherwise("node.upsert")
    folded = folding.fold(node_events(changes, F.col("tx"), op, F.floor("value").cast("bigint").cast("string")))
    return folding.revisions(folding.captured_transactions(folded, ingest.transaction_table(changes)))


_CHECK = _TX + """, e as (
  select t.tx, e.event_id, user_id, event_type = 'error' as deleted, case when event_type <> 'error' then floor(value)::bigint end as v from t join events e using (event_id)
), p as (
  select *, last_value(v ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as props,
    lead(tx) over (partition by user_id order by event_id) as nt, sum((not deleted)::int) over (partition by user_id order by event_id) as ups from e
), l as (
  select * from p where (nt is null or nt <> tx) and ups > 0
), s as (
  select *, lag(deleted) over w as pd, lag(props) over w as pp, row_number() over w as rn from l window w as (partition by user_id order by tx)
), c as (
  select distinct tx from s where not (deleted and (rn = 1 or pd)) and not (rn > 1 and deleted = pd and props = pp)
), r as (
  select tx, (tx - 1) // 3 as run, (tx - 1) % 3 as slice, sum((tx = 1 or tx in (select tx from c))::int) over (order by tx)::bigint as revision from (select distinct tx from t)
)"""


@query(_CHECK + " select lpad(run::varchar, 16, '0') as \"offset\", revision, tx::bigint as tx from r where slice = 2 or tx = (select max(tx) from r)")
def checkpoint_rows(spark, sf):
    """A checkpoint per complete run with the last revision at or before it."""
    return ingest.checkpoints(_revised(spark, sf)).select("offset", "revision", "tx")


@query(_CHECK + " select tx::bigint as tx, revision from r")
def anchor_carry_forward(spark, sf):
    return _revised(spark, sf).select("tx", "revision")


@query("select 'events' as stream, lpad((max(event_id) // 5)::varchar, 16, '0') as last_offset from events")
def last_offset(spark, sf):
    return ingest.last_offsets(ingest.checkpoints(_revised(spark, sf)))


@query("select event_id, event_type as shape from events where event_type = 'purchase'")
def dropped_changes(spark, sf):
    """A decoder that models four of five event types drops the fifth."""
    changes = ingest.transactions(log(spark, sf), 1000)
    known = changes.filter("shape <> 'purchase'")
    op = F.when(F.col("operation") == "delete", "node.remove").otherwise("node.upsert")
    writes = folding.effective_writes(node_events(known, F.col("tx"), op, F.lit("{}")))
    return ingest.dropped_changes(changes, writes).select("event_id", "shape")


@query("select tx, count(*)::bigint as writes from (select event_id // 5 + 1 as tx, event_id from events) group by 1")
def write_receipts(spark, sf):
    """Write intents per transaction: removing an absent node still counts."""
    changes = ingest.transactions(log(spark, sf), 1000)
    op = F.when(F.col("operation") == "delete", "node.remove").otherwise("node.upsert")
    return folding.effective_writes(node_events(changes, F.col("tx"), op, F.lit("{}"))).groupBy("tx").agg(F.sum("writes").alias("writes"))


@query("""with o as (select event_id, 1 as r, user_id::varchar as id from events union all select event_id, 3, user_id::varchar from events)
select id, count(*)::bigint as n_removed_last from (select id, event_id, max(r) as last_rank from o group by all) where last_rank = 3 group by id""")
def event_apply_order(spark, sf):
    """A change that removes and upserts one node in any emit order ends removed: removals apply last."""
    df = table(spark, sf, "events")
    a = node_events(df, F.col("event_id"), F.lit("node.remove"), F.lit(None).cast("string"))
    b = node_events(df, F.col("event_id"), F.lit("node.upsert"), F.lit("{}")).withColumn("event_ix", F.lit(1))
    s = folding.states(a.unionByName(b)).filter("last_in_tx and deleted")
    return s.groupBy("id").agg(F.count(F.lit(1)).alias("n_removed_last"))
