"""Queries on offsets and sources, over events taken as change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.functions import offsets as O
from chronofold.sources import logs
from chronofold.plans.registry import query, table


def events(spark, sf):
    return table(spark, sf, "events")


def _tuples(df: DataFrame) -> DataFrame:
    """Offsets `<event_id div 7>_<event_id mod 7>`."""
    return df.select("event_id", "user_id", F.concat_ws("_", F.floor(F.col("event_id") / 7).cast("string"), (F.col("event_id") % 7).cast("string")).alias("offset"))


def _rank(df: DataFrame) -> DataFrame:
    """Rank by offset order inside each user's stream."""
    w = Window.partitionBy("user_id").orderBy(O.offset_ord("offset"), "event_id")
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).select("event_id", "offset", "rank")


@query("""select event_id, (event_id // 7)::varchar || '_' || (event_id % 7)::varchar as "offset",
  row_number() over (partition by user_id order by event_id // 7, event_id % 7, event_id)::bigint as rank from events""")
def offset_sort_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return _rank(_tuples(events(spark, sf)))


@query("""select event_id, (event_id // 7)::varchar || case when event_id % 7 = 3 then '_inf' else '_' || (event_id % 7)::varchar end as "offset",
  row_number() over (partition by user_id order by event_id // 7, case when event_id % 7 = 3 then 99 else event_id % 7 end, event_id)::bigint as rank from events""")
def offset_inf(spark, sf):
    n = F.when(F.col("event_id") % 7 == 3, "inf").otherwise((F.col("event_id") % 7).cast("string"))
    df = events(spark, sf).select("event_id", "user_id", F.concat_ws("_", F.floor(F.col("event_id") / 7).cast("string"), n).alias("offset"))
    return _rank(df)


@query("""select event_id, (event_id // 7)::varchar || '_0,' || (event_id % 7)::varchar as "offset",
  row_number() over (partition by user_id order by event_id // 7, event_id % 7, event_id)::bigint as rank from events""")
def offset_composite(spark, sf):
    df = events(spark, sf)
    base = F.concat(F.floor(F.col("event_id") / 7).cast("string"), F.lit("_0"))
    return _rank(df.select("event_id", "user_id", O.compose_offset(base, F.col("event_id") % 7).alias("offset")))


@query("""with o as (select event_id, user_id, event_id // 7 as a, event_id % 7 as b, lag(event_id) over (partition by user_id order by event_id) as p from events)
select event_id, case when p is null then -1 when p // 7 = a and p % 7 = b then 0 when (p // 7, p % 7) < (a, b) then 1 else -1 end::integer as cmp from o""")
def compare_offsets(spark, sf):
    df = _tuples(events(spark, sf))
    before = F.lag("offset").over(Window.partitionBy("user_id").orderBy("event_id"))
    df = df.withColumn("before", before)
    return df.select("event_id", F.coalesce(O.compare_offsets("offset", "before"), F.lit(-1)).cast("int").alias("cmp"))


@query("""select event_id, case when event_id % 3 = 0 then (event_id // 7)::varchar end as base, case when event_id % 3 = 0 then event_id % 7 end::bigint as consumed,
  case when event_id % 3 = 0 then (event_id // 7)::varchar else event_id::varchar end as ackable from events""")
def parse_composite_offset(spark, sf):
    plain = F.col("event_id").cast("string")
    offset = F.when(F.col("event_id") % 3 == 0, O.compose_offset(F.floor(F.col("event_id") / 7).cast("string"), F.col("event_id") % 7)).otherwise(plain)
    df = events(spark, sf).select("event_id", offset.alias("offset"))
    p = O.parse_composite("offset")
    return df.select("event_id", p["base"].alias("base"), p["consumed"].alias("consumed"), O.ackable_offset("offset").alias("ackable"))


@query("""select event_id, lpad((event_id // 10)::varchar, 16, '0') as "offset", (event_id % 10)::bigint as sub_offset from events""")
def fork_point(spark, sf):
    cursor = O.compose_offset(O.encode_offset(F.floor(F.col("event_id") / 10)), F.col("event_id") % 10)
    p = O.fork_point(cursor)
    return events(spark, sf).select("event_id", p["offset"].alias("offset"), p["sub_offset"].alias("sub_offset"))


@query("""select event_id, lpad(event_id::varchar, 16, '0') as encoded, event_id::bigint as decoded from events""")
def encode_offset(spark, sf):
    e = O.encode_offset("event_id")
    return events(spark, sf).select("event_id", e.alias("encoded"), O.decode_offset(e).alias("decoded"))


@query("""select event_id, event_id // 5 as revision, strftime(ts, '%Y-%m-%dT%H:%M:%S') as at,
  row_number() over (partition by user_id order by event_id // 5, strftime(ts, '%Y-%m-%dT%H:%M:%S'), event_id)::bigint as rank from events""")
def recorded_instants(spark, sf):
    text = F.concat(F.lit("r1:"), F.lpad(F.floor(F.col("event_id") / 5).cast("string"), 16, "0"), F.lit(":"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    df = events(spark, sf).select("event_id", "user_id", O.recorded_instant(text).alias("r"))
    w = Window.partitionBy("user_id").orderBy("r.revision", "r.at", "event_id")
    return df.select("event_id", F.col("r.revision").cast("bigint").alias("revision"), F.col("r.at").alias("at"), F.row_number().over(w).cast("bigint").alias("rank"))


def appends(df: DataFrame) -> DataFrame:
    """Events as appends of ten messages; offsets are message counts of 16 digits."""
    n = F.floor(F.col("event_id") / 10)
    return df.select("event_id", F.lit("events").alias("stream"), F.when(n == 0, O.STREAM_START).otherwise(O.encode_offset(n * 10)).alias("append_base"), O.encode_offset((n + 1) * 10).alias("append_end"), (F.col("event_id") % 10).cast("int").alias("ix"))


_APPENDS = """with a as (select event_id, event_id // 10 as n, event_id % 10 as ix, case when event_id // 10 = 0 then '-1' else lpad((event_id // 10 * 10)::varchar, 16, '0') end as append_base,
  lpad((event_id // 10 * 10 + 10)::varchar, 16, '0') as append_end, max(event_id) over (partition by event_id // 10) as last_id from events)"""


@query(_APPENDS + """ select event_id, case when event_id = last_id then append_end || ',0' else append_base || ',' || (ix + 1)::varchar end as "offset" from a""")
def message_offsets(spark, sf):
    return logs.message_offsets(appends(events(spark, sf))).select("event_id", "offset")


@query(_APPENDS + """ select event_id, append_end || ',0' as "offset" from a""")
def append_offsets(spark, sf):
    return logs.message_offsets(appends(events(spark, sf)), "append").select("event_id", "offset")


@query(_APPENDS + """ select event_id, case when event_id = last_id then append_end || ',0' else append_base || ',' || (ix + 1)::varchar end as "offset" from a where event_id >= 504""")
def resume_mid_append(spark, sf):
    source = logs.append_source(appends(events(spark, sf)), "events")
    return source.read("0000000000000500,4").select("event_id", "offset")


@query(_APPENDS + """ select event_id from a where n >= 30 and not (n = 30 and ix < 4)""")
def skip_consumed(spark, sf):
    return logs.skip_consumed(appends(events(spark, sf)), "0000000000000300", 4).select("event_id")


@query("""with r as (select *, case when event_type = 'view' then null else event_id // 3 end as txid from events),
f as (select *, case when txid is null or txid is distinct from lag(txid) over (partition by user_id % 16 order by event_id) then 1 else 0 end as new from r),
g as (select *, sum(new) over (partition by user_id % 16 order by event_id) as run from f)
select event_id, max(lpad(event_id::varchar, 16, '0')) over (partition by user_id % 16, run) as "offset" from g""")
def txid_groups(spark, sf):
    df = events(spark, sf).withColumns({"stream": F.col("user_id") % 16, "arrival_ix": F.col("event_id"), "offset": O.encode_offset("event_id"), "txid": F.when(F.col("event_type") != "view", F.floor(F.col("event_id") / 3))})
    return logs.transaction_offsets(df).select("event_id", "offset")


_RECORDS = """with r as (select event_id, event_type as type, 'u' || user_id::varchar as key, case when event_id % 11 = 0 then null when event_id % 4 = 0 then 'upsert' when event_id % 4 = 1 then 'insert' else 'delete' end as operation,
  case when event_id % 5 = 0 then null else props end as value from events)"""


def records(df: DataFrame) -> DataFrame:
    """Events as typed records; every eleventh is a control frame without an operation."""
    op = F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 4 == 0, "upsert").when(F.col("event_id") % 4 == 1, "insert").otherwise("delete")
    return df.select("event_id", F.col("event_type").alias("type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), op.alias("operation"), F.when(F.col("event_id") % 5 != 0, F.col("props")).alias("value"))


@query(_RECORDS + """ select event_id, type as shape, key, case operation when 'upsert' then 'update' else operation end as operation, coalesce(value, '{}') as value from r where operation is not null""")
def state_protocol_rename(spark, sf):
    return logs.state_changes(records(events(spark, sf))).select("event_id", "shape", "key", "operation", "value")


@query(_RECORDS + """ select type as shape, count(*)::bigint as n from r where operation is not null and type in ('click', 'view') group by 1""")
def type_filter(spark, sf):
    return logs.state_changes(records(events(spark, sf)), ["click", "view"]).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


@query("""select event_id, max((event_id // 8)::varchar || '_' || (event_id % 8)::varchar) over (partition by event_id // 8) as "offset" from events where event_id % 8 <> 7 or event_id % 16 <> 15""")
def batch_offsets(spark, sf):
    """Batches of eight frames; the last frame of every second batch is the marker up-to-date."""
    b, i = F.floor(F.col("event_id") / 8), F.col("event_id") % 8
    frames = events(spark, sf).select("event_id", F.lit("shapes").alias("stream"), b.alias("batch"), i.alias("ix"), F.when((i == 7) & (F.col("event_id") % 16 == 15), "up-to-date").alias("control"), F.concat_ws("_", b.cast("string"), F.least(i, F.when(F.col("event_id") % 16 >= 8, 6).otherwise(7)).cast("string")).alias("batch_offset"))
    return logs.batch_offset_source(frames, "shapes").read().select("event_id", "offset")


@query("""select event_id, case when op not in ('insert', 'update', 'delete') then 'unsupported operation ' || op when key is null then 'missing key' when op <> 'delete' and value is null then 'missing value' end as problem
from (select event_id, case when event_id % 10 = 0 then 'truncate' when event_id % 3 = 0 then 'delete' else 'insert' end as op, case when event_id % 7 <> 0 then user_id end as key, case when event_id % 4 <> 0 then props end as value from events)""")
def change_narrowing(spark, sf):
    op = F.when(F.col("event_id") % 10 == 0, "truncate").when(F.col("event_id") % 3 == 0, "delete").otherwise("insert")
    df = events(spark, sf).select("event_id", op.alias("operation"), F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("key"), F.when(F.col("event_id") % 4 != 0, F.col("props")).alias("value"))
    return logs.narrow_changes(df).select("event_id", "problem")


@query("""select event_id, lpad(event_id::varchar, 4, '0') as "offset", (props::json->>'k')::bigint as k from events where event_id % 6 <> 0 and event_id > 0""")
def jsonl_lines(spark, sf):
    df = events(spark, sf).filter("event_id > 0").select("event_id", F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 6 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("props"), F.lit(" "))).alias("text"))
    df = logs.jsonl_lines(df)
    return df.select("event_id", "offset", F.from_json("text", "k long")["k"].alias("k"))


@query("""select event_id, lpad(row_number() over (partition by user_id order by event_id)::varchar, 6, '0') as "offset" from events where event_type <> 'error'""")
def filter_before_offsets(spark, sf):
    df = events(spark, sf).withColumn("stream", F.col("user_id"))
    return logs.filtered_offsets(df, F.col("event_type") != "error", "event_id", 6).select("event_id", "offset")


@query("""select event_id, lpad(row_number() over (partition by user_id order by event_id)::varchar, 4, '0') as "offset",
  coalesce(case when event_id % 3 = 0 then 'svc' || (event_id % 5)::varchar end, case when event_id % 2 = 0 then 'old' || (event_id % 4)::varchar end) as peer from events""")
def export_spans(spark, sf):
    pick = lambda m, p, n: F.when(F.col("event_id") % m == 0, F.concat(F.lit(p), (F.col("event_id") % n).cast("string")))
    df = events(spark, sf).select("event_id", F.col("user_id").alias("stream"), F.col("event_id").alias("arrival_ix"), F.col("event_id").cast("string").alias("span_id"), pick(3, "svc", 5).alias("service_peer_name"), pick(2, "old", 4).alias("peer_service"))
    return logs.export_spans(df).select("event_id", "offset", "peer")


@query("""select p_partkey, lpad((row_number() over (partition by p_brand order by p_partkey) + 100)::varchar, 6, '0') as "offset" from part""")
def snapshot_stream(spark, sf):
    df = table(spark, sf, "part").withColumn("stream", F.col("p_brand"))
    return logs.snapshot_stream(df, "p_partkey", 100, 6).select("p_partkey", "offset")


@query("""select event_id // 4 as seq, (event_id % 4)::integer as event_ix, event_id from events where event_id // 4 > 1000""")
def http_batches(spark, sf):
    df = events(spark, sf).groupBy(F.floor(F.col("event_id") / 4).cast("bigint").alias("seq")).agg(F.array_sort(F.collect_list("event_id")).alias("events"))
    return logs.http_batches(df, 1000).select("seq", "event_ix", F.col("event").alias("event_id"))


@query("""select event_id, case when event_type = 'error' and event_id % 5 = 0 then 'error needs value' when event_type = 'view' and event_id % 3 = 0 then 'view needs props' end as problem from events""")
def event_table_problems(spark, sf):
    df = events(spark, sf).select("event_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("props"))
    return logs.table_events(df, {"view": ["props"], "error": ["value"]}).select("event_id", "problem")


@query("""select event_id, make_timestamp((event_id * 1000123 // 1000) * 1000) as at from events""")
def hr_times(spark, sf):
    """Milliseconds of [seconds, nanoseconds] pairs: event_id * 1,000,123 microseconds, cut to milliseconds."""
    us = F.col("event_id") * 1000123
    df = events(spark, sf).select("event_id", F.floor(us / 1_000_000).cast("bigint").alias("s"), ((us % 1_000_000) * 1000).cast("bigint").alias("n"))
    return df.select("event_id", logs.hr_time("s", "n").cast("timestamp_ntz").alias("at"))
