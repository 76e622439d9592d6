"""Queries on named tools, decoders and the control plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.operators import decoders, tools
from chronofold.plans import queries_ingest as qi, queries_offsets as qo
from chronofold.plans.registry import query, table
from chronofold.streaming import control


def people(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.array(F.concat(F.lit("c-"), F.col("c_custkey").cast("string")), F.lower("c_name")).alias("aliases"), "c_nationkey")


def organisations(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("s-"), F.col("s_suppkey").cast("string"))).alias("aliases"))


@query("select 'Person' as kind, c_custkey::varchar as id, c_name as name from customer where c_custkey = 12 or 'c-' || c_custkey = '12' or lower(c_name) = '12' order by c_custkey::varchar limit 1")
def top1_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return tools.resolve_entity(people(spark, sf), organisations(spark, sf), "12")


@query("""with job as (select c_custkey::varchar as person_id, min(s_suppkey::varchar) as org_id from customer join supplier on s_nationkey = c_nationkey and s_suppkey % 4 = c_custkey % 4 group by 1)
select c_custkey::varchar as id, c_name as name, s_name as employer, c_custkey in (select o_custkey from orders) as verified from customer left join job on person_id = c_custkey::varchar left join supplier on s_suppkey::varchar = org_id""")
def recall(spark, sf):
    p, s = people(spark, sf), table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("org_id"), "s_nationkey", (F.col("s_suppkey") % 4).alias("m"))
    jobs = p.join(s, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("id").cast("bigint") % 4 == F.col("m"))).select(F.col("id").alias("person_id"), "org_id")
    verified = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("person_id"))
    return tools.recall(p.select("id", "name"), jobs, organisations(spark, sf), verified)


@query(qi._CHECK + """, b as (select max(tx) as pin from r where run = 800), v as (
  select user_id::varchar as id, props, deleted, tx as tx_from, lead(tx) over (partition by user_id order by tx) as tx_to from (select * from s where not (deleted and (rn = 1 or pd)) and not (rn > 1 and deleted = pd and props = pp)))
select id, props::varchar as props from v, b where not deleted and tx_from <= pin and (tx_to is null or tx_to > pin)""")
def believed_at(spark, sf):
    """All users as believed when the stream stood at offset 800."""
    changes = qi.ingest.transactions(qi.log(spark, sf), 2)
    op = F.when(F.col("operation") == "delete", "node.remove").otherwise("node.upsert")
    folded = qi.folding.fold(qi.node_events(changes, F.col("tx"), op, F.floor("value").cast("bigint").cast("string")))
    revised = qi.folding.revisions(qi.folding.captured_transactions(folded, qi.ingest.transaction_table(changes)))
    return tools.believed_at(folded, qi.ingest.checkpoints(revised), revised, "events", "0000000000000800").select("id", "props")


def timeline(spark, sf) -> DataFrame:
    """One version per event of a user, covering until the next; attributes type and tens."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf, "events")
    attributes = F.create_map(F.lit("type"), F.col("event_type"), F.lit("tens"), F.floor(F.col("value") / 100).cast("bigint").cast("string"))
    return e.select("user_id", F.col("event_id").alias("id"), F.col("event_id").alias("recorded_from"), F.lead("event_id").over(w).alias("recorded_to"), attributes.alias("attributes"), F.when(F.col("event_type") == "error", F.col("event_id")).alias("valid_to")).withColumnRenamed("user_id", "entity_id")


@query("select user_id as entity_id, max(event_id) as id from events where event_id <= 100 group by 1")
def timeline_as_of(spark, sf):
    return tools.resolve_as_of(timeline(spark, sf), 100).select("entity_id", "id")


@query("select user_id as entity_id from events group by 1 having min(event_id) > 100")
def timeline_not_yet_known(spark, sf):
    t = timeline(spark, sf)
    return tools.not_yet_known(tools.resolve_as_of(t, 100), t.filter("recorded_to is null")).select("entity_id")


@query("""with a as (select user_id, arg_max(event_id, event_id) as id, arg_max(event_type, event_id) as type, arg_max(floor(value / 100)::bigint, event_id) as tens from events where event_id <= 5000 group by 1),
b as (select user_id, arg_max(event_id, event_id) as id, arg_max(event_type, event_id) as type, arg_max(floor(value / 100)::bigint, event_id) as tens from events group by 1),
d as (select a.user_id as entity_id, concat_ws(',', case when a.tens <> b.tens then 'tens' end, case when a.type <> b.type then 'type' end) as changed, (case when a.type = 'error' then a.id end) is distinct from (case when b.type = 'error' then b.id end) as end_changed from a join b using (user_id) where a.id <> b.id)
select * from d where changed <> '' or end_changed""")
def timeline_revised(spark, sf):
    t = timeline(spark, sf)
    df = tools.revised_since(tools.resolve_as_of(t, 5000), t.filter("recorded_to is null"))
    return df.select("entity_id", F.array_join("changed", ",").alias("changed"), "end_changed")


@query("with e as (select event_id, user_id, event_type, floor(value)::bigint as level from events) select user_id, event_type, level from e where event_id > 500 except select user_id, event_type, level from e where event_id <= 500")
def new_edges(spark, sf):
    keys = ["user_id", "event_type", "level"]
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.floor("value").cast("bigint").alias("level"))
    before, after = (x.select(*keys).distinct() for x in (e.filter("event_id <= 500"), e.filter("event_id > 500")))
    return tools.new_edges(before, after, keys)


@query("select user_id as stream, event_id from (select *, row_number() over (partition by user_id order by event_id) as n from events where event_type = 'purchase') where n = 3")
def nth_result(spark, sf):
    e = table(spark, sf, "events").withColumn("stream", F.col("user_id"))
    return tools.nth_result(e, F.col("event_type") == "purchase", 3, "event_id").select("stream", "event_id")


@query("select event_type from (select event_type from events where user_id % 2 = 0 intersect select event_type from events where user_id % 2 = 1)")
def artifact_overlap(spark, sf):
    e = table(spark, sf, "events")
    return tools.overlap(e.filter("user_id % 2 = 0").select("event_type"), e.filter("user_id % 2 = 1").select("event_type"))


@query("select user_id::varchar as id, case when arg_max(event_type, event_id) = 'view' then 'NO_ACTION' else 'PAGE_ON_CALL' end as decision from events where event_id <= 3000 group by 1")
def policy_replay(spark, sf):
    """A decision replayed over the beliefs of event 3000."""
    df = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "view", "healthy").otherwise("degraded")
    ev = qi.node_events(df, F.col("event_id"), F.lit("node.upsert"), F.to_json(F.struct(status.alias("status"))))
    v = qi.folding.fold(ev).filter(qi.recorded_at(3000))
    return v.select("id", tools.policy(F.get_json_object("props", "$.status")).alias("decision"))


def _changes(spark, sf, shape, value) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("tx"), F.col("event_id").alias("change_ix"), F.col("ts").cast("timestamp").alias("tx_wall"), shape.alias("shape"), F.col("user_id").cast("string").alias("key"), F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("operation"), value.alias("value"))


_COUNT = " group by all"


@query("""with s as (select event_id % 3 as s, event_type = 'error' as gone from events)
select case when s = 0 and not gone then 'node.upsert' when s = 0 then 'node.remove' when s = 1 and not gone then 'node.upsert' when s = 1 then 'node.remove' when gone then 'edge.remove' else 'edge.upsert' end as op,
  case s when 0 then 'Person' when 1 then 'Company' else 'worksAt' end as kind, count(*)::bigint as n from s""" + _COUNT)
def decode_crm(spark, sf):
    s = F.col("event_id") % 3
    shape = F.when(s == 0, "person").when(s == 1, "company").otherwise("employment")
    text = lambda p: F.concat(F.lit(p), F.col("user_id").cast("string"))
    value = F.struct(text("n").alias("name"), text("e").alias("email"), F.lit(None).cast("string").alias("title"), text("d").alias("domain"), F.lit(None).cast("string").alias("stage"), text("p").alias("person"), text("c").alias("company"))
    return decoders.crm(_changes(spark, sf, shape, value)).groupBy("op", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""with e as (select event_type, event_id % 2 = 0 as client, event_id % 3 = 0 as peer, event_id % 5 = 0 as addr from events where event_type <> 'error'), c as (select *, client and (peer or addr) as callee from e),
x as (select unnest(['Service', 'Alias', 'aliasOf', 'Operation', 'exposes']) as kind from c union all select unnest(['Service', 'Alias', 'aliasOf', 'calls']) from c where callee) select kind, count(*)::bigint as n from x group by 1""")
def decode_spans(spark, sf):
    name = lambda p, m: F.concat(F.lit(p), (F.col("user_id") % m).cast("string"))
    i = F.col("event_id")
    value = F.struct(F.concat(name("Svc", 20), F.lit("-svc")).alias("service"), F.col("event_type").alias("name"), F.when(i % 2 == 0, "CLIENT").otherwise("SERVER").alias("kind"), F.when(i % 3 == 0, name("peer", 7)).alias("peer"), F.when(i % 5 == 0, name("host", 9)).alias("server_address"))
    return decoders.spans(_changes(spark, sf, F.lit("span"), value)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""select event_type as tool, case event_id % 3 when 0 then 'running' when 1 then 'ok' else 'error' end as status, case when event_id % 2 = 0 then 'file:f' || (props::json->>'k') else 'query:q' || (props::json->>'k') end as uri, count(*)::bigint as n from events group by all""")
def jsonl_toolcalls(spark, sf):
    """Tool calls of three dialects decoded to one shape."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k")
    word = F.when(i % 3 == 0, F.when(i % 2 == 0, "call").otherwise("start")).when(i % 3 == 1, F.when(i % 2 == 0, "result").otherwise("end")).otherwise(F.when(i % 2 == 0, "error").otherwise("fail"))
    args = F.when(i % 2 == 0, F.to_json(F.struct(F.concat(F.lit("f"), k).alias("path")))).otherwise(F.to_json(F.struct(F.concat(F.lit("q"), k).alias("query"))))
    df = table(spark, sf, "events").select(F.col("event_type").alias("tool"), decoders.tool_status(word).alias("status"), decoders.resource(args).alias("uri"))
    return df.groupBy("tool", "status", "uri").agg(F.count(F.lit(1)).alias("n"))


@query("""select case e.k when 1 then 'Agent' when 2 then 'Task' when 3 then 'assigned' when 4 then 'Finding' when 5 then 'reported' else 'about' end as kind, count(*)::bigint as n
from (select unnest(case event_type when 'signup' then [1] when 'click' then [1, 2, 3] when 'view' then [2] when 'purchase' then [4, 5, 6] else [1, 3] end) as k from events) e group by 1""")
def decode_fleet(spark, sf):
    e, t = table(spark, sf, "events"), F.col("event_type")
    kind = F.when(t == "signup", "agent_seen").when(t == "click", "task_started").when(t == "view", "task_status").when(t == "purchase", "finding").otherwise("task_assigned")
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    df = e.select(F.col("event_id").alias("tx"), F.col("event_id").alias("change_ix"), F.col("ts").cast("timestamp").alias("tx_wall"), kind.alias("event_type"), text("a", "user_id").alias("agent_id"), text("n", "user_id").alias("agent_name"), text("t", "user_id").alias("task_id"), F.lit("title").alias("task_title"), F.lit("open").alias("status"), text("f", "event_id").alias("finding_id"), F.lit("s").alias("finding_summary"), F.lit("low").alias("severity"))
    return decoders.fleet(df).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""select conv_id, string_agg(text, chr(10) || chr(10) order by turn) as said, count(*)::bigint as n_turns from conversations where role = 'user' group by 1""")
def session_turns(spark, sf):
    """Text blocks of the user's turns of a session, joined by an empty line."""
    c = table(spark, sf, "conversations").filter("role = 'user'")
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.lit("text").alias("type"), "text"))), lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text")))
    df = c.groupBy("conv_id").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("n_turns"))
    return df.select("conv_id", decoders.session_text().alias("said"), "n_turns")


@query("""with a as (select event_type, user_id, event_id from events) select lower(trim('U' || user_id)) as id, event_id as at,
  last_value(case when event_id % 3 = 0 then event_type end ignore nulls) over w as title, bool_or(event_type = 'purchase') over w as verified from a window w as (partition by user_id order by event_id)""")
def observations(spark, sf):
    """Running profiles: last stated title, verified so far."""
    e = table(spark, sf, "events")
    rows = e.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("email"), F.col("event_id").alias("at"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("title"), F.col("event_type").alias("name"), (F.col("event_type") == "purchase").alias("verified"))
    return decoders.observations(rows).select("id", "at", "title", "verified")


@query("""with x as (select event_type as t, case when user_id % 3 = 0 then 'tip:' when user_id % 3 = 1 then 'claim' else 'wire' end as p from events),
k as (select case t when 'signup' then ['Report'] when 'view' then ['Tip'] when 'click' then ['Claim', 'Justification', 'premiseOf', 'derives'] when 'purchase' then ['Story', 'Justification', 'premiseOf', 'derives'] else [] end as ks from x)
select kind, count(*)::bigint as n from (select unnest(ks) as kind from k) group by 1""")
def decode_newsroom(spark, sf):
    t, u = F.col("event_type"), F.col("user_id")
    shape = F.when(t == "signup", "wire").when(t == "view", "tip").when(t == "click", "claim").when(t == "purchase", "story").otherwise("other")
    ref = F.concat(F.when(u % 3 == 0, "tip:").when(u % 3 == 1, "claim").otherwise("wire"), u.cast("string"))
    value = F.struct(F.lit("x").alias("text"), F.lit("1").alias("value"), F.lit("h").alias("headline"), F.array(ref).alias("sources"))
    return decoders.newsroom(_changes(spark, sf, shape, value)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _streams(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    path = F.concat(F.lit("agents/agent-"), F.lpad((F.col("user_id") % 12).cast("string"), 2, "0"))
    return e.groupBy(path.alias("stream")).agg(F.lpad(F.max("event_id").cast("string"), 16, "0").alias("tail"))


@query("""with s as (select 'agents/agent-' || lpad((user_id % 12)::varchar, 2, '0') as stream, max(event_id) as tail from events group by 1)
select 'all' as subscription, stream, case when stream < 'agents/agent-06' then lpad(tail::varchar, 16, '0') else '-1' end as acked, lpad(tail::varchar, 16, '0') as tail, stream >= 'agents/agent-06' as has_pending from s""")
def pending_streams(spark, sf):
    tails = _streams(spark, sf)
    links = control.link_globs(tails.select("stream"), spark.createDataFrame([("all", "agents/*")], "subscription string, pattern string"))
    acks = tails.filter("stream < 'agents/agent-06'").select(F.lit("all").alias("subscription"), "stream", F.col("tail").alias("acked"))
    return control.pending(links, tails, acks)


@query("""with s as (select distinct 'agents/agent-' || lpad((user_id % 12)::varchar, 2, '0') as stream from events)
select 'ones' as subscription, stream from s where stream like 'agents/agent-0%' union all select 'deep', stream from s""")
def glob_links(spark, sf):
    rows = [("ones", "agents/agent-0*"), ("deep", "agents/**"), ("none", "agents"), ("none2", "*")]
    return control.link_globs(_streams(spark, sf).select("stream"), spark.createDataFrame(rows, "subscription string, pattern string")).select("subscription", "stream")


@query("select event_id from events where event_id < 504")
def fork_prefix(spark, sf):
    forks = control.Forks()
    forks.fork("branch", "events", "0000000000000500", 4)
    return forks.read("branch", qo.appends(table(spark, sf, "events"))).select("event_id")
