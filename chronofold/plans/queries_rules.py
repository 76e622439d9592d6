"""Queries on what sources, stores, decoders and leases refuse, keep and report."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold import errors
from chronofold.functions import offsets as O
from chronofold.functions.shared import checkpoint, shared_folder
from chronofold.operators import decoders, resolve, support, tools
from chronofold.plans import constraints, events as ev, fold as folding, ingest
from chronofold.plans.queries_ingest import log, node_events
from chronofold.plans.queries_merge import _HELD, _MEMBERS, _gone, beliefs, members
from chronofold.plans.queries_tools import _changes
from chronofold.plans.registry import query, table
from chronofold.plans.store import BeliefStore, CheckpointBook
from chronofold.sources import logs
from chronofold.streaming.control import Forks, StoredSubscriptions



def _i() -> Column:
    return F.col("event_id")


def text(prefix: str, c) -> Column:
    return F.concat(F.lit(prefix), (F.col(c) if isinstance(c, str) else c).cast("string"))


# Sources.


@query("""select event_id, lpad((event_id // 5)::varchar, 16, '0') as "offset" from events where event_id // 5 > 60""")
def log_after(spark: SparkSession, sf: str) -> DataFrame:
    """An in-memory log read strictly after a cursor."""
    return logs.log_source(log(spark, sf), "events").read(f"{60:016d}").select("event_id", "offset")


@query("""select user_id::varchar as stream, case when bool_or(event_id % 101 = 0) then 'must-refetch' when bool_or(event_id % 53 = 0) then 'error' when bool_or(event_id % 37 = 0) then 'sentinel' else 'ok' end as outcome from events group by 1""")
def control_frames(spark, sf):
    """How reading each user's frames ends; unknown control frames do not matter."""
    control = F.when(_i() % 101 == 0, "must-refetch").when(_i() % 53 == 0, "error").when((_i() % 11 == 0) & (_i() % 37 != 0), "odd")
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("stream"), control.alias("control"), F.when(_i() % 37 == 0, "now").otherwise(_i().cast("string")).alias("batch_offset"))
    return logs.read_outcomes(e)


@query("""select event_id, case when event_id % 3 = 0 then event_id::varchar end as resumes_at from events""")
def resume_positions(spark, sf):
    """An offset without its handle is no place to resume from."""
    return table(spark, sf, "events").select("event_id", logs.resume_position(_i().cast("string"), F.when(_i() % 3 == 0, text("h", "user_id"))).alias("resumes_at"))


_CURSORS = "select event_id, case when event_id % 5 = 0 then event_id::varchar when event_id % 7 = 0 then 'x,y,' || event_id when event_id % 11 = 0 then '-1,0' when event_id % 13 <> 0 then event_id || ',' || event_id % 4 end as cursor from events"


@query(f"""with c as ({_CURSORS}) select event_id, case when cursor is null then null when event_id % 5 = 0 or event_id % 7 = 0 then 'foreign cursor' when event_id % 11 <> 0 and event_id < 300 then 'not retained' end as problem from c""")
def cursor_checks(spark, sf):
    """Cursors that a durable stream, retained from 300 on, refuses: foreign ones and old ones."""
    cursor = F.when(_i() % 5 == 0, _i().cast("string")).when(_i() % 7 == 0, text("x,y,", "event_id")).when(_i() % 11 == 0, "-1,0").when(_i() % 13 != 0, F.concat_ws(",", _i().cast("string"), (_i() % 4).cast("string")))
    return table(spark, sf, "events").select("event_id", logs.cursor_problem(cursor, F.lit("300")).alias("problem"))


@query("""select event_id, event_id::varchar || '_0' as "offset" from events where event_id % 9 = 0""")
def mapper_failures(spark, sf):
    """Messages that the mapper has no value for, with their offsets."""
    raw = F.when(_i() % 9 == 0, F.concat(F.col("props"), F.lit("}{"))).when(_i() % 9 != 1, F.col("props"))
    e = table(spark, sf, "events").select("event_id", F.concat(_i().cast("string"), F.lit("_0")).alias("offset"), raw.alias("raw"))
    value = F.when(_i() % 9 != 0, F.from_json("raw", "k long")["k"])
    return logs.mapper_failures(e.withColumn("value", value)).select("event_id", "offset")


@query("select distinct user_id::varchar as stream from events where event_id % 97 = 0")
def reset_streams(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("stream"), F.when(_i() % 97 == 0, "reset").when(_i() % 5 == 0, "snapshot-end").alias("control"))
    return logs.reset_streams(e)


@query("""select event_id, case when event_id % 31 = 0 then 'the table is append-only' when event_type = 'error' then 'unknown event type'
  when event_type = 'signup' and event_id % 3 = 0 then 'agent_seen needs agent_name' when event_type = 'click' and event_id % 4 = 0 then 'task_started needs task_id' when event_type = 'view' and event_id % 6 = 0 then 'task_status needs status' end as problem from events""")
def fleet_problems(spark, sf):
    """Fleet events with a missing field, an unknown type, or a change that is no insert."""
    t = F.col("event_type")
    kind = F.when(t == "signup", "agent_seen").when(t == "click", "task_started").when(t == "view", "task_status").when(t == "purchase", "finding").otherwise("odd")
    e = table(spark, sf, "events").select(
        "event_id", kind.alias("event_type"), F.when(_i() % 31 == 0, "delete").otherwise("insert").alias("operation"),
        F.when((t != "signup") | (_i() % 3 != 0), "n").alias("agent_name"), F.when((t != "click") | (_i() % 4 != 0), "t").alias("task_id"), F.lit("title").alias("task_title"),
        F.when((t != "view") | (_i() % 6 != 0), "open").alias("status"), F.lit("f").alias("finding_id"), F.lit("s").alias("finding_summary"),
    )
    return decoders.fleet_problems(e).select("event_id", "problem")


@query("""select event_id, event_id as revision from events""")
def instant_revisions(spark, sf):
    """Recorded instants as text and their revisions again."""
    return table(spark, sf, "events").select("event_id", O.recorded_instant_revision(O.format_instant(_i(), F.col("ts").cast("timestamp"))).cast("bigint").alias("revision"))


# Stores.

USERS = ev.Graph([ev.NodeKind("User", {"v": "string"})])


def _users(changes: DataFrame) -> DataFrame:
    e = ev.Emitter(USERS).nodes["User"]
    gone = F.col("operation") == "delete"
    return ev.decode(changes, (~gone, [e.upsert(F.col("key"), {"v": F.floor("value").cast("bigint").cast("string")})]), (gone, [e.remove(F.col("key"))]))


def _store(spark, graph=USERS) -> BeliefStore:
    return BeliefStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", graph)


_WALL = "2030-01-01 00:00:00"


def _consumed(spark, sf) -> tuple[BeliefStore, list[ingest.Consumed]]:
    """The events in two halves and an empty third, each resumed where the one before ended."""
    store, source = _store(spark), logs.log_source(log(spark, sf), "events")
    return store, [ingest.consume(source, store, _users, stop=stop, max_batch_size=size, tx_wall=_WALL) for stop, size in ((500, 7), (None, 1000), (None, 5))]


_RUNS = """with t as (select user_id, event_id // 5 + 1 as tx, arg_max(event_type = 'error', event_id) as deleted, arg_max(case when event_type <> 'error' then floor(value)::bigint end, event_id) as v, bool_or(event_type <> 'error') as up from events group by all),
s as (select *, last_value(v ignore nulls) over (partition by user_id order by tx rows between unbounded preceding and current row) as props, bool_or(up) over (partition by user_id order by tx rows between unbounded preceding and current row) as born from t),
l as (select *, lag(deleted) over w as pd, lag(props) over w as pp, row_number() over w as rn from s where born window w as (partition by user_id order by tx)),
c as (select * from l where not (deleted and (rn = 1 or pd)) and not (rn > 1 and deleted = pd and props = pp))"""


@query(_RUNS + """ select user_id::varchar as id, case when not deleted then props::varchar end as v, deleted, tx::bigint as tx_from, (lead(tx) over (partition by user_id order by tx))::bigint as tx_to from c""")
def consumed_versions(spark, sf):
    """Versions of a store that consumed the log in two halves: the same as of the whole log at once."""
    v = _consumed(spark, sf)[0].versions()
    return v.select("id", F.when(~F.col("deleted"), F.get_json_object("props", "$.v")).alias("v"), "deleted", "tx_from", "tx_to")


@query(_RUNS + """ select user_id::varchar as id, case when not deleted then props::varchar end as v, deleted, tx::bigint as tx_from, (lead(tx) over (partition by user_id order by tx))::bigint as tx_to from c""")
def compacted_versions(spark, sf):
    """Versions of a store that was compacted between the two halves and holds later events of some keys."""
    store, source = _store(spark), logs.log_source(log(spark, sf), "events")
    ingest.consume(source, store, _users, stop=500, tx_wall=_WALL)
    store.compact()
    ingest.consume(source, store, _users, tx_wall=_WALL)
    return store.versions().select("id", F.when(~F.col("deleted"), F.get_json_object("props", "$.v")).alias("v"), "deleted", "tx_from", "tx_to")


@query("""with n as (select count(*) as n, max(event_id) // 5 as top from events), o as (select lpad((499 // 5)::varchar, 16, '0') as mid, lpad(top::varchar, 16, '0') as last from n)
select 1::bigint as call, 500::bigint as processed, null::varchar as from_offset, mid as last_offset from o union all select 2, n - 500, mid, last from n, o union all select 3, 0, last, last from o""")
def consume_results(spark, sf):
    """What each call reports: changes applied, where it resumed and where it stopped; nothing new is no work."""
    rows = [(i, c.processed, c.from_offset, c.last_offset) for i, c in enumerate(_consumed(spark, sf)[1], 1)]
    return spark.createDataFrame(rows, "call long, processed long, from_offset string, last_offset string")


@query(_RUNS + """, r as (select count(distinct tx) + (1 not in (select tx from c))::int as n from c), m as (select lpad((max(event_id) // 5)::varchar, 16, '0') as last from events)
select 'last' as ask, last as answer from m union all select 'last of another', null union all select 'after an older record', last from m union all select 'anchor of the older record', '3' union all select 'anchor of no offset', null union all select 'recorded now', n::varchar from r""")
def checkpoint_book(spark, sf):
    """Cursors never go back, anchors are exact, and the clock is the last revision that captured a change."""
    store = _consumed(spark, sf)[0]
    book = CheckpointBook(store)
    now = store.recorded_now()
    rows = [("last", book.last_offset("events")), ("last of another", book.last_offset("other")), ("recorded now", str(now))]
    book.record("events", f"{2:016d}", 3)
    anchor = book.anchor_for("events", "nowhere")
    rows += [("after an older record", book.last_offset("events")), ("anchor of the older record", str(book.anchor_for("events", f"{2:016d}"))), ("anchor of no offset", anchor)]
    return spark.createDataFrame(rows, "ask string, answer string")


@query("select * from (values ('bad batch size', 'ValueError', 0), ('no history', 'ConstraintError', 0), ('decoder fails', 'RuntimeError', 0), ('rule broken', 'ConstraintError', 0), ('dropped change', 'DroppedChangeError', 0), ('mixed offsets', 'OffsetFormatError', 0)) t(what, error, commits)")
def refused_batches(spark, sf):
    """Every refused batch leaves the store without a commit."""
    changes = log(spark, sf).filter("event_id < 200")
    source = logs.log_source(changes, "events")

    def broken(_):
        raise RuntimeError("decoder")

    def nothing(c):
        return _users(c).limit(0)

    def lonely(c):
        e = ev.Emitter(pairs).edges["knows"]
        return ev.decode(c, (F.lit(True), [e.upsert(("User", F.col("key")), ("User", F.lit("nobody")))]))

    pairs = ev.Graph([ev.NodeKind("User")], [ev.EdgeKind("knows", ["User"], ["User"])])
    mixed = logs.log_source(changes.withColumn("offset", F.when(_i() % 50 == 0, "odd").otherwise(F.col("offset"))), "events")
    out = []
    for what, src, decode, graph, named in (
        ("bad batch size", source, _users, USERS, {"max_batch_size": 0}), ("no history", source, _users, None, {}), ("decoder fails", source, broken, USERS, {}),
        ("rule broken", source, lonely, pairs, {}), ("dropped change", source, nothing, USERS, {}), ("mixed offsets", mixed, _users, USERS, {}),
    ):
        store = _store(spark, graph)
        store.history = graph is not None
        try:
            ingest.consume(src, store, decode, **named)
            out.append((what, "none", store.head().n))
        except Exception as e:
            out.append((what, type(e).__name__, store.head().n))
    return spark.createDataFrame(out, "what string, error string, commits int")


@query("select p_partkey::varchar as id, p_size >= 40 as updated from part where p_size >= 40 or p_partkey % 3 = 0")
def export_import(spark, sf):
    """An export holds current rows only; imported, they join or replace what a store has under their ids."""
    kind = ev.Graph([ev.NodeKind("Part", {"size": "string"})])
    p = table(spark, sf, "part").withColumns({"user_id": F.col("p_partkey"), "event_id": F.col("p_partkey"), "ts": F.lit(_WALL)})
    rows = lambda df, op, props: node_events(df, F.lit(1), F.lit(op), F.lit(props).cast("string")).withColumn("kind", F.lit("Part")).drop("tx")
    a, b = _store(spark, kind), _store(spark, kind)
    a.add(rows(p.filter("p_size >= 30"), "node.upsert", '{"size":"big"}'))
    a.add(rows(p.filter("p_size >= 30 and p_size < 40"), "node.remove", None))
    b.add(rows(p.filter("p_partkey % 3 = 0"), "node.upsert", '{"size":"any"}'))
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    a.export(path)
    b.load(path)
    live = b.versions().filter("tx_to is null and not deleted")
    return live.select("id", (F.get_json_object("props", "$.size") == "big").alias("updated"))


@query("select * from (values ('target', 1::bigint, false), ('staging branch', 3, true), ('plain branch', 1, false), ('created', 1, false)) t(store, n, twice)")
def branches(spark, sf):
    """A staging branch may hold a unique value twice, a plain one may not; writes to branches do not leak back."""
    kind = ev.Graph([ev.NodeKind("P", {"mail": "string"}, unique="mail")])
    store = _store(spark, kind)
    store.create("P", "p1", {"mail": "a@x"}, _WALL)
    root = f"{shared_folder(spark)}/branch-{uuid.uuid4().hex}"
    staging, plain = store.branch(f"{root}/s", enforce_unique=False), store.branch(f"{root}/p")
    for branch in (staging, plain):
        for id, mail in (("p2", "A@X"), ("p3", "b@x") if branch is staging else ("p4", "a@X")):
            try:
                branch.create("P", id, {"mail": mail}, _WALL)
            except errors.ConstraintError:
                pass
    out = []
    for name, s in (("target", store), ("staging branch", staging), ("plain branch", plain)):
        live = s.versions().filter("tx_to is null and not deleted")
        mails = live.groupBy(F.lower(F.get_json_object("props", "$.mail"))).count().filter("count > 1")
        out.append((name, live.count(), not mails.isEmpty()))
    out.append(("created", store.find("P", "p1").count(), False))
    return spark.createDataFrame(out, "store string, n long, twice boolean")


@query(_RUNS + """, r as (select tx, row_number() over (order by tx) as revision from (select distinct tx from c union select 1)), k as (select lpad((event_id // 5)::varchar, 16, '0') as "offset", event_id // 5 + 1 as tx from events group by all),
a as (select "offset", k.tx, (select count(*) from r where r.tx <= k.tx) as revision from k), b as (select revision, max("offset") as "offset" from a group by 1)
select (row_number() over (order by revision) - 1)::bigint as position, "offset", revision from b""")
def anchor_positions(spark, sf):
    """The ordered list of anchors that a timeline steps through."""
    return tools.anchor_list(_consumed(spark, sf)[0].checkpoints())


# Events, rules and the fold.


def _edges(spark, sf, op) -> DataFrame:
    e = table(spark, sf, "events")
    df = node_events(e, _i(), op, F.lit("{}"))
    return df.withColumns({"kind": F.lit("likes"), "id": F.lit(None).cast("string"), "from_kind": F.lit("User"), "from_id": F.concat(F.lit("u"), (F.col("change_ix") % 40).cast("string")), "to_kind": F.lit("Item"), "to_id": F.concat(F.lit("i"), (F.col("change_ix") % 7).cast("string"))})


@query("""with e as (select event_id, 'u' || event_id % 40 as a, 'i' || event_id % 7 as b, event_type = 'error' as gone from events), s as (select *, lag(gone) over (partition by a, b order by event_id) as pg from e)
select event_id as tx, (case when not gone then 1 when coalesce(pg, true) then 0 else 1 end)::bigint as writes from s""")
def edge_removals(spark, sf):
    """Removing an edge that is not there is silent; it writes nothing."""
    op = F.when(F.col("event_type") == "error", "edge.remove").otherwise("edge.upsert")
    return folding.effective_writes(_edges(spark, sf, op)).select("tx", "writes")


@query("""select event_id as tx, case when event_id % 2 = 0 then '{"since":"' || user_id || '","level":"plain"}' else '{"level":"' || event_type || '"}' end as props from events""")
def emitted_edges(spark, sf):
    """Typed edge constructors: properties in declared order, defaults where none is given."""
    kind = ev.Graph([ev.NodeKind("User"), ev.NodeKind("Item")], [ev.EdgeKind("likes", ["User"], ["Item"], {"since": "string", "level": "string"}, defaults={"level": "plain"})])
    likes = ev.Emitter(kind).edges["likes"]
    ends = (("User", F.col("key")), ("Item", F.lit("i")))
    even = _i() % 2 == 0
    changes = table(spark, sf, "events").select(_i().alias("tx"), _i().alias("change_ix"), F.col("ts").alias("tx_wall"), "event_id", "event_type", F.col("user_id").cast("string").alias("key"))
    out = ev.decode(changes, (even, [likes.upsert(*ends, {"since": F.col("key")})]), (~even, [likes.upsert(*ends, {"level": F.col("event_type")})]))
    return out.select("tx", "props")


@query("""select event_id as tx, case when event_id % 6 = 0 then 'ends and reopens' when event_id % 5 = 0 then 'no id' end as problem from events""")
def event_problems(spark, sf):
    """An event either ends its window or reopens it; nodes have an id."""
    at = F.col("ts").cast("timestamp")
    df = node_events(table(spark, sf, "events"), _i(), F.lit("node.upsert"), F.lit("{}"), valid_to=F.when(_i() % 2 == 0, at), clear=_i() % 3 == 0)
    df = df.withColumn("id", F.when(F.col("change_ix") % 5 != 0, F.col("id")))
    return ev.event_problems(df).select("tx", "problem")


@query("""with u as (select 'unique' as rule, 'Part' as kind, lower(p_brand) as subject from part group by 3 having count(*) > 1),
w as (select 'endpoint' as rule, 'madeBy' as kind, p_partkey || '->' || 'nobody' as subject from part where p_size = 7) select * from u union all select * from w""")
def audit_report(spark, sf):
    """All violations at once; nothing is changed."""
    graph = ev.Graph([ev.NodeKind("Part", {"brand": "string"}, unique="brand"), ev.NodeKind("Maker")], [ev.EdgeKind("madeBy", ["Part"], ["Maker"])])
    e = ev.Emitter(graph)
    part = ("Part", F.col("p_partkey").cast("string"))
    changes = table(spark, sf, "part").withColumns({"tx": F.col("p_partkey"), "change_ix": F.lit(0).cast("long"), "tx_wall": F.lit(_WALL).cast("timestamp")})
    rows = ev.decode(changes, (F.lit(True), [e.nodes["Part"].upsert(part[1], {"brand": F.col("p_brand")}), e.nodes["Maker"].upsert(F.col("p_type"), {})]), (F.col("p_size") < 7, [e.edges["madeBy"].upsert(part, ("Maker", F.col("p_type")))]), (F.col("p_size") == 7, [e.edges["madeBy"].upsert(part, ("Maker", F.lit("nobody")))]))
    return constraints.audit(rows, folding.fold(rows), graph)


# Merge and support.


@query(_MEMBERS + """, e as (select distinct a.canonical as x, b.canonical as y from c a join c b on b.id = a.id + 1), l as (select canonical, 'nation' as property, nation as value, branch from c union select canonical, 'level', level, branch from c),
f as (select canonical, property from l group by all having count(distinct value) > 1)
select (select count(distinct canonical) from c)::bigint as nodes, (select count(*) from e)::bigint as edges, (select count(*) from c where id <> canonical)::bigint as resolutions, (select count(*) from f)::bigint as conflicts""")
def merge_report(spark, sf):
    """Counts of a merge of two branches into a base: nodes, edges, resolutions and conflicts."""
    m = resolve.canonical_ids(members(spark, sf), "key")
    ids = m.select(F.col("id").alias("from_id"))
    edges = ids.select("from_id", (F.col("from_id") + 1).alias("to_id")).join(ids.select(F.col("from_id").alias("to_id")), "to_id").select("from_id", "to_id")
    return resolve.merge_report(m, edges, ["nation", "level"])


@query(_MEMBERS + " select canonical as id, lkey as key, arg_min(nation, (rank, id)) as nation, arg_min(level, (rank, id)) as level from c group by 1, 2")
def merge_waves(spark, sf):
    """Branch after branch into the target gives what one merge of all gives."""
    m = members(spark, sf).select("branch", "rank", "id", F.lower("key").alias("key"), "nation", "level")
    target = m.filter("branch = 'base'").select("id", "key", "nation", "level")
    for branch in ("base", "a", "b"):
        target = resolve.merge_wave(target, m.filter(F.col("branch") == branch).filter("branch <> 'base'") if branch != "base" else m.filter("branch = 'base' and rank <> 0"), "key", ["nation", "level"])
    return target


@query("select distinct 'o' || l_orderkey as fact from lineitem")
def terminal_facts(spark, sf):
    """Orders are derived, and premises of nothing."""
    _, premises, derives = beliefs(spark, sf)
    return support.terminal_facts(premises, derives)


@query("select 'supplier' as source_kind, 's' || s_suppkey as source, s_acctbal < 0 as retracted from supplier union all select 'customer', 'c' || c_custkey, c_custkey % 10 = 0 from customer")
def source_kinds(spark, sf):
    """Two kinds of sources, each with a flag of its own name."""
    s = table(spark, sf, "supplier").select(text("s", "s_suppkey").alias("sid"), (F.col("s_acctbal") < 0).alias("in_debt"))
    c = table(spark, sf, "customer").select(text("c", "c_custkey").alias("cid"), F.when(F.col("c_custkey") % 10 == 0, F.lit(True)).alias("left"))
    return support.sources_of({"supplier": (s, "sid", "in_debt"), "customer": (c, "cid", "left")}).select("source_kind", "source", "retracted")


@query(_HELD + """, f as (select 'p' || l_partkey as fact, before, held from p union all select 'o' || l_orderkey, before, held from o)
select r.r::bigint as revision, count(*) filter (where case when r.r = 1 then held else before end)::bigint as n_held, coalesce(sum(length(fact)) filter (where case when r.r = 1 then held else before end), 0)::bigint as letters from f, (values (0), (1), (2)) r(r) group by 1""")
def recorded_beliefs(spark, sf):
    """Facts as recorded before a retraction, after it, and after it is undone."""
    sources, premises, derives = beliefs(spark, sf)
    ready = support.prepared(premises, derives)
    gone = support.retract(sources, _gone(sources))
    first, after = (checkpoint(support.holding(s, premises, derives, ready), "held") for s in (sources, gone))
    changes = checkpoint(support.belief_changes({1: support.turned(first, after), 2: support.turned(after, first)}), "changes")
    parts = [support.beliefs_at(first, changes, r).agg(F.lit(r).cast("long").alias("revision"), F.count(F.lit(1)).alias("n_held"), F.coalesce(F.sum(F.length("fact")), F.lit(0)).cast("long").alias("letters")) for r in (0, 1, 2)]
    return reduce(DataFrame.unionByName, parts)


# Decoders, with whole rows.

EVENT = ("tx", "op", "kind", "id", "from_id", "to_id", "props")


def whole(rows: DataFrame) -> DataFrame:
    return rows.select(*EVENT)


_NO = "null::varchar"


@query(f"""with e as (select event_id as tx, event_type as t, 'u' || user_id as u, event_id from events)
select tx, 'node.upsert' as op, 'Company' as kind, u as id, {_NO} as from_id, {_NO} as to_id, '{{"name":"n"}}' as props, {_NO} as starts, {_NO} as ends, false as reopens from e where t = 'signup'
union all select tx, 'node.upsert', 'Person', u, {_NO}, {_NO}, '{{"name":"n"}}', {_NO}, {_NO}, false from e where t = 'click'
union all select tx, 'edge.upsert', 'worksAt', {_NO}, u, 'acme', '{{}}', case when t = 'click' then '2024-01-01' end, case when t = 'view' then '2024-01-01' end, t = 'purchase' from e where t in ('click', 'view', 'purchase')
union all select tx, 'edge.upsert', 'heldTitle', {_NO}, u, 'acme', '{{"title":"t"}}', '2024-01-01', {_NO}, false from e where t = 'error'""")
def decode_hr(spark, sf):
    """Hire, leave, rehire and promote with their windows."""
    t = F.col("event_type")
    shape = F.when(t == "signup", "company").when(t == "click", "hire").when(t == "view", "leave").when(t == "purchase", "rehire").otherwise("promote")
    value = F.struct(F.lit("n").alias("name"), F.lit("t").alias("title"), F.lit("2024-01-01").alias("effective_at"))
    rows = decoders.hr(_changes(spark, sf, shape, value).withColumn("key", text("u", "key")))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.select(*EVENT, day("valid_from").alias("starts"), day("valid_to").alias("ends"), F.coalesce("clear_valid_to", F.lit(False)).alias("reopens"))


@query(f"""with e as (select event_id as tx, event_type = 'error' as gone, event_id % 2 = 0 as file, user_id::varchar as k, case when event_id % 3 = 0 then 'old' end as old from events)
select tx, case when gone then 'node.remove' else 'node.upsert' end as op, case when file then 'File' else 'Symbol' end as kind, k as id, {_NO} as from_id, {_NO} as to_id, case when not gone and file then '{{"path":"p"}}' when not gone then '{{"name":"n"}}' end as props from e
union all select tx, case when gone then 'edge.remove' else 'edge.upsert' end, 'definedIn', {_NO}, k, 'f', case when not gone then '{{}}' end from e where not file
union all select tx, 'edge.remove', 'definedIn', {_NO}, k, old, {_NO} from e where not file and not gone and old is not null""")
def decode_code(spark, sf):
    """Files and symbols; a symbol that moves leaves its old file."""
    value = F.struct(F.lit("p").alias("path"), F.lit("n").alias("name"), F.lit("f").alias("file"), F.when(_i() % 3 == 0, "old").alias("old_file"))
    return whole(decoders.code_memory(_changes(spark, sf, F.when(_i() % 2 == 0, "file").otherwise("symbol"), value)))


@query(f"""select event_id as tx, 'node.upsert' as op, 'Host' as kind, user_id::varchar as id, {_NO} as from_id, {_NO} as to_id, '{{"status":"' || event_type || '"}}' as props from events where event_type <> 'error'""")
def decode_hosts(spark, sf):
    return whole(decoders.hosts(_changes(spark, sf, F.lit("host"), F.struct(F.col("event_type").alias("status")))))


@query(f"""with c as (select conv_id * 1000 + turn as tx, 's' || conv_id as s, 'm' || conv_id || '_' || turn as m, role, turn % 3 = 2 as sub, conv_id, turn, 's' || conv_id || '/' || case when turn % 3 = 2 then 'p' else 'main' end as a, 'w ' || turn as t from conversations)
select tx, 'node.upsert' as op, 'Session' as kind, s as id, {_NO} as from_id, {_NO} as to_id, '{{"model":"x"}}' as props from c
union all select tx, 'node.upsert', 'Agent', a, {_NO}, {_NO}, '{{"role":"' || case when sub then 'sub' else 'main' end || '"}}' from c
union all select tx, 'edge.upsert', 'ran', {_NO}, s, a, '{{}}' from c
union all select tx, 'node.upsert', 'Turn', m, {_NO}, {_NO}, '{{"role":"' || role || '","text":"' || t || '"}}' from c where turn % 4 <> 3
union all select tx, 'edge.upsert', 'said', {_NO}, a, m, '{{}}' from c where turn % 4 <> 3
union all select tx, 'node.upsert', 'Artifact', '/f' || turn, {_NO}, {_NO}, '{{"uri":"/f' || turn || '"}}' from c where turn % 2 = 0
union all select tx, 'edge.upsert', 'touched', {_NO}, a, '/f' || turn, '{{}}' from c where turn % 2 = 0""")
def decode_session(spark, sf):
    """Session messages: sessions, main and sub agents, turns of their text blocks, artifacts of known tools."""
    c = table(spark, sf, "conversations")
    turn = F.col("turn")
    block = lambda kind, t, name, given: F.struct(F.lit(kind).alias("type"), t.cast("string").alias("text"), name.cast("string").alias("name"), given.cast("string").alias("input"))
    none = F.lit(None)
    said = F.when(turn % 4 != 3, block("text", F.concat(F.lit("w "), turn.cast("string")), none, none))
    used = block("tool_use", none, F.when(turn % 2 == 0, "Read").otherwise("Bash"), F.concat(F.lit('{"file_path":"/f'), turn.cast("string"), F.lit('"}')))
    rows = c.select(
        (F.col("conv_id") * 1000 + turn).alias("tx"), F.lit(0).cast("long").alias("change_ix"), F.lit(_WALL).cast("timestamp").alias("tx_wall"), text("s", "conv_id").alias("session_id"),
        F.concat_ws("_", text("m", "conv_id"), turn.cast("string")).alias("uuid"), F.when(turn % 3 == 2, "p").alias("parent"), F.lit("x").alias("model"), "role", F.filter(F.array(said, used), lambda b: b.isNotNull()).alias("blocks"),
    )
    return whole(decoders.session(rows))


@query("""select event_id, case event_type when 'view' then '/a' || user_id when 'click' then '/n' when 'purchase' then 'http://x' end as artifact from events""")
def artifacts(spark, sf):
    """What a tool's input names: a path, a notebook or an address; nothing for other tools."""
    t = F.col("event_type")
    tool = F.when(t == "view", "Write").when(t == "click", "NotebookEdit").when(t == "purchase", "WebFetch").otherwise("Bash")
    args = F.concat(F.lit('{"file_path":"/a'), F.col("user_id").cast("string"), F.lit('","notebook_path":"/n","url":"http://x"}'))
    return table(spark, sf, "events").select("event_id", decoders.artifact(tool, args).alias("artifact"))


@query(f"""with e as (select event_id as tx, event_id % 3 as a, 'c' || event_id as c, event_type as t, user_id as u from events),
s as (select *, case when t = 'error' then 'error' when t = 'view' then 'running' else 'ok' end as st from e)
select tx, 'node.upsert' as op, 'ToolCall' as kind, c as id, {_NO} as from_id, {_NO} as to_id, '{{"tool":"' || t || '","status":"' || st || '"}}' as props from s
union all select tx, 'node.upsert', 'Resource', 'file:' || u, {_NO}, {_NO}, '{{"uri":"file:' || u || '"}}' from s where tx % 2 = 0
union all select tx, 'edge.upsert', 'touched', {_NO}, c, 'file:' || u, '{{}}' from s where tx % 2 = 0""")
def adapted_calls(spark, sf):
    """One tool call in the records of three frameworks; the events are alike."""
    words = {"parts": ("input-available", "output-available", "output-error"), "graph": ("start", "end", "error"), "lines": ("call", "result", "fail")}
    t, u = F.col("event_type"), F.col("user_id").cast("string")
    parts = []
    for n, (adapter, (running, ok, bad)) in enumerate(words.items()):
        call, tool, status, args = decoders.ADAPTERS[adapter]
        word = F.when(t == "error", bad).when(t == "view", running).otherwise(ok)
        given = F.when(_i() % 2 == 0, F.struct(u.alias("path")))
        raw = F.to_json(F.struct(text("c", "event_id").alias(call), t.alias(tool), word.alias(status), given.alias(args)))
        e = table(spark, sf, "events").filter(_i() % 3 == n).select(_i().alias("tx"), _i().alias("change_ix"), F.lit(_WALL).cast("timestamp").alias("tx_wall"), raw.alias("raw"))
        parts.append(decoders.adapted_calls(e, adapter))
    return whole(reduce(DataFrame.unionByName, parts))


_SURVEY = "with p as (select p_partkey as tx, p_name as t, p_type as b from part), a as (select * from (values ('ring', 'ring', 0), ('tool', 'widget', 1), ('tool', 'gear', 2)) v(concept, alias, ix)), h as (select distinct tx, concept from p, a where contains(lower(t || ' ' || b), alias))"


@query(_SURVEY + f""" select tx, 'node.upsert' as op, 'Entry' as kind, 'e' || tx as id, {_NO} as from_id, {_NO} as to_id, '{{"title":"' || t || '","body":"' || b || '"}}' as props from p
union all select tx, 'node.upsert', 'Concept', concept, {_NO}, {_NO}, '{{"name":"' || concept || '"}}' from h union all select tx, 'edge.upsert', 'mentions', {_NO}, 'e' || tx, concept, '{{}}' from h
union all select tx, 'edge.upsert', 'xref', {_NO}, 'e' || tx, 'e' || tx + 1, '{{}}' from p where tx % 5 = 0""")
def decode_survey(spark, sf):
    """Entries, the concepts that they mention under any alias, and cross references."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("tx"), F.lit(0).cast("long").alias("change_ix"), F.lit(_WALL).cast("timestamp").alias("tx_wall"), text("e", "p_partkey").alias("key"), F.col("p_name").alias("title"), F.col("p_type").alias("body"))
    aliases = spark.createDataFrame([("ring", "ring", 0), ("tool", "widget", 1), ("tool", "gear", 2)], "concept string, alias string, alias_ix int")
    xrefs = p.filter("tx % 5 = 0").withColumns({"a": F.col("key"), "b": text("e", F.col("tx") + 1)})
    return whole(decoders.survey(p, aliases, xrefs))


@query(f"""select event_id as tx, 'node.upsert' as op, 'Host' as kind, user_id::varchar as id, {_NO} as from_id, {_NO} as to_id, props from events""")
def ready_events(spark, sf):
    """Rows that hold events pass as they are."""
    e = ev._event("node.upsert", kind=F.lit("Host"), id=F.col("user_id").cast("string"), props=F.col("props"))
    return whole(decoders.passthrough(table(spark, sf, "events").select(_i().alias("tx"), _i().alias("change_ix"), F.col("ts").alias("tx_wall"), F.lit(0).alias("event_ix"), e.alias("event"))))


@query("""select 't' || user_id as task, arg_max(case event_type when 'click' then 'open' else 'done' end, event_id) as status, (bool_or(event_type = 'click'))::int::bigint as agents, (count(*) filter (where event_type = 'purchase'))::bigint as findings
from events where event_type in ('click', 'view', 'purchase') group by 1 having bool_or(event_type in ('click', 'view'))""".replace("arg_max(case event_type when 'click' then 'open' else 'done' end, event_id)", "arg_max(case event_type when 'click' then 'open' when 'view' then 'done' end, event_id)"))
def task_snapshot(spark, sf):
    """Every task with its status, agents and findings."""
    t = F.col("event_type")
    kind = F.when(t == "click", "task_started").when(t == "view", "task_status").when(t == "purchase", "finding")
    df = table(spark, sf, "events").withColumn("kind", kind).filter("kind is not null")
    df = df.select(_i().alias("tx"), _i().alias("change_ix"), F.col("ts").cast("timestamp").alias("tx_wall"), F.col("kind").alias("event_type"), text("a", "user_id").alias("agent_id"), F.lit("n").alias("agent_name"), text("t", "user_id").alias("task_id"), F.lit("title").alias("task_title"), F.lit("done").alias("status"), text("f", "event_id").alias("finding_id"), F.lit("s").alias("finding_summary"), F.lit("low").alias("severity"))
    return decoders.task_snapshot(decoders.fleet(df))


# Control plane.


def _tails(spark, sf) -> dict[str, str]:
    e = table(spark, sf, "events").groupBy((F.col("user_id") % 12).alias("s")).agg(F.max("event_id").alias("tail"))
    return {f"agents/agent-{r['s']:02d}": str(r["tail"]) for r in e.collect()}  # twelve rows


@query("""with s as (select user_id % 12 as s, max(event_id) as tail from events group by 1), n as (select count(*)::varchar as n, (count(*) - count(*) filter (where s < 3))::varchar as rest from s)
select 'ensure' as step, 'created' as outcome from n union all select 'ensure again', 'exists' from n union all select 'ensure otherwise', 'SubscriptionError' from n union all select 'claim', n from n union all select 'claim while held', 'claimed by w1' from n
union all select 'ack three and end', 'more' from n union all select 'ack when ended', 'FencedError' from n union all select 'claim by another driver', rest from n union all select 'generation', '2' from n union all select 'claim after the lease', rest from n
union all select 'ack of the lost lease', 'FencedError' from n union all select 'release', 'released' from n union all select 'delete', 'gone' from n""")
def lease_cycle(spark, sf):
    """Two drivers share the subscriptions of one folder: leases, fencing, acks that last, expiry and deletion."""
    tails, now = _tails(spark, sf), [0.0]
    root = f"{shared_folder(spark)}/leases-{uuid.uuid4().hex}"
    one, two = (StoredSubscriptions(spark, root, tails, lambda: now[0]) for _ in range(2))
    out = []

    def step(name, f):
        try:
            got = f()
        except errors.ClaimedError as e:
            got = str(e)
        except errors.ChronofoldError as e:
            got = type(e).__name__
        out.append((name, got if isinstance(got, str) else ""))
        return got

    todo = lambda c: str(sum(s["has_pending"] for s in c.streams))
    step("ensure", lambda: "created" if one.ensure("sub", "agents/*") else "exists")
    step("ensure again", lambda: "created" if two.ensure("sub", "agents/*") else "exists")
    step("ensure otherwise", lambda: str(two.ensure("sub", "agents/**")))
    first = one.claim("sub", "w1")
    step("claim", lambda: todo(first))
    step("claim while held", lambda: todo(two.claim("sub", "w2")))
    done = {k: v for k, v in tails.items() if k < "agents/agent-03"}
    step("ack three and end", lambda: "more" if one.ack(first, done, done=True) else "none")
    step("ack when ended", lambda: str(two.ack(first, tails)))
    second = two.claim("sub", "w2")
    step("claim by another driver", lambda: todo(second))
    step("generation", lambda: str(second.generation))
    now[0] += 3600
    third = one.claim("sub", "w1")
    step("claim after the lease", lambda: todo(third))
    step("ack of the lost lease", lambda: str(two.ack(second, tails)))
    step("release", lambda: one.release(third) or "released")
    two.delete("sub")
    step("delete", lambda: "gone" if step_gone(one) else "there")
    return spark.createDataFrame(out, "step string, outcome string")


def step_gone(subscriptions: StoredSubscriptions) -> bool:
    try:
        subscriptions.claim("sub", "w")
    except errors.SubscriptionError:
        return True
    return False


@query("""with s as (select user_id % 12 as s, max(event_id) as tail from events group by 1) select 'agents/agent-' || lpad(s::varchar, 2, '0') as stream, tail::varchar as consumed_to from s where s <> 1 and s < 10""")
def subscribed_streams(spark, sf):
    """A worker drains the pending streams that its pattern links; what was acked before is left alone."""
    from chronofold.streaming.control import consume_subscribed

    tails = _tails(spark, sf)
    s = StoredSubscriptions(spark, f"{shared_folder(spark)}/leases-{uuid.uuid4().hex}", tails)
    s.ensure("sub", "agents/agent-0*")
    s.ack(s.claim("sub", "w0"), {"agents/agent-01": tails["agents/agent-01"]}, done=True)
    seen = []

    def drain(path: str) -> str:
        seen.append((path, tails[path]))
        return f"{tails[path]},0"

    report = consume_subscribed(s, "sub", "w1", drain)
    assert not report["next_wake"]
    return spark.createDataFrame(seen, "stream string, consumed_to string")


@query("select * from (values ('fork', 'created'), ('same again', 'exists'), ('another point', 'ForkError'), ('unknown log', 'ForkError'), ('past the tail', 'ForkError'), ('composite point', 'ForkError'), ('fork of a fork', 'created')) t(what, outcome)")
def fork_rules(spark, sf):
    """A fork lies in a log that exists, at a point that it has reached, and keeps its point."""
    forks = Forks(_tails(spark, sf))
    out = []
    for what, args in (("fork", ("f", "agents/agent-00", "10")), ("same again", ("f", "agents/agent-00", "10")), ("another point", ("f", "agents/agent-00", "11")), ("unknown log", ("g", "agents/none", "1")), ("past the tail", ("g", "agents/agent-00", "99999999999")), ("composite point", ("g", "agents/agent-00", "1,2")), ("fork of a fork", ("h", "f", "5"))):
        try:
            out.append((what, "created" if forks.fork(*args) else "exists"))
        except errors.ForkError as e:
            out.append((what, type(e).__name__))
    return spark.createDataFrame(out, "what string, outcome string")
