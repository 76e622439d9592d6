"""Domain decoders: pure DataFrame functions from source rows to graph events (built with Column
expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.errors import SourceError
from chronofold.functions.offsets import offset_ord
from chronofold.operators.resolve import normal_key, strip_suffixes
from chronofold.plans.events import EdgeKind, Emitter, Graph, NodeKind, decode, valid
from chronofold.plans.fold import fold
from chronofold.sources.logs import table_events

CRM = Graph(
    [NodeKind("Person", {"name": "string", "email": "string", "title": "string"}, unique="email"), NodeKind("Company", {"name": "string", "domain": "string", "stage": "string"}, {"stage": "unknown"}, unique="domain")],
    [EdgeKind("worksAt", ["Person"], ["Company"])],
)
HR = Graph([NodeKind("Person", {"name": "string"}), NodeKind("Company", {"name": "string"})], [EdgeKind("worksAt", ["Person"], ["Company"]), EdgeKind("heldTitle", ["Person"], ["Company"], {"title": "string"})])
CODE = Graph([NodeKind("File", {"path": "string"}), NodeKind("Symbol", {"name": "string"})], [EdgeKind("definedIn", ["Symbol"], ["File"])])
HOSTS = Graph([NodeKind("Host", {"status": "string"})])
SERVICES = Graph(
    [NodeKind("Service", {"name": "string"}), NodeKind("Alias", {"name": "string"}), NodeKind("Operation", {"name": "string"})],
    [EdgeKind("aliasOf", ["Alias"], ["Service"]), EdgeKind("exposes", ["Service"], ["Operation"]), EdgeKind("calls", ["Service"], ["Service"])],
)
TOOLS = Graph([NodeKind("ToolCall", {"tool": "string", "status": "string"}, enums={"status": ["running", "ok", "error"]}), NodeKind("Resource", {"uri": "string"})], [EdgeKind("touched", ["ToolCall"], ["Resource"])])
FLEET = Graph(
    [NodeKind("Agent", {"name": "string"}), NodeKind("Task", {"title": "string", "status": "string"}), NodeKind("Finding", {"summary": "string", "severity": "string"})],
    [EdgeKind("assigned", ["Agent"], ["Task"]), EdgeKind("reported", ["Agent"], ["Finding"]), EdgeKind("about", ["Finding"], ["Task"])],
)
SESSION = Graph(
    [NodeKind("Session", {"model": "string"}), NodeKind("Agent", {"role": "string"}), NodeKind("Turn", {"role": "string", "text": "string"}), NodeKind("Artifact", {"uri": "string"})],
    [EdgeKind("ran", ["Session"], ["Agent"]), EdgeKind("said", ["Agent"], ["Turn"]), EdgeKind("touched", ["Agent"], ["Artifact"])],
)
NEWS = Graph(
    [NodeKind("Report", {"text": "string"}), NodeKind("Tip", {"text": "string"}), NodeKind("Claim", {"value": "string"}), NodeKind("Story", {"headline": "string"}), NodeKind("Justification", {"rule": "string"})],
    [EdgeKind("premiseOf", ["Report", "Tip", "Claim"], ["Justification"]), EdgeKind("derives", ["Justification"], ["Claim", "Story"])],
)
SURVEY = Graph([NodeKind("Entry", {"title": "string", "body": "string"}), NodeKind("Concept", {"name": "string"})], [EdgeKind("mentions", ["Entry"], ["Concept"]), EdgeKind("xref", ["Entry"], ["Entry"])])
#: Tools whose input names an artifact, and the field that holds it.
ARTIFACT_FIELDS = {"Read": "file_path", "Write": "file_path", "Edit": "file_path", "NotebookEdit": "notebook_path", "WebFetch": "url"}
#: Status words of three tool-call dialects.
STATUS = {"call": "running", "result": "ok", "error": "error", "start": "running", "end": "ok", "fail": "error", "output-available": "ok", "output-error": "error", "input-available": "running", "success": "ok"}


def crm(changes: DataFrame) -> DataFrame:
    """person / company / employment rows: value fields key, name, email, title, domain, stage, person, company."""
    e, v = Emitter(CRM), lambda f: F.col("value")[f]
    shape, gone = F.col("shape"), F.col("operation") == "delete"
    works = lambda: (("Person", v("person")), ("Company", v("company")))
    return decode(
        changes,
        ((shape == "person") & ~gone, [e.nodes["Person"].upsert(F.col("key"), {"name": v("name"), "email": v("email"), "title": v("title")})]),
        ((shape == "person") & gone, [e.nodes["Person"].remove(F.col("key"))]),
        ((shape == "company") & ~gone, [e.nodes["Company"].upsert(F.col("key"), {"name": v("name"), "domain": v("domain"), "stage": v("stage")})]),
        ((shape == "company") & gone, [e.nodes["Company"].remove(F.col("key"))]),
        ((shape == "employment") & ~gone, [e.edges["worksAt"].upsert(*works())]),
        ((shape == "employment") & gone, [e.edges["worksAt"].remove(*works())]),
    )


def hr(changes: DataFrame, company: str = "acme") -> DataFrame:
    """company / hire / leave / rehire / promote with valid time (value fields name, title, effective_at)."""
    e, v = Emitter(HR), lambda f: F.col("value")[f]
    ends = (("Person", F.col("key")), ("Company", F.lit(company)))
    shape = F.col("shape")
    return decode(
        changes,
        (shape == "company", [e.nodes["Company"].upsert(F.col("key"), {"name": v("name")})]),
        (shape == "hire", [e.nodes["Person"].upsert(F.col("key"), {"name": v("name")}), e.edges["worksAt"].upsert(*ends, window=valid(start=v("effective_at")))]),
        (shape == "leave", [e.edges["worksAt"].upsert(*ends, window=valid(end=v("effective_at")))]),
        (shape == "rehire", [e.edges["worksAt"].upsert(*ends, window=valid(clear=True))]),
        (shape == "promote", [e.edges["heldTitle"].upsert(*ends, {"title": v("title")}, valid(start=v("effective_at")))]),
    )


def code_memory(changes: DataFrame) -> DataFrame:
    """file / symbol observations; a symbol that moves leaves its old file (value fields path, name, file, old_file)."""
    e, v = Emitter(CODE), lambda f: F.col("value")[f]
    gone, shape = F.col("operation") == "delete", F.col("shape")
    at = lambda f: (("Symbol", F.col("key")), ("File", v(f)))
    moved = F.when(v("old_file").isNotNull(), e.edges["definedIn"].remove(*at("old_file")))
    return decode(
        changes,
        ((shape == "file") & ~gone, [e.nodes["File"].upsert(F.col("key"), {"path": v("path")})]),
        ((shape == "file") & gone, [e.nodes["File"].remove(F.col("key"))]),
        ((shape == "symbol") & ~gone, [e.nodes["Symbol"].upsert(F.col("key"), {"name": v("name")}), e.edges["definedIn"].upsert(*at("file")), moved]),
        ((shape == "symbol") & gone, [e.edges["definedIn"].remove(*at("file")), e.nodes["Symbol"].remove(F.col("key"))]),
    )


def hosts(changes: DataFrame) -> DataFrame:
    e = Emitter(HOSTS)
    return decode(changes, (F.col("operation") != "delete", [e.nodes["Host"].upsert(F.col("key"), {"status": F.col("value")["status"]})]))


SUFFIXES = ["-svc", "-service", ".prod", ".staging", ".svc", ".cluster.local"]


def spans(changes: DataFrame, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """Spans to services, aliases, operations and calls. Only client spans name a callee: the peer name,
    else the server address. Deletes are no-ops."""
    e, v = Emitter(SERVICES), lambda f: F.col("value")[f]
    raw = normal_key(v("service"))
    own = strip_suffixes(v("service"), suffixes)
    callee = F.when(F.lower(v("kind")) == "client", F.coalesce(v("peer"), v("server_address")))
    other = strip_suffixes(callee, suffixes)
    op = F.concat_ws(":", own, v("name"))
    named = lambda service, alias: [e.nodes["Service"].upsert(service, {"name": service}), e.nodes["Alias"].upsert(alias, {"name": alias}), e.edges["aliasOf"].upsert(("Alias", alias), ("Service", service))]
    live = F.col("operation") != "delete"
    return decode(
        changes,
        (live, [*named(own, raw), e.nodes["Operation"].upsert(op, {"name": v("name")}), e.edges["exposes"].upsert(("Service", own), ("Operation", op))]),
        (live & callee.isNotNull(), [*named(other, normal_key(callee)), e.edges["calls"].upsert(("Service", own), ("Service", other))]),
    )


def artifact(tool: Column, args: Column) -> Column:
    """The artifact that a tool's input names; null for other tools."""
    out = F.lit(None).cast("string")
    for name, f in ARTIFACT_FIELDS.items():
        out = F.when(tool == name, F.get_json_object(args, f"$.{f}")).otherwise(out)
    return out


def resource(args: Column) -> Column:
    """`file:<path>` or `query:<query>` of a tool call's arguments."""
    path, query = F.get_json_object(args, "$.path"), F.get_json_object(args, "$.query")
    return F.when(path.isNotNull(), F.concat(F.lit("file:"), path)).when(query.isNotNull(), F.concat(F.lit("query:"), query))


def tool_status(word: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, s in STATUS.items():
        out = F.when(word == k, s).otherwise(out)
    return out


def tool_calls(rows: DataFrame, call: str, tool: str, status: str, args: str) -> DataFrame:
    """Tool calls of any dialect (columns named by the caller) as events on shared Resource ids."""
    e = Emitter(TOOLS)
    uri = resource(F.col(args))
    touched = F.when(uri.isNotNull(), e.nodes["Resource"].upsert(uri, {"uri": uri}))
    edge = F.when(uri.isNotNull(), e.edges["touched"].upsert(("ToolCall", F.col(call)), ("Resource", uri)))
    return decode(rows, (F.lit(True), [e.nodes["ToolCall"].upsert(F.col(call), {"tool": F.col(tool), "status": tool_status(F.col(status))}), touched, edge]))


FLEET_FIELDS = {"task_started": ["task_id", "task_title"], "task_status": ["task_id", "status"], "finding": ["finding_id", "finding_summary", "task_id"], "agent_seen": ["agent_name"], "task_assigned": ["task_id"]}


def fleet(changes: DataFrame) -> DataFrame:
    """Agent-fleet events of five types; a null field that a type needs, or a change that is no insert, is
    an error, as fleet_problems tells and check_fleet raises."""
    e, c = Emitter(FLEET), F.col
    agent = ("Agent", c("agent_id"))
    seen = e.nodes["Agent"].upsert(c("agent_id"), {"name": c("agent_name")})
    task = lambda status: e.nodes["Task"].upsert(c("task_id"), {"title": c("task_title"), "status": status})
    kind = c("event_type")
    return decode(
        changes,
        (kind == "agent_seen", [seen]),
        (kind == "task_started", [seen, task(F.lit("open")), e.edges["assigned"].upsert(agent, ("Task", c("task_id")))]),
        (kind == "task_assigned", [seen, e.edges["assigned"].upsert(agent, ("Task", c("task_id")))]),
        (kind == "task_status", [task(c("status"))]),
        (kind == "finding", [e.nodes["Finding"].upsert(c("finding_id"), {"summary": c("finding_summary"), "severity": c("severity")}), e.edges["reported"].upsert(agent, ("Finding", c("finding_id"))), e.edges["about"].upsert(("Finding", c("finding_id")), ("Task", c("task_id")))]),
    )


def fleet_problems(changes: DataFrame) -> DataFrame:
    """Adds `problem`: a field that the event's type needs is null, the type is unknown, or the change is no
    insert."""
    df = table_events(changes, FLEET_FIELDS)
    known = F.col("event_type").isin(*FLEET_FIELDS)
    first = F.when(F.col("operation") != "insert", "the table is append-only").when(~F.coalesce(known, F.lit(False)), "unknown event type")
    return df.withColumn("problem", F.coalesce(first, F.col("problem")))


def check_fleet(changes: DataFrame) -> DataFrame:
    """The changes if all are valid; raises with the first problem."""
    bad = fleet_problems(changes).filter("problem is not null").orderBy(offset_ord("offset")).limit(1).collect()
    if bad:
        raise SourceError(bad[0]["problem"], None, bad[0]["offset"])
    return changes


def task_snapshot(events: DataFrame) -> DataFrame:
    """(task, status, agents, findings) of every live task of a fleet."""
    live = fold(events).filter("tx_to is null and not deleted")
    tasks = live.filter("kind = 'Task'").select(F.col("id").alias("task"), F.get_json_object("props", "$.status").alias("status"))
    agents = live.filter("kind = 'assigned'").groupBy(F.col("to_id").alias("task")).agg(F.count(F.lit(1)).alias("agents"))
    found = live.filter("kind = 'about'").groupBy(F.col("to_id").alias("task")).agg(F.count(F.lit(1)).alias("findings"))
    return tasks.join(agents, "task", "left").join(found, "task", "left").fillna(0, ["agents", "findings"])


#: What the three adapters of tool calls read: (call id, tool, status word, arguments).
ADAPTERS = {
    "parts": ("toolCallId", "toolName", "state", "input"),
    "graph": ("run_id", "name", "event", "args"),
    "lines": ("id", "tool", "status", "arguments"),
}


def adapted_calls(rows: DataFrame, adapter: str, raw: str = "raw") -> DataFrame:
    """Tool calls from a framework's JSON records (columns raw, tx, change_ix, tx_wall) as events."""
    call, tool, status, args = (F.get_json_object(raw, f"$.{f}") for f in ADAPTERS[adapter])
    return tool_calls(rows.withColumns({"_call": call, "_tool": tool, "_status": status, "_args": args}), "_call", "_tool", "_status", "_args")


def session_text(blocks: str = "blocks") -> Column:
    """Text blocks of a message joined by an empty line (blocks: array<struct<type, text>>)."""
    texts = F.transform(F.filter(F.col(blocks), lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.array_join(texts, "\n\n")


def session(messages: DataFrame) -> DataFrame:
    """Agent session messages (session_id, uuid, parent, model, role, blocks of type/text/name/input) to
    sessions, agents (main or sub), turns and artifacts."""
    e, c = Emitter(SESSION), F.col
    agent_id = F.concat_ws("/", c("session_id"), F.coalesce("parent", F.lit("main")))
    kind = F.when(c("parent").isNull(), "main").otherwise("sub")
    base = [e.nodes["Session"].upsert(c("session_id"), {"model": c("model")}), e.nodes["Agent"].upsert(agent_id, {"role": kind}), e.edges["ran"].upsert(("Session", c("session_id")), ("Agent", agent_id))]
    text = session_text()
    turn = [e.nodes["Turn"].upsert(c("uuid"), {"role": c("role"), "text": text}), e.edges["said"].upsert(("Agent", agent_id), ("Turn", c("uuid")))]
    main = decode(messages, (F.lit(True), base), (text != "", turn))
    used = messages.withColumn("block", F.explode(F.filter("blocks", lambda b: b["type"] == "tool_use")))
    used = used.withColumn("uri", artifact(F.col("block.name"), F.col("block.input"))).filter("uri is not null").withColumn("agent_id", agent_id)
    more = decode(used, (F.lit(True), [e.nodes["Artifact"].upsert(c("uri"), {"uri": c("uri")}), e.edges["touched"].upsert(("Agent", c("agent_id")), ("Artifact", c("uri")))]))
    return main.unionByName(more.withColumn("event_ix", F.col("event_ix") + 100))


def newsroom(changes: DataFrame) -> DataFrame:
    """wire / tip / claim / story dispatches with one justification per source (value fields text, value,
    headline, sources)."""
    e, v, shape = Emitter(NEWS), lambda f: F.col("value")[f], F.col("shape")
    plain = decode(
        changes,
        (shape == "wire", [e.nodes["Report"].upsert(F.col("key"), {"text": v("text")})]),
        (shape == "tip", [e.nodes["Tip"].upsert(F.col("key"), {"text": v("text")})]),
        (shape == "claim", [e.nodes["Claim"].upsert(F.col("key"), {"value": v("value")})]),
        (shape == "story", [e.nodes["Story"].upsert(F.col("key"), {"headline": v("headline")})]),
    )
    each = changes.filter(shape.isin("claim", "story")).select("*", F.posexplode(v("sources")).alias("n", "premise"))
    each = each.withColumn("j", F.concat_ws(":", F.lit("j"), "key", "premise"))
    j = e.nodes["Justification"].upsert(F.col("j"), {"rule": F.lit("cites")})
    kinds = {"Tip": F.col("premise").startswith("tip:"), "Claim": F.col("premise").startswith("claim")}
    premise = lambda k: e.edges["premiseOf"].upsert((k, F.col("premise")), ("Justification", F.col("j")))
    links = decode(
        each,
        (F.lit(True), [j]),
        (kinds["Tip"], [premise("Tip")]),
        (kinds["Claim"] & ~kinds["Tip"], [premise("Claim")]),
        (~kinds["Tip"] & ~kinds["Claim"], [premise("Report")]),
        (shape == "claim", [e.edges["derives"].upsert(("Justification", F.col("j")), ("Claim", F.col("key")))]),
        (shape == "story", [e.edges["derives"].upsert(("Justification", F.col("j")), ("Story", F.col("key")))]),
    )
    return plain.unionByName(links.withColumn("event_ix", F.col("event_ix") + 10))


def observations(rows: DataFrame) -> DataFrame:
    """Observations of people to running profiles: last stated title, aliases so far, verified so far. The
    projector reads its own row only, so its state is a set of running aggregates."""
    from pyspark.sql import Window

    w = Window.partitionBy(normal_key("email")).orderBy("at")
    return rows.select(
        normal_key("email").alias("id"), "at",
        F.last("title", ignorenulls=True).over(w).alias("title"),
        F.size(F.collect_set("name").over(w)).alias("n_aliases"),
        F.max(F.coalesce(F.col("verified"), F.lit(False))).over(w).alias("verified"),
    )


def survey(entries: DataFrame, aliases: DataFrame, xrefs: DataFrame | None = None) -> DataFrame:
    """Wiki entries to entries, the concepts that they mention, and cross references."""
    from chronofold.operators.resolve import first_alias

    e, c = Emitter(SURVEY), F.col
    nodes = decode(entries, (F.lit(True), [e.nodes["Entry"].upsert(c("key"), {"title": c("title"), "body": c("body")})]))
    hit = first_alias(entries.select("key", "tx", "change_ix", "tx_wall", F.concat_ws(" ", "title", "body").alias("text")), aliases, "text")
    links = decode(hit, (F.lit(True), [e.nodes["Concept"].upsert(c("concept"), {"name": c("concept")}), e.edges["mentions"].upsert(("Entry", c("key")), ("Concept", c("concept")))]))
    out = nodes.unionByName(links.withColumn("event_ix", F.col("event_ix") + 1))
    if xrefs is not None:
        out = out.unionByName(decode(xrefs, (F.lit(True), [e.edges["xref"].upsert(("Entry", c("a")), ("Entry", c("b")))])))
    return out


def passthrough(rows: DataFrame) -> DataFrame:
    """Rows that hold ready events."""
    return rows.select("tx", "change_ix", "tx_wall", "event_ix", "event.*")
