import pytest
from pyspark.sql import functions as F

from chronofold.errors import CommitConflict, ConstraintError, DroppedChangeError, StalePlanError
from chronofold.operators.tools import believed_at
from chronofold.operators.views import View
from chronofold.plans import events as ev, ingest, store as st
from chronofold.sources.logs import log_source
from tests.conftest import rows

ITEMS = [("001", "a", "insert", "a1"), ("002", "b", "insert", "b1"), ("003", "a", "update", "a2"), ("004", "c", "insert", "c1")]
GRAPH = ev.Graph([ev.NodeKind("Item", {"label": "string"})])


def source(spark, data, name="items"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "arrival_ix long, offset string, key string, operation string, label string")
    return log_source(df.withColumn("shape", F.lit("item")), name)


def decode(changes):
    e = ev.Emitter(GRAPH)
    gone = F.col("operation") == "delete"
    return ev.decode(changes, (gone, [e.nodes["Item"].remove(F.col("key"))]), (~gone & (F.col("label") != "skip"), [e.nodes["Item"].upsert(F.col("key"), {"label": F.col("label")})]))


def current(store):
    return dict(rows(View(store.versions()).nodes("Item").select("id", F.get_json_object("props", "$.label"))))


def test_resume_replay_and_anchors(spark, tmp_path):
    s = st.BeliefStore(spark, f"file://{tmp_path}/b", GRAPH)
    assert ingest.consume(source(spark, ITEMS), s, decode, stop=2) == ingest.Consumed(2, None, "002")
    assert ingest.consume(source(spark, ITEMS), s, decode) == ingest.Consumed(2, "002", "004")
    assert ingest.consume(source(spark, ITEMS), s, decode).processed == 0
    assert current(s) == {"a": "a2", "b": "b1", "c": "c1"}
    assert s.recorded_now() == 4
    book = st.CheckpointBook(s)
    assert book.last_offset("items") == "004" and book.anchor_for("items", "002") == 2 and book.anchor_for("items", "9") is None
    at = believed_at(s.versions(), s.checkpoints(), s.revisions(), "items", "002")
    assert rows(at.select("id")) == [("a",), ("b",)]
    more = [*ITEMS, ("005", "ghost", "delete", None), ("006", "a", "update", "a2")]
    ingest.consume(source(spark, more), s, decode)
    assert s.recorded_now() == 4 and book.anchor_for("items", "006") == 4
    book.record("items", "003", 3)
    assert book.last_offset("items") == "006"


def test_shared_offset_runs(spark, tmp_path):
    data = [("10_0", k, "insert", k) for k in "abcde"]
    s = st.BeliefStore(spark, f"file://{tmp_path}/b", GRAPH)
    assert ingest.consume(source(spark, data), s, decode, stop=2, max_batch_size=2).last_offset is None
    s = st.BeliefStore(spark, f"file://{tmp_path}/c", GRAPH)
    ingest.consume(source(spark, data), s, decode, max_batch_size=2)
    assert s.revisions().count() == 3 and s.checkpoints().count() == 1


def test_drop_rolls_back(spark, tmp_path):
    s = st.BeliefStore(spark, f"file://{tmp_path}/b", GRAPH)
    with pytest.raises(DroppedChangeError, match="'b'"):
        ingest.consume(source(spark, [("1", "a", "insert", "x"), ("1", "b", "insert", "skip")]), s, decode)
    assert s.events() is None and s.head().n == 0


def test_failing_decoder_leaves_nothing(spark, tmp_path):
    s = st.BeliefStore(spark, f"file://{tmp_path}/b", GRAPH)

    def broken(changes):
        raise RuntimeError("boom")

    with pytest.raises(RuntimeError, match="boom"):
        ingest.consume(source(spark, ITEMS), s, broken)
    assert s.head().n == 0


@pytest.mark.parametrize("n", [0, -1, 1.5, float("inf"), True])
def test_bad_batch_size(n):
    with pytest.raises(ValueError):
        ingest.check_max_batch(n)


def test_history_guard(spark, tmp_path):
    with pytest.raises(ConstraintError):
        ingest.consume(source(spark, ITEMS), st.BeliefStore(spark, f"file://{tmp_path}/b", GRAPH, history=False), decode)


def test_conflicts_branches_and_plans(spark, tmp_path):
    s = st.BeliefStore(spark, f"file://{tmp_path}/b", GRAPH)
    ingest.consume(source(spark, ITEMS[:2]), s, decode)
    old = s.head()
    b = s.branch(f"file://{tmp_path}/branch")
    none = spark.createDataFrame([], "canonical string, property string, kept string, incoming string")
    merged, canon = spark.createDataFrame([("a",)], "canonical string"), spark.createDataFrame([("a", "a")], "id string, canonical string")
    plan = st.plan_merge(s, none, merged, canon)
    extra = source(spark, [("9", "z", "insert", "z1")], "other")
    ingest.consume(extra, b, decode)
    assert set(current(b)) == {"a", "b", "z"} and set(current(s)) == {"a", "b"}
    events = b.events().filter("id = 'z'")
    st.apply_plan(s, plan, events)
    assert set(current(s)) == {"a", "b", "z"}
    with pytest.raises(StalePlanError):
        st.apply_plan(s, plan, events)
    with pytest.raises(StalePlanError):
        st.apply_plan(s, {**plan, "merged_nodes": 7}, events)
    with pytest.raises(CommitConflict):
        s._publish_manifest({"n": old.n})
    s.export(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/nodes").count() == 3


def test_streaming_wrapper(spark, tmp_path):
    from chronofold.streaming.live import consume_stream

    schema = "arrival_ix long, offset string, key string, operation string, label string, stream string, shape string"
    data = [(i, *r, "items", "item") for i, r in enumerate(ITEMS)]
    spark.createDataFrame(data[:2], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    s = st.BeliefStore(spark, f"file://{tmp_path}/b", GRAPH)

    def run():
        q = consume_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "items", s, decode, f"{tmp_path}/cp")
        q.awaitTermination()

    run()
    spark.createDataFrame(data[1:], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert current(s) == {"a": "a2", "b": "b1", "c": "c1"} and s.recorded_now() == 4


TOWN = ev.Graph([ev.NodeKind("P", {"mail": "string"}, unique="mail"), ev.NodeKind("C")], [ev.EdgeKind("at", ["P"], ["C"], cardinality="one")])


def town(changes):
    e = ev.Emitter(TOWN)
    kind, gone = F.col("label"), F.col("operation") == "delete"
    a, b = F.split("key", ">")[0], F.split("key", ">")[1]
    return ev.decode(
        changes,
        ((kind == "C") & ~gone, [e.nodes["C"].upsert(F.col("key"), {})]),
        ((kind == "C") & gone, [e.nodes["C"].remove(F.col("key"))]),
        ((kind == "at") & ~gone, [e.edges["at"].upsert(("P", a), ("C", b))]),
        ((kind == "at") & gone, [e.edges["at"].remove(("P", a), ("C", b))]),
        (~kind.isin("C", "at"), [e.nodes["P"].upsert(F.col("key"), {"mail": kind})]),
    )


def test_rules_hold_across_commits(spark, tmp_path):
    s = st.BeliefStore(spark, f"file://{tmp_path}/b", TOWN)
    log = []

    def add(key, operation, label):
        log.append((f"{len(log):03d}", key, operation, label))
        try:
            ingest.consume(source(spark, log), s, town)
        except ConstraintError:
            log.pop()
            raise

    add("p", "insert", "m@x")
    add("c", "insert", "C")
    add("d", "insert", "C")
    add("p>c", "insert", "at")
    for bad, rule in ((("q", "insert", "M@X"), "unique"), (("p>d", "insert", "at"), "cardinality"), (("c", "delete", "C"), "restricted"), (("z>c", "insert", "at"), "endpoint")):
        with pytest.raises(ConstraintError, match=rule):
            add(*bad)
    add("p", "update", "new@x")
    add("q", "insert", "m@x")
    add("p>c", "delete", "at")
    add("c", "delete", "C")
    assert rows(s.versions().filter("tx_to is null and not deleted").select("kind", "id")) == [("C", "d"), ("P", "p"), ("P", "q")]


def test_compaction_keeps_all_reads(spark, tmp_path):
    s, whole = (st.BeliefStore(spark, f"file://{tmp_path}/{x}", GRAPH) for x in "bw")
    assert s.compact().n == 0
    more = [*ITEMS, ("005", "b", "delete", None), ("006", "d", "insert", "d1")]
    for store in (s, whole):
        ingest.consume(source(spark, ITEMS), store, decode, tx_wall="2020-01-01")
    before, marks = rows(s.versions()), rows(s.checkpoints())
    s.compact()
    assert rows(s.versions()) == before and rows(s.checkpoints()) == marks and s.recorded_now() == 4
    assert len(s.head().files) == 1
    copy = s.branch(f"file://{tmp_path}/copy")
    for store in (s, whole):
        assert ingest.consume(source(spark, more), store, decode, tx_wall="2020-01-02").from_offset == "004"
    assert rows(s.versions()) == rows(whole.versions()) and rows(s.revisions()) == rows(whole.revisions())
    assert current(s) == {"a": "a2", "c": "c1", "d": "d1"}
    assert rows(copy.versions()) == before
    s.compact()
    assert rows(s.versions()) == rows(whole.versions()) and len(s.head().files) == 1
    with pytest.raises(DroppedChangeError):
        ingest.consume(source(spark, [*more, ("007", "x", "insert", "skip")]), s, decode)
