import random

import pytest
from pyspark.sql import functions as F

from chronofold import errors
from chronofold.operators import decoders, resolve, support, tools
from chronofold.streaming import control
from tests.conftest import rows


def test_suffixes_and_aliases(spark):
    df = spark.createDataFrame([(" Checkout-svc.prod ",), ("-svc",), ("cart",)], "n string")
    assert [r[0] for r in df.select(resolve.strip_suffixes("n", ["-svc", ".prod"])).collect()] == ["checkout", "-svc", "cart"]
    seen = spark.createDataFrame([("k", "b", 2), ("k", "a", 1), ("k", "b", 3)], "k string, alias string, at int")
    assert resolve.fold_aliases(seen, "k", "alias", "at").first().aliases == ["a", "b"]


def test_similarity_and_clusters(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    data = [(i, " ".join(rng.sample(words, rng.randint(1, 6)))) for i in range(80)]
    df = spark.createDataFrame(data, "id long, t string")
    got = set(map(tuple, resolve.similar_pairs(df, "id", "t", 0.6).collect()))
    first = {}
    for i, t in data:
        first.setdefault(frozenset(t.split()), i)
    sets = {i: s for s, i in first.items()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9}
    assert got == want
    canon = dict(rows(resolve.cluster(df.select("id"), spark.createDataFrame(sorted(want), "a long, b long"))))
    parent = {i: i for i, _ in data}
    for _ in range(80):
        for a, b in want:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert canon == parent


def test_merge_flags_conflicts(spark):
    data = [("base", 0, "1", "Jane@x.org", "22", "J. Doe"), ("a", 1, "2", "jane@X.org", "87", "Jane Doe"), ("b", 2, "3", None, "5", "Other")]
    m = resolve.canonical_ids(spark.createDataFrame(data, "branch string, rank int, id string, email string, risk string, name string"), "email")
    assert rows(m.select("id", "canonical")) == [("1", "1"), ("2", "1"), ("3", "3")]
    assert rows(resolve.conflicts(m, ["risk", "name"])) == [("1", "name", "J. Doe", "base-branch", "a=Jane Doe"), ("1", "risk", "22", "base-branch", "a=87")]
    among = resolve.canonical_ids(m.sparkSession.createDataFrame([(*r[:2], r[2], "one@x.org", *r[4:]) for r in data[1:]], "branch string, rank int, id string, email string, risk string, name string"), "email")
    assert rows(resolve.conflicts(among, ["risk"])) == [("2", "risk", "87", "branch-branch", "a=87|b=5")]
    assert rows(resolve.merged(m, ["risk"])) == [("1", "22"), ("3", "5")]
    assert rows(resolve.provenance(m)) == [("1", "merged", "a", "2"), ("3", "canonical", "b", "3")]


def belief(spark):
    sources = spark.createDataFrame([("s1", False), ("s2", False), ("v", False)], "source string, retracted boolean")
    premises = [("j1", "s1", "source"), ("j2", "s2", "source"), ("j3", "v", "source"), ("j4", "vuln", "fact"), ("j4", "v", "source"), ("c1", "x", "fact"), ("c2", "y", "fact")]
    derives = [("j1", "vuln"), ("j2", "vuln"), ("j3", "vuln"), ("j4", "deploy"), ("c1", "y"), ("c2", "x")]
    return sources, spark.createDataFrame(premises, "justification string, premise string, premise_kind string"), spark.createDataFrame(derives, "justification string, fact string")


def test_support_and_cascade(spark):
    sources, premises, derives = belief(spark)
    flag = lambda *ids: support.retract(sources, spark.createDataFrame([(i,) for i in ids], "source string"))
    assert rows(support.holding(sources, premises, derives)) == [("deploy",), ("vuln",)]
    assert rows(support.holding(flag("s1", "s2"), premises, derives)) == [("deploy",), ("vuln",)]
    assert rows(support.holding(flag("s1", "s2", "v"), premises, derives)) == []
    out = dict(rows(support.report(sources, flag("v"), premises, derives)))
    assert out == {"vuln": "survived", "deploy": "died", "x": "not held", "y": "not held"}
    back = dict(rows(support.report(flag("v"), sources, premises, derives)))
    assert back["deploy"] == "revived"
    why = support.explain("vuln", flag("v"), premises, derives, support.holding(flag("v"), premises, derives))
    assert rows(why.select("source", "retracted", "currently_held")) == [("s1", False, True), ("s2", False, True), ("v", True, True)]


def test_beliefs_are_turned_from_held_facts(spark, monkeypatch):
    """Several states share the prepared premises, and what turned between them is what the report says."""
    sources = spark.createDataFrame([("a", False), ("b", False), ("c", True)], "source string, retracted boolean")
    premises = spark.createDataFrame([("j1", "a", "source"), ("j1", "a", "source"), ("j2", "x", "fact"), ("j2", "b", "source"), ("j3", "c", "source"), ("j4", None, "source"), ("j5", "y", "fact")], "justification string, premise string, premise_kind string")
    derives = spark.createDataFrame([("j1", "x"), ("j2", "y"), ("j3", "z"), ("j4", "w"), ("j5", "v")], "justification string, fact string")
    changed = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "source string, retracted boolean")
    said = [r for r in rows(support.report(sources, changed, premises, derives)) if r[1] in ("died", "revived")]
    ready = support.prepared(premises, derives)
    monkeypatch.setattr(support, "prepared", None)
    before, after = (support.holding(s, premises, derives, ready) for s in (sources, changed))
    assert rows(before) == [("v",), ("x",), ("y",)] and rows(after) == [("x",), ("z",)]
    assert rows(support.turned(before, after)) == said == [("v", "died"), ("y", "died"), ("z", "revived")]


def test_recorded_beliefs_hold_each_state_once(spark, monkeypatch):
    """Two states of the sources are two fixpoints, not one for each report and revision."""
    from chronofold.plans import catalog

    calls, plain = [], support.holding
    monkeypatch.setattr(support, "holding", lambda *a, **k: calls.append(1) or plain(*a, **k))
    catalog.queries()["recorded_beliefs"](spark, "/root/testdata/sf0.001").collect()
    assert len(calls) == 2


def test_timeline(spark):
    v = [("1", "ada", 1, 3, {"title": "x"}), ("2", "ada", 3, None, {"title": "y"}), ("3", "jd", 1, 5, {"a": "b"}), ("4", "jd", 5, None, {"a": "b"}), ("5", "new", 4, None, {})]
    df = spark.createDataFrame(v, "id string, entity_id string, recorded_from int, recorded_to int, attributes map<string,string>").withColumn("valid_to", F.lit(None).cast("string"))
    at, latest = tools.resolve_as_of(df, 2), df.filter("recorded_to is null")
    assert rows(tools.not_yet_known(at, latest).select("entity_id")) == [("new",)]
    assert rows(tools.revised_since(at, latest)) == [("ada", ["title"], False)]
    assert [tools.step_anchor(3, i, d) for i, d in ((0, -1), (2, 1), (1, 1))] == [0, 2, 2]


def test_tool_call_dialects(spark):
    df = spark.createDataFrame([("c1", "search", "end", '{"query": "graph databases"}'), ("c2", "read", "output-available", '{"path": "docs/graph.md"}')], "call string, tool string, status string, args string")
    df = df.withColumns({"tx": F.lit(1), "change_ix": F.lit(1), "tx_wall": F.current_timestamp()})
    got = decoders.tool_calls(df, "call", "tool", "status", "args")
    assert rows(got.filter("kind = 'Resource'").select("id")) == [("file:docs/graph.md",), ("query:graph databases",)]
    assert got.filter("kind = 'ToolCall'").select(F.get_json_object("props", "$.status")).distinct().collect()[0][0] == "ok"


def test_subscriptions():
    now = [0.0]
    s = control.Subscriptions({"agents/a": "5", "agents/b": "-1", "other": "3"}, clock=lambda: now[0])
    assert s.ensure("x", pattern="agents/*") and not s.ensure("x", pattern="agents/*")
    with pytest.raises(errors.SubscriptionError):
        s.ensure("x", pattern="other")
    with pytest.raises(errors.SubscriptionError):
        s.ensure("y")
    opened = []
    got = control.consume_subscribed(s, "x", "w1", lambda p: opened.append(p) or "5,0")
    assert opened == ["agents/a"] and got == {"streams": ["agents/a"], "next_wake": False}
    claim = s.claim("x", "w1")
    with pytest.raises(errors.ClaimedError) as e:
        s.claim("x", "w2")
    assert e.value.holder == "w1"
    now[0] = 31
    newer = s.claim("x", "w2")
    with pytest.raises(errors.FencedError):
        s.ack(claim, {"agents/a": "9"})
    s.tails["agents/late"] = "1"
    assert s.ack(newer, {}, done=True)

    def fail(path):
        raise RuntimeError("boom")

    with pytest.raises(RuntimeError, match="boom"):
        control.consume_subscribed(s, "x", "w3", fail)
    s.claim("x", "w4")
    s.delete("x")
    with pytest.raises(errors.SubscriptionError):
        s.claim("x", "w")


def test_forks(spark):
    f = control.Forks()
    assert f.fork("b", "s", "3", 1) and not f.fork("b", "s", "3", 1)
    with pytest.raises(errors.ForkError):
        f.fork("b", "s", "3", 2)
    with pytest.raises(errors.ForkError):
        control.cursor_point("plain")
    df = spark.createDataFrame([("s", "-1", 0, "x"), ("s", "3", 0, "y"), ("s", "3", 1, "z"), ("b", "4", 0, "own")], "stream string, append_base string, ix int, k string")
    assert rows(f.read("b", df).select("stream", "k")) == [("b", "own"), ("b", "x"), ("b", "y")]


def test_support_of_long_chains(spark, monkeypatch):
    """Facts that need several facts, a cycle and more rounds than are kept side by side, against a plain fixpoint."""
    monkeypatch.setattr(support, "PARTS", 2)
    needs = {"j0": ["s0"], "ja": ["s1", "f0"], "jb": ["sx"], **{f"j{i}": [f"f{i - 1}"] for i in range(1, 6)}, "jc": ["f1", "f4"], "jd": ["f5", "g9"], "je": ["h"], "jh": ["k"], "jn": ["f0", "f0"]}
    gives = {"j0": "f0", "ja": "a", "jb": "b", **{f"j{i}": f"f{i}" for i in range(1, 6)}, "jc": "c", "jd": "d", "je": "k", "jh": "h", "jn": "f5", "jm": "m"}
    sources = spark.createDataFrame([("s0", False), ("s1", None), ("sx", True)], "source string, retracted boolean")
    premises = spark.createDataFrame([(j, p, "source" if p.startswith("s") else "fact") for j, ps in needs.items() for p in ps], "justification string, premise string, premise_kind string")
    derives = spark.createDataFrame(list(gives.items()), "justification string, fact string")
    held, size = {"s0", "s1"}, 0
    while len(held) != size:
        size = len(held)
        held |= {gives[j] for j, ps in needs.items() if set(ps) <= held}
    assert rows(support.holding(sources, premises, derives)) == sorted((f,) for f in held - {"s0", "s1"})
