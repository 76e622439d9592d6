import datetime
import random

import pytest
from pyspark.sql import functions as F

from chronofold.errors import ConstraintError
from chronofold.plans import constraints, events as ev, fold
from tests.conftest import rows

DAY = datetime.datetime(2026, 1, 1)
SCHEMA = "tx long, change_ix long, tx_wall timestamp, event_ix int, op string, kind string, id string, from_kind string, from_id string, to_kind string, to_id string, props string, valid_from timestamp, valid_to timestamp, clear_valid_to boolean"


def at(n):
    return DAY + datetime.timedelta(days=n)


def node(tx, op, id="a", props="p", start=None, end=None, clear=False, ix=0, wall=None):
    return (tx, tx, wall or at(tx), ix, f"node.{op}", "N", id, None, None, None, None, props, start, end, clear)


def edge(tx, op, a, b, end=None, clear=False, kind="e", change=None):
    return (tx, tx if change is None else change, at(tx), 0, f"edge.{op}", kind, None, "N", a, "N", b, "{}", None, end, clear)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def model(data):
    """Sequential fold, one event at a time."""
    rank = ev.OP_RANK
    state, versions = {}, {}
    by_tx = {}
    for e in sorted(data, key=lambda e: (e[0], e[1], rank[e[4]], e[3])):
        by_tx.setdefault(e[0], []).append(e)
    for tx, es in sorted(by_tx.items()):
        touched = set()
        for e in es:
            key = e[5:11]
            old = state.get(key)
            live = old is not None and not old[3]
            if e[4].endswith("remove"):
                if live:
                    state[key] = (*old[:3], True)
                    touched.add(key)
                continue
            _, _, wall, *_, props, start, end, clear = e
            if not live:
                start = start if start is not None else None if end is not None and end <= wall else wall
                state[key] = (props, start, end, False)
            else:
                state[key] = (props, old[1], end if end is not None else None if clear else old[2], False)
            touched.add(key)
        for key in touched:
            seen = versions.setdefault(key, [])
            last = seen[-1][1] if seen else None
            if state[key] != last and not (state[key][3] and (last is None or last[3])):
                seen.append((tx, state[key]))
    out = []
    for key, vs in versions.items():
        for i, (tx, s) in enumerate(vs):
            out.append((*key, *s, tx, vs[i + 1][0] if i + 1 < len(vs) else None))
    return sorted(out, key=repr)


COLUMNS = ("kind", "id", "from_kind", "from_id", "to_kind", "to_id", "props", "valid_from", "valid_to", "deleted", "tx_from", "tx_to")


def test_fold_equals_sequential_model(spark):
    rng = random.Random(7)
    data = []
    for _ in range(900):
        tx = rng.randint(1, 60)
        wall = at(tx)
        id = f"{rng.randint(0, 25)}"
        up = rng.random() < 0.7
        start = at(rng.randint(-5, 5)) if rng.random() < 0.3 else None
        end = at(tx + rng.randint(-3, 3)) if rng.random() < 0.3 else None
        clear = end is None and rng.random() < 0.3
        data.append((tx, rng.randint(0, 10**6), wall, 0, "node.upsert" if up else "node.remove", "N", id, None, None, None, None, rng.choice("pq") if up else None, start if up else None, end if up else None, clear if up else False))
    assert rows(fold.fold(frame(spark, data)).select(*COLUMNS)) == model(data)


def test_windows(spark):
    end = at(2)
    data = [node(1, "upsert", start=at(-3)), node(2, "upsert", end=end), node(3, "upsert", start=at(9)), node(4, "upsert", clear=True), node(1, "upsert", "b", end=at(-1)), node(1, "upsert", "c")]
    got = {(r.id, r.tx_from): (r.valid_from, r.valid_to) for r in fold.fold(frame(spark, data)).collect()}
    assert got == {("a", 1): (at(-3), None), ("a", 2): (at(-3), end), ("a", 4): (at(-3), None), ("b", 1): (None, at(-1)), ("c", 1): (at(1), None)}


def test_replay_is_silent_and_contrast(spark):
    data = [node(1, "upsert"), node(2, "upsert"), node(3, "remove"), node(4, "remove")]
    assert fold.fold(frame(spark, data)).count() == 2
    assert fold.fold(frame(spark, data), coalesce=False).count() == 3
    assert fold.fold(frame(spark, [node(1, "remove")])).isEmpty()


def test_revisions_carry_forward_and_mint(spark):
    v = fold.fold(frame(spark, [node(2, "upsert"), node(3, "upsert"), node(4, "upsert", props="q")]))
    tx = spark.createDataFrame([(i,) for i in range(1, 6)], "tx long")
    got = rows(fold.revisions(fold.captured_transactions(v, tx), slice_rows=2).select("tx", "revision"))
    assert got == [(1, 1), (2, 2), (3, 2), (4, 3), (5, 3)]


def test_apply_order_inside_a_change(spark):
    data = [node(1, "remove", ix=0), node(1, "upsert", ix=1)]
    assert fold.fold(frame(spark, data)).isEmpty()


def test_endpoint_rules(spark):
    data = [node(1, "upsert", "a"), edge(2, "upsert", "a", "b"), node(3, "upsert", "b"), edge(4, "upsert", "a", "b"), node(5, "remove", "b")]
    df = frame(spark, data)
    assert rows(constraints.missing_endpoints(df)) == [("e", "a", "b", 2, "N/b")]
    assert rows(constraints.restricted_deletes(df)) == [("N", "b", 5, 1)]
    ok = [node(1, "upsert", "a"), node(1, "upsert", "b"), edge(1, "upsert", "a", "b"), edge(2, "remove", "a", "b"), node(2, "remove", "b")]
    assert constraints.restricted_deletes(frame(spark, ok)).isEmpty()


def test_cardinality_one(spark):
    ok = [edge(1, "upsert", "a", "b"), edge(2, "upsert", "a", "b"), edge(3, "upsert", "a", "b", end=at(2)), edge(4, "upsert", "a", "c"), edge(5, "remove", "a", "c"), edge(6, "upsert", "a", "b", clear=True)]
    assert constraints.cardinality_violations(frame(spark, ok), ["e"]).isEmpty()
    bad = frame(spark, [*ok, edge(7, "upsert", "a", "d")])
    assert rows(constraints.cardinality_violations(bad, ["e"])) == [("e", "a", "d", 7, 2)]


def test_cardinality_of_edges_at_one_place(spark):
    """Edges of one change are born by target, however the rows are dealt."""
    names = [chr(c) for c in range(ord("b"), ord("t"))]
    df = frame(spark, [edge(1, "upsert", "a", to) for to in names])
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows(constraints.cardinality_violations(df, ["e"]))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert got == [("e", "a", to, 1, n) for n, to in enumerate(names[1:], 2)]


def test_writes_of_absent_rows(spark):
    got = rows(fold.effective_writes(frame(spark, [node(1, "remove"), edge(2, "remove", "a", "b"), edge(3, "upsert", "a", "b"), edge(4, "remove", "a", "b")])))
    assert got == [(1, 1, 1), (2, 2, 0), (3, 3, 1), (4, 4, 1)]


def test_event_checks(spark):
    with pytest.raises(ConstraintError):
        ev.check_events(frame(spark, [node(1, "upsert", end=at(1), clear=True)]))
    with pytest.raises(ValueError):
        ev.valid(end=at(1), clear=True)
    with pytest.raises(ValueError):
        ev.Graph([ev.NodeKind("N", {"meta": "string"})])
    g = ev.Graph([ev.NodeKind("A", {"x": "string", "s": "string"}, {"s": "unknown"}, {"s": ["unknown", "ok"]}), ev.NodeKind("B")], [ev.EdgeKind("ab", ["A"], ["B"])])
    e = ev.Emitter(g)
    with pytest.raises(ValueError):
        e.edges["ab"].upsert(("B", "1"), ("A", "2"))
    with pytest.raises(ValueError):
        e.nodes["A"].upsert("1", {"nope": 1})
    assert spark.range(1).select(e.nodes["A"].upsert("1", {"x": "y"})).first()[0]["props"] == '{"x":"y","s":"unknown"}'
    with pytest.raises(Exception, match="cannot be"):
        spark.range(1).select(e.nodes["A"].upsert("1", {"s": "bad"})).collect()


def test_inverted_windows(spark):
    v = fold.fold(frame(spark, [node(5, "upsert", start=at(9), end=at(6))]))
    assert constraints.inverted_windows(v).count() == 1
    assert fold.repair_windows(v).first().valid_from is None
    assert fold.repair_windows(v).filter(F.col("valid_to").isNotNull()).count() == 1


@pytest.mark.parametrize("step", [3, 100_000])
def test_rules_over_slices_of_a_hub(spark, monkeypatch, step):
    """Every rule against a replay event by event, with a hub whose edges lie in many slices or in one."""
    monkeypatch.setattr(constraints, "STEP", step)
    rng = random.Random(11)
    data = []
    for tx in range(1, 120):
        pick = rng.random()
        if pick < 0.3:
            data.append(node(tx, rng.choice(["upsert", "upsert", "remove"]), rng.choice("habc")))
        else:
            data.append(edge(tx, rng.choice(["upsert", "upsert", "remove"]), *rng.sample(["h", "h", *"abcd"], 2)))
    there, links, missing, deletes, many = set(), set(), [], [], []
    for e in data:
        tx, op, id, pair = e[0], e[4], e[6], (e[8], e[10])
        if op == "node.upsert":
            there.add(id)
        elif op == "node.remove":
            touching = sum(1 for p in links if id in p)
            if id in there and touching:
                deletes.append(("N", id, tx, touching))
            there.discard(id)
        elif op == "edge.upsert":
            missing += [("e", *pair, tx, f"N/{x}") for x in pair if x not in there]
            born = pair not in links
            links.add(pair)
            n = sum(1 for p in links if p[0] == pair[0])
            if born and n > 1:
                many.append(("e", *pair, tx, n))
        else:
            links.discard(pair)
    df = frame(spark, data)
    assert missing and deletes and many
    assert rows(constraints.missing_endpoints(df)) == sorted(missing, key=repr)
    assert rows(constraints.restricted_deletes(df)) == sorted(deletes, key=repr)
    assert rows(constraints.cardinality_violations(df, ["e"])) == sorted(many, key=repr)
