import random

from pyspark.sql import functions as F

from chronofold.functions.positions import in_ranges, in_steps, numbered, running
from chronofold.plans import ingest
from chronofold.sources import logs
from tests.conftest import rows


def plain_positions(data):
    """(group, key) -> position, by sorting each group."""
    out = {}
    for g in {g for g, _ in data}:
        for i, k in enumerate(sorted(k for h, k in data if h == g)):
            out[g, k] = i + 1
    return out


def test_numbered_by_ranges_and_steps(spark):
    rng = random.Random(7)
    data = [(rng.choice(["hot", "hot", "hot", "a", None]), k) for k in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(data, "g string, k long")
    want = plain_positions(data)
    ranges = in_ranges(df.withColumn("text", F.lpad(F.col("k").cast("string"), 6, "0")), "g", "text")
    assert ranges.filter("g = 'hot'").select("_slice").distinct().count() > 1
    for slices, order in ((ranges, "text"), (in_steps(df, "k", 100), "k")):
        got = numbered(slices, ["g"], [order], "n")
        assert {(r["g"], r["k"]): r["n"] for r in got.collect()} == want
        assert "_slice" not in got.columns


def test_running_sums_and_empty_tables(spark):
    df = spark.createDataFrame([("s", i, i % 5) for i in range(1, 60)], "g string, k long, v long")
    got = running(in_steps(df, "k", 7), ["g"], ["k"], F.col("v"), "upto")
    assert rows(got.select("k", "upto")) == sorted(((i, sum(j % 5 for j in range(1, i + 1))) for i in range(1, 60)), key=repr)
    assert numbered(in_ranges(df.limit(0), "g", "k"), ["g"], ["k"], "n").collect() == []
    null = spark.createDataFrame([("s", None), ("s", 3)], "g string, k long")
    assert rows(numbered(in_steps(null, "k"), ["g"], ["k"], "n").select("n", "k")) == [(1, None), (2, 3)]


def test_txid_runs_across_slices(spark):
    """Runs go on where a slice ends, and end there if the next transaction begins."""
    txids = ["a", "a", "a", None, None, "a", "b", "b", "b", "b", "a", None, "c"]
    data = [("s", 40_000 * i, f"{i:04d}", t) for i, t in enumerate(txids)]
    df = spark.createDataFrame(data, "stream string, arrival_ix long, offset string, txid string")
    want, ends = {}, {}
    run = 0
    for i, t in enumerate(txids):
        run += i == 0 or t is None or t != txids[i - 1]
        want[i], ends[run] = run, f"{i:04d}"
    got = {r["arrival_ix"] // 40_000: r["offset"] for r in logs.transaction_offsets(df).collect()}
    assert got == {i: ends[r] for i, r in want.items()}


def test_transactions_of_a_hot_stream(spark):
    """Runs are cut and numbered alike whether a stream lies in one slice or in many."""
    rng = random.Random(3)
    data = []
    for stream, n in (("hot", 300), ("cold", 5)):
        offset = 0
        for i in range(n):
            offset += rng.random() < 0.6
            data.append((stream, i, str(offset), "x", str(i), "insert"))
    df = spark.createDataFrame(data, "stream string, arrival_ix long, offset string, shape string, key string, operation string")
    want, tx, last, size = {}, {}, {}, {}
    for stream, i, offset, *_ in data:
        if last.get(stream) != offset or size[stream] == 2:
            tx[stream], size[stream] = tx.get(stream, 0) + 1, 0
        last[stream], size[stream] = offset, size[stream] + 1
        want[stream, i] = tx[stream]
    changes = ingest.transactions(df, 2)
    assert {(r["stream"], r["arrival_ix"]): r["tx"] for r in changes.collect()} == want
    runs = {(s, o): max(want[s, i] for t, i, p, *_ in data if (t, p) == (s, o)) for s, _, o, *_ in data}
    assert {(r["stream"], r["tx"]) for r in changes.filter("ends_run").collect()} == {(s, t) for (s, _), t in runs.items()}
    kept = {(r["stream"], r["tx"]) for r in ingest.stop_after(changes, 40).collect()}
    hot = [sum(1 for k, t in want.items() if k[0] == "hot" and t < n) for n in range(1, max(want.values()) + 1)]
    assert {t for s, t in kept if s == "hot"} == {n for n, before in enumerate(hot, 1) if before < 40}
