import pytest
from pyspark.sql import functions as F

from chronofold import errors
from chronofold.sources import logs
from tests.conftest import rows


def messages(spark, appends):
    out, n = [], 0
    for a in appends:
        base = "-1" if n == 0 else f"{n:016d}"
        out += [("s", base, f"{n + len(a):016d}", i, k) for i, k in enumerate(a)]
        n += len(a)
    return spark.createDataFrame(out, "stream string, append_base string, append_end string, ix int, key string")


def test_message_offsets_and_resume(spark):
    df = messages(spark, ["abc", "d"])
    got = dict(rows(logs.message_offsets(df).select("key", "offset")))
    assert got == {"a": "-1,1", "b": "-1,2", "c": "0000000000000003,0", "d": "0000000000000004,0"}
    source = logs.append_source(df, "s")
    assert rows(source.read("-1,1").select("key")) == [("b",), ("c",), ("d",)]
    assert rows(source.read("0000000000000003,0").select("key")) == [("d",)]
    assert dict(rows(logs.message_offsets(df, "append").select("key", "offset")))["a"] == "0000000000000003,0"
    with pytest.raises(errors.OffsetFormatError):
        source.read("7")
    with pytest.raises(errors.RetentionError) as e:
        logs.append_source(df, "s", retained_from="0000000000000002").read("0000000000000001,0")
    assert e.value.stream == "s"


def test_state_protocol(spark):
    data = [("s", 0, "1", "t", "a", None, "upsert", "t1", None), ("s", 1, "2", "t", "b", "{}", "insert", "t1", None), ("s", 2, "3", "u", "c", "{}", "delete", "t2", None), ("s", 3, "4", None, None, None, None, None, "snapshot-start"), ("s", 4, "5", "t", "d", "{}", "insert", None, None)]
    df = spark.createDataFrame(data, "stream string, arrival_ix long, offset string, type string, key string, value string, operation string, txid string, control string")
    got = rows(logs.state_source(df, "s", granularity="transaction").read().select("key", "operation", "value", "offset"))
    assert got == [("a", "update", "{}", "2"), ("b", "insert", "{}", "2"), ("c", "delete", "{}", "3"), ("d", "insert", "{}", "5")]
    assert rows(logs.state_source(df, "s", ["u"]).read().select("key")) == [("c",)]
    with pytest.raises(errors.ResetError):
        logs.state_source(df.withColumn("control", F.lit("reset")), "s").read()


def frames(spark, rows_):
    return spark.createDataFrame(rows_, "batch int, ix int, control string, batch_offset string, key string")


def test_shape_log(spark):
    df = frames(spark, [(0, 0, None, "5_0", "a"), (0, 1, None, "5_1", "b"), (0, 2, "up-to-date", "5_1", None), (1, 0, "odd", "6_0", None), (1, 1, None, "6_0", "c")])
    assert rows(logs.batch_offset_source(df, "s").read().select("key", "offset")) == [("a", "5_1"), ("b", "5_1"), ("c", "6_0")]
    for control, offset, error in (("must-refetch", "5_0", errors.MustRefetchError), ("error", "5_0", errors.ControlError), (None, "-1", errors.SourceError), (None, "now", errors.SourceError)):
        with pytest.raises(error):
            logs.batch_offset_source(frames(spark, [(0, 0, control, offset, "a")]), "s").read()
    with pytest.raises(errors.CatchUpTimeout):
        logs.batch_offset_source(df, "s", timeout_s=0).read()
    heard = []
    held = df.withColumn("handle", F.lit("h1"))
    src = logs.batch_offset_source(held, "s", handle="h1", on_handle=heard.append)
    assert rows(src.read("5_1").select("key")) == [("c",)] and heard == ["h1"]
    assert logs.batch_offset_source(held, "s").read("5_1").count() == 3  # no handle: in full


def test_mapper_failures_name_stream_and_offset(spark):
    df = spark.createDataFrame([("1_0", '{"k": 1}'), ("2_0", "{oops"), ("3_0", None)], "offset string, raw string")
    mapper = F.from_json("raw", "k long")["k"]
    with pytest.raises(errors.MapperError, match="2_0") as e:
        logs.mapped(df, "s", mapper)
    assert (e.value.stream, e.value.offset) == ("s", "2_0")
    assert logs.mapped(df.filter("offset <> '2_0'"), "s", mapper).count() == 2


def test_mixed_formats_and_bad_changes_are_refused(spark, tmp_path):
    from chronofold.plans import ingest, store as st

    schema = "arrival_ix long, offset string, key string, operation string, value string, shape string"
    for data, error in (([(0, "1_0", "a", "insert", "x", "s"), (1, "zz", "b", "insert", "x", "s")], errors.OffsetFormatError), ([(0, "1_0", None, "insert", "x", "s")], errors.SourceError)):
        s = st.BeliefStore(spark, f"file://{tmp_path}/{error.__name__}")
        with pytest.raises(error):
            ingest.consume(logs.log_source(spark.createDataFrame(data, schema), "s"), s, lambda c: c)
        assert s.head().n == 0


def test_narrowing_and_jsonl(spark, tmp_path):
    bad = spark.createDataFrame([("s", 0, "1", "k", "insert", "v"), ("s", 1, "2", None, "insert", "v")], "stream string, arrival_ix long, offset string, key string, operation string, value string")
    with pytest.raises(errors.SourceError, match="missing key"):
        logs.check_changes(bad, "s")
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\n  {"a": 2}  \n')
    got = rows(logs.read_jsonl(spark, str(tmp_path / "log.jsonl"), "a long").select("offset", "row.a"))
    assert got == [("0001", 1), ("0003", 2)]


def test_http_batches(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["b", "c"])], "seq long, events array<string>")
    assert rows(logs.http_batches(df, 1).select("seq", "event_ix", "event")) == [(2, 0, "b"), (2, 1, "c")]
    assert logs.http_batches(df, 2).isEmpty()


def test_offsets_longer_than_their_width(spark):
    n = 10_020
    lines = spark.range(1, n + 1).select(F.lit("s").alias("stream"), F.col("id").alias("line_no"), F.col("id").alias("arrival_ix"), F.lit("{}").alias("text"))
    spans = lines.selectExpr("stream", "arrival_ix", "'a' as span_id", "'p' as service_peer_name", "'q' as peer_service")
    want = [str(i).zfill(4) for i in range(1, n + 1)]
    for df in (logs.jsonl_lines(lines), logs.export_spans(spans), logs.filtered_offsets(lines, F.lit(True), "arrival_ix"), logs.snapshot_stream(lines, "arrival_ix")):
        assert [r[0] for r in df.orderBy("arrival_ix").select("offset").collect()] == want
    rest = logs.log_source(logs.jsonl_lines(lines), "s").read(after="9999").orderBy("ord", "arrival_ix")
    assert [r[0] for r in rest.select("offset").collect()] == want[9999:]
