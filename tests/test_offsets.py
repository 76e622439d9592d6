import pytest
from pyspark.sql import functions as F

from chronofold.errors import OffsetFormatError
from chronofold.functions import offsets as O
from tests.conftest import rows

PAIRS = [
    ("2_10", "2_9", 1), ("10_0", "9_999", 1), ("3_0", "3", 0), ("-1", "0_0", -1), ("0_inf", "0_999999", 1), ("0_inf", "0", 1),
    ("0_inf", "26800000_0", -1), ("0_inf,0", "0_inf,3", -1), ("aaa", "aab", -1), ("-1", "-1", 0), ("zz", "-1", 1),
    ("99999999999999999999999999_1", "100000000000000000000000000_0", -1), ("0041000_0", "41000", 0), ("-1,3", "0000000000000003,0", -1), ("5", None, None),
]


def test_compare(spark):
    df = spark.createDataFrame(PAIRS, "l string, r string, e int")
    assert [tuple(r) for r in df.select("l", "r", O.compare_offsets("l", "r")).collect()] == PAIRS


@pytest.mark.parametrize("l, r", [("0_0", "opaque"), ("0_0", "0_0,1"), ("x,1", "3,1")])
def test_mixed_formats_raise(spark, l, r):
    with pytest.raises(Exception, match="different formats"):
        spark.createDataFrame([(l, r)], "l string, r string").select(O.compare_offsets("l", "r")).collect()


def test_compose_and_parse(spark):
    df = spark.createDataFrame([("7_0", 3)], "b string, n long")
    assert df.select(O.compose_offset("b", "n")).first()[0] == "7_0,3"
    for b, n in (("a,b", 1), ("a", -1), ("a", None)):
        with pytest.raises(Exception, match="cannot compose"):
            spark.createDataFrame([(b, n)], "b string, n long").select(O.compose_offset("b", "n")).collect()
    df = spark.createDataFrame([("7_0,3",), ("7_0",)], "o string")
    assert rows(df.select(O.ackable_offset("o"))) == [("7_0",), ("7_0",)]
    assert [r[0] for r in df.select(O.parse_composite("o")).collect()] == [("7_0", 3), None]
    with pytest.raises(Exception, match="composite cursor"):
        df.select(O.fork_point("o")).collect()


def test_check_formats(spark):
    ok = spark.createDataFrame([("s", "-1"), ("s", "1_0"), ("t", "abc")], "stream string, offset string")
    O.check_formats(ok)
    with pytest.raises(OffsetFormatError):
        O.check_formats(ok.union(spark.createDataFrame([("t", "1")], ok.schema)))


def test_recorded_instants(spark):
    df = spark.createDataFrame([("r1:0000000000000002:2026-01-01T00:00:00.000Z",), ("e1:9:x",)], "t string")
    assert [r[0] if r[0] is None else int(r[0]["revision"]) for r in df.select(O.recorded_instant("t")).collect()] == [2, None]
    with pytest.raises(Exception, match="not a recorded instant"):
        df.select(O.recorded_instant_revision("t")).collect()
    at = spark.range(1).select(O.format_instant(F.lit(5), F.lit("2026-01-02 03:04:05").cast("timestamp"))).first()[0]
    assert at == "r1:0000000000000005:2026-01-02T03:04:05.000Z"
