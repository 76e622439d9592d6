"""Stream offsets as columns: parsing, composing and one sortable key for every format.

Formats: the start "-1"; numeric tuples "3", "10_0", "0_inf"; composites "<base>,<n>"; anything else is
opaque. An offset is compiled once to struct<base, consumed>, whose order is the offset order, so sorting,
filtering and partitioning stay native. Opaque offsets sort by UTF-8 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.errors import OffsetFormatError

STREAM_START = "-1"
NUMERIC = r"^\d+(?:_(?:\d+|inf))*$"
COMPOSITE = r"^([^,]*),(\d+)$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_composite(offset) -> Column:
    return _col(offset).rlike(COMPOSITE)


def parse_composite(offset) -> Column:
    """struct<base, consumed> of a composite offset; null for any other."""
    c = _col(offset)
    return F.when(is_composite(c), F.struct(F.regexp_extract(c, COMPOSITE, 1).alias("base"), F.regexp_extract(c, COMPOSITE, 2).cast("bigint").alias("consumed")))


def compose_offset(base, consumed) -> Column:
    """`<base>,<n>`; raises on a negative or missing count and on bases that hold a comma."""
    b, n = _col(base), _col(consumed)
    bad = n.isNull() | (n < 0) | (n != F.floor(n)) | b.contains(",")
    return F.when(bad, F.raise_error(F.lit("cannot compose an offset from this base and count")).cast("string")).otherwise(F.concat_ws(",", b, n.cast("bigint").cast("string")))


def numeric_parts(offset) -> Column:
    """Parts of a numeric tuple as digit strings or 'inf'; null for other formats."""
    c = _col(offset)
    return F.when(c.rlike(NUMERIC), F.split(c, "_"))


def base_key(offset) -> Column:
    """Sort key of a plain offset. Numbers are prefixed by their length, so any size sorts right."""
    c = _col(offset)
    digits = lambda p: F.regexp_replace(p, "^0+", "")
    part = lambda p: F.when(p == "inf", F.lit("~")).otherwise(F.concat(F.lpad(F.length(digits(p)).cast("string"), 3, "0"), digits(p)))
    trimmed = F.regexp_replace(c, "(?:_0+)+$", "")
    numeric = F.concat(F.lit("n"), F.array_join(F.transform(F.split(trimmed, "_"), part), ""))
    return F.when(c == STREAM_START, F.lit("")).when(c.rlike(NUMERIC), numeric).otherwise(c)


def offset_ord(offset) -> Column:
    """struct<base, consumed> that sorts like the offset; plain offsets have consumed = -1."""
    c = _col(offset)
    p = parse_composite(c)
    return F.struct(base_key(F.coalesce(p["base"], c)).alias("base"), F.coalesce(p["consumed"], F.lit(-1).cast("bigint")).alias("consumed"))


def offset_format(offset) -> Column:
    """start, numeric, opaque, or composite/<format of the base>."""
    c = _col(offset)
    plain = lambda x: F.when(x == STREAM_START, "start").when(x.rlike(NUMERIC), "numeric").otherwise("opaque")
    return F.when(is_composite(c), F.concat(F.lit("composite/"), plain(parse_composite(c)["base"]))).otherwise(plain(c))


def compare_offsets(left, right) -> Column:
    """-1, 0 or 1; null if either is null; raises where formats cannot be compared."""
    a, b = _col(left), _col(right)
    oa, ob = offset_ord(a), offset_ord(b)
    order = F.when(oa < ob, -1).when(oa > ob, 1).otherwise(0)
    numeric = lambda x: base_key(F.coalesce(parse_composite(x)["base"], x)).startswith("n") & F.coalesce(parse_composite(x)["base"], x).rlike(NUMERIC)
    start = lambda x: F.coalesce(parse_composite(x)["base"], x) == STREAM_START
    mixed = (is_composite(a) != is_composite(b)) | ((numeric(a) != numeric(b)) & ~start(a) & ~start(b))
    fail = F.raise_error(F.concat(F.lit("offsets of different formats: "), a, F.lit(" and "), b)).cast("int")
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a == b, 0).when(a == STREAM_START, -1).when(b == STREAM_START, 1).when(mixed, fail).otherwise(order)


def check_formats(log: DataFrame, stream: str = "stream", offset: str = "offset") -> None:
    """Raise if a stream mixes formats: one aggregate over the log; the start goes with any format."""
    kinds = log.select(stream, offset_format(offset).alias("format")).filter("format <> 'start'")
    bad = kinds.groupBy(stream).agg(F.min("format").alias("a"), F.max("format").alias("b")).filter("a <> b").limit(1).collect()
    if bad:
        raise OffsetFormatError(f"stream {bad[0][stream]!r} mixes {bad[0]['a']} and {bad[0]['b']} offsets")


def ackable_offset(cursor) -> Column:
    """The whole-append base of a composite cursor, else the cursor itself."""
    c = _col(cursor)
    return F.coalesce(parse_composite(c)["base"], c)


def fork_point(cursor) -> Column:
    """struct<offset, sub_offset> of a composite cursor; raises for any other."""
    p = parse_composite(cursor)
    fail = F.raise_error(F.lit("a fork point needs a composite cursor"))
    return F.struct(F.when(p.isNull(), fail.cast("string")).otherwise(p["base"]).alias("offset"), F.when(p.isNull(), fail.cast("bigint")).otherwise(p["consumed"]).alias("sub_offset"))


def encode_offset(count) -> Column:
    """A message count as 16 padded digits."""
    return F.lpad(_col(count).cast("string"), 16, "0")


def decode_offset(offset) -> Column:
    return F.when(_col(offset) == STREAM_START, F.lit(0).cast("bigint")).otherwise(_col(offset).cast("bigint"))


INSTANT = r"^r1:(\d+):(.+)$"


def recorded_instant(text) -> Column:
    """struct<revision, at> of `r1:<revision>:<timestamp>`; sorts by revision, then timestamp text;
    null for other forms."""
    c = _col(text)
    return F.when(c.rlike(INSTANT), F.struct(F.regexp_extract(c, INSTANT, 1).cast("decimal(38,0)").alias("revision"), F.regexp_extract(c, INSTANT, 2).alias("at")))


def recorded_instant_revision(text) -> Column:
    """The revision; raises for instants of other books."""
    r = recorded_instant(text)
    return F.when(r.isNull(), F.raise_error(F.lit("not a recorded instant of this book")).cast("decimal(38,0)")).otherwise(r["revision"])


def format_instant(revision, at) -> Column:
    return F.concat(F.lit("r1:"), F.lpad(_col(revision).cast("string"), 16, "0"), F.lit(":"), F.date_format(_col(at), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
