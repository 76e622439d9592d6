"""Mixing sources to target weights.

Words per source are summed; weights 1, 2, 3 repeat over the sources in code-point order, null last;
targets share all words by weight, with each source held at `cap` times its own words and the excess
reshared by weight (water-filling, in closed form over sources sorted by cap * words / weight). A
source's rate is target / words; a document is taken floor(rate) times and once more with probability
equal to the fraction.

The last copy is a Bernoulli draw seeded by hashes. Draws of documents of like size are coupled: inside
a stratum (source, size class, hash slice) documents are numbered in hash order and share one uniform
number, and document i is drawn if a whole number lies in (f * (i - 1) + u, f * i + u]. Each is drawn
with probability f, and the words taken stay within a few documents' size of the target.

Scale: what is shuffled is (id, source, size); sums are partial aggregates; the
numbering runs in slices of the hash order and adds up the slices before, so a hot source is cut into as
many windows as it needs. The table of sources is one row each.

Defined cases: null text has size 0 and takes 0; null source is a source of its own; repeated rows count
each; rows that repeat an id are told apart by a digest of their text, so that reruns agree; documents of any
size count whole; with no words all targets are 0; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAP = 3
#: Rows of a stratum slice on average, at most.
SLICE = 2_000
#: md5 makes the draws the same in any SQL engine; 13 hex digits fit a double exactly.
WORDS = "cast(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+') as bigint)"


def _uniform(*parts):
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    per = per.withColumns({
        "full": F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(level), F.lit(0)),
        "spent": F.coalesce(F.sum("weight").over(level), F.lit(0)),
        "words": F.sum("source_size").over(every),
        "weights": F.sum("weight").over(every),
    })
    # Sources before the first that its share does not fill up are capped; the rest share by weight.
    share = (F.col("words") - F.col("full")).cast("double") / (F.col("weights") - F.col("spent")).cast("double")
    per = per.withColumn("share", share).withColumn("fits", F.col("share") * F.col("weight") <= F.lit(cap) * F.col("source_size"))
    per = per.withColumn("line", F.min(F.when(F.col("fits"), F.struct(F.col("full"), F.col("spent"), F.col("share")))).over(every)["share"])
    target = F.when(F.col("line").isNull() | (F.col("line") * F.col("weight") > F.lit(cap) * F.col("source_size")), (F.lit(cap) * F.col("source_size")).cast("double")).otherwise(F.col("line") * F.col("weight"))
    return per.select("source", "source_size", "source_docs", target.alias("target"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    # The start of a digest of the text tells rows apart that repeat an id.
    return texts.select("doc_id", "source", F.coalesce(F.expr(WORDS), F.lit(0).cast("long")).alias("size"), _text_key().alias("text_key"))


def _text_key(text: str = "text"):
    return F.coalesce(F.substring(F.md5(F.col(text).cast("binary")), 1, 16), F.lit(""))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = CAP, seed: str = "mix") -> DataFrame:
    """One row per document: id, size, source, source_size, target, copies."""
    sizes = sized(docs, id_col, text_col, source_col)
    per = targets(sizes, cap).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    per = per.withColumn("slices", (F.floor(F.col("source_docs") / SLICE) + 1).cast("long"))
    df = sizes.join(per.withColumnRenamed("source", "of"), F.expr("source <=> of"))
    df = df.withColumn("u", _uniform(F.lit(seed), F.col("doc_id")))
    df = df.withColumn("slice", F.floor(_uniform(F.lit(seed + "/slice"), F.col("doc_id")) * F.col("slices")).cast("long"))
    df = df.withColumn("class", F.length(F.bin("size")).cast("long"))
    slices = df.groupBy("source", "class", "slice").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("source", "class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = slices.select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("slice").alias("l"), earlier.alias("earlier"))
    df = df.join(slices, F.expr("source <=> s and class = c and slice = l"))
    i = F.col("earlier") + F.row_number().over(Window.partitionBy("source", "class", "slice").orderBy("u", "doc_id", "text_key"))
    df = df.withColumn("i", i.cast("double")).withColumn("start", _uniform(F.lit(seed + "/start"), F.col("source"), F.col("class")))
    whole, f = F.floor("rate"), F.col("rate") - F.floor("rate")
    extra = F.floor(f * F.col("i") + F.col("start")) - F.floor(f * (F.col("i") - 1) + F.col("start"))
    return df.select(F.col("doc_id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", (whole + extra).cast("long").alias("copies"), "text_key")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = CAP, seed: str = "mix") -> DataFrame:
    """The documents, each as many times as the mix takes it, with their own columns."""
    number = copies(docs, id_col, text_col, source_col, cap, seed).select(F.col(id_col).alias("mix_id"), F.col("text_key").alias("mix_text"), "copies")
    # Rows that repeat an id and its text are drawn each; their sum is dealt out to them in the order of a row hash.
    number = number.groupBy("mix_id", "mix_text").agg(F.sum("copies").alias("mix_copies"), F.count(F.lit(1)).alias("mix_rows"))
    df = docs.join(number, docs[id_col].cast("long").eqNullSafe(number["mix_id"]) & (_text_key(text_col) == number["mix_text"]))
    row = F.row_number().over(Window.partitionBy("mix_id", "mix_text").orderBy(F.xxhash64(*[docs[c] for c in docs.columns])))
    one = df.filter("mix_rows = 1").withColumn("mix_times", F.col("mix_copies"))
    many = df.filter("mix_rows > 1").withColumn("mix_row", row)
    many = many.withColumn("mix_times", F.floor(F.col("mix_copies") * F.col("mix_row") / F.col("mix_rows")) - F.floor(F.col("mix_copies") * (F.col("mix_row") - 1) / F.col("mix_rows"))).drop("mix_row")
    out = one.unionByName(many.withColumn("mix_times", F.col("mix_times").cast("long")))
    return out.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.greatest("mix_times", F.lit(1)).cast("int")))).filter("mix_times > 0").select(*[docs[c] for c in docs.columns])


MIX_SQL = r"""
with sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, coalesce(substr(md5(text), 1, 16), '') as text_key from documents
), per as (
  select source, sum(size)::bigint as source_size, count(*)::bigint as source_docs from sizes group by source
), named as (
  select *, ((row_number() over (order by source is null, source collate "C") - 1) % 3 + 1)::bigint as weight from per
), filled as (
  select *,
    coalesce(sum(3 * source_size) over (order by source_size / weight, source is null, source rows between unbounded preceding and 1 preceding), 0)::bigint as filled_words,
    coalesce(sum(weight) over (order by source_size / weight, source is null, source rows between unbounded preceding and 1 preceding), 0)::bigint as spent,
    (sum(source_size) over ())::bigint as words, (sum(weight) over ())::bigint as weights
  from named
), shared as (
  select *, (words - filled_words)::double / (weights - spent)::double as share from filled
), line as (
  select arg_min(share, spent) as line from shared where share * weight <= 3 * source_size
), rated as (
  select s.*, case when line is null or line * weight > 3 * source_size then (3 * source_size)::double else line * weight end as target
  from shared s, line
), drawn as (
  select d.doc_id, d.size, r.source_size, r.target, case when r.source_size > 0 then r.target / r.source_size else 0.0 end as rate,
    ('0x' || substr(md5('mix|' || d.doc_id), 1, 13))::bigint / 4503599627370496.0::double as u,
    floor(('0x' || substr(md5('mix/slice|' || d.doc_id), 1, 13))::bigint / 4503599627370496.0::double * (floor(r.source_docs / 2000) + 1))::bigint as slice,
    d.source, d.text_key, length(bin(d.size))::bigint as class
  from sizes d join rated r on d.source is not distinct from r.source
), numbered as (
  select *, (row_number() over (partition by source, class order by slice, u, doc_id, text_key))::double as i,
    ('0x' || substr(md5('mix/start|' || coalesce(source, 'null') || '|' || class), 1, 13))::bigint / 4503599627370496.0::double as start
  from drawn
)
select doc_id, size, source_size, target,
  (size * (floor(rate) + floor((rate - floor(rate)) * i + start) - floor((rate - floor(rate)) * (i - 1) + start)))::bigint as taken
from numbered
"""
