"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """The rank file and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def pii_key(spark: SparkSession) -> bytes:
    """The key of pseudonyms: the session's spark.chronofold.pii.key; a key known to all where none is set, for
    synthetic tables only."""
    return spark.conf.get("spark.chronofold.pii.key", "synthetic tables").encode()


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronofold.llm import byte_bpe

    return byte_bpe.encode_digests(_table(spark, sf_dir, "documents"), *vocabulary())


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronofold.llm import embedding_dedup

    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronofold.llm import quality_rules

    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronofold.llm import pii

    return pii.scrub(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronofold.llm import jaccard_join

    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronofold.llm import chat_format

    return chat_format.parse_transcripts(chat_format.transcripts(_table(spark, sf_dir, "conversations")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronofold.llm import quality_classifier

    return quality_classifier.score(*(_table(spark, sf_dir, t) for t in ("documents", "labels", "pages")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronofold.llm import substring_dedup

    out = substring_dedup.kept_texts(_table(spark, sf_dir, "documents"))
    # What is left as text; U+FFFD stands where a cut divides a character. The digest is of the bytes.
    return out.select("doc_id", *substring_dedup.digests(), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronofold.llm import mixing

    out = mixing.copies(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronofold.llm import language_id

    return language_id.identify(_table(spark, sf_dir, "documents"))


JACCARD_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'x^', ''), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, unnest(list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], chr(10)))
    when len(w) > 0 then [array_to_string(w, chr(10))] else [] end)) as s from words
), sizes as (
  select doc_id, count(*) as n from sets group by 1
), pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared_n from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from pairs p join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared_n >= 85 * (x.n + y.n - shared_n)
), edges as (
  select a, b from links union all select b, a from links
), reach(a, b) as (
  select doc_id, doc_id from documents union select r.a, e.b from reach r join edges e on r.b = e.a
), least_id as (
  select a, min(b) as component_id from reach group by 1
)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from documents d left join sizes using (doc_id) join least_id on a = d.doc_id
"""

VECTOR_SQL = r"""
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where embedding is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) as (
  select vec_id, vec_id from embeddings union select r.a, e.b from reach r join links e on r.b = e.a
), least_id as (
  select a, min(b) as component_id from reach group by 1
), degree as (
  select a, count(*) as n from links group by 1
)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join least_id on least_id.a = vec_id left join degree on degree.a = vec_id
"""


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from chronofold.llm.mixing import MIX_SQL

    return {"op2_embedding_dedup": VECTOR_SQL, "op5_jaccard_join": JACCARD_SQL, "op9_source_mixing": MIX_SQL}
