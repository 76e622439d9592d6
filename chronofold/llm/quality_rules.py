"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte 4-grams are counted: one over every document (raw corpus), one over
the documents that labels call good (trusted target). A document's score is the mean over its n-grams
of log p_target - log p_raw; it passes if the score is at least `threshold`. Scores are sums of
integers (log ratios in 1/65536), so they do not depend on order or partitioning.

Scale: counts are summed per task and shuffled as one row for each task and used bucket; the model is
`buckets` numbers, whatever the corpus. The trusted target takes all good labelled documents, however many:
texts are dealt by id to meet their label, those without an id by content, so labels are never broadcast.

Defined cases: null or empty text has all counts 0, fails the base rules and scores 0; without good
labels the verdict passes everything that the base rules pass; repeated rows give a row each; a score equal
to the threshold passes; a text of any length is judged whole, alone in its block; an empty table gives no
rows; other columns are ignored by `judge` and kept by `filter_kept`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm import textvec as tv

U = tv.U
BUCKETS = 1 << 16
GRAM = 4
SHRINK = 10.0
THRESHOLD = -0.3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the byte 4-gram at each position, and which positions lie whole in their text."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    x = data.astype(np.uint32)
    h = x[:n] | x[1 : n + 1] << np.uint32(8) | x[2 : n + 2] << np.uint32(16) | x[3 : n + 3] << np.uint32(24)
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    inside = np.arange(n) + GRAM <= row_end[:n]
    return (h >> np.uint32(16)).astype(np.int64) % buckets, inside


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row. Words and lines are compared
    as they are, windows of words by numbers of their words."""
    n = len(offsets) - 1
    starts, _, row = tv.word_spans(data, offsets)
    per_row = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][offsets])
    word = tv.codes(tv.segments(data, ~tv.SEPARATOR[data], starts))
    m = max(0, len(word) - 4)
    two = tv.pair_codes(word[:-1], word[1:]) if m else word
    window = tv.pair_codes(tv.pair_codes(two[:m], two[2 : m + 2]), word[4 : m + 4]) if m else word[:0]
    inside = np.flatnonzero(row[:m] == row[4 : 4 + m])
    cover = np.zeros(len(word) + 5, np.int32)
    if len(inside):
        order, twice = _repeats(row[inside], window[inside])
        at = inside[order[twice]]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + 5, -1)
    covered = np.cumsum(cover)[: len(word)] > 0
    newline = np.flatnonzero(data == 10)
    line = np.unique(np.r_[offsets[:-1], newline + 1])
    line = line[line < len(data)]
    stop = np.r_[line[1:], len(data)] if len(line) else line
    with_words = np.searchsorted(starts, stop) > np.searchsorted(starts, line)
    dup = np.zeros(n, np.int64)
    if with_words.any():
        key = tv.codes(tv.segments(data, data != 10, line))[with_words]
        line_row = np.searchsorted(offsets, line[with_words], "right") - 1
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(line_row[order], kind="stable")]
        same = np.r_[False, (key[order][1:] == key[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])]
        dup = np.bincount(line_row[order][same], minlength=n)
    return {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": per_row(~tv.SEPARATOR[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": per_row(SYMBOLS[data]),
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(row[covered], minlength=n),
    }


def _repeats(row, key):
    """An order of the items by (row, key), and which of them in it have an equal neighbour."""
    order = np.argsort(key)
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    same = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    return order, np.r_[False, same] | np.r_[same, False]


def _count_rows(buckets: int):
    def run(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch, data, offsets in tv.blocks(batches, "text"):
            bucket, inside = grams(data, offsets, buckets)
            raw += np.bincount(bucket[inside], minlength=buckets)
            good = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(bool), np.diff(offsets))[: len(bucket)]
            target += np.bincount(bucket[inside & good], minlength=buckets)
        some = np.flatnonzero(raw)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", buckets: int = BUCKETS) -> np.ndarray:
    """Log ratios of the two multinomials, shrunk to 0 for rare buckets, in 1/65536."""
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("k")).filter("k is not null").distinct()
    right = good.select("k", F.lit(0).cast("long").alias("salt"), F.lit(False).alias("null_id"), F.lit(True).alias("good"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    salt = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))
    texts = texts.select(F.coalesce("id", F.lit(0)).alias("k"), salt.alias("salt"), F.col("id").isNull().alias("null_id"), "text")
    texts = texts.join(right.hint("shuffle_hash"), ["k", "salt", "null_id"], "left")
    counts = texts.select(F.coalesce("good", F.lit(False)).alias("good"), "text").mapInArrow(_count_rows(buckets), "bucket long, raw long, target long")
    counts = counts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).toArrow()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    target[counts.column(0).to_numpy()] = counts.column(2).to_numpy()
    if not target.sum():
        return np.zeros(buckets, np.int64)
    # Counts expected if target were like raw; both sides shrink by SHRINK, so rare buckets say little.
    expected = raw * (target.sum() / raw.sum())
    ratio = np.log((target + SHRINK) / (expected + SHRINK))
    return np.round(ratio * 65536).astype(np.int64)


def _score_rows(model, threshold: float):
    def run(batches):
        ratio = model.value
        for batch, data, offsets in tv.blocks(batches, "text"):
            s = statistics(data, offsets)
            bucket, inside = grams(data, offsets, len(ratio))
            total = np.zeros(len(data) + 1, np.int64)
            number = np.zeros(len(data) + 1, np.int64)
            np.cumsum(np.where(inside, ratio[bucket], 0), out=total[1 : len(bucket) + 1])
            np.cumsum(inside, out=number[1 : len(bucket) + 1])
            total[len(bucket) + 1 :], number[len(bucket) + 1 :] = total[len(bucket)], number[len(bucket)]
            score = np.diff(total[offsets]) / 65536 / np.maximum(1, np.diff(number[offsets]))
            failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(np.int64)) for x in s.values()), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)], ["key", *s, "base_failed", "kept", "score"])

    return run


def judge(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: id, statistics, base_failed, kept and score."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, buckets))
    out = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).mapInArrow(
        _score_rows(model, threshold),
        "key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double",
    )
    return out.withColumnRenamed("key", id_col)


def _filter_rows(model, threshold: float):
    def run(batches):
        score = _score_rows(model, threshold)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            pair = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(at)], ["key", "text"])
            kept = pa.concat_arrays([b.column(b.schema.get_field_index("kept")) for b in score([pair])]) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.filter(kept)

    return run


def filter_kept(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The rows of docs that judge() keeps, without a join: texts do not move."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, buckets))
    named = docs.withColumnRenamed(text_col, "text") if text_col != "text" else docs
    out = named.mapInArrow(_filter_rows(model, threshold), named.schema)
    return out.withColumnRenamed("text", text_col) if text_col != "text" else out
