"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its hashed byte 2-, 3- and 4-grams (A-Z lower-cased, ASCII
signs other than letters as blanks); a linear layer and softmax give the language. Embeddings and layer
are trained together in numpy by stochastic gradient descent, on a bounded sample of labelled rows
(`per_lang` of each language and `train_docs` in all but two of each language at least, those with the smallest
hashes, drawn from the rows that `learn` allows); every language that has a row is learned. A fifth of the sample is held back to calibrate: a temperature for the scores, and
the score under which a prediction is marked as not accepted.

Scoring is one map over whole texts: as the layer is linear, each bucket has one logit per language, and
a text's logits are sums of integers (logits in 1/2**20), the same for any partitioning.

Defined cases: null text or text without a letter is `und` with score 0; null labels and null texts are
not learned from; without anything to learn from all is `und`; repeated rows give a row each; ties go to the
first language in order; texts of any length are read whole; an empty table gives no rows; other columns do not
matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm import textvec as tv

BUCKETS = 1 << 15
DIM = 16
ORDERS = (2, 3, 4)
PER_LANG = 400
TRAIN_DOCS = 4000
FOLD = np.full(256, 32, np.uint8)
FOLD[128:] = np.arange(128, 256)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)


def grams(data: np.ndarray, offsets: np.ndarray, buckets: int):
    """For each order: the bucket at each position and which positions lie whole in their text."""
    x = FOLD[data].astype(np.uint32)
    stop = np.repeat(offsets[1:], np.diff(offsets))
    for n in ORDERS:
        m = len(x) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ x[i : i + m]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        yield (h >> np.uint32(8)).astype(np.int64) % buckets, np.arange(m) + n <= stop[:m]


def _feature_rows(buckets: int):
    def run(batches):
        for batch, data, offsets in tv.blocks(batches, "text"):
            n = len(offsets) - 1
            rows, items = [], []
            for bucket, inside in grams(data, offsets, buckets):
                at = np.flatnonzero(inside)
                rows.append(np.searchsorted(offsets, at, "right") - 1)
                items.append(bucket[at])
            row, item = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, items))
            pair, count = np.unique(row * buckets + item, return_counts=True)
            row = pair // buckets
            total = np.bincount(row, count, minlength=n)
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=n))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array((pair % buckets).astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array((count / np.maximum(total[row], 1)).astype(np.float32)))],
                ["lang", "items", "weights"],
            )

    return run


def train(langs, items, weights, buckets: int = BUCKETS, dim: int = DIM, epochs: int = 12, rate: float = 0.5, seed: int = 1):
    """Embeddings, layer and bias by gradient descent over single texts in seeded random order."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    # A step moves a text's average by the same share whatever its length.
    gain = [min(1000.0, 1 / float((x**2).sum())) for x in weights]
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    w, b = np.zeros((dim, len(names))), np.zeros(len(names))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(y)):
            x = weights[i] @ e[items[i]]
            z = x @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = w @ p
            w -= step * np.outer(x, p)
            b -= 0.05 * step * p
            e[items[i]] -= step * np.outer(weights[i] * gain[i], back)
    return names, e @ w, b


def calibrate(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The temperature with the smallest log loss, and the score that 99 of 100 right answers reach."""
    if not len(y):
        return 1.0, 0.0
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 60):
        z = logits / t
        z = z - z.max(axis=1)[:, None]
        loss = -(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1))).mean()
        best = min(best, (loss, t))
    z = logits / best[1]
    p = np.exp(z - z.max(axis=1)[:, None])
    p = (p / p.sum(axis=1)[:, None]).max(axis=1)
    right = p[logits.argmax(axis=1) == y]
    return float(best[1]), float(np.quantile(right, 0.01)) if len(right) else 0.0


def fit(docs: DataFrame, per_lang: int = PER_LANG, train_docs: int = TRAIN_DOCS, buckets: int = BUCKETS):
    """A model from the rows (id, text, lang): (names, logits by bucket, bias, temperature, floor)."""
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    each = max(2, min(per_lang, train_docs // len(counts)))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (each + 5 * each**0.5 + 10) / n))])
    draw = F.xxhash64(F.lit("sample"), "id").bitwiseAND(F.lit((1 << 40) - 1))
    sample = docs.withColumn("draw", draw).filter(F.col("lang").isin(list(counts)) & (F.col("draw") < share[F.col("lang")] * float(1 << 40)))
    sample = sample.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))).filter(F.col("rank") <= each)
    rows = sample.select(F.concat_ws("\t", F.lpad("rank", 9, "0"), "lang").alias("lang"), "text").mapInArrow(_feature_rows(buckets), "lang string, items array<int>, weights array<float>").toArrow().sort_by("lang")
    tags = [x.split("\t", 1) for x in rows.column("lang").to_pylist()]
    items = [x.values.to_numpy() for x in rows.column("items")]
    weights = [x.values.to_numpy().astype(np.float64) for x in rows.column("weights")]
    held = [int(rank) % 5 == 0 and len(items[i]) > 0 for i, (rank, _) in enumerate(tags)]
    use = [i for i, h in enumerate(held) if not h and len(items[i])]
    if not use:
        return None
    names, logits, bias = train([tags[i][1] for i in use], [items[i] for i in use], [weights[i] for i in use], buckets)
    check = [i for i, h in enumerate(held) if h and tags[i][1] in names]
    z = np.array([weights[i] @ logits[items[i]] + bias for i in check]).reshape(len(check), len(names))
    t, floor = calibrate(z, np.array([names.index(tags[i][1]) for i in check], int))
    return names, np.round(logits * (1 << 20)).astype(np.int64), bias, t, floor


def _predict_rows(model):
    def run(batches):
        names, logits, bias, t, floor = model.value
        for batch, data, offsets in tv.blocks(batches, "text"):
            n = len(offsets) - 1
            total, number = np.zeros((n, len(names)), np.int64), np.zeros(n, np.int64)
            for bucket, inside in grams(data, offsets, len(logits)):
                cut = np.minimum(offsets, len(bucket))
                number += np.diff(np.r_[0, np.cumsum(inside)][cut])
                for k in range(len(names)):
                    total[:, k] += np.diff(np.r_[0, np.cumsum(np.where(inside, logits[bucket, k], 0))][cut])
            z = (total / (1 << 20) / np.maximum(1, number)[:, None] + bias) / t
            p = np.exp(z - z.max(axis=1)[:, None])
            p /= p.sum(axis=1)[:, None]
            best = p.argmax(axis=1)
            letter = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            score = np.where(letter, p[np.arange(n), best], 0.0)
            pred = [names[i] if ok else "und" for i, ok in zip(best.tolist(), letter.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(letter & (score >= floor))], ["key", "lang_pred", "score", "accepted"])

    return run


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score, accepted."""
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).select("key", "text", letter)
    if model is None:
        return texts.select(F.col("key").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return texts.mapInArrow(_predict_rows(sent), "key long, lang_pred string, score double, accepted boolean").withColumnRenamed("key", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Learn from the rows whose crc32(id) mod 3 is not 1 and predict all: id, held_out, lang_pred,
    score, accepted."""
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % 3
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.filter("lang is not null and text is not null and id is not null").filter(fold != 1)
    out = predict(docs, fit(known, per_lang, train_docs), id_col, text_col)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select(id_col, held.alias("held_out"), "lang_pred", "score", "accepted")
