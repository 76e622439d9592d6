"""Quality classifier by co-training a text view and a metadata view.

Text view: naive Bayes over hashed byte 4-grams (mean log ratio) with text statistics. Metadata view:
naive Bayes over the source, language, length class and the web page that names the document (host,
top-level domain, path form, query). Each view is a logistic layer on these, fitted by Newton steps. In
each round either view labels all unlabelled documents that it is sure of, and both train on the union of
the other's labels and the given ones; labels are given anew each round. A view is sure where its logit
is beyond `SURE` and differs from its prior by as much, so a view that knows little passes no prior on.
The documents labelled so weigh together, by class, at most as much as the labelled rows: all count, and
scores do not drift as they get more. At the end each view is calibrated on held-out labels (Platt
scaling), and the mean of the calibrated logits scores every document.

Scale: labelled rows (`train_docs`) are a bounded sample by hash; their sparse counts go to the driver,
each at most `buckets` long. Unlabelled documents all take part: a round is one map over the texts, which
gives a small row per document and class counts per bucket, and Newton sums over the small rows. Texts
only move if more than `broadcast_ids` documents get a label; then they are dealt by id. Models are
`buckets` numbers.

Defined cases: null or empty text has statistics 0 and text logit from them; null metadata is a value of
its own; with one class of labels or none all scores are 0.5; repeated rows give a row each and train as
one document; rows without an id do not train.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm import quality_rules as rules
from chronofold.llm import textvec as tv
from chronofold.llm.frames import forget, keep

BUCKETS = 1 << 14
META_BUCKETS = 1 << 12
TRAIN_DOCS = 4000
ROUNDS = 5
SURE = 2.0
#: The weight of a text in the class counts, in whole numbers so that sums have no order.
UNIT = 1 << 20
BROADCAST_IDS = 1_000_000
N_STATS = 5
META = ("source", "lang", "size", "host", "top", "form", "query")


def _statistics(data, offsets) -> np.ndarray:
    s = rules.statistics(data, offsets)
    words = np.maximum(1, s["n_words"])
    chars = np.maximum(1, np.diff(offsets))
    upper = np.diff(np.r_[0, np.cumsum((data >= 65) & (data <= 90))][offsets])
    return np.c_[s["n_repeat_words"] / words, s["n_dup_lines"] / words, s["n_symbols"] / chars, upper / chars, np.log1p(s["n_words"]) / 10]


def _sample_rows(buckets: int):
    def run(batches):
        for batch, data, offsets in tv.blocks(batches, "text"):
            n = len(offsets) - 1
            bucket, inside = rules.grams(data, offsets, buckets)
            at = np.flatnonzero(inside)
            pair, count = np.unique((np.searchsorted(offsets, at, "right") - 1) * buckets + bucket[at], return_counts=True)
            ends = np.r_[0, np.cumsum(np.bincount(pair // buckets, minlength=n))].astype(np.int32)
            stats = _statistics(data, offsets)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pair % buckets, count)]
            dense = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * N_STATS), pa.array(stats.ravel()))
            names = batch.schema.names
            meta = batch.column(names.index("meta"))
            yield pa.RecordBatch.from_arrays([batch.column(names.index("id")), batch.column(names.index("quality")), meta, *lists, dense], ["id", "quality", "meta", "items", "counts", "stats"])

    return run


class View:
    """Naive Bayes over counts with a logistic layer over its mean log ratio and dense features, with the
    counts of the labelled rows."""

    def __init__(self, items, counts, dense, buckets: int, mean: bool):
        self.items, self.counts, self.dense, self.buckets, self.mean = items, counts, dense, buckets, mean
        self.layer, self.prior = np.zeros(2 + dense.shape[1]), 0.0

    def weigh(self, rows: np.ndarray, y: np.ndarray, more=0) -> None:
        """Log ratios from labelled rows and the class counts of other documents."""
        total = np.ones((2, self.buckets)) + more
        for i, c in zip(rows, y, strict=True):
            total[c, self.items[i]] += self.counts[i] / (max(1, self.counts[i].sum()) if self.mean else 1) * (100 if self.mean else 1)
        self.ratio = np.round((np.log(total[1] / total[1].sum()) - np.log(total[0] / total[0].sum())) * 65536).astype(np.int64)

    def fit(self, rows: np.ndarray, y: np.ndarray, others=None, more=(0.0, 0.0)) -> None:
        """The layer by Newton steps, halved where the loss does not fall; `others` gives the sums of
        other documents for a layer, `more` their weights by class."""
        x = self.features(rows)
        bad, good = np.bincount(y, minlength=2) + more
        self.prior = math.log(max(good, 1) / max(bad, 1))

        def at(w):
            loss, g, h = layer_sums(x, y, w)
            if others is not None:
                loss, g, h = (a + b for a, b in zip((loss, g, h), others(w), strict=True))
            return loss + 0.05 * w @ w, g + 0.1 * w, h + 0.1 * np.eye(len(w))

        w, (loss, g, h) = self.layer, at(self.layer)
        for _ in range(25):
            step = np.linalg.solve(h, g)
            if g @ step < 1e-6 * (1 + loss):
                break
            for _ in range(20):
                new = at(w - step)
                if new[0] <= loss:
                    break
                step = step / 2
            else:
                break
            w, (loss, g, h) = w - step, new
        self.layer = w

    def features(self, rows) -> np.ndarray:
        nb = np.array([(self.counts[i] * self.ratio[self.items[i]]).sum() / 65536 / (max(1, self.counts[i].sum()) if self.mean else 1) for i in rows])
        return np.c_[np.ones(len(rows)), nb, self.dense[rows]]

    def logit(self, rows) -> np.ndarray:
        return self.features(rows) @ self.layer


def layer_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, weight=1.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of a logistic layer over weighted rows."""
    z = np.clip(x @ w, -30, 30)
    p = 1 / (1 + np.exp(-z))
    return float((weight * (np.log1p(np.exp(z)) - y * z)).sum()), x.T @ (weight * (p - y)), (x * (weight * p * (1 - p))[:, None]).T @ x


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make logits z match labels y; slopes stay positive."""
    a, b = 1.0, 0.0
    if len(set(y.tolist())) < 2:
        return a, b
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        x = np.c_[z, np.ones(len(z))]
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - y) + 0.05 * np.array([a - 1, b]))
        a, b = a - step[0], b - step[1]
    return max(float(a), 1e-3), float(b)


def _column(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _text_features(batch) -> np.ndarray:
    nb = _column(batch, "nb").to_numpy()
    stats = _column(batch, "stats").flatten().to_numpy().reshape(-1, N_STATS)
    return np.c_[np.ones(len(nb)), nb, stats]


def _meta_features(batch, ratio: np.ndarray) -> np.ndarray:
    items, ends = _meta_items(_column(batch, "meta"), len(ratio))
    nb = np.diff(np.r_[0, np.cumsum(ratio[items])][ends]) / 65536
    return np.c_[np.ones(len(nb)), nb]


def _sure(z: np.ndarray, prior: float) -> np.ndarray:
    """1 or 0 where a logit is sure of a class, else -1."""
    return np.where(z > max(0, prior) + SURE, 1, np.where(z < min(0, prior) - SURE, 0, -1)).astype(np.int32)


def _mark_rows(model):
    """(id, label) of what the metadata view is sure of."""

    def run(batches):
        ratio, layer, prior = model.value
        for batch in batches:
            label = _sure(_meta_features(batch, ratio) @ layer, prior)
            yield pa.RecordBatch.from_arrays([_column(batch, "id"), pa.array(label)], ["id", "label"]).filter(pa.array(label >= 0))

    return run


def _label_rows(model):
    """The labels that either view gives to the other."""

    def run(batches):
        (layer, prior), (ratio, meta_layer, meta_prior) = model.value
        for batch in batches:
            to_meta, to_text = _sure(_text_features(batch) @ layer, prior), _sure(_meta_features(batch, ratio) @ meta_layer, meta_prior)
            yield pa.RecordBatch.from_arrays([*(_column(batch, c) for c in ("id", "meta", "stats")), pa.array(to_text), pa.array(to_meta)], ["id", "meta", "stats", "to_text", "to_meta"])

    return run


def _meta_count_rows(buckets: int):
    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            items, ends = _meta_items(_column(batch, "meta"), buckets)
            label = np.repeat(_column(batch, "to_meta").to_numpy(), np.diff(ends))
            for c in (0, 1):
                total[c] += np.bincount(items[label == c], minlength=buckets)
        yield _count_batch(total)

    return run


def _count_batch(total: np.ndarray):
    some = np.flatnonzero(total.any(axis=0))
    return pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[c, some]) for c in (0, 1))], ["bucket", "bad", "good"])


def _class_counts(rows: DataFrame, buckets: int, unit: int = 1) -> np.ndarray:
    got = rows.filter("bucket is not null").groupBy("bucket").agg(F.sum("bad"), F.sum("good")).toArrow()
    total = np.zeros((2, buckets))
    for c in (0, 1):
        total[c, got.column(0).to_numpy()] = got.column(c + 1).to_numpy() / unit
    return total


def _sum_rows(features, label: str, share: np.ndarray, layer: np.ndarray):
    """One row per task: loss, gradient and Hessian over its labelled rows, weighted by class."""

    def run(batches):
        n = len(layer)
        total = np.zeros(1 + n + n * n)
        for batch in batches:
            y = _column(batch, label).to_numpy()
            loss, g, h = layer_sums(features(batch)[y >= 0], y[y >= 0], layer, share[y[y >= 0]])
            total += np.r_[loss, g, h.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    return run


def _corpus_sums(views: DataFrame, features, label: str, share: np.ndarray):
    def at(layer):
        n = len(layer)
        got = views.mapInArrow(_sum_rows(features, label, share, layer), "sums array<double>").toArrow().column(0).to_pylist()
        total = np.array([math.fsum(x) for x in zip(*got, strict=True)]) if got else np.zeros(1 + n + n * n)
        return float(total[0]), total[1 : 1 + n], total[1 + n :].reshape(n, n)

    return at


def _text_rows(model):
    """A row for each text with its mean log ratio, its statistics if asked for, and after them the class
    counts of the task's labelled texts."""

    def run(batches):
        ratio, full = model.value
        n = len(ratio)
        total = np.zeros((2, n), np.int64)
        names = ["id", "source", "lang", "size", "nb", "stats", "bucket", "bad", "good"]
        for batch, data, offsets in tv.blocks(batches, "text"):
            bucket, inside = rules.grams(data, offsets, n)
            cut = np.minimum(offsets, len(bucket))
            number = np.diff(np.r_[0, np.cumsum(inside)][cut])
            nb = np.diff(np.r_[0, np.cumsum(np.where(inside, ratio[bucket], 0))][cut]) / 65536 / np.maximum(1, number)
            label = _column(batch, "label").to_numpy()
            for c in (0, 1):
                if (label == c).any():
                    weight = np.repeat(np.where(label == c, 100 * UNIT // np.maximum(1, number), 0), np.diff(cut))
                    some = inside & (weight > 0)
                    total[c] += np.bincount(bucket[some], weight[some], n).astype(np.int64)
            rows = batch.num_rows
            stats = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * N_STATS), pa.array(_statistics(data, offsets).ravel())) if full else pa.nulls(rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(_column(batch, c) for c in names[:4]), pa.array(nb), stats, *[pa.nulls(rows, pa.int64())] * 3], names)
        counts = _count_batch(total)
        k = counts.num_rows
        empty = [pa.nulls(k, t) for t in (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*empty, *counts.columns], names)

    return run


def read_texts(base: DataFrame, marks: DataFrame | None, ratio: np.ndarray, full: bool, broadcast_ids: int) -> DataFrame:
    """One map over all texts, kept: a row per text, and the class counts of those that marks label."""
    spark = base.sparkSession
    moved = marks is not None and marks.count() > broadcast_ids
    if marks is None:
        texts = base.withColumn("label", F.lit(-1))
    elif moved:
        # By id; texts without one are dealt by their content.
        salt = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))
        left = base.withColumns({"k": F.coalesce("id", F.lit(0)), "salt": salt, "null_id": F.col("id").isNull()})
        right = marks.select(F.col("id").alias("k"), F.lit(0).cast("long").alias("salt"), F.lit(False).alias("null_id"), "label")
        texts = left.join(right.hint("shuffle_hash"), ["k", "salt", "null_id"], "left")
    else:
        texts = base.join(F.broadcast(marks), "id", "left")
    sent = spark.sparkContext.broadcast((ratio, full))
    texts = texts.select("id", "source", "lang", "size", "text", F.coalesce("label", F.lit(-1)).alias("label"))
    return keep(texts.mapInArrow(_text_rows(sent), "id long, source string, lang string, size int, nb double, stats array<double>, bucket long, bad long, good long"), "texts")


def co_train(text: View, meta: View, labelled: np.ndarray, y: np.ndarray, base: DataFrame, unlabelled: DataFrame, rounds: int, broadcast_ids: int) -> DataFrame:
    """Exchange the sure labels of either view over rounds; returns the rows of the texts, with their
    statistics, under the last text model. `unlabelled` has (id, meta), each id once."""
    context, known = base.sparkSession.sparkContext, np.bincount(y, minlength=2)
    for v in (text, meta):
        v.weigh(labelled, y)
        v.fit(labelled, y)
    if rounds == 0:
        return read_texts(base, None, text.ratio, True, broadcast_ids)

    def marks() -> DataFrame:
        return keep(unlabelled.mapInArrow(_mark_rows(context.broadcast((meta.ratio, meta.layer, meta.prior))), "id long, label int"), "marks")

    def per_id(texts: DataFrame, *columns: str) -> DataFrame:
        return texts.filter("bucket is null and id is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in columns])

    label = marks()
    texts = read_texts(base, label, text.ratio, True, broadcast_ids)
    views = keep(unlabelled.join(per_id(texts, "nb", "stats"), "id"), "views")
    for r in range(1, rounds + 1):
        given = keep(views.mapInArrow(_label_rows(context.broadcast(((text.layer, text.prior), (meta.ratio, meta.layer, meta.prior)))), "id long, meta array<long>, stats array<double>, to_text int, to_meta int"), "given")
        n = given.agg(*[F.count(F.when(F.col(to) == c, 1)) for to in ("to_text", "to_meta") for c in (0, 1)]).first()
        to_text, to_meta = (np.array(x, float) for x in (n[:2], n[2:]))
        share_text, share_meta = (np.minimum(1, known / np.maximum(1, x)) for x in (to_text, to_meta))
        text.weigh(labelled, y, share_text[:, None] * _class_counts(texts, text.buckets, UNIT))
        meta.weigh(labelled, y, share_meta[:, None] * _class_counts(given.mapInArrow(_meta_count_rows(meta.buckets), "bucket long, bad long, good long"), meta.buckets))
        ratio = meta.ratio
        meta.fit(labelled, y, _corpus_sums(given, lambda b, ratio=ratio: _meta_features(b, ratio), "to_meta", share_meta), share_meta * to_meta)
        for old in (label, texts, views):
            forget(old)
        # The counts of the next round come with this pass.
        label = marks() if r < rounds else None
        texts = read_texts(base, label, text.ratio, r == rounds, broadcast_ids)
        views = keep(given.join(per_id(texts, "nb"), "id"), "views")
        forget(given)
        text.fit(labelled, y, _corpus_sums(views, _text_features, "to_text", share_text), share_text * to_text)
    forget(views)
    return texts


def _score_rows(model):
    def run(batches):
        layer, (a, b) = model.value["text"]
        for batch in batches:
            z = _text_features(batch) @ layer
            yield pa.RecordBatch.from_arrays([*(_column(batch, c) for c in ("id", "source", "lang", "size")), pa.array(a * z + b)], ["id", "source", "lang", "size", "text_logit"])

    return run


def _meta_rows(model):
    def run(batches):
        ratio, layer, (a, b) = model.value["meta"]
        for batch in batches:
            z = _meta_features(batch, ratio) @ layer
            yield pa.RecordBatch.from_arrays([_column(batch, "id"), _column(batch, "text_logit"), pa.array(a * z + b)], ["id", "text_logit", "meta_logit"])

    return run


def _meta_items(column, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed metadata tokens of each row and their offsets."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False) % buckets, ends - ends[0]


def page_metadata(pages: DataFrame) -> DataFrame:
    """(page_doc, host, top, form, query): the page whose path ends in a document's id, the first by
    URL if there are several."""
    url = pages.select("url").filter("url is not null")
    part = lambda p: F.regexp_extract("url", p, 1)
    doc = F.expr("try_cast(nullif(regexp_extract(url, '^[a-z]+://[^/]+/[a-z-]+/([0-9]+)', 1), '') as bigint)")
    url = url.select(doc.alias("page_doc"), "url").filter("page_doc is not null").groupBy("page_doc").agg(F.min("url").alias("url"))
    return url.select("page_doc", part(r"^[a-z]+://([^/]+)").alias("host"), part(r"\.([a-z]+)(?:[/:]|$)").alias("top"), part(r"[0-9]+(/|\.[a-z]+)?(?:[?#]|$)").alias("form"), part(r"[?#]([a-z_]+)").alias("query"))


def _meta_tokens():
    return F.array(*[F.xxhash64(F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("none"))).bitwiseAND(F.lit((1 << 60) - 1)) for c in META])


def score(docs: DataFrame, labels: DataFrame, pages: DataFrame, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS, threshold: float = 0.5, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row per document: doc_id, text_score, meta_score, score, kept."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    base = base.withColumn("size", F.length(F.bin(F.coalesce(F.length("text"), F.lit(0)).cast("long"))))
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("quality"))
    by_hash = lambda df, n: df.withColumn("draw", F.xxhash64(F.lit("draw"), "id")).orderBy("draw", "id").limit(n).drop("draw")
    chosen = F.broadcast(by_hash(known, train_docs))
    page = page_metadata(pages)
    # At most train_docs documents: the texts of these alone, then their pages.
    sample = base.join(chosen, "id").join(page, F.col("id") == F.col("page_doc"), "left").select("id", "quality", "text", _meta_tokens().alias("meta"))
    rows = sample.mapInArrow(_sample_rows(BUCKETS), "id long, quality int, meta array<long>, items array<int>, counts array<int>, stats array<double>").toArrow().sort_by("id")
    quality = rows.column("quality").to_numpy()
    if not ((quality == 0).any() and (quality == 1).any()):
        half = F.lit(0.5)
        return base.select(F.col("id").alias("doc_id"), half.alias("text_score"), half.alias("meta_score"), half.alias("score"), F.lit(True).alias("kept"))
    stats = np.array(rows.column("stats").to_pylist())
    text = View([x.values.to_numpy() for x in rows.column("items")], [x.values.to_numpy() for x in rows.column("counts")], stats, BUCKETS, True)
    tokens, ends = _meta_items(rows.column("meta"), META_BUCKETS)
    tokens = [tokens[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    meta = View(tokens, [np.ones(len(t)) for t in tokens], np.zeros((len(tokens), 0)), META_BUCKETS, False)
    labelled = np.flatnonzero(quality >= 0)
    held = labelled[np.arange(len(labelled)) % 5 == 0]
    train = np.setdiff1d(labelled, held)
    if len(set(quality[train].tolist())) < 2:
        train = labelled
    one = base.filter("id is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in ("source", "lang", "size")]).join(known, "id", "left_anti")
    unlabelled = keep(one.join(page, F.col("id") == F.col("page_doc"), "left").select("id", _meta_tokens().alias("meta")), "unlabelled")
    texts = co_train(text, meta, train, quality[train], base, unlabelled, rounds, broadcast_ids)
    forget(unlabelled)
    model = {"text": (text.layer, platt(text.logit(held), quality[held])), "meta": (meta.ratio, meta.layer, platt(meta.logit(held), quality[held]))}
    sent = spark.sparkContext.broadcast(model)
    out = texts.filter("bucket is null").mapInArrow(_score_rows(sent), "id long, source string, lang string, size int, text_logit double")
    out = out.join(page, F.col("id") == F.col("page_doc"), "left").select("id", "text_logit", _meta_tokens().alias("meta"))
    out = out.mapInArrow(_meta_rows(sent), "id long, text_logit double, meta_logit double")
    chance = lambda z: 1 / (1 + F.exp(-z))
    both = chance((F.col("text_logit") + F.col("meta_logit")) / 2)
    return out.select(F.col("id").alias("doc_id"), chance(F.col("text_logit")).alias("text_score"), chance(F.col("meta_logit")).alias("meta_score"), both.alias("score"), (both >= threshold).alias("kept"))
