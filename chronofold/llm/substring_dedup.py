"""Removal of repeated byte strings by prefix-free parsing.

Every byte that a string of `length` bytes covers which also starts anywhere else (same document
included) is removed. Rolling-hash triggers cut the corpus into phrases: a position is a trigger if its
16-byte rolling hash is the smallest (rightmost on ties) of some window of length - 15 positions, so each
string of `length` bytes holds a trigger that its own bytes determine. A suffix of the corpus is then the
suffix of a phrase (from its start to the next trigger) followed by a suffix of the parse (from the trigger
on), and two equal strings meet at like triggers, so the corpus order is built trigger by trigger:

1. Triggers whose half context, `length`/2 bytes forward or backward, occurs nowhere else drop out: what
   is left is the repetitive text that the method is made for.
2. The rest are dealt by the content of their trigger. The phrases that end there are sorted from their ends,
   which orders the suffixes of the dictionary, the parse suffixes by their first `length` bytes; LCPs between
   neighbours give, for each distance to the trigger, the class of the phrase suffix and of the parse suffix.
   A start repeats if another has both: the two then lie side by side in corpus order with an LCP of `length`
   or more. Like contexts are one entry of the dictionary. All this compares bytes, not hashes.
3. A trigger found in more than `MEMBERS` places does not go to one task: ranges of its starts are grouped by
   hashes instead, coarse to fine (`length`/8 starts, a seventh of these, single starts): settled whole if the
   string that spans a range occurs elsewhere, dropped if the core that its strings share does not.

Scale: step 1 is one row for about 100 bytes of text, step 2 about 800 bytes for each repeated trigger; groups
are streamed, several thousand members at a time. Equal texts are one class; if it has two members all its
strings repeat. Counts of step 3 are minimum and maximum of places (partial aggregates), and the joins back are
on unique keys, so hot passages can be split. Lists of places and spans of a text are shorter than the text.
At the end every text moves once, to the runs that it loses.

Defined cases: null text is empty: 0 bytes, nothing removed; texts shorter than `length` lose nothing; texts of
any length are whole; repeated rows are documents of their own, so their texts repeat; null ids keep their rows;
an empty table gives no rows; other columns do not matter, whatever their names. Hashes of strings in step 3
are two of 61 bits under bases drawn for each run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm import textvec as tv
from chronofold.llm.frames import forget, keep

U = tv.U
K = 16
BROADCAST_IDS = 1_000_000
#: Contexts of one trigger that a task takes together.
MEMBERS = 16_384
#: Bytes of text that are cut into ranges or starts at once.
FINE = 1 << 18
NO_ID = -(1 << 63)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by running minima from both ends of blocks of w."""
    n = len(x) - w + 1
    pad = -len(x) % w
    full = np.r_[x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)].reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def rolling(data: np.ndarray) -> np.ndarray:
    """The polynomial hash modulo 2**64 of the K bytes at each position. It chooses triggers only: equal bytes
    have equal hashes, and nothing depends on the reverse."""
    h, n, base = data.astype(U) + U(1), 1, tv.BASE
    while n < K:
        h = h[:-n] * U(base) + h[n:]
        n, base = 2 * n, base * base & 0xFFFFFFFFFFFFFFFF
    return tv.mix(h)


def triggers(data, offsets, length: int):
    """Runs of starts with one trigger: (row, trigger, first start, last start, the trigger's hash)."""
    w = length - K + 1
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty
    h = rolling(data)
    low = window_min((h & U(0xFFFFFFFF00000000)) | (U(0xFFFFFFFF) - np.arange(len(h)).astype(U)), w)
    trigger = (U(0xFFFFFFFF) - (low & U(0xFFFFFFFF))).astype(np.int64)
    stop = np.repeat(offsets[1:], np.diff(offsets))
    start = np.flatnonzero(np.arange(len(trigger)) + length <= stop[: len(trigger)])
    if not len(start):
        return empty, empty, empty, empty, empty
    q = trigger[start]
    row = np.searchsorted(offsets, start, "right") - 1
    new = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (row[1:] != row[:-1])])
    return row[new], q[new], start[new], start[np.r_[new[1:], len(start)] - 1], h[q[new]].view(np.int64)


def _half_rows(length: int, base: int):
    half = length // 2

    def run(batches):
        powers = tv.Powers(base)
        for batch, data, offsets in tv.blocks(batches, "text"):
            cls = batch.column(0).to_numpy()
            prefix = powers.prefix(data)
            row, q, first, last, tau = triggers(data, offsets, length)
            new = np.zeros(len(cls), bool)
            new[np.unique(cls, return_index=True)[1]] = True
            own = new[row]
            row, q, first, last, tau = row[own], q[own], first[own], last[own], tau[own]
            ahead, back = last >= q - half, first <= q - half
            keys = np.r_[tv.mix(powers.spans(prefix, q[ahead], q[ahead] + half)), tv.mix(powers.spans(prefix, q[back] - half, q[back]) ^ U(0x5851F42D4C957F2D))]
            row, q, tau = (np.r_[x[ahead], x[back]] for x in (row, q, tau))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(cls[row]), pa.array(q - offsets[row]), pa.array(tau)], ["key", "cls", "q", "tau"])

    return run


CONTEXT = "tau long, cls long, q long, lo long, hi long, back binary, ahead binary"


def _pieces(data, starts, ends) -> pa.Array:
    size = ends - starts
    at = np.r_[0, np.cumsum(size)]
    flat = data[np.arange(at[-1]) + np.repeat(starts - at[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat.tobytes())])


def _context_rows(length: int):
    """Texts with their repeated triggers to the phrase before each and the text after it, as far as its starts
    reach: (trigger's hash, class, place, first and last start, bytes before, bytes from the trigger on)."""

    def run(batches):
        for batch, data, offsets in tv.blocks(batches, "text"):
            row, q, first, last, tau = triggers(data, offsets, length)
            own = np.isin(q, _places(batch.column(2), offsets))
            row, q, first, last, tau = row[own], q[own], first[own], last[own], tau[own]
            cls = batch.column(0).to_numpy()
            for at in range(0, len(q), 4096):
                s = slice(at, at + 4096)
                base = offsets[row[s]]
                arrays = [pa.array(tau[s]), pa.array(cls[row[s]]), *(pa.array(x[s] - base) for x in (q, first, last))]
                yield pa.RecordBatch.from_arrays([*arrays, _pieces(data, first[s], q[s]), _pieces(data, q[s], last[s] + length)], ["tau", "cls", "q", "lo", "hi", "back", "ahead"])

    return run


def _matrix(column, width: int, backwards: bool) -> np.ndarray:
    """The values as rows of bytes, filled up with zeros; backwards from their ends."""
    data, offsets = tv.text_buffers(column)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(data)) - offsets[row]
    out = np.zeros((len(size), width), np.uint8)
    out[row, size[row] - 1 - place if backwards else place] = data
    return out


def _order(group: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by group and bytes, and the LCP of each with the one before; -1 in a new group."""
    order = np.argsort(np.ascontiguousarray(matrix).view(f"S{matrix.shape[1]}").ravel(), kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    sorted_rows, g = matrix[order], group[order]
    differ = sorted_rows[1:] != sorted_rows[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
    return order, np.r_[-1, np.where(g[1:] != g[:-1], -1, lcp)]


def _classes(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    """The class of each row by its first `depth` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < depth)
    return out


def repeated_starts(tau, low, high, back: np.ndarray, ahead: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of distances a to the trigger, low <= a <= high, at which the string of `length` bytes, the last a
    of `back` (backwards) and the first length - a of `ahead`, is that of another row: (row, from, to)."""
    back_order, back_lcp = _order(tau, back)
    ahead_order, ahead_lcp = _order(tau, ahead)
    whole = np.c_[_classes(back_order, back_lcp, back.shape[1]), _classes(ahead_order, ahead_lcp, ahead.shape[1]), low, high]
    _, first, entry, copies = np.unique(whole, axis=0, return_index=True, return_inverse=True, return_counts=True)
    entry = entry.ravel()
    n = len(first)
    found = np.zeros((n, int(high.max()) + 2), bool)
    lone = copies < 2
    low, high = low[first], high[first]
    for a in range(int(low.min()), int(high.max()) + 1):
        some = np.flatnonzero((low <= a) & (a <= high))
        key = _classes(back_order, back_lcp, a)[first[some]] * (len(tau) + 1) + _classes(ahead_order, ahead_lcp, length - a)[first[some]]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.empty(len(some), bool)
        twice[order] = np.r_[False, same] | np.r_[same, False]
        found[some, a] = twice | ~lone[some]
    edge = np.diff(np.c_[np.zeros(n, np.int8), found.astype(np.int8)], axis=1)
    row, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1] - 1
    # Back from entries to all rows that have them.
    runs = np.bincount(row, minlength=n)
    ends = np.cumsum(runs)
    per = runs[entry]
    at = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + np.repeat((ends - runs)[entry], per)
    return np.repeat(np.arange(len(entry)), per), start[at], stop[at]


def _match_rows(length: int, members: int):
    """Contexts sorted by trigger to the repeated starts, as ranges (cls, lo, hi)."""

    def match(t: pa.Table):
        tau, cls, q, lo, hi = (t.column(i).to_numpy() for i in range(5))
        back = _matrix(t.column(5), max(1, int((q - lo).max())), True)
        ahead = _matrix(t.column(6), int((hi + length - q).max()), False)
        row, start, stop = repeated_starts(tau, q - hi, q - lo, back, ahead, length)
        return pa.RecordBatch.from_arrays([pa.array(cls[row]), pa.array(q[row] - stop), pa.array(q[row] - start)], ["cls", "lo", "hi"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if len(held) < members:
                continue
            tau = held.column(0).to_numpy()
            last = int(np.flatnonzero(np.r_[True, tau[1:] != tau[:-1]])[-1])
            if last:
                yield match(held.slice(0, last))
                held = held.slice(last)
        if held is not None and len(held):
            yield match(held)

    return run


ROWS = "cls long, q long, a long, lo long, hi long, known boolean, core long, w1 long, w2 long"


def _cut(data, offsets, powers, row, q, a, width, first, last, cls, known, length: int) -> pa.RecordBatch:
    """Rows of ranges of starts q - a - width + 1 .. q - a, as far as first .. last allow: the hash of what
    their strings share and, of full ranges, two hashes of what their strings span."""
    prefixes = [p.prefix(data) for p in powers]
    top, low = q - a, q - a - width + 1
    tag = a.astype(U)
    core = tv.mix(powers[0].spans(prefixes[0], top, low + length) + tag)
    full = (low >= first) & (top <= last)
    b, e = np.where(full, low, 0), np.where(full, top + length, 0)
    whole = [tv.mix(p.spans(x, b, e) + tag).view(np.int64) for p, x in zip(powers, prefixes, strict=True)]
    at = offsets[row]
    arrays = [pa.array(cls[row]), pa.array(q - at), pa.array(a), pa.array(np.maximum(low, first) - at), pa.array(np.minimum(top, last) - at), pa.array(known), pa.array(core.view(np.int64)), *(pa.array(x, mask=~full) for x in whole)]
    return pa.RecordBatch.from_arrays(arrays, ["cls", "q", "a", "lo", "hi", "known", "core", "w1", "w2"])


def _range_rows(length: int, width: int, bases):
    """Texts with their repeated triggers to ranges of `width` starts."""

    def run(batches):
        powers = list(map(tv.Powers, bases))
        for batch, data, offsets in tv.blocks(batches, "text", FINE):
            row, q, first, last, _ = triggers(data, offsets, length)
            own = np.isin(q, _places(batch.column(2), offsets))
            row, q, first, last = row[own], q[own], first[own], last[own]
            part = (q - last) // width
            n = (q - first) // width - part + 1
            i = np.repeat(np.arange(len(q)), n)
            a = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + part[i]) * width
            yield _cut(data, offsets, powers, row[i], q[i], a, np.full(len(i), width), first[i], last[i], batch.column(0).to_numpy(), np.zeros(len(i), bool), length)

    return run


def _narrow_rows(length: int, width: int, sub: int, bases):
    """Texts with open ranges (q, a, lo, hi, settled) of `width` starts to ranges of `sub` starts."""

    def run(batches):
        powers = list(map(tv.Powers, bases))
        for batch, data, offsets in tv.blocks(batches, "text", FINE):
            row, q, a, lo, hi, known = _spans(batch.column(2), offsets, ("q", "lo", "hi"), "a")
            pieces = -(-width // sub)
            i = np.repeat(np.arange(len(q)), pieces)
            j = np.tile(np.arange(pieces), len(q)) * sub
            size = np.minimum(sub, width - j)
            a = a[i] + j
            some = (q[i] - a >= lo[i]) & (q[i] - a - size + 1 <= hi[i])
            i, a, size = i[some], a[some], size[some]
            yield _cut(data, offsets, powers, row[i], q[i], a, size, lo[i], hi[i], batch.column(0).to_numpy(), known[i], length)

    return run


def _spans(column, offsets, placed: tuple[str, ...], plain: str | None):
    """Lists of structs to arrays: row, q, a, lo, hi, settled; places become places in the block."""
    flat = column.flatten()
    per = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(per)), per)
    q, lo, hi = (flat.field(f).to_numpy() + offsets[row] for f in placed)
    return row, q, flat.field(plain).to_numpy(), lo, hi, flat.field("settled").to_numpy(zero_copy_only=False).astype(bool)


def _places(column, offsets) -> np.ndarray:
    """Lists of places in texts to places in the block."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False) + np.repeat(offsets[:-1], np.diff(column.offsets.to_numpy()))


def _start_rows(length: int, bases):
    """Texts with their open ranges to single starts: (cls, p, settled, w1, w2)."""

    def run(batches):
        powers = list(map(tv.Powers, bases))
        for batch, data, offsets in tv.blocks(batches, "text", FINE):
            row, _, _, lo, hi, settled = _spans(batch.column(2), offsets, ("q", "lo", "hi"), "a")
            n = hi - lo + 1
            i = np.repeat(np.arange(len(lo)), n)
            p = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[i]
            prefixes = [w.prefix(data) for w in powers]
            cls = batch.column(0).to_numpy()
            for at in range(0, len(p), 100_000):
                j, s = i[at : at + 100_000], p[at : at + 100_000]
                hashes = [tv.mix(w.spans(x, s, s + length)).view(np.int64) for w, x in zip(powers, prefixes, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cls[row[j]]), pa.array(s - offsets[row[j]]), pa.array(settled[j]), *map(pa.array, hashes)], ["cls", "p", "settled", "w1", "w2"])

    return run


def _run_rows(length: int):
    """Repeated starts (lo, hi) of each text to its removed runs: what the strings there cover, in order and apart."""

    def run(batches):
        for batch in batches:
            spans = batch.column(1)
            flat, per = spans.flatten(), np.diff(spans.offsets.to_numpy())
            lo, hi = (flat.field(i).to_numpy() for i in (0, 1))
            if not len(lo):
                continue
            row = np.repeat(np.arange(len(per)), per)
            apart = int(hi.max()) + length + 1
            start, stop = lo + row * apart, hi + length + row * apart
            order = np.argsort(start, kind="stable")
            start, reach = start[order], np.maximum.accumulate(stop[order])
            new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
            row, start, stop = row[order][new], start[new], reach[np.r_[new[1:], len(start)] - 1]
            runs = pa.StructArray.from_arrays([pa.array(start - row * apart), pa.array(stop - row * apart)], ["start", "stop"])
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(per)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), runs)], ["cls", "spans"])

    return run


RUNS = "array<struct<start: bigint, stop: bigint>>"


def _kept_rows(batches):
    """Texts with their removed runs to the bytes that are left."""
    for batch, data, offsets in tv.blocks(batches, "text"):
        spans = batch.column(2)
        flat, row = spans.flatten(), np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
        gone = np.zeros(len(data) + 1, np.int8)
        start, stop = (flat.field(i).to_numpy() + offsets[row] for i in (0, 1))
        # A run may end where the next text's begins.
        gone[start] += 1
        gone[stop] -= 1
        left = np.cumsum(gone[:-1], dtype=np.int8) == 0
        at = np.r_[0, np.cumsum(left)][offsets]
        kept = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[left].tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), kept.cast(pa.binary()), spans], ["id", "n_bytes", "kept", "spans"])


def _several(df: DataFrame, keys: list[str], place) -> DataFrame:
    """The keys that stand at two places or more."""
    return df.groupBy(*keys).agg(F.min(place).alias("p0"), F.max(place).alias("p1")).filter("p0 <> p1").select(*keys)


def _settle(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges whose strings all repeat, as (cls, lo, hi), and, by class, the ranges that need a closer look:
    those not settled whose core occurs elsewhere, and one settled range of each content as partner."""
    place = F.xxhash64("cls", "q", "a")
    whole = ranges.filter("w1 is not null").groupBy("w1", "w2").agg(F.min(place).alias("p0"), F.max(place).alias("p1"), F.max("known").alias("k")).filter("p0 <> p1 or k").select("w1", "w2", "p0")
    first = (place == F.col("p0")) | (F.col("known") & F.col("w1").isNull())
    # Ranges without a whole (null) stay out of the join, where they would all meet on one key.
    full = ranges.filter("w1 is not null").join(whole, ["w1", "w2"], "left")
    part = ranges.filter("w1 is null").withColumn("p0", F.lit(None).cast("long"))
    df = full.unionByName(part).select("cls", "q", "a", "lo", "hi", "known", "core", (F.col("known") | F.col("p0").isNotNull()).alias("settled"), F.coalesce(first, F.lit(False)).alias("first"))
    df = keep(df, "settled")
    cores = df.groupBy("core").agg(F.min(place).alias("c0"), F.max(place).alias("c1"), F.max(~F.col("settled")).alias("open")).filter("c0 <> c1 and open").select("core")
    rest = df.filter("not settled or first").join(cores, "core", "left_semi")
    rest = keep(rest.groupBy("cls").agg(F.collect_set(F.struct("q", "a", "lo", "hi", "settled")).alias("spans")), "open-ranges")
    return df.filter("settled and not known").select("cls", "lo", "hi"), rest


def _hot_spans(texts: DataFrame, length: int) -> DataFrame:
    """Repeated starts (cls, lo, hi) at the triggers `places` of texts (cls, text, places), by ranges."""
    width = max(1, length // 8)
    sub = max(1, width // 7)
    bases = (tv.draw_base(), tv.draw_base())
    texts = keep(texts, "hot-texts")
    held = texts.select("cls", "text")
    ranges = keep(texts.mapInArrow(_range_rows(length, width, bases), ROWS), "ranges")
    done, open_ranges = _settle(ranges)
    forget(ranges)
    ranges = keep(held.join(open_ranges, "cls").select("cls", "text", "spans").mapInArrow(_narrow_rows(length, width, sub, bases), ROWS), "narrow-ranges")
    done2, open_ranges = _settle(ranges)
    forget(ranges)
    starts = keep(held.join(open_ranges, "cls").select("cls", "text", "spans").mapInArrow(_start_rows(length, bases), "cls long, p long, settled boolean, w1 long, w2 long"), "starts")
    place = F.xxhash64("cls", "p")
    several = starts.groupBy("w1", "w2").agg(F.min(place).alias("p0"), F.max(place).alias("p1"), F.max("settled").alias("known")).filter("p0 <> p1 or known").select("w1", "w2")
    single = starts.filter("not settled").join(several, ["w1", "w2"], "left_semi").select("cls", F.col("p").alias("lo"), F.col("p").alias("hi"))
    return done.unionByName(done2).unionByName(single)


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, members: int = MEMBERS) -> DataFrame:
    """One row per document: id, n_bytes, kept (the bytes that are left; a cut may stand inside a character) and
    spans (the removed runs in order, from start up to stop, in bytes of the input)."""
    if length < 4 * K:
        raise ValueError(f"strings of at least {4 * K} bytes are needed")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("cls", F.xxhash64("text"))
    second = F.xxhash64(F.lit(7), "text").alias("cls2")
    n_bytes = F.octet_length("text").cast("long")
    classes = texts.filter(n_bytes >= length).groupBy("cls", second).agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("rep"), F.min(n_bytes).alias("n_bytes"))
    classes = keep(classes, "text-classes")

    halves = keep(texts.filter(F.octet_length("text") >= length).select("cls", "text").mapInArrow(_half_rows(length, tv.draw_base()), "key long, cls long, q long, tau long"), "half-contexts")
    # Kept first, so that the join is of two plain exchanges and a hot half context can be split.
    twice = keep(_several(halves, ["key"], F.xxhash64("cls", "q")), "repeated-halves")
    hits = halves.join(twice, "key", "left_semi")
    hits = keep(hits.select("cls", "q", "tau").distinct(), "repeated-triggers")
    forget(halves)
    hot = keep(hits.groupBy("tau").agg(F.count(F.lit(1)).alias("places")).filter(F.col("places") > members).select("tau", F.lit(True).alias("hot")), "hot-triggers")
    many = hot.count()
    hits = hits.join(F.broadcast(hot) if many <= BROADCAST_IDS else hot, "tau", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    hits = keep(hits.groupBy("cls", "hot").agg(F.collect_set("q").alias("places")), "places")
    ids = keep(classes.join(hits.select("cls").distinct(), "cls", "left_semi").select("cls", F.coalesce("rep", F.lit(NO_ID)).alias("rep")), "repeated-texts")
    chosen = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    named = texts.withColumnRenamed("cls", "own").withColumn("key", F.coalesce("id", F.lit(NO_ID)))
    # Rows that repeat an id and its text come twice; all their strings repeat anyway.
    held = keep(named.join(chosen, (F.col("key") == F.col("rep")) & (F.col("own") == F.col("cls"))).select("cls", "text"), "held-texts")

    contexts = held.join(hits.filter("not hot"), "cls").select("cls", "text", "places").mapInArrow(_context_rows(length), CONTEXT)
    spans = contexts.repartition("tau").sortWithinPartitions("tau").mapInArrow(_match_rows(length, members), "cls long, lo long, hi long")
    spans = keep(spans, "repeated-starts")
    if many:
        spans = spans.unionByName(_hot_spans(held.join(hits.filter("hot"), "cls").select("cls", "text", "places"), length))
    spans = spans.groupBy("cls").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    runs = spans.mapInArrow(_run_rows(length), f"cls long, spans {RUNS}")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    found = classes.join(runs, "cls", "left").select("cls", "cls2", F.when(F.col("members") > 1, whole).otherwise(F.col("spans")).alias("spans"))
    found = keep(found.filter("spans is not null"), "removed-runs")
    # The texts move once to meet their runs; groups of copies can be split.
    out = texts.select("id", "text", "cls", second).join(found.hint("shuffle_hash"), ["cls", "cls2"], "left")
    out = out.select("id", "text", F.coalesce("spans", F.array().cast(RUNS)).alias("spans")).mapInArrow(_kept_rows, f"id long, n_bytes long, kept binary, spans {RUNS}")
    return out.select(F.col("id").alias(id_col), "n_bytes", "kept", "spans")


def digests() -> list[Column]:
    """n_bytes, n_removed, n_spans and kept_sha256 of rows of kept_texts()."""
    n_removed = F.col("n_bytes") - F.octet_length("kept")
    return [F.col("n_bytes"), n_removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, members: int = MEMBERS) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    return kept_texts(docs, id_col, text_col, length, members).select(id_col, *digests())
