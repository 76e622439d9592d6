"""N-gram Jaccard join by PartEnum signatures.

The set of a document holds the hashes of its distinct k-word shingles. Two sets of the same or
neighbouring size bands with Jaccard similarity >= percent/100 differ in at most `k_max` features.
PartEnum cuts the feature domain into k_max // 2 + 1 parts by hash: some part then holds at most one of the
differences. That part is cut into three, and each subset of two is a signature: the pair shares at least
one. So nothing is lost, and every hit is verified on whole sets. Subsets that hold no feature are shared by
unrelated sets, so g more parts are cut: the pair then agrees in g + 1 parts, two of which lie in one of g
groups of parts. Either has a feature and is a signature by itself, or both are empty, and empty signatures
of a group are only sent in pairs, which unrelated sets hardly share.

Scale: a signature row is 16 bytes, shuffled once by signature. Exact copies collapse to one class
before that (block by block) and in the class table. Buckets are streamed sorted, never gathered: each sends
(centre, member) pairs, which are verified. What the centres leave open never becomes a list of pairs: of the
buckets with like members one is taken; in it, members of different components whose count sketches (their
L1 distance bounds the set difference from below) may link are joined by a spanning forest, at most one row a
member; the trees are groups, in which whole sets are compared in place, and again at most one link a
member comes out. Buckets and groups above `BLOCK` members are cut into blocks, one tile for each two.

Defined cases: null or wordless text has an empty set and its own component; fewer than k words make
one shingle; a null id keeps its row and never becomes a component; repeated rows give a row each, and rows
that repeat an id with another text are judged each by its own; ties of similarity at the threshold link; texts
of any length are whole; an empty table gives no rows; other columns do not matter, whatever their names.
Features are 64-bit mixes of word hashes modulo 2**61 - 1 under a base drawn for each run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm import textvec as tv
from chronofold.llm.frames import components, forget, keep

U = tv.U
SKETCH = 128
#: Parts in a group, about: groups are extra parts that make empty signatures meet in pairs.
GROUP = 64
#: Members of a block of a tile, and features in it, about.
BLOCK, FEATURES = 1024, 1 << 20
#: Up to so many ids (8 bytes each) are broadcast; above, the same semi-join shuffles.
BROADCAST_IDS = 1_000_000
#: Stands for a null id in joins; results keep the null.
NO_ID = -(1 << 63)


def bands(percent: int, most: int) -> np.ndarray:
    """Upper ends of the size bands: a set of size s links with sizes up to s * 100 / percent, which
    lie in its own band or the next."""
    ends, low = [], 1
    while True:
        ends.append(max(low, low * 100 // percent))
        low = ends[-1] + 1
        if low > most and len(ends) > 1 and ends[-2] >= most:
            return np.array(ends, np.int64)


def signatures(row, value, size, percent: int, shift: int):
    """PartEnum signatures of the sets given as sorted (row, value), in the size band `shift` above a set's
    own: the row and key of each."""
    ends = bands(percent, int(size.max(initial=1)))
    j = np.searchsorted(ends, np.maximum(size, 1)) + shift
    k_max = np.where(size > 0, 2 * (100 - percent) * ends[j] // (100 + percent), 0)
    least = k_max // 2 + 1
    groups = np.where(least > 1, least // GROUP + 1, 0)
    parts = np.where(k_max > 0, least + groups, 0)
    base = np.cumsum(parts) - parts
    use = parts[row] > 0
    r, v = row[use], value[use]
    h = tv.mix(v ^ U(0x9FB21C651E98DF25))
    part = ((h >> U(33)) % parts[r].astype(U)).astype(np.int64)
    third = ((h & U(0x7FFFFFFF)) % U(3)).astype(np.int64)
    sums = np.zeros(3 * int(parts.sum()), U)
    np.add.at(sums, 3 * (base[r] + part) + third, tv.mix(v ^ U(0x2545F4914F6CDD1D)))
    sums = sums.reshape(-1, 3)
    content = sums.sum(axis=1, dtype=U)[:, None] - sums
    owner = np.repeat(np.arange(len(size)), parts)
    part = np.arange(len(owner)) - base[owner]
    tag = (j[owner].astype(U) << U(40)) + part.astype(U) * U(4)
    key = tv.mix(content ^ tv.mix(tag[:, None] + np.arange(3, dtype=U))).ravel()
    owner, part = np.repeat(owner, 3), np.repeat(part, 3)
    bare = (content == 0).ravel() & (groups[owner] > 0)
    rows, keys = [owner[~bare]], [key[~bare]]
    if bare.any():
        # Two sets that share no other signature share two empty ones of different parts of a group.
        o, p, k = owner[bare], part[bare], key[bare]
        g = p % groups[o]
        order = np.lexsort((p, g, o))
        o, p, g, k = o[order], p[order], g[order], k[order]
        run = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (g[1:] != g[:-1])])
        stop = np.repeat(np.r_[run[1:], len(o)], np.diff(np.r_[run, len(o)]))
        n = stop - np.arange(len(o)) - 1
        x = np.repeat(np.arange(len(o)), n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        some = p[x] != p[y]
        rows.append(o[x[some]])
        keys.append(tv.mix(k[x[some]] * U(3) ^ k[y[some]]))
    return np.concatenate(rows), np.concatenate(keys)


def all_signatures(row, value, size, percent: int):
    """(row, key) of the signatures in a set's own band and the next."""
    return tuple(map(np.concatenate, zip(*(signatures(row, value, size, percent, shift) for shift in (0, 1)), strict=True)))


def digests(row, value, n: int):
    size = np.bincount(row, minlength=n)
    d1 = tv.mix(tv.sum_per_row(row, tv.mix(value ^ U(0x1B873593CC9E2D51)), n) + size.astype(U))
    d2 = tv.mix(tv.sum_per_row(row, tv.mix(value ^ U(0x52DCE729C0FFEE11)), n) ^ size.astype(U))
    return size, d1.view(np.int64), d2.view(np.int64)


def sketches(row, value, size) -> list[bytes]:
    """Of each set the counts of features by hash cell, cut at 255: `SKETCH` cells, and for larger sets a power
    of two times as many, n / 8 at least. Counting and cutting only shrink L1 distances, and so does adding
    neighbouring cells up, by which sketches of different sizes are compared."""
    level = np.ceil(np.log2(np.maximum(size, 8 * SKETCH) / (8 * SKETCH))).astype(np.int64)
    h = tv.mix(value ^ U(0x632BE59BD9B4E019))
    out = [b""] * len(size)
    for at in np.unique(level).tolist():
        some = np.flatnonzero(level == at)
        cells = SKETCH << at
        place = np.full(len(size), -1)
        place[some] = np.arange(len(some))
        own = place[row] >= 0
        cell = place[row[own]] * cells + (h[own] >> U(64 - cells.bit_length() + 1)).astype(np.int64)
        counts = np.minimum(np.bincount(cell, minlength=len(some) * cells), 255).astype(np.uint8).reshape(-1, cells)
        for i, counted in zip(some.tolist(), counts, strict=True):
            out[i] = counted.tobytes()
    return out


def _fold(counts: np.ndarray) -> np.ndarray:
    return counts[:, ::2] + counts[:, 1::2]


class Sketches:
    """The sketches of some sets, in each size down to the smallest."""

    def __init__(self, column, n: np.ndarray):
        data, offsets = tv.text_buffers(column)
        cells = np.diff(offsets)
        self.n, self.cells, self.place, self.counts = n, cells, {}, {}
        above = None
        for size in sorted(set(cells.tolist()), reverse=True):
            while above is not None and above[1].shape[1] > size:
                above = (above[0], _fold(above[1]))
            own = np.flatnonzero(cells == size)
            counts = data[(offsets[own][:, None] + np.arange(size))].astype(np.int32)
            above = (own, counts) if above is None else (np.r_[above[0], own], np.concatenate([above[1], counts]))
            place = np.full(len(cells), -1)
            place[above[0]] = np.arange(len(above[0]))
            self.place[size], self.counts[size] = place, above[1]

    def near(self, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Whether sets x and y, pair by pair, may link."""
        total = self.n[x] + self.n[y]
        out = np.abs(self.n[x] - self.n[y]) * (100 + percent) <= (100 - percent) * total
        least = np.minimum(self.cells[x], self.cells[y])
        for size in np.unique(least[out]).tolist():
            at = np.flatnonzero(out & (least == size))
            place, counts = self.place[size], self.counts[size]
            for part in np.array_split(at, 1 + len(at) * size // (1 << 20)):
                gap = np.abs(counts[place[x[part]]] - counts[place[y[part]]]).sum(axis=1)
                out[part] = gap * (100 + percent) <= (100 - percent) * total[part]
        return out


def _sizes(k: int, base: int):
    def run(batches):
        powers = tv.Powers(base)
        for batch, data, offsets in tv.blocks(batches, "text"):
            row, value = tv.shingles(data, offsets, k, powers)
            n = len(offsets) - 1
            size, d1, d2 = digests(row, value, n)
            marks = pa.array(sketches(row, value, size), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size), pa.array(d1), pa.array(d2), marks], ["id", "text_key", "n", "d1", "d2", "sketch"])

    return run


def _signature_rows(k: int, percent: int, base: int):
    def run(batches):
        powers = tv.Powers(base)
        for _, data, offsets in tv.blocks(batches, "text"):
            row, value = tv.shingles(data, offsets, k, powers)
            size, d1, _ = digests(row, value, len(offsets) - 1)
            first = np.zeros(len(size), bool)
            first[np.unique(d1, return_index=True)[1]] = True
            size = np.where(first, size, 0)
            own = first[row]
            owner, key = all_signatures(row[own], value[own], size, percent)
            for at in range(0, len(owner), 200_000):
                part = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(d1[owner[part]])], ["sig", "cls"])

    return run


def _set_rows(k: int, base: int):
    def run(batches):
        powers = tv.Powers(base)
        for _, data, offsets in tv.blocks(batches, "text"):
            row, value = tv.shingles(data, offsets, k, powers)
            n = len(offsets) - 1
            size, d1, _ = digests(row, value, n)
            ends = np.r_[0, np.cumsum(size)].astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(size), sets], ["cls", "n", "items"])

    return run


def _bucket_rows(batches):
    """Sorted (sig, cls) to the rows of signatures that several classes share, with the smallest class
    as centre; `open` tells of three classes or more. A hot signature is streamed through."""
    sig0 = cls0 = np.zeros(0, np.int64)
    flowing = None  # (sig, centre, last class) of a signature too long to hold

    def out(sig, cls, centre, more):
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(cls), pa.array(centre), pa.array(more)], ["sig", "cls", "centre", "open"])

    def emit(sig, cls):
        at = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        n = np.diff(np.r_[at, len(sig)])
        size, centre = np.repeat(n, n), np.repeat(cls[at], n)
        some = size > 1
        return out(sig[some], cls[some], centre[some], size[some] > 2)

    for batch in batches:
        sig, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if flowing is not None:
            same = sig == flowing[0]
            c = cls[same]
            c = c[np.r_[flowing[2], c[:-1]] != c] if len(c) else c
            if len(c):
                yield out(np.full(len(c), flowing[0]), c, np.full(len(c), flowing[1]), np.ones(len(c), bool))
                flowing = (flowing[0], flowing[1], c[-1])
            sig, cls = sig[~same], cls[~same]
            if not len(sig):
                continue
            flowing = None
        sig, cls = np.r_[sig0, sig], np.r_[cls0, cls]
        if not len(sig):
            continue
        new = np.r_[True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])]
        sig, cls = sig[new], cls[new]
        last = np.searchsorted(sig, sig[-1])
        if last:
            yield emit(sig[:last], cls[:last])
        sig0, cls0 = sig[last:], cls[last:]
        if len(sig0) > 50_000:
            yield emit(sig0, cls0)
            flowing = (sig0[0], cls0[0], cls0[-1])
            sig0 = cls0 = np.zeros(0, np.int64)
    if len(sig0):
        yield emit(sig0, cls0)


def _near_pairs(percent: int):
    def run(batches):
        for t in batches:
            k = t.num_rows
            both = Sketches(pa.concat_arrays([t.column(2), t.column(4)]), np.r_[t.column(3).to_numpy(), t.column(5).to_numpy()])
            some = pa.array(both.near(np.arange(k), np.arange(k, 2 * k), percent))
            yield pa.RecordBatch.from_arrays([t.column(i).filter(some) for i in (0, 1)], ["a", "b"])

    return run


def _tiles(rows: DataFrame, key: str, members: str, weight: str | None = None) -> DataFrame:
    """The rows with their tile (key, lo, hi) and block: a key with more members than a block holds, or a sum
    `weight` of more features, is cut into blocks by hash, and each two blocks meet in a tile."""
    blocks = F.ceil(F.col(members) / BLOCK)
    if weight:
        blocks = F.greatest(blocks, F.ceil(F.col(weight) / FEATURES))
    rows = rows.withColumn("blocks", F.greatest(blocks, F.lit(1)).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("blocks", "other", members, *([weight] if weight else []))
    return rows.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi", "cls")


def _by_tile(batches):
    """Sorted rows (key, lo, hi, block, ...) as one table for each tile of two rows or more."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = [held.column(i).to_numpy() for i in range(3)]
        new = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if len(held) else []
        for at, to in zip(new[:-1], new[1:], strict=True):
            if to - at > 1:
                yield held.slice(at, to - at).combine_chunks()
        held = held.slice(new[-1]) if len(new) else held
    if held is not None and len(held) > 1:
        yield held.combine_chunks()


def _forest(batches, percent: int, linked, joined: bool):
    """For each tile a spanning forest of the pairs of different components that `linked` accepts:
    linked(tile)(i, others) tells which of the others go with i. At most one row for a member. If `joined`,
    the members of a component count as connected from the start."""
    for t in _by_tile(batches):
        block, cls, comp, n = (t.column(i).to_numpy() for i in (3, 4, 5, 6))
        marks, accept = Sketches(t.column(7), n), linked(t)
        across = block[0] != block[-1] or (block != block[0]).any()
        label = np.unique(comp, return_inverse=True)[1] if joined else np.arange(len(cls))
        a, b = [], []
        for i in range(len(cls) - 1):
            other = (label[i + 1 :] != label[i]) & (comp[i + 1 :] != comp[i])
            if across:
                other &= block[i + 1 :] != block[i]
            y = np.flatnonzero(other) + i + 1
            if len(y):
                y = y[marks.near(np.full(len(y), i), y, percent)]
            if len(y):
                y = accept(i, y)
            if len(y):
                found, first = np.unique(label[y], return_index=True)
                a.append(np.full(len(first), cls[i]))
                b.append(cls[y[first]])
                label[np.isin(label, found)] = label[i]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _near_forest(percent: int):
    def run(batches):
        yield from _forest(batches, percent, lambda t: lambda i, y: y, False)

    return run


def _link_forest(percent: int):
    def linked(t):
        column = t.column(8).combine_chunks()
        items, ends, n = column.values.to_numpy(), column.offsets.to_numpy().astype(np.int64), t.column(6).to_numpy()

        def accept(i, y):
            size = ends[y + 1] - ends[y]
            row = np.repeat(np.arange(len(y)), size)
            at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + ends[y][row]
            both = np.bincount(row[np.isin(items[at], items[ends[i] : ends[i + 1]])], minlength=len(y))
            return y[both * 100 >= percent * (n[i] + n[y] - both)]

        return accept

    def run(batches):
        yield from _forest(batches, percent, linked, True)

    return run


def _components(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """One row per document: id, text_key, n, component_id."""
    base = tv.draw_base()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed = texts.withColumn("text_key", F.xxhash64("text"))
    sizes = keep(keyed.mapInArrow(_sizes(k, base), "id long, text_key long, n long, d1 long, d2 long, sketch binary"), "sizes")
    some = sizes.filter("n > 0")
    classes = keep(some.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.min("sketch").alias("sketch")), "classes")
    sigs = texts.select("text").mapInArrow(_signature_rows(k, percent, base), "sig long, cls long")
    shared = keep(sigs.repartition("sig").sortWithinPartitions("sig", "cls").mapInArrow(_bucket_rows, "sig long, cls long, centre long, open boolean"), "buckets")
    pairs = shared.filter("cls <> centre").select(F.col("centre").alias("a"), F.col("cls").alias("b")).distinct()
    candidates = shared.select(F.col("cls").alias("d1")).distinct()
    marks = keep(classes.join(candidates, "d1", "left_semi").groupBy(F.col("d1").alias("cls")).agg(F.min("n").alias("n"), F.min("sketch").alias("sketch")), "sketches")

    def sets(wanted: DataFrame) -> DataFrame:
        """The sets of the classes `d1`; only their texts are read again."""
        ids = classes.join(wanted, "d1", "left_semi")
        ids = keep(ids.select(F.coalesce("rep", F.lit(NO_ID)).alias("key")).distinct(), "candidate-ids")
        chosen = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        items = texts.withColumn("key", F.coalesce("id", F.lit(NO_ID))).join(chosen, "key", "left_semi").select("text").mapInArrow(_set_rows(k, base), "cls long, n long, items array<long>")
        return keep(items, "sets")

    a = marks.select(F.col("cls").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    b = marks.select(F.col("cls").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    near = pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "na", "sb", "nb").mapInArrow(_near_pairs(percent), "a long, b long")
    near = keep(near, "near-pairs")
    items = sets(near.select(F.col("a").alias("d1")).unionByName(near.select(F.col("b").alias("d1"))).distinct())
    a = items.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    b = items.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    both = F.size(F.array_intersect("ia", "ib"))
    links = keep(near.join(a, "a").join(b, "b").filter(both * 100 >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b"), "links")
    forget(items)
    found = keep(components(links), "components")

    # What the centres left open: buckets with members of more than one component, one of those with like members.
    rest = shared.filter("open and cls <> centre").select("sig", "cls").join(found.withColumnRenamed("node", "cls"), "cls", "left")
    rest = keep(rest.select("sig", "cls", F.coalesce("component", "cls").alias("comp")), "open-members")
    forget(shared)
    mixed = rest.groupBy("sig").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("members"),
        F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "cls")).alias("y"),
    ).filter("low <> high")
    mixed = mixed.groupBy("x", "y", "members").agg(F.min("sig").alias("sig")).select("sig", "members")
    rest = rest.join(mixed, "sig").join(marks, "cls").select("sig", "cls", "comp", "n", "sketch", "members")
    tiles = _tiles(rest, "sig", "members").select("sig", "lo", "hi", "block", "cls", "comp", "n", "sketch")
    groups = keep(components(tiles.mapInArrow(_near_forest(percent), "a long, b long")), "open-groups")
    if not groups.isEmpty():
        group = groups.select(F.col("node").alias("cls"), F.col("component").alias("grp"))
        items = sets(group.select(F.col("cls").alias("d1")))
        named = group.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "grp", F.coalesce("component", "cls").alias("comp"))
        rows = named.join(items.groupBy("cls").agg(F.min("n").alias("n"), F.first("items").alias("items")), "cls").join(marks.drop("n"), "cls")
        total = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("features"))
        tiles = _tiles(rows.join(total, "grp"), "grp", "members", "features").select("grp", "lo", "hi", "block", "cls", "comp", "n", "sketch", "items")
        extra = keep(tiles.mapInArrow(_link_forest(percent), "a long, b long"), "open-links")
        forget(items)
        if not extra.isEmpty():
            found = keep(components(links.unionByName(extra)), "components")
    named = classes.join(found.withColumnRenamed("node", "d1"), "d1", "left").withColumn("component", F.coalesce("component", "d1"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    # Kept first, so that the join is of two plain exchanges and a large class of copies can be split.
    named = keep(named.join(least, "component").select("d1", "d2", "n", "component_id"), "class-components")
    # Texts without a word share one digest; they stay out of the join, as each is its own component.
    out = some.join(named, ["d1", "d2", "n"], "left").select("id", "text_key", "n", "component_id")
    out = out.unionByName(sizes.filter("n = 0").select("id", "text_key", "n", F.lit(None).cast("long").alias("component_id")))
    return out.withColumn("component_id", F.coalesce("component_id", "id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links)."""
    out = _components(docs, id_col, text_col, k, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose id is the smallest of their component; rows with a null id stay. Of rows that
    repeat an id, each goes or stays by its own text. Texts only move if more rows go than may be broadcast."""
    found = _components(docs, id_col, text_col, k, percent).filter("id <> component_id")
    gone = keep(found.select(F.col("id").alias("gone"), F.col("text_key").alias("gone_text")).distinct(), "removed-rows")
    few = gone.count() <= BROADCAST_IDS
    same = (F.col(id_col).cast("long") == F.col("gone")) & (F.xxhash64(text_col) == F.col("gone_text"))
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
