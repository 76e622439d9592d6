"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are scaled to length one and rotated into the principal axes of all vectors, so the leading
dimensions hold most of a product. A group (label and length) of up to a tile is compared by one task. Two
vectors with cosine >= t differ by at most sqrt(2 - 2t) on any axis: larger groups are cut into cells of that
width along the first axis and only a cell and the next are compared. Cells are dealt into tiles by hash, and
a task compares one pair of tiles, block by block: it adds up the products of the leading dimensions, bounds
the rest by the product of the suffix norms (Cauchy-Schwarz), and drops pairs that cannot reach t. What
remains is decided by the plain cosine of the given components in double precision.

Scale: equal vectors collapse to one class first (partial aggregation), so a group of copies costs one
vector. Vectors are stored once, by class and in their own type, and rotated where they are compared. A tile
holds about 2**21 components, whatever the group's size, and meets the other tiles of its cells in rounds:
a round sends each vector to two tasks at most and its shuffle files go with it, so that disk stays in
proportion to the input however many tiles a group has. The rotation is d x d numbers from one pass. A tile
sends the number of links of each vector and its components as stars, never the pairs. Within a cell the
method is quadratic in time, as tiled comparison is.

Defined cases: null vectors, null or non-finite components, zero vectors and null labels link with
nothing; vectors of different length never link; repeated rows are vectors of their own, and so are rows that
repeat an id; a cosine equal to the threshold links; an empty table gives no rows; other columns do not matter,
whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.llm.frames import components, forget, joined, keep

#: Components of a tile's vectors, and the fewest vectors of a tile.
TILE_SIZE, LEAST_TILE = 1 << 21, 512
#: Rows and columns of a block of products, and pairs that are decided at once.
ROWS, COLUMNS, PAIRS = 512, 4096, 1 << 14
#: Links of a task that are held before they are joined to stars.
LINKS = 1 << 20


def _floats(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _moment_rows(batches):
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        lengths = np.diff(b.column(0).offsets.to_numpy())
        for d in np.unique(lengths):
            x = _unit(_floats(b.column(0).filter(pa.array(lengths == d))))
            sums[d] = sums.get(d, 0) + x.T @ x
    for d, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int64)), pa.array(np.arange(d * d)), pa.array(m.ravel())], ["d", "at", "v"])


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes for the most common vector length; other lengths keep their own axes."""
    top = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if top is None:
        return {}
    d = top["d"]
    rows = vectors.filter(F.size("v") == d).select("v").mapInArrow(_moment_rows, "d long, at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    m = np.zeros(d * d)
    m[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1].copy()}


def _unit(v: np.ndarray) -> np.ndarray:
    x = v / np.abs(v).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _celled(rotation, width: float):
    """Adds the vector's cell along the first axis."""

    def run(batches):
        for b in batches:
            v = b.column(b.schema.get_field_index("v"))
            lengths = np.diff(v.offsets.to_numpy())
            for d in np.unique(lengths):
                own = pa.array(lengths == d)
                x = _unit(_floats(v.filter(own)))
                r = rotation.value.get(int(d))
                first = x @ r[:, 0] if r is not None else x[:, 0]
                yield pa.RecordBatch.from_arrays([*(c.filter(own) for c in b.columns), pa.array(np.floor(first / width).astype(np.int64))], [*b.schema.names, "cell"])

    return run


class _Side:
    """The vectors of a tile: components in double precision and norms, rotated unit vectors in single precision."""

    def __init__(self, v: np.ndarray, rotation):
        y = _unit(v)
        y = y @ rotation if rotation is not None else y
        self.y = y.astype(np.float32)
        self.v = _scaled(v)
        self.norm = np.sqrt((self.v**2).sum(axis=1))

    def lead(self, k: int) -> np.ndarray:
        """The first k dimensions and the norm of the others: products of such rows bound the cosine."""
        rest = np.sqrt((self.y[:, k:].astype(np.float64) ** 2).sum(axis=1))
        return np.c_[self.y[:, :k], rest.astype(np.float32)]


def _near_pairs(a: _Side, b: _Side, t: float, same: bool):
    """Blocks of pairs (i, j) with cosine >= t; i < j within one tile."""
    d = a.y.shape[1]
    least = t - 2.5e-7 * (d + 16)  # four times what single precision can lose
    energy = np.cumsum((a.y.astype(np.float64) ** 2).mean(axis=0))
    k = min(d, max(16, -(-int((energy < 0.25).sum() + 1) // 8) * 8))
    la, lb = a.lead(k), b.lead(k)
    for r in range(0, len(la), ROWS):
        for c in range(r if same else 0, len(lb), COLUMNS):
            i, j = np.nonzero(la[r : r + ROWS] @ lb[c : c + COLUMNS].T >= least)
            if len(i) > ROWS * COLUMNS // 64:
                i, j = np.nonzero(a.y[r : r + ROWS] @ b.y[c : c + COLUMNS].T >= least)
            i, j = i + r, j + c
            if same:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), PAIRS):
                x, y = i[at : at + PAIRS], j[at : at + PAIRS]
                some = (a.v[x] * b.v[y]).sum(axis=1) / (a.norm[x] * b.norm[y]) >= t
                yield x[some], y[some]


def _stars(x: list[np.ndarray], y: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    nodes, root = joined(np.concatenate(x), np.concatenate(y))
    return nodes[nodes != root], root[nodes != root]


def _tile_links(t: float, rotation):
    def group(table: pa.Table) -> pa.Table:
        """For each vector with links its number of them, as (rep, rep, n), and the tile's components, as a
        star of (vector, another, 0) each: at most two rows for a vector."""
        same = table.num_rows > 0 and table.column("step")[0].as_py() == 0 and table.column("s")[0].as_py() == table.column("t")[0].as_py()
        side = table.column("side").to_numpy()
        first, second = (table.filter(pa.array(side == i)).combine_chunks() for i in (0, 1))
        if not first.num_rows or not (same or second.num_rows):
            return pa.table([pa.array(np.zeros(0, np.int64))] * 3, ["a", "b", "n"])
        made = lambda own: _Side(_floats(own.column("v").combine_chunks()), rotation.value.get(own.column("d")[0].as_py()))
        a = made(first)
        b = a if same else made(second)
        shift = 0 if same else first.num_rows
        rep, copies = (np.r_[first.column(c).to_numpy(), second.column(c).to_numpy()] for c in ("rep", "copies"))
        degree = np.zeros(len(rep), np.int64)
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in _near_pairs(a, b, t, same):
            j = j + shift
            np.add.at(degree, i, copies[j])
            np.add.at(degree, j, copies[i])
            x.append(i)
            y.append(j)
            if sum(map(len, x)) > LINKS + len(rep):
                x, y = ([e] for e in _stars(x, y))
        node, root = _stars(x, y)
        some = np.flatnonzero(degree)
        columns = np.r_[rep[some], rep[node]], np.r_[rep[some], rep[root]], np.r_[degree[some], np.zeros(len(node), np.int64)]
        return pa.table([pa.array(c) for c in columns], ["a", "b", "n"])

    return group


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors whose squares would over- or underflow are scaled by a power of two, which is exact."""
    top = np.abs(v).max(axis=1, initial=0)
    odd = (top > 1e100) | (top < 1e-100)
    return np.where(odd[:, None], v * np.exp2(-np.floor(np.log2(top)))[:, None], v) if odd.any() else v


def _rounds(placed: DataFrame, tiles: int):
    """Rows (base, step, s, t, side) of pairs of tiles, by rounds that send each vector to two tasks at most:
    tile s of a cell with tile s + k of the same cell (step 0), then of the next cell (step 1)."""
    own, n = F.col("own"), F.col("tiles")
    meet = lambda ok, base, step, s, t, side: F.struct(ok.alias("ok"), base.alias("base"), F.lit(step).alias("step"), s.cast("int").alias("s"), t.cast("int").alias("t"), F.lit(side).alias("side"))

    def dealt(*meets: Column) -> DataFrame:
        some = F.filter(F.array(*meets), lambda m: m["ok"])
        return placed.select("label", "d", "rep", "copies", "v", F.explode(some).alias("m")).select("label", "d", "rep", "copies", "v", "m.base", "m.step", "m.s", "m.t", "m.side")

    cell = F.col("cell")
    for k in range(tiles):
        ahead = meet(own + k < n, cell, 0, own, own + k, 0)
        yield dealt(ahead) if k == 0 else dealt(ahead, meet(own >= k, cell, 0, own - k, own, 1))
        up, down = F.greatest(n, "above"), F.greatest(n, "below")
        to, of = (own + k) % up, F.pmod(own - k, down)
        yield dealt(meet((k < up) & (to < F.col("above")), cell, 1, own, to, 0), meet((k < down) & (of < F.col("below")), cell - 1, 1, of, own, 1))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, tile: int | None = None) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept. `tile`: vectors of a tile; by their length if not given."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType
    number = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{number}>").alias("v"))
    # Row numbers keep repeated ids apart; classes are named by their smallest id and a digest.
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fit = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    plain = F.transform("v", lambda x: x.cast("double") + F.lit(0.0))  # -0.0 + 0.0 = 0.0
    every = every.withColumn("fit", F.coalesce(fit, F.lit(False))).withColumn("digest", F.when(F.col("fit"), F.unhex(F.sha2(F.concat_ws(",", "label", F.to_json(plain)), 256))))
    classes = every.filter("fit").groupBy("digest", "label").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = keep(classes.withColumn("rep", F.xxhash64("digest")).withColumn("d", F.size("v")), "vector-classes")
    names = keep(classes.select("rep", "digest", "low", "copies"), "vector-names")
    rotation = spark.sparkContext.broadcast(axes(classes.select("v")))
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9) or 1.0
    most = F.lit(tile) if tile else F.greatest(F.lit(LEAST_TILE), F.floor(F.lit(TILE_SIZE) / F.col("d")))
    # As many rows as there are full tiles at most.
    large = classes.groupBy("label", "d").count().filter(F.col("count") > most).select("label", "d").collect()
    members = classes.select("label", "d", "rep", "copies", "v")
    key, link = ["label", "d", "base", "step", "s", "t"], "a long, b long, n long"
    compare = lambda df: keep(df.groupBy(*key).applyInArrow(_tile_links(threshold, rotation), link), "vector-links")
    zero = {c: F.lit(0).cast("long" if c == "base" else "int") for c in ("base", "step", "s", "t", "side")}
    if not large:
        parts = [compare(members.withColumns(zero))]
    else:
        groups = F.broadcast(spark.createDataFrame(large, "label string, d int"))
        parts = [compare(members.join(groups, ["label", "d"], "left_anti").withColumns(zero))]
        placed = members.join(groups, ["label", "d"], "left_semi").select(*members.columns)
        placed = keep(placed.mapInArrow(_celled(rotation, width), "label string, d int, rep long, copies long, v array<%s>, cell long" % number), "placed")
        counts = placed.groupBy("label", "d", "cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("tiles"))
        counts = keep(counts, "tile-counts")
        forget(classes)  # the vectors are in `placed` now
        above = counts.select("label", "d", (F.col("cell") - 1).alias("cell"), F.col("tiles").alias("above"))
        below = counts.select("label", "d", (F.col("cell") + 1).alias("cell"), F.col("tiles").alias("below"))
        around = counts.join(above, ["label", "d", "cell"], "left").join(below, ["label", "d", "cell"], "left").fillna(0, ["above", "below"])
        rows = placed.join(F.broadcast(around), ["label", "d", "cell"]).withColumn("own", F.pmod(F.hash("rep"), F.col("tiles")))
        parts += [compare(df) for df in _rounds(rows, counts.agg(F.max("tiles")).first()[0])]
        classes = placed
    forget(classes)
    links = reduce(DataFrame.unionByName, parts)
    found = components(links.select("a", "b"))
    degree = links.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    named = names.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = keep(named.join(low, "component").select("digest", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"), "vector-components")
    forget(names)
    # Vectors that link with nothing have no digest; they stay out of the join.
    every = every.select("id", "fit", "digest")
    out = every.filter("fit").select("id", "digest").join(named, "digest", "left")
    out = out.unionByName(every.filter("not fit").select("id", "digest"), allowMissingColumns=True)
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
