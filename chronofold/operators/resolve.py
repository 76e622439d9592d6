"""Entity resolution and merge: clusters, conflicts, provenance, plans.

Branches are rows (branch, rank, id, <key>, props map). Clustering by unique key is a group; clustering by
similar text blocks on shared rare tokens, verifies Jaccard of token sets and takes connected components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.shared import checkpoint


def normal_key(text) -> Column:
    """Trimmed, lower-cased id."""
    c = F.col(text) if isinstance(text, str) else text
    return F.lower(F.trim(c))


def strip_suffixes(text, suffixes: list[str]) -> Column:
    """Normal key without trailing suffixes, repeated; never stripped to nothing."""
    import re

    pattern = "^(.+?)(?:" + "|".join(re.escape(s) for s in suffixes) + ")+$"
    return F.regexp_replace(normal_key(text), pattern, "$1")


def fold_aliases(df: DataFrame, key: str, alias: str, order: str) -> DataFrame:
    """Aliases of each key in order of first sighting, without repeats (groups of one row per alias)."""
    first = df.groupBy(key, alias).agg(F.min(order).alias("_at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", alias))), lambda x: x[alias]).alias("aliases"))


def first_alias(texts: DataFrame, aliases: DataFrame, text: str, concept: str = "concept", alias: str = "alias", order: str = "alias_ix") -> DataFrame:
    """Concepts whose alias stands in the text (case-insensitive), by the first alias that matches. The
    alias list is a declared vocabulary of bounded size and is broadcast."""
    hit = texts.join(F.broadcast(aliases), F.expr(f"contains(lower({text}), lower({alias}))"))
    keys = [c for c in texts.columns if c != text]
    return hit.groupBy(*keys, concept).agg(F.min_by(alias, order).alias("matched"))


def tokens(text: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def similar_pairs(rows: DataFrame, id: str, text: str, threshold: float) -> DataFrame:
    """Pairs a < b of distinct texts with Jaccard of token sets >= threshold. Equal token sets are one
    class, so copies make no pairs; prefixes of rare tokens block, as in set-similarity joins."""
    sets = rows.select(F.col(id).alias("id"), F.array_sort(tokens(text)).alias("t")).filter(F.size("t") > 0)
    classes = sets.groupBy("t").agg(F.min("id").alias("id"))
    each = classes.select("id", F.explode("t").alias("token"))
    freq = each.groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    ranked = each.join(freq, "token").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "token"))), lambda x: x["token"]).alias("r"))
    n = F.size("r")
    prefix = ranked.select("id", "r", F.explode(F.slice("r", 1, (n - F.ceil(n * F.lit(threshold) - 1e-9) + 1).cast("int"))).alias("token"))
    a, b = prefix.select(F.col("id").alias("a"), F.col("r").alias("ra"), "token"), prefix.select(F.col("id").alias("b"), F.col("r").alias("rb"), "token")
    fits = (F.size("ra") >= F.size("rb") * F.lit(threshold) - 1e-9) & (F.size("rb") >= F.size("ra") * F.lit(threshold) - 1e-9)
    pairs = a.join(b, "token").filter(F.col("a") < F.col("b")).filter(fits).dropDuplicates(["a", "b"])
    both = F.size(F.array_intersect("ra", "rb"))
    return pairs.filter(both >= F.lit(threshold) * (F.size("ra") + F.size("rb") - both) - 1e-9).select("a", "b")


def cluster(nodes: DataFrame, pairs: DataFrame, id: str = "id") -> DataFrame:
    """(id, canonical): smallest member of each connected component, by min-label rounds with pointer
    jumping; labels are written between rounds, so lineage stays short."""
    both = checkpoint(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpoint(both.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id")))
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("m"))
        new = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("old"))
        jump = new.select(F.col("id").alias("j"), F.col("label").alias("jl"))
        new = checkpoint(new.join(jump, F.col("label") == F.col("j"), "left").select("id", F.least("label", F.coalesce("jl", "label")).alias("label"), "old"))
        if new.filter("label <> old").limit(1).isEmpty():
            break
        labels = new.select("id", "label")
    return nodes.select(F.col(id).alias("id")).join(labels.select(F.col("id").alias("n"), "label"), F.col("id") == F.col("n"), "left").select("id", F.coalesce("label", "id").alias("canonical"))


def canonical_ids(members: DataFrame, key: str, base: str = "base") -> DataFrame:
    """(branch, id, canonical): rows with one (case-insensitive) key are one entity; canonical is the
    target's id if it has the key, else the id of the first branch, then the smallest id."""
    w = Window.partitionBy(F.lower(key))
    first = F.min(F.struct((F.col("branch") != base).alias("later"), "rank", "id")).over(w)["id"]
    return members.withColumn("canonical", F.when(F.col(key).isNull(), F.col("id")).otherwise(first))


def conflicts(members: DataFrame, props: list[str], base: str = "base") -> DataFrame:
    """Property conflicts under policy flag: (canonical, property, kept, incoming, kind): the base value stays, or
    the first branch's. Against the base, incoming lists the branches' differing values by rank; among branches
    it lists both sides, the kept one too."""
    pairs = F.expr("stack(" + str(len(props)) + ", " + ", ".join(f"'{p}', cast({p} as string)" for p in props) + ") as (property, value)")
    long = members.select("canonical", "branch", "rank", pairs).filter("value is not null").distinct()
    w = Window.partitionBy("canonical", "property")
    first = F.min(F.struct((F.col("branch") != base).alias("later"), "rank", "value")).over(w)
    differ = F.max("value").over(w) != F.min("value").over(w)
    long = long.withColumns({"kept": first["value"], "kind": F.when(first["later"], "branch-branch").otherwise("base-branch"), "differ": differ})
    long = long.filter("differ and (kind = 'branch-branch' or value <> kept)")
    listed = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("rank", "branch", "value"))), lambda x: F.concat_ws("=", x["branch"], x["value"])), "|")
    return long.groupBy("canonical", "property", "kept", "kind").agg(listed.alias("incoming"))


def merged(members: DataFrame, props: list[str], base: str = "base") -> DataFrame:
    """One row per canonical id: base values first, then by branch rank."""
    order = F.struct((F.col("branch") != base).alias("later"), "rank", "id")
    return members.groupBy("canonical").agg(*[F.min_by(p, F.when(F.col(p).isNotNull(), order)).alias(p) for p in props])


def earliest_end(members: DataFrame, end: str = "valid_to") -> DataFrame:
    """Where branches end a row, the earliest end wins; with how many ends were stated."""
    return members.filter(F.col(end).isNotNull()).groupBy("canonical").agg(F.min(end).alias("ends_at"), F.count(F.lit(1)).alias("n_ends"))


def provenance(members: DataFrame, base: str = "base") -> DataFrame:
    """(canonical, role, branch, source_id) without synthetic authors; the role of the row that names the
    entity is canonical, that of the others merged."""
    role = F.when(F.col("id") == F.col("canonical"), "canonical").otherwise("merged").alias("role")
    return members.filter((F.col("branch") != base) & ~F.col("branch").startswith("__")).select("canonical", role, "branch", F.col("id").alias("source_id")).distinct()


def merge_wave(target: DataFrame, wave: DataFrame, key: str, props: list[str], base: str = "base") -> DataFrame:
    """The target (id, <key>, props) with a wave of branch rows (branch, rank, id, <key>, props) merged in: rows
    of one key become one, the target's values first, then the branches' by rank; new keys become new rows."""
    rows = target.select(F.lit(base).alias("branch"), F.lit(-1).alias("rank"), "id", key, *props)
    members = canonical_ids(rows.unionByName(wave.select("branch", F.col("rank").cast("int").alias("rank"), "id", key, *props)), key, base)
    out = merged(members, [key, *props], base)
    return out.select(F.col("canonical").alias("id"), key, *props)


def merge_report(members: DataFrame, edges: DataFrame, props: list[str], base: str = "base") -> DataFrame:
    """One row: merged nodes and edges, resolutions (rows that another id stands for) and conflicts."""
    canon = members.select("id", "canonical").distinct()
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = one(members.select("canonical").distinct(), "nodes")
    for df, name in ((repoint(edges, canon), "edges"), (canon.filter("id <> canonical"), "resolutions"), (conflicts(members, props, base), "conflicts")):
        out = out.crossJoin(one(df, name))  # single rows
    return out


def bylines(sources: DataFrame) -> DataFrame:
    return sources.groupBy("canonical").agg(F.array_join(F.array_sort(F.collect_set("branch")), ",").alias("byline"))


def repoint(edges: DataFrame, canon: DataFrame) -> DataFrame:
    """Edges (from_id, to_id) between canonical ids, without repeats."""
    a = canon.select(F.col("id").alias("from_id"), F.col("canonical").alias("from_canonical"))
    b = canon.select(F.col("id").alias("to_id"), F.col("canonical").alias("to_canonical"))
    e = edges.join(a, "from_id", "left").join(b, "to_id", "left")
    return e.select(F.coalesce("from_canonical", "from_id").alias("from_id"), F.coalesce("to_canonical", "to_id").alias("to_id")).distinct()


def dangling(refs: DataFrame, nodes: DataFrame, ref: str, id: str) -> tuple[DataFrame, DataFrame]:
    """References that resolve and those that do not."""
    on = refs[ref] == nodes[id]
    return refs.join(nodes, on, "left_semi"), refs.join(nodes, on, "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side; empty if both agree as multisets."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
