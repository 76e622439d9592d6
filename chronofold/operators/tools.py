"""Named questions over beliefs: entity lookup, recall, timelines and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_entity(people: DataFrame, organisations: DataFrame, query: str) -> DataFrame:
    """The entity that a name, alias or id means: people first, then organisations, lowest id."""
    q = F.lit(query)
    hit = (F.col("id") == q) | (F.col("name") == q) | F.array_contains("aliases", q)
    of = lambda df, rank, kind: df.filter(hit).select(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), "id", "name")
    return of(people, 0, "Person").unionByName(of(organisations, 1, "Organization")).orderBy("rank", "id").limit(1).select("kind", "id", "name")


def recall(entities: DataFrame, employment: DataFrame, organisations: DataFrame, verified: DataFrame) -> DataFrame:
    """Entities with their employer (lowest organisation id) and whether they are verified."""
    job = employment.groupBy("person_id").agg(F.min("org_id").alias("org_id"))
    names = organisations.select(F.col("id").alias("org_id"), F.col("name").alias("employer"))
    flags = verified.select("person_id").distinct().withColumn("verified", F.lit(True))
    df = entities.join(job, entities["id"] == job["person_id"], "left").drop("person_id").join(names, "org_id", "left")
    return df.join(flags, df["id"] == flags["person_id"], "left").select("id", "name", "employer", F.coalesce("verified", F.lit(False)).alias("verified"))


def believed_at(versions: DataFrame, points: DataFrame, revised: DataFrame, stream: str, offset: str) -> DataFrame:
    """All rows as believed when the stream stood at an offset; empty if the offset has no checkpoint."""
    at = points.filter((F.col("stream") == stream) & (F.col("offset") == offset)).select(F.max("tx").alias("at"))
    return versions.join(F.broadcast(at), (F.col("tx_from") <= F.col("at")) & (F.col("tx_to").isNull() | (F.col("tx_to") > F.col("at")))).filter("not deleted").drop("at")


def resolve_as_of(versions: DataFrame, anchor: Column | int, entity: str = "entity_id") -> DataFrame:
    """The newest version of each entity that covers the anchor (recorded_from, recorded_to)."""
    a = anchor if isinstance(anchor, Column) else F.lit(anchor)
    covers = (F.col("recorded_from") <= a) & (F.col("recorded_to").isNull() | (F.col("recorded_to") > a))
    w = Window.partitionBy(entity).orderBy(F.desc("recorded_from"), F.desc("id"))
    return versions.filter(covers).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def not_yet_known(at: DataFrame, latest: DataFrame, entity: str = "entity_id") -> DataFrame:
    return latest.join(at, entity, "left_anti")


def revised_since(at: DataFrame, latest: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Entities in both whose version differs, with the changed attribute keys and whether the end of
    validity changed; versions that differ in nothing compared are left out."""
    a = at.select(F.col(entity), F.col("id").alias("id_a"), F.col("attributes").alias("attr_a"), F.col("valid_to").alias("to_a"))
    b = latest.select(F.col(entity), F.col("id").alias("id_b"), F.col("attributes").alias("attr_b"), F.col("valid_to").alias("to_b"))
    keys = F.array_distinct(F.concat(F.map_keys("attr_a"), F.map_keys("attr_b")))
    changed = F.array_sort(F.filter(keys, lambda k: ~F.col("attr_a")[k].eqNullSafe(F.col("attr_b")[k])))
    df = a.join(b, entity).filter("id_a <> id_b").select(entity, changed.alias("changed"), (~F.col("to_a").eqNullSafe(F.col("to_b"))).alias("end_changed"))
    return df.filter((F.size("changed") > 0) | F.col("end_changed"))


def anchor_list(points: DataFrame) -> DataFrame:
    """(position, offset, revision) of the anchors that views can be pinned to, by revision: of the checkpoints
    of one revision the last stands for it. Positions are counted per thousand revisions and over these."""
    one = points.groupBy("revision").agg(F.max_by("offset", "tx").alias("offset")).withColumn("slice", F.floor(F.col("revision") / 1000))
    per = one.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("slice", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("slice").orderBy("revision"))
    return one.join(per, "slice").select((F.col("before") + inside - 1).alias("position"), "offset", "revision")


def step_anchor(n_anchors: int, index: int, by: int) -> int:
    """Clamped selection in a list of anchors."""
    return max(0, min(n_anchors - 1, index + by))


def new_edges(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    return after.join(before, keys, "left_anti")


def nth_result(messages: DataFrame, is_result: Column, n: int, order: str) -> DataFrame:
    """The offset after the nth tool result of each stream."""
    w = Window.partitionBy("stream").orderBy(order)
    return messages.filter(is_result).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == n).drop("_n")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def policy(status: Column) -> Column:
    """A decision as a function of a view."""
    return F.when(status == "healthy", "NO_ACTION").otherwise("PAGE_ON_CALL")
