"""Justification-based support: least fixpoint, retraction reports and explanations.

premises(justification, premise, premise_kind 'source' | 'fact'), derives(justification, fact),
sources(source, retracted). A fact holds if one of its justifications has all its premises, at least one,
holding; a source holds unless retracted. Cycles cannot hold themselves. Each round only looks at what the
last round added (semi-naive): unmet premises are counted down per justification.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions.shared import checkpoint


#: So many rounds' rows are read side by side before they are written as one.
PARTS = 16


def _gathered(parts: list[DataFrame]) -> list[DataFrame]:
    return [checkpoint(reduce(DataFrame.unionByName, parts))] if len(parts) > PARTS else parts


def prepared(premises: DataFrame, derives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What `holding` needs to know whatever is retracted, written once for several states of the sources: distinct
    premises, and derived facts with the number of premises and whether these wait for facts."""
    pairs = checkpoint(premises.select("justification", "premise", "premise_kind").distinct())
    waits = F.coalesce(F.max(F.col("premise_kind") == "fact"), F.lit(False))
    totals = pairs.groupBy("justification").agg(F.count(F.lit(1)).alias("total"), waits.alias("waits"))
    return pairs, checkpoint(derives.select("justification", "fact").join(totals, "justification"))


def holding(sources: DataFrame, premises: DataFrame, derives: DataFrame, ready: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(fact) of all facts that hold. Rounds write what they add and no more: the premises that came to hold, by
    justification, and the new facts; justifications that wait for facts are looked up, not rewritten. `ready`:
    what `prepared` made of these premises and derives."""
    pairs, needs = ready or prepared(premises, derives)
    live = sources.filter("not coalesce(retracted, false)").select(F.col("source").alias("premise")).distinct()
    ok = pairs.filter("premise_kind = 'source'").join(live, "premise", "left_semi").groupBy("justification").agg(F.count(F.lit(1)).alias("ok"))
    derived = needs.join(ok, "justification", "left").select("justification", "fact", (F.col("total") - F.coalesce("ok", F.lit(0))).alias("left"), "waits")
    if pairs.filter("premise_kind = 'fact'").isEmpty():
        return derived.filter("left = 0").select("fact").distinct()
    derived = checkpoint(derived.filter("left = 0 or waits"))
    by_fact = pairs.filter("premise_kind = 'fact'").select("justification", F.col("premise").alias("fact"))
    new = checkpoint(derived.filter("left = 0").select("fact").distinct())
    held, counts = [new], []
    while not new.isEmpty():
        hits = checkpoint(by_fact.join(new, "fact", "left_semi").groupBy("justification").agg(F.count(F.lit(1)).alias("hit")))
        earlier = [c.join(hits, "justification", "left_semi") for c in counts]
        met = reduce(DataFrame.unionByName, [hits, *earlier]).groupBy("justification").agg(F.sum("hit").alias("hit"))
        done = derived.filter("left > 0").join(met, "justification").filter("hit = left").select("fact").distinct()
        new = checkpoint(done.join(reduce(DataFrame.unionByName, held), "fact", "left_anti"))
        held, counts = _gathered([*held, new]), _gathered([*counts, hits])
    return reduce(DataFrame.unionByName, held)


def retract(sources: DataFrame, ids: DataFrame, retracted: bool = True) -> DataFrame:
    """Sources with the given (source) flagged or unflagged."""
    hit = ids.select("source").distinct().withColumn("hit", F.lit(True))
    return sources.join(hit, "source", "left").select(*[F.when(F.col("hit"), F.lit(retracted)).otherwise(F.coalesce("retracted", F.lit(False))).alias("retracted") if c == "retracted" else F.col(c) for c in sources.columns])


def supported_justifications(sources: DataFrame, premises: DataFrame, held: DataFrame) -> DataFrame:
    """(justification) whose premises all hold."""
    live = sources.filter("not coalesce(retracted, false)").select(F.col("source").alias("premise"), F.lit("source").alias("premise_kind"))
    live = live.unionByName(held.select(F.col("fact").alias("premise"), F.lit("fact").alias("premise_kind"))).distinct().withColumn("ok", F.lit(True))
    return premises.join(live, ["premise", "premise_kind"], "left").groupBy("justification").agg(F.min(F.coalesce("ok", F.lit(False))).alias("ok")).filter("ok").select("justification")


def report(sources: DataFrame, changed: DataFrame, premises: DataFrame, derives: DataFrame) -> DataFrame:
    """(fact, outcome): died, revived, survived (lost a justification, still holds) or unaffected."""
    ready = prepared(premises, derives)
    before, after = (checkpoint(holding(s, premises, derives, ready)) for s in (sources, changed))
    lost = supported_justifications(sources, premises, before).join(supported_justifications(changed, premises, after), "justification", "left_anti")
    hurt = lost.join(derives, "justification").select("fact").distinct().withColumn("hurt", F.lit(True))
    b, a = before.withColumn("b", F.lit(True)), after.withColumn("a", F.lit(True))
    df = derives.select("fact").distinct().join(b, "fact", "left").join(a, "fact", "left").join(hurt, "fact", "left").fillna(False, ["b", "a", "hurt"])
    outcome = F.when(F.col("b") & ~F.col("a"), "died").when(~F.col("b") & F.col("a"), "revived").when(F.col("a") & F.col("hurt"), "survived").when(F.col("a"), "unaffected").otherwise("not held")
    return df.select("fact", outcome.alias("outcome"))


def turned(before: DataFrame, after: DataFrame) -> DataFrame:
    """(fact, outcome) of the facts that died or revived between two sets of held facts: the rows of `report` that
    change a belief, without another look at justifications."""
    died = before.join(after, "fact", "left_anti").select("fact", F.lit("died").alias("outcome"))
    return died.unionByName(after.join(before, "fact", "left_anti").select("fact", F.lit("revived").alias("outcome")))


def explain(fact: str, sources: DataFrame, premises: DataFrame, derives: DataFrame, held: DataFrame) -> DataFrame:
    """Why a fact is or was believed: its justifications and sources, retracted ones too."""
    why = derives.filter(F.col("fact") == fact).join(premises.filter("premise_kind = 'source'"), "justification")
    why = why.join(sources, F.col("premise") == F.col("source")).select("fact", "justification", "source", F.coalesce("retracted", F.lit(False)).alias("retracted"))
    now = held.withColumn("currently_held", F.lit(True))
    return why.join(now, "fact", "left").withColumn("currently_held", F.coalesce("currently_held", F.lit(False)))


def sticky(reports: DataFrame, source: str = "source", order: str = "at") -> DataFrame:
    """Re-reporting a source does not undo its retraction: once flagged, it stays so."""
    return reports.groupBy(source).agg(F.max(F.coalesce("retracted", F.lit(False))).alias("retracted"), F.max_by("label", order).alias("label"))


def scaffold(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims (fact, sources array) to one justification per premise: (premises, derives)."""
    each = claims.select("fact", F.explode("sources").alias("premise")).distinct()
    j = F.concat_ws(":", F.lit("j"), "fact", "premise").alias("justification")
    kind = F.when(F.col("premise").startswith("claim:"), "fact").otherwise("source").alias("premise_kind")
    return each.select(j, "premise", kind), each.select(j, "fact")


def sources_of(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(source, retracted, source_kind) from several kinds of sources, each a table with its id column and the
    column that flags a retraction."""
    parts = [df.select(F.col(id).cast("string").alias("source"), F.coalesce(F.col(flag), F.lit(False)).alias("retracted"), F.lit(kind).alias("source_kind")) for kind, (df, id, flag) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def terminal_facts(premises: DataFrame, derives: DataFrame) -> DataFrame:
    """(fact) of derived facts that are no premise of anything."""
    used = premises.filter("premise_kind = 'fact'").select(F.col("premise").alias("fact"))
    return derives.select("fact").distinct().join(used, "fact", "left_anti")


def belief_changes(reports: dict[int, DataFrame]) -> DataFrame:
    """(fact, revision, holds) rows that reports write at their recorded revisions: a fact that died is deleted
    softly, one that revived is current again; all others keep their row."""
    parts = [df.filter("outcome in ('died', 'revived')").select("fact", F.lit(r).cast("long").alias("revision"), (F.col("outcome") == "revived").alias("holds")) for r, df in reports.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def beliefs_at(first: DataFrame, changes: DataFrame, revision: int) -> DataFrame:
    """(fact) held as recorded at a revision: `first` at revision 0, then the changes up to it."""
    rows = first.select("fact", F.lit(0).cast("long").alias("revision"), F.lit(True).alias("holds")).unionByName(changes.filter(F.col("revision") <= revision))
    return rows.groupBy("fact").agg(F.max_by("holds", "revision").alias("holds")).filter("holds").select("fact")
