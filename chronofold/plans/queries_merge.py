"""Queries on resolution, merge, provenance and support."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators import resolve, support
from chronofold.plans.registry import query, table


def members(spark, sf) -> DataFrame:
    """Customers in two branches by parity of their order count; a key groups them across branches. Branch
    b rounds balances, and is the later branch; keys that end in 7 are in the base already."""
    c = table(spark, sf, "customer")
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    c = c.join(n, F.col("c_custkey") == F.col("k"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    branch = F.when(F.col("c_custkey") % 200 == 7, "base").when(F.col("n") % 2 == 0, "a").otherwise("b")
    key = F.concat(F.when(F.col("n") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")), (F.col("c_custkey") % 200).cast("string"))
    rank = F.when(branch == "base", 0).when(branch == "a", 1).otherwise(2)
    return c.select(branch.alias("branch"), rank.alias("rank"), F.col("c_custkey").alias("id"), key.alias("key"), F.col("c_nationkey").cast("string").alias("nation"), F.floor(F.col("c_acctbal") / 1000).cast("bigint").cast("string").alias("level"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") * 7 % 1000).alias("valid_to"))


_MEMBERS = """with n as (select o_custkey, count(*) as n from orders group by 1),
m0 as (select c_custkey as id, coalesce(n, 0) as n, * exclude (n) from customer left join n on o_custkey = c_custkey),
m as (select id, case when id % 200 = 7 then 'base' when n % 2 = 0 then 'a' else 'b' end as branch, case when id % 200 = 7 then 0 when n % 2 = 0 then 1 else 2 end as rank,
  lower(c_mktsegment) || (id % 200) as lkey, c_nationkey::varchar as nation, floor(c_acctbal / 1000)::bigint::varchar as level, case when id % 3 = 0 then id * 7 % 1000 end as valid_to from m0),
c as (select *, first_value(id) over (partition by lkey order by rank, id) as canonical from m)"""


@query(_MEMBERS + " select id, canonical from c")
def unique_key_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.canonical_ids(members(spark, sf), "key").select("id", "canonical")


@query(_MEMBERS + """, l as (select canonical, branch, rank, 'nation' as property, nation as value from c union select canonical, branch, rank, 'level', level from c),
k as (select *, first_value(value) over (partition by canonical, property order by rank, value) as kept from l),
d as (select *, first_value(branch) over (partition by canonical, property order by rank, value) <> 'base' as among, min(value) over (partition by canonical, property) <> max(value) over (partition by canonical, property) as differ from k)
select canonical, property, kept, case when among then 'branch-branch' else 'base-branch' end as kind, string_agg(branch || '=' || value, '|' order by rank, branch, value) as incoming from d where differ and (among or value <> kept) group by all""")
def property_conflicts(spark, sf):
    return resolve.conflicts(resolve.canonical_ids(members(spark, sf), "key"), ["nation", "level"])


@query(_MEMBERS + " select canonical, arg_min(nation, (rank, id)) as nation, arg_min(level, (rank, id)) as level from c group by 1")
def merged_entities(spark, sf):
    return resolve.merged(resolve.canonical_ids(members(spark, sf), "key"), ["nation", "level"])


@query(_MEMBERS + " select canonical, min(valid_to) as ends_at, count(*)::bigint as n_ends from c where valid_to is not null group by 1")
def earliest_end_wins(spark, sf):
    return resolve.earliest_end(resolve.canonical_ids(members(spark, sf), "key"))


@query(_MEMBERS + " select distinct canonical, case when id = canonical then 'canonical' else 'merged' end as role, branch, id as source_id from c where branch <> 'base'")
def provenance_rows(spark, sf):
    return resolve.provenance(resolve.canonical_ids(members(spark, sf), "key"))


@query(_MEMBERS + " select canonical, string_agg(distinct branch, ',' order by branch) as byline from c where branch <> 'base' group by 1")
def bylines(spark, sf):
    return resolve.bylines(resolve.provenance(resolve.canonical_ids(members(spark, sf), "key")))


@query(_MEMBERS + " select count(distinct canonical)::bigint as nodes, count(*) filter (where id <> canonical)::bigint as resolutions from c")
def merge_counts(spark, sf):
    m = resolve.canonical_ids(members(spark, sf), "key")
    return m.agg(F.countDistinct("canonical").alias("nodes"), F.count(F.when(F.col("id") != F.col("canonical"), 1)).alias("resolutions"))


@query(_MEMBERS + " select distinct coalesce(canonical, o_custkey)::varchar as from_id, 'o' || o_orderkey as to_id from orders left join c on id = o_custkey")
def repointed_edges(spark, sf):
    canon = resolve.canonical_ids(members(spark, sf), "key").select(F.col("id").cast("string"), F.col("canonical").cast("string"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("from_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("to_id"))
    return resolve.repoint(orders, canon)


@query("""with recursive p as (select p_partkey as id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda t: t <> ''))) as t from part),
k as (select t, min(id) as id from p where len(t) > 0 group by 1),
e as (select a.id as a, b.id as b from k a join k b on a.id <> b.id where len(list_intersect(a.t, b.t)) >= 0.5 * len(list_distinct(a.t || b.t)) - 1e-9),
r(a, b) as (select id, id from k union select r.a, e.b from r join e on r.b = e.a),
m as (select a, min(b) as canonical from r group by 1)
select p.id, coalesce(canonical, p.id) as canonical from p left join k using (t) left join m on m.a = k.id""")
def fulltext_resolution(spark, sf):
    """Parts clustered by token-set similarity of their names (0.5), copies through their class."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    pairs = resolve.similar_pairs(part, "id", "name", 0.5)
    classes = part.withColumn("t", F.array_sort(resolve.tokens("name"))).groupBy("t").agg(F.min("id").alias("rep"))
    canon = resolve.cluster(classes.select(F.col("rep").alias("id")), pairs)
    named = part.withColumn("t", F.array_sort(resolve.tokens("name"))).join(classes, "t").select("id", "rep")
    return named.join(canon.withColumnRenamed("id", "rep"), "rep").select("id", "canonical")


@query("""with n as (select user_id, lower(trim(' Svc' || (user_id % 40) || case user_id % 4 when 0 then '-svc' when 1 then '.prod' when 2 then '-svc.prod' else '' end || ' ')) as raw from events)
select distinct raw, regexp_replace(raw, '^(.+?)(?:-svc|\\.prod)+$', '\\1') as service from n""")
def service_identity(spark, sf):
    u = F.col("user_id")
    tail = F.when(u % 4 == 0, "-svc").when(u % 4 == 1, ".prod").when(u % 4 == 2, "-svc.prod").otherwise("")
    df = table(spark, sf, "events").select(F.concat(F.lit(" Svc"), (u % 40).cast("string"), tail, F.lit(" ")).alias("name"))
    return df.select(resolve.normal_key("name").alias("raw"), resolve.strip_suffixes("name", ["-svc", ".prod"]).alias("service")).distinct()


@query("""select user_id, string_agg(event_type, ',' order by first_at) as aliases from (select user_id, event_type, min(event_id) as first_at from events group by all) group by 1""")
def alias_fold(spark, sf):
    df = resolve.fold_aliases(table(spark, sf, "events"), "user_id", "event_type", "event_id")
    return df.select("user_id", F.array_join("aliases", ",").alias("aliases"))


@query("""with a(concept, alias, alias_ix) as (values ('article', 'the ', 0), ('article', 'der ', 1), ('verb', ' IS ', 0), ('verb', 'est', 1), ('link', ' and ', 0))
select doc_id, concept, arg_min(alias, alias_ix) as matched from documents join a on contains(lower(text), lower(alias)) group by all""")
def alias_extraction(spark, sf):
    """Concepts mentioned in documents, by the first alias that matches."""
    rows = [("article", "the ", 0), ("article", "der ", 1), ("verb", " IS ", 0), ("verb", "est", 1), ("link", " and ", 0)]
    aliases = spark.createDataFrame(rows, "concept string, alias string, alias_ix int")
    return resolve.first_alias(table(spark, sf, "documents").select("doc_id", "text"), aliases, "text").select("doc_id", "concept", "matched")


@query("select doc_id, doc_id * 3 % 2000 in (select doc_id from documents) as resolved from documents")
def dangling_refs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    refs = d.select("doc_id", (F.col("doc_id") * 3 % 2000).alias("ref"))
    ok, bad = resolve.dangling(refs, d.select(F.col("doc_id").alias("target")), "ref", "target")
    return ok.select("doc_id", F.lit(True).alias("resolved")).unionByName(bad.select("doc_id", F.lit(False).alias("resolved")))


@query("select 'type:' || event_type || event_id::varchar as event_type, case event_id % 7 when 0 then 'left' else 'right' end as side from events where event_id % 7 in (0, 1)")
def convergence_check(spark, sf):
    """Two decoders of one log, of which the first misses some events and the second others."""
    e = table(spark, sf, "events")
    a = e.filter("event_id % 7 <> 1").select(F.concat(F.lit("type:"), F.lower("event_type"), F.col("event_id").cast("string")).alias("event_type"))
    b = e.filter("event_id % 7 <> 0").withColumn("x", F.split(F.concat(F.lit("TYPE|"), F.col("event_type")), r"\|")).select(F.concat(F.lower(F.col("x")[0]), F.lit(":"), F.lower(F.col("x")[1]), F.col("event_id").cast("string")).alias("event_type"))
    return resolve.same_rows(a, b)


def beliefs(spark, sf):
    """Suppliers are sources (every fifth retracted in the second state); a part is derived once per
    supplier that carries it; an order needs all its parts."""
    l = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey").distinct()
    sources = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source"), F.lit(False).alias("retracted"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    carry = l.select(F.concat(name("j", "l_suppkey"), name("_", "l_partkey")).alias("justification"), name("s", "l_suppkey").alias("premise"), F.lit("source").alias("premise_kind"), name("p", "l_partkey").alias("fact")).distinct()
    order = l.select(name("jo", "l_orderkey").alias("justification"), name("p", "l_partkey").alias("premise"), F.lit("fact").alias("premise_kind"), name("o", "l_orderkey").alias("fact")).distinct()
    every = carry.unionByName(order)
    return sources, every.select("justification", "premise", "premise_kind"), every.select("justification", "fact").distinct()


def _gone(sources: DataFrame) -> DataFrame:
    return sources.filter(F.substring("source", 2, 20).cast("bigint") % 5 != 0).select("source")


_HELD = """with l as (select distinct l_suppkey, l_partkey, l_orderkey from lineitem), live as (select s_suppkey from supplier where s_suppkey % 5 = 0),
p as (select l_partkey, bool_or(l_suppkey in (select s_suppkey from live)) as held, bool_or(l_suppkey in (select s_suppkey from supplier)) as before, bool_or(l_suppkey not in (select s_suppkey from live)) as hurt from l group by 1),
o as (select l_orderkey, bool_and(held) as held, bool_and(before) as before from (select distinct l_orderkey, l_partkey from l) join p using (l_partkey) group by 1)"""


@query(_HELD + " select 'p' || l_partkey as fact from p where held union all select 'o' || l_orderkey from o where held")
def holding(spark, sf):
    """Facts that hold after four of five suppliers are retracted."""
    sources, premises, derives = beliefs(spark, sf)
    return support.holding(support.retract(sources, _gone(sources)), premises, derives)


@query(_HELD + """, f as (select 'p' || l_partkey as fact, before, held, hurt from p union all select 'o' || l_orderkey, before, held, false from o)
select fact, case when before and not held then 'died' when held and hurt then 'survived' when held then 'unaffected' else 'not held' end as outcome from f""")
def retract_cascade(spark, sf):
    sources, premises, derives = beliefs(spark, sf)
    return support.report(sources, support.retract(sources, _gone(sources)), premises, derives)


@query(_HELD + """ select 'p' || l_partkey as fact, 'revived' as outcome from p where before and not held union all select 'o' || l_orderkey, 'revived' from o where before and not held""")
def un_retract(spark, sf):
    """Parts and orders that come back when the retraction is undone."""
    sources, premises, derives = beliefs(spark, sf)
    return support.report(support.retract(sources, _gone(sources)), sources, premises, derives).filter("outcome = 'revived'")


@query(_HELD + """ select 'p' || l_partkey as fact, 'j' || l_suppkey || '_' || l_partkey as justification, 's' || l_suppkey as source, l_suppkey % 5 <> 0 as retracted, held as currently_held
from (select distinct l_suppkey, l_partkey from l) join p using (l_partkey) where l_partkey = 25""")
def why_supported(spark, sf):
    """The explanation of a fact lists retracted sources too."""
    sources, premises, derives = beliefs(spark, sf)
    changed = support.retract(sources, _gone(sources))
    return support.explain("p25", changed, premises, derives, support.holding(changed, premises, derives))


@query("select user_id::varchar as source, bool_or(event_type = 'error') as retracted, arg_max(event_type, event_id) as label from events group by 1")
def sticky_retraction(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("source"), (F.col("event_type") == "error").alias("retracted"), F.col("event_type").alias("label"), F.col("event_id").alias("at"))
    return support.sticky(e)


@query("""select distinct 'j:claim' || o_custkey || ':' || case when o_orderkey % 7 = 0 then 'claim:' else 'src:' end || o_orderkey % 13 as justification, case when o_orderkey % 7 = 0 then 'claim:' else 'src:' end || o_orderkey % 13 as premise,
case when o_orderkey % 7 = 0 then 'fact' else 'source' end as premise_kind from orders""")
def justification_scaffold(spark, sf):
    ref = F.concat(F.when(F.col("o_orderkey") % 7 == 0, "claim:").otherwise("src:"), (F.col("o_orderkey") % 13).cast("string"))
    claims = table(spark, sf, "orders").groupBy(F.concat(F.lit("claim"), F.col("o_custkey").cast("string")).alias("fact")).agg(F.collect_set(ref).alias("sources"))
    return support.scaffold(claims)[0]
