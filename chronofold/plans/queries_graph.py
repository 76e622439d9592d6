"""Pattern queries and constraint reports over the star-schema tables taken as a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators.views import View, batch_once, collect_ordered, prop
from chronofold.plans import constraints
from chronofold.plans.events import FIELDS
from chronofold.plans.registry import query, table


def node_rows(df: DataFrame, kind: str, id: str, **props: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    text = F.to_json(F.struct(*[c.alias(n) for n, c in props.items()])) if props else F.lit("{}")
    return df.select(F.lit(kind).alias("kind"), F.col(id).cast("string").alias("id"), *[none.alias(c) for c in ("from_kind", "from_id", "to_kind", "to_id")], text.alias("props"))


def edge_rows(df: DataFrame, kind: str, start: tuple[str, str], end: tuple[str, str]) -> DataFrame:
    ends = {"from_kind": F.lit(start[0]), "from_id": F.col(start[1]).cast("string"), "to_kind": F.lit(end[0]), "to_id": F.col(end[1]).cast("string")}
    return df.select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("id"), *[c.alias(n) for n, c in ends.items()], F.lit("{}").alias("props")).distinct()


def view(*parts: DataFrame) -> View:
    """A current view of rows that were recorded once, at transaction 0."""
    df = reduce(DataFrame.unionByName, parts)
    nothing = F.lit(None)
    return View(df.select("*", F.lit(1).alias("incarnation"), nothing.cast("timestamp").alias("valid_from"), nothing.cast("timestamp").alias("valid_to"), F.lit(False).alias("deleted"), F.lit(0).alias("tx_from"), nothing.cast("bigint").alias("tx_to")))


def places(spark, sf) -> View:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return view(
        node_rows(c, "Customer", "c_custkey", name=F.col("c_name"), segment=F.col("c_mktsegment")),
        node_rows(n, "Nation", "n_nationkey", name=F.col("n_name")),
        node_rows(r, "Region", "r_regionkey", name=F.col("r_name")),
        edge_rows(c, "inNation", ("Customer", "c_custkey"), ("Nation", "c_nationkey")),
        edge_rows(n, "inRegion", ("Nation", "n_nationkey"), ("Region", "n_regionkey")),
    )


def supply(spark, sf) -> View:
    s, p, l = (table(spark, sf, t) for t in ("supplier", "part", "lineitem"))
    n = table(spark, sf, "nation")
    return view(
        node_rows(s, "Supplier", "s_suppkey", name=F.col("s_name")),
        node_rows(p, "Part", "p_partkey", name=F.col("p_name"), brand=F.col("p_brand")),
        node_rows(n, "Nation", "n_nationkey", name=F.col("n_name")),
        edge_rows(l, "supplies", ("Supplier", "l_suppkey"), ("Part", "l_partkey")),
        edge_rows(s, "at", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey")),
        edge_rows(l, "has", ("Order", "l_orderkey"), ("Part", "l_partkey")),
        node_rows(table(spark, sf, "orders"), "Order", "o_orderkey", status=F.col("o_orderstatus")),
    )


@query("select c_custkey::varchar as id, c_name as name, n_name as nation from customer join nation on c_nationkey = n_nationkey")
def traverse_one_hop(spark: SparkSession, sf: str) -> DataFrame:
    m = places(spark, sf).match("Customer", "c").traverse("inNation", "e", "Nation", "n")
    return m.select(id=F.col("c.id"), name=prop("c", "name"), nation=prop("n", "name"))


@query("select c_custkey::varchar as id, n_name as nation, r_name as region from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_mktsegment = 'BUILDING'")
def traverse_two_hop(spark, sf):
    m = places(spark, sf).match("Customer", "c").where(prop("c", "segment") == "BUILDING").traverse("inNation", "e", "Nation", "n").traverse("inRegion", "f", "Region", "r")
    return m.select(id=F.col("c.id"), nation=prop("n", "name"), region=prop("r", "name"))


@query("""select a.s_suppkey::varchar as a, b.s_suppkey::varchar as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey and b.s_suppkey - a.s_suppkey <= 10""")
def self_kind_traverse(spark, sf):
    """Suppliers joined to suppliers by a self-kind edge (neighbours in key order of one nation)."""
    s = table(spark, sf, "supplier")
    t = s.select(F.col("s_suppkey").alias("other"), F.col("s_nationkey").alias("on"))
    near = s.join(t, (F.col("s_nationkey") == F.col("on")) & (F.col("other") > F.col("s_suppkey")) & (F.col("other") - F.col("s_suppkey") <= 10))
    v = view(node_rows(s, "Supplier", "s_suppkey"), edge_rows(near, "near", ("Supplier", "s_suppkey"), ("Supplier", "other")))
    return v.match("Supplier", "a").traverse("near", "e", "Supplier", "b").select(a=F.col("a.id"), b=F.col("b.id"))


@query("""select s_suppkey::varchar as id, string_agg(p_name || '#' || p_partkey, '|' order by p_name, p_partkey::varchar) as parts, count(*)::bigint as n
from (select distinct l_suppkey, l_partkey from lineitem) join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey group by 1""")
def group_collect_ordered(spark, sf):
    m = supply(spark, sf).match("Supplier", "s").traverse("supplies", "e", "Part", "p")
    one = F.concat_ws("#", prop("p", "name"), F.col("p.id"))
    return m.group_by(F.col("s.id").alias("id")).agg(F.array_join(collect_ordered(one, prop("p", "name"), F.col("p.id")), "|").alias("parts"), F.count(F.lit(1)).alias("n"))


@query("select count(*)::bigint as n from (select distinct l_suppkey, l_partkey from lineitem) join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey")
def match_count(spark, sf):
    return supply(spark, sf).match("Supplier", "s").traverse("supplies", "e", "Part", "p").count()


@query("select n_name as nation, count(*)::bigint as n from customer join nation on c_nationkey = n_nationkey group by 1")
def reverse_traverse(spark, sf):
    m = places(spark, sf).match("Nation", "n").traverse("inNation", "e", "Customer", "c", reverse=True)
    return m.group_by(prop("n", "name").alias("nation")).agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey::varchar as id, c_name as name from customer where c_custkey = 42 or c_name = 'Customer#000000077' or c_custkey in (7, 9)")
def where_or_contains(spark, sf):
    """Equality, disjunction and membership in an array."""
    m = places(spark, sf).match("Customer", "c").where((F.col("c.id") == "42") | (prop("c", "name") == "Customer#000000077") | F.array_contains(F.array(F.lit("7"), F.lit("9")), F.col("c.id")))
    return m.select(id=F.col("c.id"), name=prop("c", "name"))


@query("select c_custkey::varchar as id, c_name as name from customer where c_mktsegment = 'MACHINERY' order by c_name, c_custkey::varchar limit 1")
def order_limit(spark, sf):
    m = places(spark, sf).match("Customer", "c").where(prop("c", "segment") == "MACHINERY")
    return m.select(id=F.col("c.id"), name=prop("c", "name")).orderBy("name", "id").limit(1)


@query("select p_partkey::varchar as id, p_name as name from part where p_partkey = 17")
def get_by_id(spark, sf):
    return supply(spark, sf).node("Part", "17").select("id", F.get_json_object("props", "$.name").alias("name"))


@query("select distinct l_suppkey::varchar as from_id, l_partkey::varchar as to_id from lineitem where l_suppkey = 3 and l_partkey = (select min(l_partkey) from lineitem where l_suppkey = 3)")
def find_by_endpoints(spark, sf):
    first = table(spark, sf, "lineitem").filter("l_suppkey = 3").agg(F.min("l_partkey")).first()[0]
    return supply(spark, sf).edge("supplies", ("Supplier", "3"), ("Part", str(first))).select("from_id", "to_id")


@query("select p_partkey::varchar as id, (select count(*) from part where p_partkey::varchar > '1500') > 25 as has_next from part where p_partkey::varchar > '1500' order by p_partkey::varchar limit 25")
def keyset_page(spark, sf):
    return supply(spark, sf).page("Part", "1500", 25).select("id", "has_next")


@query("select l_suppkey::varchar as id, count(distinct l_partkey)::bigint as n from lineitem group by 1")
def count_neighbours(spark, sf):
    return supply(spark, sf).neighbours("supplies", "Supplier")


@query("select distinct l_suppkey::varchar as from_id, l_partkey::varchar as to_id from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey where s_acctbal > 0 and p_size <= 25")
def subgraph(spark, sf):
    """Edges among suppliers with a balance and parts of the smaller sizes."""
    a = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.lit("Supplier").alias("kind"), F.col("s_suppkey").cast("string").alias("id"))
    b = table(spark, sf, "part").filter("p_size <= 25").select(F.lit("Part").alias("kind"), F.col("p_partkey").cast("string").alias("id"))
    return supply(spark, sf).subgraph(a.unionByName(b))[1].filter("kind = 'supplies'").select("from_id", "to_id")


@query("select 'Customer' as kind, count(*)::bigint as n from customer union all select 'Nation', count(*) from nation union all select 'inNation', count(*) from customer")
def batch_queries(spark, sf):
    """Three questions over one cached snapshot, as tagged rows."""
    n = F.count(F.lit(1)).alias("n")
    parts = batch_once(places(spark, sf), {k: (lambda v, k=k: (v.edges(k) if k == "inNation" else v.nodes(k)).agg(n).select(F.lit(k).alias("kind"), "n")) for k in ("Customer", "Nation", "inNation")})
    return reduce(DataFrame.unionByName, parts.values())


def line_events(spark, sf) -> DataFrame:
    """Orders and line items as events in key order: an order node per o_orderkey at tx = key (every 50th is
    never created, every 60th is removed at the end), then its edges to suppliers."""
    none = F.lit(None)
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")

    def rows(df, tx, change, op, kind, **given):
        cols = {"op": F.lit(op), "kind": F.lit(kind), "props": F.lit("{}"), "clear_valid_to": F.lit(False), **given}
        typed = {"valid_from": "timestamp", "valid_to": "timestamp"}
        return df.select(tx.cast("bigint").alias("tx"), change.cast("bigint").alias("change_ix"), F.lit(0).alias("event_ix"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("tx_wall"), *[cols.get(f, none.cast(typed.get(f, "string"))).alias(f) for f in FIELDS])

    orders = rows(o.filter("o_orderkey % 50 <> 0"), F.col("o_orderkey") * 2, F.lit(0), "node.upsert", "Order", id=F.col("o_orderkey").cast("string"))
    suppliers = rows(table(spark, sf, "supplier"), F.lit(-1), F.col("s_suppkey"), "node.upsert", "Supplier", id=F.col("s_suppkey").cast("string"))
    pairs = l.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("line"))
    ends = {"from_kind": F.lit("Order"), "from_id": F.col("l_orderkey").cast("string"), "to_kind": F.lit("Supplier"), "to_id": F.col("l_suppkey").cast("string")}
    edges = rows(pairs, F.col("l_orderkey") * 2 + 1, F.col("line") * 1000 + F.col("l_suppkey"), "edge.upsert", "servedBy", **ends)
    gone = rows(o.filter("o_orderkey % 60 = 0 and o_orderkey % 50 <> 0"), F.lit(1_000_000_000), F.col("o_orderkey"), "node.remove", "Order", id=F.col("o_orderkey").cast("string"))
    return orders.unionByName(suppliers).unionByName(edges).unionByName(gone)


@query("select distinct l_orderkey::varchar as from_id, l_suppkey::varchar as to_id from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 50 <> 0) or l_suppkey not in (select s_suppkey from supplier)")
def missing_endpoints(spark, sf):
    return constraints.missing_endpoints(line_events(spark, sf)).select("from_id", "to_id").distinct()


@query("select l_orderkey::varchar as id, count(distinct l_suppkey)::bigint as live_edges from lineitem where l_orderkey in (select o_orderkey from orders where o_orderkey % 60 = 0 and o_orderkey % 50 <> 0) group by 1")
def restricted_deletes(spark, sf):
    return constraints.restricted_deletes(line_events(spark, sf)).select("id", "live_edges")


@query("""with p as (select l_orderkey, l_suppkey, min(l_linenumber) as line from lineitem group by all)
select l_orderkey::varchar as from_id, l_suppkey::varchar as to_id, n::bigint as n_live from (select *, row_number() over (partition by l_orderkey order by line * 1000 + l_suppkey) as n from p) where n > 1""")
def cardinality_violations(spark, sf):
    return constraints.cardinality_violations(line_events(spark, sf), ["servedBy"]).select("from_id", "to_id", "n_live")


@query("select lower(c_mktsegment || c_nationkey || '-' || c_custkey % 200) as value, count(*)::bigint as n, min(c_custkey::varchar) as first_id from customer group by 1 having count(*) > 1")
def unique_violations(spark, sf):
    c = table(spark, sf, "customer").withColumn("k", F.concat(F.col("c_mktsegment"), F.col("c_nationkey").cast("string"), F.lit("-"), (F.col("c_custkey") % 200).cast("string")))
    v = view(node_rows(c, "Customer", "c_custkey", k=F.col("k")))
    return constraints.unique_violations(v.df, "Customer", F.get_json_object("props", "$.k"))
