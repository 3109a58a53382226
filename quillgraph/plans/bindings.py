"""The tables of the test data as graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.graph import EDGE_COLUMNS, NODE_COLUMNS, PropertyGraph, conformed
from quillgraph.plans.staging import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def _node(df: DataFrame, id_: Column, label: Column, kind: str, file: Column, community: Column, base: int, order: Column) -> DataFrame:
    return df.select(id_.alias("id"), label.alias("label"), F.lit(kind).alias("file_type"), file.alias("source_file"), community.cast("int").alias("community"), (order.cast("long") + base).alias("ord"))


def _edge(df: DataFrame, src: Column, dst: Column, relation: str, confidence: Column, weight: Column, base: int) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), confidence.alias("confidence"), weight.cast("double").alias("weight"), F.lit(f"{relation}.tbl").alias("source_file"), F.lit(base).cast("long").alias("ord"))


def places(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Suppliers and customers in nations in regions; a community per region."""
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation")
    region_of = nation.select(F.col("n_nationkey").alias("k"), "n_regionkey")
    nodes = _node(t("region"), key("r", "r_regionkey"), F.col("r_name"), "document", F.lit("geo/regions.md"), F.col("r_regionkey"), 0, F.col("r_regionkey"))
    nodes = nodes.unionByName(_node(nation, key("n", "n_nationkey"), F.col("n_name"), "document", F.lit("geo/nations.md"), F.col("n_regionkey"), 100, F.col("n_nationkey")))
    s = t("supplier").join(F.broadcast(region_of), F.col("s_nationkey") == F.col("k"))  # nations: a fixed, small table
    nodes = nodes.unionByName(_node(s, key("s", "s_suppkey"), F.col("s_name"), "code", F.concat(F.lit("supply/n"), F.col("s_nationkey").cast("string"), F.lit(".py")), F.col("n_regionkey"), 10**9, F.col("s_suppkey")))
    c = t("customer").join(F.broadcast(region_of), F.col("c_nationkey") == F.col("k"))
    nodes = nodes.unionByName(_node(c, key("c", "c_custkey"), F.col("c_name"), "code", F.concat(F.lit("sales/"), F.lower("c_mktsegment"), F.lit(".ts")), F.col("n_regionkey"), 10**12, F.col("c_custkey")))
    sure, one = F.lit("EXTRACTED"), F.lit(1)
    edges = _edge(nation, key("n", "n_nationkey"), key("r", "n_regionkey"), "part_of", sure, one, 0)
    edges = edges.unionByName(_edge(t("supplier"), key("s", "s_suppkey"), key("n", "s_nationkey"), "located_in", sure, one, 1))
    edges = edges.unionByName(_edge(t("customer"), key("c", "c_custkey"), key("n", "c_nationkey"), "located_in", sure, one, 2))
    return PropertyGraph(conformed(nodes, NODE_COLUMNS), conformed(edges, EDGE_COLUMNS), True)


def trade(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Places, and orders that customers place, the parts they call for and the suppliers those depend on."""
    t = lambda n: table(spark, sf_dir, n)
    base = places(spark, sf_dir)
    part, orders, lines = t("part"), t("orders"), t("lineitem")
    nodes = _node(part, key("p", "p_partkey"), F.col("p_name"), "code", F.concat(F.lit("parts/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".ts")), F.col("p_size") % 5, 10**13, F.col("p_partkey"))
    nodes = nodes.unionByName(_node(orders, key("o", "o_orderkey"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), "code", F.concat(F.lit("orders/p"), F.substring("o_orderpriority", 1, 1), F.lit(".go")), F.col("o_custkey") % 5, 10**14, F.col("o_orderkey")))
    edges = _edge(orders, key("o", "o_orderkey"), key("c", "o_custkey"), "placed_by", F.lit("EXTRACTED"), F.lit(1), 3)
    calls = spread(lines.select("l_orderkey", "l_partkey", "l_returnflag"), "l_orderkey", "l_partkey").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"), F.max("l_returnflag").alias("flag"))
    told = F.when(F.col("flag") == "A", "AMBIGUOUS").when(F.col("flag") == "N", "EXTRACTED").otherwise("INFERRED")
    edges = edges.unionByName(_edge(calls, key("o", "l_orderkey"), key("p", "l_partkey"), "calls", told, F.col("n"), 4))
    needs = spread(lines.select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey").distinct()
    edges = edges.unionByName(_edge(needs, key("p", "l_partkey"), key("s", "l_suppkey"), "depends_on", F.lit("EXTRACTED"), F.lit(1), 5))
    return PropertyGraph(base.nodes.unionByName(conformed(nodes, NODE_COLUMNS)), base.edges.unionByName(conformed(edges, EDGE_COLUMNS)), True)


def supply(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations and suppliers only: a forest with a tree per region."""
    g = places(spark, sf_dir)
    return PropertyGraph(g.nodes.where("id not like 'c:%'"), g.edges.where("src not like 'c:%'"), True)


def trade_until(spark: SparkSession, sf_dir: str, day: str, shift: int = 0) -> PropertyGraph:
    """Customers and the orders before a day; ``shift`` moves customers' communities by order count, so that snapshots differ."""
    orders, customers = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(day).cast("timestamp_ntz")), table(spark, sf_dir, "customer")
    active = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = customers.join(active, F.col("c_custkey") == F.col("o_custkey"))
    nodes = _node(c, key("c", "c_custkey"), F.col("c_name"), "code", F.lit("sales/customers.ts"), (F.col("n") + shift) % 5, 0, F.col("c_custkey"))
    nodes = nodes.unionByName(_node(orders, key("o", "o_orderkey"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), "code", F.lit("orders/all.go"), F.col("o_custkey") % 5, 10**12, F.col("o_orderkey")))
    edges = _edge(orders, key("o", "o_orderkey"), key("c", "o_custkey"), "placed_by", F.lit("EXTRACTED"), F.lit(1), 0)
    return PropertyGraph(conformed(nodes, NODE_COLUMNS), conformed(edges, EDGE_COLUMNS), True)


def events(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Users and the types of their events, weighted by count."""
    e = table(spark, sf_dir, "events")
    users = e.select("user_id").distinct()
    kinds = e.select("event_type").distinct()
    nodes = _node(users, key("u", "user_id"), F.concat(F.lit("user"), F.col("user_id").cast("string")), "code", F.lit("users/all.py"), F.col("user_id") % 3, 0, F.col("user_id"))
    nodes = nodes.unionByName(_node(kinds, key("e", "event_type"), F.col("event_type"), "code", F.lit("events/all.py"), F.lit(3), 10**9, F.lit(0)))
    both = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return PropertyGraph(conformed(nodes, NODE_COLUMNS), conformed(_edge(both, key("u", "user_id"), key("e", "event_type"), "fires", F.lit("EXTRACTED"), F.col("n"), 0), EDGE_COLUMNS), True)


def chat(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Turns of conversations, each followed by the next."""
    t = table(spark, sf_dir, "conversations")
    id_ = F.concat(F.lit("t:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    to = F.concat(F.lit("t:"), F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") + 1).cast("string"))
    nodes = _node(t, id_, F.col("role"), "document", F.concat(F.lit("chat/c"), F.col("conv_id").cast("string"), F.lit(".md")), F.col("conv_id") % 7, 0, F.col("conv_id") * 1000 + F.col("turn"))
    ids = nodes.select(F.col("id").alias("dst"))
    edges = _edge(t, id_, to, "follows", F.lit("EXTRACTED"), F.lit(1), 0).join(ids, "dst", "left_semi")
    return PropertyGraph(conformed(nodes, NODE_COLUMNS), conformed(edges, EDGE_COLUMNS), True)


# The same graphs in DuckDB's SQL, for the oracles.

_PLACE_NODES = """
select 'r:' || r_regionkey as id, r_name as label, 'document' as file_type, 'geo/regions.md' as source_file, r_regionkey as community, cast(r_regionkey as bigint) as ord from region
union all select 'n:' || n_nationkey, n_name, 'document', 'geo/nations.md', n_regionkey, 100 + n_nationkey from nation
union all select 's:' || s_suppkey, s_name, 'code', 'supply/n' || s_nationkey || '.py', n_regionkey, 1000000000 + s_suppkey from supplier join nation on s_nationkey = n_nationkey"""
_CUSTOMER_NODES = """
union all select 'c:' || c_custkey, c_name, 'code', 'sales/' || lower(c_mktsegment) || '.ts', n_regionkey, 1000000000000 + c_custkey from customer join nation on c_nationkey = n_nationkey"""
_PLACE_EDGES = """
select 'n:' || n_nationkey as src, 'r:' || n_regionkey as dst, 'part_of' as relation, 'EXTRACTED' as confidence, 1.0::double as weight, 0 as ord from nation
union all select 's:' || s_suppkey, 'n:' || s_nationkey, 'located_in', 'EXTRACTED', 1.0, 1 from supplier"""
_CUSTOMER_EDGES = """
union all select 'c:' || c_custkey, 'n:' || c_nationkey, 'located_in', 'EXTRACTED', 1.0, 2 from customer"""
_TRADE_NODES = """
union all select 'p:' || p_partkey, p_name, 'code', 'parts/' || lower(replace(p_brand, '#', '')) || '.ts', p_size % 5, 10000000000000 + p_partkey from part
union all select 'o:' || o_orderkey, 'Order ' || o_orderkey, 'code', 'orders/p' || substr(o_orderpriority, 1, 1) || '.go', o_custkey % 5, 100000000000000 + o_orderkey from orders"""
_TRADE_EDGES = """
union all select 'o:' || o_orderkey, 'c:' || o_custkey, 'placed_by', 'EXTRACTED', 1.0, 3 from orders
union all select 'o:' || l_orderkey, 'p:' || l_partkey, 'calls', case max(l_returnflag) when 'A' then 'AMBIGUOUS' when 'N' then 'EXTRACTED' else 'INFERRED' end, count(*), 4 from lineitem group by l_orderkey, l_partkey
union all select distinct 'p:' || l_partkey, 's:' || l_suppkey, 'depends_on', 'EXTRACTED', 1.0, 5 from lineitem"""

_DERIVED = """
incident as (select src as id, dst as neighbor from edges union select dst, src from edges),
degrees as (select id, count(*) as degree from incident group by id),
entities as (select * from nodes where source_file <> '' and contains(string_split(source_file, '/')[-1], '.') and label <> string_split(source_file, '/')[-1])"""

SUPPLY = f"with nodes as materialized ({_PLACE_NODES}), edges as materialized ({_PLACE_EDGES}), {_DERIVED}"
PLACES = f"with nodes as materialized ({_PLACE_NODES}{_CUSTOMER_NODES}), edges as materialized ({_PLACE_EDGES}{_CUSTOMER_EDGES}), {_DERIVED}"
TRADE = f"with nodes as materialized ({_PLACE_NODES}{_CUSTOMER_NODES}{_TRADE_NODES}), edges as materialized ({_PLACE_EDGES}{_CUSTOMER_EDGES}{_TRADE_EDGES}), {_DERIVED}"


def snapshots(old: str, new: str) -> str:
    def one(name: str, day: str, shift: int) -> str:
        return f"""
        {name}_orders as (select * from orders where o_orderdate < '{day}'),
        {name}_nodes as (select 'c:' || c_custkey as id, c_name as label, (n + {shift}) % 5 as community from customer join (select o_custkey, count(*) as n from {name}_orders group by 1) on c_custkey = o_custkey
                         union all select 'o:' || o_orderkey, 'Order ' || o_orderkey, o_custkey % 5 from {name}_orders),
        {name}_edges as (select 'o:' || o_orderkey as src, 'c:' || o_custkey as dst, 'placed_by' as relation from {name}_orders)"""

    return f"with {one('old', old, 0)}, {one('new', new, 1)}"
