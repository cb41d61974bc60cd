"""Facet tables (one row for each element of a collection) from the star schema, and the same in SQL.

Every facet names its key in a column, so that an operator works on all keys at once. Expiry is a nullable epoch in milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, value, n (a number as text), expire_at: a third of the keys expire."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("cust:"), "c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), F.col("c_custkey").cast("string").alias("n"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") * 1000).alias("expire_at"))


def lst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, pos (from 0), elem."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("order:"), "l_orderkey").alias("key"), (F.row_number().over(w) - 1).cast("long").alias("pos"), (F.col("l_partkey") % 7).cast("string").alias("elem"))


def hsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, field, value."""
    o = table(spark, sf_dir, "orders")
    fields = {"cust": F.col("o_custkey").cast("string"), "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "total": F.floor("o_totalprice").cast("string")}
    pairs = F.array(*(F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items()))
    return o.select(F.concat(F.lit("order:"), "o_orderkey").alias("key"), F.inline(pairs))


def st(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key (supplier), member (part)."""
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("supp:"), "l_suppkey").alias("key"), F.col("l_partkey").cast("string").alias("member")).distinct()


def zs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key (nation), member (customer), score."""
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("nation:"), "c_nationkey").alias("key"), F.concat(F.lit("c"), "c_custkey").alias("member"), F.col("c_acctbal").alias("score"))


def zq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key (supplier), member (part), score (quantity): sets that overlap."""
    return table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("supp:"), "l_suppkey").alias("key"), F.col("l_partkey").cast("string").alias("member")).agg(F.sum("l_quantity").alias("score"))


def bm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key (event type), offset of a set bit (minute since 2024 began)."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), (F.floor(millis("ts") / 60000) - MINUTE).alias("offset")).distinct()


def millis(ts: str) -> F.Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series (event type), ts_ms, value, event_id (arrival order)."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), millis("ts").alias("ts_ms"), "value", "event_id")


def xs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key (event type), ms, seq, user_id, value."""
    w = Window.partitionBy("event_type", "ms").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("ms", millis("ts"))
    return e.select(F.col("event_type").alias("key"), "ms", (F.row_number().over(w) - 1).cast("long").alias("seq"), "user_id", "value")


def js(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, doc: JSON of an order with a nested object, an array and a flag."""
    o = table(spark, sf_dir, "orders")
    doc = F.concat(
        F.lit('{"cust":'), "o_custkey", F.lit(',"flag":'), F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("false"), F.lit(',"name":"'), "o_orderpriority",
        F.lit('","tags":["'), "o_orderstatus", F.lit('","x","'), "o_orderstatus", F.lit('"],"sub":{"a":'), F.col("o_orderkey") % 10, F.lit(',"b":null}}'),
    )
    return o.select(F.concat(F.lit("doc:"), "o_orderkey").alias("key"), doc.alias("doc"))


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, member, lon, lat: places from key arithmetic."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.lit("places").alias("key"), F.concat(F.lit("c"), "c_custkey").alias("member"), ((F.col("c_custkey") * 37 % 36000) / 100.0 - 180).alias("lon"), ((F.col("c_custkey") * 53 % 17000) / 100.0 - 85).alias("lat"))


def vs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key (label), name, id, v (array of double)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("string").alias("key"), F.col("vec_id").alias("id"), F.concat(F.lit("v"), "vec_id").alias("name"), F.col("embedding").cast("array<double>").alias("v"))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, props) and edges (src, dst, rel): customers, nations and regions, and what customers ordered from suppliers' nations."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    node = lambda df, label, key, props: df.select(F.concat(F.lit(f"{label}:"), key).alias("id"), F.lit(label).alias("label"), props.alias("name"))
    nodes = node(c, "customer", "c_custkey", F.col("c_name")).unionByName(node(n, "nation", "n_nationkey", F.col("n_name"))).unionByName(node(r, "region", "r_regionkey", F.col("r_name")))
    edge = lambda df, a, x, b, y, rel: df.select(F.concat(F.lit(f"{a}:"), x).alias("src"), F.concat(F.lit(f"{b}:"), y).alias("dst"), F.lit(rel).alias("rel"))
    edges = edge(c, "customer", "c_custkey", "nation", "c_nationkey", "LIVES_IN").unionByName(edge(n, "nation", "n_nationkey", "region", "n_regionkey", "PART_OF"))
    ring = n.select(F.concat(F.lit("nation:"), "n_nationkey").alias("src"), F.concat(F.lit("nation:"), (F.col("n_nationkey") * 7 + 3) % 25).alias("dst"), F.lit("NEXT").alias("rel"))
    return nodes, edges.unionByName(ring)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel (role), message, conv_id, turn."""
    return table(spark, sf_dir, "conversations").select(F.col("role").alias("channel"), F.col("text").alias("message"), "conv_id", "turn")


MS = "epoch_us(ts) // 1000"
#: 2024-01-01 in minutes.
MINUTE = 28_401_120

SQL = {
    "kv": "SELECT 'cust:' || c_custkey AS key, c_mktsegment AS value, c_custkey::VARCHAR AS n, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 1000 END AS expire_at FROM customer",
    "lst": "SELECT 'order:' || l_orderkey AS key, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::BIGINT AS pos, (l_partkey % 7)::VARCHAR AS elem FROM lineitem",
    "hsh": "SELECT 'order:' || o_orderkey AS key, unnest(['cust', 'status', 'priority', 'total']) AS field, unnest([o_custkey::VARCHAR, o_orderstatus, o_orderpriority, floor(o_totalprice)::BIGINT::VARCHAR]) AS value FROM orders",
    "st": "SELECT DISTINCT 'supp:' || l_suppkey AS key, l_partkey::VARCHAR AS member FROM lineitem",
    "zs": "SELECT 'nation:' || c_nationkey AS key, 'c' || c_custkey AS member, c_acctbal AS score FROM customer",
    "zq": "SELECT 'supp:' || l_suppkey AS key, l_partkey::VARCHAR AS member, sum(l_quantity) AS score FROM lineitem GROUP BY ALL",
    "bm": f"SELECT DISTINCT event_type AS key, {MS} // 60000 - {MINUTE} AS offset_ FROM events",
    "ts": f"SELECT event_type AS series, {MS} AS ts_ms, value, event_id FROM events",
    "xs": f"SELECT event_type AS key, {MS} AS ms, (row_number() OVER (PARTITION BY event_type, {MS} ORDER BY event_id) - 1)::BIGINT AS seq, user_id, value FROM events",
    "js": """SELECT 'doc:' || o_orderkey AS key, '{"cust":' || o_custkey || ',"flag":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || ',"name":"' || o_orderpriority || '","tags":["' || o_orderstatus || '","x","' || o_orderstatus || '"],"sub":{"a":' || (o_orderkey % 10) || ',"b":null}}' AS doc FROM orders""",
    "geo": "SELECT 'places' AS key, 'c' || c_custkey AS member, (c_custkey * 37 % 36000)::DOUBLE / 100.0::DOUBLE - 180 AS lon, (c_custkey * 53 % 17000)::DOUBLE / 100.0::DOUBLE - 85 AS lat FROM customer",
    "vs": "SELECT label::VARCHAR AS key, vec_id AS id, 'v' || vec_id AS name, embedding::DOUBLE[] AS v FROM embeddings",
    "nodes": "SELECT 'customer:' || c_custkey AS id, 'customer' AS label, c_name AS name FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'region', r_name FROM region",
    "edges": "SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, 'LIVES_IN' AS rel FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'PART_OF' FROM nation UNION ALL SELECT 'nation:' || n_nationkey, 'nation:' || ((n_nationkey * 7 + 3) % 25), 'NEXT' FROM nation",
    "messages": "SELECT role AS channel, text AS message, conv_id, turn FROM conversations",
}


def sql(facets: str, body: str) -> str:
    """A query over the facets that it names, separated by spaces."""
    return "WITH " + ", ".join(f"{f} AS ({SQL[f]})" for f in facets.split()) + " " + body
