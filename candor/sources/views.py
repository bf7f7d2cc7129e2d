"""Review-shaped views over the test tables.  Each SQL text runs unchanged in Spark and in DuckDB.

reviews_v       customers reviewing parts, one review per order line: dense, every user has many reviews
users_v         metadata of those customers
products_v      metadata of those parts
text_reviews_v  documents as review texts
market_v        orders reviewing parts: many one-review users, ratings follow the part
rings_v         market_v plus look-alike groups built from all customers and all parts, each member
                leaving out a product now and then
events_v        the event log as reviews: five products that every user reviewed
scores_v        a label and two probabilities per order line
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

REVIEW_KEY = (
    "concat(CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', "
    "CAST(l_linenumber AS STRING))"
)

REVIEWS_V = f"""
SELECT {REVIEW_KEY} AS review_id,
       concat('u', CAST(o_custkey AS STRING)) AS user_id,
       concat('p', CAST(l_partkey AS STRING)) AS product_id,
       CAST(1 + (CAST(l_quantity AS INT) - 1) % 5 AS DOUBLE) AS rating,
       l_shipdate AS date,
       l_returnflag <> 'R' AS verified_purchase
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

USERS_V = """
SELECT concat('u', CAST(o_custkey AS STRING)) AS user_id, min(o_orderdate) AS join_date, count(*) AS review_count,
       1 + (o_custkey % 41) / CAST(10 AS DOUBLE) AS avg_rating,
       count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS verified_purchases
FROM orders GROUP BY o_custkey
"""

PRODUCTS_V = """
SELECT concat('p', CAST(p_partkey AS STRING)) AS product_id, p_name AS product_name, p_type AS category,
       p_retailprice AS price, 1 + (p_size % 41) / CAST(10 AS DOUBLE) AS avg_rating,
       CAST(p_size AS BIGINT) AS review_count, d AS listing_date
FROM part LEFT JOIN (SELECT l_partkey, min(o_orderdate) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                     GROUP BY l_partkey) x ON p_partkey = l_partkey
"""

TEXT_REVIEWS_V = """
SELECT d.doc_id AS review_id, concat('u', CAST(d.doc_id % 97 AS STRING)) AS user_id, d.source AS product_id,
       CAST(1 + d.doc_id % 5 AS DOUBLE) AS rating, d.text AS review_text, o_orderdate AS date,
       quality = 1 AS verified_purchase, d.lang AS lang
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN orders ON o_orderkey = d.doc_id
"""

MARKET_V = f"""
SELECT {REVIEW_KEY} AS review_id,
       concat('o', CAST(l_orderkey AS STRING)) AS user_id,
       concat('p', CAST(l_partkey AS STRING)) AS product_id,
       CAST(least(5, greatest(1, floor((10 + p_size % 41 + CAST(round(l_discount * 100) AS INT)) / 10.0))) AS DOUBLE)
         AS rating,
       l_shipdate AS date,
       l_returnflag <> 'R' AS verified_purchase
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

RINGS_V = f"""
{MARKET_V}
UNION ALL
SELECT concat('ring-', CAST(c_custkey AS STRING), '-', CAST(p_partkey AS STRING)) AS review_id,
       concat('u', CAST(c_custkey AS STRING)) AS user_id, concat('k', CAST(p_partkey AS STRING)) AS product_id,
       CASE WHEN (c_custkey + p_partkey) % 7 = 0 THEN CAST(4 AS DOUBLE) ELSE CAST(5 AS DOUBLE) END AS rating,
       TIMESTAMP '1998-02-01 00:00:00' AS date, false AS verified_purchase
FROM customer JOIN part ON floor(c_custkey / 10.0) = floor(p_partkey / 4.0) AND (c_custkey * 3 + p_partkey * 5) % 13 <> 0
"""

EVENTS_V = """
SELECT event_id AS review_id, concat('u', CAST(user_id AS STRING)) AS user_id, event_type AS product_id,
       CAST(1 + event_id % 5 AS DOUBLE) AS rating, ts AS date, event_type <> 'error' AS verified_purchase
FROM events
"""

SCORES_V = f"""
SELECT {REVIEW_KEY} AS review_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
       CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 1000 AS DOUBLE) / 1000 AS nlp_probability,
       l_quantity / 50 AS graph_probability
FROM lineitem
"""

VIEWS = {
    "reviews_v": REVIEWS_V,
    "users_v": USERS_V,
    "products_v": PRODUCTS_V,
    "text_reviews_v": TEXT_REVIEWS_V,
    "market_v": MARKET_V,
    "rings_v": RINGS_V,
    "events_v": EVENTS_V,
    "scores_v": SCORES_V,
}


def register_tables(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Make the tables that ``sql`` names available as temporary views."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view over the parquet tables of ``sf_dir``."""
    register_tables(spark, sf_dir, VIEWS[name])
    df = spark.sql(VIEWS[name])
    if "review_text" in df.columns:
        # Text work is bound by the processor: a table of few splits should not leave cores idle.  Larger ones are not moved.
        cores = spark.sparkContext.defaultParallelism
        if spark.read.parquet(f"{sf_dir}/documents.parquet").rdd.getNumPartitions() < cores:
            df = df.repartition(cores, "review_id")
    for column, kind in df.dtypes:
        if kind == "timestamp_ltz":
            df = df.withColumn(column, df[column].cast("timestamp_ntz"))
    return df
