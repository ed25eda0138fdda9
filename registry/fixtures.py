"""Microdata tables built from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.operators.taxonomy import ancestor_paths, taxonomy_from_columns
from cloakframe.roles import Roles

HEIGHT = 2  # nation -> region -> ALL

CUST = Roles("c_custkey", ["c_acctbal"], "n_name", ["c_mktsegment"])
ORD = Roles("o_orderkey", ["o_totalprice", "o_day", "c_acctbal"], "n_name", ["o_orderpriority"])
EVT = Roles("event_id", ["value", "second", "user_id"], "event_type")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with the name of their region."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "r_name"
    )


def cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    where = places(spark, sf_dir)
    return customer.join(where, customer.c_nationkey == where.n_nationkey).select(
        "c_custkey", "c_acctbal", "c_mktsegment", "n_name"
    )


def ord_(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    where = places(spark, sf_dir)
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(where, customer.c_nationkey == where.n_nationkey)
        .select(
            "o_orderkey",
            "o_totalprice",
            F.datediff("o_orderdate", F.lit("1970-01-01")).cast("double").alias("o_day"),
            "c_acctbal",
            "o_orderpriority",
            "n_name",
        )
    )


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "value",
        second.cast("double").alias("second"),
        F.col("user_id").cast("double").alias("user_id"),
        "event_type",
    )


def emb(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The embeddings with one column per element, and the names of these."""
    rows = table(spark, sf_dir, "embeddings")
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    names = [f"e{i}" for i in range(width)]
    parts = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]
    return rows.select("vec_id", *parts, F.col("label").cast("bigint").alias("label")), names


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy_from_columns(places(spark, sf_dir), ["n_name", "r_name"])


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestor_paths(edges(spark, sf_dir), HEIGHT)


def segment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy_from_columns(table(spark, sf_dir, "customer"), ["c_mktsegment"])
