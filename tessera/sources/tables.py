"""Domain frames from the given tables. Each reads only the columns that it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price series: instrument (supplier), date, close (value per unit sold that day), volume."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("instrument"), F.col("l_shipdate").cast("date").alias("date"))
    value = F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double")
    return li.agg((value / F.sum(F.col("l_quantity").cast(MONEY)).cast("double")).alias("close"), F.sum(F.col("l_quantity").cast("long")).alias("volume"))


def benchmark_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, close over all instruments."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"))
    value = F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double")
    return li.agg((value / F.sum(F.col("l_quantity").cast(MONEY)).cast("double")).alias("close"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual facts by nation: entity, fy, concept, value, filed. revenue: order totals; each line's discount and tax give costs."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("fy"), F.col("o_totalprice").cast(MONEY).alias("total"), F.col("o_orderdate").cast("date").alias("filed"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("entity"))
    placed = orders.join(customer, "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").cast(MONEY).alias("price"), F.col("l_discount").cast(MONEY).alias("discount"), F.col("l_tax").cast(MONEY).alias("tax"))
    totals = placed.groupBy("entity", "fy").agg(F.sum("total").alias("revenue"), F.max("filed").alias("filed"), F.count(F.lit(1)).alias("orders"))
    costs = lines.join(placed.select("o_orderkey", "entity", "fy"), "o_orderkey").groupBy("entity", "fy").agg(F.sum(F.col("price") * F.col("discount")).alias("discounts"), F.sum(F.col("price") * F.col("tax")).alias("taxes"), F.sum("price").alias("gross"))
    return totals.join(costs, ["entity", "fy"], "left").select("entity", "fy", "filed", *[F.round(F.col(c).cast("double"), 2).alias(c) for c in ("revenue", "gross", "discounts", "taxes")], F.col("orders").cast("double").alias("orders"))


def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, event_class, ts, date, value, k (from the JSON properties), event_id."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.col("user_id").alias("entity"), F.col("event_type").alias("event_class"), "ts", F.col("ts").cast("date").alias("date"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
