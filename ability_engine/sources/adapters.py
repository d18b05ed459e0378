"""Star schema of releases, benchmarks and scores, derived from the driver's tables: suppliers release, brands measure, line items score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def benches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("basket_pos")
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("benchmark")).distinct()
    return brands.withColumn("basket_pos", F.regexp_replace("benchmark", "Brand#", "").cast("int")).select(
        "benchmark", "basket_pos",
        F.when(n == 25, 2.0).otherwise(1.0).alias("weight"),
        (n <= 6).alias("legacy"),
        (1 + n % 4).alias("generation"),
        ((n <= 20) | (n == 25)).alias("in_index"),
        (2016 + n % 10).alias("introduced"),
        F.when(n % 5 == 0, 40.0 + n).alias("human_baseline"),
        F.lit("no tools, pass@1").alias("preferred_config"),
    )


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("r-"), F.lpad(key.cast("string"), 9, "0")).alias("release_id"),
        F.col("s_nationkey").alias("lab"),
        F.date_add(F.lit("2019-01-01").cast("date"), ((37 * key) % 2200).cast("int")).alias("date"),
        F.when(key % 5 == 0, "small").when(key % 5 == 1, "mid").alias("tier"),
        F.when(key % 11 == 0, "announced").otherwise("released").alias("status"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus", "l_returnflag", (F.col("l_linenumber") % 2).alias("odd"))
    brands = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("benchmark"))
    n = F.regexp_replace("benchmark", "Brand#", "").cast("int")
    # Parts grow with the lines, and a small file of them holds millions of rows: no broadcast.
    cells = lines.join(brands.hint("merge"), lines.l_partkey == brands.p_partkey).where((7 * F.col("l_suppkey") + 3 * n) % 10 < 4)
    shares = cells.groupBy("l_suppkey", "benchmark", "l_linestatus", "odd").agg((100.0 * F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("value"))
    return shares.select(
        F.concat(F.lit("r-"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("release_id"), "benchmark", "value",
        F.when(F.col("l_linestatus") == "F", "official").otherwise("maintainer").alias("reported_by"),
        F.when(F.col("odd") == 1, "pass@1").otherwise("default").alias("config"),
        (F.when(F.col("l_linestatus") == "F", 0).otherwise(2) + F.col("odd")).cast("int").alias("score_pos"),
    )


def launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as releases: customers are labs."""
    status, priority = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("release_id"),
        F.col("o_custkey").alias("lab"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(priority == "4", "mid").when(priority == "5", "small").alias("tier"),
        F.when(status == "P", "announced").otherwise("released").alias("status"),
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), F.col("user_id").cast("string").alias("address"), F.when(F.col("event_type") == "error", "bot").otherwise("visit").alias("class"))
