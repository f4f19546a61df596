"""The star schema read as a survey: suppliers rate parts, a line item is one observation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: An observation's own key after its rater and work, and the order among equals.
LOCAL = ("o", "ln", "price", "qty")


def observations(lineitem: DataFrame) -> DataFrame:
    """rater, work, the local key and five integer scores of each line item."""
    whole = lambda c: c.cast("bigint")
    return lineitem.select(
        F.col("l_suppkey").alias("rater"),
        F.col("l_partkey").alias("work"),
        F.col("l_orderkey").alias("o"),
        F.col("l_linenumber").alias("ln"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("qty"),
        whole(F.round(F.col("l_discount") * 1000)).alias("influence"),
        whole(F.least(F.lit(100.0), 2 * F.col("l_quantity"))).alias("ambition"),
        whole(F.round(F.col("l_tax") * 1250)).alias("fairness"),
        ((F.col("l_orderkey") * 7 + F.col("l_partkey") * 3) % 101).alias("traditionality"),
        ((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11 + F.col("l_partkey")) % 101).alias("originality"),
    )
