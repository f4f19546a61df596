"""Lookups of evidence: last record wins, key sets compared, sources in turn, two keys in turn."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_lookup_last(rows: DataFrame, records: DataFrame, keys: list[str], value: str, ordinal: str) -> DataFrame:
    """rows with the value of the record of the largest ordinal for their keys, or null."""
    last = records.groupBy(*keys).agg(F.max_by(value, ordinal).alias(value))
    return rows.join(last, keys, "left")


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only: `missing` from the right, or `stale` there."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, keys, "full_outer").where("_l is null or _r is null")
    return both.select(*keys, F.when(F.col("_r").isNull(), "missing").otherwise("stale").alias("status"))


def waterfall(pending: DataFrame, sources: list[DataFrame], keys: list[str], evidence: str) -> DataFrame:
    """Evidence of the first source that has any; each source has keys and evidence. Sources stay side by side in one aggregation."""
    tagged = [s.select(*keys, evidence, F.lit(k).alias("source")) for k, s in enumerate(sources)]
    best = reduce(DataFrame.union, tagged).groupBy(*keys).agg(F.min(F.struct("source", evidence)).alias("x")).select(*keys, "x.source", f"x.{evidence}")
    return pending.join(best, keys, "left")


def verify_in_turn(pending: DataFrame, sources: list[DataFrame], keys: list[str], prior: DataFrame | None = None) -> DataFrame:
    """pending with status, source, evidence and errors, as if sources were asked one after another until one has evidence.

    A source has keys, evidence and error (either may be null). Errors of all sources up to the one that decides are kept
    in order; later ones were never asked. Keys that prior (keys, evidence) has are verified already, by source -1, and no
    source is asked for them. Null keys are verified by nothing.
    """
    tagged = [s.select(*keys, F.lit(k).alias("source"), "evidence", "error") for k, s in enumerate(sources)]
    if prior is not None:
        tagged.append(prior.select(*keys, F.lit(-1).alias("source"), "evidence", F.lit(None).cast("string").alias("error")).where("evidence is not null"))
    found = F.min(F.when(F.col("evidence").isNotNull(), F.struct("source", "evidence"))).alias("x")
    faults = F.sort_array(F.collect_set(F.when(F.col("error").isNotNull(), F.struct("source", "error")))).alias("faults")
    per = reduce(DataFrame.union, tagged).groupBy(*keys).agg(found, faults).select(*keys, "x.source", "x.evidence", "faults")
    asked = F.filter("faults", lambda f: F.coalesce(f["source"] <= F.col("source"), F.lit(True)))
    errors = F.coalesce(F.transform(asked, lambda f: f["error"]), F.array().cast("array<string>"))
    status = F.when(F.col("evidence").isNotNull(), "verified").otherwise("unverified")
    return pending.join(per, keys, "left").withColumns({"status": status, "errors": errors}).drop("faults")


def fallback_lookup(rows: DataFrame, table: DataFrame, first: str, second: str) -> DataFrame:
    """rows with `value` by the first key, else by the second; table has key, value and ord, of which the last holds."""
    last = table.groupBy("key").agg(F.max_by("value", "ord").alias("value"))
    one = last.select(F.col("key").alias(first), F.col("value").alias("_v1"))
    two = last.select(F.col("key").alias(second), F.col("value").alias("_v2"))
    return rows.join(one, first, "left").join(two, second, "left").withColumn("value", F.coalesce("_v1", "_v2")).drop("_v1", "_v2")
