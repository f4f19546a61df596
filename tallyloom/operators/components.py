"""Connected components over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import written


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links; a component is named by its least node.

    Alternates large-star and small-star steps, which need a logarithmic number of rounds even on long chains. Each
    round is written to the shared folder; the driver sees a count and a checksum only. Links to itself and repeated
    links don't matter; an empty table gives an empty one.
    """
    edges = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    mark = F.expr("bit_xor(xxhash64(hi, lo))")
    before = edges.agg(F.count("*").alias("n"), mark.alias("x")).first()
    for _ in range(max_rounds):
        if not before["n"]:
            break
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(floor, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = written(small.union(floor.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), mark.alias("x")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
