"""Lists, variants, global statistics and the consensus of works.

Lists are ranked in long form, so that the limit on places is applied in each partition before the shuffle and a rater
with a large share of all rows sends at most a list's length from each task. Statistics of all observations are one
row, joined by broadcast; works are aggregated with partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scoring import adjusted_score, composite, penalty, rounded, shrunk
from tallyloom.sources.star import LOCAL
from tallyloom.spec import FIVE_AXES, SurveySpec


def placements(obs: DataFrame, spec: SurveySpec = FIVE_AXES) -> DataFrame:
    """obs by list with its place, for places up to the list's length."""
    entries = F.array(*(F.struct(F.lit(name).alias("list"), F.col(axis).alias("score")) for name, axis in spec.lists))
    long = obs.select("*", F.inline(entries))
    order = Window.partitionBy("rater", "list").orderBy(F.desc("score"), "o", "ln", "work", "price", "qty")
    return long.withColumn("place", F.row_number().over(order)).where(F.col("place") <= spec.list_length)


def ranked(placed: DataFrame, spec: SurveySpec = FIVE_AXES) -> DataFrame:
    """One row for each observation in a list, with its places."""
    places = [F.min(F.when(F.col("list") == name, F.col("place"))).alias(f"r_{name}") for name in spec.list_names]
    return placed.groupBy("rater", "work", *LOCAL, *spec.axes).agg(*places, F.count("*").alias("n_lists"), F.sum("place").alias("sum_place"), F.min("place").alias("best_place"))


def picked(rows: DataFrame, spec: SurveySpec = FIVE_AXES, work: str = "work", local: tuple[str, ...] = LOCAL) -> DataFrame:
    """All variants of a rater's work: rn 1 is the one whose scores hold; m_* are the least places over the variants."""
    group = Window.partitionBy("rater", work)
    order = group.orderBy(F.desc("n_lists"), "sum_place", "best_place", *local)
    least = {f"m_{name}": F.min(f"r_{name}").over(group) for name in spec.list_names}
    return rows.withColumns({"rn": F.row_number().over(order), "variants": F.count("*").over(group), **least})


def adjusted(unique: DataFrame, spec: SurveySpec = FIVE_AXES) -> DataFrame:
    """unique with a_* (scores moved by places) and the composite of each row."""
    moved = {a: adjusted_score(F.col(a), F.col(f"m_{spec.list_of(a)}"), spec) if a in spec.adjusted else F.col(a).cast("double") for a in spec.axes}
    out = unique.withColumns({f"a_{a}": c for a, c in moved.items()})
    return out.withColumn("composite", composite({a: F.col(f"a_{a}") for a in spec.axes}, spec))


def unique_observations(obs: DataFrame, spec: SurveySpec = FIVE_AXES) -> DataFrame:
    return adjusted(picked(ranked(placements(obs, spec), spec), spec).where("rn = 1"), spec)


def global_stats(unique: DataFrame, spec: SurveySpec = FIVE_AXES) -> DataFrame:
    """One row: raters, means of raw and moved scores, mean and population deviation of composites."""
    means = [F.avg(a).alias(f"g_{a}") for a in spec.axes] + [F.avg(f"a_{a}").alias(f"ga_{a}") for a in spec.axes]
    return unique.agg(F.countDistinct("rater").alias("n_raters"), F.count("*").alias("n_obs"), *means, F.avg("composite").alias("g_composite"), F.stddev_pop("composite").alias("sd"))


def work_means(unique: DataFrame, spec: SurveySpec = FIVE_AXES, work: str = "work") -> DataFrame:
    means = [F.avg(a).alias(f"raw_{a}") for a in spec.axes] + [F.avg(f"a_{a}").alias(f"adj_{a}") for a in spec.axes]
    lists = [x for n in spec.list_names for x in (F.count(f"m_{n}").alias(f"n_{n}"), F.avg(f"m_{n}").alias(f"place_{n}"))]
    return unique.groupBy(work).agg(F.count("*").alias("support"), *means, *lists)


def consensus(unique: DataFrame, stats: DataFrame, spec: SurveySpec = FIVE_AXES, work: str = "work") -> DataFrame:
    """Works with shrunken scores, composites, penalty and consensus."""
    w = work_means(unique, spec, work).crossJoin(F.broadcast(stats))
    posterior = {a: shrunk(F.col("support"), F.col(f"adj_{a}"), F.col(f"ga_{a}"), spec) for a in spec.axes}
    w = w.withColumns({f"post_{a}": c for a, c in posterior.items()})
    w = w.withColumns(
        {
            "support_rate": F.col("support") / F.col("n_raters"),
            "raw": composite({a: F.col(f"raw_{a}") for a in spec.axes}, spec),
            "posterior": composite({a: F.col(f"post_{a}") for a in spec.axes}, spec),
            "penalty": penalty(F.col("sd"), F.col("support"), spec),
        }
    )
    return w.withColumn("consensus", F.col("posterior") - F.col("penalty"))


def by_consensus() -> list[Column]:
    return [F.desc(rounded(F.col("consensus"), 9)), F.desc("support"), F.desc(rounded(F.col("raw"), 9)), F.asc("year"), F.asc(F.lower("title"))]


def overall_rank(works: DataFrame, tie: str = "work") -> DataFrame:
    """Places over all works: one row each of a table that is aggregated to works, so one task sorts it."""
    return works.withColumn("rank", F.row_number().over(Window.orderBy(*by_consensus(), F.asc(tie))))
