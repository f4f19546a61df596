"""From observations to ranked works in one chain: series rules, clusters, canonical identities, one observation for each
rater and cluster, exclusions, statistics of what is included, consensus and rank; with the logs of every step.

Observations are joined to clusters by the id of their identity; everything before that join works on distinct identities.
The rows that a rater and a cluster share are one window's partition: at most the places of one rater's lists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import identity as I
from tallyloom.operators import scoring as S
from tallyloom.operators.components import components
from tallyloom.operators.ordinals import with_ordinal
from tallyloom.operators.rollup import IDENTITY, identity_id, roll_up
from tallyloom.session import written
from tallyloom.sources.config import Series
from tallyloom.spec import FIVE_AXES, SurveySpec


@dataclass
class Aggregate:
    """works: ranked; observations: one for each rater and included cluster; selections: every place of an included
    cluster; stats: one row; excluded: canonical identities left out; merges: identities under another's name; rollups:
    decisions of series rules; within: rater and cluster with the kept and the discarded local ids."""

    works: DataFrame
    observations: DataFrame
    selections: DataFrame
    stats: DataFrame
    excluded: DataFrame
    merges: DataFrame
    rollups: DataFrame
    within: DataFrame


def from_places(rows: DataFrame, spec: SurveySpec) -> DataFrame:
    """rows with the number, sum and least of their places r_*; rows without any place go."""
    places = F.array_compact(F.array(*(F.col(f"r_{n}").cast("int") for n in spec.list_names)))
    out = rows.withColumns({"n_lists": F.size(places), "sum_place": F.aggregate(places, F.lit(0), lambda a, x: a + x), "best_place": F.array_min(places)})
    return out.where("n_lists > 0")


def clusters(identities: DataFrame, counts: DataFrame, rules: I.MediaRules, aliases: dict[str, str] | None = None) -> DataFrame:
    """id, cluster and n of each identity of counts (id, n)."""
    live = identities.join(counts, "id")
    keyed = written(live.select("id", "n", X.title_candidates(F.col("title"), F.col("original_title"), aliases).alias("titles"), X.creator_key(F.col("creator")).alias("creator_key"), "medium", "year"), "keyed")
    named = components(I.links(keyed, rules)).withColumnRenamed("node", "id")
    return keyed.select("id", "n").join(named, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"), "n")


def aggregate(
    observations: DataFrame,
    series: Series = Series(()),
    exclusions: tuple[tuple[str, int, str], ...] = (),
    aliases: dict[str, str] | None = None,
    spec: SurveySpec = FIVE_AXES,
    rules: I.MediaRules = I.DEFAULT_MEDIA,
    local: tuple[str, ...] = ("work_id",),
    series_medium: str = "book_series",
) -> Aggregate:
    """observations: rater, the local key, an identity (title, original_title, creator, year, medium), scores by axis and
    places r_<list>. Equal sort keys are decided by the local key, equal works by the least id of their cluster. An empty
    table gives empty works. exclusions are normalised titles with year and medium, as `config.exclusions` makes them.
    """
    spark = observations.sparkSession
    rows = from_places(observations.withColumn("id", identity_id()), spec)
    seen = written(rows.groupBy("id", "rater").agg(*(F.first(c).alias(c) for c in IDENTITY), F.count("*").alias("n")), "seen")
    rolled = roll_up(seen, series, aliases)
    counts = seen.join(rolled.mapping, "id").groupBy(F.col("current").alias("id")).agg(F.sum("n").alias("n"))
    grouped = written(clusters(rolled.identities, counts, rules, aliases), "clusters")
    members = grouped.join(rolled.identities, "id")
    canon = I.canonical(members, series_medium).select("cluster", "id").join(rolled.identities, "id").select("cluster", *IDENTITY)
    out = spark.createDataFrame(list(exclusions), "known string, year int, medium string").distinct()
    canon = canon.withColumn("known", X.aliased(X.normalize(F.col("title")), aliases or {})).join(out.withColumn("out", F.lit(True)), ["known", "year", "medium"], "left")
    canon = written(canon.select("cluster", *IDENTITY, F.coalesce("out", F.lit(False)).alias("out")), "canonical")
    of = rolled.mapping.join(grouped.select(F.col("id").alias("current"), "cluster"), "current").select("id", "cluster").join(canon.select("cluster", "out"), "cluster")
    every = S.picked(rows.join(of, "id"), spec, "cluster", local)
    every = written(S.adjusted(every, spec), "variants")
    unique = every.where("rn = 1")
    kept = unique.where("not out")
    raters = seen.agg(F.countDistinct("rater").alias("n_raters"))
    totals = seen.agg(F.sum("n").alias("observations")).crossJoin(every.agg(F.sum("n_lists").alias("collected"), F.sum(F.when(F.col("out"), F.col("n_lists")).otherwise(0)).alias("left_out"), F.count_if(F.col("rn") == 1).alias("unique_observations")))
    stats = written(S.global_stats(kept, spec).drop("n_raters").crossJoin(raters).crossJoin(totals), "stats")
    named = canon.where("not out").drop("out")
    works = with_ordinal(S.consensus(kept, stats, spec, "cluster").join(named, "cluster"), [*S.by_consensus(), F.asc("cluster")], "rank", 1)
    place = works.select("cluster", "rank")
    raw = lambda c: F.col(c).alias(f"raw_{c}")
    key = ["rater", "cluster", *local]
    shown = kept.select(*key, *map(raw, IDENTITY), *spec.axes, *(F.col(f"m_{n}").alias(f"place_{n}") for n in spec.list_names)).join(place, "cluster")
    long = F.array(*(F.struct(F.lit(n).alias("list"), F.col(f"r_{n}").cast("int").alias("place")) for n in spec.list_names))
    agent = ["agent_id"] if "agent_id" in every.columns else []
    picks = every.where("not out").select(*key, *agent, *map(raw, IDENTITY), *spec.axes, F.inline(long)).where("place is not null").join(place, "cluster")
    same = F.struct(*local) if len(local) > 1 else F.col(local[0])
    within = every.where("variants > 1").groupBy("rater", "cluster").agg(F.min(F.when(F.col("rn") == 1, same)).alias("kept"), F.sort_array(F.collect_list(F.when(F.col("rn") > 1, same))).alias("discarded"))
    to = canon.select("cluster", *(F.col(c).alias(f"to_{c}") for c in IDENTITY))
    differs = F.lit(False)
    for c in IDENTITY:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"to_{c}"))
    merges = members.join(to, "cluster").where(differs).select(*IDENTITY, *(f"to_{c}" for c in IDENTITY), F.col("n").alias("observations"))
    return Aggregate(works, shown, picks, stats, canon.where("out").drop("out"), merges, rolled.decisions.join(rolled.identities, "id").drop("id"), within)


def summary(a: Aggregate, top: int = 25) -> dict:
    """The audit summary; counts are taken where the tables are, and the driver gets one row a table and the top works."""
    s = a.stats.first()
    first = a.works.orderBy("rank").limit(top).select("rank", "title", "creator", "year", "medium", F.round("consensus", 4).alias("weighted_score"), "support")
    works = a.works.agg(F.count("*").alias("n"), F.count_if(F.col("support") == 1).alias("singletons")).first()
    return {
        "agents": s["n_raters"],
        "valid_observations": s["observations"],
        "unique_agent_work_observations": s["unique_observations"],
        "retained_works": works["n"],
        "singletons": works["singletons"],
        "excluded": a.excluded.count(),
        "identity_merges": a.merges.count(),
        "series_rollup_decisions": a.rollups.count(),
        "within_agent_merges": a.within.count(),
        "collected_selections": s["collected"],
        "excluded_selections": s["left_out"],
        "top": [r.asDict() for r in first.collect()],
    }


def write(a: Aggregate, folder: str) -> None:
    """Each table as JSON lines below the folder, the summary as summary/; Spark's committer makes each complete or absent."""
    import json

    tables = {k: getattr(a, k) for k in ("works", "observations", "selections", "stats", "excluded", "merges", "rollups", "within")}
    tables["singletons"] = a.works.where("support = 1")
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{folder}/{name}")
    spark = a.works.sparkSession
    spark.createDataFrame([(json.dumps(summary(a), ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")


def verify(a: Aggregate, spec: SurveySpec = FIVE_AXES, tolerance: float = 1e-9) -> DataFrame:
    """check, rows and failed: the works recomputed from the retained observations by other aggregates, and their keys.

    The report passes where no check has failed rows; means, shrinkage, composites, penalty and consensus are each redone
    from sums, and every place of the selections is unique in its rater's list."""
    places = {n: F.col(f"place_{n}") for n in spec.list_names}
    o = a.observations
    for axis in spec.axes:
        name = spec.list_of(axis)
        moved = F.col(axis).cast("double")
        if axis in spec.adjusted:
            mid = (spec.list_length + 1) / 2
            moved = F.least(F.lit(100.0), F.greatest(F.lit(0.0), moved + spec.max_adjustment * (mid - F.coalesce(places[name], F.lit(spec.list_length + 1))) / (mid - 1)))
        o = o.withColumn(f"x_{axis}", moved)
    mix = sum((F.lit(w) * F.col(f"x_{x}") for x, w in spec.weights), F.lit(0.0))
    o = o.withColumn("mix", mix)
    whole = o.agg(F.count("*").alias("N"), *(F.sum(f"x_{x}").alias(f"X_{x}") for x in spec.axes), F.sum("mix").alias("s1"), F.sum(F.col("mix") * F.col("mix")).alias("s2"))
    per = o.groupBy("cluster").agg(F.count("*").alias("k"), *(F.sum(f"x_{x}").alias(f"t_{x}") for x in spec.axes), *(F.sum(x).alias(f"r_{x}") for x in spec.axes))
    w = a.works.join(per, "cluster", "left").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(a.stats.select(F.col("n_raters").alias("everyone"))))
    post = {x: (F.col(f"t_{x}") + spec.prior * F.col(f"X_{x}") / F.col("N")) / (F.col("k") + spec.prior) for x in spec.axes}
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("N") - (F.col("s1") / F.col("N")) ** 2))
    posterior = sum((F.lit(v) * post[x] for x, v in spec.weights), F.lit(0.0))
    fine = F.lit(spec.z) * sd / F.sqrt(F.col("k"))
    near = lambda p, q: F.coalesce(F.abs(p - q) <= tolerance * F.greatest(F.lit(1.0), F.abs(q)), F.lit(False))
    every = lambda parts: F.array_min(F.array(*parts))
    checks = {
        "support is the number of observations": F.coalesce(F.col("support") == F.col("k"), F.lit(False)),
        "support rate": near(F.col("support_rate"), F.col("k") / F.col("everyone")),
        "raw means": every([near(F.col(f"raw_{x}"), F.col(f"r_{x}") / F.col("k")) for x in spec.axes]),
        "moved means": every([near(F.col(f"adj_{x}"), F.col(f"t_{x}") / F.col("k")) for x in spec.axes]),
        "shrunken means": every([near(F.col(f"post_{x}"), post[x]) for x in spec.axes]),
        "raw composite": near(F.col("raw"), sum((F.lit(v) * F.col(f"r_{x}") / F.col("k") for x, v in spec.weights), F.lit(0.0))),
        "penalty": F.coalesce(F.abs(F.col("penalty") - fine) <= 1e-6, F.lit(False)),
        "consensus": F.coalesce(F.abs(F.col("consensus") - (posterior - fine)) <= 1e-6, F.lit(False)),
    }
    row = w.agg(F.count("*").alias("rows"), *(F.count_if(~c).alias(f"c{k}") for k, c in enumerate(checks.values())))
    entries = F.array(*(F.struct(F.lit(name).alias("check"), F.col("rows"), F.col(f"c{k}").alias("failed")) for k, name in enumerate(checks)))
    out = row.select(F.inline(entries))
    n = a.works.agg(F.count("*").alias("rows"), (F.count("*") - F.countDistinct("rank") + F.coalesce(F.max("rank") - F.count("*"), F.lit(0))).alias("failed"))
    out = out.union(n.select(F.lit("ranks are 1 to the number of works"), "rows", "failed"))
    spot = a.selections.groupBy("rater", "list", "place").agg(F.count("*").alias("k")).agg(F.sum("k"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)))
    out = out.union(spot.toDF("rows", "failed").select(F.lit("places are held once"), F.coalesce("rows", F.lit(0)), "failed"))
    gone = a.works.join(a.excluded.select("title", "year", "medium"), ["title", "year", "medium"], "left_semi")
    return out.union(gone.agg(F.lit("excluded works are not ranked"), F.count("*"), F.count("*")))
