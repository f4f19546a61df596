"""Queries over the survey that line items stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.scoring import adjusted_score, rank_adjustment, rounded
from tallyloom.operators import scoring as S
from tallyloom.plans.registry import query
from tallyloom.session import written
from tallyloom.sources.star import LOCAL, observations, table
from tallyloom.spec import FIVE_AXES

SPEC = FIVE_AXES
AXES, LISTS = SPEC.axes, SPEC.list_names


def _sql_chain() -> str:
    axes = ", ".join(AXES)
    long = " union all ".join(f"select *, '{n}' as list, {a} as score from obs" for n, a in SPEC.lists)
    places = ", ".join(f"min(case when list = '{n}' then place end) as r_{n}" for n in LISTS)
    least = ", ".join(f"min(r_{n}) over (partition by rater, work) as m_{n}" for n in LISTS)
    moved = ", ".join(
        f"greatest(0e0, least(100e0, {a} + 5e0 * (50.5e0 - coalesce(m_{SPEC.list_of(a)}, 101)) / 49.5e0)) as a_{a}" if a in SPEC.adjusted else f"cast({a} as double) as a_{a}" for a in AXES
    )
    mix = lambda p: " + ".join(f"{w}e0 * {p}{a}" for a, w in SPEC.weights)
    g = ", ".join([f"avg({a}) as g_{a}" for a in AXES] + [f"avg(a_{a}) as ga_{a}" for a in AXES])
    m = ", ".join([f"avg({a}) as raw_{a}" for a in AXES] + [f"avg(a_{a}) as adj_{a}" for a in AXES] + [f"count(m_{n}) as n_{n}, avg(m_{n}) as place_{n}" for n in LISTS])
    post = ", ".join(f"(support * adj_{a} + 10e0 * ga_{a}) / (support + 10) as post_{a}" for a in AXES)
    return f"""with obs as (
  select l_suppkey as rater, l_partkey as work, l_orderkey as o, l_linenumber as ln, l_extendedprice as price, l_quantity as qty,
    cast(round(l_discount * 1000) as bigint) as influence, cast(least(100, 2 * l_quantity) as bigint) as ambition,
    cast(round(l_tax * 1250) as bigint) as fairness, (l_orderkey * 7 + l_partkey * 3) % 101 as traditionality,
    (l_orderkey * 37 + l_linenumber * 11 + l_partkey) % 101 as originality from lineitem),
long as ({long}),
placed as (select * from (select *, row_number() over (partition by rater, list order by score desc, o, ln, work, price, qty) as place from long) where place <= 100),
ranked as (select rater, work, o, ln, price, qty, {axes}, {places}, count(*) as n_lists, sum(place) as sum_place, min(place) as best_place
  from placed group by rater, work, o, ln, price, qty, {axes}),
picked as (select *, row_number() over (partition by rater, work order by n_lists desc, sum_place, best_place, o, ln, price, qty) as rn,
  count(*) over (partition by rater, work) as variants, {least} from ranked),
moved as (select *, {moved} from picked where rn = 1),
uniq as (select *, {mix('a_')} as composite from moved),
stats as (select count(distinct rater) as n_raters, count(*) as n_obs, {g}, avg(composite) as g_composite, stddev_pop(composite) as sd from uniq),
means as (select work, count(*) as support, {m} from uniq group by work),
shrunk as (select *, {post} from means cross join stats),
scored as (select *, cast(support as double) / n_raters as support_rate, {mix('raw_')} as raw, {mix('post_')} as posterior, 1.645e0 * sd / sqrt(support) as penalty from shrunk),
cons as (select s.*, posterior - penalty as consensus, p_name as title, p_brand as creator, p_type as medium, 1950 + p_size as year from scored s join part on work = p_partkey),
works as (select *, row_number() over (order by round(consensus, 9) desc, support desc, round(raw, 9) desc, year, lower(title), work) as rank from cons)
"""


CHAIN = _sql_chain()


def obs(spark: SparkSession, d: str) -> DataFrame:
    return observations(table(spark, d, "lineitem"))


def placed(spark: SparkSession, d: str) -> DataFrame:
    return S.placements(obs(spark, d))


def unique(spark: SparkSession, d: str) -> DataFrame:
    return S.unique_observations(obs(spark, d))


def unique_once(spark: SparkSession, d: str) -> DataFrame:
    """The unique observations as a table, for plans that read them for statistics and again for works."""
    return written(unique(spark, d), "unique")


def parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("work"), F.col("p_name").alias("title"), F.col("p_brand").alias("creator"), F.col("p_type").alias("medium"), (1950 + F.col("p_size")).alias("year"))


def works(spark: SparkSession, d: str) -> DataFrame:
    u = unique_once(spark, d)
    return S.overall_rank(S.consensus(u, S.global_stats(u)).join(parts(spark, d), "work"))


def r6(*names: str) -> list:
    return [rounded(F.col(n), 6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


POST = [f"post_{a}" for a in AXES]
HEAD = ["rank", "work", "title", "creator", "medium", "year", "support"]


@query("consensus", CHAIN + f"select rank, work, title, creator, medium, year, support, {s6('consensus', 'posterior', 'raw', 'penalty', 'support_rate', *POST)} from works")
def consensus(spark, d):
    return works(spark, d).select(*HEAD, *r6("consensus", "posterior", "raw", "penalty", "support_rate", *POST))


G = [f"g_{a}" for a in AXES] + [f"ga_{a}" for a in AXES] + ["g_composite", "sd"]


@query("global_stats", CHAIN + f"select n_raters, n_obs, {s6(*G)} from stats")
def global_stats(spark, d):
    return S.global_stats(unique(spark, d)).select("n_raters", "n_obs", *r6(*G))


M = [f"raw_{a}" for a in AXES] + [f"adj_{a}" for a in AXES]


@query("work_means", CHAIN + f"select work, support, {s6(*M)} from means")
def work_means(spark, d):
    return S.work_means(unique(spark, d)).select("work", "support", *r6(*M))


@query("selection_stats", CHAIN + f"select work, {', '.join(f'n_{n}, round(place_{n}, 6) as place_{n}' for n in LISTS)} from means")
def selection_stats(spark, d):
    return S.work_means(unique(spark, d)).select("work", *(x for n in LISTS for x in (F.col(f"n_{n}"), F.round(f"place_{n}", 6).alias(f"place_{n}"))))


@query("variant_pick", CHAIN + "select rater, work, o, ln, n_lists, sum_place, best_place, variants from picked where rn = 1")
def variant_pick(spark, d):
    return S.picked(S.ranked(placed(spark, d))).where("rn = 1").select("rater", "work", "o", "ln", "n_lists", "sum_place", "best_place", "variants")


@query("variant_min_rank", CHAIN + f"select rater, work, {', '.join(f'min(r_{n}) as m_{n}' for n in LISTS)} from ranked group by rater, work")
def variant_min_rank(spark, d):
    return S.ranked(placed(spark, d)).groupBy("rater", "work").agg(*(F.min(f"r_{n}").alias(f"m_{n}") for n in LISTS))


@query("top100_lists", CHAIN + "select rater, list, place, work, o, ln, score from placed")
def top100_lists(spark, d):
    return placed(spark, d).select("rater", "list", "place", "work", "o", "ln", "score")


@query("support_rate", CHAIN + "select work, support, round(support_rate, 6) as support_rate from scored")
def support_rate(spark, d):
    u = unique_once(spark, d)
    return S.consensus(u, S.global_stats(u)).select("work", "support", *r6("support_rate"))


@query("rank_adjustment", CHAIN + "select list, place, score, round(5e0 * (50.5e0 - place) / 49.5e0, 6) as adjustment, round(greatest(0e0, least(100e0, score + 5e0 * (50.5e0 - place) / 49.5e0)), 6) as adjusted, count(*) as n from placed group by list, place, score")
def rank_adjustments(spark, d):
    g = placed(spark, d).groupBy("list", "place", "score").agg(F.count("*").alias("n"))
    place = F.col("place")
    return g.select("list", "place", "score", F.round(rank_adjustment(place, SPEC), 6).alias("adjustment"), F.round(adjusted_score(F.col("score"), place, SPEC), 6).alias("adjusted"), "n")


@query("within_merges", CHAIN + "select rater, work, max(variants) as variants, max(case when rn = 1 then o end) as kept_o, sum(case when rn > 1 then o else 0 end) as discarded_o_sum from picked where variants > 1 group by rater, work")
def within_merges(spark, d):
    v = S.picked(S.ranked(placed(spark, d))).where("variants > 1")
    return v.groupBy("rater", "work").agg(F.max("variants").alias("variants"), F.max(F.when(F.col("rn") == 1, F.col("o"))).alias("kept_o"), F.sum(F.when(F.col("rn") > 1, F.col("o")).otherwise(0)).alias("discarded_o_sum"))


@query("group_len_hist", CHAIN + "select n, count(*) as n_groups from (select rater, list, count(*) as n from placed group by rater, list) group by n")
def group_len_hist(spark, d):
    return placed(spark, d).groupBy("rater", "list").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("n_groups"))


EXCLUDED = (("red ring", 1960, "SMALL"), ("blue bolt", 1975, "PROMO"), ("old gear", 1980, "LARGE"), ("small ring", 1961, "ECONOMY"))
EXCLUDED_SQL = "(values " + ", ".join(f"('{t}', {y}, '{m}')" for t, y, m in EXCLUDED) + ") as x(title, year, medium)"


def exclusions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXCLUDED, "title string, year int, medium string")


PART = "(select p_partkey as work, p_name as title, p_brand as creator, p_type as medium, 1950 + p_size as year from part)"


@query("exclusion_anti", f"select work, title, year, medium from {PART} p where not exists (select 1 from {EXCLUDED_SQL} where x.title = p.title and x.year = p.year and x.medium = p.medium)")
def exclusion_anti(spark, d):
    return parts(spark, d).join(F.broadcast(exclusions(spark)), ["title", "year", "medium"], "left_anti").select("work", "title", "year", "medium")


@query("excluded_semi", f"select work, title, year, medium from {PART} p where exists (select 1 from {EXCLUDED_SQL} where x.title = p.title and x.year = p.year and x.medium = p.medium)")
def excluded_semi(spark, d):
    return parts(spark, d).join(F.broadcast(exclusions(spark)), ["title", "year", "medium"], "left_semi").select("work", "title", "year", "medium")


@query(
    "reconcile_counts",
    CHAIN + f""", kept as (select p.* from placed p join {PART} w using (work) where not exists (select 1 from {EXCLUDED_SQL} where x.title = w.title and x.year = w.year and x.medium = w.medium))
select (select count(*) from placed) as collected, (select count(*) from kept) as retained, (select count(*) from placed) - (select count(*) from kept) as excluded,
 (select sum(100 - n) from (select count(*) as n from placed group by rater, list)) as shortfall""",
)
def reconcile_counts(spark, d):
    gone = parts(spark, d).join(F.broadcast(exclusions(spark)), ["title", "year", "medium"], "left_semi").select("work", F.lit(1).alias("out"))
    p = placed(spark, d).groupBy("rater", "list", "work").agg(F.count("*").alias("n")).join(gone, "work", "left")
    g = p.groupBy("rater", "list").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("out").isNull(), F.col("n")).otherwise(0)).alias("kept"))
    return g.agg(F.sum("n").alias("collected"), F.sum("kept").alias("retained"), (F.sum("n") - F.sum("kept")).alias("excluded"), F.sum(100 - F.col("n")).alias("shortfall"))


@query("topk_minima", CHAIN + "select min(case when rank <= 25 then support end) as min_top25, min(case when rank <= 100 then support end) as min_top100, count(case when rank <= 100 and support < 10 then 1 end) as thin_top100 from works")
def topk_minima(spark, d):
    at = lambda k: F.min(F.when(F.col("rank") <= k, F.col("support")))
    return works(spark, d).agg(at(25).alias("min_top25"), at(100).alias("min_top100"), F.count_if((F.col("rank") <= 100) & (F.col("support") < 10)).alias("thin_top100"))


@query("top25", CHAIN + f"select rank, work, title, support, {s6('consensus')} from works where rank <= 25")
def top25(spark, d):
    u = unique_once(spark, d)
    best = S.consensus(u, S.global_stats(u)).join(parts(spark, d), "work").orderBy(*S.by_consensus(), "work").limit(25)
    return S.overall_rank(best).select("rank", "work", "title", "support", *r6("consensus"))


@query("singletons", CHAIN + "select work, support from means where support = 1")
def singletons(spark, d):
    return S.work_means(unique(spark, d)).where("support = 1").select("work", "support")


@query("audit_summary", CHAIN + "select (select n_raters from stats) as raters, (select count(*) from ranked) as observations, (select n_obs from stats) as unique_observations, (select count(*) from means) as works, (select count(*) from means where support = 1) as singletons, (select count(*) from placed) as placements, (select round(sd, 6) from stats) as sd, (select round(max(consensus), 4) from cons) as top_score")
def audit_summary(spark, d):
    u = unique_once(spark, d)
    stats = S.global_stats(u)
    n_obs = S.ranked(placed(spark, d)).agg(F.count("*").alias("observations"), F.sum("n_lists").alias("placements"))
    w = S.consensus(u, stats).agg(F.count("*").alias("works"), F.count_if(F.col("support") == 1).alias("singletons"), F.round(F.max("consensus"), 4).alias("top_score"))
    one = stats.select(F.col("n_raters").alias("raters"), F.col("n_obs").alias("unique_observations"), F.round("sd", 6).alias("sd"))
    return one.crossJoin(n_obs).crossJoin(w)


@query(
    "integrity_checks",
    CHAIN + """select count(*) as works, count(case when abs(consensus - (posterior - 1.645e0 * sd / sqrt(support))) <= 1e-9 then 1 end) as consensus_ok, max(rank) - min(rank) + 1 as rank_span, count(distinct rank) as ranks,
 count(case when support between 1 and n_raters then 1 end) as support_ok, (select count(*) from (select rater, list, place from placed group by rater, list, place having count(*) > 1)) as repeated_places from works""",
)
def integrity_checks(spark, d):
    """Recomputed from the unique observations by another plan, and joined to the published works."""
    u = unique_once(spark, d)
    stats = S.global_stats(u)
    post = F.lit(0.0)
    for a, w in SPEC.weights:
        post = post + F.lit(w) * (F.sum(f"a_{a}") + 10 * F.first(f"ga_{a}")) / (F.count("*") + 10)
    again = u.crossJoin(F.broadcast(stats)).groupBy("work").agg((post - 1.645 * F.first("sd") / F.sqrt(F.count("*"))).alias("again"))
    w = works(spark, d).join(again, "work")
    twice = placed(spark, d).groupBy("rater", "list", "place").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_places"))
    checks = w.agg(
        F.count("*").alias("works"),
        F.count_if(F.abs(F.col("consensus") - F.col("again")) <= 1e-9).alias("consensus_ok"),
        (F.max("rank") - F.min("rank") + 1).alias("rank_span"),
        F.countDistinct("rank").alias("ranks"),
        F.count_if(F.col("support").between(1, F.col("n_raters"))).alias("support_ok"),
    )
    return checks.crossJoin(twice)


# Lists of a rater: the ids are the works' observations.
_ID = "concat_ws('-', work, o, ln)"


@query("list_jaccard", CHAIN + f""", ids as (select distinct rater, list, {_ID} as id from placed), sizes as (select rater, list, count(*) as n from ids group by rater, list),
 meet as (select a.rater, a.list as list_a, b.list as list_b, count(*) as shared from ids a join ids b on a.rater = b.rater and a.id = b.id and a.list < b.list group by 1, 2, 3)
select x.rater, x.list as list_a, y.list as list_b, coalesce(shared, 0) as shared, round(coalesce(shared, 0) / cast(x.n + y.n - coalesce(shared, 0) as double), 3) as jaccard
from sizes x join sizes y on x.rater = y.rater and x.list < y.list left join meet on meet.rater = x.rater and list_a = x.list and list_b = y.list""")
def list_jaccard(spark, d):
    """Lists of an id are gathered (four at most), so pairs come from short arrays and not from a self-join."""
    per = placed(spark, d).groupBy("rater", F.expr(_ID).alias("id")).agg(F.sort_array(F.collect_set("list")).alias("lists"))
    pairs = lambda xs: F.flatten(F.transform(xs, lambda x: F.transform(F.filter(xs, lambda y: y > x), lambda y: F.struct(x.alias("list_a"), y.alias("list_b")))))
    shared = per.select("rater", F.inline(pairs(F.col("lists")))).groupBy("rater", "list_a", "list_b").agg(F.count("*").alias("shared"))
    sizes = per.select("rater", F.explode("lists").alias("list")).groupBy("rater", "list").agg(F.count("*").alias("n"))
    every = sizes.groupBy("rater").agg(F.map_from_entries(F.collect_list(F.struct("list", "n"))).alias("n"), F.sort_array(F.collect_list("list")).alias("lists"))
    all_pairs = every.select("rater", "n", F.inline(pairs(F.col("lists")))).join(shared, ["rater", "list_a", "list_b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    whole = F.col("n")[F.col("list_a")] + F.col("n")[F.col("list_b")] - F.col("shared")
    return all_pairs.select("rater", "list_a", "list_b", "shared", F.round(F.col("shared") / whole, 3).alias("jaccard"))


@query("unique_to_list", CHAIN + f"select rater, list, count(*) as n from (select rater, {_ID} as id, min(list) as list from placed group by 1, 2 having count(distinct list) = 1) group by rater, list")
def unique_to_list(spark, d):
    alone = placed(spark, d).groupBy("rater", F.expr(_ID).alias("id")).agg(F.min("list").alias("list"), F.max("list").alias("last")).where("list = last")
    return alone.groupBy("rater", "list").agg(F.count("*").alias("n"))


@query("list_union", CHAIN + f"select rater, count(distinct {_ID}) as n from placed group by rater")
def list_union(spark, d):
    return placed(spark, d).select("rater", F.expr(_ID).alias("id")).distinct().groupBy("rater").agg(F.count("*").alias("n"))


def _two(spark, d):
    p = placed(spark, d)
    ids = lambda name: p.where(F.col("list") == name).select("rater", F.expr(_ID).alias("id"))
    return ids("ambition"), ids("originality")


_TWO = CHAIN + f", a as (select rater, {_ID} as id from placed where list = 'ambition'), b as (select rater, {_ID} as id from placed where list = 'originality') "


@query("list_setops", _TWO + "select 'both' as kind, rater, id from (select * from a intersect select * from b) union all select 'only_ambition', rater, id from (select * from a except select * from b)")
def list_setops(spark, d):
    a, b = _two(spark, d)
    tag = lambda df, k: df.select(F.lit(k).alias("kind"), "rater", "id")
    return tag(a.intersect(b), "both").union(tag(a.subtract(b), "only_ambition"))


@query("pilot_gate", CHAIN + f""", lists as (select rater, list, count(*) as n, count(distinct {_ID}) as n_ids from placed group by rater, list),
 same as (select rater, max(k) as k from (select rater, {_ID} as id, count(distinct list) as k from placed group by 1, 2) group by rater)
select l.rater, bool_and(n = 100) as full_lists, bool_and(n = n_ids) as no_repeats, max(k) as most_lists_of_an_id from lists l join same using (rater) group by l.rater""")
def pilot_gate(spark, d):
    per = placed(spark, d).groupBy("rater", F.expr(_ID).alias("id"), "list").agg(F.count("*").alias("n"))
    lists = per.groupBy("rater", "list").agg(F.sum("n").alias("n"), F.count("*").alias("n_ids")).groupBy("rater").agg(F.bool_and(F.col("n") == 100).alias("full_lists"), F.bool_and(F.col("n") == F.col("n_ids")).alias("no_repeats"))
    most = per.groupBy("rater", "id").agg(F.count("*").alias("k")).groupBy("rater").agg(F.max("k").alias("most_lists_of_an_id"))
    return lists.join(most, "rater")


_LONG = "select rater, axis, score from obs unpivot (score for axis in (" + ", ".join(AXES) + "))"


@query("unpivot_axes", CHAIN + f"select axis, score, count(*) as n from ({_LONG}) group by axis, score")
def unpivot_axes(spark, d):
    long = obs(spark, d).unpivot(["rater"], list(AXES), "axis", "score")
    return long.groupBy("axis", "score").agg(F.count("*").alias("n"))


@query("score_distribution", CHAIN + f"select rater, axis, min(score) as least, round(avg(score), 2) as mean, median(score) as median, max(score) as most, count(distinct score) as n_distinct from ({_LONG}) group by rater, axis")
def score_distribution(spark, d):
    """Counts by score come first, so a rater's rows meet as 101 scores at most."""
    long = obs(spark, d).unpivot(["rater"], list(AXES), "axis", "score").groupBy("rater", "axis", "score").agg(F.count("*").alias("n"))
    return long.groupBy("rater", "axis").agg(
        F.min("score").alias("least"),
        F.round(F.sum(F.col("score") * F.col("n")) / F.sum("n"), 2).alias("mean"),
        F.percentile("score", F.lit(0.5), F.col("n")).alias("median"),
        F.max("score").alias("most"),
        F.count("*").alias("n_distinct"),
    )


@query("axis_dim", "select * from (values " + ", ".join(f"('{a}', {i}, {w}e0, {str(SPEC.list_of(a) is not None).lower()}, {str(a in SPEC.adjusted).lower()}, '{SPEC.list_of(a) or ''}')" for i, (a, w) in enumerate(SPEC.weights)) + ") as t(axis, position, weight, selection_axis, rank_adjusted, list)")
def axis_dim(spark, d):
    rows = [(a, i, w, SPEC.list_of(a) is not None, a in SPEC.adjusted, SPEC.list_of(a) or "") for i, (a, w) in enumerate(SPEC.weights)]
    return spark.createDataFrame(rows, "axis string, position int, weight double, selection_axis boolean, rank_adjusted boolean, list string")


@query("era_histogram", CHAIN + "select medium, case when year < 1950 then 'before 1950' when year < 1980 then '1950-1979' when year < 2010 then '1980-2009' else 'since 2010' end as era, count(*) as n from works group by 1, 2")
def era_histogram(spark, d):
    y = F.col("year")
    era = F.when(y < 1950, "before 1950").when(y < 1980, "1950-1979").when(y < 2010, "1980-2009").otherwise("since 2010")
    return S.work_means(unique(spark, d)).select("work").join(parts(spark, d), "work").groupBy("medium", era.alias("era")).agg(F.count("*").alias("n"))


@query("selections_enriched", CHAIN + "select p.rater, p.list, p.place, w.work, w.title, w.rank from placed p join works w using (work) join " + PART.replace("select", "select") + f" q using (work) where not exists (select 1 from {EXCLUDED_SQL} where x.title = q.title and x.year = q.year and x.medium = q.medium)")
def selections_enriched(spark, d):
    w = works(spark, d).join(F.broadcast(exclusions(spark)), ["title", "year", "medium"], "left_anti").select("work", "title", "rank")
    return placed(spark, d).join(w, "work").select("rater", "list", "place", "work", "title", "rank")


@query("dict_encode", CHAIN + """, seen as (select s, min(k) as k from (select title as s, rank * 3 as k from works union all select creator, rank * 3 + 1 from works union all select medium, rank * 3 + 2 from works) group by s),
 dict as (select s, dense_rank() over (order by k) - 1 as id from seen)
select rank, a.id as title_id, b.id as creator_id, c.id as medium_id, round(consensus, 6) as consensus from works join dict a on a.s = title join dict b on b.s = creator join dict c on c.s = medium""")
def dict_encode(spark, d):
    """String ids in the order of first occurrence, over a table of one row a work."""
    w = works(spark, d).select("rank", "title", "creator", "medium", "consensus")
    cells = w.select(F.inline(F.array(*(F.struct(F.col(c).alias("s"), (F.col("rank") * 3 + i).alias("k")) for i, c in enumerate(("title", "creator", "medium"))))))
    ids = cells.groupBy("s").agg(F.min("k").alias("k")).select("s", (F.dense_rank().over(Window.orderBy("k")) - 1).alias("id"))
    for c in ("title", "creator", "medium"):
        w = w.join(ids.select(F.col("s").alias(c), F.col("id").alias(f"{c}_id")), c)
    return w.select("rank", "title_id", "creator_id", "medium_id", *r6("consensus"))
