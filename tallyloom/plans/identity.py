"""Queries on identities: parts read as works to reconcile."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import identity as I
from tallyloom.operators.components import components
from tallyloom.plans.registry import query
from tallyloom.plans.survey import CHAIN, PART, obs, parts, unique
from tallyloom.sources.config import Identity
from tallyloom.sources.star import table
from tallyloom.spec import ALIASES, DATASETS, DEFAULT_DATASET

#: Part types as media.
RULES = I.MediaRules({"SMALL": "compact", "MEDIUM": "compact", "LARGE": "regular", "STANDARD": "regular"}, ("compact",), (("LARGE", "PROMO"),), {"LARGE": "shelf", "PROMO": "shelf"})


def _case(d: dict[str, str], c: str) -> str:
    return "case " + " ".join(f"when {c} = '{k}' then '{v}'" for k, v in d.items()) + f" else {c} end"


def _norm(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


_KEY = f"array_to_string(list_sort(list_filter(string_split({_norm('creator')}, ' '), lambda w: w not in ('and', 'with', 'the', ''))), ' ')"
_FAM = _case(RULES.families, "medium")
_BUCKET = _case(RULES.families | RULES.buckets, "medium")
_match = lambda a, b: f"({a} = {b} or ({_case(RULES.families, a)} = 'compact' and {_case(RULES.families, b)} = 'compact') or ({a} = 'LARGE' and {b} = 'PROMO') or ({a} = 'PROMO' and {b} = 'LARGE'))"
_IDS = f"with ids as (select work as id, {_norm('title')} as title, {_KEY} as creator_key, medium, {_FAM} as family, {_BUCKET} as bucket, year, creator from {PART})"
_words = lambda t: f"list_distinct(string_split({t}.creator_key, ' '))"
_REL = f"len(list_intersect({_words('a')}, {_words('b')})) * 2 >= least(len({_words('a')}), len({_words('b')}))"
_EXACT = "exact as (select distinct m.a, i.id as b from ids i join (select title, creator_key, family, min(id) as a from ids group by 1, 2, 3) m using (title, creator_key, family) where i.id > m.a)"
_BAND = f"band as (select distinct a.id as a, b.id as b from ids a join ids b on a.title = b.title and a.bucket = b.bucket and abs(a.year - b.year) <= 1 and a.id < b.id where {_match('a.medium', 'b.medium')} and (a.medium = b.medium or {_REL}))"


def ids(spark, d):
    p = parts(spark, d)
    titles = X.title_candidates(F.col("title"), F.lit(""))
    return p.select(F.col("work").alias("id"), "title", titles.alias("titles"), X.creator_key(F.col("creator")).alias("creator_key"), "creator", "medium", "year")


@query("family_map", f"select medium, {_FAM} as family, {_BUCKET} as bucket, count(*) as n from {PART} group by 1, 2, 3")
def family_map(spark, d):
    m = F.col("medium")
    return parts(spark, d).groupBy("medium").agg(F.count("*").alias("n")).select("medium", RULES.family(m).alias("family"), RULES.bucket(m).alias("bucket"), "n")


@query("media_compat", f"select a.medium as medium_a, b.medium as medium_b from (select distinct p_type as medium from part) a cross join (select distinct p_type as medium from part) b where {_match('a.medium', 'b.medium')}")
def media_compat(spark, d):
    return I.compatible_pairs(parts(spark, d), RULES)


@query("creator_key", f"select work, {_KEY} as creator_key from {PART}")
def creator_key(spark, d):
    return parts(spark, d).select("work", X.creator_key(F.col("creator")).alias("creator_key"))


@query("creators_related", f"with k as (select distinct {_KEY} as creator_key from {PART} where work % 3 = 0 union select distinct 'studio ' || work % 40 || ' ' || work % 7 from {PART}) select a.creator_key as key_a, b.creator_key as key_b from k a join k b on a.creator_key < b.creator_key where {_REL}")
def creators_related(spark, d):
    """Brands of parts and made-up names of two numbers."""
    p = parts(spark, d)
    made = p.select(F.concat_ws(" ", F.lit("studio"), F.col("work") % 40, F.col("work") % 7).alias("k"))
    return I.related_pairs(p.where("work % 3 = 0").select(X.creator_key(F.col("creator")).alias("k")).union(made))


@query("title_candidates", f"select work, list_sort(list_distinct(list_filter([{_norm('title')}, {_norm('creator')}, trim(regexp_replace({_norm('title')}, ' (film|novel|novella|book|tv series|television series|series|video game|game|anime|manga)$', ''))], lambda x: x <> ''))) as titles from {PART}")
def title_candidates(spark, d):
    return parts(spark, d).select("work", X.title_candidates(F.col("title"), F.col("creator")).alias("titles"))


@query("identity_counts", CHAIN + "select title, creator, year, medium, sum(support) as n from works group by all")
def identity_counts(spark, d):
    support = unique(spark, d).groupBy("work").agg(F.count("*").alias("n"))
    return support.join(parts(spark, d), "work").groupBy("title", "creator", "year", "medium").agg(F.sum("n").alias("n"))


@query("exact_edges", f"{_IDS}, {_EXACT} select a, b from exact")
def exact_edges(spark, d):
    return I.exact_edges(ids(spark, d), RULES)


@query("band_pairs", f"{_IDS}, {_BAND} select a, b from band")
def band_pairs(spark, d):
    return I.band_pairs(ids(spark, d), RULES)


_CLUSTERS = _IDS.replace("with ids", "with recursive ids") + f""", {_EXACT}, {_BAND}, edges as (select a, b from exact union select a, b from band),
 both_ways as (select a, b from edges union select b as a, a as b from edges),
 reach(id, x) as (select id, id from ids union select r.id, e.b from reach r join both_ways e on e.a = r.x where e.b < r.id or true),
 clusters as (select id, min(x) as cluster from reach group by id)"""


def clusters(spark, d):
    i = ids(spark, d)
    named = components(I.links(i, RULES))
    return i.join(named, F.col("id") == F.col("node"), "left").withColumn("cluster", F.coalesce("component", "id")).drop("node", "component")


@query("entity_clusters", _CLUSTERS + " select id, cluster from clusters")
def entity_clusters(spark, d):
    return clusters(spark, d).select("id", "cluster")


@query("canonical_pick", _CLUSTERS + """, n as (select l_partkey as id, count(*) as n from lineitem group by 1),
 m as (select c.cluster, p.work as id, p.title, p.year, p.medium, coalesce(n.n, 0) as n from clusters c join """ + PART + """ p on p.work = c.id left join n on n.id = c.id)
 select cluster, id, title, year, medium from (select *, row_number() over (partition by cluster order by (medium <> 'LARGE'), n desc, length(title), year, lower(title), id) as rn from m) where rn = 1""")
def canonical_pick(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"))
    return I.canonical(clusters(spark, d).join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))), "LARGE")


ALIAS = (("red ring", "ring, red"), ("blue bolt", "bolt of blue"), ("old gear", "gear"), ("small bolt", "bolt"))
_ALIAS_SQL = "(values " + ", ".join(f"('{min(pair)}', '{name}')" for pair in ALIAS for name in sorted(set(pair))) + ") as t(canonical, name)"


@query("alias_lookup", f"select work, title, coalesce(canonical, title) as resolved from {PART} p left join {_ALIAS_SQL} on t.name = p.title")
def alias_lookup(spark, d):
    """Pairs of names; the last assignment of a name holds."""
    last = {name: min(a, b) for a, b in ALIAS for name in (a, b)}
    aliases = spark.createDataFrame(sorted(last.items()), "title string, canonical string")
    return parts(spark, d).join(F.broadcast(aliases), "title", "left").select("work", "title", F.coalesce("canonical", "title").alias("resolved"))


OVERRIDES = ((1, "ring", "SMALL", "ring (small)"), (2, "ring", None, "ring"), (3, "bolt", "PROMO", "bolt (promo)"), (4, "red", None, "red thing"))
_OV = "(values " + ", ".join(f"({p}, '{w}', {repr(m) if m else 'null'}, '{r}')" for p, w, m, r in OVERRIDES) + ") as r(priority, word, only_medium, replacement)"


@query("override_first_match", f"select work, title, coalesce((select arg_min(replacement, priority) from {_OV} where contains(p.title, word) and (only_medium is null or only_medium = p.medium)), title) as resolved from {PART} p")
def override_first_match(spark, d):
    holds = lambda word, only: F.contains("title", F.lit(word)) & (F.col("medium") == only if only else F.lit(True))
    rules = [(holds(word, only), F.lit(to)) for _, word, only, to in sorted(OVERRIDES)]
    return parts(spark, d).select("work", "title", I.first_match(rules, F.col("title")).alias("resolved"))


CORRECTIONS = (
    I.Override(("The Red Ring", "blue ring"), Identity("The Ring", "", "Brand#1", 1960, "LARGE"), ("Brand#3", "brand 4"), ("SMALL", "LARGE")),
    I.Override(("red ring",), Identity("Red Ring", "", "Brand#2", 1961, "PROMO"), ("4 brand",), by_words=True, keep_original=True),
    I.Override(("old gear",), Identity("The Old Gear", "Gear", "Brand#9", 1977, "ECONOMY")),
)


@query("identity_overrides", f"""select work, case k when 1 then 'The Ring' when 2 then 'Red Ring' when 3 then 'The Old Gear' else title end as title, case k when 1 then '' when 3 then 'Gear' else original end as original_title,
 case k when 1 then 'Brand#1' when 2 then 'Brand#2' when 3 then 'Brand#9' else creator end as creator, case k when 1 then 1960 when 2 then 1961 when 3 then 1977 else year end as year, case k when 1 then 'LARGE' when 2 then 'PROMO' when 3 then 'ECONOMY' else medium end as medium
 from (select *, case when title in ('red ring', 'blue ring') and creator in ('Brand#3', 'Brand#4') and medium in ('SMALL', 'LARGE') then 1 when title = 'red ring' and creator = 'Brand#4' then 2 when title = 'old gear' then 3 end as k
  from (select work, title, creator, year, medium, 'o' || work % 5 as original from {PART}))""")
def identity_overrides(spark, d):
    """Corrections of known identities; the season goes from titles of one medium."""
    p = parts(spark, d).withColumn("original_title", F.concat(F.lit("o"), F.col("work") % 5))
    p = p.withColumn("title", F.when(F.col("medium") == "SMALL", F.concat("title", F.lit(": Season "), F.col("work") % 9)).otherwise(F.col("title")))
    return I.identified(p, CORRECTIONS, "SMALL").select("work", "title", "original_title", "creator", "year", "medium")


# rule, precedence, kind, component, title, creator, medium, parent
SERIES = tuple(
    (rule, prec, kind, comp, title, f"Brand#{b}", "SMALL", parent)
    for rule, prec, kind, comp, title, parent in ((1, 0, "parent", 0, "red ring", "ring saga"), (1, 1, "continuous", 1, "blue ring", "ring saga"), (1, 2, "standalone", 2, "small ring", "ring saga"), (2, 2, "standalone", 1, "small bolt", "bolt saga"), (2, 2, "standalone", 2, "old bolt", "bolt saga"), (1, 2, "standalone", 3, "red ring", "ring saga"), (2, 0, "parent", 0, "small ring", "bolt saga"))
    for b in range(1, 26)
)
SERIES_SUPPORT = 10
_SERIES = "series as (select * from (values " + ", ".join(str(r) for r in SERIES) + ") as t(rule_ord, precedence, kind, component, title, creator, medium, parent))"
_HIT = f"with {_SERIES}, hit as (select s.*, l_suppkey as rater, p_partkey as work, 1950 + p_size as year from lineitem join part on l_partkey = p_partkey join series s on s.title = p_name and s.creator = p_brand and s.medium = p_type), support as (select rule_ord, component, count(distinct rater) as support from hit where kind = 'standalone' group by 1, 2), decisive as (select * from hit where (rule_ord, precedence, component) = (select min((s.rule_ord, s.precedence, s.component)) from series s where s.title = hit.title and s.creator = hit.creator and s.medium = hit.medium))"


def _series(spark, d):
    c = spark.createDataFrame(SERIES, "rule_ord int, precedence int, kind string, component int, title string, creator string, medium string, parent string")
    rows = obs(spark, d).select("rater", "work").join(parts(spark, d), "work")
    return I.rollup(rows, c, SERIES_SUPPORT)


@query("rollup_support", _HIT + " select * from support")
def rollup_support(spark, d):
    return _series(spark, d)[0]


@query("rollup_decisions", _HIT + f" select title, parent, reason, support, count(distinct rater) as raters, count(*) as n from (select h.title, h.parent, h.rater, s.support, case when kind <> 'standalone' then kind when s.support >= {SERIES_SUPPORT} then 'preserved' else 'rolled up' end as reason from decisive h left join support s using (rule_ord, component)) group by 1, 2, 3, 4")
def rollup_decisions(spark, d):
    return _series(spark, d)[1].groupBy("title", "parent", "reason", "support").agg(F.countDistinct("rater").alias("raters"), F.count("*").alias("n"))


COHORTS = (("general", 1, 35), ("genre", 36, 70), ("world", 71, 95), ("contrary", 96, 100))


@query("cohort_expand", "select name as cohort, unnest(range(a, b + 1)) as agent, 'scorer-' || lpad(cast(unnest(range(a, b + 1)) as varchar), 3, '0') as agent_id from (values " + ", ".join(map(str, COHORTS)) + ") as t(name, a, b)")
def cohort_expand(spark, d):
    """Ranges of rater numbers as rows; every number of 1 to 100 is asked for once."""
    c = spark.createDataFrame(COHORTS, "cohort string, a bigint, b bigint")
    out = c.select("cohort", F.explode(F.sequence("a", "b")).alias("agent"))
    return out.withColumn("agent_id", F.concat(F.lit("scorer-"), F.lpad(F.col("agent").cast("string"), 3, "0")))


@query("dataset_alias", "select name, case when name in ('v1', 'v3') then 'v1' else 'v2' end as dataset, case when name in ('v1', 'v3') then 4 else 5 end as axes from (values ('v1'), ('v2'), ('v3'), ('v4'), (''), ('other')) as t(name)")
def dataset_alias(spark, d):
    names = ["v1", "v2", "v3", "v4", "", "other"]
    rows = [(n, key := ALIASES.get(n, DEFAULT_DATASET), len(DATASETS[key].axes)) for n in names]
    return spark.createDataFrame(rows, "name string, dataset string, axes int")
