"""Queries of the explorer, lookups, reports and checks of rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyloom.functions import text as X
from tallyloom.functions.scoring import rounded
from tallyloom.operators import lookups as L
from tallyloom.operators.explorer import ExplorerQuery, Field
from tallyloom.plans.registry import query
from tallyloom.plans.survey import AXES, CHAIN, LISTS, obs, parts, placed, works
from tallyloom.sources import reports
from tallyloom.sources.star import LOCAL, table
from tallyloom.spec import FIVE_AXES

FIELDS = (
    Field("rank", "Rank", "rank"),
    Field("title", "Title", "text"),
    Field("medium", "Medium", "category"),
    Field("year", "Year", "year"),
    Field("consensus", "Consensus", "number"),
    Field("support_rate", "Support", "percent"),
    Field("place_ambition", "Mean place, ambition", "number"),
)
VIEW = ExplorerQuery(FIELDS, search_columns=("title", "creator", "medium", "year"))


@query("filter_conj", CHAIN + "select rank, work, title from works where medium = 'SMALL' and year = 1975 and contains(lower(concat_ws(' ', title, creator, medium, cast(year as varchar))), 'r')")
def filter_conj(spark, d):
    q = VIEW.where("medium", "SMALL").where("year", 1975).searched("R")
    return q.matching(works(spark, d)).select("rank", "work", "title")


@query("sort_two_key", CHAIN + "select row_number() over (order by round(place_ambition, 6) desc nulls first, medium asc nulls last, rank) as pos, rank, work, medium from works")
def sort_two_key(spark, d):
    """Positions in the view's order; the view itself is sorted without them."""
    q = ExplorerQuery((*FIELDS, Field("p", "p", "number"))).sorted_by("p", False).then_by("medium", True)
    w = works(spark, d).withColumn("p", F.round("place_ambition", 6))
    return w.withColumn("pos", F.row_number().over(Window.orderBy(*q.order()))).select("pos", "rank", "work", "medium")


@query("sort_natural", "select row_number() over (order by lower(regexp_extract(p_brand, '^[^0-9]*')), cast(regexp_extract(p_brand, '([0-9]+)$', 1) as bigint), p_partkey) as pos, p_partkey as work, p_brand as brand from part")
def sort_natural(spark, d):
    p = table(spark, d, "part")
    return p.select(F.row_number().over(Window.orderBy(X.natural_key(F.col("p_brand")), "p_partkey")).alias("pos"), F.col("p_partkey").alias("work"), F.col("p_brand").alias("brand"))


@query("page_slice", CHAIN + "select rank, work, title, year from works order by year, title, rank limit 25 offset 50")
def page_slice(spark, d):
    q = ExplorerQuery(FIELDS, sorts=(("year", True), ("title", True)), page=2, page_size=25)
    return q.slice(works(spark, d)).select("rank", "work", "title", "year")


@query("display_columns", CHAIN + "select work, cast(round(cast(round(consensus, 6) as decimal(18, 6)), 2) as varchar) as consensus, printf('%.1f', 100 * support_rate) || '%' as support, case when place_ambition is null then '—' else cast(round(cast(round(place_ambition, 6) as decimal(18, 6)), 2) as varchar) end as place, replace(medium, '_', ' ') as medium, lpad(cast(rank as varchar), cast(greatest(3, length(cast(rank as varchar))) as integer), '0') as rank from works")
def display_columns(spark, d):
    w = works(spark, d).withColumns({c: rounded(F.col(c), 6) for c in ("consensus", "place_ambition")})
    f = {x.key: x.shown() for x in FIELDS}
    rank = F.col("rank").cast("string")
    return w.select("work", f["consensus"].alias("consensus"), f["support_rate"].alias("support"), f["place_ambition"].alias("place"), f["medium"].alias("medium"), F.lpad(rank, F.greatest(F.lit(3), F.length(rank)), F.lit("0")).alias("rank"))


@query("distinct_union", "select p_type as value from part union select o_orderpriority from orders")
def distinct_union(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("value")).union(table(spark, d, "orders").select("o_orderpriority")).distinct()


@query("left_lookup_last", "select c_custkey, (select max_by(s_name, s_suppkey) from supplier where s_nationkey = c_nationkey) as supplier from customer")
def left_lookup_last(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("supplier"), "s_suppkey")
    return L.left_lookup_last(c, s, ["nation"], "supplier", "s_suppkey").select("c_custkey", "supplier")


@query("full_outer_diff", "select coalesce(a.k, b.k) as k, case when b.k is null then 'missing' else 'stale' end as status from (select distinct c_custkey as k from customer) a full outer join (select distinct o_custkey + 7 as k from orders) b on a.k = b.k where a.k is null or b.k is null")
def full_outer_diff(spark, d):
    return L.key_difference(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select((F.col("o_custkey") + 7).alias("k")), ["k"])


@query("waterfall", """select n_nationkey as k, coalesce(case when a.v is not null then 0 end, case when b.v is not null then 1 end, case when c.v is not null then 2 end) as source, coalesce(a.v, b.v, c.v) as evidence from nation
 left join (select s_nationkey as k, min(s_name) as v from supplier where s_acctbal > 9000 group by 1) a on a.k = n_nationkey
 left join (select c_nationkey as k, min(c_name) as v from customer where c_acctbal > 9900 group by 1) b on b.k = n_nationkey
 left join (select n_nationkey as k, n_name as v from nation) c on c.k = n_nationkey""")
def waterfall(spark, d):
    pending = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    sources = [
        table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("evidence")),
        table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("evidence")),
        table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("evidence")),
    ]
    return L.waterfall(pending, sources, ["k"], "evidence")


MANUAL = ((1, "red ring", "a"), (2, "blue bolt — Brand#3", "b"), (3, "blue bolt", "c"), (4, "red ring", "d"), (5, "old gear — Brand#9", "e"))
_MANUAL = "(select key, max_by(value, ord) as value from (values " + ", ".join(map(str, MANUAL)) + ") as t(ord, key, value) group by key)"


@query("fallback_lookup", f"select p_partkey as work, coalesce(a.value, b.value) as value from part left join {_MANUAL} a on a.key = p_name || ' — ' || p_brand left join {_MANUAL} b on b.key = p_name")
def fallback_lookup(spark, d):
    m = spark.createDataFrame(MANUAL, "ord int, key string, value string")
    p = parts(spark, d).select("work", F.col("title").alias("k2"), F.concat_ws(" — ", "title", "creator").alias("k1"))
    return L.fallback_lookup(p, m, "k1", "k2").select("work", "value")


_OBS = CHAIN.split(",\nlong as")[0]


@query("valid_rows", _OBS + " select rater, count(*) as n, count(case when qty between 1 and 50 and price > 0 and influence between 0 and 100 and ambition between 0 and 100 and fairness between 0 and 90 and originality between 1 and 100 then 1 end) as n_valid from obs group by rater")
def valid_rows(spark, d):
    c = F.col
    ok = c("qty").between(1, 50) & (c("price") > 0) & c("influence").between(0, 100) & c("ambition").between(0, 100) & c("fairness").between(0, 90) & c("originality").between(1, 100)
    return obs(spark, d).groupBy("rater").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_valid"))


@query("dup_toggle", _OBS + " select o, ln, rn, cnt, rn = cnt and cnt % 2 = 1 as kept, rn % 2 = 0 as flagged from (select o, ln, row_number() over (partition by o, ln order by work, rater, price, qty) as rn, count(*) over (partition by o, ln) as cnt from obs) where cnt > 1")
def dup_toggle(spark, d):
    w = Window.partitionBy("o", "ln")
    x = obs(spark, d).select("o", "ln", F.row_number().over(w.orderBy("work", "rater", "price", "qty")).alias("rn"), F.count("*").over(w).alias("cnt")).where("cnt > 1")
    return x.select("*", ((F.col("rn") == F.col("cnt")) & (F.col("cnt") % 2 == 1)).alias("kept"), (F.col("rn") % 2 == 0).alias("flagged"))


@query("unknown_refs", "select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def unknown_refs(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("unreferenced", CHAIN + "select rater, work, o, ln from (select distinct rater, work, o, ln, price, qty from obs) x where not exists (select 1 from placed p where p.rater = x.rater and p.work = x.work and p.o = x.o and p.ln = x.ln and p.price = x.price and p.qty = x.qty)")
def unreferenced(spark, d):
    key = ["rater", "work", *LOCAL]
    return obs(spark, d).select(*key).distinct().join(placed(spark, d).select(*key), key, "left_anti").select("rater", "work", "o", "ln")


@query("rank_join", CHAIN + f"select p.rater, p.list, p.place, p.work, w.title, w.year from placed p join (select p_partkey as work, p_name as title, 1950 + p_size as year from part where p_size > 10) w using (work)")
def rank_join(spark, d):
    return placed(spark, d).join(parts(spark, d).where("year > 1960"), "work").select("rater", "list", "place", "work", "title", "year")


@query("explode_works", "select l_orderkey as o, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as idx, l_partkey as work from lineitem")
def explode_works(spark, d):
    """Works of a report as rows with their place in it: here, lines of an order."""
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("works"))
    return a.select("o", F.posexplode("works").alias("pos", "w")).select("o", (F.col("pos") + 1).cast("long").alias("idx"), F.col("w.l_partkey").alias("work"))


@query("explode_rankings", CHAIN + "select rater, list, work, min(place) as place from placed group by rater, list, work")
def explode_rankings(spark, d):
    """Lists as arrays and back: the first position of a repeated id holds."""
    lists = placed(spark, d).groupBy("rater", "list").agg(F.sort_array(F.collect_list(F.struct("place", "work"))).alias("ids"))
    rows = lists.select("rater", "list", F.posexplode(F.transform("ids", lambda x: x["work"])).alias("pos", "work"))
    return rows.groupBy("rater", "list", "work").agg((F.min("pos") + 1).cast("long").alias("place"))


def report_rows(spark, d):
    """Reports as their JSON texts, one for each rater: the works that its lists hold, and the lists."""
    p = placed(spark, d).withColumn("work_id", F.concat_ws("-", F.lit("w"), "work", "o", "ln"))
    scores = F.struct(*AXES)
    head = p.join(parts(spark, d), "work").select("rater", F.struct("work_id", "title", F.lit("").alias("original_title"), "creator", "year", F.lit("film").alias("medium"), scores.alias("scores")).alias("w")).distinct()
    w = head.groupBy("rater").agg(F.sort_array(F.collect_list("w")).alias("works"))
    lists = p.groupBy("rater", "list").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "work_id"))), lambda x: x["work_id"]).alias("ids"))
    axes = lists.groupBy("rater").agg(F.map_from_entries(F.collect_list(F.struct("list", "ids"))).alias("axes"))
    rater = F.col("rater").cast("string")
    number = F.lpad(rater, F.greatest(F.lit(3), F.length(rater)), F.lit("0"))
    text = F.to_json(F.struct(F.concat(F.lit("scorer-"), number).alias("agent_id"), "works", "axes"))
    return w.join(axes, "rater").select(F.concat(F.lit("agent_"), number, F.lit(".json")).alias("file"), text.alias("text"))


_FILE = "'agent_' || lpad(cast(rater as varchar), cast(greatest(3, length(cast(rater as varchar))) as integer), '0') || '.json'"
_REPORT = f""", entry as (select distinct rater, 'w-' || work || '-' || o || '-' || ln as id, p_name as title, p_brand as creator, {', '.join(AXES)} from placed join part on p_partkey = work),
 nth as (select *, row_number() over (partition by rater order by id, title, creator, {', '.join(AXES)}) as pos from entry),
 listed as (select rater, list, place, 'w-' || work || '-' || o || '-' || ln as id, count(*) over (partition by rater, list) as n from placed),
 said as (select rater, 'works: ' || count(*) as message from nth group by rater having count(*) not between 100 and 400
  union all select rater, 'work ' || pos || ': duplicate id ' || id from (select *, row_number() over (partition by rater, id order by pos) as k from nth) where k > 1
  union all select rater, 'work ' || pos || ': duplicate work ' || title from (select *, row_number() over (partition by rater, title, creator order by pos) as k from nth) where k > 1
  union all select distinct rater, list || ' has ' || n from listed where n <> 100
  union all select rater, list || ' repeats an id' from listed where n = 100 group by rater, list having count(distinct id) < 100
  union all select distinct rater, 'unreferenced ' || id from nth where (rater, id) not in (select (rater, id) from listed where n = 100))"""


@query("validate_report", CHAIN + _REPORT + f" select {_FILE} as file, count(message) as n_messages, md5(coalesce(string_agg(message, '; ' order by message), '')) as messages_md5 from (select distinct rater from placed) left join said using (rater) group by rater")
def validate_report(spark, d):
    """The strict validator over the reports that the raters' lists make."""
    m = reports.validate(report_rows(spark, d), FIVE_AXES)
    return m.select("file", F.size("messages").cast("long").alias("n_messages"), F.md5(F.array_join("messages", "; ")).alias("messages_md5"))


@query("scan_reports", CHAIN + f"select rater as number, work, o, ln, min({AXES[0]}) as {AXES[0]}, {', '.join(f'min(r_{n}) as r_{n}' for n in LISTS)} from ranked group by rater, work, o, ln having count(*) % 2 = 1")
def scan_reports(spark, d):
    """Reports written as JSON and read again: works parsed and checked, ids resolved, places joined."""
    o = reports.parse(report_rows(spark, d), FIVE_AXES).observations
    part = F.split("work_id", "-")
    number = lambda k: F.element_at(part, k).cast("long")
    return o.select(F.col("number").cast("long").alias("number"), number(2).alias("work"), number(3).alias("o"), number(4).cast("int").alias("ln"), AXES[0], *(F.col(f"r_{n}").cast("long").alias(f"r_{n}") for n in LISTS))


def faulty_rows(spark, d):
    """The reports with faults by rule: years out of range, works that the lists alone have, and works that no list has."""
    r = report_rows(spark, d).select("file", F.from_json("text", "agent_id string, works array<struct<work_id: string, title: string, original_title: string, creator: string, year: bigint, medium: string, scores: struct<" + ", ".join(f"{a}: bigint" for a in AXES) + ">>>, axes map<string, array<string>>").alias("r"))
    o = lambda w: F.element_at(F.split(w["work_id"], "-"), 3).cast("long")
    there = F.filter("r.works", lambda w: o(w) % 13 != 0)
    aged = F.transform(there, lambda w: F.when(o(w) % 17 == 0, w.withField("year", F.lit(999).cast("long"))).otherwise(w))
    loose = F.transform(F.filter("r.works", lambda w: o(w) % 19 == 0), lambda w: w.withField("work_id", F.concat(F.lit("z-"), w["work_id"])))
    return r.select("file", F.to_json(F.struct("r.agent_id", F.concat(aged, loose).alias("works"), "r.axes")).alias("text"))


_FAULTY = _REPORT + f""", file as (select *, {_FILE} as file, cast(string_split(id, '-')[3] as bigint) as ord from nth),
 given as (select *, row_number() over (partition by file order by pos) as nr, count(*) over (partition by file) as n_given from file where ord % 13 <> 0),
 extra as (select f.*, row_number() over (partition by f.file order by f.pos) as nr from file f where ord % 19 = 0),
 good as (select * from given where ord % 17 <> 0),
 times as (select *, row_number() over (partition by file, id order by nr) as k, count(*) over (partition by file, id) as cnt from good),
 held as (select file, id from times where k = cnt and cnt % 2 = 1),
 spots as (select {_FILE} as file, list, id, min(place) as place from listed group by all)"""
_LOOSE_TIMES = "select file, 'z-' || id as id, row_number() over (partition by file, id order by nr) as k, count(*) over (partition by file, id) as cnt from extra"


@query("scan_malformed", CHAIN + _FAULTY + f""" select file, 'invalid work' as reason, count(*) as n from given where ord % 17 = 0 group by file
 union all select file, 'duplicate id', count(*) from (select file from times where k % 2 = 0 union all select file from ({_LOOSE_TIMES}) where k % 2 = 0) group by file""")
def scan_malformed(spark, d):
    return reports.parse(faulty_rows(spark, d), FIVE_AXES).malformed.groupBy("file", "reason").agg(F.count("*").alias("n"))


@query("scan_unknown", CHAIN + _FAULTY + " select file, list, id as work_id, place from spots where (file, id) not in (select (file, id) from held)")
def scan_unknown(spark, d):
    u = reports.parse(faulty_rows(spark, d), FIVE_AXES).unknown
    return u.select("file", "list", "work_id", F.col("place").cast("long").alias("place"))


@query("scan_unreferenced", CHAIN + _FAULTY + f" select file, id as work_id from ({_LOOSE_TIMES}) where k = cnt and cnt % 2 = 1")
def scan_unreferenced(spark, d):
    return reports.parse(faulty_rows(spark, d), FIVE_AXES).unreferenced
