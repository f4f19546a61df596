"""Text functions, identities and the explorer on small rows."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import identity as I
from tallyloom.operators.components import components
from tallyloom.operators.explorer import ExplorerQuery, Field
from tallyloom.operators.lookups import verify_in_turn
from tallyloom.plans.survey import r6


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'int'}" for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, want",
    [("The Škvorecký & Sons", "skvorecky and sons"), ("8½", "8 half"), ("An  Émile-Zola!", "emile zola"), ("Straße", "strasse"), ("日本", ""), (None, ""), ("a the b", "the b")],
)
def test_normalize(spark, raw, want):
    assert one(spark, X.normalize(F.col("t")), t=raw) == want
    assert one(spark, X.normalize_full(F.col("t")), t=raw) == want


def test_creators(spark):
    assert one(spark, X.creator_key(F.col("t")), t="Zoe and the Adams, Zoe") == "adams zoe zoe"
    related = X.creators_related(F.col("a"), F.col("b"))
    assert one(spark, related, a="adams zoe", b="adams brown carl dora") is True
    assert one(spark, related, a="", b="adams") is False


@pytest.mark.parametrize("raw, want", [("Show: Season 2", "Show"), ("Show series TEN", "Show"), ("Season of Mist", "Season of Mist"), ("Show - season 12 ", "Show")])
def test_strip_season(spark, raw, want):
    assert one(spark, X.strip_season(F.col("t")), t=raw) == want


def test_html_and_csv(spark):
    assert one(spark, X.normalize_html(F.col("t")), t="<b>The&nbsp;A &amp; B</b>") == "the a and b"
    assert one(spark, X.csv_cell(F.col("t")), t='a "b", c') == '"a ""b"", c"'
    assert one(spark, X.csv_cell(F.col("t")), t=None) == ""
    assert one(spark, X.escape_html(F.col("t")), t="<a href='x'>&") == "&lt;a href=&#039;x&#039;&gt;&amp;"


def test_natural_order(spark):
    rows = spark.createDataFrame([("A10",), ("a2",), ("Á1",), ("b",)], "t string").orderBy(X.natural_key(F.col("t"))).collect()
    assert [r.t for r in rows] == ["Á1", "a2", "A10", "b"]


def test_sequence_ratio(spark):
    assert round(one(spark, X.sequence_ratio("a", "b"), a="abcd", b="bcde"), 6) == 0.75


def test_components_on_a_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert components(links.limit(0)).count() == 0


def test_merge_rules(spark):
    rows = [
        (1, ["x"], "adam", "novel", 2000),
        (2, ["x"], "eve", "novel", 2001),  # same medium, a year apart: one
        (3, ["x"], "eve", "novel", 2003),  # two years from 2 but the same creator
        (4, ["x"], "zed", "novel", 2005),  # nobody
        (5, ["x"], "adam", "novella", 2000),  # a family, related creators
        (6, ["x"], "adam", "film", 2000),  # never with prose
    ]
    ids = spark.createDataFrame(rows, "id long, titles array<string>, creator_key string, medium string, year int")
    exact = {(r.a, r.b) for r in I.exact_edges(ids).collect()}
    band = {(r.a, r.b) for r in I.band_pairs(ids).collect()}
    assert exact == {(2, 3), (1, 5)} and band == {(1, 2), (1, 5)}
    chain = {(r.a, r.b) for r in I.chain_edges(ids).collect()}
    assert chain == {(1, 2)}


def test_band_pairs_equal_brute_force_without_a_shuffle_of_pairs(spark):
    draw = random.Random(3)
    media = ("novel", "novella", "film", "documentary", "anime", "game")
    rows = [(k, draw.sample(["x", "y", "z"], draw.randint(1, 3)), draw.choice(["", "adam b", "adam", "eve"]), draw.choice(media), 2000 + draw.randint(0, 3)) for k in range(60)]
    rows += [(900, [], "adam", "novel", 2000), (901, ["x"], "adam", "novel", None), (902, ["x"], "adam", None, 2000), (903, ["x", "x"], None, "film", 2001)]
    family = lambda m: I.FAMILIES.get(m, m)

    def meet(p, q):
        if p[0] == q[0] or None in (p[3], p[4], q[3], q[4]) or not set(p[1]) & set(q[1]) or abs(p[4] - q[4]) > 1:
            return False
        a, b = set((p[2] or "").split()), set((q[2] or "").split())
        match = p[3] == q[3] or family(p[3]) == family(q[3]) == "prose" or {p[3], q[3]} in ({"film", "documentary"}, {"film", "anime"})
        return match and (p[3] == q[3] or bool(a and b) and 2 * len(a & b) >= min(len(a), len(b)))

    again = [*rows, (rows[0][0], rows[0][1], rows[0][2], rows[0][3], rows[0][4] + 1), rows[1]]
    for case, deal in ((rows, 4096), (rows, 3), (again, 3)):
        ids = spark.createDataFrame(case, "id long, titles array<string>, creator_key string, medium string, year int")
        out = I.band_pairs(ids, deal=deal)
        assert sorted(map(tuple, out.collect())) == sorted({(min(p[0], q[0]), max(p[0], q[0])) for p in case for q in case if meet(p, q)})
        assert (case is again) == out._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


def test_percent_is_printf_of_the_exact_value(spark):
    draw = random.Random(5)
    rates = [15 / 6000, 9 / 6000, 27 / 6000, 0.0035, 0.0015, 0.9995, 0.0, -0.0045, 1.0, *(k / 2000 for k in range(0, 2001)), *(draw.random() for _ in range(2000))]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(rates)] + [(-1, None)], "k int, rate double")
    got = dict(rows.select("k", Field("rate", "Rate", "percent").shown()).collect())
    assert got.pop(-1) == "—" and got == {k: "%.1f%%" % (100 * x) for k, x in enumerate(rates)}
    assert got[0] == "0.2%"


def test_columns_round_as_their_sql(spark):
    ties = [(k + 0.5) / 1e6 for k in range(47_000_000, 64_000_000, 9973)]
    values = [64.3828995, 16.4507265, 2.0786065, -64.3828995, 0.0, 54.1234375, *ties, *(math.nextafter(x, 0) for x in ties), *(math.nextafter(x, 100) for x in ties)]
    want = duckdb.execute("select round(x, 6) from (select unnest(?::double[]) as x)", [values]).fetchall()
    got = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, consensus double").select("k", *r6("consensus")).orderBy("k").collect()
    assert [r.consensus for r in got] == [x for x, in want]


def test_explorer(spark):
    fields = (Field("rank", "Rank", "rank"), Field("title", "Title, full", "text"), Field("score", "Score", "number"))
    rows = spark.createDataFrame([(1, "b", 2.0), (2, 'a "x"', None), (3, "c", 2.0), (4, "d", 3.5)], "rank int, title string, score double")
    q = ExplorerQuery(fields, search_columns=("title",))
    ranks = lambda query: [r["rank"] for r in query.ordered(rows).collect()]
    assert ranks(q.sorted_by("score", True)) == [1, 3, 4, 2]
    assert ranks(q.sorted_by("score", False)) == [2, 4, 1, 3]
    assert ranks(q.sorted_by("score", False).then_by("title", False)) == [2, 4, 3, 1]
    assert q.sorted_by("score").sorts == (("score", False),) and q.sorted_by("title").sorts == (("title", True),)
    assert q.clicked("title").clicked("title").sorts == (("title", False),)
    assert q.sorted_by("score").then_by("title", True).sorted_by("title").sorts == (("title", True),)
    last = ExplorerQuery(fields, page=9, page_size=3)
    assert [r["rank"] for r in last.slice(rows, 4).collect()] == [4] and q.where("rank", 2).searched("X").page == 0
    assert [r["rank"] for r in q.searched(' "X" a').ordered(rows).collect()] == [2]
    assert q.where("rank", 2).csv_document(rows) == '﻿Rank,"Title, full",Score\n2,"a ""x""",—'


def test_normalize_folds_compatibility_forms(spark):
    for text, want in (("E\u0301mile", "emile"), ("\ufb01n", "fin"), ("İstanbul", "istanbul"), ("Ａbc １２", "abc 12"), ("Straße №5", "strasse no5"), ("Ǆungla x²", "dzungla x2")):
        assert one(spark, X.normalize(F.col("t")), t=text) == one(spark, X.normalize_full(F.col("t")), t=text) == want
    assert one(spark, X.normalize(F.col("t"), half=False, ampersand="after"), t="8½") == "81 2"


def test_search_of_selections(spark):
    fields = (Field("rater", "Agent", "agent"), Field("list", "List", "category"), Field("medium", "Medium", "category"), Field("year", "Year", "year"))
    rows = spark.createDataFrame([(7, "traditional_mystery", "tv_series", 1999), (70, "ambition", None, None)], "rater long, list string, medium string, year int")
    q = ExplorerQuery(fields, search_columns=("rater", "list", "medium", "year"))
    found = lambda text: sorted(r.rater for r in q.searched(text).matching(rows).collect())
    assert found("agent 7") == [7, 70] and found("TV traditional 1999") == [7] and found("mystery series agent") == [7]
    assert found("—") == [] and found("tv_series") == [] and found(" ") == [7, 70]


def test_sources_in_turn_keep_errors_and_earlier_verdicts(spark):
    schema = "k int, evidence string, error string"
    one = spark.createDataFrame([(1, None, "timeout"), (2, "a", None), (3, None, "refused")], schema)
    two = spark.createDataFrame([(1, "b", None), (2, None, "late"), (3, None, "timeout"), (4, "c", "odd")], schema)
    pending = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (None,)], "k int")
    prior = spark.createDataFrame([(4, "old"), (9, "x"), (5, None)], "k int, evidence string")
    got = {r.k: (r.status, r.source, r.evidence, r.errors) for r in verify_in_turn(pending, [one, two], ["k"], prior).collect()}
    assert got == {
        1: ("verified", 1, "b", ["timeout"]),
        2: ("verified", 0, "a", []),
        3: ("unverified", None, None, ["refused", "timeout"]),
        4: ("verified", -1, "old", []),
        5: ("unverified", None, None, []),
        None: ("unverified", None, None, []),
    }
    assert verify_in_turn(pending.limit(0), [one], ["k"]).count() == 0
