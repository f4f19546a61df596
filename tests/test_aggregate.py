"""The whole chain on hand-made observations: rules, clusters, exclusions, files and checks."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import aggregate as A
from tallyloom.operators import rollup as R
from tallyloom.sources import config, reports
from tallyloom.spec import FIVE_AXES

SPEC = FIVE_AXES
SCHEMA = "rater long, work_id string, title string, original_title string, creator string, year int, medium string, " + ", ".join(f"{a} long" for a in SPEC.axes) + ", " + ", ".join(f"r_{n} int" for n in SPEC.list_names)


def row(rater, work_id, title, creator="Ann Lee", year=1990, medium="novel", score=50, places=(1, None, None, None), original=""):
    return (rater, work_id, title, original, creator, year, medium, *([score] * 5), *places)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


PARENT = {"title": "The Saga", "original_title": "", "creator": "Ann Lee", "year": 1980, "medium": "book_series"}
CONFIG = {
    "preserve_component_support": 2,
    "series": [
        {"parent": PARENT, "media": ["novel", "book_series"], "creator_aliases": ["Ann Lee", "A. Lee"], "continuous_components": [{"titles": ["Part One"]}], "standalone_components": [{"titles": ["Alone"]}, {"titles": ["Rare"]}]},
        {"parent": PARENT | {"title": "Great Saga"}, "media": ["book_series"], "parent_titles": ["Saga"]},
    ],
}


def seen(spark, rows):
    df = frame(spark, rows).withColumn("id", R.identity_id())
    return df.groupBy("id", "rater").agg(*(F.first(c).alias(c) for c in R.IDENTITY), F.count("*").alias("n"))


def test_rules_fold_in_order(spark):
    rows = [row(1, "a", "Part One"), row(2, "a", "Alone (novel)"), row(3, "a", "Alone", "A Lee"), row(4, "a", "Rare"), row(5, "a", "Rare", medium="film"), row(6, "a", "Saga", medium="book_series")]
    r = R.roll_up(seen(spark, rows), config.series(CONFIG))
    title = {x.id: (x.title, x.medium) for x in r.identities.collect()}
    now = sorted((title[m.id][0], title[m.current][0]) for m in r.mapping.collect())
    # a later rule meets what an earlier one wrote
    assert now == [("Alone", "Alone"), ("Alone (novel)", "Alone (novel)"), ("Part One", "Great Saga"), ("Rare", "Great Saga"), ("Rare", "Rare"), ("Saga", "Great Saga")]
    log = {(x.rule, title[x.id][0], x.reason, x.support) for x in r.decisions.collect()}
    assert (0, "Part One", "continuous_component", 0) in log and (0, "Rare", "low_support_standalone_component", 1) in log
    assert (0, "Alone", "preserved_standalone_component", 2) in log and (1, "The Saga", "parent_alias", 0) in log


def test_rules_that_meet_one_identity_go_in_order():
    assert R._levels(4, [[0, 2], [2, 3]], [(1, 3)]) == [[0, 1], [2], [3]]
    assert R._levels(0, [], []) == []


def test_chain_merges_excludes_and_checks(spark, tmp_path):
    rows = [row(k, "x", "Red House", score=80) for k in range(1, 4)]
    rows += [row(1, "y", "Red House", year=1991, score=20, places=(9, 2, None, None)), row(4, "z", "The Red House (novel)", creator="Lee, Ann", year=1970, medium="novella")]
    rows += [row(k, "w", "Blue Door", "Bo Hart", score=10, places=(2, None, None, None)) for k in (1, 2)] + [row(5, "q", "Far Hill", "Cy Ode", places=(None, 1, None, None))]
    a = A.aggregate(frame(spark, rows + [row(6, "none", "Unplaced", "No One", places=(None,) * 4)]), exclusions=config.exclusions([{"title": "The Blue Door", "year": 1990, "medium": "novel"}]))
    works = {w.title: w for w in a.works.collect()}
    assert set(works) == {"Red House", "Far Hill"} and works["Red House"].support == 4 and works["Red House"].n_raters == 5
    # rater 1 rated two variants: the one in more lists holds, with the least places of both
    one = a.observations.where("rater = 1").first()
    assert (one.work_id, one.ambition, one.place_ambition, one.place_fairness) == ("y", 20, 1, 2)
    assert [(w.kept, w.discarded) for w in a.within.collect()] == [("y", ["x"])]
    assert {(m.title, m.year, m.to_title, m.to_year, m.observations) for m in a.merges.collect()} == {("Red House", 1991, "Red House", 1990, 1), ("The Red House (novel)", 1970, "Red House", 1990, 1)}
    assert [x.title for x in a.excluded.collect()] == ["Blue Door"]
    assert {(v.check, v.failed) for v in A.verify(a).where("failed > 0").collect()} == set()
    s = A.summary(a)
    assert (s["agents"], s["valid_observations"], s["retained_works"], s["excluded"], s["excluded_selections"], s["singletons"]) == (5, 8, 2, 1, 2, 1)
    A.write(a, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "singletons")).first()["title"] == "Far Hill"
    assert json.loads(spark.read.text(str(tmp_path / "out" / "summary")).first()[0]) == s


def test_checks_find_a_changed_work(spark):
    a = A.aggregate(frame(spark, [row(1, "x", "Red House"), row(2, "x", "Far Hill", "Cy Ode")]))
    a.works = a.works.withColumn("consensus", F.col("consensus") + 0.5)
    assert {v.check for v in A.verify(a).where("failed > 0").collect()} == {"consensus"}


def test_chain_of_empty_and_null_tables(spark):
    empty = A.aggregate(frame(spark, []))
    assert empty.works.count() == 0 and empty.merges.count() == 0 and empty.stats.count() == 1
    odd = A.aggregate(frame(spark, [row(1, "x", None, None, None, None), row(None, "y", "Red House")]).withColumn("cluster_", F.lit(1)))
    assert odd.works.count() == 2


def test_chain_from_report_files(spark, tmp_path):
    for k in (1, 2):
        work = {"work_id": "a", "title": "Red House", "original_title": "", "creator": "Ann Lee", "year": 1990 + k, "medium": "novel", "scores": {x: 10 * k for x in SPEC.axes}}
        (tmp_path / f"agent_00{k}.json").write_text(json.dumps({"agent_id": f"scorer-00{k}", "works": [work], "axes": {"ambition": ["a"]}}))
    r = reports.parse(reports.read_files(spark, str(tmp_path)), SPEC)
    w = A.aggregate(r.observations.withColumnRenamed("number", "rater")).works.collect()
    assert [(x.title, x.year, x.support, x.n_ambition) for x in w] == [("Red House", 1991, 2, 2)]


def test_configuration_files(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps(CONFIG))
    (tmp_path / "out.json").write_text(json.dumps([{"title": "The Red House", "year": 1990, "medium": "novel"}, {"title": "Maison rouge", "year": 1990, "medium": "novel"}]))
    (tmp_path / "names.json").write_text(json.dumps([["Maison Rouge", "Red House"]]))
    (tmp_path / "m1.json").write_text(json.dumps({"k": {"v": 1}, "l": {"v": 2}}))
    (tmp_path / "m2.json").write_text(json.dumps({"k": {"v": 3}}))
    s = config.load_series(spark, str(tmp_path / "rules.json"))
    assert s.least_support == 2 and s.rules[0].standalone == (("Alone",), ("Rare",)) and s.rules[1].creators == ("Ann Lee",)
    names = config.load_aliases(spark, str(tmp_path / "names.json"))
    assert names == {"maison rouge": "maison rouge", "red house": "maison rouge"}
    assert config.load_exclusions(spark, str(tmp_path / "out.json"), names) == (("maison rouge", 1990, "novel"),)
    assert config.load_exclusions(spark, str(tmp_path / "absent.json")) == ()
    assert config.load_manual_sources(spark, [str(tmp_path / "m1.json"), str(tmp_path / "m2.json")]) == {"k": {"v": 3}, "l": {"v": 2}}
    assert config.cohorts([("a", 1, 2), ("b", 3, 3)], 3) == [("a", 1), ("a", 2), ("b", 3)]
    with pytest.raises(ValueError):
        config.cohorts([("a", 1, 2), ("b", 2, 3)], 3)


def test_normalized_on_the_driver_equals_the_column(spark):
    texts = ["The Café & Bar", "8½", "ﬁn de siècle", "İstanbul", "Ａbc", "É́mile", "  a  an the ", "", "Sōseki's “Kokoro”"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.normalize(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [X.normalized(t) for t in texts]
