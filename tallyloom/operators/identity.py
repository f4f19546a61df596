"""Which works are one: media, merge rules, edges, canonical identities, overrides and series roll-ups.

Edges come from equality keys alone: exact keys give a star to the least id, the year band gives keys (title, year) for
a year and the next. Clusters are built from `links`; `band_pairs` lists every pair and serves as a report.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.functions.text import creators_related
from tallyloom.session import written
from tallyloom.sources.config import Identity

# Media and their families.
FAMILIES = {
    "novel": "prose",
    "book_series": "prose",
    "novella": "prose",
    "short_story": "prose",
    "web_serial": "prose",
    "video_game": "interactive",
    "visual_novel": "interactive",
    "radio_drama": "audio",
    "audio_drama": "audio",
    "podcast": "audio",
}
SCREEN = ("film", "documentary", "anime", "tv_series", "cartoon")
COMPATIBLE_FAMILIES = ("prose", "interactive", "audio")
COMPATIBLE_PAIRS = (("documentary", "film"), ("anime", "film"), ("cartoon", "tv_series"))


#: Rows of one title, bucket and year that one block of `band_pairs` holds.
DEALT = 4096


class MediaRules:
    """Families of media, wider families that only bucket, and pairs that match across families."""

    def __init__(self, families: dict[str, str], compatible: tuple[str, ...], pairs: tuple[tuple[str, str], ...], buckets: dict[str, str]):
        self.families, self.compatible, self.pairs, self.buckets = families, compatible, pairs, buckets

    @staticmethod
    def _mapped(medium: Column, d: dict[str, str]) -> Column:
        out = None
        for k, v in d.items():
            out = F.when(medium == k, F.lit(v)) if out is None else out.when(medium == k, F.lit(v))
        return medium if out is None else out.otherwise(medium)

    def family(self, medium: Column) -> Column:
        return self._mapped(medium, self.families)

    def bucket(self, medium: Column) -> Column:
        return self._mapped(medium, self.families | self.buckets)

    def match(self, a: Column, b: Column) -> Column:
        """Whether two media can be one work's."""
        family = self.family(a)
        hit = (a == b) | ((family == self.family(b)) & family.isin(*self.compatible))
        for x, y in self.pairs:
            hit = hit | ((a == x) & (b == y)) | ((a == y) & (b == x))
        return hit


DEFAULT_MEDIA = MediaRules(FAMILIES, COMPATIBLE_FAMILIES, COMPATIBLE_PAIRS, {m: "screen" for m in SCREEN})


def exact_edges(ids: DataFrame, rules: MediaRules = DEFAULT_MEDIA) -> DataFrame:
    """Edges (a, b) to the least id with the same title candidate, creator key and family, in any year.

    ids: id, titles (array), creator_key, medium, year.
    """
    keyed = ids.select("id", F.explode("titles").alias("title"), "creator_key", rules.family(F.col("medium")).alias("family"))
    least = keyed.groupBy("title", "creator_key", "family").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(least, ["title", "creator_key", "family"]).where("id > a").select("a", F.col("id").alias("b")).distinct()


def band_pairs(ids: DataFrame, rules: MediaRules = DEFAULT_MEDIA, deal: int = DEALT) -> DataFrame:
    """Pairs (a < b) that share a title candidate, at most a year apart, of matching media, and of one medium or related creators.

    Ids that agree in all of this are one row of the join, which is spread into pairs after it. A pair is kept at the least
    title that both have, so pairs need no shuffle to be distinct (but where an id has several rows). Titles of a bucket and
    year with more than `deal` rows are dealt into blocks, each of which meets all others.
    """
    words = X.key_words(F.col("creator_key"))
    keyed = ids.select("id", F.array_distinct("titles").alias("titles"), rules.bucket(F.col("medium")).alias("bucket"), "year", "medium", words.alias("words"))
    keyed = written(keyed.select("id", F.explode("titles").alias("title"), F.when(F.size("titles") > 1, F.col("titles")).alias("titles"), "bucket", "year", "medium", "words"), "band")
    keys, like = ["title", "bucket", "year"], ["year", "medium", "words", "titles"]
    large = F.broadcast(keyed.groupBy(*keys).agg(F.ceil(F.count("*") / deal).alias("blocks")).where("blocks > 1"))
    dealt = keyed.join(large, keys, "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))))
    left = dealt.groupBy("title", "bucket", "block", *like).agg(F.collect_list("id").alias("ids")).withColumn("band", F.col("year"))
    right = dealt.groupBy("title", "bucket", "block", *like).agg(F.collect_list("id").alias("ids")).drop("block")
    right = right.select("title", "bucket", *(F.col(c).alias(f"{c}_b") for c in ("ids", *like)), F.explode(F.array(F.col("year"), F.col("year") + 1)).alias("band"))
    right = right.join(large.withColumnRenamed("year", "band"), ["title", "bucket", "band"], "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)))
    met = left.join(right, ["title", "bucket", "band", "block"])
    first = F.col("titles").isNull() | F.col("titles_b").isNull() | (F.array_min(F.array_intersect("titles", "titles_b")) == F.col("title"))
    same = F.col("medium") == F.col("medium_b")
    hit = rules.match(F.col("medium"), F.col("medium_b")) & (same | X.words_related(F.col("words"), F.col("words_b")))
    pairs = met.where(first & hit).select("year", "year_b", "ids_b", F.explode("ids").alias("id")).select("year", "year_b", "id", F.explode("ids_b").alias("id_b"))
    pairs = pairs.where(F.when(F.col("year") == F.col("year_b"), F.col("id") < F.col("id_b")).otherwise(F.col("id") != F.col("id_b")))
    out = pairs.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b"))
    once = ids.groupBy("id").count().where("count > 1").isEmpty()
    return out if once else out.distinct()


def chain_edges(ids: DataFrame) -> DataFrame:
    """The closure of the one-medium rule without its pairs: ids of a title, medium and year to the least of them, and the
    least of a year to that of the next."""
    keyed = ids.select("id", F.explode("titles").alias("title"), "medium", "year")
    least = keyed.groupBy("title", "medium", "year").agg(F.min("id").alias("a"))
    star = keyed.join(least, ["title", "medium", "year"]).where("id > a").select("a", F.col("id").alias("b"))
    after = least.select("title", "medium", (F.col("year") - 1).alias("year"), F.col("a").alias("b"))
    return star.union(least.join(after, ["title", "medium", "year"]).select("a", "b")).distinct()


def kin_edges(ids: DataFrame, rules: MediaRules = DEFAULT_MEDIA) -> DataFrame:
    """The closure of the band rule across media, given `chain_edges`: one id for each title, year, medium and creator key
    meets those of a matching medium, at most a year away, that share a word of the creator key (related creators do)."""
    keyed = ids.select("id", F.explode("titles").alias("title"), rules.bucket(F.col("medium")).alias("bucket"), "year", "medium", "creator_key")
    keys = ["title", "bucket", "year", "medium", "creator_key"]
    words = keyed.groupBy(*keys).agg(F.min("id").alias("id")).select("*", F.explode(F.array_distinct(F.split("creator_key", " "))).alias("word")).where("word <> ''")
    left = words.withColumn("band", F.col("year"))
    right = words.select(*(F.col(c).alias(f"{c}_b") for c in ("id", "medium", "creator_key")), "title", "bucket", "word", F.explode(F.array(F.col("year"), F.col("year") + 1)).alias("band"))
    met = left.join(right, ["title", "bucket", "word", "band"]).where("medium <> medium_b")
    hit = rules.match(F.col("medium"), F.col("medium_b")) & creators_related(F.col("creator_key"), F.col("creator_key_b"))
    return met.where(hit).select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).where("a < b").distinct()


def links(ids: DataFrame, rules: MediaRules = DEFAULT_MEDIA) -> DataFrame:
    """Edges whose components are those of `exact_edges` and `band_pairs`; none of the joins pairs a whole title group."""
    return exact_edges(ids, rules).union(chain_edges(ids)).union(kin_edges(ids, rules))


def canonical(members: DataFrame, series_medium: str = "book_series") -> DataFrame:
    """The identity of each cluster: a series first, then the most observed, shorter title, earlier year, title, id."""
    order = F.struct(
        (F.col("medium") != series_medium).alias("k1"), (-F.col("n")).alias("k2"), F.length("title").alias("k3"), F.col("year").alias("k4"), F.lower("title").alias("k5"), F.col("id").alias("k6")
    )
    return members.groupBy("cluster").agg(F.min(F.struct(order.alias("o"), "id", "title", "year", "medium")).alias("x")).select("cluster", "x.id", "x.title", "x.year", "x.medium")


def first_match(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first rule whose condition holds, else the default; rules are compiled into one expression."""
    out = None
    for holds, value in rules:
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return default if out is None else out.otherwise(default)


@dataclass(frozen=True)
class Override:
    """A known correction: names and, where given, creators and media that it holds for, and the identity that it puts.

    by_words compares creators as sorted words; keep_original leaves the original title as it was."""

    titles: tuple[str, ...]
    to: Identity
    creators: tuple[str, ...] = ()
    media: tuple[str, ...] = ()
    by_words: bool = False
    keep_original: bool = False


def identified(rows: DataFrame, overrides: tuple[Override, ...], season_medium: str = "tv_series") -> DataFrame:
    """rows with title, original_title, creator, year and medium corrected: seasons go from titles of the one medium, then
    the first override that holds decides. Nulls meet no override."""
    names = ("title", "original_title", "creator", "year", "medium")
    rows = rows.withColumn("title", F.when(F.col("medium") == season_medium, X.strip_season(F.col("title"))).otherwise(F.col("title")))
    title, who, words = X.normalize(F.col("title")), X.normalize(F.col("creator")), X.creator_key(F.col("creator"))
    rules = []
    for o in overrides:
        holds = title.isin(*(X.normalized(t) for t in o.titles))
        if o.creators and o.by_words:
            holds = holds & words.isin(*(X.creator_words(c) for c in o.creators))
        elif o.creators:
            holds = holds & who.isin(*(X.normalized(c) for c in o.creators))
        if o.media:
            holds = holds & F.col("medium").isin(*o.media)
        value = F.struct(*(F.col(c) if c == "original_title" and o.keep_original else F.lit(getattr(o.to, c)).cast(rows.schema[c].dataType).alias(c) for c in names))
        rules.append((F.coalesce(holds, F.lit(False)), value))
    found = rows.withColumn("_to", first_match(rules, F.struct(*(F.col(c) for c in names))))
    return found.withColumns({c: F.col(f"_to.{c}") for c in names}).drop("_to")


def related_pairs(keys: DataFrame) -> DataFrame:
    """Pairs (key_a < key_b) of distinct creator keys k that are related, met over a word that both have."""
    words = keys.select("k").distinct().select("k", F.explode(F.array_distinct(F.split("k", " "))).alias("word")).where("word <> ''")
    met = words.withColumnRenamed("k", "key_a").join(words.withColumnRenamed("k", "key_b"), "word").where("key_a < key_b").select("key_a", "key_b").distinct()
    return met.where(creators_related(F.col("key_a"), F.col("key_b")))


def compatible_pairs(media: DataFrame, rules: MediaRules = DEFAULT_MEDIA) -> DataFrame:
    """Ordered pairs of distinct media that can be one work's, met over equal media, a family or a listed pair."""
    m = F.col("medium")
    family = rules.family(m)
    keys = [F.concat(F.lit("m:"), m), F.when(family.isin(*rules.compatible), F.concat(F.lit("f:"), family))]
    keys += [F.when(m.isin(*pair), F.lit(f"p:{k}")) for k, pair in enumerate(rules.pairs)]
    keyed = media.select("medium").distinct().select("medium", F.explode(F.array_compact(F.array(*keys))).alias("key"))
    return keyed.withColumnRenamed("medium", "medium_a").join(keyed.withColumnRenamed("medium", "medium_b"), "key").select("medium_a", "medium_b").distinct()


def rollup(obs: DataFrame, components: DataFrame, least_support: int) -> tuple[DataFrame, DataFrame]:
    """Support of each standalone component, and the decision for each observation that a rule touches.

    obs: rater, title, creator, medium and any id columns; components: rule_ord, precedence, kind (parent, continuous or
    standalone), component, title, creator, medium, parent. A standalone component with enough raters stays. Support counts
    every component that an observation meets; of several the first rule, precedence and component decide. Rules whose parent is another rule's component would need a fold: refused.
    """
    chained = components.alias("a").join(components.alias("b"), (F.col("a.parent") == F.col("b.title")) & (F.col("a.rule_ord") < F.col("b.rule_ord")) & (F.col("a.creator") == F.col("b.creator"))).limit(1)
    if chained.count():
        raise ValueError("a rule rewrites to a title that a later rule holds")
    keys = ["title", "creator", "medium"]
    hit = obs.join(F.broadcast(components), keys)
    support = hit.where("kind = 'standalone'").groupBy("rule_ord", "component").agg(F.countDistinct("rater").alias("support"))
    first = components.groupBy(*keys).agg(F.min_by(F.struct("rule_ord", "precedence", "kind", "component", "parent"), F.struct("rule_ord", "precedence", "component")).alias("c")).select(*keys, "c.*")
    decided = obs.join(F.broadcast(first), keys).join(F.broadcast(support), ["rule_ord", "component"], "left")
    reason = F.when(F.col("kind") != "standalone", F.col("kind")).when(F.col("support") >= least_support, "preserved").otherwise("rolled up")
    return support, decided.withColumn("reason", reason)
