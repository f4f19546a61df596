"""License scans: sparse TF-IDF cosine to licence texts and notices, then inheritance from the nearest ancestor directory.

A whole text is compared with whole licence texts, its first words with the heads of long ones, and each of its lines,
sentences and paragraphs with notices: terms weigh (1 + ln tf) * idf, idf over all templates, function
words as if all had them, and a term that no template has weighs like one in a single template and counts once. All of this stays inside the row, as array functions over constants, so texts
are never shuffled. A unit that has none of the telling terms of any template can't reach the least cosine, since what
is left of every template is shorter than that; texts and units without such a term are passed over, which loses nothing.

A file-wide match goes before a notice; of matches that are as near to two digits the template that stands first counts. A
file is a licence file if its name says so or if the match is at least half of its words; a directory takes the best match
of its licence files, and files without one take the licence of the nearest directory above them that has one, by joins
on paths.

Defined results: a null text has no notice; a null path has no directory and inherits nothing; repeated rows each get
their result; equal matches of a directory's files go to the name that sorts first; without a template above the
threshold the licence is null; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.license_templates import HEADS, NOTICES, WHOLE
from tallyloom.session import written

FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$"
TERM = "[a-z0-9]+"
MIN_COSINE = 0.75
#: What is between paragraphs, in comments too, and between sentences.
BLANK = r"\n[\x20\t\r*#/;%-]*\n"
SENTENCE = r"(?<=[.!?])[\x20\t\r\n]+"
#: Terms of a text's head.
HEAD_TERMS = 60
#: What one of the many like tags counts for in idf, so that its fixed words don't count as common.
TAG_SHARE = 1 / 6
#: Tasks over which one directory's descendants are spread in the join with licence files.
SPREAD = 16

#: Function words: they weigh as if all templates had them.
FUNCTION = frozenset(
    "a about all also an and any are as at be but by can do does each either even for from has have if in into is it its may more most no not of on one only or other "
    "our out see shall so such than that the their this through to under unless use used was we what which whether will with without you your".split()
)
#: Words that many texts of any kind have, some of them in other languages: they are the last to be chosen as telling.
EVERYDAY = FUNCTION | frozenset(
    "above act action advice allowed anyone author authors away basis benefit business c caused change changing charge client code commercial connection copies copy "
    "counts covered create creates creation damage data deal designed direct distribution document event everyone except extent february file files first floor "
    "following form forms found free freedom future general goods however http https included including individual information interest international january june "
    "kind kinds language large later law laws legal library list loss make mean means met mit modify must name names new notice november option org particular "
    "performance person persons please possible present prior products program promote provide provided public published purpose refer related required resulting "
    "rights sa sell services share software source special specific street style subject take terms universal v version way work works writing written www".split()
)

#: (kind, licence, text) of all templates; a kind of unit is compared with templates of that kind.
TEMPLATES = (*(("whole", *x) for x in WHOLE), *(("head", *x) for x in HEADS), *(("notice", *x) for x in NOTICES))


def template_vectors(templates=TEMPLATES) -> tuple[dict[str, float], float, list[tuple[str, str, dict[str, float]]]]:
    """idf by term, the idf of other terms, and kind, licence and a vector of length 1 of each template."""
    counts = [(kind, name, Counter(re.findall(TERM, text.lower())[: HEAD_TERMS if kind == "head" else None])) for kind, name, text in templates]
    shares = [TAG_SHARE if text.startswith("SPDX-") else 1.0 for *_, text in templates]
    n_all, df = max(1.0, sum(shares)), Counter()
    for share, (*_, c) in zip(shares, counts, strict=True):
        df.update(dict.fromkeys(c, share))
    idf = {term: 1 + (0 if term in FUNCTION else math.log(n_all / n)) for term, n in df.items()}
    vectors = []
    for kind, name, c in counts:
        v = {term: (1 + math.log(n)) * idf[term] for term, n in c.items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        vectors.append((kind, name, {term: w / norm for term, w in v.items()}))
    return idf, 1 + math.log(n_all), vectors


def telling_terms(vectors, min_cosine: float) -> list[list[str]]:
    """For each template, terms of which every unit that reaches min_cosine with it has one: so many, everyday words last,
    that the others together are shorter than min_cosine."""
    out = []
    for _, _, v in vectors:
        own, left = [], sum(w * w for w in v.values())
        for term in sorted(v, key=lambda t: (t in EVERYDAY or t.isdigit(), -v[t], t)):
            if left < min_cosine * min_cosine * (1 - 1e-9):
                break
            own.append(term)
            left -= v[term] * v[term]
        out.append(own)
    return out


def any_word(words: list[str]) -> str:
    """A pattern of any of the words as a whole term, as a tree of their letters, so that most places fail at once."""

    def branch(rest: list[str]) -> str:
        tails: dict[str, list[str]] = {}
        for w in rest:
            if w:
                tails.setdefault(w[0], []).append(w[1:])
        options = "|".join(c + branch(t) for c, t in sorted(tails.items()))
        return ("(?:" + options + ")" + "?" * ("" in rest)) if options else ""

    return f"(?<![a-z0-9]){branch(sorted(words))}(?![a-z0-9])" if words else "(?!)"


def _map(d: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for k, v in sorted(d.items()) for x in (k, float(v))))


def matches(low: Column, min_cosine: float, templates=TEMPLATES) -> tuple[Column, Column, Column]:
    """Three steps: whether a lower-case text can match at all; `units` of it; and the best (file_wide, near, cosine, n,
    license) from `units`, null for none."""
    idf, other, vectors = template_vectors(templates)
    telling = telling_terms(vectors, min_cosine)
    vocabulary = F.array(*(F.lit(t) for t in sorted(idf)))
    anything = sorted({t for own in telling for t in own})
    told = F.array(*map(F.lit, anything))
    terms_of = lambda u: F.regexp_extract_all(u, F.lit(TERM), F.lit(0))
    parts = F.array_distinct(F.concat(F.split(low, "\n"), F.split(low, BLANK), F.split(low, f"{SENTENCE}|{BLANK}")))
    every = F.array(F.struct(F.lit("whole").alias("kind"), terms_of(low).alias("terms")), F.struct(F.lit("head").alias("kind"), F.slice(terms_of(low), 1, HEAD_TERMS).alias("terms")))
    units = F.filter(F.concat(every, F.transform(parts, lambda u: F.struct(F.lit("notice").alias("kind"), terms_of(u).alias("terms")))), lambda u: F.arrays_overlap(u["terms"], told))
    entry = lambda at, kind, name, v: F.struct(F.lit(kind).alias("kind"), F.lit(at).alias("at"), F.lit(name).alias("license"), F.array(*map(F.lit, telling[at])).alias("told"), _map(v).alias("w"))
    weights = F.array(*(entry(at, *vector) for at, vector in enumerate(vectors)))
    idf_of = _map(idf)

    def vector(u: Column) -> Column:
        terms = u["terms"]
        asked = F.filter(weights, lambda t: (t["kind"] == u["kind"]) & F.arrays_overlap(t["told"], terms))
        known = F.transform(
            F.array_intersect(terms, vocabulary),
            lambda x: F.struct(x.alias("term"), ((1 + F.log((F.size(terms) - F.size(F.array_remove(terms, x))).cast("double"))) * F.element_at(idf_of, x)).alias("w")),
        )
        rest = F.size(F.array_except(terms, vocabulary)) * other * other
        return F.struct(u["kind"].alias("kind"), known.alias("known"), F.size(terms).alias("n"), rest.alias("rest"), asked.alias("asked"))

    better = lambda a, b: F.when(a.isNull() | (b > a), b).otherwise(a)

    def best(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v["known"], v["rest"].cast("double"), lambda s, k: s + k["w"] * k["w"]))
        cosine = lambda t: F.aggregate(v["known"], F.lit(0.0), lambda s, k: s + k["w"] * F.coalesce(F.try_element_at(t["w"], k["term"]), F.lit(0.0))) / F.greatest(norm, F.lit(1e-9))
        scores = F.transform(v["asked"], lambda t: F.struct(cosine(t).alias("cosine"), (-t["at"]).alias("place"), t["license"].alias("license")))
        ranked = F.transform(
            F.filter(scores, lambda x: x["cosine"] >= min_cosine),
            lambda x: F.struct((v["kind"] != "notice").alias("file_wide"), F.round(x["cosine"], 2).alias("near"), x["place"].alias("place"), x["cosine"].alias("cosine"), v["n"].alias("n"), x["license"].alias("license")),
        )
        return F.array_max(ranked)

    return low.rlike(any_word(anything)), units, F.array_max(F.transform(F.transform(F.col("units"), vector), best))


def directory(path: Column) -> Column:
    """The path without its last part; null for a path without a directory."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", ""))


def scan_headers(files: DataFrame, text_col: str = "text", path_col: str = "path", id_col: str = "doc_id", min_cosine: float = MIN_COSINE) -> DataFrame:
    """doc_id, path, dir, cosine and notice (null below min_cosine) and is_license_file; one scan."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    told, units, top = matches(F.col("low"), min_cosine)
    d = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.explode(F.array(F.lower(text))).alias("low"))
    none = F.array().cast("array<struct<kind:string,terms:array<string>>>")
    d = d.withColumn("units", F.explode(F.array(F.when(told, units).otherwise(none))))
    n_terms = F.when(F.size("units") > 0, F.size(F.regexp_extract_all("low", F.lit(TERM), F.lit(0)))).otherwise(0)
    d = d.select("doc_id", "path", F.explode(F.array(F.struct(top.alias("top"), n_terms.alias("n_terms")))).alias("x"))
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    return d.select(
        *("doc_id", "path"),
        directory(F.col("path")).alias("dir"),
        F.col("x.top.cosine").alias("cosine"),
        F.col("x.top.license").alias("notice"),
        (F.col("x.top").isNotNull() & (named | (2 * F.col("x.top.n") >= F.col("x.n_terms")))).alias("is_license_file"),
    )


def ancestors(path: Column) -> Column:
    """A directory and all directories above it, with their depths."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("up"), k.alias("depth")))


def scan_licenses(files: DataFrame, text_col: str = "text", path_col: str = "path", id_col: str = "doc_id", min_cosine: float = MIN_COSINE) -> DataFrame:
    """doc_id, path, license, cosine, origin (header, inherited or null) and license_dir for every file.

    One scan of the texts; ids, paths and matches are written and used from there. Directories are aggregated before they
    meet, the descendants of one directory are spread over SPREAD keys, and the last join, on the directory, is one that
    adaptive execution splits where a directory holds a large share of the files.
    """
    found = written(scan_headers(files, text_col, path_col, id_col, min_cosine), "matches")
    declared = found.where("is_license_file and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "notice")).alias("best")).select(F.col("dir").alias("up"), "best.notice")
    spread = declared.select("up", "notice", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    dirs = found.where("dir is not null").select("dir").distinct()
    above = dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias("a"), F.pmod(F.xxhash64("dir"), F.lit(SPREAD)).cast("int").alias("salt"))
    near = above.select("dir", "a.up", "a.depth", "salt").join(spread, ["up", "salt"])
    resolved = near.groupBy("dir").agg(F.max(F.struct("depth", "up", "notice")).alias("n")).select("dir", F.col("n.up").alias("license_dir"), F.col("n.notice").alias("inherited"))
    own = F.col("notice").isNotNull()
    return found.join(resolved, "dir", "left").select(
        *("doc_id", "path"),
        F.coalesce("notice", "inherited").alias("license"),
        F.round("cosine", 6).alias("cosine"),
        F.when(own, "header").when(F.col("inherited").isNotNull(), "inherited").alias("origin"),
        F.when(~own, F.col("license_dir")).alias("license_dir"),
    )


def query(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source, then language, then id."""
    tree = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    return scan_licenses(docs.select("doc_id", "text", tree.alias("path")))
