"""Queries of text functions, over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.plans.registry import query
from tallyloom.sources.star import table

_fold = lambda c: f"replace(lower(strip_accents(lower({c}))), 'ß', 'ss')"
_words = lambda c: f"trim(regexp_replace({c}, '[^a-z0-9]+', ' ', 'g'))"
_bare = lambda c: f"trim(regexp_replace({c}, '^(the|a|an) ', ''))"
F1 = _bare(_words(_fold("replace(replace(text, '½', ' half '), '&', ' and ')")))
F2 = _bare(_words(f"replace({_fold('text')}, '&', ' and ')"))
F4 = _words(_fold("text"))
_entities = lambda c: f"replace(replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
F3 = _words(_fold("replace(" + _entities("regexp_replace(html, '<[^>]+>', ' ', 'g')") + ", '&', ' and ')"))


def _digest(df, key, **columns):
    return df.select(key, *(x for name, c in columns.items() for x in (F.length(c).alias(f"{name}_chars"), F.md5(c).alias(f"{name}_md5"))))


@query("normalize_text", f"select doc_id, length(n) as norm_chars, md5(n) as norm_md5 from (select doc_id, {F1} as n from documents)")
def normalize_text(spark, d):
    return _digest(table(spark, d, "documents"), "doc_id", norm=X.normalize(F.col("text")))


@query("normalize_variants", f"select doc_id, length(a) as validator_chars, md5(a) as validator_md5, length(b) as finaliser_chars, md5(b) as finaliser_md5 from (select doc_id, {F2} as a, {F4} as b from documents)")
def normalize_variants(spark, d):
    t = F.col("text")
    return _digest(table(spark, d, "documents"), "doc_id", validator=X.normalize(t, half=False, ampersand="after"), finaliser=X.normalize(t, half=False, ampersand="none", articles=False))


@query("normalize_html", f"select page_id, length(n) as norm_chars, md5(n) as norm_md5 from (select page_id, {F3} as n from pages)")
def normalize_html(spark, d):
    return _digest(table(spark, d, "pages"), "page_id", norm=X.normalize_html(F.col("html")))


_STOP = ", ".join(f"'{w}'" for w in X.TOKEN_STOP)


_SPELLED = "replace(replace(text, '½', ' half '), '&', ' and ')"


@query("creator_tokens", f"select doc_id, len(list_distinct(list_filter(string_split({_words(_fold(_SPELLED))}, ' '), lambda w: length(w) >= 4 and w not in ({_STOP})))) as n_tokens from documents")
def creator_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.creator_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("strip_suffix", f"select p_partkey as work, trim(regexp_replace(p_name || case p_size % 3 when 0 then ': Season ' || p_size when 1 then ' series two' else '' end, '{X.SEASON}', '', 'i')) as title from part")
def strip_suffix(spark, d):
    tail = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(": Season "), F.col("p_size").cast("string"))).when(F.col("p_size") % 3 == 1, F.lit(" series two")).otherwise(F.lit(""))
    return table(spark, d, "part").select(F.col("p_partkey").alias("work"), X.strip_season(F.concat("p_name", tail)).alias("title"))


@query("year_window_match", "select page_id, len(list_filter(range(page_id % 900 - 2, page_id % 900 + 3), lambda y: contains(url, cast(y as varchar)))) > 0 as near from pages")
def year_window_match(spark, d):
    """Whether a number within two of the page's own is in its address."""
    return table(spark, d, "pages").select("page_id", X.year_matches(F.col("url"), F.col("page_id") % 900).alias("near"))


SEARCH = "the LICENSE un"


@query("search_tokens", "select doc_id from documents where " + " and ".join(f"contains(lower(concat_ws(' ', text, lang, source)), '{t}')" for t in SEARCH.lower().split()))
def search_tokens(spark, d):
    hay = F.lower(F.concat_ws(" ", "text", "lang", "source"))
    return table(spark, d, "documents").where(X.has_tokens(hay, SEARCH)).select("doc_id")


_cell = lambda c: f"case when contains({c}, '\"') or contains({c}, ',') or contains({c}, chr(10)) then '\"' || replace({c}, '\"', '\"\"') || '\"' else {c} end"
_html = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')"


@query("csv_cells", f"select doc_id, md5({_cell('text')}) as cell_md5, md5({_html}) as html_md5 from documents")
def csv_cells(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.csv_cell(F.col("text"))).alias("cell_md5"), F.md5(X.escape_html(F.col("text"))).alias("html_md5"))


@query("url_check", "select page_id, case when starts_with(url, 'https://') then 'https' when starts_with(url, 'http://') then 'http' else 'invalid' end as scheme from pages")
def url_check(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.when(u.startswith("https://"), "https").when(u.startswith("http://"), "http").otherwise("invalid").alias("scheme"))


@query("seq_similarity")
def seq_similarity(spark, d):
    """Ratcliff-Obershelp ratio of neighbouring part names; difflib's heuristic has no SQL form."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("work"), F.col("p_name").alias("title"))
    before = p.select((F.col("work") + 1).alias("work"), F.col("title").alias("other"))
    return p.join(before, "work").select("work", F.round(X.sequence_ratio("title", "other"), 6).alias("ratio"))
