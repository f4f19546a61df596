"""Text normalisation and matching as columns, with an Arrow function where full Unicode folding is asked for."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accented Latin letters and their base letters, in one order.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
BASE = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"
ARTICLES = "the|a|an"
# Words that say only what form a work has.
FORM_WORDS = ("film", "novel", "novella", "book", "tv series", "television series", "series", "video game", "game", "anime", "manga")
CREATOR_STOP = ("and", "with", "the")
TOKEN_STOP = ("and", "the", "with", "studios", "studio", "games", "productions", "company")


#: Blocks of letters with compatibility forms: Latin, super- and subscripts, letter-like, circled, ligatures, full width.
_BLOCKS = ((0x00A1, 0x0250), (0x1E00, 0x1F00), (0x2070, 0x20A0), (0x2100, 0x2150), (0x2150, 0x2190), (0x2460, 0x2500), (0xFB00, 0xFB07), (0xFF01, 0xFFE7))


def _fold(text: str | None) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    return plain.casefold()


def _forms() -> tuple[str, str, dict[str, str]]:
    """Characters that fold into one other, what they fold into, and those that fold into several."""
    folds = {c: f for a, b in _BLOCKS for c in map(chr, range(a, b)) if (f := _fold(c)) != c and f}
    one = {c: f for c, f in folds.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in folds.items() if len(f) > 1}


_ONE, _ONE_FOLDED, _SEVERAL = _forms()


def folded(text: Column) -> Column:
    """Lower case, without marks, in compatibility form for the blocks above; JVM-side. Plain ASCII needs the lower case only."""
    x = F.translate(F.lower(text), _ONE, _ONE_FOLDED)
    apart = x
    for char, fold in _SEVERAL.items():
        apart = F.replace(apart, F.lit(char), F.lit(fold))
    x = F.when(x.rlike("[" + "".join(_SEVERAL) + "]"), apart).otherwise(x)
    x = F.when(x.rlike(r"\p{Mn}"), F.regexp_replace(x, r"\p{Mn}+", "")).otherwise(x)
    return F.when(text.rlike(r"[^\x00-\x7f]"), x).otherwise(F.lower(text))


def normalize(text: Column, half: bool = True, ampersand: str = "before", articles: bool = True) -> Column:
    """Words of ASCII letters and digits, one space apart.

    half: a one-half sign is the word half; ampersand: & is the word and ("before" or "after" folding) or a break ("none");
    articles: one leading article goes.
    """
    x = F.coalesce(text, F.lit(""))
    if half:
        x = F.replace(x, F.lit("½"), F.lit(" half "))
    if ampersand == "before":
        x = F.replace(x, F.lit("&"), F.lit(" and "))
    x = folded(x)
    if ampersand == "after":
        x = F.replace(x, F.lit("&"), F.lit(" and "))
    x = F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))
    return F.trim(F.regexp_replace(x, f"^({ARTICLES}) ", "")) if articles else x


@F.udf(T.StringType(), useArrow=True)
def folded_full(text):
    """Compatibility decomposition, no combining marks, case folded: for scripts that `folded` doesn't know."""
    return _fold(text)


def normalize_full(text: Column) -> Column:
    """`normalize` with full Unicode folding, in Arrow batches."""
    x = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("½"), F.lit(" half ")), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(folded_full(x), "[^a-z0-9]+", " ")), f"^({ARTICLES}) ", ""))


def normalize_html(html: Column) -> Column:
    """Tags go, the common entities are read, & is the word and, articles stay."""
    x = F.regexp_replace(html, "<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return normalize(x, half=False, articles=False)


def normalized(value: str) -> str:
    """`normalize` of one text on the driver, for names in configuration files."""
    x = _fold(value.replace("½", " half ").replace("&", " and "))
    x = re.sub("[^a-z0-9]+", " ", x).strip(" ")
    return re.sub(f"^({ARTICLES}) ", "", x).strip(" ")


def creator_words(name: str) -> str:
    """`creator_key` of one name on the driver."""
    return " ".join(sorted(w for w in normalized(name).split() if w not in CREATOR_STOP))


def alias_map(pairs) -> dict[str, str]:
    """Normalised names that mean one work, each with the smaller name of its pair; the last pair of a name holds."""
    out: dict[str, str] = {}
    for one, other in pairs:
        names = (normalized(one), normalized(other))
        out |= dict.fromkeys(names, min(names))
    return out


def aliased(title: Column, aliases: dict[str, str]) -> Column:
    """A normalised title, or what it is an alias of."""
    if not aliases:
        return title
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(F.try_element_at(table, title), title)


def creator_key(name: Column) -> Column:
    """The sorted words of a name without joining words; repeats stay."""
    words = F.filter(F.split(normalize(name), " "), lambda w: ~w.isin(*CREATOR_STOP, ""))
    return F.array_join(F.array_sort(words), " ")


def key_words(key: Column) -> Column:
    """The distinct words of a creator key."""
    return F.array_distinct(F.filter(F.split(key, " "), lambda w: w != ""))


def words_related(x: Column, y: Column) -> Column:
    """Whether half of the distinct words of the shorter list or more are in both; false where either is empty."""
    return (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) * 2 >= F.least(F.size(x), F.size(y)))


def creators_related(a: Column, b: Column) -> Column:
    """`words_related` of two creator keys."""
    return words_related(key_words(a), key_words(b))


def creator_tokens(name: Column, least: int = 4, stop: tuple[str, ...] = TOKEN_STOP) -> Column:
    return F.array_distinct(F.filter(F.split(normalize(name, articles=False), " "), lambda w: (F.length(w) >= least) & ~w.isin(*stop)))


# Fixed value: how a season or series is written at the end of a title.
SEASON = r"(?i)\s*[:,-]?\s*(season|series)\s+(\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s*$"


def strip_season(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, SEASON, ""))


def title_candidates(title: Column, original: Column, aliases: dict[str, str] | None = None) -> Column:
    """Normalised title and original title by their aliases, and both without a trailing form word; no empties, no repeats."""
    known = aliases or {}
    both = [aliased(normalize(x), known) for x in (title, original)]
    bare = [F.trim(F.regexp_replace(x, f" ({'|'.join(FORM_WORDS)})$", "")) for x in both]
    bare = [aliased(F.trim(F.regexp_replace(x, f"^({ARTICLES}) ", "")), known) for x in bare]
    return F.array_sort(F.array_distinct(F.filter(F.array(*both, *bare), lambda x: x != "")))


def year_matches(text: Column, year: Column, spread: int = 2) -> Column:
    return F.exists(F.sequence(year - spread, year + spread), lambda y: F.contains(text, y.cast("string")))


def has_tokens(haystack: Column, search: str) -> Column:
    """Whether every white-space token of the search is in the lower-case haystack."""
    hit = F.lit(True)
    for token in search.lower().split():
        hit = hit & F.contains(haystack, F.lit(token))
    return hit


def csv_cell(text: Column) -> Column:
    """Quoted only where a quote, comma or line break asks for it; null is empty."""
    x = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(x.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def one_decimal(x: Column) -> Column:
    """A double with one decimal as printf writes it: from its exact binary value, ties to the even digit.

    `format_string` rounds the shortest decimal form half up instead. Ten times x is tenths + rest without any error."""
    tenths = 8 * x + 2 * x
    rest = 2 * x - (tenths - 8 * x)
    near = F.rint(tenths)
    tie = (F.abs(tenths - near) == 0.5) & (rest != 0)
    return F.format_string("%.1f", F.when(tie, tenths + F.signum(rest) / 2).otherwise(near) / 10)


def escape_html(text: Column) -> Column:
    x = text
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        x = F.replace(x, F.lit(char), F.lit(name))
    return x


def natural_key(text: Column) -> Column:
    """A sort key in which runs of digits order as numbers and case and Latin accents don't count."""
    wide = F.regexp_replace(text, "([0-9]+)", "0000000000$1")
    return folded(F.regexp_replace(wide, "[0-9]*([0-9]{10})(?![0-9])", "$1"))


@F.udf(T.DoubleType(), useArrow=True)
def sequence_ratio(a, b):
    """Ratcliff-Obershelp similarity of two strings."""
    import difflib

    return difflib.SequenceMatcher(None, a or "", b or "").ratio()
