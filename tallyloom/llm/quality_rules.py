"""Quality rules: a decision list learned by sequential covering, emitted as an ordered conditional expression.

Statistics of each text come from built-in functions in one pass. A bounded, hash-ordered sample of labelled rows is
split into rows to grow on and rows to prune on. Each rule is a conjunction of thresholds that is grown by information
gain, pruned on rows that it was not grown on, and kept while it is precise there; rows that it covers leave the
sample. The list becomes one `CASE WHEN` column, so that scoring is a scan without Python.

Defined results: a null text has no words; a text without words fails the base rules; null and repeated ids are of no
concern to scoring, and a label whose id several documents have counts once, with the least of their statistics; without labels of both kinds the
list is empty and keeps all that passes the base rules; other columns of any name pass through `keep_good`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import SPACE_CLASS

#: Words of a window that counts as repeated.
WINDOW = 5
#: Statistics that rules may test. They are ratios or means, so that thresholds don't depend on length alone.
FEATURES = ("n_words", "mean_chars", "symbols_per_word", "upper_share", "digit_share", "repeat_share", "dup_line_share", "marks_per_word", "distinct_share")


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in a window found twice or more; hashes: one long for each word."""
    n = F.size(hashes) - (WINDOW - 1)
    parts = [F.slice(hashes, F.lit(k + 1), F.greatest(n, F.lit(0))) for k in range(WINDOW)]
    return F.transform(F.arrays_zip(*parts), lambda s: F.xxhash64(s))


def _covered(windows: Column) -> Column:
    """Words under the windows whose hash occurs again in the array."""
    m = F.size(windows)
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = F.zip_with(
        F.slice(placed, F.lit(1), m - 1),
        F.slice(placed, F.lit(2), m - 1),
        lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>")),
    )
    return F.sort_array(F.array_distinct(F.flatten(pairs)))


def _union_length(starts: Column) -> Column:
    m = F.size(starts)
    gaps = F.zip_with(F.slice(starts, F.lit(1), m - 1), F.slice(starts, F.lit(2), m - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    return F.when(m < 1, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda a, g: a + g) + WINDOW)


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`row`: each row of docs as a struct; `stats`: a struct of its text's statistics.

    One pass without a shuffle. Each step stands in a projection of its own and is used more than once above, which
    keeps the optimizer from inlining an array into a lambda that would compute it for every element; the explode of
    one struct at the end keeps it from pushing a filter on the statistics below them, which would inline them all.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.struct("*").alias("row"), text.alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", SPACE_CLASS + "+"), ""))
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    d = d.withColumn("windows", _repeat_words(F.col("hashes")))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.withColumn("starts", F.when(repeats, _covered(F.col("windows"))).otherwise(F.array().cast("array<int>")))
    squeezed = lambda outside: F.length(F.regexp_replace("text", outside, ""))
    d = d.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        squeezed(r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _union_length(F.col("starts")).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        squeezed(r"[^\p{Lu}]+").alias("n_upper"),
        squeezed(r"[^0-9]+").alias("n_digits"),
        squeezed(r"[^!?]+").alias("n_marks"),
        F.size(F.array_distinct("hashes")).alias("n_distinct"),
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    stats = F.struct(
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        per("word_chars", "n_words").alias("mean_chars"),
        per("n_symbols", "n_words").alias("symbols_per_word"),
        per("n_upper", "word_chars").alias("upper_share"),
        per("n_digits", "word_chars").alias("digit_share"),
        per("n_repeat_words", "n_words").alias("repeat_share"),
        per("n_dup_lines", "n_lines").alias("dup_line_share"),
        per("n_marks", "n_words").alias("marks_per_word"),
        per("n_distinct", "n_words").alias("distinct_share"),
    )
    return d.select("row", F.explode(F.array(stats)).alias("stats"))


def base_failed() -> Column:
    """The fixed rules over `stats`: too few words, or too many in repeated windows."""
    s = F.col("stats")
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


@dataclass(frozen=True)
class Test:
    """feature > threshold, or feature <= threshold."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col("stats")[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Test, ...]


def thresholds(values: list[float], most: int) -> list[float]:
    """Midpoints between neighbouring distinct values, at evenly spaced ranks where there are more than `most`."""
    ordered = sorted(values)
    cuts = sorted({(a + b) / 2 for i in range(1, most + 1) if (k := len(ordered) * i // (most + 1)) and (a := ordered[k - 1]) < (b := next((x for x in ordered[k:] if x > a), a))})
    distinct = sorted(set(ordered))
    return [(a + b) / 2 for a, b in zip(distinct, distinct[1:])] if len(distinct) <= most else cuts


def learn_rules(
    rows: list[tuple[dict[str, float], int, bool]], max_rules: int = 12, max_tests: int = 3, min_precision: float = 0.9, min_cover: int = 3, max_thresholds: int = 96
) -> list[Rule]:
    """Sequential covering of the rows to reject.

    rows: (statistics, label with 0 for reject, whether to prune on this row). Sets of rows are bit sets in integers,
    so one candidate costs one AND and one bit count.
    """
    rows = sorted(rows, key=lambda r: (*(r[0][f] for f in FEATURES), r[1], r[2]))
    everyone = (1 << len(rows)) - 1
    bits = lambda keep: sum(1 << i for i, r in enumerate(rows) if keep(r))
    bad, prune = bits(lambda r: r[1] == 0), bits(lambda r: r[2])
    tests: list[tuple[Test, int]] = []
    for f in FEATURES:
        order = sorted(range(len(rows)), key=lambda i: rows[i][0][f])
        cuts = thresholds([r[0][f] for r in rows], max_thresholds)
        mask, at = 0, 0
        for cut in cuts:
            while at < len(order) and rows[order[at]][0][f] <= cut:
                mask |= 1 << order[at]
                at += 1
            tests += [(Test(f, False, cut), mask), (Test(f, True, cut), everyone & ~mask)]
    left, rules = everyone, []
    while len(rules) < max_rules:
        cover, rule = left & ~prune, []
        while len(rule) < max_tests:
            p, n = (cover & bad).bit_count(), (cover & ~bad).bit_count()
            if not p or not n and rule:
                break
            best, gain = None, 1e-9
            for test, mask in tests:
                q = (cover & mask & bad).bit_count()
                if q < min_cover:
                    continue
                m = (cover & mask & ~bad).bit_count()
                g = q * (math.log2(q / (q + m)) - math.log2(p / (p + n)))
                if g > gain:
                    best, gain = (test, mask), g
            if best is None:
                break
            rule.append(best)
            cover &= best[1]
        worth = []
        for k in range(1, len(rule) + 1):
            c = left & prune
            for _, mask in rule[:k]:
                c &= mask
            p, n = (c & bad).bit_count(), (c & ~bad).bit_count()
            worth.append(((p - n) / max(1, p + n), -k, p / max(1, p + n)))
        if not worth or max(worth)[2] < min_precision:
            break
        rule = rule[: -max(worth)[1]]
        rules.append(tuple(t for t, _ in rule))
        gone = left
        for _, mask in rule:
            gone &= mask
        left &= ~gone
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as an ordered conditional over `stats`: false where the first rule that holds rejects."""
    out = None
    for rule in rules:
        holds = rule[0].column()
        for test in rule[1:]:
            holds = holds & test.column()
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000, text_col: str = "text", id_col: str = "doc_id", **how) -> list[Rule]:
    """Rules from labels.quality. At most max_train_rows labelled rows are used, those of the lowest id hash, so that the
    sample doesn't depend on partitions; they are the only rows broadcast and collected."""
    key = F.xxhash64(F.col(id_col).cast("string"))
    sample = (
        labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
        .select(F.col(id_col).cast("long").alias("label_id"), F.col("quality").cast("int").alias("label_quality"), key.alias("label_key"))
        .orderBy("label_key", "label_id", "label_quality")
        .limit(max_train_rows)
    )
    own = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).alias("text"))
    train = text_stats(own.join(F.broadcast(sample), "label_id"))
    picked = train.select(*(F.col("stats")[f].cast("double").alias(f) for f in FEATURES), F.col("row.label_quality").alias("label"), F.col("row.label_key").alias("key"), base_failed().alias("failed"))
    once = picked.where(~F.col("failed")).groupBy("key", "label").agg(F.min(F.struct(*FEATURES)).alias("s"))
    rows = [({f: r["s"][f] for f in FEATURES}, r["label"], r["key"] % 3 == 0) for r in once.collect()]
    return learn_rules(rows, **how)


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """`row`, `stats`, `base_failed` and `kept` for every row of docs."""
    scored = text_stats(docs, text_col)
    return scored.select("row", "stats", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of op2."""
    out = judge(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("row.doc_id", *(F.col("stats")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that the rules reject, with the columns of docs."""
    return judge(docs, fit(docs, labels, text_col=text_col), text_col).where("kept").select("row.*")
