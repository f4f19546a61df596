"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

A text is a multiset of five-word shingles; a shingle weighs its term frequency times a smoothed inverse document
frequency between 1 and 2. Document frequencies are counted over all documents, in hashed buckets of a fixed number,
so that the table that every task needs has a fixed size; what chance alone puts into a bucket, the median, is taken off,
so that ordinary shingles stay rare and common ones common however many documents there are. Consistent weighted samples
of the weighted set agree between two texts with a probability of their weighted Jaccard similarity; bands of four
samples give buckets of texts, and every link is verified on the whole weighted sets.

Equal word sequences are one text from the start. Every text of a bucket is first compared with the bucket's centre, the
text that meets most others over all bands, so that a large group makes one candidate for each of its texts. Where the
texts of a bucket aren't in one class after that, they are joined exactly: two sets of the threshold's similarity have
their first common element, in one order of all elements, where the weight that both have left is still enough for it. Texts
of different classes that share such an element are candidates too, so no pair of a bucket is left undecided.

Defined results: a text of one to four words is one shingle, texts without words are equal to each other; a null text
has no words; a null id is replaced by a hash of the text; rows that share an id are one class, whatever their texts;
of rows that share the least id of a class `keep_one` keeps the one of the least hash; other columns pass through it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import batch_bytes, narrowed, ship, worker_cache
from tallyloom.llm.shingles import gram_hashes, mixed, sequence_key, word_hashes, words_of
from tallyloom.operators.components import components
from tallyloom.session import written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
#: Buckets of document frequencies, and steps of weight: an element's low four bits hold its step.
DF_BITS, STEPS = 17, 16
_POOL = 1 << 16
#: Bytes of texts or weighted sets that go to a Python worker at once.
BATCH = "4m"

SIGNED = "id long, text_key long, seq_a long, seq_b long, bands array<long>"
SIGNED_ARROW = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("seq_a", pa.int64()), ("seq_b", pa.int64()), ("bands", pa.list_(pa.int64()))])


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of all shingles of a text, from those of its words."""
    return gram_hashes(h, min(SHINGLE, len(h))) if len(h) else h


def elements(h: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The weighted set as sorted integers: the n-th occurrence of a shingle is an element of its own, so that minimum
    and maximum of term frequencies are intersection and union; the low four bits are the step of its weight."""
    own = np.sort(shingle_hashes(h))
    if not len(own):
        return own
    new = np.concatenate(([True], own[1:] != own[:-1]))
    at = np.arange(len(own))
    nth = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    step = steps[(own >> np.uint64(64 - DF_BITS)).astype(np.int64)].astype(np.uint64)
    return np.sort((mixed(own + nth * np.uint64(0xA24BAED4963EE407)) & ~np.uint64(STEPS - 1)) | step)


def weight(e: np.ndarray) -> np.ndarray:
    return 1 + (e & np.uint64(STEPS - 1)).astype(np.float64) / (STEPS - 1)


def weighted_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two weighted sets; two empty ones are equal."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = float(weight(np.intersect1d(x, y, assume_unique=True)).sum())
    return both / (float(weight(x).sum()) + float(weight(y).sum()) - both)


def idf_steps(df: np.ndarray, n_docs: int) -> np.ndarray:
    """The step of weight of each bucket: 0 where all documents have it, STEPS - 1 where it has no more than most buckets."""
    own = np.clip(df - np.median(df), 0, n_docs)
    scale = np.log((1 + n_docs) / (1 + own)) / np.log(1 + max(1, n_docs))
    return np.clip(np.rint(scale * (STEPS - 1)), 0, STEPS - 1).astype(np.uint8)


class Sampler:
    """Consistent weighted samples; the random draws of an element and sample come from pools by hash."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.multipliers = r.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        gamma, cost, shift = r.gamma(2, 1, _POOL), r.gamma(2, 1, _POOL), r.random(_POOL)
        log_w = np.log(1 + np.arange(STEPS) / (STEPS - 1))[:, None]
        t = np.floor(log_w / gamma + shift)
        self.rank = (np.log(cost) - gamma * (t - shift) - gamma).astype(np.float32).ravel()
        self.t = t.astype(np.int64).astype(np.uint64).ravel()
        self.mix = r.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)

    def bands(self, e: np.ndarray) -> np.ndarray:
        """One hash for each band of samples of the weighted set e."""
        if not len(e):
            return np.zeros(BANDS, dtype=np.int64)
        offset = ((e & np.uint64(STEPS - 1)) * np.uint64(_POOL)).astype(np.int32)
        picked = np.empty(BANDS * ROWS, dtype=np.uint64)
        step = max(1, min(len(picked), _POOL // len(e)))
        for k in range(0, len(picked), step):
            at = ((e * self.multipliers[k : k + step, None]) >> np.uint64(48)).astype(np.int32)
            at += offset
            best = self.rank.take(at).argmin(axis=1)
            picked[k : k + step] = e[best] + self.t[at[np.arange(len(best)), best]]
        rows = mixed(picked.reshape(BANDS, ROWS) * self.mix)
        return mixed(rows.sum(axis=1, dtype=np.uint64)).view(np.int64)


def _sampler() -> Sampler:
    return worker_cache(("icws",), Sampler)


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by bucket of shingle hashes; bucket -1 counts the documents that have shingles."""
    df, n = np.zeros(1 << DF_BITS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            own = np.unique(shingle_hashes(word_hashes(words_of(text.as_py()))) >> np.uint64(64 - DF_BITS)).astype(np.int64)
            df[own] += 1
            n += len(own) > 0
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], names=["bucket", "n"])


def document_frequencies(own: DataFrame) -> tuple[np.ndarray, int]:
    """Documents by hashed bucket, over all of them, and their number. 2^DF_BITS counts reach the driver, at any size."""
    df, n_docs = np.zeros(1 << DF_BITS, dtype=np.int64), 0
    with batch_bytes(own.sparkSession, BATCH):
        rows = own.select("text").mapInArrow(_count_buckets, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    for row in rows:
        if row["bucket"] < 0:
            n_docs = row["n"]
        else:
            df[row["bucket"]] = row["n"]
    return df, n_docs


def _members(keyed: DataFrame) -> DataFrame:
    """keyed (key, node) with the size n of its bucket, where the bucket has two texts or more."""
    many = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return written(keyed.join(many, "key"), "members")


def _stars(weighed: DataFrame, threshold: float) -> DataFrame:
    """Candidates (a < b): every text of a bucket with the bucket's centre, unless their weights are too far apart."""
    mass = weighed.groupBy("node").agg(F.sum("n").alias("mass"))
    centre = F.max_by(F.struct("node", "w"), F.struct("mass", F.bitwise_not("node")))
    led = weighed.join(weighed.join(mass, "node").groupBy("key").agg(centre.alias("c")), "key")
    led = led.where((F.col("node") != F.col("c.node")) & (F.least("w", "c.w") >= threshold * (1 - 1e-9) * F.greatest("w", "c.w")))
    return led.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float, label: str) -> DataFrame:
    """The pairs whose weighted Jaccard similarity reaches the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.empty(0, dtype=np.uint64))
        for batch in batches:
            out = []
            for a, b, x, y in zip(*batch.columns, strict=True):
                left = x.as_py()
                if left != last[0]:
                    last = (left, np.frombuffer(left, dtype=np.uint64))
                s = weighted_jaccard(last[1], np.frombuffer(y.as_py(), dtype=np.uint64))
                if s >= threshold:
                    out.append((a.as_py(), b.as_py(), s))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "similarity"])

    left = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    with batch_bytes(sets.sparkSession, BATCH):
        return written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long, similarity double"), label)


def prefix(e: np.ndarray, threshold: float, lightest: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The elements, heaviest first, at which the first common one with a similar set can be, and the weight of the set
    from each on. A partner weighs `lightest` at least. All sets have their elements in one order."""
    step = (e & np.uint64(STEPS - 1)).astype(np.int64)
    own = e[np.lexsort((e, -step))]
    w = weight(own)
    total = float(w.sum())
    left = total - np.cumsum(w) + w
    n = int((left >= common_weight(total, max(lightest, threshold * total), threshold)).sum())
    return own[:n], left[:n]


def common_weight(w, v, threshold: float):
    """What two sets of weights w and v have in common at least, if their similarity reaches threshold."""
    return (w + v) * (threshold / (1 + threshold) * (1 - 1e-9))


def _first_of_equals(rows: DataFrame) -> DataFrame:
    """The elements of texts of several classes; of those that the same texts have, only the first in the order of sets. A
    first common element is the first of its equals, since both texts have all of them."""
    texts = [F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"k{k}") for k in (1, 2))]
    held = rows.groupBy("e").agg(F.min("c").alias("x"), F.max("c").alias("y"), *texts).where("x <> y")
    place = F.struct(-F.col("e").bitwiseAND(F.lit(STEPS - 1)), F.col("e").bitwiseXOR(F.lit(-(1 << 63))))
    return held.groupBy("n", "k1", "k2").agg(F.min_by("e", place).alias("e")).select("e")


def _remaining_links(weighed: DataFrame, links: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """All verified links between texts of one bucket that `links` don't put into one class already."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [prefix(np.frombuffer(x.as_py(), dtype=np.uint64), threshold, v.as_py()) for x, v in zip(batch.column(3), batch.column(4), strict=True)]
            e = pa.array([r[0].view(np.int64) for r in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], e, pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["node", "c", "w", "e", "rest"])

    named = components(links.select("a", "b"))
    placed = written(weighed.where("n > 2").join(named, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"), "w"), "placed")
    undecided = placed.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.min("w").alias("lightest")).where("x <> y").select("key", "lightest")
    texts = placed.join(undecided, "key").groupBy("node", "c", "w").agg(F.min("lightest").alias("lightest"))
    with batch_bytes(sets.sparkSession, BATCH):
        chosen = texts.join(sets.select("node", "set"), "node").select("node", "c", "w", "set", "lightest")
        own = written(chosen.mapInArrow(prefixes, "node long, c long, w double, e array<long>, rest array<double>"), "prefixes")
    rows = own.select("node", "c", "w", F.explode(F.arrays_zip("e", "rest")).alias("z")).select("node", "c", "w", "z.e", "z.rest")
    met = lambda of: of.groupBy("e").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.min("w").alias("v")).where("x <> y").select("e", "v")
    open_rows = written(rows.join(met(rows), "e").where(F.col("rest") >= common_weight(F.col("w"), F.col("v"), threshold)).drop("v"), "open")
    left = open_rows.join(_first_of_equals(open_rows), "e", "left_semi")
    right = left.select("e", *(F.col(x).alias(y) for x, y in (("node", "b"), ("c", "d"), ("w", "v"), ("rest", "over"))))
    enough = F.least("rest", "over") >= common_weight(F.col("w"), F.col("v"), threshold)
    pairs = left.join(right, "e").where((F.col("node") < F.col("b")) & (F.col("c") != F.col("d")) & enough).select(F.col("node").alias("a"), "b").distinct()
    return _verified(pairs, sets, threshold, "remaining-links")


def similar_links(texts: DataFrame, own: DataFrame, steps, threshold: float) -> DataFrame:
    """Verified links (a, b, similarity) between nodes; texts has one row (node, id, text_key, bands) for each text, and own
    the texts by (id, text_key)."""
    keyed = texts.select("node", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("key"), "node")
    members = _members(keyed)

    def make_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [elements(word_hashes(words_of(t.as_py())), steps.value) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([float(weight(e).sum()) for e in sets], pa.float64()), pa.array([e.tobytes() for e in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "w", "set"])

    key = ["id", "text_key"]
    involved = written(texts.select("node", *key).join(members.select("node").distinct(), "node", "left_semi"), "involved")
    found = narrowed(own, involved, key).join(involved, key).dropDuplicates(["node"]).select("node", "text")
    with batch_bytes(own.sparkSession, BATCH):
        sets = written(found.mapInArrow(make_sets, "node long, w double, set binary"), "sets")
    weighed = written(members.join(sets.select("node", "w"), "node"), "weighed")
    links = _verified(_stars(weighed, threshold), sets, threshold, "links")
    return links.union(_remaining_links(weighed, links, sets, threshold))


def _own_id(id_col: str, text):
    """The id, or a hash of the text that isn't a small number even for a null text."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text, F.lit("no id")))


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """id (null ids replaced) and class_id, the least id of the class, for every row of docs.

    Two scans of the texts (frequencies, samples) and a third that shuffles those that share a bucket: a filter of a
    fixed size keeps the others out, as far as its buckets go round.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.col(text_col).cast("string")
    own = docs.select(_own_id(id_col, text).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    steps = spark.sparkContext.broadcast(idf_steps(*document_frequencies(own)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler()
        for batch in batches:
            rows = []
            for i, k, t in zip(*batch.columns, strict=True):
                h = word_hashes(words_of(t.as_py()))
                rows.append((i.as_py(), k.as_py(), *sequence_key(h), sampler.bands(elements(h, steps.value))))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SIGNED_ARROW, strict=True)], schema=SIGNED_ARROW)

    seq = ["seq_a", "seq_b"]
    with batch_bytes(spark, BATCH):
        all_signed = written(own.mapInArrow(sign, SIGNED), "signed")
    least = F.min_by(F.struct("id", "text_key", "bands"), F.struct("id", "text_key"))
    several = written(all_signed.groupBy("id").agg(F.min("seq_a").alias("x"), F.max("seq_a").alias("y")).where("x <> y").select("id"), "shared-ids")
    # A text is named by its least id, or by its hash where other texts have that id too.
    name = F.when(F.col("other").isNull(), F.col("id")).otherwise(F.xxhash64(*seq, F.lit("text")))
    reps = all_signed.groupBy(*seq).agg(least.alias("r")).select(*seq, "r.*").join(several.withColumn("other", F.lit(1)), "id", "left")
    reps = written(reps.select(name.alias("node"), *seq, "id", "text_key", "bands"), "reps")
    links = similar_links(reps, own, steps, threshold).select("a", "b")
    named = all_signed.join(several, "id", "left_semi").join(reps.select(*seq, "node"), seq).select("id", "node").distinct()
    same_id = named.join(named.groupBy("id").agg(F.min("node").alias("b")), "id").where("node <> b").select(F.col("node").alias("a"), "b")
    joined = components(links.union(same_id))
    first = joined.join(reps.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("class_id"))
    of_node = joined.join(first, "component").select("node", "class_id")
    of_text = reps.select("node", *seq, "id").join(of_node, "node", "left").select(*seq, F.coalesce("class_id", "id").alias("class_id"))
    return all_signed.select("id", *seq).join(of_text, seq).select("id", "class_id")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class, that of the least id; its columns as they are.

    Only rows that may go are shuffled: those whose id is in a bucket, of a fixed number, with an id that goes or that
    several rows have.
    """
    found = classes(docs, text_col, id_col, threshold)
    marked = written(found.groupBy("id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n")).where("id <> class_id or n > 1"), "marked")
    keyed = docs.select(F.struct("*").alias("row"), _own_id(id_col, F.col(text_col).cast("string")).alias("id"))
    others = narrowed(keyed, marked, ["id"], keep=False).select("row")
    asked = narrowed(keyed, marked, ["id"]).join(marked, "id", "left")
    single = asked.where("class_id is null").select("row")
    shared = asked.where("id = class_id").groupBy("id").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row")
    return others.union(single).union(shared).select("row.*")


def query(docs: DataFrame) -> DataFrame:
    """One row for each document: its id and the least id of its class."""
    return classes(docs).select(F.col("id").alias("doc_id"), "class_id")
