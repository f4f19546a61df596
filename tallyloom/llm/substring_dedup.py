"""Substring dedup by relative Lempel-Ziv parsing.

Every document is factored against the indexed blocks of all documents with smaller ids. The index maps each window of
50 words to its first place: the least document that holds it, and where. It is exact and small: a window is anchored
at the least hash among its runs of 16 words, equal windows have equal anchors, and only windows under an anchor that
occurs in two different texts can match at all, so only these are indexed, by (anchor, window) hash.

The blocks of words that a document's windows point to are joined to it, and it is parsed greedily, word by word: at the
first window with a place in the index a factor starts, and grows as long as its words equal those of the reference. At
its end the windows across the boundary are looked up in turn, the first of them with a place starts the next factor.
So every factor is a verified substring of its reference, of 50 words or more, and the words under factors go.

Documents with equal word sequences are one text: the copy with the least id is parsed for all, the words of every
other copy go as a whole if it has a window.

Defined results: a null text has no words; rows with a null id are never reference and lose nothing; rows that share
an id don't count against each other; texts of less than 50 words keep all; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import narrowed, ship
from tallyloom.llm.shingles import gram_hashes, sequence_key, sliding_min, word_hashes, words_of
from tallyloom.session import written

#: Words of a window, and of the runs among which its anchor is chosen.
WINDOW = 50
ANCHOR = 16
#: Words of a reference block.
BLOCK = 64

TEXTS = "doc_id long, text_key long, n_words long, words_sha256 string, seq_a long, seq_b long, anchors array<long>"
TEXTS_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("words_sha256", pa.string()), ("seq_a", pa.int64()), ("seq_b", pa.int64()), ("anchors", pa.list_(pa.int64()))]
)
PARSED = "doc_id long, seq_a long, seq_b long, text string, starts array<int>, windows array<long>, marks array<long>"
PARSED_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("seq_a", pa.int64()), ("seq_b", pa.int64()), ("text", pa.string()), ("starts", pa.list_(pa.int32())), ("windows", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64()))]
)
RUNS = "t long, runs array<struct<start:int,n:int,ref:long,ref_t:long,at:int>>"
BLOCKS = "ref_t long, block int, words binary"
FACTORED = "seq_a long, seq_b long, n_removed long, kept_sha256 string, factors array<struct<start:int,length:int,ref:long,at:int>>"
RUNS_ARROW = pa.schema([("t", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("ref", pa.int64()), ("ref_t", pa.int64()), ("at", pa.int32())])))])
BLOCKS_ARROW = pa.schema([("ref_t", pa.int64()), ("block", pa.int32()), ("words", pa.binary())])
FACTORED_ARROW = pa.schema(
    [("seq_a", pa.int64()), ("seq_b", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("factors", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref", pa.int64()), ("at", pa.int32())])))]
)


def anchors_of(h: np.ndarray) -> np.ndarray:
    """The anchor of every window, by its start."""
    return sliding_min(gram_hashes(h, ANCHOR), WINDOW - ANCHOR + 1)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, key, text in zip(*batch.columns, strict=True):
            words = words_of(text.as_py())
            h = word_hashes(words)
            anchors = np.unique(anchors_of(h)).view(np.int64)
            rows.append((doc_id.as_py(), key.as_py(), len(words), _sha(words), *sequence_key(h), anchors))
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, TEXTS_ARROW, strict=True)], schema=TEXTS_ARROW)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows under shared anchors, of the texts that have any."""
    for batch in batches:
        rows = []
        for doc_id, a, b, text, shared in zip(*batch.columns, strict=True):
            h = word_hashes(words_of(text.as_py()))
            marks = anchors_of(h)
            starts = np.flatnonzero(np.isin(marks, np.array(shared.as_py(), dtype=np.int64).view(np.uint64)))
            rows.append((doc_id.as_py(), a.as_py(), b.as_py(), text.as_py(), starts.astype(np.int32), gram_hashes(h, WINDOW)[starts].view(np.int64), marks[starts].view(np.int64)))
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PARSED_ARROW, strict=True)], schema=PARSED_ARROW)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def runs_of(found: list[dict]) -> list[dict]:
    """Windows one after the other whose places follow each other in one reference, as one run of n windows."""
    runs: list[dict] = []
    for m in sorted(found, key=lambda m: m["start"]):
        last = runs[-1] if runs else None
        if last and last["ref_t"] == m["ref_t"] and m["start"] - last["start"] == m["at"] - last["at"] == last["n"]:
            last["n"] += 1
        else:
            runs.append(m | {"n": 1})
    return runs


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([(t.as_py(), runs_of(found.as_py())) for t, found in zip(*batch.columns, strict=True)], RUNS_ARROW)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asked blocks of reference texts."""
    for batch in batches:
        rows = []
        for t, text, asked in zip(*batch.columns, strict=True):
            words = words_of(text.as_py())
            rows += [(t.as_py(), k, b" ".join(words[k * BLOCK : (k + 1) * BLOCK])) for k in asked.as_py()]
        yield _batch(rows, BLOCKS_ARROW)


def common_length(words: list[bytes], start: int, blocks: dict[int, list[bytes]], at: int) -> int:
    """How many words from start on equal those of the reference from `at` on, as far as its blocks are there."""
    n = 0
    while (block := blocks.get((at + n) // BLOCK)) is not None:
        theirs = block[(at + n) % BLOCK :]
        mine = words[start + n : start + n + len(theirs)]
        if mine != theirs:
            return n + next((k for k, (x, y) in enumerate(zip(mine, theirs)) if x != y), len(mine))
        n += len(theirs)
        if not theirs:
            break
    return n


def parse(words: list[bytes], runs: list[dict], blocks: dict[int, dict[int, list[bytes]]]) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, length, reference, place in it) of 50 words or more; blocks by reference text and number."""
    factors: list[tuple[int, int, int, int]] = []
    free = 0
    for run in sorted(runs, key=lambda r: r["start"]):
        own = blocks.get(run["ref_t"], {})
        start = max(run["start"], free)
        while start < run["start"] + run["n"]:
            at = run["at"] + start - run["start"]
            length = common_length(words, start, own, at)
            if length >= WINDOW:
                factors.append((start, length, run["ref"], at))
                free = start = start + length - WINDOW + 1
            else:  # equal hashes of different words
                start += 1
    return factors


def _factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for a, b, text, runs, supplied in zip(*batch.columns, strict=True):
            words = words_of(text.as_py())
            blocks: dict[int, dict[int, list[bytes]]] = {}
            for x in supplied.as_py():
                blocks.setdefault(x["ref_t"], {})[x["block"]] = x["words"].split(b" ")
            factors = parse(words, runs.as_py(), blocks)
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            for start, length, _, _ in factors:
                gone[start] += 1
                gone[start + length] -= 1
            keep = np.cumsum(gone)[:-1] == 0
            kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            rows.append((a.as_py(), b.as_py(), len(words) - len(kept), _sha(kept), [dict(zip(("start", "length", "ref", "at"), f, strict=True)) for f in factors]))
        yield _batch(rows, FACTORED_ARROW)


def dedup_substrings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256 and factors (start, length, ref, at).

    Texts under a shared anchor are shuffled, and a filter of a fixed size keeps the others out as far as its buckets go
    round; anchors are about a sixteenth of the words, windows are shuffled only under shared anchors, blocks only where a
    window points to them. Keys are aggregated before each shuffle or met by joins that adaptive execution splits, so
    that a passage in a third of all documents is no hot task. Joins whose sides both grow with the documents are merge
    joins at every size, so that what a small table shows of the plan holds for a large one.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    texts = written(own.mapInArrow(_read_texts, TEXTS), "texts")
    seq = ["seq_a", "seq_b"]
    least = written(
        texts.where("doc_id is not null").groupBy(*seq).agg(F.min("doc_id").alias("rep_id"), F.max(F.when(F.size("anchors") > 0, F.lit(1)).otherwise(0)).alias("long_enough")), "least"
    )
    reps = least.where("long_enough = 1").withColumnRenamed("rep_id", "doc_id").drop("long_enough")
    marked = texts.where("doc_id is not null").join(reps, [*seq, "doc_id"], "left_semi")
    anchors = marked.select("doc_id", "text_key", *seq, F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("seq_a").alias("first"), F.max("seq_a").alias("last")).where("first <> last").select("anchor")
    wanted = anchors.join(shared.hint("merge"), "anchor").groupBy("doc_id", "text_key", *seq).agg(F.collect_set("anchor").alias("anchors"))
    one = F.struct("text_key", "anchors")
    wanted = wanted.groupBy("doc_id", *seq).agg(F.min(one).alias("one")).select("doc_id", *seq, "one.text_key", "one.anchors")
    key = ["doc_id", "text_key"]
    wanted = written(wanted, "wanted")
    chosen = narrowed(own, wanted, key).join(wanted.hint("merge"), key).dropDuplicates(key)
    # t names a text; it is stored, so it stays the same however often the table is read.
    parsed = written(chosen.select("doc_id", *seq, "text", "anchors").mapInArrow(_windows, PARSED).withColumn("t", F.monotonically_increasing_id()), "parsed")
    spread = parsed.select("doc_id", "t", F.explode(F.arrays_zip("starts", "windows", "marks")).alias("w")).select("doc_id", "t", F.col("w.starts").alias("start"), "w.windows", "w.marks")
    window = ["marks", "windows"]
    index = spread.groupBy(*window).agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("last")).where("ref < last").drop("last")
    repeated = written(spread.join(index.hint("merge"), window), "repeated")
    first = repeated.where("doc_id = ref").groupBy(*window).agg(F.min(F.struct("t", "start")).alias("place"))
    match = F.struct("start", "ref", F.col("place.t").alias("ref_t"), F.col("place.start").alias("at"))
    matches = repeated.where("ref < doc_id").join(first.hint("merge"), window).groupBy("t").agg(F.collect_list(match).alias("found"))
    runs = written(matches.mapInArrow(_runs, RUNS), "runs")
    numbers = F.sequence(F.floor(F.col("r.at") / BLOCK).cast("int"), F.floor((F.col("r.at") + F.col("r.n") + (WINDOW - 2)) / BLOCK).cast("int"))
    asked = written(runs.select("t", F.explode("runs").alias("r")).select("t", "r.ref_t", F.explode(numbers).alias("block")).distinct(), "asked")
    by_text = asked.select("ref_t", "block").distinct().groupBy("ref_t").agg(F.collect_list("block").alias("blocks"))
    texts_of = parsed.select(F.col("t").alias("ref_t"), "text")
    blocks = narrowed(texts_of, asked, ["ref_t"]).join(by_text.hint("merge"), "ref_t").select("ref_t", "text", "blocks").mapInArrow(_blocks, BLOCKS)
    supplied = asked.join(blocks, ["ref_t", "block"]).groupBy("t").agg(F.collect_list(F.struct("ref_t", "block", "words")).alias("supplied"))
    matched = narrowed(parsed.select("t", *seq, "text"), runs, ["t"]).join(runs.hint("merge"), "t").join(supplied.hint("merge"), "t")
    factored = matched.select(*seq, "text", "runs", "supplied").mapInArrow(_factor, FACTORED)
    known = least.join(factored, seq, "left")
    copy = (F.col("doc_id") > F.col("rep_id")) & (F.col("n_words") >= WINDOW)
    parsed_one = (F.col("doc_id") == F.col("rep_id")) & F.col("n_removed").isNotNull()
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("length"), F.col("rep_id").alias("ref"), F.lit(0).alias("at")))
    return texts.join(known, seq, "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).when(parsed_one, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_sha([]))).when(parsed_one, F.col("kept_sha256")).otherwise(F.col("words_sha256")).alias("kept_sha256"),
        F.when(copy, whole).when(parsed_one, F.col("factors")).otherwise(F.array().cast("array<struct<start:int,length:int,ref:bigint,at:int>>")).alias("factors"),
    )


def query(docs: DataFrame) -> DataFrame:
    """The columns of op10."""
    return dedup_substrings(docs).drop("factors")


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple[int | None, int, int, str]]:
    """The contract stated plainly, for tests: (doc_id, n_words, n_removed, kept_sha256)."""
    first: dict[tuple[bytes, ...], int] = {}
    split = [(i, words_of(x)) for i, x in rows]
    for i, w in split:
        for k in range(len(w) - WINDOW + 1):
            if i is not None:
                key = tuple(w[k : k + WINDOW])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone: set[int] = set()
        for k in range(len(w) - WINDOW + 1):
            if i is not None and first[tuple(w[k : k + WINDOW])] < i:
                gone.update(range(k, k + WINDOW))
        out.append((i, len(w), len(gone), _sha([x for k, x in enumerate(w) if k not in gone])))
    return out
