"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

The three-word runs of each test item are counted over all documents, and every run that occurs is a seed. Where a
document has one of the rarer half of an item's occurring runs, the words around it are aligned with the item; where it
has another one, they are aligned if enough of the item's words are there for the least score. That test drops no
alignment that could reach the score, so common phrases cost little and an edited copy is found by any run it kept.
The score of the best local alignment over that of a perfect copy says how much of the item is there, edits and gaps
included. A copy that has no three words of the item in a row has no seed.

The test set is broadcast in blocks of a bounded size, all documents against each block; a task holds one block, and
documents aren't shuffled. So a test set costs two scans of the documents for every BLOCK_BYTES of it.

Defined results: words are compared in lower case without punctuation; items of fewer than MIN_ITEM_WORDS such words
and null items match nothing; a null text has no words; null ids pass through; repeated rows each get their results;
repeated items count as one; other columns pass through `drop_contaminated`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.shared import ship, worker_cache
from tallyloom.llm.shingles import gram_hashes, mixed
from tallyloom.session import written

SEED_WORDS = 3
MIN_ITEM_WORDS = 5
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
#: Test texts that are broadcast at once; a larger test set goes in several blocks.
BLOCK_BYTES = 16 << 20
MEMO_ENTRIES = 800_000
#: Words of more bytes, and those beyond ASCII, are hashed one by one.
MEMO_WORD_BYTES = 64
#: Texts whose words are held at once, and bytes that are hashed at once (a longer text or word is taken whole).
GROUP_BYTES = 4 << 20
PIECE_BYTES = 1 << 17
_FILTER_BITS = 22


def _plain_bytes() -> np.ndarray:
    """For each ASCII byte its lower case, 0 where it is dropped from plain words; 0 for bytes beyond ASCII."""
    return np.array([ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 0 for b in range(256)], dtype=np.uint8)


_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_PLAIN = _plain_bytes()
#: Random bits for each place of a plain ASCII word and each byte there: the sum of a word's is mixed to its hash.
_TERMS = mixed(np.arange(1, 256 * (MEMO_WORD_BYTES + 1) + 1, dtype=np.uint64))


def _hash(plain: bytes) -> int:
    """The hash of one plain word, as _ascii_hashes has it for ASCII ones."""
    if len(plain) > MEMO_WORD_BYTES or not plain.isascii():
        return xxhash.xxh64_intdigest(plain) | 1
    at = np.arange(len(plain)) * 256 + np.frombuffer(plain, dtype=np.uint8)
    return int(mixed(_TERMS[at].sum(keepdims=True))[0]) | 1


class _PlainHashes(dict):
    """Hash of a word in lower case without punctuation; 0 where nothing is left."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        plain = "".join(c for c in word.decode("utf-8").lower() if c.isalnum()).encode()
        h = _hash(plain) if plain else 0
        if len(word) <= MEMO_WORD_BYTES:
            self[word] = h
        return h


def _piece_hashes(buf: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a piece of texts that begin at heads; ASCII words without a loop over them."""
    space = _IS_SPACE[buf]
    first = np.ones(len(buf), dtype=bool)
    first[1:] = space[:-1]
    first[heads] = True
    first = np.flatnonzero(first & ~space)
    h = np.zeros(len(first), dtype=np.uint64)
    if not len(first):
        return first, h
    low = _PLAIN[buf]
    kept = low != 0
    # Kept bytes before each word and in it, and the place of each kept byte in its word.
    before = np.cumsum(kept, dtype=np.int64)
    total = int(before[-1])
    before = before[first] - kept[first]
    size = np.diff(before, append=total)
    at = np.arange(total) - np.repeat(before, size)
    if size.max() > MEMO_WORD_BYTES:
        np.minimum(at, MEMO_WORD_BYTES, out=at)
    real = np.flatnonzero(size)
    if len(real):
        h[real] = mixed(np.add.reduceat(_TERMS[at * 256 + low[kept]], before[real])) | np.uint64(1)
    one_by_one = size > MEMO_WORD_BYTES
    if buf.max() > 127:
        one_by_one |= np.maximum.reduceat(buf, first) > 127
    one_by_one = np.flatnonzero(one_by_one)
    if len(one_by_one):
        memo = worker_cache(("plain",), _PlainHashes, large=True)
        raw, ends = buf.tobytes(), np.append(first[1:], len(buf))
        words = (raw[a:b].rstrip() for a, b in zip(first[one_by_one].tolist(), ends[one_by_one].tolist(), strict=True))
        h[one_by_one] = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(one_by_one))
    return first, h


@dataclass
class PlainWords:
    """Plain words of some texts, one after another."""

    #: Row of the first text, and for each text and the end the plain words before it and all words before it.
    row: int
    cuts: np.ndarray
    all_cuts: np.ndarray
    #: The hash of each plain word and its place among all words.
    h: np.ndarray
    at: np.ndarray


def plain_words(texts: pa.Array) -> Iterator[PlainWords]:
    """The plain words of texts (null: none), by groups of whole texts of about GROUP_BYTES."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + GROUP_BYTES, "right")) - 1)
        heads = ends[row : stop + 1] - ends[row]
        group = whole[ends[row] : ends[stop]]
        starts, hashes = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)]
        a = 0
        while a < len(group):
            # A piece ends behind white space, so that it cuts no word.
            b = a + PIECE_BYTES
            while b < len(group) and not len(gaps := np.flatnonzero(_IS_SPACE[group[b - 1024 : b]])):
                b += PIECE_BYTES
            b = b - 1023 + int(gaps[-1]) if b < len(group) else len(group)
            lo, hi = np.searchsorted(heads, (a, b))
            first, h = _piece_hashes(group[a:b], heads[lo:hi] - a)
            starts.append(first + a)
            hashes.append(h)
            a = b
        h = np.concatenate(hashes)
        all_cuts = np.searchsorted(np.concatenate(starts), heads)
        at = np.flatnonzero(h)
        yield PlainWords(row, np.searchsorted(at, all_cuts), all_cuts, h[at], at)
        row = stop


def plain_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the plain words of a text, and the place of each among all its words."""
    (words,) = plain_words(pa.array([text], pa.large_string()))
    return words.h, words.at


def _local(a: np.ndarray, b: np.ndarray) -> tuple[float, int, int]:
    """The best local alignment score and the ends of its parts of a and b."""
    ramp = -GAP * np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1)
    best, end_a, end_b = 0.0, 0, 0
    for i, x in enumerate(a.tolist()):
        new = np.maximum(row + GAP, 0.0)
        np.maximum(new[1:], row[:-1] + np.where(b == np.uint64(x), MATCH, MISMATCH), out=new[1:])
        row = np.maximum.accumulate(new + ramp) - ramp
        k = int(row.argmax())
        if row[k] > best:
            best, end_a, end_b = float(row[k]), i + 1, k
    return best, end_a, end_b


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman: score, and start and end of the aligned words in the passage."""
    score, end_a, end_b = _local(item, passage)
    if score <= 0:
        return 0.0, 0, 0
    _, _, back = _local(item[:end_a][::-1], passage[:end_b][::-1])
    return score, end_b - back, end_b


@dataclass
class Block:
    """Test items of one broadcast: words by item, and seeds as hash, item and place in the item, sorted by hash."""

    items: list[tuple[int, np.ndarray]]
    grams: np.ndarray = field(init=False)
    gram_item: np.ndarray = field(init=False)
    gram_at: np.ndarray = field(init=False)
    gram_rare: np.ndarray = field(init=False)

    def __post_init__(self):
        own = [gram_hashes(h, SEED_WORDS) for _, h in self.items]
        grams = np.concatenate([*own, np.empty(0, dtype=np.uint64)])
        item = np.concatenate([*(np.full(len(g), k) for k, g in enumerate(own)), np.empty(0, dtype=np.int64)]).astype(np.int64)
        at = np.concatenate([*(np.arange(len(g)) for g in own), np.empty(0, dtype=np.int64)]).astype(np.int64)
        self._set(grams, item, at, np.ones(len(grams), dtype=bool))

    def _set(self, grams: np.ndarray, item: np.ndarray, at: np.ndarray, rare: np.ndarray) -> None:
        order = np.lexsort((at, item, grams))
        self.grams, self.gram_item, self.gram_at, self.gram_rare = grams[order], item[order], at[order], rare[order]
        self.maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.maybe[(self.grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def keep_occurring(self, df: dict[int, int]) -> None:
        """Keep the runs that a document has, and mark the rarer half of each item's, ties by place."""
        n = np.array([df.get(g, 0) for g in self.grams.view(np.int64).tolist()], dtype=np.int64)
        order = np.lexsort((self.gram_at, n, self.gram_item))
        order = order[n[order] > 0]
        _, start, size = np.unique(self.gram_item[order], return_index=True, return_counts=True)
        rank = np.arange(len(order)) - np.repeat(start, size)
        self._set(self.grams[order], self.gram_item[order], self.gram_at[order], rank < np.repeat((size + 1) // 2, size))

    def hits(self, words: PlainWords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of runs that are among the grams and lie in one text, their texts, and their places in the sorted grams."""
        own = gram_hashes(words.h, SEED_WORDS)
        at = np.flatnonzero(self.maybe[(own >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return at[:0], at[:0], at[:0]
        k = np.searchsorted(self.grams, own[at])
        text = np.searchsorted(words.cuts, at, "right") - 1
        real = (k < len(self.grams)) & (self.grams[np.minimum(k, len(self.grams) - 1)] == own[at]) & (at + SEED_WORDS <= words.cuts[text + 1])
        return at[real], text[real], k[real]

    def _reaches(self, item: int, near: list[int], min_score: float) -> bool:
        """Whether an alignment of an item with these words can reach min_score: each word in common adds MATCH at most."""
        words = self.items[item][1].tolist()
        return sum(map(set(near).__contains__, words)) >= min_score * len(words)

    def matches(self, texts: pa.Array, min_score: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item id, score, first word, word after the last) of the best alignment of each text with each item that
        reaches min_score."""
        for words in plain_words(texts):
            starts, text, seeds = self.hits(words)
            for t, a, n in zip(*np.unique(text, return_index=True, return_counts=True), strict=True):
                c, d = words.cuts[t : t + 2]
                place = words.at[c:d] - words.all_cuts[t]
                for found in self._matches(words.h[c:d], place, starts[a : a + n] - c, seeds[a : a + n], min_score):
                    yield words.row + int(t), *found

    def _matches(self, h: np.ndarray, place: np.ndarray, starts: np.ndarray, seeds: np.ndarray, min_score: float) -> list[tuple[int, float, int, int]]:
        """(item id, score, first word, word after the last) in one text, from the places of its seeds."""
        plain = h.tolist()
        spans: dict[int, list[list[int]]] = {}
        for p, k in zip(starts.tolist(), seeds.tolist(), strict=True):
            gram = self.grams[k]
            while k < len(self.grams) and self.grams[k] == gram:
                item, q = int(self.gram_item[k]), int(self.gram_at[k])
                size = len(self.items[item][1])
                slack = size // 2 + SEED_WORDS
                a, b = max(0, p - q - slack), min(len(h), p - q + size + slack)
                own = spans.get(item, [])
                if self.gram_rare[k] or self._reaches(item, plain[a:b], min_score):
                    own = spans.setdefault(item, own)
                    if own and a <= own[-1][1] and a >= own[-1][0]:
                        own[-1][1] = max(own[-1][1], b)
                    else:
                        own.append([a, b])
                k += 1
        found = []
        for item, own in spans.items():
            item_id, words = self.items[item]
            best = max((*align(words, h[a:b]), a) for a, b in own)
            if best[0] >= min_score * MATCH * len(words):
                found.append((item_id, best[0] / (MATCH * len(words)), int(place[best[3] + best[1]]), int(place[best[3] + best[2] - 1]) + 1))
        return sorted(found)


def _blocks(benchmark: DataFrame, text_col: str, id_col: str) -> Iterator[Block]:
    """The test set in blocks of about BLOCK_BYTES; the driver holds one at a time."""
    own = benchmark.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    total = own.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    for k in range(n):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        items = [(r["item_id"], plain_hashes(r["text"])[0]) for r in rows]
        yield Block([x for x in items if len(x[1]) >= MIN_ITEM_WORDS])


def prepared(docs: DataFrame, benchmark: DataFrame, text_col: str, bench_text_col: str, bench_id_col: str) -> list[Broadcast[Block]]:
    """The blocks with the seeds that occur in docs; one scan of the texts for each block."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    out = []
    for block in _blocks(benchmark, bench_text_col, bench_id_col):
        sent = spark.sparkContext.broadcast(block)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(sent.value.grams), dtype=np.int64)
            for batch in batches:
                for words in plain_words(batch.column(0)):
                    _, text, seed = sent.value.hits(words)
                    np.add.at(n, np.unique(np.stack([text, seed]), axis=1)[1], 1)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.grams[at].view(np.int64)), pa.array(n[at])], names=["gram", "n"])

        counts = texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect() if len(block.grams) else []
        block.keep_occurring({r["gram"]: r["n"] for r in counts})
        out.append(spark.sparkContext.broadcast(block))
    return out


FOUND = "doc_id long, item_id long, score double, first_word long, end_word long"


def contaminations(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", bench_text_col: str = "text", bench_id_col: str = "item_id", min_score: float = MIN_SCORE) -> DataFrame:
    """A row for each document and test item found in it: score (1 for a whole copy) and its words in the document."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in prepared(docs, benchmark, text_col, bench_text_col, bench_id_col):

        def scan(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(batch.column(0)[row].as_py(), *m) for row, *m in block.value.matches(batch.column(1), min_score)]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "score", "first_word", "end_word"])

        found = own.mapInArrow(scan, FOUND)
        out = found if out is None else out.union(found)
    return out


def _clean(block: Broadcast[Block], min_score: float):
    """Whether a text has none of the block's items, as a function of columns."""

    @F.arrow_udf(T.BooleanType())
    def clean(texts: pa.Array) -> pa.Array:
        kept = np.ones(len(texts), dtype=bool)
        kept[[row for row, *_ in block.value.matches(texts, min_score)]] = False
        return pa.array(kept)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """docs without the rows in which a test item is found; the columns of docs, no shuffle. Rows that one block leaves
    are written before the next block, so that a task never holds two."""
    blocks = prepared(docs, benchmark, text_col, "text", "item_id")
    for k, block in enumerate(blocks):

        docs = docs.where(_clean(block, min_score)(F.col(text_col).cast("string")))
        if k + 1 < len(blocks):
            docs = written(docs, "clean-of-block")
    return docs


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminations(docs, benchmark)
