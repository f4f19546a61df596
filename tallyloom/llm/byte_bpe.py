"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash and displace) resolves a pre-token that is itself a
vocabulary entry with one hash, one displacement and one comparison. Tier two: every other pre-token is merged over
a linked list of its bytes, with a heap of adjacent pairs by (rank, position), in O(n log n). Resolved pre-tokens are
kept in a bounded memo of each Python worker.

Defined results: a null text counts as an empty one, which has no ids; null ids pass through; repeated rows each get
their own result; other columns are not read. Text of any length is held once in the memory of its task.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.shared import parse_ranks, ship, vocabulary, vocabulary_path, worker_cache

#: Resolved pre-tokens that a worker keeps; beyond this the memo starts again.
MEMO_ENTRIES = 600_000
#: Ids that are gathered before a batch of encoded documents goes out.
BATCH_IDS = 500_000


class PerfectHash:
    """A minimal perfect hash from the keys to range(len(keys)): one displacement for each bucket of four keys or so."""

    TRIES = 1 << 12
    SPREAD, MIX, WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = max(1, n), max(1, n // 4)
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        self.displacement = [0] * self.buckets
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            members[xxhash.xxh64_intdigest(key) % self.buckets].append(i)
        free = np.ones(self.n, dtype=bool)
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        alone, empty = [], self.n
        for b in order:
            if len(members[b]) < 2:
                alone.append(b)
                continue
            hashes = np.array([xxhash.xxh64_intdigest(keys[i], seed=1) for i in members[b]], dtype=np.uint64)
            tries = int(min(self.TRIES, max(16, 4 * (self.n / max(1, empty)) ** len(hashes))))
            for first in range(0, 1 << 26, tries):
                d = np.arange(first, first + tries, dtype=np.uint64)[:, None]
                x = hashes ^ (d * np.uint64(self.SPREAD))
                x = (x ^ (x >> np.uint64(32))) * np.uint64(self.MIX)
                slots = ((x ^ (x >> np.uint64(32))) % np.uint64(self.n)).astype(np.int64)
                fits = free[slots].all(axis=1)
                spread = np.sort(slots, axis=1)
                fits &= (spread[:, 1:] != spread[:, :-1]).all(axis=1)
                if fits.any():
                    k, empty = int(fits.argmax()), empty - len(hashes)
                    self.displacement[b] = first + k
                    for i, slot in zip(members[b], slots[k].tolist(), strict=True):
                        self._put(slot, keys[i], i, free)
                    break
            else:
                raise ValueError("no displacement found")
        left = iter(np.flatnonzero(free).tolist())
        for b in alone:
            if members[b]:
                slot = next(left)
                self.displacement[b] = -slot - 1
                self._put(slot, keys[members[b][0]], members[b][0], free)

    def _slot(self, key: bytes, d: int) -> int:
        x = xxhash.xxh64_intdigest(key, seed=1) ^ (d * self.SPREAD & self.WORD)
        x = (x ^ (x >> 32)) * self.MIX & self.WORD
        return (x ^ (x >> 32)) % self.n

    def _put(self, slot: int, key: bytes, value: int, free: np.ndarray) -> None:
        self.keys[slot], self.values[slot], free[slot] = key, value, False

    def get(self, key: bytes) -> int | None:
        """The index of key, or None where it isn't among the keys."""
        if not self.keys:
            return None
        d = self.displacement[xxhash.xxh64_intdigest(key) % self.buckets]
        if d < 0:
            slot = -d - 1
        else:
            slot = self._slot(key, d)
        return self.values[slot] if self.keys[slot] == key else None


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of piece: the adjacent pair of lowest rank, leftmost first, is joined until no pair has a rank."""
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    live = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not live[i] or (mid := after[i]) >= n or after[mid] != end:
            continue
        live[mid] = False
        after[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class _Memo(dict):
    """Pre-token to ids; a miss goes through both tiers."""

    def __init__(self, codec: ByteBPE):
        self.codec = codec

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        ids = self.codec.resolve(token.encode("utf-8"))
        if len(token) <= 256:
            self[token] = ids
        return ids


class _Counts(dict):
    """Pre-token to the number of its ids; a miss goes through both tiers."""

    def __init__(self, codec: ByteBPE):
        self.codec = codec

    def __missing__(self, token: str) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        n = len(self.codec.resolve(token.encode("utf-8")))
        if len(token) <= 256:
            self[token] = n
        return n


class ByteBPE:
    """A codec over the ranks of a .tiktoken file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        keys = list(ranks)
        self.order = [ranks[k] for k in keys]
        self.whole = PerfectHash(keys)
        self.bytes_of = [b""] * (max(self.order, default=-1) + 1)
        for key, rank in ranks.items():
            self.bytes_of[rank] = key
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.find = regex.compile(pattern).findall
        self.memo, self.counts = _Memo(self), _Counts(self)

    def resolve(self, raw: bytes) -> tuple[int, ...]:
        """The ids of one pre-token: one that is in the vocabulary whole, else those of its merged bytes."""
        found = self.whole.get(raw)
        return (self.order[found],) if found is not None else tuple(merge_bytes(raw, self.ranks))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.find(text))))

    def count(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.find(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def ids_text(self, ids: list[int]) -> str:
        return " ".join(map(self.text_of.__getitem__, ids))


def codec(raw: bytes) -> ByteBPE:
    """The codec of a rank file's bytes, built once in each Python worker."""
    import public_tokenizers

    return worker_cache(("byte_bpe", len(raw), hash(raw)), lambda: ByteBPE(parse_ranks(raw), public_tokenizers.PATTERN), large=True)


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
DECODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("decoded", T.BinaryType())])
DIGESTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
)


def _ready(docs: DataFrame, text_col: str, id_col: str, vocabulary_file: str | None):
    ship(docs.sparkSession)
    ranks = vocabulary(docs.sparkSession, vocabulary_file or vocabulary_path("byte_bpe_50k.tiktoken"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), ranks


def encode_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids of every row, in one pass without a shuffle."""
    own, ranks = _ready(docs, text_col, id_col, vocabulary_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(ranks.value)

        def packed(doc_ids: pa.Array, parts: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(p) for p in parts], dtype=np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate(parts)))
            return pa.RecordBatch.from_arrays([doc_ids, pa.array(sizes), ids], names=ENCODED.names)

        for batch in batches:
            first, held, parts = 0, 0, []
            for k, text in enumerate(batch.column(1)):
                parts.append(np.array(use.encode(text.as_py() or ""), dtype=np.int32))
                held += len(parts[-1])
                if held >= BATCH_IDS:
                    yield packed(batch.column(0).slice(first, len(parts)), parts)
                    first, held, parts = k + 1, 0, []
            if parts:
                yield packed(batch.column(0).slice(first), parts)

    return own.mapInArrow(run, ENCODED)


def decode_documents(encoded: DataFrame, vocabulary_file: str | None = None) -> DataFrame:
    """doc_id and the bytes that its ids stand for. Null ids decode to no bytes; an id outside the vocabulary is an error."""
    ship(encoded.sparkSession)
    ranks = vocabulary(encoded.sparkSession, vocabulary_file or vocabulary_path("byte_bpe_50k.tiktoken"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(ranks.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([use.decode(x.as_py() or []) for x in batch.column(1)], pa.binary())], names=DECODED.names)

    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED)


def round_trip(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary_file: str | None = None) -> DataFrame:
    """Digests of the ids and of the bytes decoded from them. Encoding and decoding run in the same task, so ids never leave it."""
    own, ranks = _ready(docs, text_col, id_col, vocabulary_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(ranks.value)
        for batch in batches:
            counts, first, second = [], [], []
            for one in batch.column(1):
                ids = use.encode(one.as_py() or "")
                counts.append(len(ids))
                first.append(hashlib.sha256(use.ids_text(ids).encode()).hexdigest())
                second.append(hashlib.sha256(use.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=DIGESTS.names)

    return own.mapInArrow(run, DIGESTS)
