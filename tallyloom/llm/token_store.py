"""Token-ID files with bit-plane shuffling.

Documents are dealt by ranges of their id and sorted, so that each task holds one shard of consecutive documents. A
task tokenizes its documents, gathers their ids in chunks of whole documents, cuts each chunk into fixed-size blocks
of unsigned 32-bit ids, transposes every block into byte (or bit) planes and compresses each plane with zstandard.
High planes are nearly constant and low planes are dense, so each compresses better alone than interleaved.

The container is a Parquet table, one row a chunk, written by Spark's committer: a lost executor leaves no torn file,
and any store that Spark writes will do. Its small columns are the chunk index (documents, lengths, place in the shard,
sizes of planes); a reader of the index never touches the planes, and each chunk can be read without another.

Defined results: a null text counts as an empty one and gets the end id alone; null ids come first, dealt by
their texts; rows that share an id stay neighbours in one task, ordered by text; other columns are not read. A document is never cut: one longer than a chunk
makes a longer chunk.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import string
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.shared import ship, vocabulary, vocabulary_path, worker_cache
from tallyloom.session import scratch_path

END_ID = 1
END = END_ID.to_bytes(4, "little")
#: Ids of a block that is transposed as a whole, and ids after which a chunk is closed.
BLOCK_IDS = 8_192
CHUNK_IDS = 1 << 20
MEMO_ENTRIES = 800_000

CHUNKS = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("chunk", T.IntegerType()),
        T.StructField("shard_start", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("plane_kind", T.StringType()),
        T.StructField("plane_bytes", T.ArrayType(T.LongType())),
        T.StructField("planes", T.ArrayType(T.BinaryType())),
    ]
)
CHUNKS_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("chunk", pa.int32()),
        ("shard_start", pa.int64()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("plane_kind", pa.string()),
        ("plane_bytes", pa.list_(pa.int64())),
        ("planes", pa.list_(pa.binary())),
    ]
)


def to_planes(ids: np.ndarray, kind: str = "byte", block: int = BLOCK_IDS) -> list[bytes]:
    """The compressed planes of ids: 4 byte planes or 32 bit planes, each over all blocks; the last block is padded with 0."""
    padded = np.zeros(-(-len(ids) // block) * block, dtype="<u4")
    padded[: len(ids)] = ids
    raw = padded.view(np.uint8).reshape(-1, block, 4)
    if kind == "byte":
        planes = raw.transpose(2, 0, 1)
    else:
        planes = np.packbits(np.unpackbits(raw, axis=2, bitorder="little").transpose(2, 0, 1), axis=2, bitorder="little")
    pack = zstandard.ZstdCompressor(level=3)
    return [pack.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n_ids: int, kind: str = "byte", block: int = BLOCK_IDS) -> np.ndarray:
    """The ids that to_planes() has packed."""
    blocks = -(-n_ids // block)
    unpack = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(unpack.decompress(p), dtype=np.uint8) for p in planes]
    if kind == "byte":
        raw = np.stack([r.reshape(blocks, block) for r in rows], axis=2)
    else:
        bits = np.stack([np.unpackbits(r.reshape(blocks, block // 8), axis=1, bitorder="little") for r in rows], axis=2)
        raw = np.packbits(bits, axis=2, bitorder="little")
    return np.ascontiguousarray(raw).reshape(-1).view("<u4")[:n_ids]


PUNCTUATION = string.punctuation.encode()
#: Words of Latin letters that lower case and composition leave in as many letters.
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017e]+").fullmatch


def _byte_letters() -> list[str]:
    """The character for each byte under byte-level BPE: itself where it is printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + other.index(b)) for b in range(256)]


BYTE_LETTERS = "".join(_byte_letters())
#: First bytes in UTF-8 of the combining marks that may join an ASCII letter, not in one case alike.
MARKS = (b"\xcc", b"\xcd")


def _ends_in_letter(core: bytes) -> bool:
    """Whether the tokenizer surely breaks between core and ASCII punctuation: after an ASCII or Latin letter or a digit."""
    if core[-1:].isalnum():
        return True
    last = core[-4:].decode("utf-8", "ignore")[-1:]
    return last.isalnum() and (last.isascii() or "\u00c0" <= last <= "\u024f")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _WordIds(dict):
    """Ids of words between ASCII white space, as bytes. The tokenizer turns white space into breaks, so that a text's ids
    are those of its words in turn. Case and trailing punctuation are resolved before the tokenizer is asked, since it
    lowers case and breaks there itself, and words differ in them far more than in their letters."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(raw.decode("utf-8"))
        self.merge = self.tokenizer.model.tokenize

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        if word.isalpha() and word.islower():  # ASCII letters, which are their own byte letters
            ids = _packed([t.id for t in self.merge(word.decode())])
        elif b"<|" in word:  # may hold a special token, which is told apart before anything else
            ids = self._whole(word)
        elif word.isascii() and (low := word.lower()) != word:
            ids = self[low]
        elif (core := word.rstrip(PUNCTUATION)) and len(core) < len(word) and _ends_in_letter(core):
            ids = self[core] + self[word[len(core) :]]
        elif LATIN(text := word.decode("utf-8")):
            ids = self._letters(text)
        else:
            ids = self._whole(word)
        if len(word) <= 256:
            self[word] = ids
        return ids

    def _letters(self, word: str) -> bytes:
        """Ids of Latin letters in their composed form: one pre-token, so its lower-case bytes go to the merges at once."""
        return _packed([t.id for t in self.merge(codecs.charmap_decode(word.lower().encode("utf-8"), "strict", BYTE_LETTERS)[0])])

    def _whole(self, word: bytes) -> bytes:
        return _packed(self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids)

    def text(self, text: str) -> np.ndarray:
        """The ids of a text and the end id. ASCII letters are lowered at once, but for special tokens and for marks: J and
        a caron stay two characters, where j and a caron become one."""
        raw = text.encode("utf-8")
        if b"<|" not in raw and not any(m in raw for m in MARKS):
            raw = raw.lower()
        return np.frombuffer(b"".join([*map(self.__getitem__, raw.split()), END]), dtype="<u4")


#: The rules of a tokenizer file under which a text's ids are those of its words.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def by_words(raw: bytes) -> bool:
    """Whether a tokenizer file lowers case, turns white space into breaks and merges byte letters, as _WordIds takes for granted."""
    rules = json.loads(raw)
    split = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    cut = [p["pattern"].get("Regex") for p in split if p["type"] == "Split"] == [PIECES] and [p["type"] for p in split] == ["Split", "ByteLevel"]
    return cut and (rules.get("normalizer") or {}).get("normalizers") == NORMALIZER and rules["model"]["type"] == "BPE"


def _encoder(raw: bytes):
    if not worker_cache(("by_words", len(raw), hash(raw)), lambda: by_words(raw)):
        from tokenizers import Tokenizer

        whole = worker_cache(("tokenizer", len(raw), hash(raw)), lambda: Tokenizer.from_str(raw.decode("utf-8")), large=True)
        return lambda text: np.array([*whole.encode(text, add_special_tokens=False).ids, END_ID], dtype="<u4")
    return worker_cache(("word_ids", len(raw), hash(raw)), lambda: _WordIds(raw), large=True).text


def write_tokens(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", kind: str = "byte", vocabulary_file: str | None = None) -> None:
    """Write the ids of docs, each ended by END_ID, as chunks under `path`/chunks and their index under `path`/index.

    One shuffle, of id and text, by ranges of the id; the number of shards follows from the session's partitioning.
    """
    spark = docs.sparkSession
    ship(spark)
    words = vocabulary(spark, vocabulary_file or vocabulary_path("word_bpe_49k.json"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(words.value)
        shard, chunk, start = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def closed() -> pa.RecordBatch:
            planes = to_planes(np.concatenate(parts), kind)
            row = [shard, chunk, start, held, doc_ids, [len(p) for p in parts], kind, [len(p) for p in planes], planes]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, CHUNKS_ARROW, strict=True)], schema=CHUNKS_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                doc_ids.append(doc_id.as_py())
                parts.append(ids)
                held += len(ids)
                if held >= CHUNK_IDS:
                    yield closed()
                    chunk, start = chunk + 1, start + held
                    doc_ids, parts, held = [], [], 0
        if parts:
            yield closed()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Shards are numbered in the order of the union; the ranges are found without reading a text.
    nameless = own.where("doc_id is null").repartition("text").sortWithinPartitions("text")
    dealt = nameless.union(own.where("doc_id is not null").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    dealt.mapInArrow(pack, CHUNKS).write.option("compression", "none").parquet(f"{path}/chunks")
    index = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").drop("planes")
    index.write.parquet(f"{path}/index")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard and the number of ids in all shards before it; as many rows as shards."""
    totals = spark.read.parquet(f"{path}/index").groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


READ = "shard int, doc_id long, at long, n_tokens long, ids array<long>, ids_crc32 long"


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (where asked for) and ids_crc32 of every document, decoded from the chunks.

    With doc_ids only the chunks that hold one of them, by the index, are read and decoded."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, at, n_ids, doc_ids, lengths, kind, planes = (batch.column(c)[row].as_py() for c in ("shard", "shard_start", "n_ids", "doc_ids", "lengths", "plane_kind", "planes"))
                ids = from_planes(planes, n_ids, kind)
                cuts = np.cumsum([0, *lengths])
                pieces = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                columns = [
                    pa.array([shard] * len(pieces), pa.int32()),
                    pa.array(doc_ids, pa.int64()),
                    pa.array(at + cuts[:-1], pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([p.astype(np.int64) for p in pieces] if with_ids else [None] * len(pieces), pa.list_(pa.int64())),
                    pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "at", "n_tokens", "ids", "ids_crc32"])

    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    if doc_ids is not None:
        asked = F.array(*map(F.lit, doc_ids)).cast("array<long>")
        held = spark.read.parquet(f"{path}/index").where(F.arrays_overlap("doc_ids", asked)).select("shard", "chunk").collect()
        here = [(F.col("shard") == r["shard"]) & (F.col("chunk") == r["chunk"]) for r in held]
        chunks = chunks.where(reduce(Column.__or__, here, F.lit(False)))
    chunks = chunks.drop("chunk", "plane_bytes")
    out = chunks.mapInArrow(unpack, READ).join(shard_starts(spark, path), "shard")
    if doc_ids is not None:
        out = out.where(F.col("doc_id").isin(doc_ids))
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", *["ids"] * with_ids, "ids_crc32")


def query(docs: DataFrame) -> DataFrame:
    """The columns of op4: docs are written to the shared folder and read back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path)
    return read_tokens(spark, path, with_ids=False)
