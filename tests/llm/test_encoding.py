"""Secret scans, token stores, byte-level BPE and rollups against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import byte_bpe, secret_scan, token_rollup, token_store
from tallyloom.llm.shared import parse_ranks, vocabulary_path

RAW = open(vocabulary_path("byte_bpe_50k.tiktoken"), "rb").read()
WORDS = open(vocabulary_path("word_bpe_49k.json"), "rb").read()
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parse_ranks(RAW), special_tokens={})
TOKENIZER = Tokenizer.from_str(WORDS.decode())


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = byte_bpe.PerfectHash(keys)
    assert [h.get(k) for k in keys] == list(range(3000)) and None not in h.keys and h.get(b"other") is None
    assert byte_bpe.PerfectHash([]).get(b"a") is None and byte_bpe.PerfectHash([b"a"]).get(b"a") == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_byte_bpe_equals_library(text):
    own = byte_bpe.codec(RAW)
    ids = own.encode(text)
    assert ids == LIBRARY.encode_ordinary(text) and own.decode(ids) == text.encode() and own.count(text) == len(ids)


def test_byte_bpe_on_long_runs():
    own = byte_bpe.codec(RAW)
    for text in ("ab" * 20_000, "é" * 5_000, " " * 3_000 + "x", "a" * 10_000):
        assert own.encode(text) == LIBRARY.encode_ordinary(text)


def test_encode_and_decode(spark, odd):
    encoded = byte_bpe.encode_documents(odd)
    got = Counter((r.doc_id, tuple(r.ids), r.n_tokens) for r in encoded.collect())
    assert got == Counter((i, tuple(ids := LIBRARY.encode_ordinary(t)), len(ids)) for i, t in texts_of(odd))
    assert Counter((r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode_documents(encoded).collect()) == Counter((i, t.encode()) for i, t in texts_of(odd))
    assert byte_bpe.round_trip(odd.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_ids_equal_library(text):
    assert token_store._encoder(WORDS)(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("text", ["<|endoftext|>a b<|startoftext|>", "THE, The the'S don't!!", "a\x85b\x1cc İÉ ß.", "é ́x"])
def test_word_ids_on_odd_texts(text):
    assert token_store._encoder(WORDS)(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("text", ["J\u030c j\u030c W\u030a H\u0331A\u0301", "\u212aA \u03a3A A\u03a3 \u00c9T\u00c9", "A<|ENDOFTEXT|>B", "STRA\u00dfE, \u0130I. \u1e9eX!", "A\u1dc4 E\u20d7 N\u0f73"])
def test_word_ids_of_texts_in_capitals(text):
    assert token_store._encoder(WORDS)(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids + [1]


def test_memo_of_words_knows_one_case():
    words = token_store._WordIds(WORDS)
    assert words.text("Loose, LOOSE loose, l\u00d6se L\u00d6se").tolist() == TOKENIZER.encode("loose, loose loose, l\u00f6se l\u00f6se", add_special_tokens=False).ids + [1]
    assert set(words) == {w.encode() for w in ("loose,", "loose", ",", "l\u00d6se")}


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 8192, 8193, 30_000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert (token_store.from_planes(token_store.to_planes(ids, kind), n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_store(spark, odd, tmp_path, kind, monkeypatch):
    path = f"file://{tmp_path}/{kind}"
    token_store.write_tokens(odd, path, kind=kind)
    rows = sorted(token_store.read_tokens(spark, path).collect(), key=lambda r: r.start)
    want = Counter((i, tuple(TOKENIZER.encode(t, add_special_tokens=False).ids + [1])) for i, t in texts_of(odd))
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += len(r.ids)
    few = token_store.read_tokens(spark, path, doc_ids=[903, 5, 77777]).collect()
    assert sorted(map(tuple, few)) == sorted(tuple(r) for r in rows if r.doc_id in (903, 5))


def test_token_store_query(spark, odd, documents):
    for frame in (documents, odd.limit(0)):
        rows = {r.doc_id: r for r in token_store.query(frame).collect()}
        at = 0
        for i, t in sorted(texts_of(frame)):
            ids = TOKENIZER.encode(t, add_special_tokens=False).ids + [1]
            assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
        assert len(rows) == frame.count()


def test_other_tokenizer_files_encode_whole_texts():
    other = open(vocabulary_path("byte_bpe_50k.json"), "rb").read()
    assert token_store.by_words(WORDS) and not token_store.by_words(other)
    text = "Two  words\n and a Third"
    assert token_store._encoder(other)(text).tolist() == Tokenizer.from_str(other.decode()).encode(text, add_special_tokens=False).ids + [1]


def test_round_trip_digests(spark, odd):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((i, len(ids := LIBRARY.encode_ordinary(t)), sha(" ".join(map(str, ids)).encode()), sha(t.encode())) for i, t in texts_of(odd))
    assert Counter(tuple(r) for r in byte_bpe.round_trip(odd).collect()) == want


# The patterns as the contract states them, and the least lengths.
PLAIN = ((r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), (r"AKIA[A-Z0-9]+", 20), (r"[0-9a-f]+", 24))


def test_secret_spans(spark, odd):
    rows = secret_scan.secret_spans(odd).collect()
    assert len(rows) == odd.count()
    assert Counter((r.doc_id, r.base_spans) for r in rows) == Counter((i, secret_scan.brute_spans(t)) for i, t in texts_of(odd))
    mine = next(r for r in rows if r.doc_id == 907)
    assert (mine.n_assign, mine.n_access, mine.n_hex, mine.n_random) == (1, 1, 1, 1)
    found = secret_scan.query(odd)
    assert found.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"] and secret_scan.query(odd.limit(0)).count() == 0
    for r, t in ((r, t) for r in found.collect() for i, t in texts_of(odd) if i == r.doc_id is not None and [x for x, _ in texts_of(odd)].count(i) == 1):
        spans = [(m.start(), k, m.end()) for k, (p, n) in enumerate(PLAIN) for m in re.finditer(p, t) if len(m[m.lastindex or 0]) >= n]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r.base_sha256 == secret_scan.sha256(base)
    query = {(r.doc_id, r.base_sha256) for r in found.collect()}
    assert query == {(i, secret_scan.sha256(secret_scan.brute_spans(t))) for i, t in texts_of(odd)}


def test_redaction_leaves_other_rows(spark, odd):
    before, after = odd.orderBy("doc_id", "text").collect(), secret_scan.redact_secrets(odd).collect()
    assert after[0].__fields__ == before[0].__fields__ and len(after) == len(before)
    text = next(r.text for r in after if r.doc_id == 907)
    assert text == '[assign]" [access] [random] 123e4567-e89b-12d3-a456-426614174000'
    assert Counter(r.text for r in after if r.doc_id != 907) == Counter(r.text for r in before if r.doc_id != 907)


def test_random_parts_of_runs():
    from pathlib import Path

    count = secret_scan._token_counter(Path(secret_scan.vocabulary_path("byte_bpe_50k.tiktoken")).read_bytes())
    spans = lambda t: [(a, b) for a, b, kind in secret_scan.find_spans(t, count, 2.0) if kind == "random"]
    key, low = "q8Zr3Lx9Vt2Kw7Yp4Nd6Hb1J", "xqzkvjwpghtrmnbdflcsqxzv"
    for before in ("", "/production/backups/customers/reports/", "https-callback-authorization-session-", "/production/backups/customers/reports/archive/monthly/europe/"):
        for secret in (key, low, low.upper(), key[:12] + "_" + key[12:]):
            assert [b for a, b in spans(before + secret) if a <= len(before)] == [len(before) + len(secret)], (before, secret)
    assert spans("/production/backups/customers/reports/" + low) == [(38, 62)]
    for text in ("/users/123e4567-e89b-12d3-a456-426614174000/profile/settings", "xxhash-zstd-lz-snappy-brotli", "Donaudampfschifffahrtsgesellschaft", "abcdefghijklmnopqrstuvwxyz", "/assets/images/2024/01/15/header-background-large"):
        assert spans(text) == [], text


def test_known_forms_are_no_secrets():
    n = lambda s: len(LIBRARY.encode_ordinary(s))
    for run in ("d41d8cd98f00b204e9800998ecf8427e", "D41D8CD98F00B204E9800998ECF8427E", "123e4567-e89b-12d3-a456-426614174000", "sha256-47DEQpj8HBSaTImW5JCeuQeRkm5NMpJWZG3hSuFU", "get_user_name_from_request_context_v2", "2024-01-01-2024-12-31-0001"):
        assert not [s for s in secret_scan.find_spans(run, n, 2.0) if s[2] == "random"], run


def test_rollup_store(spark, tmp_path):
    store = token_rollup.RollupStore(spark, f"file://{tmp_path}/r")
    schema = "doc_id long, source string, lang string, tokenizer string, op string, n_tokens long, seq int"
    change = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert store.totals().count() == 0
    first = change((1, "a", "en", "t1", "insert", 10, 0), (2, "a", "en", "t1", "insert", 5, 0), (3, None, "de", "t1", "insert", 7, 0), (None, "a", "en", "t1", "insert", 9, 0), (1, "a", "en", "t2", "insert", 4, 0))
    assert store.apply(1, first) and not store.apply(1, first)
    totals = lambda: {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}
    assert totals() == {("a", "en", "t1"): (2, 15), (None, "de", "t1"): (1, 7), ("a", "en", "t2"): (1, 4)}
    second = change((1, "a", "en", "t1", "revise", 12, 0), (1, "a", "en", "t1", "revise", 11, 1), (2, "a", "en", "t1", "delete", 0, 0), (3, "b", "de", "t1", "revise", 7, 0), (9, "a", "en", "t1", "delete", 3, 0), (8, "a", "en", "t1", "revise", 2, 0))
    assert store.apply(2, second) and not store.apply(2, second)
    assert totals() == {("a", "en", "t1"): (2, 13), ("b", "de", "t1"): (1, 7), ("a", "en", "t2"): (1, 4)}
    assert store.apply(3, change((2, "a", "en", "t1", "insert", 6, 0), (1, "a", "en", "t1", "insert", 1, 0)))
    assert totals()["a", "en", "t1"] == (3, 9) and store.committed() == [1, 2, 3]
    assert {(r.doc_id, r.n_tokens) for r in store.documents().where("tokenizer = 't1'").collect()} == {(1, 1), (2, 6), (3, 7), (8, 2)}
    # a batch that broke off before its totals counts for nothing and is written anew
    spark.createDataFrame([(5, "t1", "a", "en", 1, 99)], token_rollup.LEDGER).withColumn("part", token_rollup._part()).write.partitionBy("part").parquet(f"file://{tmp_path}/r/ledger/batch=4")
    assert totals()["a", "en", "t1"] == (3, 9)
    assert store.apply(4, change((5, "a", "en", "t1", "insert", 1, 0))) and totals()["a", "en", "t1"] == (4, 10)
    # rejected changes are counted, and a base stands for the batches that it holds
    assert {(r.source, r.n_rejected) for r in store.totals().where("n_rejected > 0").collect()} == {("a", 1)}
    before, documents = totals(), sorted(map(tuple, store.documents().collect()))
    assert store.compact() == 1 and totals() == before and sorted(map(tuple, store.documents().collect())) == documents
    assert not store.apply(3, change((1, "a", "en", "t1", "insert", 50, 0))) and store.committed() == [1, 2, 3, 4]
    assert store.apply(5, change((5, "a", "en", "t1", "delete", 0, 0), (1, "a", "en", "t1", "revise", 2, 0))) and totals()["a", "en", "t1"] == (3, 10)
    assert store.compact() == 2 and totals()["a", "en", "t1"] == (3, 10) and len(store._live("ledger")) == 1


def test_rollup_query(spark, documents, odd):
    n = lambda s: len(LIBRARY.encode_ordinary(s))
    for frame in (odd, documents):
        rows = [(r.doc_id, r.text, r.source, r.lang) for r in frame.collect()]
        got = {(r.state, r.source, r.lang): (r.n_docs, r.n_tokens, r.n_rejected) for r in token_rollup.query(frame).collect()}
        assert got == token_rollup.brute_force(rows, n)
    assert token_rollup.query(odd.limit(0)).count() == 0


def test_token_counts(spark, odd):
    got = Counter((r.doc_id, r.n_tokens) for r in token_rollup.count_tokens(odd, "v").collect())
    assert got == Counter((i, len(LIBRARY.encode_ordinary(t))) for i, t in texts_of(odd))
