"""Near duplicates, substring dedup, decontamination and the pipeline against brute force."""

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tallyloom.llm import decontaminate, minhash_dedup, substring_dedup
from tallyloom.llm.shingles import gram_hashes, sliding_min, word_hashes, words_of

KEY = lambda r: (r[0] is not None, r[0] or 0, *r[1:])


def test_hash_helpers():
    h = word_hashes([b"a", b"b", b"a", b"b", b"c", b"a", b"b"])
    for k in (1, 2, 3, 5, 7):
        g = gram_hashes(h, k)
        words = "ababcab"
        same = {(i, j) for i, j in combinations(range(len(g)), 2) if words[i : i + k] == words[j : j + k]}
        assert {(i, j) for i, j in combinations(range(len(g)), 2) if g[i] == g[j]} == same
    x = np.random.default_rng(0).integers(0, 100, 40)
    for w in (1, 2, 7, 35, 40, 41):
        assert sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(40 - w + 1)]


def brute_classes(rows, threshold=minhash_dedup.THRESHOLD):
    h = {i: word_hashes(words_of(t)) for i, t in rows}
    df = np.zeros(1 << minhash_dedup.DF_BITS, dtype=np.int64)
    for _, t in rows:
        own = minhash_dedup.shingle_hashes(word_hashes(words_of(t)))
        df[np.unique(own >> np.uint64(64 - minhash_dedup.DF_BITS)).astype(int)] += 1
    steps = minhash_dedup.idf_steps(df, sum(bool(words_of(t)) for _, t in rows))
    sets = {i: minhash_dedup.elements(x, steps) for i, x in h.items()}
    of = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if minhash_dedup.weighted_jaccard(sets[a], sets[b]) >= threshold:
            old, new = max(of[a], of[b]), min(of[a], of[b])
            of = {i: new if c == old else c for i, c in of.items()}
    return of


def test_near_duplicates(spark, documents):
    base = [(r.doc_id, r.text) for r in documents.orderBy("doc_id").limit(70).collect()]
    edited = []
    for k, (i, t) in enumerate(base[:25]):
        w = t.split()
        for j in range(0, len(w), max(1, len(w) // (k % 4 + 1))):
            w[j] = "changed"
        edited.append((1000 + i, " ".join(w)))
    group = [(2000 + k, base[30][1] + f" tail{k}") for k in range(40)]
    r = np.random.default_rng(8)
    words = [f"w{j}" for j in range(150)]
    around = [(4000 + k, " ".join(np.where(r.random(150) < (k % 7) / 90, f"own{k // 3}", words))) for k in range(90)]
    rows = base + edited + group + around + [(3000, ""), (3001, None), (3002, "two words"), (3003, "two  words")]
    got = {r.doc_id: r.class_id for r in minhash_dedup.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_samples_agree_as_similar_sets_do():
    sampler = minhash_dedup.Sampler()
    r = np.random.default_rng(5)
    steps = np.full(1 << minhash_dedup.DF_BITS, 9, dtype=np.uint8)
    shared = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    agree = []
    for _ in range(40):
        x = minhash_dedup.elements(np.concatenate([shared, r.integers(0, 1 << 63, 44, dtype=np.uint64)]), steps)
        y = minhash_dedup.elements(np.concatenate([shared, r.integers(0, 1 << 63, 44, dtype=np.uint64)]), steps)
        agree.append((sampler.bands(x) == sampler.bands(y)).mean())
    s = minhash_dedup.weighted_jaccard(x, y)
    assert abs(np.mean(agree) - s**minhash_dedup.ROWS) < 0.12


def test_near_duplicates_on_odd_rows(spark, odd):
    got = minhash_dedup.query(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r.class_id for r in got}
    assert by[900] == by[901] == by[902] and by[903] == by[904] and by[908] == 5
    kept = minhash_dedup.keep_one(odd)
    rows = kept.collect()
    assert kept.columns == odd.columns and len(rows) == len({r.class_id for r in got})
    assert minhash_dedup.query(odd.limit(0)).count() == 0


def test_large_buckets_without_a_band_left(spark):
    texts = {}
    for k in range(20):
        words = [f"w{k}x{j}" for j in range(60)]
        texts[k], texts[100 + k] = " ".join(words), " ".join([*words, f"end{k}"])
    own = spark.createDataFrame([(i, i, t) for i, t in texts.items()], "id long, text_key long, text string")
    signed = spark.createDataFrame([(i, i, i, [1] * minhash_dedup.BANDS) for i in texts], "node long, id long, text_key long, bands array<long>")
    steps = spark.sparkContext.broadcast(np.full(1 << minhash_dedup.DF_BITS, 9, dtype=np.uint8))
    links = minhash_dedup.similar_links(signed, own, steps, minhash_dedup.THRESHOLD).collect()
    assert {(r.a, r.b) for r in links} == {(k, 100 + k) for k in range(20)}


def test_prefixes_of_similar_sets_meet():
    r = np.random.default_rng(2)
    steps = r.integers(0, minhash_dedup.STEPS, 1 << minhash_dedup.DF_BITS).astype(np.uint8)
    for n in range(1, 60):
        words = r.integers(0, 1 << 63, n + 9, dtype=np.uint64)
        x, y = (minhash_dedup.elements(np.where(r.random(n + 9) < 0.01, r.integers(0, 1 << 63, n + 9, dtype=np.uint64), words), steps) for _ in range(2))
        s = minhash_dedup.weighted_jaccard(x, y)
        (a, left), (b, over) = minhash_dedup.prefix(x, s), minhash_dedup.prefix(y, s)
        both, i, j = np.intersect1d(a, b, return_indices=True)
        least = minhash_dedup.common_weight(minhash_dedup.weight(x).sum(), minhash_dedup.weight(y).sum(), s)
        assert s == 0 or (np.minimum(left[i], over[j]) >= least).any(), n


def test_ids_of_several_texts(spark, documents):
    a, b, c = (r.text for r in documents.orderBy("doc_id").limit(3).collect())
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, c), (4, c), (5, c + " end"), (6, "alone")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, class_id int")
    got = [(r.doc_id, r.class_id) for r in minhash_dedup.query(docs).collect()]
    assert sorted(got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (6, 6)]
    kept = [minhash_dedup.keep_one(docs.repartition(n)).collect() for n in (1, 4)]
    assert sorted(kept[0]) == sorted(kept[1]) and sorted(r.doc_id for r in kept[0]) == [1, 4, 6]


def test_weights_tell_common_shingles_at_any_size():
    for n_docs, noise in ((1_000, 0), (10**6, 5_000), (10**10, 76_000_000)):
        df = np.random.default_rng(1).poisson(noise, 1 << minhash_dedup.DF_BITS)
        df[:50] += n_docs // 10
        steps = minhash_dedup.idf_steps(df, n_docs)
        assert steps[:50].max() <= 5 and np.median(steps[50:]) >= 8


def test_substrings(spark, documents, odd):
    base = [(r.doc_id, r.text) for r in documents.orderBy("doc_id").limit(50).collect()]
    passage = " ".join(base[7][1].split()[:80])
    rows = base + [(1000 + i, f"new{i} words {passage} then {base[i][1]}") for i in range(12)] + [(2000, None), (None, base[3][1]), (2001, base[4][1]), (2001, base[5][1] + " more")]
    for frame in (spark.createDataFrame(rows, "doc_id long, text string"), odd):
        out = substring_dedup.query(frame)
        got = sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=KEY)
        assert got == sorted(substring_dedup.brute_force([(r.doc_id, r.text) for r in frame.collect()]), key=KEY)
    assert substring_dedup.query(odd.limit(0)).count() == 0


def test_substrings_equal_sql(spark, documents):
    import duckdb

    from tallyloom.llm.queries import OP10_SQL

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(con.execute(OP10_SQL).fetchall()) == sorted(tuple(r) for r in substring_dedup.query(documents).collect())


def test_factors_are_substrings_of_their_references(spark, documents):
    words = lambda a, b: [f"w{k}" for k in range(a, b)]
    long = documents.where("length(text) > 3000").orderBy("doc_id").first().text.split()
    rows = {
        1: [*words(0, 50), "gap", *words(1, 51)],
        2: words(0, 51),
        3: long[:400],
        4: ["new", *long[100:300], "gap", *long[250:330], *words(0, 50)],
        5: [*long[120:180], *long[200:249], "end"],
        6: words(0, 51),
    }
    out = substring_dedup.dedup_substrings(spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")).collect()
    factors = {r.doc_id: [tuple(f) for f in r.factors] for r in out}
    assert factors[1] == factors[3] == [] and factors[2] == [(0, 50, 1, 0), (1, 50, 1, 51)] and factors[6] == [(0, 51, 2, 0)]
    assert factors[4] == [(1, 200, 3, 100), (202, 80, 3, 250), (282, 50, 1, 0)] and factors[5] == [(0, 60, 3, 120)]
    for i, own in factors.items():
        for start, length, ref, at in own:
            assert length >= 50 and ref < i and rows[i][start : start + length] == rows[ref][at : at + length]
    plain = {i: (n, gone) for i, n, gone, _ in substring_dedup.brute_force([(i, " ".join(w)) for i, w in rows.items()])}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in out} == plain


def test_alignment():
    w = lambda s: word_hashes([x.encode() for x in s.split()])
    item = w("a b c d e f g h")
    assert decontaminate.align(item, w("x x a b c d e f g h y")) == (16.0, 2, 10)
    assert decontaminate.align(item, w("a b c z d e f g h")) == (15.0, 0, 9)
    assert decontaminate.align(item, w("q r s")) == (0.0, 0, 0)


def test_leaks(spark, documents, benchmark):
    items = [(r.item_id, r.text) for r in benchmark.orderBy("item_id").limit(12).collect()]
    texts = [r.text for r in documents.where("lang = 'de'").orderBy("doc_id").limit(12).collect()]
    rows, want = [], set()
    for k, (i, t) in enumerate(items):
        w = t.split()
        if k % 3 == 1:
            w = [x if j % 7 else "other" for j, x in enumerate(w)]  # edited
        if k % 3 == 2:
            w = [x.upper() + "!!" for j, x in enumerate(w) if j % 9]  # shouted, words lost
        rows.append((k, texts[k % len(texts)] + "\n" + " ".join(w) + "\n" + texts[0]))
        want.add((k, i))
    rows += [(100 + k, t.replace("\n", " ")) for k, t in enumerate(texts[:5])] + [(200, None), (None, items[0][1]), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as item_id")
    bench = spark.createDataFrame([*items, items[0], (77, None), (78, "too short")], "item_id long, text string")
    clean = {r.doc_id for r in docs.collect() if r.doc_id is not None and r.doc_id >= 100}
    found = decontaminate.query(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.doc_id is not None and r.doc_id < 100} >= want
    assert not clean & {r.doc_id for r in found} and any(r.doc_id is None for r in found)
    left = decontaminate.drop_contaminated(docs, bench)
    assert {r.doc_id for r in left.collect()} == clean and left.columns == docs.columns
    assert decontaminate.query(docs, bench.limit(0)).count() == 0 and decontaminate.query(docs.limit(0), bench).count() == 0


def test_leaks_against_every_alignment(spark, benchmark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 4 = 0 or n_chars < 900")
    items = [(r.item_id, decontaminate.plain_hashes(r.text)[0]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    want = set()
    for r in documents.collect():
        h = decontaminate.plain_hashes(r.text)[0]
        have = set(h.tolist())
        for i, words in items:
            if len(words) >= decontaminate.MIN_ITEM_WORDS and sum(w in have for w in words.tolist()) >= 0.5 * len(words):
                if decontaminate.align(words, h)[0] >= decontaminate.MIN_SCORE * decontaminate.MATCH * len(words):
                    want.add((r.doc_id, i))
    found = {(r.doc_id, r.item_id) for r in decontaminate.query(documents, spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")).collect()}
    assert want and found == want


def test_plain_words_of_a_batch(documents, monkeypatch):
    odd = [None, "", " \n", "...", "Don't STOP dont", "a" * 64 + " " + "A" * 65 + " " + "a" * 65, "\u201cWord\u201d word", "Stra\u00dfe \u0130 \u03a3\u03a3 x\u0301", "-" * 3000 + "end END", "tail", "head\x0bx\x0c\r\ny", "\u4f60\u597d" * 900]
    texts = [*odd, *(r.text for r in documents.limit(40).collect()), *odd]
    plain = [["".join(c for c in w.decode().lower() if c.isalnum()) for w in words_of(t)] for t in texts]
    want = [(k, i, w) for k, words in enumerate(plain) for i, w in enumerate(words) if w]
    names: dict[int, str] = {}
    for group, piece in ((4 << 20, 1 << 17), (5000, 1024), (1, 2000)):
        monkeypatch.setattr(decontaminate, "GROUP_BYTES", group)
        monkeypatch.setattr(decontaminate, "PIECE_BYTES", piece)
        got = []
        for x in decontaminate.plain_words(pa.array(["cut off", *texts])[1:]):
            for j, (a, b) in enumerate(zip(x.cuts[:-1], x.cuts[1:], strict=True)):
                got += [(x.row + j, int(p - x.all_cuts[j]), int(h)) for p, h in zip(x.at[a:b], x.h[a:b], strict=True)]
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(names.setdefault(h, w) == w for (_, _, h), (_, _, w) in zip(got, want, strict=True))
    assert len(names) == len({w for _, _, w in want})
    assert not list(decontaminate.plain_words(pa.array([], pa.string())))


def test_ascii_words_are_hashed_without_a_loop(monkeypatch):
    def refused(memo, word):
        raise AssertionError(word)

    monkeypatch.setattr(decontaminate._PlainHashes, "__missing__", refused)
    h, place = decontaminate.plain_hashes("Loopless-word 42, ... LOOPLESSWORD!")
    assert place.tolist() == [0, 1, 3] and h[0] == h[2] != h[1]


def test_blocks_of_the_test_set(spark, documents, benchmark, monkeypatch):
    whole = sorted(map(tuple, decontaminate.query(documents, benchmark).collect()))
    left = {r.doc_id for r in decontaminate.drop_contaminated(documents, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2_000)
    assert sorted(map(tuple, decontaminate.query(documents, benchmark).collect())) == whole
    assert {r.doc_id for r in decontaminate.drop_contaminated(documents, benchmark).collect()} == left


def test_edited_leaks(spark):
    item = [f"w{j}" for j in range(20)]
    copies = {n: [f"new{n}" if j % n == n - 1 else x for j, x in enumerate(item)] for n in (4, 5, 6)}
    pad = [f"pad{j}" for j in range(60)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    frame = lambda rows: spark.createDataFrame([(i, " ".join(pad + w + pad)) for i, w in rows], "doc_id long, text string")
    for n, copy in copies.items():
        assert [(r.doc_id, r.item_id) for r in decontaminate.query(frame([(n, copy), (99, [])]), bench).collect()] == [(n, 1)]
    # whole copies elsewhere make the surviving runs the commoner ones; a phrase alone is no leak
    rows = [*copies.items(), (0, item), *((100 + k, item[:3]) for k in range(8))]
    assert {r.doc_id for r in decontaminate.query(frame(rows), bench).collect()} == {0, 4, 5, 6}
    assert {r.doc_id for r in decontaminate.drop_contaminated(frame(rows), bench).collect()} == {100 + k for k in range(8)}


def test_pipeline(spark, documents, odd):
    docs, counts = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.columns == documents.columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[2] == counts[3] > 0.6 * documents.count()
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert Counter(r.doc_id for r in ids.collect()) == Counter(r.doc_id for r in docs.collect())
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()} == {r.doc_id: r.n_tokens for r in ids.collect()}
    few = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        few = stage(spark, few, "/root/testdata/sf0.001")
    assert few.count() > 0
