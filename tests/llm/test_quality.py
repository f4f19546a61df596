"""Quality rules, the passage classifier and licence scans."""

import re
from collections import Counter
from pathlib import Path

import numpy as np

from tallyloom.llm import license_scan, quality_mil, quality_rules


def stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at: dict = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, odd, labels):
    rows = quality_rules.query(odd, labels).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((r.doc_id, *stats(r.text or "")) for r in odd.collect())
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and (not r.base_failed or not r.kept) for r in rows)


def test_rules_separate_and_columns_pass(spark, odd):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = quality_rules.fit(documents, labels)
    assert rules and quality_rules.fit(documents.union(documents), labels) == rules
    learned = quality_rules.fit(documents, labels.where("crc32(cast(doc_id as string)) % 3 <> 1"))
    left = [(r.kept, r.quality) for r in quality_rules.judge(documents, learned).selectExpr("row.doc_id", "kept").join(labels.where("crc32(cast(doc_id as string)) % 3 = 1"), "doc_id").collect()]
    assert len(left) > 100 and sum(k == (q == 1) for k, q in left) > 0.97 * len(left)
    kept = {r.doc_id for r in quality_rules.keep_good(documents, labels).collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    good = [i for i in marks if marks[i] == 1]
    assert sum(i in kept for i in good) >= 0.93 * len(good) and sum(i in kept for i in marks if marks[i] == 0) == 0
    assert quality_rules.keep_good(odd, labels).columns == odd.columns
    assert quality_rules.fit(documents, labels.limit(0)) == [] and quality_rules.query(documents.limit(0), labels).count() == 0


def test_learned_conjunction():
    r = np.random.default_rng(1)
    rows = []
    for k in range(900):
        s = {f: float(x) for f, x in zip(quality_rules.FEATURES, r.random(len(quality_rules.FEATURES)))}
        rows.append((s, 0 if s["upper_share"] > 0.6 and s["digit_share"] <= 0.4 else 1, k % 3 == 0))
    rules = quality_rules.learn_rules(rows)
    hit = lambda s: any(all((s[t.feature] > t.threshold) == t.above for t in rule) for rule in rules)
    assert sum(hit(s) == (y == 0) for s, y, _ in rows) > 0.95 * len(rows)
    assert quality_rules.learn_rules([]) == []


def test_gradients():
    r = np.random.default_rng(3)
    x, starts, y = r.random((9, quality_mil.SHAPES + quality_mil.STATS)), np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0])
    m = quality_mil.Model({k: v.astype(np.float64) for k, v in quality_mil.Model.fresh().p.items()})
    loss = lambda: -np.mean(np.log(np.where(y == 1, s := m.forward(x, starts)[0], 1 - s)))
    for name, g in m.gradients(x, starts, y).items():
        p = m.p[name].reshape(-1)
        for k in (0, len(p) // 2, len(p) - 1):
            old = p[k]
            p[k] = old + 1e-5
            up = loss()
            p[k] = old - 1e-5
            down = loss()
            p[k] = old
            assert abs((up - down) / 2e-5 - g.reshape(-1)[k]) < 1e-5


def test_classifier(spark, labels, odd):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r.doc_id: r for r in quality_mil.query(documents, labels).collect()}
    held = [r for r in labels.collect() if rows[r.doc_id].held_out]
    assert len(held) > 50 and np.mean([rows[r.doc_id].predicted == r.quality for r in held]) > 0.93
    model, prior = quality_mil.fit(documents, labels)
    out = quality_mil.score(odd, model, prior).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert quality_mil.fit(documents, labels.limit(0)) == (None, 0.5)
    assert quality_mil.score(odd.limit(0), model, prior).count() == 0
    alone = {r.doc_id: r.score for r in quality_mil.score(documents.repartition(3), model, prior).collect()}
    texts = {r.doc_id: r.text for r in documents.limit(40).collect()}
    assert all(abs(alone[i] - model.forward(quality_mil.passages(t), np.array([0]))[0][0]) < 1e-5 for i, t in texts.items())
    few = quality_mil.fit(documents.union(documents), labels, max_train_passages=150)[0]
    assert few is not None and any((few.p[k] != model.p[k]).any() for k in few.p)


def plain_licenses(rows):
    """(license, license_dir) by (id, path): every unit against every template of its kind, without a filter."""
    words = lambda t: re.findall("[a-z0-9]+", t)
    cut = lambda kind, t: words(t.lower())[:60] if kind == "head" else words(t.lower())
    bags = [(kind, name, Counter(cut(kind, t))) for kind, name, t in license_scan.TEMPLATES]
    share = [1 / 6 if t.startswith("SPDX") else 1 for *_, t in license_scan.TEMPLATES]
    n_of = {w: sum(x for x, (*_, bag) in zip(share, bags) if w in bag) for *_, own in bags for w in own}
    idf = lambda w: 1 if w in license_scan.FUNCTION and w in n_of else 1 + np.log(sum(share) / n_of.get(w, 1))
    vector = lambda bag: {w: (1 if w not in n_of else 1 + np.log(n)) * idf(w) for w, n in bag.items()}
    length = lambda v: np.sqrt(sum(x * x for x in v.values()))
    notice, declared = {}, {}
    for i, path, text in rows:
        low = (text or "").lower()
        units = [("whole", words(low)), ("head", words(low)[:60])]
        units += [("notice", words(u)) for u in {*low.split("\n"), *re.split(license_scan.BLANK, low), *re.split(rf"(?<=[.!?])[ \t\r\n]+|{license_scan.BLANK}", low)}]
        found = []
        for kind, own in units:
            v = vector(Counter(own))
            for at, (k, name, bag) in enumerate(bags):
                if k == kind and own:
                    t = vector(bag)
                    c = sum(x * t.get(w, 0) for w, x in v.items()) / length(v) / length(t)
                    if c >= 0.75:
                        found.append((kind != "notice", round(c, 2), -at, c, len(own), name))
        top = max(found, default=None)
        notice[i, path] = top and top[5]
        if top and path and "/" in path and (re.search(license_scan.FILE_NAME, path) or 2 * top[4] >= len(words(low))):
            d = path.rsplit("/", 1)[0]
            declared[d] = min(declared.get(d, (1, "")), (-round(top[3], 9), top[5]))
    out = {}
    for i, path, _ in rows:
        own, up = notice[i, path], path.rsplit("/", 1)[0] if path and "/" in path else None
        while own is None and up is not None and up not in declared:
            up = up.rsplit("/", 1)[0] if "/" in up else None
        out[i, path] = (own, None) if own or up is None else (declared[up][1], up)
    return out


def test_licenses(spark, odd):
    notice = license_scan.NOTICES[[n for n, _ in license_scan.NOTICES].index("MIT") + 1][1].replace(", ", ",\n")
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.\nand many more words here that make this file a long one of text"),
        (2, "a/b/c.py", "code"),
        (3, "a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        (4, "a/b/d/e/f.py", None),
        (5, None, "x"),
        (6, "top.py", ""),
        (7, "z/q.py", f"See\n\n{notice}\n\ncode " + "word " * 160),
        (8, "z/r.py", "code"),
        (9, "y/only.txt", "Licensed under the Apache License, Version 2.0."),
        (10, "y/k/x.py", "the license of this text is unknown to all of us here"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    files = files.union(files.limit(3))
    want = plain_licenses(rows)
    got = license_scan.scan_licenses(files).collect()
    assert len(got) == 13 and all((r.license, r.license_dir) == want[r.doc_id, r.path] for r in got)
    assert {r.doc_id: r.license for r in got} == {1: "MIT", 2: "GPL-3.0", 3: "GPL-3.0", 4: "GPL-3.0", 5: None, 6: None, 7: "MIT", 8: None, 9: "Apache-2.0", 10: "Apache-2.0"}
    assert license_scan.query(odd).count() == odd.count() and license_scan.query(odd.limit(0)).count() == 0


def comment(text):
    words = text.split()
    return "".join(f" * {' '.join(words[k : k + 9])}\n" for k in range(0, len(words), 9))


def test_standard_licence_files(spark):
    from tallyloom.llm.license_templates import NOTICES, WHOLE

    gnu = {name: text for name, text in NOTICES if "any later version" in text}
    rows, want = [], {}
    for k, (name, text) in enumerate(WHOLE):
        rows.append((k, f"whole{k}/LICENSE", f"Copyright (c) 2019, Some People and Others\n\n{text}\n"))
        want[k] = name
    for k, (name, text) in enumerate(gnu.items(), 100):
        rows.append((k, f"head{k}/x.c", f"/*\n * x.c, a part of y\n * Copyright 2001 Z\n *\n{comment(text)} *\n */\nint main() {{ return {k}; }}\n" + "code();\n" * 80))
        want[k] = name
    for k, name in enumerate(("MIT", "Apache-2.0", "GPL-2.0-only", "MPL-2.0"), 200):
        rows.append((k, f"s{k}/x.c", f"// SPDX-License-Identifier: {name}\nint x;\n"))
        want[k] = name
    rows += [(290, "u/a.c", "// SPDX-License-Identifier: EPL-2.0\nint x;\n"), (291, "u/b.txt", "der Weg\nmit\nuns"), (292, "u/c.txt", "Released under the Foo License.\n")]
    want |= {290: None, 291: None, 292: None}
    folder = Path("/usr/share/common-licenses")
    standard = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    for k, (file, name) in enumerate(standard.items(), 300):
        if (folder / file).exists():
            rows.append((k, f"f{k}/LICENSE", (folder / file).read_text()))
            want[k] = name
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert {r.doc_id: r.license for r in got} == want
    assert {(r.doc_id, r.path): (r.license, r.license_dir) for r in got} == plain_licenses(rows)
