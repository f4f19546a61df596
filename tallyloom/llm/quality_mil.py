"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of 64 words. Each passage is encoded: shares of hashed word shapes and of a few
statistics go through a learned layer. Gated attention (Ilse, Tomczak, Welling 2018) weighs the passages, and the
weighted sum is scored. Encoder, attention and score are learned together from labels of whole documents, with Adam
over numpy arrays on the driver, from a bounded sample of labelled rows; scoring is one scan. What a passage is judged by
is the form of its words, their lengths, marks and repetition; which words they are plays no part.

Defined results: a null or empty text is one passage without words and gets a score like any other; null ids pass
through; rows that share an id each get their score, and the first in order of their passages is learned from; without labels of both kinds every score is their mean (0.5
without labels). Labels are used from rows whose crc32 of the id, mod 3, isn't 1; language, source and id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import ship, worker_cache
from tallyloom.llm.shingles import word_hashes, words_of
from tallyloom.session import written

PASSAGE_WORDS = 64
SHAPES = 192
STATS = 8
#: Labelled documents to learn from at most, passages of one of them (longer texts are not drawn), and passages in all.
MAX_TRAIN_DOCS = 4_000
MAX_BAG = 1_000
MAX_TRAIN_PASSAGES = 200_000
#: Passages that are scored at once.
SCORE_PASSAGES = 8_192
MEMO_ENTRIES = 400_000


class _Shapes(dict):
    """A word's shape bucket (low 16 bits), length, upper-case letters, digits and marks (12 bits each, capped)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        text = word.decode("utf-8")
        shape, upper, digits, marks = [], 0, 0, 0
        for c in text:
            if c.isalpha():
                kind = "U" if c.isupper() else "l"
                upper += kind == "U"
            elif c.isdigit():
                kind, digits = "d", digits + 1
            else:
                kind, marks = c, marks + 1
            if not shape or shape[-1] != kind:
                shape.append(kind)
        bucket = int(word_hashes(["".join(shape[:12]).encode()])[0] % SHAPES)
        value = bucket | sum(min(n, 4095) << (16 + 12 * k) for k, n in enumerate((len(text), upper, digits, marks)))
        if len(word) <= 64:
            self[word] = value
        return value


def passages(text: str | None) -> np.ndarray:
    """The features of every passage of the text, one row each; an empty text has one row of zeros."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.zeros((1, SHAPES + STATS), dtype=np.float32)
    codes = np.fromiter(map(worker_cache(("shapes",), _Shapes, large=True).__getitem__, words), dtype=np.uint64, count=n)
    count = -(-n // PASSAGE_WORDS)
    at = np.arange(n) // PASSAGE_WORDS
    size = np.bincount(at, minlength=count)
    out = np.zeros((count, SHAPES + STATS), dtype=np.float32)
    bucket = (codes & np.uint64(0xFFFF)).astype(np.int64)
    out[:, :SHAPES] = np.sqrt(np.bincount(at * SHAPES + bucket, minlength=count * SHAPES).reshape(count, SHAPES) / size[:, None])
    fields = [((codes >> np.uint64(16 + 12 * k)) & np.uint64(4095)).astype(np.float64) for k in range(4)]
    chars = np.bincount(at, fields[0], count)
    h = word_hashes(words)
    order = np.lexsort((h, at))
    fresh = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (at[order][1:] != at[order][:-1])))
    same = np.concatenate(([False], h[1:] == h[:-1]))
    stats = [
        chars / size / 10,
        *(np.bincount(at, f, count) / np.maximum(chars, 1) for f in fields[1:]),
        np.bincount(at[order], fresh, count) / size,
        np.bincount(at, same, count) / size,
        np.bincount(at, fields[0] > 20, count) / size,
        size / PASSAGE_WORDS,
    ]
    out[:, SHAPES:] = np.stack(stats, axis=1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """encode (W, b), attend (V, U, a), score (w, c)."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, width: int = 24, gate: int = 16, seed: int = 11) -> Model:
        r = np.random.default_rng(seed)
        shapes = {"W": (SHAPES + STATS, width), "b": (width,), "V": (width, gate), "U": (width, gate), "a": (gate,), "w": (width,), "c": (1,)}
        return cls({k: (r.normal(0, s[0] ** -0.5, s) if len(s) > 1 or k == "a" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()})

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Scores of bags whose passages start at `starts` in x, and what the gradients need."""
        p = self.p
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        h = np.tanh(x @ p["W"] + p["b"])
        tv, su = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (tv * su) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        alpha = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(alpha[:, None] * h, starts, axis=0)
        return _sigmoid(z @ p["w"] + p["c"]), {"bag": bag, "h": h, "tv": tv, "su": su, "alpha": alpha, "z": z}

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        score, s = self.forward(x, starts)
        d = (score - y) / len(y)
        dz = d[:, None] * p["w"]
        dalpha = (dz[s["bag"]] * s["h"]).sum(axis=1)
        mean = np.add.reduceat(dalpha * s["alpha"], starts)[s["bag"]]
        de = s["alpha"] * (dalpha - mean)
        dgate = de[:, None] * p["a"]
        dv, du = dgate * s["su"] * (1 - s["tv"] ** 2), dgate * s["tv"] * s["su"] * (1 - s["su"])
        dh = s["alpha"][:, None] * dz[s["bag"]] + dv @ p["V"].T + du @ p["U"].T
        dx = dh * (1 - s["h"] ** 2)
        return {"W": x.T @ dx, "b": dx.sum(0), "V": s["h"].T @ dv, "U": s["h"].T @ du, "a": (s["tv"] * s["su"]).T @ de, "w": s["z"].T @ d, "c": np.array([d.sum()])}


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> Model:
    """Adam over shuffled batches of bags; the same rows in any order give the same model only if they come sorted."""
    model, r = Model.fresh(seed=seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(bags))
        pace = rate * (1 - epoch / epochs) + rate * 0.02
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            sizes = np.array([len(bags[i]) for i in own])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            step += 1
            for name, g in model.gradients(np.concatenate([bags[i] for i in own]), starts, y[own]).items():
                g = g + decay * model.p[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                model.p[name] = (model.p[name] - pace * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(id_col: str = "doc_id"):
    """Whether a row's label is kept for tests."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_train_docs: int = MAX_TRAIN_DOCS, max_bag: int = MAX_BAG, max_train_passages: int = MAX_TRAIN_PASSAGES) -> tuple[Model | None, float]:
    """The model and the mean label. The sample: labelled rows not held out, of the lowest id hash; broadcast, and collected
    as far as max_train_passages go."""
    ship(docs.sparkSession)
    sample = (
        labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & ~held_out(id_col))
        .select(F.col(id_col).cast("long").alias("label_id"), F.col("quality").cast("int").alias("label"), F.xxhash64(F.col(id_col).cast("string")).alias("key"))
        .orderBy("key", "label_id", "label")
        .limit(max_train_docs)
    )
    own = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).cast("string").alias("text"))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names, bags = [], [], []
            for key, label, text in zip(*batch.columns, strict=True):
                x = passages(text.as_py())
                if len(x) <= max_bag:
                    keys.append(key.as_py())
                    names.append(label.as_py())
                    bags.append(x.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.int32()), pa.array(bags, pa.binary())], names=["key", "label", "bag"])

    featurized = own.join(F.broadcast(sample), "label_id").select("key", "label", "text").mapInArrow(featurize, "key long, label int, bag binary")
    picked = written(featurized.groupBy("key", "label").agg(F.min("bag").alias("bag")), "bags")
    held, chosen = 0, []
    for r in picked.select("key", "label", F.octet_length("bag").alias("n")).orderBy("key", "label").collect():
        held += r["n"] // (2 * (SHAPES + STATS))
        if held > max_train_passages:
            break
        chosen.append(r["key"])
    last = max(chosen, default=None)
    rows = sorted((r["key"], r["label"], bytes(r["bag"])) for r in picked.where(F.col("key") <= F.lit(last)).collect()) if chosen else []
    y = np.array([r[1] for r in rows], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        return None, float(y.mean()) if len(y) else 0.5
    bags = [np.frombuffer(r[2], dtype=np.float16).reshape(-1, SHAPES + STATS).astype(np.float32) for r in rows]
    return train(bags, y), float(y.mean())


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model | None, prior: float = 0.5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs, in one scan."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores: list[float] = []
            bags: list[np.ndarray] = []
            held = 0
            for k, text in enumerate(batch.column(2)):
                if model is None:
                    scores.append(prior)
                    continue
                bags.append(passages(text.as_py()))
                held += len(bags[-1])
                if held >= SCORE_PASSAGES or k + 1 == batch.num_rows:
                    starts = np.cumsum([0, *map(len, bags[:-1])])
                    scores += model.forward(np.concatenate(bags), starts)[0].tolist()
                    bags, held = [], 0
            values = np.array(scores, dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values), pa.array((values >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCORED)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of op7."""
    model, prior = fit(docs, labels)
    return score(docs, model, prior)
