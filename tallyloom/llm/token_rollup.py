"""Token counts as delta-maintained rollups.

A store is a folder of signed deltas by batch. Inserts add a document and its tokens, deletes take them away, and
a revised count adds the difference; each batch is reduced to additive totals by source, language and tokenizer version,
so that the totals of the store are the sum over its batches and no count is made twice. Every batch also keeps its signed
rows by document, dealt into parts by a hash of the key and sorted; a later batch reads only the parts that its own keys
fall into. `compact` folds the batches so far into one base, so that readers open a bounded number of folders.

Commits are idempotent: a batch is written under its number, whole, and counts once its last table, the totals, has been
committed; a batch whose number is committed is not written again, and one that broke off halfway is written anew,
since each table is overwritten. One writer at a time commits a given number.

Defined results: a null text has no tokens; null sources and languages are groups of their own; changes without an id,
a tokenizer version or a known operation aren't applied but counted, as n_rejected of their group; of several changes to
one document and version in a batch the one with the largest `seq` holds (ties: the larger count); a delete or revision
of an unknown document, and an insert of a known one, count as no delete, an insert and a revision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.byte_bpe import codec
from tallyloom.llm.shared import ship, vocabulary, vocabulary_path
from tallyloom.session import scratch_path, written

KEYS = ("source", "lang", "tokenizer")
LEDGER = "doc_id long, tokenizer string, source string, lang string, d_docs long, d_tokens long"
TOTALS = "source string, lang string, tokenizer string, d_docs long, d_tokens long, d_rejected long"
#: Folders that the signed rows of a batch are dealt into.
PARTS = 64
#: Tasks that may write one part at once.
SPREAD = 61


def count_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text", vocabulary_file: str | None = None, revise: Callable[[str], str] | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer and n_tokens of every row, in one scan; n_revised counts revise(text) where it differs."""
    spark = docs.sparkSession
    ship(spark)
    ranks = vocabulary(spark, vocabulary_file or vocabulary_path("byte_bpe_50k.tiktoken"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(ranks.value)
        for batch in batches:
            n, later = [], []
            for x in batch.column(3):
                text = x.as_py() or ""
                n.append(use.count(text))
                new = text if revise is None else revise(text)
                later.append(None if new == text else use.count(new))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(later, pa.int64())], names=["doc_id", "source", "lang", "n_tokens", "n_revised"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long, n_revised long").withColumn("tokenizer", F.lit(tokenizer))


def _part() -> Column:
    return F.pmod(F.xxhash64("doc_id", "tokenizer"), F.lit(PARTS)).cast("int").alias("part")


class RollupStore:
    """The batches under a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self, table: str, kind: str) -> dict[int, str]:
        """Committed batches or bases by number: those whose totals have Spark's success mark."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/totals")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return {}
        names = [s.getPath() for s in fs.listStatus(at)]
        done = [p.getName() for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return {int(n.partition("=")[2]): f"{self.path}/{table}/{n}" for n in sorted(done) if n.startswith(f"{kind}=")}

    def _live(self, table: str) -> list[str]:
        """The folders that readers add up: the last base and the batches that it doesn't hold."""
        bases = self._folders(table, "base")
        last = max(bases, default=None)
        held = set(self._held(last))
        return ([] if last is None else [bases[last]]) + [p for n, p in self._folders(table, "batch").items() if n not in held]

    def _held(self, base: int | None) -> list[int]:
        return [] if base is None else [r["batch"] for r in self.spark.read.schema("batch int").parquet(f"{self.path}/held/base={base}").collect()]

    def committed(self) -> list[int]:
        return sorted(self._folders("totals", "batch"))

    def _read(self, table: str, schema: str, parts: list[int] | None = None) -> DataFrame:
        paths = self._live(table)
        if not paths:
            return self.spark.createDataFrame([], schema)
        out = None
        for path in paths:
            one = self.spark.read.schema(schema + ", part int" * (table == "ledger")).parquet(path)
            one = one if parts is None else one.where(F.col("part").isin(parts))
            out = one if out is None else out.union(one)
        return out.drop("part")

    def _write(self, table: str, name: str, rows: DataFrame) -> None:
        if table == "ledger":
            rows = rows.withColumn("part", _part()).repartition("part", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))).sortWithinPartitions("part", "doc_id")
            rows.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{table}/{name}")
        else:
            rows.write.mode("overwrite").parquet(f"{self.path}/{table}/{name}")

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commit changes (doc_id, source, lang, tokenizer, op, n_tokens, seq), op one of insert, delete and revise.

        False where the batch is committed already. `changes` runs once: what holds of it is written before it is used.
        """
        if batch in self.committed():
            return False
        key = ["doc_id", "tokenizer"]
        fit = F.coalesce(F.expr("doc_id is not null and tokenizer is not null and op in ('insert', 'delete', 'revise')"), F.lit(False))
        value = F.struct(F.coalesce("seq", F.lit(0)).alias("seq"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "op", "source", "lang")
        # A rejected row has a key of its own group; a third of all rows may be rejected, so they are added up at once.
        group = F.when(~fit, F.struct("source", "lang"))
        last = written(
            changes.select(F.when(fit, F.col("doc_id")).alias("doc_id"), "tokenizer", (~fit).alias("rejected"), group.alias("g"), value.alias("value"))
            .groupBy(*key, "rejected", "g")
            .agg(F.max("value").alias("c"), F.count("*").alias("n"))
            .select(*key, "rejected", "c.op", F.coalesce("g.source", "c.source").alias("source"), F.coalesce("g.lang", "c.lang").alias("lang"), "c.n_tokens", "n"),
            "changes",
        )
        held = last.where("not rejected")
        signed = held.where("op <> 'delete'").select(*key, "source", "lang", F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").cast("long").alias("d_tokens"))
        if self._live("ledger"):
            parts = [r["part"] for r in held.select(_part()).distinct().collect()]
            known = self._read("ledger", LEDGER, parts).join(held.select(*key), key, "left_semi")
            old = known.select(*key, "source", "lang", (-F.col("d_docs")).alias("d_docs"), (-F.col("d_tokens")).alias("d_tokens"))
            signed = _net(old.union(signed))
        self._write("ledger", f"batch={batch}", signed)
        rows = self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger/batch={batch}").withColumn("d_rejected", F.lit(0).cast("long"))
        refused = last.where("rejected").select(*KEYS, *(F.lit(0).cast("long").alias(c) for c in ("d_docs", "d_tokens")), F.col("n").alias("d_rejected"))
        added = rows.select(*refused.columns).union(refused).groupBy(*KEYS)
        self._write("totals", f"batch={batch}", added.agg(*(F.sum(c).alias(c) for c in ("d_docs", "d_tokens", "d_rejected"))))
        return True

    def compact(self) -> int | None:
        """Fold what readers add up into one base; its number, or None for an empty store. Batches stay committed."""
        bases, batches = self._folders("totals", "base"), self.committed()
        if not batches:
            return None
        name = f"base={max(bases, default=0) + 1}"
        self._write("held", name, self.spark.createDataFrame([(n,) for n in batches], "batch int"))
        self._write("ledger", name, _net(self._read("ledger", LEDGER)))
        added = self._read("totals", TOTALS).groupBy(*KEYS)
        self._write("totals", name, added.agg(*(F.sum(c).alias(c) for c in ("d_docs", "d_tokens", "d_rejected"))))
        return max(bases, default=0) + 1

    def totals(self) -> DataFrame:
        """Documents, tokens and rejected changes by source, language and tokenizer version."""
        summed = self._read("totals", TOTALS).groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"), F.sum("d_rejected").alias("n_rejected"))
        return summed.where("n_docs <> 0 or n_tokens <> 0 or n_rejected <> 0")

    def documents(self) -> DataFrame:
        """The current count of each document and tokenizer version."""
        return _net(self._read("ledger", LEDGER)).withColumnsRenamed({"d_docs": "n_docs", "d_tokens": "n_tokens"})


def _net(signed: DataFrame) -> DataFrame:
    """Signed rows added up by document, without those that cancel out."""
    summed = signed.groupBy("doc_id", "tokenizer", "source", "lang").agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
    return summed.where("d_docs <> 0 or d_tokens <> 0")


VERSION = "byte_bpe_50k"


def query(docs: DataFrame) -> DataFrame:
    """Totals of all documents by state, after each of three batches: `inserted`, all documents (the batch comes twice and
    counts once); `deduplicated`, after deletes of all copies of a text but the one of the least id; `revised`, after
    revised counts of the remaining texts once their line breaks are spaces."""
    spark = docs.sparkSession
    store = RollupStore(spark, scratch_path(spark, "rollup"))
    change = lambda df, op: df.select("doc_id", "source", "lang", "tokenizer", F.lit(op).alias("op"), "n_tokens", F.lit(0).alias("seq"))
    state = lambda name: written(store.totals().select(F.lit(name).alias("state"), *KEYS, "n_docs", "n_tokens", "n_rejected"), name)
    counts = written(count_tokens(docs, VERSION, revise=lambda text: text.replace("\n", " ")), "counts")
    inserts = change(counts, "insert")
    store.apply(1, inserts)
    store.apply(1, inserts)
    first = state("inserted")
    keyed = docs.where("doc_id is not null").select("doc_id", "source", "lang", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("second"), F.col("text")).alias("b"))
    least = keyed.groupBy("a", "b").agg(F.min("doc_id").alias("least"))
    copies = written(keyed.join(least, ["a", "b"]).where("doc_id > least").withColumns({"tokenizer": F.lit(VERSION), "n_tokens": F.lit(0).cast("long")}), "copies")
    store.apply(2, change(copies, "delete"))
    second = state("deduplicated")
    broken = counts.where("n_revised is not null and doc_id is not null").withColumn("n_tokens", F.col("n_revised"))
    store.apply(3, change(broken.join(copies.select("doc_id"), "doc_id", "left_anti"), "revise"))
    return first.union(second).union(state("revised"))


def brute_force(rows: list[tuple[int | None, str | None, str | None, str | None]], count) -> dict[tuple, tuple[int, int, int]]:
    """(n_docs, n_tokens, n_rejected) by state, source and language, stated plainly, for tests; rows (id, text, source, lang)."""
    held: dict[int, tuple] = {}
    rejected: dict[tuple, int] = {}
    for i, text, source, lang in rows:
        if i is None:
            rejected[source, lang] = rejected.get((source, lang), 0) + 1
        else:
            best = lambda n, s, g: (n, (s is not None, s or ""), (g is not None, g or ""))
            now = (count(text or ""), source, lang)
            held[i] = max(held.get(i, now), now, key=lambda r: best(*r))
    first: dict[str | None, int] = {}
    for i, text, _, _ in rows:
        if i is not None:
            first[text] = min(i, first.get(text, i))
    gone = {i for i, text, _, _ in rows if i is not None and first[text] < i}
    states = [("inserted", dict(held)), ("deduplicated", {i: v for i, v in held.items() if i not in gone})]
    revised = dict(states[1][1])
    for i in revised:
        texts = [(count(t.replace("\n", " ")), s, g) for j, t, s, g in rows if j == i and "\n" in (t or "")]
        if texts:
            revised[i] = max(texts, key=lambda r: (r[0], (r[1] is not None, r[1] or ""), (r[2] is not None, r[2] or "")))
    out: dict[tuple, tuple[int, int, int]] = {}
    for name, docs in [*states, ("revised", revised)]:
        for (n, s, g), add in [*((v, (1, v[0], 0)) for v in docs.values()), *(((0, s, g), (0, 0, n)) for (s, g), n in rejected.items())]:
            out[name, s, g] = tuple(map(sum, zip(out.get((name, s, g), (0, 0, 0)), add, strict=True)))
    return out
