"""What the text operators share: words, vocabulary files, code shipping."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are the maximal runs of characters outside this class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: A vocabulary file is broadcast; one above this size is refused.
MAX_VOCABULARY_BYTES = 64 << 20

#: Buckets of a filter of keys, the most rows that it broadcasts.
FILTER_BUCKETS = 1 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, unless PYTHONPATH or the working folder does already."""
    root = Path(__file__).resolve().parents[2]
    known = {os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), "."] if p or p == "."}
    app = spark.sparkContext.applicationId
    if str(root) in known or app in _shipped:
        return
    _shipped.add(app)
    target = Path(tempfile.mkdtemp()) / "tallyloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "tallyloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file is on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary(spark: SparkSession, path: str) -> Broadcast[bytes]:
    """A vocabulary file's bytes, read on the driver, so that executors need no copy of the file."""
    size = os.path.getsize(path)
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes; {MAX_VOCABULARY_BYTES} at most are broadcast")
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    import base64

    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrowed(rows: DataFrame, keys: DataFrame, on: list[str], keep: bool = True) -> DataFrame:
    """Rows whose key may be among keys (or, without keep, surely isn't), by hash buckets of a fixed number, which are
    broadcast. A filter before a shuffle: it lets more pass the more keys there are, and never loses one."""
    bucket = F.pmod(F.xxhash64(*on), F.lit(FILTER_BUCKETS)).cast("int").alias("key_bucket")
    few = keys.select(bucket).distinct()
    return rows.select("*", bucket).join(F.broadcast(few), "key_bucket", "left_semi" if keep else "left_anti").select(*rows.columns)


@contextmanager
def batch_bytes(spark: SparkSession, most: str) -> Iterator[None]:
    """Arrow batches of at most so many bytes, for what is run (not only planned) inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def worker_cache(key: tuple, make, large: bool = False):
    """make(), once for each Python worker process and key. Of large entries a worker keeps the last two that it used, so
    that the stages of a job that share a worker don't add up."""
    store = sys.modules[__name__].__dict__.setdefault("_worker_cache", {})
    if large:
        store = store.setdefault("large", {})
        if key in store:
            store[key] = store.pop(key)
        elif len(store) > 1:
            del store[next(iter(store))]
    if key not in store:
        store[key] = make()
    return store[key]
