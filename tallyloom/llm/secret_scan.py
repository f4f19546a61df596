"""Secret scans by token efficiency.

Assignments of secrets, access keys and long hexadecimal strings are found by pattern. Beside them, every run of
20 or more key characters is encoded under a tiktoken vocabulary: natural words and identifiers take few tokens, a
random string takes one token for about every one or two characters. Runs with a low characters-per-token ratio are
reported as kind `random`, unless they are digests or identifiers of a known form. Where words joined by / _ - = hide a
random string in a longer run, the ratio is taken over its parts, and the random ones are reported. A run in one letter
case without digits has to be without separators and under a stricter ratio.

Defined results: a null text counts as an empty one; null ids pass through; repeated rows each get their own result;
spans are in code points, end exclusive; other columns are neither read nor returned by `secret_spans`, and
`redact_secrets` returns them as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.shared import parse_ranks, ship, vocabulary, vocabulary_path, worker_cache

# The base patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST = 20
#: Of max_ratio, for runs that look like words; random letters of one case are under it in about nine of ten cases.
STRICT = 0.95
#: Words of a path or a name up to this length don't end a random string that separators cut.
SHORT = 5
#: Known identifiers between separators, and all other parts of a run.
PART = re.compile(
    r"(?<![A-Za-z0-9+])(?P<known>[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|sha(?:1|224|256|384|512)[-_][A-Za-z0-9+/]{27,86}={0,2})(?![A-Za-z0-9+])"
    r"|[A-Za-z0-9+]+"
)
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
KNOWN = re.compile(
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"  # UUID
    r"|sha(?:1|224|256|384|512)[-_][A-Za-z0-9+/=]+"  # subresource integrity
    r"|[0-7][0-9A-HJKMNP-TV-Z]{25}"  # ULID
    r"|[0-9+/_=-]+"  # numbers, dates, rules
)

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("n_random", T.LongType()),
        T.StructField("base_spans", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)


def is_known(run: str) -> bool:
    """Whether a run is a digest or an identifier of a known form."""
    return (len(run) in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-fA-F]+", run) is not None) or KNOWN.fullmatch(run) is not None or run.lower() in _ALPHABET


def looks_keyed(run: str) -> bool:
    """Whether a run mixes letters with digits, or changes case inside a word."""
    return (re.search(r"[0-9]", run) is not None and re.search(r"[A-Za-z]", run) is not None) or re.search(r"[a-z][A-Z].*[a-z][A-Z]", run) is not None


def is_random(run: str, count_tokens: Callable[[str], int], max_ratio: float) -> bool:
    """Whether a run has few characters per token and is no known identifier."""
    keyed = looks_keyed(run)
    if len(run) < LEAST or is_known(run) or not keyed and re.search("[/_=-]", run):
        return False
    return len(run) < (max_ratio if keyed else STRICT * max_ratio) * count_tokens(run)


def random_spans(run: str, count_tokens: Callable[[str], int], max_ratio: float) -> list[tuple[int, int]]:
    """The whole run if it is random, else its random parts: neighbours without a longer word between them, or single ones."""
    if is_random(run, count_tokens, max_ratio):
        return [(0, len(run))]
    if is_known(run):
        return []
    groups: list[list[tuple[int, int]]] = [[]]
    for m in PART.finditer(run):
        odd = m["known"] is None and not (len(m[0]) >= LEAST and is_known(m[0])) and len(m[0]) < max_ratio * count_tokens(m[0])
        if odd or m["known"] is None and len(m[0]) <= SHORT and groups[-1]:
            groups[-1].append((m.start(), m.end() if odd else -1))
        else:
            groups.append([])
    found = []
    for group in groups:
        while group and group[-1][1] < 0:
            group.pop()
        if not group:
            continue
        a, b = group[0][0], group[-1][1]
        if is_random(run[a:b], count_tokens, max_ratio):
            found.append((a, b))
        else:
            found += [(x, y) for x, y in group if is_random(run[x:y], count_tokens, max_ratio)]
    return found


def find_spans(text: str, count_tokens: Callable[[str], int], max_ratio: float) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans by start, then kind as in KINDS."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in RUN.finditer(text):
        found += [(m.start() + a, 3, m.start() + b) for a, b in random_spans(m[0], count_tokens, max_ratio)]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _token_counter(raw: bytes) -> Callable[[str], int]:
    def make():
        import public_tokenizers
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parse_ranks(raw), special_tokens={})
        return lambda s: len(own.encode_ordinary(s))

    return worker_cache(("tiktoken", len(raw), hash(raw)), make)


def secret_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_ratio: float = 2.0, vocabulary_file: str | None = None) -> DataFrame:
    """One row for each row of docs: counts by kind and all spans as `kind:start:end`, comma-joined.

    One pass, no shuffle. max_ratio: a run of key characters with fewer characters per token than this is random.
    """
    spark = docs.sparkSession
    ship(spark)
    ranks = vocabulary(spark, vocabulary_file or vocabulary_path("byte_bpe_50k.tiktoken"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _token_counter(ranks.value)
        for batch in batches:
            rows = []
            for one in batch.column(1):
                spans = find_spans(one.as_py() or "", count, max_ratio)
                n = [sum(k == kind for _, _, k in spans) for kind in KINDS]
                rows.append((*n, _joined([s for s in spans if s[2] != "random"]), _joined(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=SCHEMA.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, SCHEMA)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with every union of overlapping spans replaced by one mark that names the first span's kind."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end, kind = spans[k]
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][1])
            k += 1
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", max_ratio: float = 2.0, vocabulary_file: str | None = None) -> DataFrame:
    """docs with secrets replaced by marks such as [assign]; all other columns, null texts and clean texts stay as they are."""
    spark = docs.sparkSession
    ship(spark)
    ranks = vocabulary(spark, vocabulary_file or vocabulary_path("byte_bpe_50k.tiktoken"))

    @F.udf(T.StringType(), useArrow=True)
    def clean(text):
        return None if text is None else redact(text, find_spans(text, _token_counter(ranks.value), max_ratio))

    return docs.withColumn(text_col, clean(F.col(text_col)))


def query(docs: DataFrame) -> DataFrame:
    """The digest columns of op1."""
    found = secret_spans(docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")


def brute_spans(text: str) -> str:
    """The base spans as the patterns state them, for tests."""
    out = []
    for rank, (pattern, least, group) in enumerate(((ASSIGN, 6, 2), (re.compile("AKIA[A-Z0-9]+"), 20, 0), (re.compile("[0-9a-f]+"), 24, 0))):
        out += [(m.start(), rank, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
