"""The registered queries of the text operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import byte_bpe, decontaminate, license_scan, minhash_dedup, quality_mil, quality_rules, secret_scan, substring_dedup, token_rollup, token_store
from tallyloom.llm.shared import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.query(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.query(table(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.query(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.query(table(spark, sf_dir, "documents"))


def op7_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.query(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_license_scan": op3_license_scan,
    "op4_token_store": op4_token_store,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_token_rollup": op6_token_rollup,
    "op7_quality_mil": op7_quality_mil,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_substring_dedup": op10_substring_dedup,
}

OP10_SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
win as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as k from w, unnest(range(1, len(ws) - 48)) as t(i)),
least as (select k, min(doc_id) as m from win group by k),
gone as (select doc_id, list(distinct p) as ps from (select win.doc_id, unnest(range(i, i + 50)) as p from win join least using (k) where m < win.doc_id) group by doc_id),
kept as (select w.doc_id, ws, case when ps is null then ws else list_filter(ws, lambda x, i: not list_contains(ps, i)) end as ks from w left join gone using (doc_id))
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - len(ks) as bigint) as n_removed, sha256(array_to_string(ks, ' ')) as kept_sha256 from kept
"""

#: The other operators learn, sample, align or merge bytes, which SQL can't state; tests hold them against brute force.
ORACLES: dict[str, str] = {"op10_substring_dedup": OP10_SQL}
