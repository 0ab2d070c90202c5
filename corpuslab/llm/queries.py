"""The operators over their whole tables: name -> callable(spark, sf_dir), and equal DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact, fuzzy_lines, language, lexical, merkle, mixing, passages, quality, secrets, simhash, suffix, tokens
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {
    "op3_line_hashing": passages.ORACLE,
    "op4_suffix_dedup": suffix.ORACLE,
    "op5_secrets": secrets.ORACLE,
    "op9_exact_dedup": exact.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_dedup(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query
def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op9_exact_dedup(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query
def op10_decontaminate(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"))


@query
def op3_line_hashing(spark, sf_dir):
    return passages.digests(table(spark, sf_dir, "documents"))


@query
def op7_fuzzy_lines(spark, sf_dir):
    return fuzzy_lines.per_document(table(spark, sf_dir, "documents"))


@query
def op5_secrets(spark, sf_dir):
    return secrets.per_document(table(spark, sf_dir, "documents"))


@query
def op4_suffix_dedup(spark, sf_dir):
    return suffix.digests(table(spark, sf_dir, "documents"))


@query
def op11_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


@query
def op12_merkle_manifest(spark, sf_dir):
    return merkle.audit(table(spark, sf_dir, "documents"))


@query
def op13_lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
