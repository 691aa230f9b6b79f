"""Registered queries of this subpackage, with their SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, lexical, licenses, minhash, packing, periods, quality, repeats, secrets, toxicity, urls, vectors, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return add


@query("op1_bpe")
def op1_bpe(spark: SparkSession, root: str) -> DataFrame:
    return bpe.round_trip(table(spark, root, "documents"))


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.packed(table(spark, root, "documents"))


@query("op5_secret_ledger", secrets.oracle_sql())
def op5_secret_ledger(spark: SparkSession, root: str) -> DataFrame:
    return secrets.digest(secrets.scanned(table(spark, root, "documents")))


@query("op8_fast_similarity_sketch")
def op8_fast_similarity_sketch(spark: SparkSession, root: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, root, "documents"))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    return repeats.digest(repeats.without_repeats(table(spark, root, "documents")), with_text=True)


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, root: str) -> DataFrame:
    return toxicity.judged(table(spark, root, "documents"), table(spark, root, "labels"))


@query("op3_quality_ratio")
def op3_quality_ratio(spark: SparkSession, root: str) -> DataFrame:
    return quality.judged(table(spark, root, "documents"), table(spark, root, "labels"))


@query("op4_host_reputation", urls.oracle_sql())
def op4_host_reputation(spark: SparkSession, root: str) -> DataFrame:
    """The outcome of a page is the quality label that bears its id."""
    outcomes = table(spark, root, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return urls.judged(table(spark, root, "pages"), outcomes)


@query("op10_prefix_forest")
def op10_prefix_forest(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings")
    return vectors.nearest(rows, rows.where(F.col("vec_id") % 50 == 0).select("vec_id"))


@query("op9_license_alignment")
def op9_license_alignment(spark: SparkSession, root: str) -> DataFrame:
    return licenses.scanned(table(spark, root, "documents"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, root: str) -> DataFrame:
    return periods.digest(periods.periodic(table(spark, root, "documents"), repeat=True))


@query("op12_document_tree", lexical.oracle_sql())
def op12_document_tree(spark: SparkSession, root: str) -> DataFrame:
    return lexical.ranked(table(spark, root, "documents"), table(spark, root, "benchmark"))


@query("op13_window_dedup", windows.oracle_sql())
def op13_window_dedup(spark: SparkSession, root: str) -> DataFrame:
    return windows.digest(windows.without_windows(table(spark, root, "documents")))
