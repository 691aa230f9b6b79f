"""Reading corpora and routing documents (inventory A1, A4, A5, A8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions.scans import first_row


def read_corpus(spark: SparkSession, path: str, version: int, kinds: tuple[str, ...] = ("runs", "pages", "ocr", "placements")) -> dict[str, DataFrame]:
    """Tables of a corpus folder, rows of another version left out (a partition filter where partitioned by it)."""
    return {k: of_version(spark.read.parquet(f"{path}/{k}"), version) for k in kinds}


def of_version(df: DataFrame, version: int, column: str = "ir_version") -> DataFrame:
    return df.where(F.col(column) == version).drop(column)


def best_reading(df: DataFrame, keys: list[str], source: str, precedence: list[str]) -> DataFrame:
    """The transcription of the most trusted reviewer per key; a reviewer not listed comes last."""
    rank = F.array_position(F.array(*[F.lit(p) for p in precedence]), F.col(source))
    order = [F.when(rank == 0, len(precedence) + 1).otherwise(rank), F.col(source)]
    ties = [F.col(c) for c in df.columns if c not in (*keys, source)]
    return first_row(df, keys, [*order, *ties])


def sample_pages(df: DataFrame, page: str, every: int | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """Every n-th page, or an inclusive range."""
    if every is not None:
        df = df.where(F.pmod(F.col(page), F.lit(every)) == 0)
    if between is not None:
        df = df.where(F.col(page).between(*between))
    return df


def split_refused(docs: DataFrame, refused: Column) -> tuple[DataFrame, DataFrame]:
    """Documents to go on with, and those refused; a null verdict is no refusal."""
    verdict = F.coalesce(refused, F.lit(False))
    return docs.where(~verdict), docs.where(verdict)
