"""The pipeline over ``documents``: toxic documents go, of near-duplicates one stays, long repeats are cut out, secrets are
masked, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of
``docs``, extra ones included. Null texts count as empty and stay null where nothing is cut; rows with a null id are never
dropped as duplicates, for nothing can refer to them. Rows that repeat id and text become one
in the near-duplicate stage. Empty tables pass through.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import minhash, packing, repeats, secrets, toxicity
from quire.llm.shared import stored


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes from which a repeat is cut, and of those that anchors compare. A passage of 51 words has about 300 bytes in these
#: languages, so the 400 of the query ``op6_suffix_dedup`` (fixed by its contract) would leave most of them.
REPEAT, CONTENT = 200, 100


def plain_names(stage):
    """A stage that sees extra columns under names of their own, so that none can clash with what operators add."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = [c if c in COLUMNS else f"extra_{k}" for k, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*plain), sf_dir).select(*plain).toDF(*docs.columns)

    return run_stage


@plain_names
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    return toxicity.scored(docs, model).where("score < 0.5").select(*docs.columns)


@plain_names
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


@plain_names
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of ``REPEAT`` bytes, which every repeat of 400 consists of, so that passages of over 50 words go as well."""
    return measured(repeats.trimmed(repeats.without_repeats(docs, length=REPEAT, content=CONTENT)), docs)


@plain_names
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return measured(secrets.redacted(secrets.scanned(docs)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


def measured(new: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, ``n_chars`` as the texts are now."""
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return new.select(*docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("secrets", mask_secrets),
    ("packing", pack),
]
#: SQL cannot express suffix sorting or token merges over whole tables; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
