"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes what its predecessor kept, as a table with the columns of ``documents``, and
models are fitted on that.  Between stages the table is written and read again, so a lost executor
costs no more than a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, langid, neardup, packing, pii
from plumbline.llm.shared import discard, scratch, written
from plumbline.llm.tokens import default_vocabulary

#: A document goes if the likeliest language has a calibrated probability below this.
LEAST_LANGUAGE_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter or whose language cannot be told."""
    found = langid.predict(docs, langid.fit(docs), whole_rows=True)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id."""
    return neardup.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(decontaminate.find_benchmark(docs, items, whole_rows=True)).where(~F.col("contaminated")).select("row.*")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars follows the text."""
    rows = pii.scan(docs, with_redacted=True)
    found = F.size("spans") > 0
    columns = [F.when(found, F.length("row.text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return rows.select(*columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids and their places in sequences of 1024 tokens;
    ``packing.sequences`` joins them."""
    return packing.pack(docs, default_vocabulary("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("best-fit packing", packed),
]
#: Language models, weighted sampling and tokenisation cannot be said in SQL; tests compare the
#: stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  A stage's table, and what it made on the way, go as soon as the
    next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower(), keep=True)
        if before is not None:
            discard(before)
        before = docs
    return docs
