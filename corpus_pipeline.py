"""Corpus preparation in five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows as Parquet
and reads them again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloam.llm import exact, langid, near, packing, pii
from codeloam.llm.common import materialise, unused
from codeloam.llm.queries import PII_KEY, VOCABULARY

#: A document whose words are spread over languages so that none has half of them is rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those in no one language; a model for the rest is fitted on docs. Where
    no document has a label there is no model, and all with a letter stay."""
    names, model = (unused(docs, "__lang_pred"), unused(docs, "__score")), langid.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs, model, names)
    return found.where((F.col(names[0]) != "und") & (F.col(names[1]) >= LEAST_SCORE)).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays."""
    return exact.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near.drop_near_duplicates(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values give way to pseudonyms; n_chars, if there, is counted anew."""
    out = pii.pseudonymise(docs, PII_KEY, pii=unused(docs, "__pii"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, placed in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [("language", language), ("exact", exact_dedup), ("near", near_dedup), ("pii", private), ("pack", pack)]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
