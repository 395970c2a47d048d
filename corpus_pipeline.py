"""A corpus pipeline: five stages over `documents`, each on all that the one before it kept.

Toxic documents go, then documents in no language that was learned, then all but one document of each group
of near copies, then documents that hold an item of `benchmark`; what is left is encoded. All stages but the
last return the columns of documents; each result is written as a table that the next stage reads, and a stage's input is
deleted once its result is written.

Defined results: a null text counts as empty. It is not toxic, but in no language, so it goes at the second stage, as does a text
without a letter or one whose likeliest language has a posterior under `LEAST_SCORE`. Rows with a null id stay; of rows of one
id one is left. Empty tables give no rows; columns other than those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontam, langid, neardup, toxicity
from tracewell.llm.common import DOCUMENT_COLUMNS, Scratch, table

#: Posterior probability that a language needs.
LEAST_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(DOCUMENT_COLUMNS)
    model = toxicity.train(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, tuple(DOCUMENT_COLUMNS)).where(F.col("predicted") == 0).select(DOCUMENT_COLUMNS)


def drop_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(DOCUMENT_COLUMNS)
    names, matrix = langid.train(langid.training_rows(docs))
    judged = langid.predict(docs, names, matrix, tuple(DOCUMENT_COLUMNS))
    return judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(DOCUMENT_COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(spark, docs.select(DOCUMENT_COLUMNS)).select(DOCUMENT_COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs.select(DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(docs, bpe.tokenizer_text())


STAGES = [("toxicity", drop_toxic), ("language", drop_undetermined), ("near_copies", drop_near_copies), ("contamination", drop_contaminated), ("encode", encode)]
#: SQL can't express trained models, near copies or BPE; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.put(docs, f"{k}-{name}")
            if k:
                scratch.drop(f"{k - 1}-*")
    return docs
