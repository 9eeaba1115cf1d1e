"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated passages are cut,
contaminated documents go, and the rest is mixed to the target weights of its sources.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``. ``run``
writes each stage's result as Parquet to the shared folder and reads it again for the next, so every stage works on all
that its predecessor kept and a lost executor costs no earlier stage. Rows with nulls, empty texts and repeated rows pass
by the rules in the operators' docstrings; an empty table gives an empty mix.

No SQL can express the learned first stage, so the tests hold ``run`` against plain Python versions of the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklab.llm import decontaminate, mixing, simhash, substrings, toxicity
from ranklab.llm.common import free_names, shared_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score, = free_names(docs, "_toxicity")
    return toxicity.with_scores(docs, model, score_col=score).filter(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash group."""
    return simhash.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows that start in a document with a smaller id."""
    return substrings.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule does not reject."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document left."""
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_duplicates), ("substring dedup", cut_repeats),
          ("benchmark decontamination", drop_contaminated), ("mixing", mix_sources)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
