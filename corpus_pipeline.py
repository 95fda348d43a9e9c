"""The corpus pipeline: language ID, line dedup, near dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.llm import decontaminate, langid, linededup, packing, simhash
from chronomesh.llm.common import discard, materialize, scratch
from chronomesh.llm.queries import tokenizer_path


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not recognised."""
    return langid.keep_known(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that repeat an earlier one up to one edit; keeps every document."""
    return _sized(linededup.deduplicate(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose five-word shingles are similar to 0.8 or more."""
    return simhash.deduplicate(docs, width=5, similarity=0.8)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents and cuts single benchmark passages."""
    return _sized(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens."""
    return packing.best_fit_pack(docs, tokenizer_path())


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: Trained and tokenizing stages have no SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next.

    A stage's helper tables and its input go once its result is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratch() as written:
            docs = materialize(stage(spark, docs, sf_dir), name)
        for table in [*before, *written[:-1]]:
            discard(table)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
