"""Training-corpus pipeline: five of the llm operators over ``documents``.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all rows its
predecessor kept; ``run`` writes every stage's result as Parquet into the
shared checkpoint folder and rereads it for the next, so a lost executor costs
at most the running stage; a stage's result is deleted once its successor is written.  Null texts do not pass language ID; later stages
treat null as empty, keep extra columns and their order, and give an empty
result for an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import decontam, langcrf, mixing, simhash, suffix
from shelfwise.session import checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go (null, no letter, words labelled
    with a mean certainty below 0.5); documents of several languages stay."""
    return langcrf.drop_unidentified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the smallest id."""
    return simhash.drop_near_duplicates(docs, shingle=4, max_bits=4)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 bytes that occur twice are cut out of the texts."""
    return suffix.remove_repeats(docs, length=200)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
]

# A trained model, SimHash groups and suffix sorting have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:          # its successor is written, so nothing reads it again
            _delete(spark, before)
        before = out
    return docs


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
