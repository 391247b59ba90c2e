"""The corpus pipeline: five stages, each over all rows that its predecessor kept."""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseriver.llm import near_dedup, packing, pii, quality_rules, source_mix
from clauseriver.llm.common import read, shared_folder


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go.

    Null, empty and short texts go; rows that repeat stay each or go each; null sources have no host verdict.
    An empty table stays empty. The columns are those of docs, whatever their names.
    """
    judged = quality_rules.judge_documents(docs)
    return judged.where(F.col(judged.columns[-1])).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that of the least doc_id.

    Rows that repeat become one. Texts without a word, null ones and rows without a doc_id stay, all of them.
    Long texts are compared whole. An empty table stays empty. The columns are those of docs.
    """
    return near_dedup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows.

    Null texts stay null, no row goes or comes; rows that repeat change alike. An empty table stays empty. The columns are
    those of docs.
    """
    return _counted(pii.redact(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their targets; the rows come in the order of the curriculum.

    Texts without a word, and null ones, are in no copy and go; a null source is a source. Ties in time go by a digest
    of the row. An empty table stays empty. The columns are those of docs: the order of the written rows (by
    file, then place in the file) is that of training.
    """
    return _counted(source_mix.mix(docs).select(*[f"`{c}`" for c in docs.columns]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids, their places in sequences and the position of their row in the mix.

    A document that the mix repeats is packed each time, under a position of its own. Pieces fill the sequences
    in the order of positions; sequences in the order of their least position are the curriculum. docs that
    aren't read from files have no positions and go by a digest.
    """
    try:
        position = packing.file_position()
        docs.select(position)
    except AnalysisException:
        position = None
    return packing.pack(docs, keep_ids=True, position=position)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("source_mix", mixing),
    ("packing", pack),
]
#: Signatures, bootstrapping and tokens are beyond SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; what each one returns is written to the shared folder and read again.

    The result reads the last table written, so a run's folder must stay as long as its result is in use.
    """
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
