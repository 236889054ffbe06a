"""The corpus pipeline: ``documents`` through five stages of ``trackloom.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm.common import cleared, discard, materialize, read_table
from trackloom.llm.lines import dedup_lines
from trackloom.llm.mixing import mixed_documents
from trackloom.llm.packing import pack
from trackloom.llm.quality import classify_quality
from trackloom.llm.simhash import keep_first


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of probable good quality stay."""
    names = docs.columns
    return classify_quality(docs, read_table(spark, sf_dir, "labels")).where("kept").select(*names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go; every document stays, n_chars follows its text."""
    return dedup_lines(docs, chars_col="n_chars").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return keep_first(docs, shingle=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights: documents are repeated or cut as the mix takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The classifier and the packing cannot be told in SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  What a stage wrote on its way is deleted once its result is
    written, and so is the stage before's; what the last one reads stays, as its rows are yet to be read."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with cleared(spark) as kept:
            before, docs = docs, materialize(stage(spark, docs, sf_dir))
            kept.append(docs)
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
