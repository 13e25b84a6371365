"""The corpus pipeline: from raw documents to packed sequences, a table between each two stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table, written
from ledgerloom.llm.cotrain import keep_documents
from ledgerloom.llm.decontam import uncontaminated
from ledgerloom.llm.lines import without_repeats
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.simhash_wide import one_of_similar


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject.

    Null and empty texts and null metadata are scored as such; repeated rows are scored each; without labels of both
    classes all documents stay.
    """
    return keep_documents(docs, table(spark, sf_dir, "labels"), threshold=0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier line; a document that loses all its words goes. n_chars follows the text.

    Null and empty texts stay as they are. The earliest line is that of the smallest id, null ids last; of rows that
    repeat id and text one keeps its lines.
    """
    return without_repeats(docs, threshold=0.8, drop_emptied=True).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates: fingerprints of five-word shingles are compared bit-sliced,
    and pairs that they leave are linked at an exact similarity of 0.8.

    Null, empty and blank texts are one group. The first is that of the smallest id, null ids last; rows that repeat an
    id are documents of their own unless their texts are similar.
    """
    return one_of_similar(docs, shingle=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no passage resembles a benchmark item. Null and empty texts stay, as do repeated rows."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"), shingle=5, threshold=0.8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 4096. Null and empty texts are one end token; repeated
    rows and null ids are documents of their own."""
    return pack_documents(docs, capacity=4096, end_id=2, with_ids=False)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: no stage but the line splitting of the second has an equivalent in SQL; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over the table that the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
