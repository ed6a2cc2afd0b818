"""From raw documents to packed token sequences, one stage after the other.

Each stage is a function of (spark, docs, sf_dir) that works on all rows its predecessor kept
and returns the columns of ``documents``, but for the last, which returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import ngramjoin, packing, pii, quality
from quire.llm.common import small_batches, stored, table
from quire.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject.

    Null, empty and blank texts have no words and are dropped; texts of any length are judged
    whole; equal rows are judged alike and all of them kept or dropped; a null language is a
    language of its own; an empty table stays empty. Extra columns are carried as they are,
    whatever their names.
    """
    whole = docs.select("doc_id", "text", "lang", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    judged = quality.quality(whole, keep=("row",)).select("row", F.explode(F.array("kept")).alias("stays"))
    # the verdict is a generated column, so the filter stays above it: pushed down, it would compute each count for each use
    return judged.where("stays").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the least id.

    Documents without words (null, empty or blank texts) and rows with a null id stay; rows that
    repeat an id stay or go together; texts of any length are compared whole; an empty table
    stays empty; extra columns are carried as they are.
    """
    small_batches(spark)
    return ngramjoin.one_of_each(docs, ngramjoin.Settings(words=5, percent=75))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in every text.

    No row goes. A null text stays null and an empty one empty; equal texts are masked alike;
    texts of any length are read whole; an empty table stays empty; ``n_chars``, where there
    is one, is counted anew, and extra columns are carried as they are.
    """
    small_batches(spark)
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all documents into sequences of at most 4096.

    A null or empty text is one piece that holds only the end token; long texts are cut; equal
    rows take different places; an empty table gives no pieces; extra columns are not read.
    """
    small_batches(spark)
    return packing.packed(docs, vocabulary(), end=2, capacity=4096)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]

#: SQL expresses neither the stages' fits nor the packing; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
