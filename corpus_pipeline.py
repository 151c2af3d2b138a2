"""The filtering pipeline over documents: STAGES in order, each written as Parquet and read again for the next.

Every stage takes the rows that the stage before kept, judges each by its own text, and returns the columns of its
input (the last one the columns of packed pieces), whatever other columns there are. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.llm.decontam import drop_leaks
from linkloom.llm.line_dedup import drop_repeated_lines
from linkloom.llm.ngram_join import keep_one_each
from linkloom.llm.packing import pack_documents
from linkloom.llm.tables import settle, table
from linkloom.llm.toxicity import score_toxicity


def toxicity(spark, docs, sf_dir):
    """Documents that the model calls toxic go.

    A null or empty text has the score of no terms; a long text is read whole; rows that repeat, or whose ids are null or
    repeat, are judged one by one; a score of exactly 0.5 goes.
    """
    return score_toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*docs.columns)


def line_dedup(spark, docs, sf_dir):
    """Repeated lines go; n_chars follows the text.

    A null or empty text stays as it is; a text that loses all its lines becomes empty and stays; rows that repeat with
    one id are one document, and a null id comes after all others; of the documents that hold a line the smallest id
    keeps it, so there are no ties.
    """
    found = drop_repeated_lines(docs)
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).select(*docs.columns)


def ngram_jaccard(spark, docs, sf_dir):
    """One document of each group of near duplicates stays, that with the smallest id.

    Null texts and texts without words are linked with nothing and stay; of rows that repeat one stays; of null or equal
    ids the smallest hash of the text stays.
    """
    return keep_one_each(docs).select(*docs.columns)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a test item go.

    Null and empty texts hold none and stay; rows that repeat, or whose ids are null or repeat, are judged one by one;
    half of an item covered is enough to go.
    """
    return drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing(spark, docs, sf_dir):
    """The documents as packed pieces.

    A null or empty text is one end token; a long text is cut into pieces; rows that repeat, or whose ids are null or
    repeat, are documents of their own; pieces of equal length are packed in the order of id and piece.
    """
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("packing", packing)]
#: SQL can express neither the model of the first stage nor the tokens of the last.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
