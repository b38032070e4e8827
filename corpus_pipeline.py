"""Cleaning of a training corpus: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspan.llm.bpe import bpe_round_trip
from larkspan.llm.common import ship, table, written
from larkspan.llm.decontamination import without_contamination
from larkspan.llm.exact_dedup import without_copies
from larkspan.llm.jaccard import without_near_copies
from larkspan.llm.registry import vocabulary
from larkspan.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon does not reject.

    Rows are judged each by their text, repeated ones and those with a null id
    too; a null or empty text has no hits and stays.  Without labels all stay;
    an empty table stays empty.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of texts that are equal but for white space: the longest, of equally long ones that with the smallest id.

    A null text counts as empty.  Rows with a null id stay; of rows that repeat
    id and text one stays.  An empty table stays empty.
    """
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group linked by a Jaccard similarity of 0.8 on five-word shingles.

    Rows with a null id and texts without a word stay; rows that repeat an id
    stay or go together.  An empty table stays empty.
    """
    return without_near_copies(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away.

    Rows are judged each by their text, repeated ones and those with a null id
    too; null and wordless texts stay.  An empty table stays empty; an empty
    benchmark changes nothing.  What is left is written in the stage itself, so
    that its texts pass through Python in small batches.
    """
    return written(without_contamination(docs, table(spark, sf_dir, "benchmark")), "clean")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each document that is left.

    A null text counts as empty and has no tokens; repeated rows give repeated
    results, a null id stays null.  An empty table stays empty.
    """
    return bpe_round_trip(docs, vocabulary(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", tokens),
]

#: No stage but the second can be said in SQL; the stages are held against brute force one by one, run() against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        docs = kept if hasattr(kept, "written_to") else written(kept, f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
