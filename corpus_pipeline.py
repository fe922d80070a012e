"""The corpus pipeline: stages over documents, each handed on as Parquet.

Every stage takes whole texts of any length, keeps the columns it finds (the last one returns
pieces) and returns no rows for an empty table. Null ids are handled as ids of their own; what
becomes of null and empty texts, ties and repeated rows is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabwright.llm.common import written
from tabwright.llm.decontaminate import without_leaks
from tabwright.llm.language_id import reject_unknown
from tabwright.llm.line_dedup import without_repeats
from tabwright.llm.near_dedup import keep_one_of_each
from tabwright.llm.packing import pack
from tabwright.llm.queries import SEQUENCE, TOKENIZER, table

NEAR_PERCENT = 80  # lower than in op10_minhash, which has a contract of its own

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language that the model holds likely. Null and empty texts, and texts
    without a letter, have none and go; repeated rows stay or go together."""
    return reject_unknown(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of lines that repeat are kept once, where the id is least (null first); texts made
    of such passages alone go. Null and empty texts repeat nothing and stay."""
    return without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, those with NEAR_PERCENT of their shingles in
    common: the one with the least id. Null and empty texts are linked with nothing and stay;
    rows that repeat that id and text stay all."""
    return keep_one_of_each(docs, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. Null and empty texts leak nothing; repeated rows stay
    or go together."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. A null or empty text is its closing id alone; repeated
    rows are packed each."""
    return pack(docs, TOKENIZER, SEQUENCE)


STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing),
]

# The stages work on models and iterations that SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
