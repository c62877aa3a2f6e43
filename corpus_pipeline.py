"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all documents the stage before kept and
returns a DataFrame; `run` writes every stage's result to the shared folder and reads it
again as the next one's documents. All but the last return the columns of `documents`.

1. language: documents without letters or unlike every learned language go.
2. lines: long lines that many documents share stay in the last of them only.
3. near_duplicates: one document of each group of near copies (five-word shingles, similarity 0.8) stays.
4. mix: sources are taken to their target weights; a document may come twice or not at all.
5. pack: the mix as token pieces packed into sequences.

Every stage takes an empty table and gives one back, looks at texts of any length whole, gives repeated rows the same
decision and says below what it does with nulls, empty texts and ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from imgtrace.llm import language, line_dedup, minhash, mixing, packing
from imgtrace.llm.tables import materialize, table


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a learned language. Null, empty and letterless texts go; null langs are not learned from; of equal scores the first name wins."""
    return language.recognised(docs)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with fewer lines. A null text stays null, an empty one is one empty line; rows that share a doc_id each count, a null doc_id is below all others."""
    return line_dedup.drop_lines(docs).select(*docs.columns)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents that with the smallest doc_id. Texts without words link with nothing and stay; rows without a doc_id are documents of their own."""
    return minhash.one_of_each(docs, width=5, percent=80)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it. A null source is a source, after all others; a null or empty text has no words; ties go by doc_id and text."""
    return mixing.mixed_documents(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places. A null or empty text is its end token; equal lengths take places in any order, each its own."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", _language), ("lines", _lines), ("near_duplicates", _near_duplicates), ("mix", _mix), ("pack", _pack),
]

#: Stages 1, 3 and 5 have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
