"""Corpus cleaning in five stages over documents (doc_id, text, lang, source, n_chars).

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's docs. All but the last return docs' own columns,
n_chars being that of the new text. Rows without a doc_id and rows that share one are judged by their
own texts; of rows with the same doc_id and text, one is left after the near-copy stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnfold.llm.common import documents, stored, table
from returnfold.llm.langid import held_out, learn, predict
from returnfold.llm.line_templates import drop_templates
from returnfold.llm.near_copies import one_of_each
from returnfold.llm.packing import CAPACITY, pack, token_pieces
from returnfold.llm.suffix_dedup import removals
from returnfold.llm.words import tokenizer_path


def _own(docs: DataFrame) -> DataFrame:
    """docs with all columns but doc_id and text renamed, so that none clashes with a stage's own."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"_own{i}" for i, c in enumerate(docs.columns)))


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows with docs' columns again, in their order; n_chars anew."""
    names = [c if c in ("doc_id", "text") else f"_own{i}" for i, c in enumerate(docs.columns)]
    return rows.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(n).alias(c) for n, c in zip(names, docs.columns)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no letters, or unlike any learned language."""
    models = learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(~held_out()))
    return _back(predict(_own(docs), models).where("not rejected"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates, and documents that consist of nothing else."""
    return _back(drop_templates(_own(docs)).where("emptied is null or not emptied"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near copies the document of least doc_id."""
    return _back(one_of_each(_own(docs)), docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops strings of 50 bytes that start in earlier documents, and documents of which nothing stays.

    Of a character that is cut in two, nothing stays.
    """
    left = removals(documents(docs), with_text=True).where("n_removed < n_bytes or n_bytes = 0")
    names = lambda df, md5: df.withColumns({"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_md5": md5})
    kept = names(left, F.col("text_md5")).dropDuplicates(["_id", "_md5"]).select("_id", "_md5", F.col("kept").alias("text"))
    own = names(_own(docs), F.md5(F.coalesce("text", F.lit(""))))
    return _back(own.drop("text").join(kept, ["_id", "_md5"]), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): the documents packed into sequences."""
    return pack(stored(token_pieces(documents(docs), tokenizer_path("word_bpe_49k.json"), 1, CAPACITY), "pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", packing),
]

#: Kneser-Ney models, ProbMinHash, suffix sorting and the genetic algorithm have no SQL form; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
