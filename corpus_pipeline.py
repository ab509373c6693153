"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. ``run`` chains them as the
driver does: each result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import best_fit, langid, line_dedup, simhash, toxicity
from weftline.llm.common import fresh, materialize
from weftline.llm.queries import id_crc, table, tokenizer_path


def kept(docs: DataFrame, found: DataFrame, new: list[str], condition: Column) -> DataFrame:
    """The columns of ``docs`` of the rows of ``found`` (those columns, then ``new`` ones) where the condition holds."""
    return found.where(condition).drop(*new).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the model knows a word or an n-gram: null, empty and letterless texts go, and those of no learned language.

    Repeated rows stay repeated, an empty table stays empty; without any labelled row no document is known. Columns
    beside doc_id, text and lang are carried along, whatever their names.
    """
    model = langid.train(docs, id_crc() % 3 != 1)
    new = [fresh(docs.columns, name) for name in ("lang_pred", "lang_score", "lang_known")]
    found = langid.identify(docs, model, keep=docs.columns, names=tuple(new))
    return kept(docs, found, new, (F.col(new[0]) != "und") & (F.col(new[2]) > 0))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; null and empty texts are judged by the bias alone.

    Repeated rows stay or go together, an empty table stays empty; without labels all stay. Columns beside doc_id
    and text are carried along, whatever their names.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), id_crc() % 5 != 0)
    new = fresh(docs.columns, "toxicity")
    return kept(docs, toxicity.score(docs, model, keep=docs.columns, name=new), [new], F.col(new) < 0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each line of the corpus that nearly repeats another kept once; n_chars follows the text.

    Null texts stay null, a text all of whose lines go becomes empty; rows that repeat id and text keep the same
    lines; of equal lines the first by doc_id and place stays. Other columns are untouched.
    """
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that with the least doc_id; null and empty texts are one component.

    Rows that repeat a doc_id stay or go together; rows without doc_id stay only where no other is in their component.
    """
    return simhash.keep_one_per_component(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences; a null or empty text is its end id alone."""
    return best_fit.best_fit_packing(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("best_fit_packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
