"""The corpus pipeline: five stages over ``documents``, each an operator of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import decontamination, language_id, near_copies, sentencepiece_viterbi, toxicity
from lexweave.llm._common import dealt, numbered, stored, table
from lexweave.llm.queries import tokenizer

#: Share of a text's n-grams that its language must contain.
LEAST_LANGUAGE_SCORE = 0.2


#: Holds a whole document beside the verdict on it, or tells the rows apart.
ROW = "_row"


def _judged(docs: DataFrame) -> DataFrame:
    """The documents' texts, each with its whole document for an id: a verdict meets its row, whatever the row's id."""
    return docs.select(F.struct(*docs.columns).alias(ROW), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose expected severity reaches the operator's limit."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade(_judged(docs), model, id_col=ROW).where("not toxic").select(f"{ROW}.*")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those of which no language contains enough n-grams."""
    found = language_id.predict(_judged(docs), language_id.train(docs), id_col=ROW)
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.where(known).select(f"{ROW}.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near copies (SimHash, five-word Jaccard from 0.8)."""
    return near_copies.dedup(numbered(docs, ROW), row_col=ROW).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that leak a benchmark item."""
    found = decontamination.contamination(_judged(docs), table(spark, sf_dir, "benchmark"), id_col=ROW)
    return found.where("not contaminated").select(f"{ROW}.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, pieces_xxh64, restored) of every document that is left."""
    return sentencepiece_viterbi.digest(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: Trained models, iteration and tokenizers: not in SQL's reach. tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's rows are stored in the shared folder before the next."""
    docs = dealt(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
