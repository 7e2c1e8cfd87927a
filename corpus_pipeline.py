"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and gives the documents that go on, with the columns of ``documents``; the
last gives the encoded documents. Rows of stages keep their doc_id; a document that the mix takes twice is there
twice, and one that it takes in part is there as these parts. Null texts fail the quality rules and go; empty tables
pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import linededup, mixing, pieces, quality, simhash
from tessera.llm.common import Tables, materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_text(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return docs.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return judged.where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that they share with earlier ones; those without a word left go."""
    done = linededup.dedup(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return with_text(done)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (by doc_id) of each group whose SimHash fingerprints are linked, as in ``op6_simhash``."""
    return simhash.representatives(docs).select(*COLUMNS)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: whole, and where a pass takes only some of its blocks, a row for each run of them."""
    return with_text(mixing.resample(docs))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_chars, n_chunks, n_tokens, ids_crc32, round_trip and the ids of every document of the mix."""
    import public_tokenizers

    return pieces.encode(docs.drop("n_chars"), public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "source"), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing_to_weights),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Thresholds from exact binomial bounds, alignments, fingerprints and piece scans have no SQL form: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded documents of the mix. What the stages write on the way goes as soon as their rows are stored; the tables that the
    result reads are its own: ``tessera.llm.common.release`` deletes them when it is stored."""
    docs, left = table(spark, sf_dir, "documents"), Tables(spark)
    for name, stage in STAGES[:-1]:
        with Tables(spark) as own:
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
        own.drop(keep=docs)
        left.drop()
        left = own
    with Tables(spark) as own:
        out = STAGES[-1][1](spark, docs, sf_dir)
    out._tessera_tables = [left, own]
    return out
