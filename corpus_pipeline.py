"""A pipeline that prepares training text: each stage works on all documents that the one before it kept.

Every stage but the last returns the columns it was given. Defined cases: a document without text or without a letter goes in
the first stage; null ids, languages and sources are kept as they are; rows that share an id, or have none, are told apart by
their texts, and of repeated rows one stays; of near-duplicates the one with the smallest id (null first) and then the smallest
hash of its text stays; texts of any length are worked on whole; an empty table gives an empty result; other columns, whatever
their names, are carried along to the last stage.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontamination, language_id, line_dedup, near_dedup, sentencepiece_codec
from textloom.llm.common import NULL_ID, documents, stored

#: The stages need more than SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def _plain(docs: DataFrame, *named: str) -> tuple[DataFrame, tuple[str, ...]]:
    """docs with every column but the named ones under a name that no operator uses, and these names."""
    others = [c for c in docs.columns if c not in named]
    names = tuple(f"other_{i}" for i in range(len(others)))
    return docs.select(*named, *[F.col(f"`{c}`").alias(n) for c, n in zip(others, names, strict=True)]), names


def _given(found: DataFrame, docs: DataFrame, *named: str) -> DataFrame:
    """The columns of docs again."""
    others = iter(range(len(docs.columns)))
    return found.select(*[F.col(c) if c in named else F.col(f"other_{next(others)}").alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (no text, no letter, nothing learned) go; a missing lang is filled in."""
    plain, others = _plain(docs, "doc_id", "text", "lang")
    learn = language_id.fold_of(F.col("id")) != 2
    found = language_id.language_of(plain, learn, carry=("doc_id", "text", "lang", *others))
    kept = found.where(F.col("lang_pred") != language_id.UNKNOWN)
    return _given(kept.withColumn("lang", F.coalesce("lang", "lang_pred")), docs, "doc_id", "text", "lang")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    plain, others = _plain(docs, "doc_id", "text")
    found = _given(line_dedup.dedup_lines(plain, carry=others), docs, "doc_id", "text")
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, once. What is decided holds for a row (id and hash of its text), not for its id."""
    row = {"kept_key": F.coalesce("doc_id", F.lit(NULL_ID)).cast("long"), "tie": F.xxhash64("text")}
    kept = near_dedup.near_duplicates(docs, ties=True).where("first").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("kept_key"), "tie").distinct()
    plain, _ = _plain(docs, "doc_id", "text")
    left = plain.withColumns(row).join(kept, list(row), "left_semi")
    # Repeated rows lie together already.
    return _given(left.dropDuplicates(list(row)), docs, "doc_id", "text")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    plain, others = _plain(docs, "doc_id", "text")
    found = decontamination.decontaminated(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=("text", *others))
    return _given(found.where(~F.col("contaminated")), docs, "doc_id", "text")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the text as SentencePiece ids; whether decoding gave the text back."""
    found = sentencepiece_codec.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), carry=("lang", "source"))
    return found.select("doc_id", "lang", "source", "n_pieces", "ids", "ids_crc32", "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
