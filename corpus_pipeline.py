"""Corpus pipeline: quality rules, near duplicates, secrets, mixing, pieces.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the next
table. Each stage works on all its predecessor kept, and each is written as Parquet and read
again. All but the last return the columns of ``docs`` as they came, whatever their names; the
operators see only the columns they need, the others travel in a struct.

Defined results: rows with null columns pass like others (a null text has no words and is rejected by the
quality rules); an empty table stays empty through all stages; of repeated rows and near
duplicates one stays; repeated or null doc_ids with different texts are different documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abode.llm import mixing, ngram_join, piece_sampling, quality_rules, secret_scan
from abode.llm.registry import documents, register
from abode.llm.token_counts import tokenizer_path
from abode.session import materialize

ORACLE_SQL = None  # components of near duplicates and sampled pieces have no practical SQL; see tests/llm

ROW = "_row"


def _wrapped(docs: DataFrame, *needed) -> DataFrame:
    """All columns as one struct, and those an operator reads beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), *needed)


def _unwrapped(rows: DataFrame) -> DataFrame:
    return rows.select(f"{ROW}.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _unwrapped(quality_rules.apply_rules(_wrapped(docs, "text")).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id."""
    return ngram_join.one_of_each_group(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets masked in the texts; n_chars follows."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in others]).alias(ROW), "text")
    rows = secret_scan.find_secrets(rows, redact=True)
    changed = F.size("secrets") > 0
    columns = {c: F.col(f"{ROW}.`{c}`") for c in others} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return rows.select(*[columns[c].alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target size asks."""
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.row_identity(docs).alias("_mx_id"))
    return mixing.emit_to(docs, mixing.mix(materialize(sized, "mix-sizes"), ties=("_mx_id",)))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each document, and whether they decode to its text."""
    path = tokenizer_path("piece_bpe_32k.model")
    coded = piece_sampling.encode_and_check(docs.select("doc_id", "source", "text"), path)
    return coded.select("doc_id", "source", F.size("ids").alias("n_pieces"), "ids", "lossless")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources", mix),
    ("sentencepiece", pieces),
]


@register("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
