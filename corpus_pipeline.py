"""From documents to packed sequences: five stages, each one of the corpus operators.

Each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.llm import exact_dedup, near_copies, packing, quality, secret_scan
from callgauge.llm.common import table, written
from callgauge.llm.queries import tokenizer_file


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    A null or empty text is scored like any; a repeated id stays if one of its texts does, with all its rows; a null id
    is scored by its texts alike. Without enough labels all stay. Any length is read whole. Empty table: no rows.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def first_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the row of the smallest id.

    A null text equals an empty one; a null id ranks behind every id; of rows that repeat with id and text one stays. Any
    length is compared whole. Empty table: no rows.
    """
    return exact_dedup.keep_first(docs)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group joined by pairs that share 0.8 or more of their five-word shingles.

    SimHash fingerprints within 3 bits, found by vantage-point trees as in operator 2, only propose the pairs; the exact Jaccard
    similarity of their shingles decides. A text has one fingerprint of its own and 20 of drawn shingles. Texts of fewer
    than five words are one shingle; null texts and those without a word are alike. A repeated id goes by its
    own text; a null id ranks behind every id. Empty table: no rows.
    """
    return near_copies.keep_one(docs, words=5, similarity=0.8)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets replaced by their kind; n_chars follows the text where that changed.

    Null and empty texts stay as they are, copies are all redacted, null and repeated ids are no matter, as texts are
    told apart by their hash. Empty table: no rows.
    """
    clean = secret_scan.redact(docs.withColumn("_cg_before", F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("text").eqNullSafe(F.col("_cg_before")), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return clean.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and places in sequences of 2048.

    A null or empty text is a piece of the end id alone; a long one is cut into as many pieces as it needs; null and
    repeated ids are packed like any. Empty table: no rows.
    """
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), width=2048, end_id=1)


STAGES = [
    ("quality classifier", good),
    ("exact dedup", first_of_equal),
    ("SimHash near-dedup", one_of_near),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: The classifier, the near-duplicates and the packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
