"""Corpus preparation: documents in, a mixed and deduplicated corpus of token ids out.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame, which is written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import jaccard, language, mixing, pieces, suffixes
from auditloom.llm.common import folds, staged, table
from auditloom.llm.queries import MIX_MOST, MIX_WEIGHTS, PIECE_MODEL

LEAST_SCORE = 0.5  # of the language found among all
LEAST_FAMILIAR = 0.25  # share of known words against the language's usual one; less is no learned language
REPEAT_WORDS = 51
REPEAT_BYTES = 2 * REPEAT_WORDS - 1  # so many words take at least as many bytes
LONG_BYTES = 400  # repeats that go whatever words they hold: some scripts do not part words


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones too), texts whose best language is not
    even likely, and texts with few known words for their length. Judged row by row, so repeated
    rows share their fate; a very long text is judged whole. An empty table stays empty, and
    without labelled rows nothing can be kept."""
    model = language.fit(docs.where(~folds()))
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no name can clash
    found = language.identify(numbered, model, f"c{docs.columns.index('text')}")
    kept = found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
                       & (F.col("familiar") >= LEAST_FAMILIAR))
    return kept.select(numbered.columns).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return jaccard.one_of_each(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated strings of more than 50 words out of the texts. A character cut in two is
    replaced by U+FFFD; a text that consists of repeats becomes empty and stays."""
    cleaned = suffixes.remove_repeats(docs, REPEAT_BYTES, words=REPEAT_WORDS, enough=LONG_BYTES)
    whole = F.size("spans") == 0
    text = F.when(whole, F.col("text")).otherwise(F.make_valid_utf8(F.col("kept").cast("string")))
    return cleaned.withColumn("text", text).withColumn(
        "n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    ).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents until the sources have their target words."""
    mixed = mixing.mix(docs, MIX_WEIGHTS, MIX_MOST).where("copies > 0")
    again = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return mixed.withColumn("_copy", again).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    tokens = pieces.encoded(docs.select("doc_id", "source", "text"), pieces.load(PIECE_MODEL))
    return tokens.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language id", language_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeat_stage),
    ("source mix", mix_stage),
    ("sentencepiece", token_stage),
]

ORACLE_SQL = None  # models, components and copies have no SQL form; tests hold brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
