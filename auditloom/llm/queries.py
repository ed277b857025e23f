"""Registered queries of the operators; each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import covertree, jaccard, language, licences, lines, mixing, phrases
from auditloom.llm import pieces, quality, ranking, rpforest, sharding, suffixes
from auditloom.llm.common import folds, table

SHARDS = 40
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MIX_WEIGHTS, MIX_MOST = [5.0, 2.0, 1.0], 3


def op1_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf, "embeddings"), 0.98)


def op2_sharding(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = sharding.numbered(sharding.place(docs, SHARDS), "shard", "doc_id", "text_crc32")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = language.fit(docs.where(~folds()))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", folds().alias("held_out"), "lang_pred", "score")


def op4_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    removed = F.aggregate(
        "spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return suffixes.remove_repeats(docs, 400).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def op5_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return rpforest.neighbours(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf, "labels").where(~folds()))
    return quality.scored(docs, model).select(
        "doc_id", folds().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    model = pieces.load(PIECE_MODEL)
    tokens = pieces.encoded(table(spark, sf, "documents").select("doc_id", "text"), model, verify=True)
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def op8_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licences.scan(table(spark, sf, "documents"))


def op9_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf, "documents")).select(
        "doc_id", "n_shingles", "component_id")


def op10_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"), MIX_WEIGHTS, MIX_MOST)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 20)


def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


def op13_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lines.drop_repeated(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    q.__name__: q for q in (
        op1_embedding_dedup, op2_sharding, op3_language_id, op4_suffix_dedup,
        op5_nearest_neighbours, op6_quality, op7_sentencepiece,
        op8_licence_scan,
        op9_jaccard_join, op10_source_mix, op11_ranked_search, op12_collocations, op13_line_dedup,
    )
}

SQL: dict[str, str] = {
    "op8_licence_scan": licences.scan_sql(),
    "op11_ranked_search": ranking.ranked_sql(20),
    "op12_collocations": phrases.collocations_sql(),
    "op13_line_dedup": lines.dedup_sql(),
}
