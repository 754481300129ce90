"""The queries of this package over the corpus tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fill_middle, fingerprints, html_text, language, mixing, near_dedup, packing, pieces, quality, search, spelling, token_store
from .common import read, tokenizer_path, written


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_digest(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(read(spark, sf_dir, "conversations"))
    return chat.read_back(written(chat.format_windows(turns, tokenizer_path("byte_bpe_50k.json")), "chat-windows"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", language.held_out(4, 2))
    model = language.learn(docs.where(~F.col("held_out")))
    return language.identify(docs, model, ("doc_id", "held_out"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", language.held_out(5, 0))
    model = quality.learn(docs.where(~F.col("held_out")), read(spark, sf_dir, "labels"))
    return quality.score(docs, model, ("doc_id", "held_out"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the whole documents whose doc_id is divisible by 20, against all documents."""
    docs = read(spark, sf_dir, "documents")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search.bm25_topk(docs, asked).withColumn("score", F.round("score", 6))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_neighbours(read(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(read(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(read(spark, sf_dir, "documents"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_near_dedup, op2_html_text, op3_token_store, op4_chat_windows, op5_language, op6_quality, op7_mixing, op8_packing, op9_bm25_documents, op10_fingerprints, op11_fill_middle, op12_spelling, op13_pieces)}
ORACLES: dict[str, str] = {"op7_mixing": mixing.SQL, "op9_bm25_documents": search.SQL, "op11_fill_middle": fill_middle.SQL}
