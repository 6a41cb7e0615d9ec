"""The queries of this subpackage: each derives its columns from the rows of one operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelab.llm import bpe, decontaminate, fertility, hilbert, html, resampling, simhash, surrogates, tokenfiles, topk, toxicity, warc, whitening
from ratelab.llm.frames import shared_folder
from ratelab.llm.sql import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES = SQL


def query(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
    """Register a function of a table reader under its own name."""
    QUERIES[build.__name__] = lambda spark, folder: build(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))
    return build


def bpe_vocabulary() -> bpe.Vocabulary:
    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op1_simhash_near_dedup(table):
    return simhash.near_duplicates(table("documents")).select("doc_id", "fingerprint", "component_id")


def bpe_digests(docs: DataFrame) -> DataFrame:
    vocabulary = bpe_vocabulary()
    done = bpe.decode(bpe.encode(docs, vocabulary), vocabulary)
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_byte_level_bpe(table):
    return bpe_digests(table("documents"))


@query
def op5_toxicity(table):
    docs = table("documents")
    model = toxicity.train(toxicity.labelled_sample(docs, table("labels")))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return toxicity.scores(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


@query
def op8_pii_surrogates(table):
    done = surrogates.pseudonymize(table("documents"), details="replaced")
    return done.select("doc_id", "text", F.size("replaced").cast("long").alias("n_replaced"),
                       F.transform("replaced", lambda r: r["kind"]).alias("kinds"),
                       F.transform("replaced", lambda r: r["replacement"]).alias("replacements"))


@query
def op9_decontamination(table):
    found = decontaminate.find_windows(table("documents"), table("benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"))


@query
def op2_exact_top_k(table):
    vectors = table("embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"))


@query
def op4_warc(table):
    pages = table("pages")
    folder = shared_folder(pages.sparkSession, "warc")
    found = warc.read(warc.write(pages, folder), folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"), "problem")


@query
def op6_hilbert_sharding(table):
    placed = hilbert.shard_documents(table("documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_token_files(table):
    docs = table("documents")
    folder = shared_folder(docs.sparkSession, "tokens")
    found = tokenfiles.read(tokenfiles.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json")), folder)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op10_html_extraction(table):
    return html.extract(table("pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_embedding_whitening(table):
    return whitening.whiten(table("embeddings"))


@query
def op13_importance_resampling(table):
    return resampling.resample(table("documents"), table("benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def fertility_vocabularies() -> fertility.Vocabularies:
    return fertility.Vocabularies(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_tokeniser_fertility(table):
    return fertility.judge(table("documents"), fertility_vocabularies()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "language", "chars_per_token", "chars_per_piece", "byte_share", "entropy")
