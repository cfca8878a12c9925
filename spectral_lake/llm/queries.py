"""Registered queries of the text operators: whole tables, production parameters."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, edit_fingerprint, html_extract, language_mixture, license_scan, minhash, mixing, ngram_join, quality_rules, source_divergence, suffix_dedup, toxicity, vector_codes
from .common import materialise, table

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
RANKS = "byte_bpe_multi_50k.tiktoken"


def public_tokenizers(folder: str = TOKENIZERS):
    """The module that describes the vocabulary files in ``folder``."""
    spec = importlib.util.spec_from_file_location("public_tokenizers", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs.select("doc_id", "text"), toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string")) % 4).alias("part"))
    model = language_mixture.train(docs.where("part <> 2"))
    out = language_mixture.identify(docs.select("doc_id", "text", F.coalesce(F.col("part") == 2, F.lit(False)).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "mixture")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeats_and_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # besides the contract's columns: what repeats at 250 bytes, the least that 50 words of prose take
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"), "n_passage_bytes", "n_passages", "passage_free_text")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    public = public_tokenizers()
    ranks = public.path(RANKS)
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public.PATTERN), ranks)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialise(edit_fingerprint.edited_fingerprints(table(spark, sf_dir, "documents")))
    return prints.join(edit_fingerprint.near_classes(prints), "fingerprint").select(*prints.columns, "near_class")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"), words=4, percent=85)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = vector_codes.train(vectors)
    out = vector_codes.with_label_error(vector_codes.encode(vectors, books))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).alias("codebooks_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality_rules, op3_mixing, op4_language_id, op5_minhash_dedup, op6_suffix_dedup, op7_html_extract, op8_byte_bpe, op9_edit_fingerprint, op10_license_scan, op11_ngram_join, op12_vector_codes, op13_source_divergence)}
ORACLES = {
    "op2_quality_rules": quality_rules.rules_sql(),
    "op5_minhash_dedup": f"SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM ({ngram_join.linked_sql(5, 85)})",
    "op11_ngram_join": ngram_join.linked_sql(4, 85),
    "op12_vector_codes": vector_codes.codes_sql(),
    "op13_source_divergence": source_divergence.divergence_sql(),
}
