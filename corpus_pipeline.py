"""From raw documents to tokens: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectral_lake.llm import bpe, minhash, mixing, quality_rules, suffix_dedup
from spectral_lake.llm.common import materialise, sweep, table
from spectral_lake.llm.queries import RANKS, public_tokenizers

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.apply_rules(docs).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, at similarity 0.8 or more on 5-word shingles: the one with the least doc_id."""
    return minhash.one_of_each(docs, percent=80).select(*COLUMNS)


#: Bytes of a passage that counts as repeated: what 50 words of prose take at least.
PASSAGE = 250


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of ``PASSAGE`` bytes that stand elsewhere too.

    A cut may split a character; its bytes on either side are dropped.  A text that is removed
    whole stays as an empty one, with size 0, which the next stage takes zero times.
    """
    out = suffix_dedup.remove_repeats(docs, PASSAGE, gram=62, text=True).withColumnRenamed("kept_text", "text")
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_documents(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and a digest of what they decode to."""
    public = public_tokenizers()
    ranks = public.path(RANKS)
    out = bpe.decode(bpe.encode(docs, ranks, public.PATTERN), ranks)
    return out.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("MinHash near-dedup", near_dedup), ("suffix-array dedup", repeats), ("mixing sources to target weights", mix), ("byte-level BPE", tokens)]

#: Stages 2 to 5 are beyond SQL; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again, its intermediate tables removed."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        sweep(spark, keep=docs)
    return docs
