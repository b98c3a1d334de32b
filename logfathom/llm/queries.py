"""Each operator of the package as a query over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfathom.plans.scale import work_path

from . import (alignment, bpe, dedup, jaccard, licenses, line_dedup, packing, sharding, token_counts, topk,
               toxicity, warc, whitening)
from .common import staged, table, text_of


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four commits: all documents arrive, arrive again (a retry, which changes
    nothing), repeats of equal texts leave, and the others are counted anew with an end id."""
    docs = table(spark, sf_dir, "documents")
    counted = staged(token_counts.token_count(
        docs.select("doc_id", "source", "lang", "text"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
        .withColumn("digest", F.unhex(F.sha2(text_of(), 256)))
        .drop("text").withColumn("tokenizer", F.lit("byte_bpe_50k"))
        .withColumn("row_no", F.monotonically_increasing_id()), "token-counts")
    # Of equal texts the row with the largest doc_id is kept; a null doc_id loses against any other.
    winners = counted.groupBy("digest").agg(
        F.max(F.struct("doc_id", "row_no")).alias("best")).select(
        F.col("best.row_no").alias("row_no"), F.lit(True).alias("kept"))
    marked = staged(counted.join(winners, "row_no", "left").withColumn(
        "kept", F.col("kept").isNotNull()), "kept-counts")
    none = F.lit(None).cast("long").alias("old_tokens")
    store = token_counts.TokenTotals(spark, work_path(spark, "token-totals"))
    arrived = counted.select(*token_counts.KEYS, F.lit(token_counts.INSERT).alias("change"),
                             "tokens", none)
    store.commit("load", arrived)
    store.commit("load", arrived)
    store.commit("repeats", marked.filter("NOT kept").select(
        *token_counts.KEYS, F.lit(token_counts.DELETE).alias("change"), "tokens", none))
    store.commit("end-ids", marked.filter("kept").select(
        *token_counts.KEYS, F.lit(token_counts.REVISE).alias("change"),
        (F.col("tokens") + 1).alias("tokens"), F.col("tokens").alias("old_tokens")))
    return store.totals()


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("word_bpe_49k.json"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.even_tree(24)
    return sharding.assign(table(spark, sf_dir, "documents"), tree,
                           sharding.with_region(tree, "region-new", 24))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"),
                                public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                public_tokenizers.PATTERN)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn(
        "deviation", F.col("deviation").cast("long"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_exact_dedup, op2_token_counts, op3_packing, op4_sharding, op5_jaccard_join, op6_warc, op7_licenses,
        op8_toxicity, op9_byte_bpe, op10_top_k, op11_whitening, op12_line_dedup, op13_alignment)}
