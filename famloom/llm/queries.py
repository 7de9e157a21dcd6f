"""One query per operator over the driver's tables, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from famloom.llm import (
    decontaminate,
    exact_dedup,
    hard_negatives,
    html_text,
    language_id,
    line_dedup,
    minhash,
    packing,
    phrases,
    secrets,
    suffix_dedup,
    token_files,
    warc,
)
from famloom.llm.common import table


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    path = token_files.new_folder(spark, "warc")
    warc.write_archives(pages, path, min_bytes=0)
    warc.build_index(spark, path)
    records = warc.fetch(spark, path, warc.lookup(spark, path, pages))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.without_repeats(table(spark, folder, "documents"), span=200, keep="none")
    return suffix_dedup.digest_rows(cut)


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = line_dedup.without_repeated_lines(
        table(spark, folder, "documents"), min_words=line_dedup.PASSAGE_WORDS
    )
    return line_dedup.digest_rows(cut)


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"), keep="largest")


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pieces_of(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )
    return packing.pack(pieces)


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "documents"))


def op8_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.languages_of(table(spark, folder, "documents"))


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = token_files.new_folder(spark, "token_files")
    token_files.write_token_files(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path
    )
    return token_files.read_token_files(spark, path)


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    swapped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.quantized(table(spark, folder, "embeddings"), scale=256, label=swapped)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(table(spark, folder, "pages"))


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, folder, "documents"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_packing": op6_packing,
    "op7_secrets": op7_secrets,
    "op8_minhash": op8_minhash,
    "op9_language_id": op9_language_id,
    "op10_token_files": op10_token_files,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_html_text": op12_html_text,
    "op13_phrases": op13_phrases,
}

ORACLES = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op13_phrases": phrases.ORACLE,
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER copies AS keep_id, count(*) OVER copies AS group_size,
               doc_id = max(doc_id) OVER copies AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW copies AS (PARTITION BY coalesce(text, ''))""",
}
