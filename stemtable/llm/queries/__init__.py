"""The registered queries of this package: name -> (function, SQL twin or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtable.llm import (
    chat_format,
    collocations,
    decontaminate,
    html_extract,
    language_id,
    license_scan,
    mixing,
    ngram_join,
    quality_rules,
    substring_dedup,
    suffix_array_dedup,
    url_filter,
    vector_codes,
)
from stemtable.llm.frames import literal_table, table
from stemtable.llm.queries import sql


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    held_out = F.coalesce(held_out, F.lit(False))
    model = language_id.train(docs.filter(~held_out))
    named = language_id.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs, table(spark, sf_dir, "labels")).drop("text")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digested(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_array_dedup.digested(suffix_array_dedup.suffix_array_dedup(docs, window=400, keep_first=False))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.html_extract(pages, html_extract.train(pages))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.digested(substring_dedup.substring_dedup(docs, window=20))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = literal_table(spark, sql.PROBE, "conv_id long, turn long, role string, text string")
    return chat_format.digested(chat_format.windows(rows.unionByName(probe)))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded, book, _ = vector_codes.compress(vectors)
    return vector_codes.digested(coded, book)


QUERIES = {
    "op1_language_id": (op1_language_id, None),
    "op2_ngram_join": (op2_ngram_join, None),
    "op3_quality_rules": (op3_quality_rules, None),
    "op4_decontaminate": (op4_decontaminate, None),
    "op5_url_filter": (op5_url_filter, url_filter.oracle_sql()),
    "op6_suffix_array_dedup": (op6_suffix_array_dedup, None),
    "op7_html_extract": (op7_html_extract, None),
    "op8_mixing": (op8_mixing, sql.MIXING),
    "op9_license_scan": (op9_license_scan, None),
    "op10_substring_dedup": (op10_substring_dedup, None),
    "op11_collocations": (op11_collocations, sql.collocations()),
    "op12_chat_format": (op12_chat_format, sql.chat_format()),
    "op13_vector_codes": (op13_vector_codes, sql.vector_codes()),
}
