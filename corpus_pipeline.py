"""A training corpus from raw documents: rate, thin out near copies, cut repeats, cut test items, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.  All but the last return
the columns of the documents; ``n_chars`` follows the text where a stage cuts it.

Every stage works for empty tables, null and empty texts, repeated rows and
further columns, as its operator says.  A document whose text is cut away as a
whole stays with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtable.llm import decontaminate, mixing, ngram_join, quality_rules, substring_dedup
from stemtable.llm.frames import table, written

#: Words of a passage that no later document may repeat.
PASSAGE = 40

# No stage before the last has a SQL twin: hashing, automata and a trained model.
ORACLE_SQL = None


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" not in columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def rate_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the classifier keep."""
    rated = quality_rules.quality_rules(docs, table(spark, sf_dir, "labels"))
    return rated.filter("kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def thin_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs, shingle=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the later ones."""
    found = substring_dedup.substring_dedup(docs, window=PASSAGE)
    return _sized(substring_dedup.stripped(found, docs.columns), docs.columns)


def cut_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark items are cut out, documents that consist of them are dropped."""
    return _sized(decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), window=10), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their number of copies and the words taken."""
    return mixing.mix(docs).filter("copies > 0")


STAGES = [
    ("quality rules", rate_quality),
    ("n-gram Jaccard join", thin_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", cut_test_items),
    ("mixing sources to target weights", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
