"""The corpus pipeline: toxicity, near duplicates, shared passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's ``docs``; all but the last keep the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petriscope.llm.common import drop_written, join_ids, written
from petriscope.llm.decontamination import decontaminate
from petriscope.llm.ngram_jaccard import ngram_jaccard
from petriscope.llm.packing import pack
from petriscope.llm.substring_dedup import substring_dedup
from petriscope.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go.

    Null and empty texts are never rejected; repeated rows, and rows with a null
    id, are judged by their texts.  All columns stay.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at five-word shingles and a Jaccard similarity of 0.8, the smallest id stays.

    Documents without words, and rows with a null id, are in no group and stay;
    so do repeated rows of the id that stays.  All columns stay.
    """
    groups = ngram_jaccard(docs.select("doc_id", "text"), n=5, percent=80)
    return join_ids(docs, "doc_id", groups.where("component_id <> doc_id").select("doc_id").distinct(), "left_anti")


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document has go; ``n_chars`` follows the text.

    A document of which nothing goes keeps its text to the letter, null too;
    other columns stay whatever their names.  Exact copies of one id stay; rows
    with a null id are neither cut nor cut others.
    """
    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("given"))
    cut = substring_dedup(rows, window=13)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    old = {c: F.col(f"given.`{c}`") for c in docs.columns}
    return cut.select(*((F.when(F.col("n_removed") > 0, new[c]).otherwise(old[c]) if c in new else old[c]).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go, with all rows of their id.

    Null and empty texts overlap with nothing; rows with a null id can't be
    named and stay.  All columns stay.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 1024 tokens.

    A null or empty text is one piece of one token; repeated rows and rows with
    a null id are documents of their own.  Other columns are left out.
    """
    return pack(docs, size=1024, with_ids=False).drop("ids").withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("shared passages", shared_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The toxicity chain is trained, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
            if before is not None:
                drop_written(before)
            before = docs
    return docs
