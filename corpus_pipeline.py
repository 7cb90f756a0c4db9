"""A corpus pipeline: each stage works on what the one before it kept.

Every stage returns a DataFrame, which is written as Parquet and read again as the next one's input.  The last one
adds the pieces of each text; the others return the columns of ``documents``.

Null, empty and blank texts score as texts without words, are copies of one another (one stays), lose nothing and have
no pieces (null: null pieces).  A very long text is one row throughout, never cut.  Of equal ids in one group of
copies, one row stays, so repeated rows count once.  Rows with a null id go through all stages.  Other columns,
whatever their names, stay as they are; ``n_chars`` follows the text.  Empty tables give an empty result; without
labels nothing is toxic, without test items nothing is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm import decontaminate, sentencepiece_codec, simhash, substring_dedup, toxicity
from geolith.llm.common import stored

TOXIC_AT = 0.3


def counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, as the text now is."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``TOXIC_AT`` or more go."""
    model = toxicity.fit_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    score_col = scored.columns[len(docs.columns)]
    return scored.where(F.col(score_col) < TOXIC_AT).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 or more of their five-word shingles stays."""
    return simhash.first_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that repeat are cut out."""
    out = substring_dedup.remove_repeats(docs)
    columns = [F.col("kept_text").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return counted(out.select(*columns))


def drop_test_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words of two or more test items go; the words of one item are cut out."""
    return counted(decontaminate.remove_test_data(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' pieces, beside the columns of ``documents``."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.load())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("substring_dedup", drop_repeats),
    ("decontaminate", drop_test_data),
    ("sentencepiece", encode),
]

#: SQL can express neither the scores nor the segmentation: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
