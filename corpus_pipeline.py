"""A training-data pipeline over the documents table, one operator a stage.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
documents, extra ones included. A stage's result is written as Parquet in the
shared folder of spark.checkpoint.dir and read again as the next one's docs.
Rows without a doc_id go in the first stage, and of rows that share one the row
with the smallest text (null before any) stays; where texts are equal too, the
one whose other columns come first as text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import byte_bpe, common, decontamination, line_dedup, ngram_join, toxicity

#: SQL can't express a trained classifier; the stages and the whole are tested against plain versions instead.
ORACLE_SQL = None


def _one_row_an_id(docs: DataFrame) -> DataFrame:
    docs = docs.where("doc_id is not null")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        order = F.struct(F.col("text").isNotNull(), "text", F.to_json(F.struct(*sorted(docs.columns))))
        docs = docs.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return docs


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(common.small(common.cut(ids.select("doc_id").distinct())), "doc_id", "left_anti").select(docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go."""
    docs = _one_row_an_id(docs)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, toxicity.scores(docs, model).where("score >= 0.5"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; text and n_chars are what stays. A null text stays null."""
    docs = _one_row_an_id(docs)
    out = line_dedup.apply_bitmaps(docs.select("doc_id", "text"), line_dedup.keep_bitmaps(docs))
    new = docs.drop("text").join(out.select("doc_id", F.when(F.col("text").isNotNull(), F.col("kept")).alias("text")), "doc_id")
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))
    return new.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    docs = _one_row_an_id(docs)
    return _without(docs, ngram_join.jaccard_components(docs).where("component_id <> doc_id"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    docs = _one_row_an_id(docs)
    return _without(docs, decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of what the ids decode to."""
    import public_tokenizers

    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("byte_bpe", encode),
]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table. Of what the stages wrote only the last one's rows stay, as the result reads them."""
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            _delete(spark, before)
        before = at
    return docs
