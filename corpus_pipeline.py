"""A training corpus from ``documents``: five stages, each reading what the one before wrote.

quality classifier -> n-gram Jaccard join -> benchmark decontamination -> mixing by source -> token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._shared import settle, shared_dir
from quern.llm.cotraining import good_documents
from quern.llm.decontaminate import without_leaks
from quern.llm.jaccard_join import ngram_jaccard_join
from quern.llm.mixing import mix_passages
from quern.llm.wavelet import token_wavelet

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject.

    Every row is judged by its own text and metadata: null and repeated ids, repeated rows and empty texts are rows like
    others. Without labels, and of an empty table, all is kept. Other columns than those of documents are dropped.
    """
    return good_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: the one with the least doc_id (of several, any one; null last).

    Rows are told apart by a written number, so repeated and null ids do not matter: of repeated rows one stays. Rows
    without words are no copies of anything, and all stay. An empty table gives an empty one.
    """
    rows = settle(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "stage-rows")
    found = ngram_jaccard_join(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    named = rows.select("row", F.col("doc_id").isNull().alias("unnamed"), "doc_id").join(found, "row")
    stays = named.groupBy("component_id").agg(F.min(F.struct("unnamed", "doc_id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(stays, "row", "left_semi").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no test item.

    Every row is judged by its own text; null texts hold none, null and repeated ids are ids like others.
    """
    return without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each pass over a row of ``docs``, with the words of that pass.

    Rows without words give nothing; a null source is one like others; rows that share an id each give their own words.
    """
    return mix_passages(docs.select(*COLUMNS))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token-id shards of the corpus, read back: a row for each row of ``docs``; null and empty texts have the end id alone."""
    return token_wavelet(spark, docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed_sources),
    ("token ids", token_output),
]

#: No stage but the joins can be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/quern/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
