"""Index snapshots: whole versions, and a pointer that names the current one."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.index import Index


def save(index: Index, path: str) -> str:
    """Write a snapshot; it becomes current when its pointer row is committed.

    Pointers are numbered, so no clock decides which is current. There is one writer at a time.
    """
    version = uuid.uuid4().hex
    index.docs.write.parquet(f"{path}/{version}/docs")
    # sorted by term, so a query's terms select few row groups
    index.terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/{version}/terms")
    index.doc_lengths.write.parquet(f"{path}/{version}/lengths")
    spark = index.docs.sparkSession
    try:
        number = spark.read.parquet(f"{path}/current").agg(F.max("number")).first()[0] + 1
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        number = 0
    spark.createDataFrame([(number, version)], "number long, version string").coalesce(1).write.mode("append").parquet(f"{path}/current")
    return version


def load(spark: SparkSession, path: str) -> Index:
    version = spark.read.parquet(f"{path}/current").orderBy(F.desc("number")).first()["version"]
    read = lambda name: spark.read.parquet(f"{path}/{version}/{name}")
    return Index(read("docs"), read("terms"), read("lengths"), kept=True)


def upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """``current`` after ``changes``: later rows of an id replace earlier ones, deletes remove it."""
    from quern.operators.index import live

    ops = current.withColumn("op", F.lit("upsert")).unionByName(changes, allowMissingColumns=True)
    return live(ops).drop("op")
