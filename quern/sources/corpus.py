"""Where documents come from: directories of text, binary files, tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def directory(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("md", "txt")) -> DataFrame:
    """(file_id, text) of every file below ``path`` with one of the extensions, by file_id, its relative path.

    A directory that is missing has no file.
    """
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    try:
        files = reader.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file_id string, text string")
    named = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # a URI
    full = F.regexp_replace(named, "^file:/+", "/")
    return files.select(F.replace(full, F.lit(path.rstrip("/") + "/"), F.lit("")).alias("file_id"), F.col("value").alias("text")).orderBy("file_id")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file_id"), F.col("content").alias("data"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as search documents: file_id, text, fields, seq."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")), lambda k, v: v.isNotNull())
    return d.select(F.col("doc_id").cast("string").alias("file_id"), F.coalesce("text", F.lit("")).alias("text"), fields.alias("fields"), F.col("doc_id").alias("seq"))
