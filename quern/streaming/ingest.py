"""Continuous indexing: an operation stream into snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quern.operators.index import Index
from quern.sources import store


def stream_into(ops: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Apply a stream of operations (seq, op, file_id, text, fields), batch by batch, each as a new snapshot.

    A batch that runs again gives the same documents: the last operation of an id decides.
    """

    def apply(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            docs = store.load(spark, path).docs
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            docs = batch.drop("op").limit(0)
        store.save(Index.build(store.upsert(docs, batch)), path)

    return ops.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
