"""What the metadata service knows: file versions, chunk locations, members of the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.cluster import latest


def locations(changes: DataFrame) -> DataFrame:
    """(chunk_id, node_id) of an event log (seq, chunk_id, node_id, change ADD or REMOVE): the last event of a pair decides.

    Adding a location twice is adding it once.
    """
    last = changes.groupBy("chunk_id", "node_id").agg(F.max_by("change", "seq").alias("change"))
    return last.where("change = 'ADD'").select("chunk_id", "node_id")


def chunk_ids(located: DataFrame) -> DataFrame:
    """Every chunk that some node holds."""
    return located.select("chunk_id").distinct()


def chunk_locations(located: DataFrame, chunk_id: str) -> DataFrame:
    return located.where(F.col("chunk_id") == chunk_id).select("node_id")


def get_file(versions: DataFrame, file_chunks: DataFrame, located: DataFrame, version: int = 0) -> DataFrame:
    """(file_id, version, ordinal, chunk_id, nodes): the chunks of a version (0: of the latest) and who holds them *now*.

    ``versions`` has (file_id, version), ``file_chunks`` (file_id, version, ordinal, chunk_id).  A chunk without a holder has no nodes.
    """
    wanted = latest(versions) if version == 0 else versions.where(F.col("version") == version)
    parts = wanted.select("file_id", "version").join(file_chunks, ["file_id", "version"])
    # holders of one chunk: as many as there are replicas
    held = located.groupBy("chunk_id").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))
    return parts.join(held, "chunk_id", "left").select("file_id", "version", "ordinal", "chunk_id", F.coalesce("nodes", F.array().cast("array<string>")).alias("nodes"))


def ring_state(events: DataFrame) -> DataFrame:
    """(node_id, ring_version) of the members; every membership event, a repeated one too, makes a version.

    ``events`` has (seq, node_id, change); a change that is not LEAVE joins.
    """
    last = events.groupBy("node_id").agg(F.max_by("change", "seq").alias("change"), F.count("*").alias("n"))
    total = last.agg(F.sum("n").alias("ring_version"))
    members = last.where("change IS NULL OR change <> 'LEAVE'").select("node_id")
    return members.join(F.broadcast(total))  # one row


def search_shards(nodes: DataFrame) -> DataFrame:
    """Shards of the search, by node_id: the nodes (node_id, address, roles) that have the role SEARCH."""
    return nodes.where(F.array_contains("roles", "SEARCH")).select("node_id", "address").orderBy("node_id")
