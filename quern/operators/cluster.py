"""Chunks, the hash ring, placement, versions, liveness, repair and rebalancing."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import looks_like_text

CHUNK_BYTES = 4 << 20
VNODES = 128


def ring_hash(key: Column) -> Column:
    """The first 16 hex digits of SHA-256: they sort as the unsigned 64-bit integers do."""
    return F.substring(F.sha2(key, 256), 1, 16)


def split_chunks(files: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """(file_id, ordinal, chunk_id, size, data) of (file_id, data BINARY); an empty file has no chunk."""
    n = F.length("data")
    at = F.posexplode(F.sequence(F.lit(0), n - 1, F.lit(size))).alias("ordinal", "at")
    parts = files.where(n > 0).select("file_id", "data", at)
    parts = parts.select("file_id", "ordinal", F.substr("data", F.col("at") + 1, F.lit(size)).alias("data"))
    return parts.select("file_id", "ordinal", F.sha2("data", 256).alias("chunk_id"), F.length("data").cast("long").alias("size"), "data")


def reassemble(chunks: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(file_id, data, sha256, whole): the chunks of each file in order.

    A chunk whose bytes do not match its id is left out, and its file is not ``whole``; nor is one with a gap in its
    ordinals, or with fewer chunks than ``expected`` (file_id, n_chunks) says.  A file is one row, as its bytes are one value.
    """
    good = F.sha2("data", 256) == F.col("chunk_id")
    rows = chunks.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.when(good, F.struct("ordinal", "data")))).alias("parts"), F.every(good).alias("whole"),
        F.max("ordinal").alias("last"), F.countDistinct("ordinal").alias("n"),
    )
    # each ordinal once; the pieces are joined at once, as hexadecimal digits
    parts = F.filter("parts", lambda x, i: (i == 0) | (x["ordinal"] != F.get("parts", i - 1)["ordinal"]))
    data = F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x["data"])), ""))
    whole = F.col("whole") & (F.col("last") + 1 == F.col("n"))
    rows = rows.select("file_id", data.alias("data"), whole.alias("whole"), "n")
    if expected is not None:
        rows = expected.select("file_id", "n_chunks").join(rows, "file_id", "left")
        rows = rows.withColumn("whole", (F.col("n_chunks") == F.coalesce("n", F.lit(0))) & F.coalesce("whole", F.lit(True))).withColumn("data", F.coalesce("data", F.lit(b"")))
    return rows.select("file_id", "data", F.sha2("data", 256).alias("sha256"), "whole")


def put_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a chunk is accepted if its bytes hash to its id."""
    ok = F.sha2("data", 256) == F.col("chunk_id")
    return chunks.where(ok), chunks.where(~ok)


def get_chunks(ids: DataFrame, store: DataFrame) -> DataFrame:
    """(chunk_id, status, data) of each id: OK, NOT_FOUND, or CHECKSUM_MISMATCH (without data).  Of several copies a good one counts."""
    asked = store.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    held = asked.groupBy("chunk_id").agg(F.max_by("data", F.sha2("data", 256) == F.col("chunk_id")).alias("held"))
    found = ids.select("chunk_id").distinct().join(held, "chunk_id", "left")
    good = F.sha2("held", 256) == F.col("chunk_id")
    status = F.when(F.col("held").isNull(), "NOT_FOUND").when(good, "OK").otherwise("CHECKSUM_MISMATCH")
    return found.select("chunk_id", status.alias("status"), F.when(good, F.col("held")).alias("data"))


def chunks_exist(ids: DataFrame, store: DataFrame) -> DataFrame:
    """(chunk_id, exists) of each id; bytes are not read."""
    held = store.select("chunk_id", F.lit(True).alias("held")).distinct()
    return ids.select("chunk_id").distinct().join(held, "chunk_id", "left").select("chunk_id", F.coalesce("held", F.lit(False)).alias("exists"))


def replicate(locations: DataFrame, copies: DataFrame) -> DataFrame:
    """``locations`` after ``copies`` (chunk_id, node_id) of chunks that some node holds."""
    known = copies.select("chunk_id", "node_id").join(locations.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return locations.select("chunk_id", "node_id").union(known).distinct()


def delete_chunks(locations: DataFrame, gone: DataFrame) -> DataFrame:
    """``locations`` without ``gone`` (chunk_id, node_id); deleting what is not there changes nothing."""
    return locations.select("chunk_id", "node_id").join(gone.select("chunk_id", "node_id"), ["chunk_id", "node_id"], "left_anti")


class Ring:
    """Consistent hashing over a set of nodes.  Its size is nodes times virtual nodes, which membership bounds."""

    def __init__(self, nodes: list[str], vnodes: int = VNODES):
        self.nodes = sorted(set(nodes))
        self.points = sorted((hashlib.sha256(f"{n}#{i}".encode()).hexdigest()[:16], n) for n in self.nodes for i in range(vnodes))

    def replicas_at(self, k: int, r: int) -> list[str]:
        out: list[str] = []
        for step in range(len(self.points)):
            node = self.points[(k + step) % len(self.points)][1]
            if node not in out:
                out.append(node)
                if len(out) == r:
                    break
        return out

    def replicas_of(self, key: str, r: int) -> list[str]:
        h = hashlib.sha256(key.encode()).hexdigest()[:16]
        return self.replicas_at(bisect_left(self.points, (h, "")) % len(self.points), r) if self.points else []

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.points or [], "pos string, node_id string")

    def segments(self, spark: SparkSession, r: int) -> DataFrame:
        """(bucket, lo, hi, nodes): keys in (lo, hi] belong to ``nodes``; once for each 3-digit bucket that it meets."""
        rows = []
        for k, (pos, _) in enumerate(self.points):
            nodes = self.replicas_at(k, r)
            lo = self.points[k - 1][0] if k else ""
            for b in range(int(lo[:3] or "0", 16), int(pos[:3], 16) + 1):
                rows.append((f"{b:03x}", lo, pos, nodes))
        if self.points:
            last, nodes = self.points[-1][0], self.replicas_at(0, r)
            rows += [(f"{b:03x}", last, "g", nodes) for b in range(int(last[:3], 16), 4096)]
        return spark.createDataFrame(rows, "bucket string, lo string, hi string, nodes array<string>")


def replicas(keys: DataFrame, ring: Ring, r: int, key: str = "key") -> DataFrame:
    """``keys`` with (node_id, rank): the first ``r`` distinct nodes clockwise from each key.

    An equality join on the first hex digits of the hash and a range check within: no key meets the whole ring.
    """
    found = keys.withColumn("_h", ring_hash(F.col(key))).withColumn("_b", F.substring("_h", 1, 3))
    parts = F.broadcast(ring.segments(keys.sparkSession, r))  # 4096 rows and two for each virtual node
    found = found.join(parts, (F.col("_b") == F.col("bucket")) & (F.col("_h") > F.col("lo")) & (F.col("_h") <= F.col("hi")))
    return found.select(*keys.columns, F.posexplode("nodes").alias("rank", "node_id")).withColumn("rank", F.col("rank") + 1)


#: Copies of a chunk, and how many must be acknowledged.
COPIES, QUORUM = 3, 2


def write_quorum(acks: DataFrame, w: int = QUORUM) -> DataFrame:
    """(chunk_id, acked, ok) of (chunk_id, node_id, ack)."""
    return acks.groupBy("chunk_id").agg(F.sum(F.col("ack").cast("long")).alias("acked")).withColumn("ok", F.col("acked") >= w)


def upload(files: DataFrame, ring: Ring, reachable: DataFrame, size: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(registrations, locations) of files (file_id, data).

    registrations: (file_id, n_chunks, sha256, committed, is_text, owner). A file is committed if at least QUORUM of the
    COPIES nodes that the ring names acknowledge each of its chunks; the ring must have COPIES nodes. ``owner`` indexes
    a committed text: of the nodes of its first chunk, the first that took it.  locations: (chunk_id, node_id) of committed files,
    nodes that acknowledged only. A file without bytes is committed without a chunk.
    """
    if len(ring.nodes) < COPIES:
        raise ValueError(f"{len(ring.nodes)} nodes, {COPIES} needed")
    parts = split_chunks(files, size).select("file_id", "ordinal", "chunk_id")
    placed = replicas(parts, ring, COPIES, "chunk_id").join(reachable.select("node_id", F.lit(1).alias("ack")), "node_id", "left")
    acked = F.count("ack")
    each = placed.groupBy("file_id", "ordinal").agg(acked.alias("acked"), F.min_by("node_id", F.when(F.col("ack") == 1, F.col("rank"))).alias("owner"))
    state = each.groupBy("file_id").agg(F.count("*").alias("n_chunks"), F.min("acked").alias("least"), F.min_by("owner", "ordinal").alias("owner"))
    rows = files.select("file_id", F.sha2(F.coalesce("data", F.lit(b"")), 256).alias("sha256"), F.coalesce(looks_like_text(F.col("data")), F.lit(False)).alias("is_text"))
    rows = rows.join(state, "file_id", "left").withColumn("committed", F.coalesce(F.col("least") >= QUORUM, F.lit(True)))
    owner = F.when(F.col("committed") & F.col("is_text"), F.col("owner"))
    registered = rows.select("file_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "sha256", "committed", "is_text", owner.alias("owner"))
    kept = placed.where("ack = 1").join(registered.where("committed").select("file_id"), "file_id", "left_semi")
    return registered, kept.select("chunk_id", "node_id").distinct()


def download(file_chunks: DataFrame, checksums: DataFrame, located: DataFrame, alive: DataFrame, store: DataFrame) -> DataFrame:
    """(file_id, status, sha256, data) of files: OK, UNAVAILABLE (a chunk without a live holder) or CORRUPT.

    ``file_chunks`` has (file_id, ordinal, chunk_id), ``checksums`` (file_id, sha256) of every file, ``store`` (chunk_id, data).
    A damaged or missing chunk or another checksum of the whole makes a file corrupt; its bytes are not given.
    """
    live = located.join(alive.select("node_id"), "node_id", "left_semi").select("chunk_id", F.lit(True).alias("live")).distinct()
    parts = file_chunks.join(live, "chunk_id", "left").join(store.select("chunk_id", "data"), "chunk_id", "left")
    reach = parts.groupBy("file_id").agg(F.every(F.coalesce("live", F.lit(False))).alias("reachable"))
    back = reassemble(parts.withColumn("data", F.coalesce("data", F.lit(b"")))).withColumnRenamed("sha256", "found")
    rows = checksums.join(reach, "file_id", "left").join(back, "file_id", "left")
    found = F.coalesce("found", F.sha2(F.lit(b""), 256))
    good = F.coalesce("whole", F.lit(True)) & (found == F.col("sha256"))
    status = F.when(~F.coalesce("reachable", F.lit(True)), "UNAVAILABLE").when(good, "OK").otherwise("CORRUPT")
    return rows.select("file_id", status.alias("status"), F.when(status == "OK", found).alias("sha256"), F.when(status == "OK", F.coalesce("data", F.lit(b""))).alias("data"))


def read_around(placed: DataFrame, alive: DataFrame) -> DataFrame:
    """(chunk_id, node_id): the first placed node that is alive."""
    return placed.join(alive, "node_id", "left_semi").groupBy("chunk_id").agg(F.min_by("node_id", "rank").alias("node_id"))


def versions(registrations: DataFrame) -> DataFrame:
    """``registrations`` (file_id, seq, ...) with the version that each makes."""
    return registrations.withColumn("version", F.row_number().over(Window.partitionBy("file_id").orderBy("seq")).cast("long"))


def latest(versioned: DataFrame) -> DataFrame:
    last = Window.partitionBy("file_id").orderBy(F.desc("version"))
    return versioned.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def membership(events: DataFrame) -> DataFrame:
    """Nodes whose last change (seq, node_id, change) is no LEAVE."""
    last = events.groupBy("node_id").agg(F.max_by("change", "seq").alias("change"))
    return last.where("change <> 'LEAVE'").select("node_id")


def liveness(probes: DataFrame, threshold: int = 3) -> DataFrame:
    """(node_id, failures, alive) of probes (node_id, seq, ok): dead after ``threshold`` failures in a row at the end."""
    good = probes.groupBy("node_id").agg(F.max(F.when(F.col("ok"), F.col("seq"))).alias("last_ok"))
    late = probes.join(good, "node_id").where("NOT ok AND (last_ok IS NULL OR seq > last_ok)")
    counts = late.groupBy("node_id").agg(F.count("*").alias("failures"))
    out = good.select("node_id").join(counts, "node_id", "left").select("node_id", F.coalesce("failures", F.lit(0)).alias("failures"))
    return out.withColumn("alive", F.col("failures") < threshold)


def repair_plan(locations: DataFrame, alive: DataFrame, ring: Ring, r: int = 3) -> DataFrame:
    """(chunk_id, source, target): copies that bring chunks with a live holder back to ``r``."""
    held = locations.join(alive.withColumn("live", F.lit(True)), "node_id", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    state = held.groupBy("chunk_id").agg(F.sum(F.col("live").cast("int")).alias("n"), F.min(F.when(F.col("live"), F.col("node_id"))).alias("source"))
    weak = state.where((F.col("n") < r) & F.col("source").isNotNull())
    ranked = replicas(weak, ring, len(ring.nodes), "chunk_id").join(alive, "node_id", "left_semi")
    ranked = ranked.join(locations.select("chunk_id", "node_id"), ["chunk_id", "node_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy("rank"))
    return ranked.withColumn("place", place).where(F.col("place") <= r - F.col("n")).select("chunk_id", "source", F.col("node_id").alias("target"))


def rebalance_plan(locations: DataFrame, alive: DataFrame, ring: Ring, r: int = 3) -> DataFrame:
    """(chunk_id, target, evicted): copies to nodes that the ring wants, each then giving up one that it does not."""
    held = locations.join(alive, "node_id", "left_semi")
    full = held.groupBy("chunk_id").count().where(F.col("count") >= r).select("chunk_id")
    held = held.join(full, "chunk_id")
    ideal = replicas(full, ring, r, "chunk_id")
    wanted = ideal.join(alive, "node_id", "left_semi").join(held.select("chunk_id", "node_id"), ["chunk_id", "node_id"], "left_anti")
    surplus = held.select("chunk_id", "node_id").join(ideal.select("chunk_id", "node_id"), ["chunk_id", "node_id"], "left_anti")
    wanted = wanted.withColumn("place", F.row_number().over(Window.partitionBy("chunk_id").orderBy("rank")))
    surplus = surplus.withColumn("place", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("node_id"))))
    return wanted.select("chunk_id", "place", F.col("node_id").alias("target")).join(surplus.select("chunk_id", "place", F.col("node_id").alias("evicted")), ["chunk_id", "place"], "left").drop("place")


def transitions(states: DataFrame) -> DataFrame:
    """(round, node_id, alive): changes of states (round, node_id, alive); a node that is first seen counts as alive before."""
    before = F.coalesce(F.lag("alive").over(Window.partitionBy("node_id").orderBy("round")), F.lit(True))
    return states.withColumn("before", before).where("alive <> before").select("round", "node_id", "alive")


def maintenance_round(members: DataFrame, probes: DataFrame, located: DataFrame, ring: Ring, r: int = COPIES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(health, repairs, moves, locations): one round over the members; probes of others are forgotten.

    Dead nodes are found, weak chunks copied, then chunks moved to where the ring wants them; ``locations`` are those after it.
    """
    health = liveness(probes.join(members.select("node_id"), "node_id", "left_semi"))
    alive = members.select("node_id").join(health.where("NOT alive"), "node_id", "left_anti")
    repairs = repair_plan(located, alive, ring, r)
    repaired = located.select("chunk_id", "node_id").union(repairs.select("chunk_id", F.col("target").alias("node_id")))
    moves = rebalance_plan(repaired, alive, ring, r)
    after = repaired.union(moves.select("chunk_id", F.col("target").alias("node_id")))
    return health, repairs, moves, delete_chunks(after, moves.where("evicted IS NOT NULL").select("chunk_id", F.col("evicted").alias("node_id")))
