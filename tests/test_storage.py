"""Chunks, ring, repair, caches and codec against known numbers."""

import pytest
from pyspark.sql import functions as F

from quern.operators import cache, cluster, codec


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node_id string")


def test_chunks(spark):
    files = spark.createDataFrame([("x", b"x" * 10), ("e", b"")], "file_id string, data binary")
    rows = cluster.split_chunks(files, 4).orderBy("ordinal").collect()
    assert [r["size"] for r in rows] == [4, 4, 2] and rows[0]["chunk_id"] == rows[1]["chunk_id"]
    back = cluster.reassemble(cluster.split_chunks(files, 4)).collect()
    assert [(r["file_id"], bytes(r["data"])) for r in back] == [("x", b"x" * 10)]
    good, bad = cluster.put_chunks(spark.createDataFrame([("nope", b"x")], "chunk_id string, data binary"))
    assert good.count() == 0 and bad.count() == 1


def test_damaged_and_missing_chunks_are_told(spark):
    files = spark.createDataFrame([(f, bytes(f * 9, "ascii")) for f in "abcd"] + [("e", b"")], "file_id string, data binary")
    parts = cluster.split_chunks(files, 4).persist()
    bad = parts.where("NOT (file_id = 'b' AND ordinal = 1)").withColumn("data", F.when(F.expr("file_id = 'c' AND ordinal = 0"), F.lit(b"x")).otherwise(F.col("data")))
    got = {r["file_id"]: (bytes(r["data"]), r["whole"]) for r in cluster.reassemble(bad).collect()}
    assert got == {"a": (b"a" * 9, True), "b": (b"b" * 5, False), "c": (b"c" * 5, False), "d": (b"d" * 9, True)}
    ids = spark.createDataFrame([(r["chunk_id"],) for r in parts.where("ordinal = 0 AND file_id = 'a'").collect()] + [("nope",)], "chunk_id string")
    assert sorted(r["status"] for r in cluster.get_chunks(ids, parts).collect()) == ["NOT_FOUND", "OK"]
    assert sorted(r["exists"] for r in cluster.chunks_exist(ids, parts).collect()) == [False, True]


def test_upload_and_download(spark):
    files = spark.createDataFrame([(f"f{k}", bytes(f"text {k} ", "ascii") * 40) for k in range(30)] + [("empty", b""), ("bin", b"\x00" * 9)], "file_id string, data binary")
    ring = cluster.Ring([f"node{k}" for k in range(1, 6)])
    registered, located = cluster.upload(files, ring, nodes(spark, ["node1", "node2", "node3"]), 64)
    rows = {r["file_id"]: r for r in registered.collect()}
    assert rows["empty"]["committed"] and rows["empty"]["n_chunks"] == 0 and not rows["bin"]["is_text"] and rows["bin"]["owner"] is None
    parts = cluster.split_chunks(files, 64)
    for name, r in rows.items():
        asked = [ring.replicas_of(p["chunk_id"], 3) for p in parts.where(F.col("file_id") == name).orderBy("ordinal").collect()]
        acked = [[n for n in a if n in ("node1", "node2", "node3")] for a in asked]
        assert r["committed"] == all(len(a) >= 2 for a in acked)
        assert r["owner"] == (acked[0][0] if r["committed"] and r["is_text"] and acked else None)
    assert located.where("node_id IN ('node4', 'node5')").isEmpty()
    kept = registered.where("committed").select("file_id", "sha256")
    own = parts.join(kept, "file_id", "left_semi")
    store = own.select("chunk_id", "data").dropDuplicates(["chunk_id"])
    back = cluster.download(own.select("file_id", "ordinal", "chunk_id"), kept, located, nodes(spark, ["node1", "node2", "node3"]), store)
    assert {r["status"] for r in back.collect()} == {"OK"} and back.count() == kept.count()
    gone = cluster.download(own.select("file_id", "ordinal", "chunk_id"), kept, located, nodes(spark, ["node4"]), store)
    assert {(r["file_id"] == "empty", r["status"]) for r in gone.collect()} == {(True, "OK"), (False, "UNAVAILABLE")}
    with pytest.raises(ValueError):
        cluster.upload(files, cluster.Ring(["a", "b"]), nodes(spark, ["a"]))


def test_coordinator(spark):
    from quern.operators.coordinator import Coordinator
    from quern.operators.index import Index

    rows = [(str(k), f"bread {'salt ' * (k % 3)}", {}, k) for k in range(12)]
    index = Index.build(spark.createDataFrame(rows, "file_id string, text string, fields map<string,string>, seq long")).persist()
    c = Coordinator(index, index.docs.select("file_id", (F.col("seq") % 4).cast("int").alias("shard")), 4)
    part = c.query("salt", 3, down=(1,))
    assert (part.responded, part.queried, part.scoring, part.complete) == (3, 4, "local", False)
    whole = c.query("salt", 3)
    assert whole.complete and not whole.from_cache and whole.scoring == "global" and whole.hits[0][0] == "11"
    assert c.query("salt", 3).from_cache and not c.query("salt ", 3).from_cache and not c.query("salt", 4).from_cache
    assert c.query("salt", 3).hits == whole.hits and c.cache_stats()["hits"] == 2 and c.cache_stats()["misses"] == 4
    with pytest.raises(ValueError):
        c.query("")


def test_a_round_of_maintenance(spark):
    keys = spark.range(60).select(F.sha2(F.col("id").cast("string"), 256).alias("chunk_id"))
    five, six = (cluster.Ring([f"node{i}" for i in range(1, n + 1)]) for n in (5, 6))
    located = cluster.replicas(keys, five, 3, "chunk_id").select("chunk_id", "node_id")
    probes = spark.createDataFrame([(f"node{i}", k, i != 2) for i in range(1, 7) for k in range(3)], "node_id string, seq int, ok boolean")
    health, repairs, moves, after = cluster.maintenance_round(nodes(spark, six.nodes), probes, located, six)
    assert [r["node_id"] for r in health.where("NOT alive").collect()] == ["node2"]
    assert repairs.count() == located.where("node_id = 'node2'").count() and all(r["target"] != "node2" for r in moves.collect())
    held = after.where("node_id <> 'node2'").groupBy("chunk_id").count()
    assert held.where("count < 3").isEmpty() and held.count() == 60


def test_ring(spark):
    ring = cluster.Ring(["node1", "node2", "node3", "node4"])
    assert ring.replicas_of("some-chunk-id", 3) == ["node2", "node1", "node3"]
    keys = spark.range(500).select(F.concat(F.lit("key-"), "id").alias("key"))
    got = {}
    for r in cluster.replicas(keys, ring, 3).orderBy("rank").collect():
        got.setdefault(r["key"], []).append(r["node_id"])
    assert got == {f"key-{k}": ring.replicas_of(f"key-{k}", 3) for k in range(500)}
    big = cluster.Ring(["n1", "n2", "n3", "n4"], 200)
    counts = [0] * 4
    for k in range(12_000):
        counts[int(big.replicas_of(f"key-{k}", 1)[0][1]) - 1] += 1
    assert counts == [2990, 3021, 3170, 2819]


def test_rebalance_moves_only_to_the_newcomer(spark):
    import hashlib

    blocks = [(f"block-{i}-".encode().ljust(64, bytes([97 + i % 26]))) for i in range(40)]
    keys = spark.createDataFrame([(hashlib.sha256(b).hexdigest(),) for b in blocks], "chunk_id string")
    five, six = (cluster.Ring([f"node{i}" for i in range(1, n + 1)]) for n in (5, 6))
    located = cluster.replicas(keys, five, 3, "chunk_id").select("chunk_id", "node_id")
    plan = cluster.rebalance_plan(located, nodes(spark, six.nodes), six).collect()
    assert len(plan) == 21 and {r["target"] for r in plan} == {"node6"} and all(r["evicted"] for r in plan)
    # a lost node: every chunk that it held gets one new copy on a node that is alive
    fix = cluster.repair_plan(located, nodes(spark, ["node1", "node2", "node4", "node5"]), five).collect()
    lost = located.where("node_id = 'node3'").count()
    assert len(fix) == lost and all(r["target"] != "node3" for r in fix)


def test_liveness(spark):
    rows = [("dead", k, False) for k in range(3)] + [("back", 0, False), ("back", 1, False), ("back", 2, True), ("back", 3, False)]
    got = {r["node_id"]: r["alive"] for r in cluster.liveness(spark.createDataFrame(rows, "node_id string, seq int, ok boolean")).collect()}
    assert got == {"dead": False, "back": True}


def skewed():
    step, cold = 0, 0
    for _ in range(300):
        for _ in range(3):
            for h in range(8):
                yield step, f"hot{h}"
                step += 1
        for _ in range(10):
            yield step, f"cold{cold}"
            step, cold = step + 1, cold + 1


@pytest.mark.parametrize(("policy", "hits"), [("lru", 4800), ("lfu", 7192)])
def test_cache_traces(spark, policy, hits):
    rows = [("s", k, key) for k, key in skewed()]
    rows += [("c", k, str(k % 12)) for k in range(600)]
    got = cache.simulate(spark.createDataFrame(rows, "trace string, step long, key string"), policy, 16).where("trace = 's' AND hit").count()
    assert got == hits
    cyclic = spark.createDataFrame([r for r in rows if r[0] == "c"], "trace string, step long, key string")
    assert cache.simulate(cyclic, policy, 8).where("hit").count() == 0


def test_codec():
    for n in (0, 1, 127, 128, 16383, 16384, 2**32 - 1, 2**64 - 1):
        assert codec.decode_varint(codec.encode_varint(n), 0)[0] == n
    posts = [(3, 2, [5, 40]), (9, 1, [0]), (1000, 3, [1, 2, 900])]
    data = codec.encode(posts)
    assert len(data) == 18 and codec.decode(data) == posts
    assert len(codec.encode([(k, 1, []) for k in range(1000)])) == 3002
    for bad in (data[:-1], b"\xff", b"\x80" * 11):
        with pytest.raises(ValueError):
            codec.decode(bad)


def test_registry_is_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
