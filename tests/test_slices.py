"""What is made of texts slice by slice: bounded batches, no row moved for the analysis, files that share an id as in the SQL."""

import re

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__
from quern.functions import text


class Captured:
    """A DataFrame whose mapInArrow gives the function."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_offsets_come_in_bounded_batches():
    texts = ["Ab été x9-y " * 20_000, None, "", "same", "ends"] * 24
    rows = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(len(texts))]), pa.array(texts)], ["file_id", "text"])
    out = list(text.token_offsets(Captured())(iter([rows])))
    assert len(out) > 1 and max(b.nbytes for b in out) < sum(b.nbytes for b in out) / 2
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    want = [(str(i), k, m[0].decode().lower(), m.start(), m.end()) for i, t in enumerate(texts) for k, m in enumerate(re.finditer(rb"[A-Za-z0-9]+", (t or "").encode()))]
    assert got == want


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with repeated ids, ids far apart, texts without terms; no document of shard 3 has a term."""
    path = str(tmp_path_factory.mktemp("odd"))
    long = " ".join(f"w{k % 97} of w{k % 31}" for k in range(3000))
    rows = [(0, "tion reer tion"), (0, "reer zebra attion tion"), (4, long), (4, None), (8, ""), (1, "the and of"), (1, "été tion, reer"), (3, "of the"), (7, None), (70_000_001, "tion reer reer"), (5, "zebra tion x9")]
    spark.createDataFrame([(i, t, "en", "src1", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    return path


def agrees(spark, path, name):
    """The query's rows are those of its SQL."""
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    want = sorted(db.sql(__spark_entry__.oracle_sql()[name]).fetchall(), key=repr)
    assert sorted(map(tuple, __spark_entry__.queries()[name](spark, path).collect()), key=repr) == want


def plan(spark, path, name):
    return __spark_entry__.queries()[name](spark, path)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_gaps_of_repeated_ids_and_over_slices(spark, odd, monkeypatch):
    from quern.operators import codec

    monkeypatch.setattr(codec, "SLICE_BYTES", 16)
    agrees(spark, odd, "posting_gap_encode")
    assert "Join" not in plan(spark, odd, "posting_gap_encode")


def test_roundtrip_on_arrays(spark, odd, monkeypatch):
    import numpy as np

    from quern.operators import codec

    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**35 - 1, 2**62], np.int64)
    data = codec.encode_array(values)
    assert data.tobytes() == b"".join(codec.encode_varint(int(v)) for v in values)
    assert codec.decode_array(data).tolist() == values.tolist()
    monkeypatch.setattr(codec, "SLICE_BYTES", 16)
    agrees(spark, odd, "codec_roundtrip")
    good = codec.encode_array
    monkeypatch.setattr(codec, "encode_array", lambda v: good(np.where(v == 3, 4, v)))  # a codec that errs is told
    p = codec.Postings.of(codec.Tokens.of(np.frombuffer(b"x a a ab b y x", np.uint8), np.array([0, 6, 14])), np.array([1, 4]))
    assert not codec._decodes(p, np.cumsum(p.tf) - p.tf).all()


def test_sizes_need_no_positions_in_a_shuffle(spark, odd, monkeypatch):
    from quern.operators import codec

    monkeypatch.setattr(codec, "SLICE_BYTES", 16)
    agrees(spark, odd, "posting_compressed_size")
    found = plan(spark, odd, "posting_compressed_size")
    assert "Join" not in found and "collect_list" not in found


def test_corpus_stats_of_repeated_ids(spark, odd):
    agrees(spark, odd, "corpus_stats")


def test_lengths_of_repeated_ids_without_a_join(spark, odd):
    from quern.operators import index as ix
    from quern.sources.corpus import documents

    agrees(spark, odd, "doc_length")
    lengths = ix.Index.build(documents(spark, odd)).doc_lengths
    assert "Join" not in lengths._jdf.queryExecution().toString()


def test_document_frequencies_are_counted_by_slices(spark, odd, tmp_path):
    agrees(spark, odd, "idf")
    agrees(spark, odd, "document_frequency")
    once = spark.read.parquet(f"{odd}/documents.parquet").dropDuplicates(["doc_id"])
    once.write.parquet(f"{tmp_path}/documents.parquet")
    agrees(spark, str(tmp_path), "idf")
    assert "Join" not in plan(spark, str(tmp_path), "document_frequency")


def test_pairs_are_counted_by_slices(spark, odd, tmp_path):
    agrees(spark, odd, "phrase_pairs_top")  # texts of one id pair with each other
    once = spark.read.parquet(f"{odd}/documents.parquet").dropDuplicates(["doc_id"])
    once.write.parquet(f"{tmp_path}/documents.parquet")
    agrees(spark, str(tmp_path), "phrase_pairs_top")
    assert "Window" not in plan(spark, str(tmp_path), "phrase_pairs_top")


def test_shard_stats_of_a_shard_without_terms(spark, odd):
    agrees(spark, odd, "shard_stats")


def test_shard_totals_of_repeated_ids(spark, odd):
    agrees(spark, odd, "shard_totals")


def test_search_makes_rows_of_its_terms_only(spark, odd):
    from quern.operators import index as ix
    from quern.sources.corpus import documents

    agrees(spark, odd, "scatter_gather_topk")
    index = ix.Index.build(documents(spark, odd))
    assert {r["term"] for r in index.found(["tion", "zebra"]).collect()} == {"tion", "zebra"}
    assert "Join" not in index.found(["tion"])._jdf.queryExecution().toString()


@pytest.mark.parametrize("policy", ["lru", "lfu"])
def test_long_traces_go_on_part_by_part(spark, monkeypatch, policy):
    import random

    from quern.operators import cache

    rnd = random.Random(5)
    traces = {"long": 1000, "other": 450, None: 300, "short": 90}
    rows = [(t, 7 * k, str(min(int(rnd.expovariate(0.08)), 40))) for t, n in traces.items() for k in range(n)]
    want = []
    for t in traces:
        held = {"lru": cache.LRUCache, "lfu": cache.LFUCache}[policy](16)
        for _, step, key in (r for r in rows if r[0] == t):
            hit = held.get(key) is not None
            if not hit:
                held.put(key, True)
            want.append((t, step, key, hit))
    rnd.shuffle(rows)
    accesses = spark.createDataFrame(rows, "trace string, step long, key string")
    monkeypatch.setattr(cache, "PART", 100)
    sizes = []
    runs = cache._runs
    monkeypatch.setattr(cache, "_runs", lambda *a: sizes.append(a) or runs(*a))
    got = [tuple(r) for r in cache.simulate(accesses, policy, 16).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(sizes) == 11
