"""The search language, the analyzer and ranking, on small corpora with known results."""

import math
import time

import pytest
from pyspark.sql import functions as F

from quern.functions.text import STOP_WORDS, analyze, analyze_word, looks_like_text, snippet, stem_word
from quern.operators import index as ix
from quern.operators import search
from quern.plans.querylang import Node, QuerySyntaxError, parse, positive_terms
from quern.sources import store

# two small corpora of our own
CORPUS_A = {
    "bread.md": "Sourdough bread rises slowly on a warm shelf near an old oven so that loaves and rolls keep an open crumb.",
    "ovens.md": "Every oven is heated by three burners. Heating holds the shelf warm when a burner fails.",
    "salt.md": "Salt tightens dough by slowing yeast activity and strengthening gluten. Slowing is gradual, not sudden.",
    "diary.md": "A well-kept diary makes bakers calm: note to the diary, rest, then bake.",
}
CORPUS_B = [
    ("diary.md", "A well kept diary makes bakers calm.", {"owner": "mill", "type": "note", "lang": "en"}),
    ("bread.md", "Sourdough bread places loaves on a shelf of wood.", {"owner": "shop", "type": "note", "lang": "en"}),
    ("order.md", "The diary is closed, then we bake well.", {"owner": "mill", "type": "draft", "lang": "en"}),
    ("gap.md", "loaves of the shelf", {"owner": "shop", "type": "draft"}),
]


def bm25(corpus, terms):
    """(file_id, score) of documents with one of ``terms``, best first: the formula, on plain lists."""
    words = {k: [t for w in v.split() for t in analyze_word(w)] for k, v in corpus}
    mean = sum(map(len, words.values())) / len(words)
    scores = {}
    for t in terms:
        n = sum(t in w for w in words.values())
        for k, w in words.items():
            if tf := w.count(t):
                scores[k] = scores.get(k, 0) + math.log(1 + (len(words) - n + 0.5) / (n + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
    return sorted(((k, round(x, 6)) for k, x in scores.items()), key=lambda r: (-r[1], r[0]))


def near(got, want):
    assert [k for k, _ in got] == [k for k, _ in want] and all(abs(x - y) < 2e-6 for (_, x), (_, y) in zip(got, want))


def build(spark, rows):
    return ix.Index.build(spark.createDataFrame([(a, b, c, k) for k, (a, b, c) in enumerate(rows)], "file_id string, text string, fields map<string,string>, seq long")).persist()


@pytest.fixture(scope="module")
def corpus_a(spark):
    return build(spark, [(k, v, {}) for k, v in CORPUS_A.items()])


@pytest.fixture(scope="module")
def corpus_b(spark):
    return build(spark, CORPUS_B)


def hits(index, query, k=10, **more):
    return [(r["file_id"], r["score"]) for r in search.search(index, query, k, **more).collect()]


# Words with their stems as Porter's algorithm publishes them.
PAIRS = "caresses caress ponies poni ties ti caress caress cats cat feed feed plastered plaster bled bled motoring motor sing sing hopping hop tanned tan falling fall hissing hiss fizzed fizz filing file sized size happy happi sky sky controll control roll roll rate rate a a is is as as university univers universe univers organization organ ytnyizer ytnyizer yttbiliti yttbiliti royying royi iyying iyi ygaue ygaue ydoesll ydoesll".split()


def test_stems_agree_with_known_pairs(spark):
    from quern.functions.stemmer import stems

    words, want = PAIRS[::2], PAIRS[1::2]
    got = {r["surface"]: r["term"] for r in stems(spark.createDataFrame([(w,) for w in words], "surface string")).collect()}
    assert [got[w] for w in words] == want
    assert [stem_word(w) for w in words] == want


def test_column_and_driver_stemmers_agree(spark):
    import random

    from quern.functions.stemmer import stems

    rnd = random.Random(3)
    ends = ["", "ed", "ing", "ational", "ization", "iveness", "ion", "ement", "ly", "ness", "ies", "sses", "y", "eed", "ll"]
    words = sorted({"".join(rnd.choice("aeioubtsylz1") for _ in range(rnd.randint(1, 6))) + rnd.choice(ends) for _ in range(1500)})
    got = {r["surface"]: r["term"] for r in stems(spark.createDataFrame([(w,) for w in words], "surface string")).collect()}
    assert {w: stem_word(w) for w in words} == got


def test_analysis(spark):
    assert len(STOP_WORDS) == 124
    docs = spark.createDataFrame([("a", "How does a filesystem journal writes?"), ("b", "chunks are replicated across the ring"), ("c", "the and of a to"), ("d", None), ("e", "été")], "file_id string, text string")
    got = sorted((r["file_id"], r["position"], r["term"]) for r in analyze(docs).collect())
    assert got == [("a", 3, "filesystem"), ("a", 4, "journal"), ("a", 5, "write"), ("b", 0, "chunk"), ("b", 2, "replic"), ("b", 3, "across"), ("b", 5, "ring"), ("e", 0, "t")]
    lengths = {r["file_id"]: r["length"] for r in ix.lengths(docs, analyze(docs)).collect()}
    assert lengths == {"a": 3, "b": 4, "c": 0, "d": 0, "e": 1}


def test_parser():
    stub = lambda w: {"the": [], "a": [], "write-ahead": ["write", "ahead"]}.get(w, [w])
    t = lambda x: Node("term", x)
    p = lambda q, **k: parse(q, analyze=stub, **k)
    assert p("chunk") == t("chunk")
    assert p("chunk replication").kind == "or" and p("chunk replication", implicit="AND").kind == "and"
    assert p("chunk OR ring AND hash") == Node("or", children=(t("chunk"), Node("and", children=(t("ring"), t("hash")))))
    assert p("(chunk OR ring) AND hash").kind == "and"
    assert p("the a the") is None and p("  ") is None and p("the chunk") == t("chunk")
    assert p("write-ahead") == Node("and", children=(t("write"), t("ahead")))
    assert p("fsync()") == t("fsync")
    for bad in ("(chunk", "chunk)", "AND chunk", "chunk AND", "NOT"):
        with pytest.raises(QuerySyntaxError):
            p(bad)
    assert positive_terms(p("chunk AND ring NOT hash")) == ["chunk", "ring"]
    assert positive_terms(p("chunk OR ring OR chunk")) == ["chunk", "ring"]
    with pytest.raises(QuerySyntaxError):
        p("hashing owner:mill", strict=True)
    assert p("hashing owner:mill").kind == "or" and p("owner:mill log", strict=True).kind == "or"
    assert [o for _, o in parse('"the-ring x"').children] == [0, 1]
    assert [o for _, o in parse('"write - log"').children] == [0, 2]
    assert analyze_word("write-ahead") == ["write", "ahead"]


def test_ranking(corpus_a):
    rows = list(CORPUS_A.items())
    near(hits(corpus_a, "warm bread shelf"), bm25(rows, ["warm", "bread", "shelf"]))
    near(hits(corpus_a, "heat"), bm25(rows, ["heat"]))  # heated, Heating
    assert hits(corpus_a, "heat")[0][0] == "ovens.md"
    near(hits(corpus_a, "oven slowly slow"), bm25(rows, ["oven", "slowli", "slow"]))
    assert hits(corpus_a, "sourdough AND diary") == []
    assert [h[0] for h in hits(corpus_a, "shelf AND NOT burner")] == ["bread.md"]
    assert {h[0] for h in hits(corpus_a, "(diary OR salt) AND NOT bread")} == {"diary.md", "salt.md"}
    for nothing in ("NOT bread", "kubernetes", "the and of", ""):
        assert hits(corpus_a, nothing) == []
    assert hits(corpus_a, "shelf", 0) == []


def test_phrases_and_fields(corpus_b):
    rows = [r[:2] for r in CORPUS_B]
    near(hits(corpus_b, '"well kept diary'), [r for r in bm25(rows, ["well", "kept", "diari"]) if r[0] == "diary.md"])
    assert hits(corpus_b, '"well diary"') == [] and hits(corpus_b, '"loaves shelf"') == []
    # loaves 0, shelf 3 in gap.md; loaves 3, shelf 6 in bread.md: stop words between count as places
    assert {h[0] for h in hits(corpus_b, '"loaves of the shelf"')} == {"gap.md", "bread.md"}
    assert hits(corpus_b, "owner:mill") == [("diary.md", 0.0), ("order.md", 0.0)]
    assert [h[0] for h in hits(corpus_b, "diary AND owner:mill AND type:note")] == ["diary.md"]
    assert hits(corpus_b, "owner:mil") == [] and hits(corpus_b, "nosuchfield:note") == []
    assert hits(corpus_b, "sourdough") == hits(corpus_b, "sourdough AND owner:shop")
    near(hits(corpus_b, "sourdough"), bm25(rows, ["sourdough"]))
    assert {h[0] for h in hits(corpus_b, "diary OR owner:shop")} == {"order.md", "diary.md"}


def test_suggestions(corpus_b):
    vocab = ix.vocabulary(corpus_b.terms)
    assert [r["surface"] for r in search.autocomplete(vocab, "sour").collect()] == ["sourdough"]
    assert search.autocomplete(vocab, "").count() == 0
    assert search.did_you_mean(vocab, "sourdogh").first()["surface"] == "sourdough"
    assert search.did_you_mean(vocab, "sourdough").count() == 0 and search.did_you_mean(vocab, "kubernetes").count() == 0


def test_shards_score_as_one_index(corpus_a):
    shards = corpus_a.docs.select("file_id", (F.col("seq") % 3).cast("int").alias("shard"))
    near(hits(corpus_a, "oven shelf", shards=shards), hits(corpus_a, "oven shelf"))
    local = hits(corpus_a, "oven shelf", shards=shards, stats="local")
    assert local != hits(corpus_a, "oven shelf")
    # without the shard of salt.md (seq 2) no statistics are global: the others score by their own
    assert hits(corpus_a, "oven shelf", shards=shards, exclude_shards=(2,)) == [h for h in local if h[0] != "salt.md"]


def test_snippet():
    text = "x" * 10 + " " + "word " * 60 + "hashing target " + "tail " * 60
    got = snippet(text, ["hash"])
    assert got.startswith("...") and got.endswith("...") and "hashing" in got and len(got) < 240
    assert snippet("nothing here", ["hash"]) == "" and snippet(None, ["hash"]) == ""


def test_increments_and_snapshots(spark, tmp_path):
    rows = [("a", "chunk replication", 1, "upsert"), ("a", "consistent hashing", 2, "upsert"), ("b", "chunk", 3, "upsert"), ("b", "", 4, "delete")]
    ops = spark.createDataFrame(rows, "file_id string, text string, seq long, op string").withColumn("fields", F.create_map().cast("map<string,string>"))
    index = ix.Index.build(ix.live(ops).drop("op"))
    assert {r["term"]: r["n"] for r in ix.document_frequency(index.terms).collect()} == {"consist": 1, "hash": 1}
    start = time.time()
    assert [h[0] for h in hits(index, "hashing")] == ["a"] and time.time() - start < 60  # neither cached nor written
    store.save(index, str(tmp_path))
    again = store.load(spark, str(tmp_path))
    assert hits(again, "hashing") == hits(index, "hashing")
    later = store.upsert(again.docs, spark.createDataFrame([("a", "", 9, "delete"), ("c", "zebra", 10, "upsert")], "file_id string, text string, seq long, op string"))
    store.save(ix.Index.build(later), str(tmp_path))
    assert [r["file_id"] for r in store.load(spark, str(tmp_path)).docs.collect()] == ["c"]


def test_text_sniffing(spark):
    df = spark.createDataFrame([(b"text",), (b"",), (b"a\x00b",)], "data binary")
    assert [r[0] for r in df.select(looks_like_text(F.col("data"))).collect()] == [True, False, False]


def test_directories(spark, tmp_path):
    from quern.sources.corpus import directory

    (tmp_path / "sub").mkdir()
    for name, text in (("b c+d.md", "two"), ("a.txt", "one"), ("sub/z.md", "three"), ("no.MD", "x"), ("no.py", "x")):
        (tmp_path / name).write_text(text)
    assert [tuple(r) for r in directory(spark, str(tmp_path)).collect()] == [("a.txt", "one"), ("b c+d.md", "two"), ("sub/z.md", "three")]
    assert directory(spark, str(tmp_path / "missing")).count() == 0


def test_streamed_operations(spark, tmp_path):
    from quern.streaming.ingest import stream_into

    schema = "file_id string, text string, fields map<string,string>, seq long, op string"
    for k, rows in enumerate(([("a", "bread", None, 1, "upsert"), ("b", "salt", None, 2, "upsert")], [("a", "", None, 3, "delete"), ("b", "salt dough", None, 4, "upsert")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ops"))
        stream_into(spark.readStream.schema(schema).parquet(str(tmp_path / "ops")), str(tmp_path / "index"), str(tmp_path / "seen")).awaitTermination()
    index = store.load(spark, str(tmp_path / "index"))
    assert [(r["file_id"], r["text"]) for r in index.docs.collect()] == [("b", "salt dough")]
    assert [h[0] for h in hits(index, "dough")] == ["b"]


def test_compaction(spark):
    rows = [("a", 1, "upsert"), ("a", 2, "upsert"), ("b", 3, "upsert"), ("c", 4, "upsert"), ("c", 5, "delete")]
    ops = spark.createDataFrame(rows, "file_id string, seq long, op string")
    assert tuple(ix.compaction(ops).first()) == (4, 2, True)
    docs = spark.range(3000).select(F.col("id").cast("string").alias("file_id"), (F.col("id") * 7 % 3000 * F.col("id") % 977).alias("seq"))
    got = [r["doc_id"] for r in ix.compacted(docs).orderBy("seq", "file_id").collect()]
    assert got == list(range(3000)) and ix.compacted(docs.limit(0)).count() == 0
