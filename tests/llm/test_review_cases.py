"""Cases of the reviews: budgets, tiny sources, recall, bounded samples, stages with awkward rows."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_operators import DOCS, LABELS, documents, prose


def test_windows_keep_their_budget(spark):
    from quern.llm.chat import chat_windows, read_conversations

    rnd = random.Random(6)
    rows = [(1, 0, "system", prose(1, 90))] + [(1, k, rnd.choice(["user", "assistant"]), prose(k, rnd.choice([3, 40, 300, 460]))) for k in range(1, 60)]
    rows += [(2, 0, "user", prose(9, 3000)), (2, 1, "assistant", "ok"), (2, 2, "user", prose(3, 450)), (2, 3, "assistant", prose(4, 470))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).withColumn("new", F.lit(2))
    windows = chat_windows(turns).collect()
    assert all(w["n_tokens"] <= 2048 or len(w["new"]) == 1 for w in windows) and sum(w["n_tokens"] > 2048 for w in windows) == 1
    again = [w for w in windows if w["conv_id"] == 1 and w["window"] > 0]
    assert again and any(not w["new"][0] for w in again) and all("system" in w["text"][:20] or sum(w["new"]) for w in again)
    back = {r["conv_id"]: r for r in read_conversations(chat_windows(turns)).collect()}
    assert back[1]["n_turns"] == 60 and back[2]["loss_chars"] == 2 + len(prose(4, 470))


def test_small_sources_come_near_their_targets(spark):
    from quern.llm.mixing import mix_passages, mix_sources, plan

    sizes = {"a": 10, "b": 33, "c": 45, "d": 5, "e": 9000, "f": 12000}
    made = plan(sizes)
    for s in made.sources:
        assert abs(min(s.seats * made.block_words, 3 * s.size) - s.target) <= made.block_words
    rows = [(k, prose(k, n), "en", s, 1) for k, (s, n) in enumerate((s, w) for s, n in sizes.items() for w in ([n] if n < 50 else [50] * (n // 50)))]
    docs = spark.createDataFrame(rows, DOCS)
    got = mix_sources(docs).collect()
    source = {r[0]: r[3] for r in rows}
    for name in sizes:
        mine = [r for r in got if source[r["doc_id"]] == name]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 2 and all(r["taken"] <= 3 * r["size"] for r in mine)
    # quotas of shards: what the passages of a shard hold
    many = plan({"x": 400_000, "y": 900_000}, block_words=8)
    assert many.shards > 1 and [sum(q) for q in zip(*(many.shard_quotas(k) for k in range(many.shards)))] == [s.seats for s in many.sources]
    assert all(min(many.shard_quotas(k)) >= 0 for k in range(many.shards))
    words = mix_passages(docs, with_shard=True).select("source", "mix_shard", F.regexp_count("text", F.lit(r"\S+")).alias("n"))
    taken = {r["source"]: r["n"] for r in words.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    assert taken == {n: sum(r["taken"] for r in got if source[r["doc_id"]] == n) for n in sizes}


def test_rows_of_one_id_each_give_their_words(spark):
    from quern.llm.mixing import mix_passages, mix_sources

    rows = [(5, prose(1, 40), "en", "s", 1), (5, prose(2, 400), "en", "s", 1), (None, prose(3, 30), "en", "s", 1), (None, prose(4, 90), "en", "t", 1), (6, prose(5, 70), "en", "t", 1), (6, prose(5, 70), "en", "t", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    taken = sorted((r["source"], r["n"]) for r in mix_sources(docs).join(docs.select("doc_id", "source").distinct().where("doc_id IS NOT NULL"), "doc_id").groupBy("source").agg(F.sum("taken").alias("n")).collect())
    got = mix_passages(docs).select("doc_id", "source", F.regexp_count("text", F.lit(r"\S+")).alias("n"))
    assert sorted((r["source"], r["n"]) for r in got.where("doc_id IS NOT NULL").groupBy("source").agg(F.sum("n").alias("n")).collect()) == taken
    assert got.agg(F.sum("n")).first()[0] == mix_sources(docs).agg(F.sum("taken")).first()[0]


def test_decontamination_recall_and_short_items(spark):
    from quern.llm._shared import scan_words, span_hashes, text_buffers
    from quern.llm.decontaminate import align, decontaminate
    import pyarrow as pa

    def hashed(text):
        data, off = text_buffers(pa.array([text]))
        w = scan_words(data, off)
        return span_hashes(data, w.starts, w.ends)

    rnd = random.Random(9)
    items = [prose(1000 + k, rnd.choice([8, 12, 20, 40])) for k in range(30)]
    texts = []
    for k in range(150):
        words = rnd.choice(items).split()
        share = rnd.choice([0, 0.1, 0.2, 0.3])
        words = [f"new{k}x{i}" if rnd.random() < share else w for i, w in enumerate(words)]
        if rnd.random() < 0.3:
            del words[rnd.randrange(len(words))]
        texts.append(f"{prose(k, 30)} {' '.join(words)} {prose(k + 500, 30)}")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate(documents(spark, texts), table).collect()}
    want = {}
    for i, item in enumerate(items):  # every item against every text
        a = hashed(item)
        scores = align([(a, hashed(t)) for t in texts])[0]
        want |= {(d, i): s / (2 * len(a)) for d, s in enumerate(scores.tolist()) if s / (2 * len(a)) >= 0.5}
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len(want) > 100 and len(got) >= 0.95 * len(want)
    few = spark.createDataFrame([(1, "Alpha beta"), (2, "gamma"), (3, "alpha gamma")], "item_id long, text string")
    hits = decontaminate(documents(spark, ["x ALPHA beta y", "alpha x beta", "gamma", None]), few).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in hits if r["score"] == 1.0) == [(0, 1), (2, 2)]


def test_samples_of_the_classifier_are_bounded_in_rows(spark):
    from quern.llm.cotraining import classify_quality, fit_quality

    rows = [(7, prose(k), "en", "s", 1) for k in range(60)] + [(k, prose(k), "en", "s", 1) for k in range(100, 160)] + [(k, " ".join(w + "***" for w in prose(k).split()), "en", "s", 1) for k in range(200, 260)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("y", F.lit("clash")).withColumn("key", F.lit(1))
    labels = spark.createDataFrame([(7, 1, 0)] + [(k, 1, 0) for k in range(100, 140)] + [(k, 0, 0) for k in range(200, 240)], LABELS)
    model, _ = fit_quality(docs, labels, most_labelled=60)  # of which the repeated id alone could fill all
    assert model is not None
    got = classify_quality(docs, labels)
    assert got.count() == 180
    kept = {r["doc_id"]: r["kept"] for r in got.where("doc_id <> 7").collect()}
    assert sum(kept[k] for k in range(100, 160)) >= 58 and sum(kept[k] for k in range(200, 260)) <= 4


def test_line_dedup_recall_on_templates(spark):
    from quern.llm.line_dedup import SHINGLE, line_components

    rnd, texts = random.Random(12), []
    for base in range(150):  # families that share a template, near the threshold
        head, own = prose(base % 5, 9), prose(300 + base, 14)
        texts.append(f"{head} {own}")
        at = rnd.randrange(len(head) + 5, len(head) + len(own) - 8)
        twin = f"{head} {own}"
        texts.append(twin[:at] + "".join(rnd.choice("qxz") for _ in range(rnd.randint(1, 8))) + twin[at + rnd.randint(1, 8) :])
    sets = [{x[k : k + SHINGLE] for k in range(max(1, len(x) - SHINGLE + 1))} for x in texts]
    links = {(i, j): 100 * len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(texts)) for j in range(i)}
    links = {k: v for k, v in links.items() if v >= 80}
    got = {r["doc_id"]: r["root"] for r in line_components(documents(spark, texts)).collect()}
    near = [k for k, v in links.items() if v < 85]
    assert len(links) > 80 and len(near) > 10
    assert np.mean([got[i] == got[j] for i, j in links]) >= 0.95 and np.mean([got[i] == got[j] for i, j in near]) >= 0.9


def test_stages_of_the_pipeline_with_awkward_rows(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    copy = prose(70, 60)
    rows = [(1, copy, "en", "a", 1), (1, prose(71, 60), "en", "a", 1), (2, copy, "en", "a", 1), (None, copy, None, None, None), (None, prose(72, 60), None, None, None), (3, f"{prose(73)} {item} {prose(74)}", "en", "b", 1), (3, prose(75, 60), "en", "b", 1), (4, None, "en", "b", 0), (5, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit(0)).withColumn("taken", F.lit("x"))
    texts = lambda df: sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())
    one = p.one_of_each(spark, docs, sf)
    assert one.columns == list(p.COLUMNS)
    assert texts(one) == sorted((str(r[0]), str(r[1])) for r in [rows[0], *rows[1:2], *rows[4:]])
    clean = p.without_benchmark(spark, docs, sf)
    assert texts(clean) == sorted((str(r[0]), str(r[1])) for k, r in enumerate(rows) if k != 5) and clean.columns == list(p.COLUMNS)
    mixed = p.mixed_sources(spark, docs, sf)
    assert mixed.columns == list(p.COLUMNS) and mixed.where("text IS NULL OR text = ''").count() == 0
    assert p.good_quality(spark, docs, sf).columns == list(p.COLUMNS)
    none = spark.createDataFrame([], DOCS)
    for _, stage in p.STAGES:
        assert stage(spark, none, sf).count() == 0
