"""Each operator on small tables: known results, brute force, and awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0d]+"


def prose(seed, n=80):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def documents(spark, texts):
    return spark.createDataFrame([(k, t, None if k % 5 == 4 else "en", None if k % 7 == 3 else f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], DOCS)


def awkward(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, columns with clashing names."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (None, prose(1), None, "b", 9), (4, prose(2, 60_000), "de", None, 1), (5, prose(3), "en", "b", 2), (5, prose(3), "en", "b", 2), (6, "é 中文 😀 ok", "x", "c", 3)]
    return spark.createDataFrame(rows, DOCS).select("*", *(F.lit(0).alias(c) for c in ("node", "size", "h", "key", "taken", "root", "words", "n_words", "label_id", "start")))


LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(60)] + [(None, 1, 0), (3, None, 0), (5, 0, 1)], LABELS)


def operators(spark, labels):
    from quern.llm.cotraining import classify_quality
    from quern.llm.decontaminate import decontaminate
    from quern.llm.jaccard_join import ngram_jaccard_join
    from quern.llm.line_dedup import dedup_lines
    from quern.llm.mixing import mix_passages, mix_sources
    from quern.llm.pii import find_pii
    from quern.llm.quality_rules import quality_rules
    from quern.llm.wavelet import token_wavelet

    items = spark.createDataFrame([(1, prose(3)), (None, prose(1)), (2, None), (3, "a b")], "item_id long, text string")
    return {
        "op1": lambda d: decontaminate(d, items), "op2": lambda d: token_wavelet(spark, d), "op3": ngram_jaccard_join, "op4": find_pii, "op6": mix_sources, "mix": mix_passages,
        "op7": dedup_lines, "op8": lambda d: classify_quality(d, labels), "op9": lambda d: quality_rules(d, labels),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op6", "mix", "op7", "op8", "op9"])
def test_awkward_and_empty_tables(spark, labels, name):
    run = operators(spark, labels)[name]
    rows = run(awkward(spark)).collect()
    per_row = {"op2", "op3", "op4", "op6", "op8", "op9"}
    if name in per_row:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(["1", "2", "3", "None", "4", "5", "5", "6"])
    if name == "op1":
        assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in rows) == [("5", "1"), ("5", "1"), ("None", "None")]
    if name == "op7":
        assert {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in rows}[5] == (2, 1)
    assert run(spark.createDataFrame([], DOCS)).count() == 0


def test_tokens_read_back(spark):
    from quern.llm.wavelet import WaveletMatrix, token_wavelet

    texts = [prose(1), "", "  two  spaces\n\n tabs\t", "it's <|endoftext|> é中😀 12 + 3", prose(2, 500), "a" * 3000]
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for k, t in enumerate(texts):
        ids = [*tk.encode(t, add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(tuple(r) for r in token_wavelet(spark, documents(spark, texts)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == want
    ids = np.random.default_rng(1).integers(0, 50, 5000).astype(np.uint32)
    m = WaveletMatrix.open(WaveletMatrix.encode(ids, [5000]))
    assert (m.ids() == ids).all() and m.access(77) == ids[77] and m.locate(7) == np.flatnonzero(ids == 7).tolist()
    assert m.count(9, 100, 2000) == int((ids[100:2000] == 9).sum()) and m.count(99) == 0


def test_jaccard_components_equal_brute_force(spark):
    from quern.llm.jaccard_join import ngram_jaccard_join

    rnd, texts = random.Random(5), []
    for base in range(6):
        words = prose(base, 70).split()
        for _ in range(8):
            w = list(words)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(["x", "y", "z"])
            texts.append(" ".join(w))
    texts += ["one two", "One  TWO", "", "solo"]
    sets = []
    for t in texts:
        w = re.findall(WORD, t.lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = sorted(tuple(r) for r in ngram_jaccard_join(documents(spark, texts)).collect())
    assert got == [(k, len(sets[k]), find(k)) for k in range(len(texts))]


def test_decontamination_finds_edited_copies_and_leaves_others(spark):
    from quern.llm.decontaminate import decontaminate

    item = prose(50, 40).split()
    edited = list(item)
    for k in range(3, 40, 6):
        edited[k] = "changed"
    del edited[20]
    texts = [prose(60), prose(61) + " " + " ".join(item).upper() + " " + prose(62), prose(63) + " " + " ".join(edited), prose(64) + " " + " ".join(item[:8])]
    items = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate(documents(spark, texts), items).collect()}
    assert set(got) == {1, 2} and got[1]["score"] == 1.0 and (got[1]["start_word"], got[1]["end_word"]) == (80, 120)


def test_pii_equals_brute_force(spark):
    from quern.llm.pii import find_pii

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    bare = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(bare(m)) <= 19 and luhn(bare(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(bare(m)) <= 15),
    ]
    rnd = random.Random(5)
    parts = ["a@b.c", "@", "x_y", "1.2.3.4", "999.1.1.1", "000255.1.2.3", "4111 1111 1111 1111", "4785380592391139", "+49 (30) 123456-78", "+1", " ", ".", "-", "_", "é", "😀", "12", "7", "\n", "..", "+"]
    texts = [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8"] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 20))) for _ in range(300)]
    got = {r["doc_id"]: r for r in find_pii(documents(spark, texts)).collect()}
    for k, t in enumerate(texts):
        spans = sorted((m.start(), r, f"{name}:{m.start()}:{m.end()}") for r, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, t or "") if ok(m[0]))
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(s[2] for s in spans).encode()).hexdigest(), t
        assert got[k]["n_email"] == sum(s[1] == 0 for s in spans)
    long = ["1" * 200_000, "a.b." * 50_000, "1 " * 100_000, "x@" + "a." * 60_000 + "b"]
    assert find_pii(documents(spark, long)).where("n_email > 0").count() == 1
    added = find_pii(documents(spark, ["pay to GB82 WEST 1234 5698 7654 32 now, ssn 123-45-6789", "123-45-6789"])).orderBy("doc_id").collect()
    assert "iban:7:34" in added[0]["spans"] and "ssn:" in added[0]["spans"] and added[1]["spans"] == ""


def test_chat_windows_round_trip(spark):
    from quern.llm.chat import chat_windows, escape, format_chats, read_conversations, unescape

    for text in ("</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user", "<\\|x", "<<SYS>> <</SYS>>", "<", "[\\\\INST]", "<\\\\\\|"):
        assert unescape(escape(text)) == text and "<|" not in escape(text)
    said = "</s>[INST] ok [/INST] <|end|>"
    rows = [(1, 0, "system", "be brief")] + [(1, k, "user" if k % 2 else "assistant", f"{said} {k} " + prose(k, 30)) for k in range(1, 30)] + [(2, 0, None, None), (None, 0, "user", "x"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_windows(turns, budget=600).where("conv_id = 1").orderBy("window").collect()
    assert len(windows) > 2 and all(w["n_tokens"] <= 600 for w in windows) and all("<|turn|>system\nbe brief" in w["text"] for w in windows)
    got = {r["conv_id"]: r for r in format_chats(turns, budget=600).collect()}
    conv = [(r[2], r[3]) for r in rows[:30]]
    assert got[1]["n_turns"] == 30 and got[1]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in conv).encode()).hexdigest()
    learned = "".join(b for a, b in conv if a == "assistant")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert got[2]["n_turns"] == 1 and got[None]["n_turns"] == 1 and got[3]["n_turns"] == 2
    assert read_conversations(chat_windows(turns.limit(0))).count() == 0


def test_apportionment(spark):
    from quern.llm.mixing import mix_passages, mix_sources, plan, sainte_lague, targets

    rnd = random.Random(2)
    for _ in range(30):
        votes, seats, plain = [rnd.random() for _ in range(rnd.randint(1, 9))], rnd.randint(0, 60), []
        plain = [0] * len(votes)
        for _ in range(seats):
            k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * plain[i] + 1), -i))
            plain[k] += 1
        assert sainte_lague(votes, seats) == plain
    assert targets([10, 10, 1000], [1.0, 2.0, 3.0]) == [30.0, 30.0, 960.0]
    p = plan({f"s{k}": 40_000 * (k + 1) for k in range(5)})
    shards = -(-p.seats // 4096)
    assert [sum(x) for x in zip(*(p.shard_quotas(k) for k in range(shards)))] == [s.seats for s in p.sources]
    docs = documents(spark, [prose(k, 50 + k) for k in range(200)])
    rows = mix_sources(docs, block_words=8).collect()
    sums = defaultdict(lambda: [0, 0.0])
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        sums[source[r["doc_id"]]][0] += r["taken"]
        sums[source[r["doc_id"]]][1] = r["target"]
    assert all(abs(a - b) <= 16 for a, b in sums.values())
    assert sorted(map(tuple, mix_sources(docs, block_words=8).collect())) == sorted(map(tuple, rows))
    got = mix_passages(docs, block_words=8).groupBy("doc_id").agg(F.sum(F.size(F.split(F.trim("text"), "\\s+"))).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}


def test_line_dedup_recall(spark):
    from quern.llm.line_dedup import SHINGLE, line_components

    rnd, lines = random.Random(4), []
    for base in range(40):
        line = prose(base, 25)
        lines.append(line)
        for _ in range(3):
            at = rnd.randrange(len(line))
            lines.append(line[:at] + rnd.choice("qx") + line[at + 1 :])
    lines += ["short", "Short", "  short "]
    got = {r["doc_id"]: r["root"] for r in line_components(documents(spark, lines)).collect()}
    sets = [{x[k : k + SHINGLE] for k in range(max(1, len(x) - SHINGLE + 1))} for x in (" ".join(t.lower().split()) for t in lines)]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert sum(got[i] == got[j] for i, j in links) >= 0.98 * len(links)
    assert all(got[i] != got[j] for i in range(0, 160, 4) for j in range(0, i, 4))


def test_cotraining_keeps_good_and_rejects_junk(spark):
    from quern.llm.cotraining import classify_quality

    good = [prose(k) for k in range(300)]
    junk = [" ".join(w + "***" for w in prose(k).split()) for k in range(300, 360)]
    docs = documents(spark, good + junk)
    labels = spark.createDataFrame([(k, int(k < 300), 0) for k in range(0, 360, 2)], LABELS)
    rows = {r["doc_id"]: r["kept"] for r in classify_quality(docs, labels).collect()}
    assert sum(rows[k] for k in range(300)) >= 296 and sum(rows[k] for k in range(300, 360)) <= 2
    assert classify_quality(docs, labels.limit(0)).where("kept AND score IS NULL").count() == 360


def test_quality_rules(spark):
    from quern.llm.quality_rules import binomial_tail, quality_rules

    assert abs(binomial_tail(2, 10, 0.3) - 0.3827827864) < 1e-9 and abs(binomial_tail(0, 50, 0.1) - 0.9**50) < 1e-12 and binomial_tail(5, 5, 0.2) == 1.0
    texts = [prose(k, 60 + k) for k in range(30)] + ["x y z " * 40, "same line\nsame line\nother #*", "### $$$ " * 50, "a b c a b c", "", None]
    rows = {r["doc_id"]: r for r in quality_rules(documents(spark, texts), spark.createDataFrame([], LABELS)).collect()}
    for k, t in enumerate(texts):
        w, windows, seen = re.findall(WORD, t or ""), defaultdict(list), set()
        for i in range(len(w) - 2):
            windows[tuple(w[i : i + 3])].append(i)
        for at in windows.values():
            if len(at) > 1:
                seen |= {i + d for i in at for d in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        got = rows[k]
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(seen))
        assert got["base_failed"] == (len(w) < 50 or 100 * len(seen) > 50 * len(w)) and got["kept"] == (not got["base_failed"])
    good = [prose(k, 80) for k in range(2500)]
    bad = [" ".join(x + "***" for x in t.split()) for t in good[:30]]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(good + bad)], DOCS)
    found = quality_rules(docs, spark.createDataFrame([(k, 1, 0) for k in range(2500)], LABELS))
    assert found.where("kept AND doc_id < 2500").count() == 2500 and found.where("kept AND doc_id >= 2500").count() == 0


def test_html(spark):
    from quern.llm.html_text import extract_html, main_text

    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>x";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies on this site to do things for you and others.</div>
    <article><h2>Fish &amp; chips</h2><p>One&nbsp;long <b>bold</b>\n line &lt;x&gt;.<p>Two<br>lines<div class="ad">Buy this now, it is the best thing you will ever see here.</div><p>End.</article>
    <aside><p>Other things to read that are not part of this at all, whatever.</p></aside><section id="comments"><p>I think that this is a very long and good comment on it.</p></section>
    <form><p>Sign up for our letter today and get it each week in your mail.</p></form><footer><p>All rights reserved by us.</p></footer></body></html>"""
    assert main_text(page) == "Fish & chips\nOne long bold line <x>.\nTwo lines\nEnd."
    assert main_text(None) == main_text("") == "" and main_text("<" * 5000 + "a='" * 3000) is not None
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", ""), (1, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in extract_html(pages).collect()) == [("1", 51), ("1", 51), ("2", 0), ("None", 0)]


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token ids"]
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        d = stage(spark, d, "/root/testdata/sf0.001").cache()
        assert d.count() > 0
        if k < 4:
            assert d.columns == list(corpus_pipeline.COLUMNS)
    assert "start" in d.columns
