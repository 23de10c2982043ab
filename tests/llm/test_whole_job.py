"""Cases of the review of round 1 in which an operator did less than its whole job."""

from pyspark.sql import functions as F
from test_operators import documents, prose


def test_decontamination_aligns_copies_that_keep_few_seeds(spark):
    from quern.llm.decontaminate import decontaminate

    item = prose(50, 40).split()

    def changed(step, mark):
        return " ".join(f"{mark}{k}" if k % step == step - 1 else w for k, w in enumerate(item))

    items = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    for step in (4, 5):
        edited = prose(60) + " " + changed(step, "new") + " " + prose(61)
        for others in ([], [" ".join(item)], [changed(step, f"m{k}x") for k in range(50)]):
            got = {r["doc_id"]: r["score"] for r in decontaminate(documents(spark, [edited, prose(62), *others]), items).collect()}
            assert set(got) == {0, *range(2, 2 + len(others))} and got[0] >= 0.6


def test_line_dedup_decides_every_banded_link(spark):
    from quern.llm.line_dedup import SHINGLE, line_components, lines, signatures

    # many families of near copies of one template: most of a band is of other families than its two hubs
    head = prose(70, 12)
    texts = [f"{head} {prose(100 + k // 2, 3)} {k % 2}" for k in range(600)]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r["root"] for r in line_components(docs).collect()}
    bands = {r["doc_id"]: set(r["bands"]) for r in lines(docs).join(signatures(lines(docs)), "node").collect()}
    sets = [{x[k : k + SHINGLE] for k in range(max(1, len(x) - SHINGLE + 1))} for x in texts]
    met = [(i, j) for i in range(len(texts)) for j in range(i) if bands[i] & bands[j]]
    links = [(i, j) for i, j in met if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(met) > 5 * len(links) and all(got[i] == got[j] for i, j in links)
    up = {k: k for k in got}

    def find(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for i, j in links:
        up[find(i)] = find(j)
    assert len(set(got.values())) == len({find(k) for k in got})


def test_html_keeps_article_text_wherever_it_stands():
    from quern.llm.html_text import main_text

    def long(k):
        return " ".join(f"word{k}x{i}" for i in range(50))

    menu = "<nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav>"
    foot = "<footer><p>All rights reserved.</p></footer>"
    assert main_text(f"<body><article><h1>Title</h1><p>{long(1)}</p><p>{long(2)}</p></article>{foot}") == f"Title\n{long(1)}\n{long(2)}"
    assert main_text(f"<body><article><p>{long(1)}</p></article></body>") == main_text(f"<body><p>{long(1)}</p></body>") == long(1)
    assert main_text(f"<body>{menu}<article><h1>Title</h1><p>A short start.</p><p>{long(2)}</p></article>{foot}") == f"Title\nA short start.\n{long(2)}"
    assert main_text(f"<body>{menu}<article><p>{long(1)}</p></article>{foot}") == main_text(f"<body>{menu}<p>{long(1)}</p>{foot}") == long(1)
    for name in ("ad-free layout", "has-sidebar", "content-with-nav", "search"):
        assert main_text(f'<body>{menu}<div class="{name}"><article><h1>Title</h1><p>{long(1)}</p></article></div>{foot}') == f"Title\n{long(1)}"
    comments = f'<section id="comments"><article><p>{long(3)}</p></article></section><div class="site-footer"><p>{long(4)}</p></div><div class="ad"><p>{long(5)}</p></div>'
    assert main_text(f"<body>{menu}<main><article><p>{long(1)}</p></article>{comments}</main>") == long(1)
    assert main_text(f"<body>{menu}<article><p>{long(1)}</p><ul><li><a href=/1>One</a><li><a href=/2>Two</a><li><a href=/3>Three</a></ul></article>").startswith(long(1))


def test_iban_before_words_numbers_and_other_ibans(spark):
    from quern.llm.pii import IBAN_LENGTHS, find_pii

    gb, de, no = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "NO93 8601 1117 947"
    assert IBAN_LENGTHS["GB"] == 22 and IBAN_LENGTHS["MT"] == 31
    afters = ["", " Please pay", " Bank", " BIC DEUTDEFF", " 5 times", ", now", ".", " a", " I", "\nX1"]
    texts = [f"é to {x}{after}" for x in (gb, de, no) for after in afters] + [f"{gb} {de} {no}", f"{gb}x", f"{de}0", gb.replace("32", "33") + " Please", f"{no}, {gb} {gb}", "XX" + "1" * 30]
    got = [r["spans"] for r in find_pii(documents(spark, texts)).orderBy("doc_id").collect()]
    found = [[tuple(map(int, x.split(":")[1:])) for x in spans.split(",") if x.startswith("iban")] for spans in got]
    assert found[:30] == [[(5, 5 + len(x))] for x in (gb, de, no) for _ in afters]
    assert [[t[a:b] for a, b in f] for t, f in zip(texts[30:35], found[30:35])] == [[gb, de, no], [], [], [], [no, gb, gb]]


def test_passages_are_cut_by_the_block_size_of_the_plan(spark, monkeypatch):
    from quern.llm import mixing

    plan = mixing.plan
    monkeypatch.setattr(mixing, "plan", lambda sizes, weights, block_words, most: plan(sizes, weights, 2 * block_words, most))  # as for a very large source
    docs = documents(spark, [prose(k, 30 + k) for k in range(40)])
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs, block_words=8).where("taken > 0").collect()}
    got = mixing.mix_passages(docs, block_words=8).groupBy("doc_id").agg(F.sum(F.size(F.split(F.trim("text"), "\\s+"))).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == taken
