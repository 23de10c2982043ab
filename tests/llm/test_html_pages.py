"""Main text of generated pages against what was put in them, awkward pages, and time on hostile ones."""

import random
import time

from test_operators import prose


def test_cases_of_the_review():
    from quern.llm.html_text import FEATURES, main_text, tree

    long = prose(1, 40)
    assert main_text("<body><article><p>A</p><p>B</p></article></body>") == "A\nB"
    assert main_text("plain text without markup") == "plain text without markup"
    assert main_text(f"<div class='site-with-sidebar'><article><p>{long}</p></article></div>") == long
    assert main_text(f"<div id='form-wrap'><h1>Title</h1><p>{long}</p></div>") == f"Title\n{long}"
    assert main_text(f"<form><div class=header><a href=/>Home</a></div><h1>Title</h1><p>{long}</p></form>") == f"Title\n{long}"
    assert main_text(f"<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><h1>Heading</h1><p>{long}</p>") == f"Heading\n{long}"
    linked = prose(2, 30)
    assert main_text(f"<article><p>{long}</p><p><a href=x>{linked}</a></p><p>{long}</p></article>") == f"{long}\n{linked}\n{long}"
    assert main_text("<p>" + " ".join([long] * 5) + "<br>x &lt;b&gt; &#233;&nbsp;y") == " ".join([long] * 5) + " x <b> é y"
    used = set()

    def walk(node, depth=0):
        if isinstance(node, tuple):
            used.add(FEATURES[node[0]])
            walk(node[2], depth + 1)
            walk(node[3], depth + 1)

    walk(tree())
    assert {"words", "link density"} <= used and used & {"words before", "words after", "link density before", "link density after"}


def test_generated_pages_equal_what_was_put_in_them():
    from quern.llm.html_text import main_text

    rnd = random.Random(3)
    say = lambda a, b: prose(rnd.random(), rnd.randint(a, b))
    for _ in range(300):
        menu = "<nav><ul>" + "".join(f"<li><a href=/{k}>{say(1, 3)}</a>" for k in range(rnd.randint(0, 8))) + "</ul></nav>"
        ad = lambda: f'<div class="{rnd.choice(["ad", "ads", "cookie-notice", "newsletter", "share-buttons"])}"><p>{say(1, 40)}</p></div>'
        body, want = [], []
        for _ in range(rnd.randint(1, 9)):
            text, tag = say(1, 60), rnd.choice(["p", "p", "p", "h2", "li", "blockquote", "td"])
            shown = text.replace(" ", " <b>x</b>\n ", 1) if rnd.random() < 0.2 else text
            body.append(f"<{tag}>{shown}</{tag}>")
            want.append(" ".join(shown.replace("<b>", "").replace("</b>", "").split()))
            if rnd.random() < 0.2:
                body.append(rnd.choice([ad(), f"<aside><p>{say(1, 40)}</p></aside>", f"<script>var x='<p>{say(1, 9)}</p>';</script>", f"<!-- <p>{say(1, 9)}</p> -->", f"<form><p>{say(1, 20)}</p></form>"]))
        rest = f'<section id="comments"><article><p>{say(1, 90)}</p></article></section><footer><p>{say(1, 30)}</p></footer>'
        wrap = rnd.choice(["<div>", '<div class="page-with-sidebar">', "<div id=wrapper>", '<div class="layout sidebar">'])
        page = f"<html><head><title>{say(1, 5)}</title></head><body>{wrap}{menu if rnd.random() < 0.8 else ''}{ad() if rnd.random() < 0.4 else ''}<article>{''.join(body)}</article>{rest if rnd.random() < 0.8 else ''}</div></body></html>"
        assert main_text(page) == "\n".join(want), page


def test_awkward_and_hostile_pages(spark):
    from quern.llm.html_text import extract_html, main_text

    for piece in ("<a ", "<![CDATA[", "<a x='", "</b>", "</div>", "<div>", "<a x=\"'", "<p a='>", "<!--", "<script>", "<button>", "<div class=ad>", "<", "<a x='y\">", "<a '>", "&"):
        page = piece * (1_000_000 // len(piece))
        start = time.time()
        main_text(page)
        assert time.time() - start < 20, piece
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract_html(empty).count() == 0
    long = prose(5, 200_000)
    rows = [(1, "u", f"<article><p>{long}</p></article>"), (1, "u", f"<article><p>{long}</p></article>"), (None, None, None), (2, "v", "no markup at all")]
    got = extract_html(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")).collect()
    assert sorted((str(r["page_id"]), r["n_chars"], r["text"] == long) for r in got) == [("1", len(long), True), ("1", len(long), True), ("2", 16, False), ("None", 0, False)]
