"""Line dedup aggregates few rows for each line, brings only lines with a copy or a link together, and gives what plain Python does."""

import random

from pyspark.sql import functions as F

from quern.llm import line_dedup

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]


def _rows_made(df) -> int:
    """Rows that the explodes of ``df`` made."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Generate":
            found += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_a_long_line_is_few_rows(spark):
    rnd = random.Random(3)
    text = " ".join(rnd.choice(WORDS) + str(rnd.randrange(10**6)) for _ in range(700))
    each = line_dedup.lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).cache()
    texts = each.select("node", F.col("body").cast("binary").alias("body"))
    for made in (_rows_made(line_dedup.signatures(each)), _rows_made(line_dedup._marks(texts))):
        assert 0 < made <= len(text) / 8 + 3, (made, len(text))


def test_signatures_and_marks_are_those_of_every_shingle(spark):
    # sizes around whole steps of shingles, shingles that come again, and white space of each kind
    bodies = ["a", "abcdefg", "abcdefgh", "abcdefghi", "abababababababababababab", "é" * 30, *("x" + "yz0123456789" * 3 + "q" * k for k in range(20))]
    each = line_dedup.lines(spark.createDataFrame(enumerate(["A \t B\v\vc\r", "  a b C", "\t\f", "", *bodies]), "doc_id long, text string")).cache()
    got = {r["doc_id"]: r["body"] for r in each.collect()}
    assert got == {0: "a b c", 1: "a b c"} | {k + 4: b for k, b in enumerate(bodies)}
    at = each.select("node", F.col("body").cast("binary").alias("raw"))
    at = at.select("node", "raw", F.explode(F.sequence(F.lit(1), F.greatest(F.octet_length("raw") - 7, F.lit(1)))).alias("i"))
    hashes: dict[int, set[int]] = {}
    for node, h in at.select("node", F.xxhash64(F.substring("raw", F.col("i"), F.lit(8)))).collect():
        hashes.setdefault(node, set()).add(h & (1 << 64) - 1)
    marks = line_dedup._marks(each.select("node", F.col("body").cast("binary").alias("body")).dropDuplicates(["node"])).collect()
    assert len(marks) == len(hashes)
    for r in marks:
        words = [0] * 16
        for h in hashes[r["node"]]:
            words[h >> 6 & 15] ^= 1 << (h & 63)
        assert r["size"] == len(hashes[r["node"]]) and [r[f"bits{k}"] & (1 << 64) - 1 for k in range(16)] == words
    rows, masks = line_dedup.ROWS, line_dedup._MASKS
    low = [(n, *(min((h >> line_dedup._SHIFTS[k % 4] & 0xFFFFFFFF) ^ m for h in hs) for k, m in enumerate(masks))) for n, hs in hashes.items()]
    names = [f"m{k}" for k in range(len(masks))]
    want = spark.createDataFrame(low, ", ".join(f"{c} long" for c in ["node", *names]))
    want = want.select("node", F.array(*(F.xxhash64(F.lit(b), *names[b * rows : (b + 1) * rows]) for b in range(line_dedup.BANDS))).alias("bands"))
    assert dict(want.collect()) == dict(line_dedup.signatures(each).collect())


def test_only_lines_with_a_copy_or_a_link_are_brought_together(spark, monkeypatch):
    rnd = random.Random(5)
    alone = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(80))
    near = alone()
    texts = ["\n".join([alone(), "same line here", alone()]) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(30, near), (31, near[:-1] + "#"), (None, near), (None, alone()), (5, "same line here\nsame line here"), (40, None)]
    made, plain = {}, line_dedup.settle

    def settle(df, name):
        out = plain(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "settle", settle)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed_lines"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # of what repeats an id one line number stands for all: a null id is first, document 5 has lines 0, 1, 2 and 0, 1
    want = {k: (3, 1, [1]) for k in range(20)} | {0: (3, 0, []), 30: (1, 1, [0]), 31: (1, 1, [0]), None: (2, 1, []), 5: (5, 3, [0, 1, 1]), 40: (0, 0, [])}
    assert got == want
    assert made["line-groups"] == 22 + 3 and made["lines"] == 60 + 2 + 2 + 2
