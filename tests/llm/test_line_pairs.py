"""Lines of one large band that are no copies of one another are told apart before their texts are compared."""

import random

from quern.llm import line_dedup


def test_few_pairs_are_left_for_the_exact_check(spark, monkeypatch):
    rnd = random.Random(9)
    letters = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head = letters(760)
    lines = [head + letters(140) for _ in range(120)]  # similarity about 0.73
    lines.append(lines[5][:-1])  # but these two are a link
    made, plain = [], line_dedup.settle

    def settle(df, name):
        out = plain(df, name)
        if name == "line-pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "settle", settle)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["root"] for r in line_dedup.line_components(docs).collect()}
    assert got[5] == got[120] and len(set(got.values())) == 120
    assert made[-1] < 0.2 * 120 * 119 / 2, made
