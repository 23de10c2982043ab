"""Quality rules (operator 9), in DataFrame functions only: risk-controlled thresholds.

Each rule rejects documents whose signal is above a cutoff.  Cutoffs are chosen
for each stratum (language) on labelled documents: going from the most lenient to the
strictest of a fixed grid, a cutoff stands while the exact binomial test rejects, at
the corrected level, that more than the allowed share of good documents falls
to it.  The level is split over all (stratum, rule) tests, the allowed share over the rules,
so all cutoffs hold together with probability 1 - delta.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._shared import settle

_SPACES = " \t\n\x0b\x0c\r"
LONG_TEXT_WORDS = 1 << 17
#: Signals, and grids of cutoffs from lenient to strict, fixed before any label is seen.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeat_ratio": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "dup_line_ratio": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "upper_ratio": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
}


def _shift(name: str, x: Column, bits: Column) -> Column:
    return F.call_function(name, x, bits)


def signals(docs: DataFrame) -> DataFrame:
    """Counts of each row of ``docs``: doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_letters."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select("doc_id", "stratum", "text", F.btrim("text", F.lit(_SPACES)).alias("bare"))
    words = F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    d = d.select("doc_id", "stratum", "text", words.alias("words"), lines.alias("lines"))
    n = F.size("words")
    # windows of three words as hashes; the place goes into the low bits, so one sort of integers brings equal windows together
    w = F.col("words")
    places = F.sequence(F.lit(0), n - 3)
    hashed = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    bits = F.ceil(F.log2(n.cast("double"))).cast("int")
    short = F.sort_array(F.transform(places, lambda i: _shift("shiftleft", _shift("shiftrightunsigned", hashed(i), bits), bits) + i))
    long = F.sort_array(F.transform(places, lambda i: F.struct(hashed(i).alias("h"), i.alias("i"))))
    empty = F.array().cast("array<long>")
    d = d.select(
        "doc_id", "stratum", "text", "words", "lines", bits.alias("bits"),
        F.when(n.between(3, LONG_TEXT_WORDS), short).otherwise(empty).alias("sorted"),
        F.when(n > LONG_TEXT_WORDS, long).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("sorted_long"),
    )
    s, b, t = F.col("sorted"), F.col("bits"), F.col("sorted_long")
    key = lambda x: _shift("shiftrightunsigned", x, b)
    twice = F.filter(s, lambda x, i: F.coalesce(key(F.get(s, i + 1)) == key(x), F.lit(False)) | F.coalesce(key(F.get(s, i - 1)) == key(x), F.lit(False)))
    twice_long = F.filter(t, lambda x, i: F.coalesce(F.get(t, i + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(t, i - 1)["h"] == x["h"], F.lit(False)))
    at = F.sort_array(
        F.concat(F.transform(twice, lambda x: (x - _shift("shiftleft", key(x), b)).cast("int")), F.transform(twice_long, lambda x: x["i"]))
    )
    joined = F.array_join("words", "")
    d = d.select("doc_id", "stratum", n.cast("long").alias("n_words"), joined.alias("joined"), F.col("lines"), at.alias("at"))
    p = F.col("at")
    # a window at place p brings min(3, distance to the next window) words that the next does not
    repeated = F.aggregate(F.sequence(F.lit(0), F.size("at") - 1), F.lit(0), lambda a, i: a + F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - F.get(p, i), F.lit(3))))
    upper = F.length("joined") - F.length(F.regexp_replace("joined", "[A-Z]+", ""))
    letters = F.length("joined") - F.length(F.regexp_replace("joined", "[A-Za-z]+", ""))
    symbols = F.length("joined") - F.length(F.regexp_replace("joined", "[#*$%&|<>]+", ""))
    return d.select(
        "doc_id", "stratum", "n_words", F.length("joined").cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("at") > 0, repeated).otherwise(0).cast("long").alias("n_repeat_words"), upper.cast("long").alias("n_upper"), letters.cast("long").alias("n_letters"),
    )


def _ratio(rule: str) -> Column:
    top, bottom = {"symbol_ratio": ("n_symbols", "n_words"), "repeat_ratio": ("n_repeat_words", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "upper_ratio": ("n_upper", "n_letters")}[rule]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n trials with chance p: the regularized incomplete beta I(1 - p; n - k, k + 1)."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_part(b, a, 1 - x)
    return _beta_part(a, b, x)


def _beta_part(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0  # Lentz's continued fraction
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * out


def choose_cutoffs(good: dict[str, int], above: dict[tuple[str, str, float], int], risk: float, delta: float) -> dict[tuple[str, str], float]:
    """{(stratum, rule): strictest cutoff that stands}; none where even the most lenient falls.

    ``good`` counts good labelled documents of a stratum, ``above`` those over a cutoff.
    """
    tests = max(1, len(good) * len(RULES))
    out = {}
    for stratum, n in good.items():
        for rule, grid in RULES.items():
            for cutoff in grid:
                if binomial_tail(above.get((stratum, rule, cutoff), 0), n, risk / len(RULES)) > delta / tests:
                    break
                out[stratum, rule] = cutoff
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, *, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    ``kept`` is false if the base rules fail (under 50 words, or over half of the
    words in repeated windows of three) or a cutoff of the document's language is passed.  Good documents that pass the base rules fall to
    the cutoffs with a share of at most ``risk`` in each language, with probability 1 - ``delta`` for all.

    A null text counts as empty; a null language is a stratum of its own, as is each value; one with too few
    labels gets no cutoff.  Labels with a null id or quality are not used, of labels of one id the
    best counts.  Repeated rows are kept; other columns are not read; without documents the result is empty,
    without labels only the base rules act.
    """
    made = settle(signals(docs), "signals")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    best = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("quality").alias("best"))
    held = made.where(~failed).join(best.where("best = 1").select("label_id"), F.col("doc_id") == F.col("label_id"))
    names = {f"c{i}_{j}": (rule, cutoff) for i, (rule, grid) in enumerate(RULES.items()) for j, cutoff in enumerate(grid)}
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *(F.sum((_ratio(rule) > cutoff).cast("long")).alias(c) for c, (rule, cutoff) in names.items())).collect()
    good = {r["stratum"]: r["n"] for r in counts}
    cutoffs = choose_cutoffs(good, {(r["stratum"], *names[c]): r[c] for r in counts for c in names}, risk, delta)
    verdict = F.lit(False)
    for (stratum, rule), cutoff in cutoffs.items():
        verdict = verdict | ((F.col("stratum") == stratum) & (_ratio(rule) > cutoff))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~verdict).alias("kept"))
