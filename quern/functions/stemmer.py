"""The original Porter stemmer (1980, with abli and logi) as SQL over a column of lower-case words.

A ``y`` that acts as a consonant is written ``Y`` first; then every condition of the algorithm is a
regular expression without backtracking references, so the same steps run in Spark SQL and in other engines.
A step reads the word that the last one left several times, so it binds it once: a one-element array goes
through all steps. The expression grows with the number of steps only, and a filter on stems may be pushed through it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C, V = "[^aeiouy]", "[aeiouy]"
M_POSITIVE = f"^({C}+)?{V}+{C}"
M_ONE = f"^({C}+)?{V}+{C}+({V}+)?$"
M_OVER_ONE = f"^({C}+)?{V}+{C}+{V}+{C}"
CVC = f"{C}{V}[^aeiouywxY]$"
DOUBLES = "|".join(c * 2 for c in "bcdfghjklmnpqrstvwxz0123456789") + "|yY|YY"

# Porter's suffix tables, in the algorithm's order.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def steps(dialect: str = "spark") -> list[str]:
    """SQL expressions over a column ``w``, to be applied one after the other."""
    spark = dialect == "spark"

    def has(x: str, pattern: str) -> str:
        return f"({x} rlike '{pattern}')" if spark else f"regexp_matches({x}, '{pattern}')"

    def cut(n: int) -> str:
        return f"substring(w, 1, length(w) - {n})"

    def rules(table, guard: str, first: str = "") -> str:
        cases = " ".join(f"WHEN w LIKE '%{s}' THEN CASE WHEN {has(cut(len(s)), guard)} THEN {cut(len(s))} || '{r}' ELSE w END" for s, r in table)
        return f"CASE {first} {cases} ELSE w END"

    mark = "regexp_replace(regexp_replace(w, '(^|[aeiou])y', '$1Y'), 'yy', 'yY')" if spark else r"regexp_replace(regexp_replace(w, '(^|[aeiou])y', '\1Y', 'g'), 'yy', 'yY', 'g')"
    bare = cut(1)
    return [
        mark,
        f"CASE WHEN w LIKE '%sses' THEN {cut(2)} WHEN w LIKE '%ies' THEN {cut(2)} WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN {cut(1)} ELSE w END",
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {has(cut(3), M_POSITIVE)} THEN {cut(1)} ELSE w END WHEN w LIKE '%ed' THEN CASE WHEN {has(cut(2), V)} THEN {cut(2)} || '#' ELSE w END "
        f"WHEN w LIKE '%ing' THEN CASE WHEN {has(cut(3), V)} THEN {cut(3)} || '#' ELSE w END ELSE w END",
        f"CASE WHEN w NOT LIKE '%#' THEN w WHEN w LIKE '%at#' OR w LIKE '%bl#' OR w LIKE '%iz#' THEN {bare} || 'e' "
        f"WHEN {has('w', f'({DOUBLES})#$')} THEN CASE WHEN {has('w', '[lsz]#$')} THEN {bare} ELSE {cut(2)} END "
        f"WHEN {has(bare, M_ONE)} AND {has(bare, CVC)} THEN {bare} || 'e' ELSE {bare} END",
        f"CASE WHEN {has('w', '[yY]$')} AND {has(cut(1), V)} THEN {cut(1)} || 'i' ELSE w END",
        rules(STEP2, M_POSITIVE),
        rules(STEP3, M_POSITIVE),
        rules([(s, "") for s in STEP4], M_OVER_ONE, f"WHEN {has('w', '[st]ion$')} AND {has(cut(3), M_OVER_ONE)} THEN {cut(3)}"),
        f"CASE WHEN w LIKE '%e' AND ({has(cut(1), M_OVER_ONE)} OR ({has(cut(1), M_ONE)} AND NOT {has(cut(1), CVC)})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {has('w', M_OVER_ONE)} THEN {cut(1)} ELSE w END",
        "lower(w)",
    ]


def stems(words: DataFrame, word: str = "surface", out: str = "term") -> DataFrame:
    """``words`` with the stem of each lower-case word; words of up to two characters stay."""
    made = f"array({word})"
    for step in steps():
        made = f"transform({made}, w -> {step})"
    return words.withColumn(out, F.expr(f"CASE WHEN length({word}) <= 2 THEN {word} ELSE element_at({made}, 1) END"))


def stem_sql(source: str, word: str = "surface", dialect: str = "duckdb") -> str:
    """A SELECT of (word, term) over the table expression ``source``."""
    sql = f"SELECT {word} AS s, {word} AS w FROM {source}"
    for step in steps(dialect):
        sql = f"SELECT s, CASE WHEN length(s) <= 2 THEN w ELSE {step} END AS w FROM ({sql})"
    return f"SELECT s AS {word}, w AS term FROM ({sql})"
