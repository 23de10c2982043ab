"""Text analysis: tokens, stop words, stems of words, snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import stemmer

# The stop words of the search language.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further "
    "had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours "
    "ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with you your yours yourself yourselves".split()
)
TOKEN = "[A-Za-z0-9]+"


def tokenize(text: Column) -> Column:
    """Lower-case ASCII alphanumeric runs; other characters, accented letters too, separate."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(found, F.lower)


def tokens(docs: DataFrame) -> DataFrame:
    """(file_id, position, surface): positions count all tokens, stop words included."""
    return docs.select("file_id", F.posexplode(tokenize(F.col("text"))).alias("position", "surface"))


def token_offsets(docs: DataFrame) -> DataFrame:
    """(file_id, position, surface, begin, end): tokens with their places [begin, end) in the UTF-8 bytes of the text."""
    from quern.functions import scan

    return scan.token_offsets(docs)


def analyze(docs: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(file_id, position, surface, term); of ``wanted`` terms only, if given.  No row leaves its partition."""
    from quern.functions import scan

    return scan.analyze(docs, wanted)


def not_stop(surface: str = "surface") -> Column:
    return ~F.col(surface).isin(*STOP_WORDS)


def looks_like_text(data: Column) -> Column:
    """Not empty, and no NUL in the first 8192 bytes."""
    return (F.length(data) > 0) & ~F.call_function("contains", F.substring(data, 1, 8192), F.lit(b"\x00"))


# --- the same analysis for a few words on the driver (queries, snippets of the top k)


_Y, _YY = re.compile("(^|[aeiou])y"), re.compile("yy")
_M_POSITIVE, _M_ONE, _M_OVER_ONE, _CVC, _V, _DOUBLES = (re.compile(p).search for p in (stemmer.M_POSITIVE, stemmer.M_ONE, stemmer.M_OVER_ONE, stemmer.CVC, stemmer.V, f"({stemmer.DOUBLES})$"))
_STEP2, _STEP3, _STEP4 = ((table, tuple(suffix for suffix, _ in table)) for table in (stemmer.STEP2, stemmer.STEP3, tuple((s, "") for s in stemmer.STEP4)))


def stem_word(word: str) -> str:
    """Porter's stem of one lower-case word, from the same steps."""
    if len(word) <= 2:
        return word
    w = _YY.sub("yY", _Y.sub(r"\1Y", word)) if "y" in word else word
    has = lambda p, x: p(x) is not None

    def first(w: str, table, ends: tuple, guard) -> str:
        if not w.endswith(ends):
            return w
        for suffix, instead in table:
            if w.endswith(suffix):
                s = w[: -len(suffix)]
                return s + instead if has(guard, s) else w
        return w

    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    stripped = False
    if w.endswith("eed"):
        w = w[:-1] if has(_M_POSITIVE, w[:-3]) else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                if has(_V, w[: -len(suffix)]):
                    w, stripped = w[: -len(suffix)], True
                break
    if stripped:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif has(_DOUBLES, w):
            w = w if w[-1] in "lsz" else w[:-1]
        elif has(_M_ONE, w) and has(_CVC, w):
            w += "e"
    if w[-1:] in ("y", "Y") and has(_V, w[:-1]):
        w = w[:-1] + "i"
    w = first(first(w, *_STEP2, _M_POSITIVE), *_STEP3, _M_POSITIVE)
    if w.endswith(("sion", "tion")) and has(_M_OVER_ONE, w[:-3]):
        w = w[:-3]
    else:
        w = first(w, *_STEP4, _M_OVER_ONE)
    if w.endswith("e") and (has(_M_OVER_ONE, w[:-1]) or has(_M_ONE, w[:-1]) and not has(_CVC, w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and has(_M_OVER_ONE, w):
        w = w[:-1]
    return w.lower()


def analyze_word(word: str) -> list[str]:
    """The terms of one query word: none for a stop word, several for ``write-ahead``."""
    return [stem_word(t) for t in (x.lower() for x in re.findall(TOKEN, word)) if t not in STOP_WORDS]


def snippet(text: str | None, terms: list[str], context: int = 90, snap: int = 20) -> str:
    """The surroundings, in bytes, of the first token with one of ``terms``; empty without one."""
    raw, wanted = (text or "").encode(), set(terms)
    for m in re.finditer(TOKEN.encode(), raw):
        word = m[0].decode().lower()
        if word not in STOP_WORDS and stem_word(word) in wanted:
            break
    else:
        return ""
    blank = b" \t\n\v\f\r"
    begin, end = max(0, m.start() - context), min(len(raw), m.start() + context)
    floor, ceiling = max(0, begin - snap), min(len(raw), end + snap)
    while begin > floor and raw[begin] not in blank:
        begin -= 1
    while end < ceiling and raw[end] not in blank:
        end += 1
    body = raw[begin:end].replace(b"\n", b" ").replace(b"\r", b" ").decode(errors="replace")
    return ("..." if begin else "") + body + ("..." if end < len(raw) else "")
