"""Personal data (operator 4), in DataFrame functions only.

Regular expressions propose spans, checksums (Luhn, mod 97) and value ranges
confirm them, and words nearby raise or lower a score.  Base kinds keep every span that
is confirmed; the method adds kinds that need a checksum or context to be believed.

Repeated groups are possessive and start only where a run of their characters
starts (or the last match ended), which is the same leftmost match and takes neither a
stack nor the square of a long run.  Where an IBAN ends no pattern can tell: one proposes its
head and the characters that may follow, and of the ends of words there the checksum takes one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    base: float  # score of a confirmed span without context
    near: str  # words that speak for it
    far: str  # words that speak against it


#: The base kinds, in the order in which spans of equal start are listed.
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write", "example"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){2}\.[0-9]++", 0.6, "ip|host|server|address", "version|release|chapter"),
    Kind("card", r"(?:(?<![0-9])|(?<=[0-9])\G)[0-9](?:[\x20-]?[0-9]){11,}+", 0.8, "card|visa|credit|payment", "order|isbn|serial"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "phone|call|tel|mobile|fax", "sum|total"),
)
#: Kinds that the method adds.
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))", 0.9, "iban|account|bank", "serial"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social|security", "phone|fax"),
)
KINDS = BASE + ADDED
#: Characters of an IBAN by country, as registered.
IBAN_LENGTHS = {
    c: int(x[:2])
    for x in (
        "15NO 16BE 18DKFIFOGLNLSDFK 19MKSI 20ATBAEEKZLTLUXKMN 21CHHRLILV 22BGBHCRDEGBGEIEMERSVA 23AEGIILIQTLSOOM 24ADCZESMDPKROSASESKTNVG "
        "25LYPTST 26ISTR 27BIDJFRGRITMCMRSM 28ALAZBYCYDOGTHULBNIPLSV 29BREGPSQAUA 30JOKWMUYE 31MTSC 32LC 33RU"
    ).split()
    for c in map("".join, zip(x[2::2], x[3::2]))
}
CONTEXT_CHARS = 40
CONTEXT_WEIGHT = 0.3
LEAST_SCORE = 0.5  # for added kinds


def _digit(text: Column, at: Column) -> Column:
    return F.ascii(F.substring(text, at, F.lit(1))) - 48


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = _digit(digits, n - k) * F.when(k % 2 == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _mod97(bare: Column) -> Column:
    def sum_up(turned: Column) -> Column:
        def add(rest: Column, k: Column) -> Column:
            c = F.ascii(F.substring(turned, k, F.lit(1)))
            return F.when(c < 58, (rest * 10 + (c - 48)) % 97).otherwise((rest * 100 + (c - 55)) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1

    return _let(F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4)), sum_up)


def _iban(head: Column, tail: Column) -> Column:
    """The IBAN from ``head`` on, null if none: of the ends of words in ``tail`` that mod 97 confirms the one of the
    country's length; else all of the tail, or for countries without a known length the longest."""
    lengths = F.create_map(*(F.lit(x) for item in IBAN_LENGTHS.items() for x in item))

    def pick(words: Column) -> Column:
        ends = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.concat(head, F.array_join(F.slice(words, F.lit(1), k), " ")))
        each = F.transform(ends, lambda e: F.struct(e.alias("found"), F.translate(e, " ", "").alias("bare")))
        sure = F.filter(each, lambda e: F.when(F.length(e["bare"]).between(15, 34) & ~e["found"].rlike("[a-z ]$"), _mod97(e["bare"])).otherwise(False))
        size = F.element_at(lengths, F.left(head, F.lit(2)))
        whole = F.concat(head, tail)
        return _let(
            sure,
            lambda s: F.coalesce(
                F.get(F.filter(s, lambda e: F.length(e["bare"]) == size), F.lit(0)), F.get(F.filter(s, lambda e: size.isNull() | (e["found"] == whole)), F.size(F.filter(s, lambda e: size.isNull() | (e["found"] == whole))) - 1)
            )["found"],
        )

    return _let(F.split(tail, " "), pick)


def _confirmed(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, "\\."), lambda p: ~F.left(p, F.length(p) - 3).rlike("[1-9]") & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        digits = F.translate(found, " -", "")
        return F.when(F.length(digits).between(12, 19), _let(digits, _luhn)).otherwise(False)
    if kind == "phone":
        return F.length(F.translate(found, "+ ().-", "")).between(9, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value made once, also where a lambda uses it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(lengths: Column) -> Column:
    """Sums of the elements before each one, in about n * sqrt(n) steps."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    div = lambda x, y: F.call_function("div", x, y).cast("int")

    def within(z: Column) -> Column:
        at, step = z["at"], z["step"]
        groups = F.transform(F.sequence(F.lit(0), div(F.size(at) - 1, step)), lambda g: add(F.slice(at, g * step + 1, step)))
        heads = _let(groups, lambda gs: F.transform(F.sequence(F.lit(0), F.size(gs) - 1), lambda g: add(F.slice(gs, F.lit(1), g))))
        return _let(
            heads,
            lambda hs: F.transform(F.sequence(F.lit(0), F.size(at) - 1), lambda i: F.get(hs, div(i, step)) + add(F.slice(at, i - i % step + 1, i % step))),
        )

    return _let(F.struct(lengths.alias("at"), F.ceil(F.sqrt(F.size(lengths).cast("double"))).cast("int").alias("step")), within)


_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


def _apart(spans: Column) -> Column:
    """Those of ``spans`` that do not start within the last one taken before."""
    first = F.slice(spans, F.lit(1), F.lit(1))
    return F.aggregate(spans, first, lambda taken, x: F.when(x["start"] >= F.get(taken, F.size(taken) - 1)["end"], F.concat(taken, F.array(x))).otherwise(taken))


def _spans(kind: Kind, rank: int, found: Column, gaps: Column, tails: Column | None = None) -> Column:
    """Confirmed spans of one kind, from its matches and the text between them; with ``tails`` a match is a head only."""
    n = F.size(found)
    lengths = F.zip_with(F.slice(gaps, F.lit(1), n), found, lambda g, m: F.length(g) + F.length(m))
    raw = F.arrays_zip(found.alias("m"), _before(lengths).alias("b"), F.slice(gaps, F.lit(1), n).alias("g"), F.slice(gaps, F.lit(2), n).alias("h"))
    if tails is None:
        sure = F.filter(raw, lambda x: _confirmed(kind.name, x["m"]))
    else:
        whole = F.zip_with(raw, tails, lambda x, t: x.withField("m", _iban(x["m"], t)).withField("h", F.concat(x["m"], x["h"])))
        sure = F.transform(F.filter(whole, lambda x: x["m"].isNotNull()), lambda x: x.withField("h", F.substr(x["h"], F.length(x["m"]) + 1)))

    def scored(x: Column) -> Column:
        near = F.lower(F.concat(F.right(x["g"], F.lit(CONTEXT_CHARS)), F.lit(" "), F.left(x["h"], F.lit(CONTEXT_CHARS))))
        word = lambda w: F.when(near.rlike(f"(?<![a-z])(?:{w})"), CONTEXT_WEIGHT).otherwise(0.0)
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(kind.base) + word(kind.near) - word(kind.far)))
        start = x["b"] + F.length(x["g"])
        return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (start + F.length(x["m"])).cast("int").alias("end"), score.alias("score"))

    out = F.transform(sure, scored)
    if tails is not None:
        out = _apart(out)
    if kind in ADDED:
        out = F.filter(out, lambda x: x["score"] >= LEAST_SCORE)
    return F.when(n > 0, out).otherwise(F.array().cast(_SPAN))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores.

    Counts and ``base_sha256`` are of the base kinds; ``spans`` lists all kinds as
    kind:start:end (code points, end exclusive) by start, then kind; ``scores`` in that order.

    A null text counts as empty; null ids and repeated rows are kept; other columns are not
    read.  An empty table gives an empty result.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = out.select("doc_id", "text", *(F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)).alias(f"m_{k.name}") for k in KINDS), *(F.regexp_extract_all("text", F.lit(k.pattern), F.lit(1)).alias(f"t_{k.name}") for k in KINDS if k.name == "iban"))
    tails = {k.name: F.col(f"t_{k.name}") for k in KINDS if k.name == "iban"}
    empty = F.array().cast("array<string>")
    gaps = (F.when(F.size(f"m_{k.name}") > 0, F.split("text", k.pattern, -1)).otherwise(empty).alias(f"g_{k.name}") for k in KINDS)
    out = out.select("*", *gaps)
    out = out.select("doc_id", *(_spans(k, r, F.col(f"m_{k.name}"), F.col(f"g_{k.name}"), tails.get(k.name)).alias(k.name) for r, k in enumerate(KINDS)))
    sort = lambda kinds: F.array_sort(F.concat(*(F.col(k.name) for k in kinds)))
    out = out.select("doc_id", *(F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE), sort(BASE).alias("base"), sort(KINDS).alias("all"))
    return out.select(
        "doc_id", *(f"n_{k.name}" for k in BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), F.transform("all", lambda x: x["score"]).alias("scores")
    )
