"""Fuzzy line dedup (operator 7): MinHash banding, exact Jaccard, union-find over lines.

Equal lines are one node.  A line's set is its distinct shingles of eight UTF-8 bytes (letters
lowered, runs of white space as one space); lines link if the sets' Jaccard similarity is at least the
threshold.  Signatures are cut into bands; the lines of a band each meet two of them that
the band picks, others in each band (two more where many components are left), and every pair met is decided by the exact similarity.
Then lines of a band that are still in different components meet one another, unless sizes or
parities rule a link out, so each link that has a band in common is decided.
One line of each component stays: the first by (doc_id, line).

All of it is DataFrame functions: shingles are an explode that feeds the minima within one
generated stage, and no group of lines is ever gathered.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._shared import drop, settle
from quern.llm.components import components

SHINGLE = 8
BANDS, ROWS = 7, 3
#: Each minimum is over 32 bits of the shingle's hash, from one of these places, under one of these masks.
_SHIFTS = (32, 20, 8, 0)
_MASKS = [(k % 8 << 29) | int(x) for k, x in enumerate(np.random.default_rng(7).integers(0, 1 << 29, BANDS * ROWS))]
_PICKS = [int(x) for x in np.random.default_rng(8).integers(0, 1 << 62, BANDS)]
_LOW = (1 << 32) - 1


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, node, body) of each line with a visible character; node names its normal form, body."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.lower(F.col("text").cast("string")), "\n")).alias("line", "raw"))
    # most lines have nothing to replace, and to look for it costs a small part of the expression
    uneven = reduce(or_, (F.col("raw").contains(c) for c in ("  ", "\t", "\v", "\f", "\r")))
    flat = F.when(uneven, F.regexp_replace("raw", r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")).otherwise(F.col("raw"))
    each = each.where(F.trim("raw", F.lit(" \t\v\f\r")) != "").select("doc_id", "line", F.trim(flat).alias("body"))
    return each.select("doc_id", "line", F.shiftrightunsigned(F.xxhash64("body"), 1).alias("node"), "body")


#: Shingles of a row where they are aggregated: the aggregate's own cost for a row is many times that of one more shingle.
_STEP = 8


def _last(n: Column) -> Column:
    """Where the last shingle of ``n`` bytes starts, from 1."""
    return F.greatest(n - (SHINGLE - 1), F.lit(1))



def signatures(each: DataFrame) -> DataFrame:
    """(node, bands) of each node of ``lines``."""
    raw = each.select("node", F.col("body").cast("binary").alias("raw"))
    raw = raw.select("node", "raw", _last(F.octet_length("raw")).alias("last"))
    at = raw.select("node", "raw", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(_STEP))).alias("i"))
    # past the end the last shingle stands again, which no minimum minds
    starts = [F.least(F.col("i") + j, "last") if j else F.col("i") for j in range(_STEP)]
    h = at.select("node", *(F.xxhash64(F.substring("raw", i, F.lit(SHINGLE))).alias(f"h{j}") for j, i in enumerate(starts)))
    cut = lambda k, j: F.shiftrightunsigned(f"h{j}", _SHIFTS[k % len(_SHIFTS)]).bitwiseAND(F.lit(_LOW))
    least = lambda k, m: F.least(*(cut(k, j).bitwiseXOR(F.lit(m)) for j in range(_STEP)))
    low = h.groupBy("node").agg(*(F.min(least(k, m)).alias(f"m{k}") for k, m in enumerate(_MASKS)))
    return low.select("node", F.array(*(F.xxhash64(F.lit(b), *(f"m{b * ROWS + r}" for r in range(ROWS))) for b in range(BANDS))).alias("bands"))


def _buckets(nodes: DataFrame) -> DataFrame:
    """(h, node, hubs) of the bands that several nodes have, written; hubs are the two that have the extremes of an order of the band's own."""
    entries = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    mask = F.element_at(F.array(*map(F.lit, _PICKS)), F.col("band") + 1)
    picked = entries.select("h", "band", F.col("node").bitwiseXOR(mask).alias("o")).groupBy("h", "band").agg(F.min("o").alias("lo"), F.max("o").alias("hi")).where("lo != hi")
    picked = settle(picked.select("h", F.array(F.col("lo").bitwiseXOR(mask), F.col("hi").bitwiseXOR(mask)).alias("hubs")), "line-hubs")
    buckets = settle(entries.select("node", "h").join(picked, "h").select("h", "node", "hubs"), "line-buckets")
    drop(picked)
    return buckets


def _hub_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b): each node of a band with the band's hubs."""
    met = buckets.select("node", F.explode("hubs").alias("hub")).where("node != hub")
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


#: Words of 64 places of a set's parity bits, and nodes of a band that one join key has on a side.
_WORDS = 16
_CHUNK = 4096


def _marks(texts: DataFrame) -> DataFrame:
    """(node, size, bits0, ...): the set's size, and the parity of how many of it fall to each place.

    Two sets differ in at least as many shingles as their parities do in places.
    """
    sets = texts.select("node", F.array_distinct(_shingles("body")).alias("s"))
    at = sets.select("node", F.size("s").cast("long").alias("size"), "s", F.explode(F.sequence(F.lit(0), F.size("s") - 1, F.lit(_STEP))).alias("i"))
    at = at.select("node", "size", *(F.get("s", F.col("i") + j).alias(f"s{j}") for j in range(_STEP)))  # null past the end
    at = at.select("node", "size", *(F.expr(f"int(s{j} >> 6 & {_WORDS - 1})").alias(f"w{j}") for j in range(_STEP)), *(F.expr(f"shiftleft(1L, int(s{j} & 63))").alias(f"b{j}") for j in range(_STEP)))
    word = [F.expr(f"bit_xor({' ^ '.join(f'if(w{j} = {k}, b{j}, 0L)' for j in range(_STEP))})").alias(f"bits{k}") for k in range(_WORDS)]
    return at.groupBy("node").agg(F.max("size").alias("size"), *word)


_BITS = [f"bits{k}" for k in range(_WORDS)]


def _room(percent: int) -> Column:
    """Whether sizes and parities of sides a and b leave room for a link."""
    apart = " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in _BITS)
    alike = f"{100 + percent} * (size_a + size_b - ({apart})) >= {2 * percent} * (size_a + size_b)"
    return F.expr(f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b) and {alike}")


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, node, root, top, top_n, n) of the bands that have several components, written: top is the largest, of top_n of the n nodes."""
    here = buckets.select("h", "node").join(labels, "node", "left").select("h", "node", F.coalesce("root", "node").alias("root"))
    each = here.groupBy("h", "root").agg(F.count("*").alias("n"))
    bands = each.groupBy("h").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top")).where("roots > 1")
    bands = bands.select("h", F.col("top.root").alias("top"), F.col("top.n").alias("top_n"), "n")
    return settle(here.join(bands, "h"), "line-mixed")


def _more_hub_pairs(mixed: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b): each node that is not of its band's largest component with two that round k picks, one of that component and one of the others, written."""
    of = lambda inside: F.min(F.when(inside, F.struct(F.xxhash64("node", "h", F.lit(k)).alias("o"), "node", "root")))
    hubs = mixed.groupBy("h").agg(of(F.col("root") == F.col("top")).alias("x"), of(F.col("root") != F.col("top")).alias("y"))
    hubs = hubs.select("h", F.explode(F.array("x", "y")).alias("hub")).select("h", F.col("hub.node").alias("hub"), F.col("hub.root").alias("hub_root"))
    met = mixed.where("root != top").select("h", "node", "root").join(hubs, "h").where("root != hub_root")
    return settle(met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "line-pairs")


def _rest_pairs(mixed: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a band and of different components that sizes and parities leave room for, written."""
    # a pair of two components has a side that is not of the band's largest
    parts = lambda n: F.ceil(n / _CHUNK).cast("int")
    here = mixed.select("h", "node", "root", "top", parts(F.col("n") - F.col("top_n")).alias("few"), parts(F.col("n")).alias("all")).join(marks, "node")
    spread = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    named = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "size", *_BITS)]
    x = here.where("root != top").select("h", "top", spread("few", 0).alias("i"), every("all").alias("j"), *named("a"))
    y = here.select("h", every("few").alias("i"), spread("all", 1).alias("j"), *named("b"))
    met = x.join(y, ["h", "i", "j"]).where("root_b = top or root_a < root_b").where(_room(percent))
    return settle(met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), "line-pairs")


def _shingles(body: str) -> Column:
    # as a variable the bytes are at hand for each shingle; from the row all of them would be copied for each
    each = lambda raw: F.transform(F.sequence(F.lit(1), _last(F.octet_length(raw))), lambda i: F.xxhash64(F.substring(raw, i, F.lit(SHINGLE))))
    return F.transform(F.array(body), each)[0]


def _decide(pairs: DataFrame, texts: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The links of ``pairs``, written: exact, where sizes and parities leave room."""
    side = lambda x: marks.select(*(F.col(c).alias(f"{c}_{x}") for c in ("node", "size", *_BITS))).withColumnRenamed(f"node_{x}", x)
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(_room(percent)).select("a", "b", "size_a", "size_b")
    both = near.join(texts.toDF("a", "body_a"), "a").join(texts.toDF("b", "body_b"), "b")
    # each set is named once: a filter is moved to where its parts are made, and makes what it names as often
    shared = F.size(F.array_intersect(_shingles("body_a"), _shingles("body_b"))).cast("long")
    links = both.where((100 + percent) * shared >= percent * (F.col("size_a") + F.col("size_b"))).select("a", "b")
    return settle(links, "line-links")


#: Rounds of hubs at most, the first included, and comparisons for each line of a band that need no further one.
HUB_ROUNDS, FEW_COMPARED = 2, 4


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    return components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))


def _roots(each: DataFrame, percent: int) -> DataFrame:
    """(node, root) of each node of ``lines`` that has a link, written; root is the least node of its component."""
    nodes = settle(signatures(each), "line-nodes")
    buckets = _buckets(nodes)
    drop(nodes)
    texts = each.select("node", F.col("body").cast("binary").alias("body")).join(buckets.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    texts = settle(texts, "line-texts")
    marks = settle(_marks(texts), "line-marks")
    pairs = settle(_hub_pairs(buckets), "line-pairs")
    links = _decide(pairs, texts, marks, percent)
    drop(pairs)
    labels = settle(components(links), "line-labels")
    drop(links)
    for k in range(HUB_ROUNDS):
        mixed = _mixed(buckets, labels)
        work, entries = mixed.agg(F.sum(F.when(F.col("root") != F.col("top"), F.col("n"))), F.count("*")).first()
        if k + 1 == HUB_ROUNDS or (work or 0) <= FEW_COMPARED * entries:
            break
        pairs = _more_hub_pairs(mixed, k)
        links = _decide(pairs, texts, marks, percent)
        drop(pairs)
        if links.isEmpty():
            drop(links)
            break
        before, labels = labels, settle(_joined(labels, links), "line-labels")
        drop(mixed, before, links)
    drop(buckets)
    pairs = _rest_pairs(mixed, marks, percent)
    drop(mixed)
    more = _decide(pairs, texts, marks, percent)
    drop(pairs, texts, marks)
    roots = settle(_joined(labels, more), "line-roots")
    drop(labels, more)
    return roots


def _judged(found: DataFrame) -> DataFrame:
    """(doc_id, line, root, stays) of ``found``, which has all lines of its components: the first of a component stays."""
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "line")).alias("first"))
    return found.join(first, "root").select("doc_id", "line", "root", ((F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("line") == F.col("first.line"))).alias("stays"))


def line_components(docs: DataFrame, *, percent: int = 80) -> DataFrame:
    """(doc_id, line, root, stays) of each line with a visible character."""
    each = settle(lines(docs), "lines")
    return _judged(each.select("doc_id", "line", "node").join(_roots(each, percent), "node", "left").select("doc_id", "line", F.coalesce("root", "node").alias("root")))


def _removed(each: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, line) of each line that does not stay, written.

    A line that no other equals and that has no link stays; only the others are brought together.
    """
    many = each.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    groups = many.join(roots, "node", "full").select("node", F.coalesce("root", "node").alias("root"))
    found = settle(each.select("doc_id", "line", "node").join(groups, "node").select("doc_id", "line", "root"), "line-groups")
    gone = settle(_judged(found).where(~F.col("stays")).select("doc_id", "line"), "line-removed")
    drop(found)
    return gone


def dedup_lines(docs: DataFrame, *, percent: int = 80) -> DataFrame:
    """One row for each doc_id: doc_id, n_lines, n_removed, removed_lines.

    Lines are counted from 0 in the text split at \\n; blank lines are neither counted nor removed.
    ``removed_lines`` are near copies (Jaccard of character shingles >= percent / 100, met by bands with high recall and
    decided exactly) of a line that stays.

    Null, empty and blank texts have no lines.  Rows that repeat a doc_id give one row; equal lines of them
    count as copies, but one line number stands for all of them; a null doc_id is a document.  Other columns are not read; an empty table gives an empty result.
    """
    each = settle(lines(docs), "lines")
    roots = _roots(each, percent)
    gone = _removed(each, roots)
    drop(roots)
    # a line number stays where it names a line that does
    both = each.select("doc_id", "line", F.lit(1).alias("n"), F.lit(0).alias("gone")).union(gone.select("doc_id", "line", F.lit(0), F.lit(1)))
    sums = both.repartition("doc_id").groupBy("doc_id", "line").agg(F.sum("n").alias("n"), F.sum("gone").alias("gone"))
    sums = sums.groupBy("doc_id").agg(F.sum("n").alias("n_lines"), (F.sum("n") - F.count_if(F.col("gone") < F.col("n"))).alias("n_removed"))
    named = gone.groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("removed_lines"))
    out = docs.select(F.col("doc_id").cast("long").alias("id")).distinct()
    for more in (sums, named):
        out = out.join(more, F.col("id").eqNullSafe(more["doc_id"]), "left").drop("doc_id")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"))
