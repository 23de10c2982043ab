"""Boolean selection and BM25 ranking of a query as one DataFrame plan."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import snippet
from quern.operators.index import Index, postings
from quern.plans.querylang import Node, all_terms, has_positive_filter, parse, positive_terms

K1, B = 1.5, 0.75


def idf(n_docs: Column, n: Column) -> Column:
    return F.log(1 + (n_docs - n + 0.5) / (n + 0.5))


def bm25(tf: Column, length: Column, avgdl: Column, weight: Column) -> Column:
    norm = F.when(avgdl > 0, 1 - B + B * length / avgdl).otherwise(1.0)
    return weight * tf * (K1 + 1) / (tf + K1 * norm)


def condition(node: Node, terms: list[str]) -> Column:
    """The query as a predicate over the columns has_i, at_i (positions of term i) and fields."""
    if node.kind == "term":
        return F.col(f"has_{terms.index(node.value)}")
    if node.kind == "field":
        return F.coalesce(F.try_element_at("fields", F.lit(node.field)) == node.value, F.lit(False))
    if node.kind == "phrase":
        (first, start), *rest = node.children
        at = lambda t, o: F.transform(f"at_{terms.index(t)}", lambda p: p - o)
        # where the phrase would begin, by each of its terms: one intersection after the other
        begins = reduce(F.array_intersect, (at(t, o) for t, o in rest), at(first, start))
        return F.coalesce(F.exists(begins, lambda p: p >= 0), F.lit(False))
    if node.kind == "not":
        return ~condition(node.children[0], terms)
    return reduce(operator.and_ if node.kind == "and" else operator.or_, (condition(c, terms) for c in node.children))


def matches(index: Index, node: Node, lengths: DataFrame | None = None) -> DataFrame:
    """One row for each document that has a term of the query: flags, positions, fields."""
    terms = list(dict.fromkeys(all_terms(node)))
    return _found(index, node).groupBy("file_id").agg(*_flags(node, terms))


def _found(index: Index, node: Node) -> DataFrame:
    """Postings of the query's terms; positions only where a phrase needs them."""
    terms = index.found(list(dict.fromkeys(all_terms(node))))
    if any(n.kind == "phrase" for n in _walk(node)):
        return postings(terms)
    return terms.groupBy("term", "file_id").agg(F.count("*").cast("int").alias("tf"))


def _flags(node: Node, terms: list[str]) -> list[Column]:
    aggs = [F.max(F.col("term") == t).alias(f"has_{k}") for k, t in enumerate(terms)]
    if any(n.kind == "phrase" for n in _walk(node)):
        aggs += [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"at_{k}") for k, t in enumerate(terms)]
    return aggs


def select(index: Index, query: str, implicit: str = "OR") -> DataFrame:
    """(file_id) of every live document that the query selects, ranked or not: NOT is the complement."""
    node = parse(query, implicit)
    if node is None:
        return index.docs.select("file_id").limit(0)
    terms = list(dict.fromkeys(all_terms(node)))
    rows = index.docs.select("file_id", "fields")
    if terms:
        rows = rows.join(matches(index, node), "file_id", "left")
        for k in range(len(terms)):
            rows = rows.withColumn(f"has_{k}", F.coalesce(f"has_{k}", F.lit(False)))
    return rows.where(condition(node, terms)).select("file_id")


def search(index: Index, query: str, top_k: int = 10, *, implicit: str = "OR", shards: DataFrame | None = None, stats: str = "global", exclude_shards: tuple = ()) -> DataFrame:
    """The best documents: file_id, score (rounded to 6 places), by score, then file_id.

    ``shards`` (file_id, shard) splits the corpus; each shard gives its ``top_k`` and these are merged. ``stats`` =
    "local" scores a shard with its own statistics, "global" with those of all shards, as one index would.
    Documents of ``exclude_shards`` do not answer; without their statistics nothing is global, so scoring is local then.
    """
    node = parse(query, implicit)
    empty = index.docs.select("file_id", F.lit(0.0).alias("score")).limit(0)
    if node is None or top_k <= 0:
        return empty
    wanted = positive_terms(node)
    if not wanted:
        if not has_positive_filter(node):
            return empty
        rows = select(index, query, implicit)
        if shards is not None and exclude_shards:
            rows = rows.join(shards.where(~F.col("shard").isin(*exclude_shards)), "file_id", "left_semi")
        return rows.orderBy("file_id").limit(top_k).select("file_id", F.lit(0.0).alias("score"))
    lengths = index.doc_lengths
    lengths = lengths.join(shards, "file_id") if shards is not None else lengths.withColumn("shard", F.lit(0))
    if exclude_shards:
        lengths, stats = lengths.where(~F.col("shard").isin(*exclude_shards)), "local"
    lengths = lengths.withColumn("group", F.lit(0) if stats == "global" else F.col("shard"))
    found = _found(index, node).join(lengths, "file_id")
    # a row for each shard, and one for each shard and term of the query: as many as shards and terms of one query
    corpus = lengths.groupBy("group").agg(F.count("*").alias("n_docs"), F.avg("length").alias("avgdl"))
    seen = found.groupBy("group", "term").agg(F.count("*").alias("n"))
    scored = found.join(F.broadcast(seen), ["group", "term"]).join(F.broadcast(corpus), "group")
    positive = F.col("term").isin(wanted)
    part = F.when(positive, bm25(F.col("tf"), F.col("length"), F.col("avgdl"), idf(F.col("n_docs"), F.col("n"))))
    terms = list(dict.fromkeys(all_terms(node)))
    rows = scored.groupBy("file_id", "shard").agg(F.round(F.sum(part), 6).alias("score"), F.count(F.when(positive, 1)).alias("positive"), *_flags(node, terms))
    rows = rows.where("positive > 0")
    if any(c.kind == "field" for c in _walk(node)):
        rows = rows.join(index.docs.select("file_id", "fields"), "file_id")
    rows = rows.where(condition(node, terms)).select("file_id", "shard", "score")
    if shards is not None:
        rows = shard_top_k(rows, top_k)
    return rows.select("file_id", "score").orderBy(F.desc("score"), "file_id").limit(top_k)


def _walk(node: Node):
    yield node
    for c in node.children:
        if isinstance(c, Node):
            yield from _walk(c)


def with_snippets(index: Index, hits: DataFrame, query: str) -> DataFrame:
    """``hits`` with a snippet of each; only their texts are read."""
    terms = positive_terms(parse(query))

    @F.pandas_udf("string")
    def cut(text):
        return text.map(lambda t: snippet(t, terms))

    return hits.join(index.docs.select("file_id", "text"), "file_id").select("file_id", "score", cut("text").alias("snippet"))


def merge_hits(hits: DataFrame, top_k: int) -> DataFrame:
    """Hits of several shards: of each document the best, then the best documents."""
    best = hits.groupBy("file_id").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "file_id").limit(top_k)


def shard_top_k(hits: DataFrame, top_k: int) -> DataFrame:
    """The best ``top_k`` hits (file_id, shard, score) of each shard, with their rank there."""
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("score"), "file_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= top_k)


def autocomplete(vocabulary: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Words that begin with the last token of ``prefix``, frequent ones first."""
    import re

    found = re.findall("[A-Za-z0-9]+", prefix)
    if not found:
        return vocabulary.limit(0)
    return vocabulary.where(F.col("surface").startswith(found[-1].lower())).orderBy(F.desc("freq"), "surface").limit(limit)


def did_you_mean(vocabulary: DataFrame, word: str, k: int = 2) -> DataFrame:
    """(surface, distance): words within ``k`` edits of one unknown word, near ones first."""
    import re

    found = [w.lower() for w in re.findall("[A-Za-z0-9]+", word)]
    if len(found) != 1 or not vocabulary.where(F.col("surface") == found[0]).isEmpty():
        return vocabulary.select("surface", F.lit(0).alias("distance")).limit(0)
    distance = F.levenshtein("surface", F.lit(found[0]), k)
    near = vocabulary.where(F.abs(F.length("surface") - len(found[0])) <= k).select("surface", distance.alias("distance"))
    return near.where(F.col("distance").between(1, k)).orderBy("distance", "surface")
