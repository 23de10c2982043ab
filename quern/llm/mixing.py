"""Mixing sources to target weights (operator 6) by Sainte-Lague apportionment.

The words of a source lie on a circular line, its documents in seeded order.  The source's part of the mix is a walk along
it from a seeded place, up to ``MOST_PASSES`` times around, in blocks of equal size.  The mix is a row of
output shards; each takes its seats (blocks) from the sources by highest quotients target / (2 k + 1), so that every
shard has integer quotas, and the shards before it leave off where it goes on.  What a document gives follows from its
place on the line and the sum of its source's quotas, so blocks are never spelled out.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.llm._shared import settle

WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
#: Words of a block, at most; a block is at most a sixteenth of the least target, so that targets are met.
BLOCK_WORDS = 32
#: Blocks of all sources in an output shard, at least, and how many shards there are at most: beyond, they hold more blocks.
SHARD_BLOCKS, MOST_SHARDS = 4096, 256
_WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: str = "text") -> Column:
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: int = MOST_PASSES) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``most`` times its size."""
    rest, open_, out = float(sum(sizes)), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        weight = sum(weights[k] for k in open_)
        over = [k for k in open_ if rest * weights[k] / weight > most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = rest * weights[k] / weight
            break
        for k in over:
            out[k] = float(most * sizes[k])
        rest -= sum(out[k] for k in over)
        open_ = [k for k in open_ if k not in set(over)]
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 k + 1); equal quotients go to the earlier.

    ``most`` limits the seats of each.  Near-final seats come from the divisor, so that
    the highest quotients are only looked at for the last few.
    """
    n, most = len(votes), most or [seats] * len(votes)
    total = sum(votes)
    out = [0] * n
    if total <= 0:
        return out
    for k in range(n):  # below every final number: quotas less one for each that is limited or rounded up
        out[k] = min(most[k], max(0, int(votes[k] / total * max(0, seats - n)) - 1))
    heap = [(-votes[k] / (2 * out[k] + 1), k) for k in range(n) if out[k] < most[k] and votes[k] > 0]
    heapq.heapify(heap)
    left = seats - sum(out)
    while left > 0 and heap:
        _, k = heapq.heappop(heap)
        out[k] += 1
        left -= 1
        if out[k] < most[k]:
            heapq.heappush(heap, (-votes[k] / (2 * out[k] + 1), k))
    return out


@dataclass
class SourcePlan:
    source: str | None
    size: int
    target: float
    seats: int = 0
    upto: tuple[int, ...] = ()  # seats in the shards before each shard, and in all


@dataclass
class MixPlan:
    sources: list[SourcePlan]
    block_words: int
    seats: int
    shards: int

    def shard_quotas(self, shard: int) -> list[int]:
        """Blocks of each source in an output shard."""
        return [s.upto[shard + 1] - s.upto[shard] for s in self.sources]


def plan(sizes: dict[str | None, int], weights=WEIGHTS, block_words: int = BLOCK_WORDS, most: int = MOST_PASSES) -> MixPlan:
    """Quotas of every output shard: the apportionment grows by a shard's seats at a time, and a source never loses by it."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    own = [sizes[s] for s in names]
    want = targets(own, [float(weights[k % len(weights)]) for k in range(len(names))], most)
    block_words = max(1, min([block_words, *(int(t) // 16 for t in want if t > 0)]))
    sources = [SourcePlan(s, n, t) for s, n, t in zip(names, own, want)]
    seats = round(sum(want) / block_words)
    limits = [-(-most * n // block_words) for n in own]
    shard_blocks = max(SHARD_BLOCKS, -(-seats // MOST_SHARDS))
    shards = max(1, -(-seats // shard_blocks))
    upto = [sainte_lague(want, min(seats, shard_blocks * k), limits) for k in range(shards + 1)]
    for k, s in enumerate(sources):
        s.upto = tuple(u[k] for u in upto)
        s.seats = s.upto[-1]
    return MixPlan(sources, block_words, seats, shards)


def _mix(rows: DataFrame, weights, block_words: int, most: int, seed: int) -> DataFrame:
    """``rows`` (row, doc_id, source, size, tie) with what the mix takes of each."""
    spark = rows.sparkSession
    rows = settle(rows, "sizes")
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    made = plan(sizes, weights, block_words, most)
    schema = T.StructType(
        [T.StructField("name", T.StringType()), *(T.StructField(k, T.LongType()) for k in ("source_size", "words", "turn")), T.StructField("target", T.DoubleType()), T.StructField("upto", T.ArrayType(T.LongType()))]
    )
    table = []
    for k, s in enumerate(made.sources):
        blocks = -(-s.size // made.block_words)
        turn = (seed * 2654435761 + k * 40503) % blocks * made.block_words if blocks else 0
        table.append((s.source, s.size, min(s.seats * made.block_words, most * s.size), turn, s.target, list(s.upto[1:])))
    sources = spark.createDataFrame(table, schema)
    placed = _placed(rows, seed).join(sources, F.col("source").eqNullSafe(F.col("name")), "left")
    line, n = F.col("source_size"), F.col("size")
    around = F.greatest(line, F.lit(1))  # a source without words has no line
    placed = placed.withColumn("place", F.pmod(F.col("first_word") - F.col("turn"), around))
    placed = placed.withColumn("passes", F.call_function("div", F.col("words"), around)).withColumn("rest", F.pmod("words", around))
    upto = lambda x: F.col("passes") * x + F.least(x, F.col("rest"))  # noqa: E731  words taken of the first x of the line
    end = F.col("place") + n
    taken = F.when(end <= line, upto(end) - upto(F.col("place"))).otherwise(upto(line) - upto(F.col("place")) + upto(end - line))
    placed = placed.withColumn("taken", F.when(n > 0, taken).otherwise(F.lit(0)).cast("long")).withColumn("block_words", F.lit(made.block_words).cast("long"))
    return placed.withColumn("shard", F.when(F.col("taken") > 0, _shard(F.when(F.col("place") < F.col("words"), F.col("place")).otherwise(F.lit(0)))))


def _shard(word: Column) -> Column:
    """The output shard of a word of a source's walk."""
    return F.size(F.filter("upto", lambda u: u * F.col("block_words") <= word))


def mix_sources(docs: DataFrame, *, weights=WEIGHTS, block_words: int = BLOCK_WORDS, most: int = MOST_PASSES, seed: int = 20240607) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken, first_word, place, passes, rest, shard, block_words.

    ``size`` counts words (null text: 0); sources by code point, null last, weigh ``weights`` in turn.
    ``taken`` counts the words that the mix takes, repeats included: all of the document ``passes`` times, and those of its words once more
    that lie before ``rest`` on the source's line.  ``first_word`` is the place of the document on that line, ``place`` counted
    from where the walk begins.  ``shard`` is the output shard of the first word taken, null if none is.
    A source gets its target but for less than a block.

    A null doc_id, repeated rows and empty texts keep their rows (an empty text gives
    nothing).  Other columns are not read.  An empty table gives an empty result.
    What is collected is one total for each source; quotas are made for at most MOST_SHARDS shards.
    """
    rows = _mix(_rows(docs, F.lit(None).cast("long")), weights, block_words, most, seed)
    return rows.select("doc_id", "size", "source_size", "target", "taken", "first_word", "place", "passes", "rest", "shard", "block_words")


def _rows(docs: DataFrame, row: Column) -> DataFrame:
    return docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), F.xxhash64("text").alias("tie"))


def _placed(sized: DataFrame, seed: int) -> DataFrame:
    """``sized`` with first_word: the words before each document on its source's line.

    The seeded order is cut into 4096 ranges for each source, and sums run within a
    range and over ranges, so no task holds a whole source.  Rows that are equal in id, size and text are alike.
    """
    keyed = sized.withColumn("key", F.xxhash64("doc_id", "tie", F.lit(seed)))
    keyed = keyed.withColumn("range", F.shiftrightunsigned("key", 52).cast("int"))
    sums = keyed.groupBy("source", "range").agg(F.sum("size").alias("n"))
    over = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = keyed.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    return joined.select("row", "doc_id", "source", "size", (F.col("before") + F.col("inside")).alias("first_word"))


def mix_passages(docs: DataFrame, *, with_shard: bool = False, weights=WEIGHTS, block_words: int = BLOCK_WORDS, most: int = MOST_PASSES, seed: int = 20240607) -> DataFrame:
    """The mix itself: the columns of ``docs`` for each pass over a document, with the text taken.

    A whole pass has the whole text; of the last, partial pass there is a row for each run of words taken, as written from
    the first word to the last.  ``n_chars`` counts the text of a run.  ``with_shard`` adds mix_shard, the output shard of a row's first word.
    A document of which nothing is taken has no row.  Each row of ``docs`` gives what it is to give, whatever other
    rows share its doc_id.
    """
    # a written number names the row
    numbered = settle(docs.withColumn("__mix_row", F.monotonically_increasing_id()), "mix-rows")
    own = settle(_mix(_rows(numbered, F.col("__mix_row")), weights, block_words, most, seed).where("taken > 0"), "mix")
    own = own.select(F.struct("row", "size", "source_size", "place", "passes", "rest", "upto", "block_words").alias("__mix"))
    d = numbered.join(own, F.col("__mix_row") == F.col("__mix.row"))
    mine = lambda name: F.col(f"__mix.{name}")
    n, line, place, rest = mine("size"), mine("source_size"), mine("place"), mine("rest")
    # runs of words: (pass, from, to); of a document around the walk's start, the words from there on come first in each pass
    head = F.least(n, line - place)
    part = lambda begin, end: F.struct(mine("passes").cast("int").alias("pass"), begin.alias("a"), end.alias("b"))
    last = F.array(part(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.least(head, rest - place))), part(head, head + F.least(rest, n - head)))
    whole = F.transform(F.sequence(F.lit(0), mine("passes").cast("int") - 1), lambda k: F.struct(k.alias("pass"), F.lit(0).cast("long").alias("a"), n.alias("b")))
    whole = F.when(mine("passes") > 0, whole).otherwise(F.array().cast("array<struct<pass:int,a:bigint,b:bigint>>"))
    runs = F.filter(F.concat(whole, last), lambda r: r["b"] > r["a"])
    d = d.withColumn("__run", F.explode(runs))
    words = F.regexp_extract_all("text", F.lit(f"{_WORD}[\\x20\\x09-\\x0D]*"), F.lit(0))
    a, b = F.col("__run.a"), F.col("__run.b")
    text = F.when(b - a == n, F.col("text")).otherwise(F.array_join(F.slice(words, (a + 1).cast("int"), (b - a).cast("int")), ""))
    d = d.withColumn("text", text).withColumn("n_chars", F.when(b - a == n, F.col("n_chars")).otherwise(F.length("text")).cast("long"))
    if with_shard:
        start = F.pmod(place + a, line) + F.col("__run.pass") * line
        d = d.withColumn("mix_shard", F.size(F.filter("__mix.upto", lambda u: u * mine("block_words") <= start)))
    return d.select(*docs.columns, *(["mix_shard"] if with_shard else []))
