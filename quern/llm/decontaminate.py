"""Benchmark decontamination (operator 1): n-gram seeds, then Smith-Waterman.

The seeds are n-grams of the test items, and spaced ones (three words of four in a row), which survive where every third word
is changed; items of few words have pairs of words too, and those of one or two words themselves.  One pass over the documents joins them to
items by those seeds and aligns each item with the words around its seeds, unless too few
of the item's words stand there for the score.  No seed is dropped for being frequent: which
ones an edited copy keeps cannot be told from how many documents have them.  Texts
are never shuffled; what moves is the result.

Items are taken in blocks of at most ``block_seeds`` seeds, so what is sent to the executors has
that bound at any size of the benchmark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._shared import give_back, mix, scan_words, slices, span_hashes, text_buffers

MATCH, MISMATCH, GAP = 2, -1, -1
_SHIFT = 32  # scores stand above the start column in one integer
SCHEMA = "doc_id long, item_id long, score double, n_seeds int, start_word int, end_word int"


#: Items of fewer words have pairs of words as seeds too.
SHORT_WORDS = 12


def _shapes(words: int, n: int) -> list[tuple[int, ...]]:
    """The seeds of an item: which words of a run each is made of."""
    if words < n:
        return [tuple(range(words))]
    whole = [tuple(range(n))] + [tuple(k for k in range(n + 1) if k != gap) for gap in range(1, n) if words > n]
    return whole + ([(0, 1)] if words < SHORT_WORDS and n > 2 else [])


def shape_hashes(words: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A hash for each place at which the shape's words stand in ``words``."""
    span = shape[-1] + 1
    if len(words) < span:
        return np.zeros(0, np.uint64)
    count = len(words) - span + 1
    out = words[:count].copy()
    for k in shape[1:]:
        out = mix(out) * np.uint64(0xA24BAED4963EE407) + words[k : k + count]
    return mix(out + np.uint64(sum(1 << k for k in shape)))


@dataclass
class ItemBlock:
    """Some test items: their words, and their seeds sorted by hash; ``shapes`` are the places of a seed's words."""

    item_ids: list
    words: list[np.ndarray]
    seeds: np.ndarray  # distinct hashes, ascending
    owner_first: np.ndarray  # the (item, position) pairs of seed k are owner_first[k] .. owner_first[k + 1]
    owner_item: np.ndarray
    owner_at: np.ndarray
    bits: np.ndarray  # a quick filter by the lowest 20 bits
    shapes: list[tuple[int, ...]]

    @classmethod
    def make(cls, item_ids, words, n) -> ItemBlock:
        hashes, items, ats, used = [], [], [], set()
        for k, w in enumerate(words):
            for shape in _shapes(len(w), n):
                g = shape_hashes(w, shape)
                used.add(shape)
                hashes.append(g)
                items.append(np.full(len(g), k))
                ats.append(np.arange(len(g)))
        h, item, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, items, ats))
        order = np.argsort(h, kind="stable")
        h, item, at = h[order].astype(np.uint64), item[order], at[order]
        seeds, first = np.unique(h, return_index=True)
        bits = np.zeros(1 << 20, bool)
        bits[(seeds & np.uint64(0xFFFFF)).astype(np.int64)] = True
        return cls(item_ids, words, seeds, np.append(first, len(h)), item, at, bits, sorted(used))

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``grams``, numbers of the seeds there)."""
        at = np.flatnonzero(self.bits[(grams & np.uint64(0xFFFFF)).astype(np.int64)])
        if not len(at) or not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.seeds, grams[at]), len(self.seeds) - 1)
        same = self.seeds[k] == grams[at]
        return at[same], k[same]


def _item_blocks(items: DataFrame, n: int, block_seeds: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    ids, words, held = [], [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        data, offsets = text_buffers(pa.array([row["text"]], pa.string()))
        w = scan_words(data, offsets)
        w = span_hashes(data, w.starts, w.ends)
        if not len(w):
            continue
        ids.append(row["item_id"])
        words.append(w)
        held += n * len(w)  # shapes of a seed
        if held >= block_seeds:
            yield ids, words
            ids, words, held = [], [], 0
    if ids:
        yield ids, words


def _scanned(batch: pa.RecordBatch):
    """For each slice of texts: (first row, words of the slice, their hashes)."""
    data, offsets = text_buffers(batch.column("text"))
    for i, j in slices(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        w = scan_words(part, off)
        yield i, w, span_hashes(part, w.starts, w.ends)


def _own(w, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts at word positions ``at``, and whether n words from there stay in the text."""
    text = np.searchsorted(w.first, at, "right") - 1
    return text, at + n <= w.first[text + 1]


def align(windows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of (item, passage) pairs: best scores, first and end words in the passage.

    All pairs advance together, one item word at a time.
    """
    rows, cols = max(len(a) for a, _ in windows), max(len(b) for _, b in windows)
    item, item_len = np.zeros((len(windows), rows), np.uint64), np.array([len(a) for a, _ in windows])
    passage, passage_len = np.zeros((len(windows), cols), np.uint64), np.array([len(b) for _, b in windows])
    for k, (a, b) in enumerate(windows):
        item[k, : len(a)], passage[k, : len(b)] = a, b
    one = 1 << _SHIFT
    column = np.arange(cols + 1, dtype=np.int64)
    fresh = np.broadcast_to(column, (len(windows), cols + 1))
    above = fresh.copy()
    best, best_end = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    inside = column[None, :] <= passage_len[:, None]
    for r in range(rows):
        live = r < item_len
        same = passage == item[:, r : r + 1]
        cell = np.maximum(fresh, above + GAP * one)
        cell[:, 1:] = np.maximum(cell[:, 1:], above[:, :-1] + np.where(same, MATCH * one, MISMATCH * one))
        slope = column * (-GAP * one)
        cell = np.maximum.accumulate(cell + slope, axis=1) - slope
        cell = np.where(live[:, None], cell, above)
        seen = np.where(inside, cell, 0)
        at = seen.argmax(axis=1)
        top = seen[np.arange(len(windows)), at]
        better = live & (top >> _SHIFT > best >> _SHIFT)
        best[better], best_end[better] = top[better], at[better]
        above = cell
    return best >> _SHIFT, best & (one - 1), best_end


def decontaminate(docs: DataFrame, items: DataFrame, *, n: int = 3, min_score: float = 0.5, block_seeds: int = 1_000_000) -> DataFrame:
    """Rows (doc_id, item_id, score, n_seeds, start_word, end_word): documents that hold a test item.

    ``score`` is the alignment's share of the item's own score (match 2, other word -1, gap -1), at least
    ``min_score``; the words from start_word to end_word (exclusive) of the document align best.
    There is a row for each document row and item.  A-Z count as lower case.

    Null, empty and blank texts, of documents or items, match nothing; an item of fewer than ``n`` words matches where all
    of it stands. Repeated
    rows of either table give repeated rows; null ids are carried. Other columns are
    not read.  With an empty table on either side the result is empty.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    result = spark.createDataFrame([], SCHEMA)
    for ids, words in _item_blocks(items, n, block_seeds):
        sent = spark.sparkContext.broadcast(ItemBlock.make(ids, words, n))
        result = result.unionAll(docs.mapInArrow(_aligner(sent, min_score), SCHEMA))
    return result


def without_leaks(docs: DataFrame, items: DataFrame, *, n: int = 3, min_score: float = 0.5, block_seeds: int = 1_000_000) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no test item (as ``decontaminate`` finds them).

    Each row is judged where it is read: nothing is joined, so null and repeated ids do not matter.
    """
    for ids, words in _item_blocks(items, n, block_seeds):
        sent = docs.sparkSession.sparkContext.broadcast(ItemBlock.make(ids, words, n))
        docs = docs.mapInArrow(_filter(sent, min_score), docs.schema)
    return docs


def _filter(sent, min_score: float):
    def run(batches):
        for batch in batches:
            leaks = {row for row, _ in found_items(batch, sent.value, min_score)}
            yield batch.filter(pa.array([k not in leaks for k in range(len(batch))], pa.bool_()))
        give_back()

    return run


def found_items(batch: pa.RecordBatch, block: ItemBlock, min_score: float) -> dict[tuple[int, int], tuple]:
    """(row, item) -> (share, seeds, first word, end word) of the items that the batch's texts hold."""
    waiting = []
    for first, w, words in _scanned(batch):
        places = defaultdict(list)
        for shape in block.shapes:
            at, seed = block.hits(shape_hashes(words, shape))
            text, whole = _own(w, at, shape[-1] + 1)
            for p, s, t in zip(at[whole].tolist(), seed[whole].tolist(), text[whole].tolist()):
                for o in range(block.owner_first[s], block.owner_first[s + 1]):
                    places[t, int(block.owner_item[o])].append(p - int(block.owner_at[o]))
        for (t, item), begins in places.items():
            begins.sort()
            lo, hi, size = int(w.first[t]), int(w.first[t + 1]), len(block.words[item])
            i = 0
            while i < len(begins):  # places that are near one another are one passage
                j = i
                while j + 1 < len(begins) and begins[j + 1] - begins[j] <= size and begins[j + 1] - begins[i] <= 2 * size:
                    j += 1
                a, b = max(lo, begins[i] - size), min(hi, begins[j] + 2 * size)
                # the score is at most MATCH for each item word that stands there
                if np.count_nonzero(np.isin(block.words[item], words[a:b])) / size >= min_score:
                    waiting.append((first + t, item, j - i + 1, a - lo, words[a:b]))
                i = j + 1
    waiting.sort(key=lambda x: (len(block.words[x[1]]), len(x[4])))
    found: dict[tuple[int, int], tuple] = {}
    i = 0
    while i < len(waiting):
        j = i
        while j < len(waiting) and (j == i or (j - i + 1) * len(waiting[j][4]) <= 200_000):
            j += 1
        group = waiting[i:j]
        scores, starts, ends = align([(block.words[x[1]], x[4]) for x in group])
        for x, score, s, e in zip(group, scores.tolist(), starts.tolist(), ends.tolist()):
            share = score / (MATCH * len(block.words[x[1]]))
            if share >= min_score:
                key = (x[0], x[1])
                row = (share, x[2], x[3] + s, x[3] + e)
                if key not in found or (-share, row[2]) < (-found[key][0], found[key][2]):
                    found[key] = row
        i = j
    return found


def _aligner(sent, min_score: float):
    def run(batches):
        block = sent.value
        for batch in batches:
            ids = batch.column("doc_id")
            found = found_items(batch, block, min_score)
            keys = sorted(found)
            rows = [found[k] for k in keys]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([k[0] for k in keys], pa.int64())),
                    pa.array([block.item_ids[k[1]] for k in keys], pa.int64()),
                    pa.array([r[0] for r in rows], pa.float64()),
                    *(pa.array([r[c] for r in rows], pa.int32()) for c in (1, 2, 3)),
                ],
                ["doc_id", "item_id", "score", "n_seeds", "start_word", "end_word"],
            )
        give_back()

    return run
