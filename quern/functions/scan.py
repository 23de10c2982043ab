"""Texts on Arrow columns, a slice of bounded bytes at a time: tokens, terms, postings, and what is counted of them.

A slice is worked on as arrays, so its memory is a multiple of ``SLICE_BYTES`` (or of one longer text), however
many rows a batch has. Each distinct word of a slice is stemmed once, and nothing is shuffled for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.functions.text import STOP_WORDS, stem_word

#: Bytes of text that are looked at together (a longer text is a slice of its own).
SLICE_BYTES = 1 << 21

#: Lower case of the bytes that make tokens, 0 for others.
_LOWER = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _LOWER[_c] = _LOWER[ord(chr(_c).upper())] = _c

_STOPS = frozenset(STOP_WORDS)


@lru_cache(1 << 18)
def _term(word: str) -> str | None:
    return None if word in _STOPS else stem_word(word)


def strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A string array of words of ``sizes`` bytes that lie one after the other in ``data``."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


@dataclass
class Tokens:
    """Tokens of some texts, in order."""

    doc: np.ndarray  #: the text of each token
    position: np.ndarray
    begin: np.ndarray  #: byte places within the text
    end: np.ndarray
    surface: pa.Array

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Tokens:
        """Of texts with the UTF-8 bytes data[offsets[i] : offsets[i + 1]]."""
        low = _LOWER[data]
        word = low != 0
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = ~word[:-1]
        edge[offsets] = True  # a token never crosses from one text to the next
        begin = np.flatnonzero(word & edge[:-1])
        edge[1:-1] = ~word[1:]
        edge[offsets] = True
        end = np.flatnonzero(word & edge[1:]) + 1
        first = np.searchsorted(begin, offsets)
        counts = np.diff(first)
        doc = np.repeat(np.arange(len(counts)), counts)
        position = (np.arange(len(begin)) - first[doc]).astype(np.int32)
        at = offsets[doc]
        return cls(doc, position, (begin - at).astype(np.int32), (end - at).astype(np.int32), strings(low[word], end - begin))

    def words(self) -> tuple[np.ndarray, list[str]]:
        """The number of each token's surface, and the distinct surfaces."""
        coded = self.surface.dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary.to_pylist()


@dataclass
class Terms:
    """Tokens that are no stop words: ``number`` counts into ``names``, distinct terms."""

    doc: np.ndarray
    position: np.ndarray
    number: np.ndarray
    names: pa.Array
    kept: np.ndarray  #: which of the tokens these are

    @classmethod
    def of(cls, tokens: Tokens, wanted: frozenset[str] | None = None) -> Terms:
        index, words = tokens.words()
        found = [_term(w) for w in words]
        if wanted is not None:
            found = [t if t in wanted else None for t in found]
        coded = pa.array(found, pa.string()).dictionary_encode()
        number = coded.indices.fill_null(-1).to_numpy()[index] if len(words) else np.zeros(0, np.int32)
        kept = np.flatnonzero(number >= 0)
        return cls(tokens.doc[kept], tokens.position[kept], number[kept].astype(np.int64), coded.dictionary, kept)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of parts of a string column; a null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, places, values = column.buffers()
    places = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(places, places[i] + limit, "right")) - 1))
        yield i, j, values[places[i] : places[j]], places[i : j + 1] - places[i]
        i = j


def by_slice(docs: DataFrame, work: Callable[[pa.RecordBatch, Tokens], list[pa.Array]], schema: str) -> DataFrame:
    """Rows that ``work`` makes of each slice of ``docs``: of its rows, and the tokens of their column ``text``."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays(work(batch.slice(i, j - i), Tokens.of(data, offsets)), names)

    return docs.mapInArrow(run, schema)


def token_offsets(docs: DataFrame) -> DataFrame:
    """(file_id, position, surface, begin, end): tokens with their places [begin, end) in the UTF-8 bytes of the text."""

    def work(rows, t):
        return [rows.column("file_id").take(pa.array(t.doc)), pa.array(t.position), t.surface, pa.array(t.begin), pa.array(t.end)]

    return by_slice(docs.select("file_id", "text"), work, "file_id string, position int, surface string, begin int, end int")


def analyze(docs: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(file_id, position, surface, term) of the tokens that are no stop words; of ``wanted`` terms only, if given."""
    only = None if wanted is None else frozenset(wanted)

    def work(rows, tokens):
        t = Terms.of(tokens, only)
        return [rows.column("file_id").take(pa.array(t.doc)), pa.array(t.position), tokens.surface.take(pa.array(t.kept)), t.names.take(pa.array(t.number))]

    return by_slice(docs.select("file_id", "text"), work, "file_id string, position int, surface string, term string")


def text_lengths(docs: DataFrame) -> DataFrame:
    """(file_id, length) of every row: its tokens that are no stop words. A text without an id has none."""

    def work(rows, tokens):
        index, words = tokens.words()
        counts = np.array([w not in _STOPS for w in words], bool)[index]
        length = np.bincount(tokens.doc[counts], minlength=len(rows))
        return [rows.column("file_id"), pa.array(np.where(rows.column("file_id").is_null(), 0, length))]

    return by_slice(docs.select("file_id", "text"), work, "file_id string, length long")


def text_counts(docs: DataFrame) -> DataFrame:
    """(term, n): of each slice, its terms with the number of rows that have them."""

    def work(rows, tokens):
        t = Terms.of(tokens)
        each = np.unique(t.doc * len(t.names) + t.number)
        return [t.names, pa.array(np.bincount(each % len(t.names), minlength=len(t.names)) if len(t.names) else each)]

    return by_slice(docs.select("text"), work, "term string, n long")


def text_groups(docs: DataFrame, group: str) -> DataFrame:
    """(group, term) of each slice, each once: the terms of the rows of each group."""

    def work(rows, tokens):
        t = Terms.of(tokens)
        coded = rows.column(group).dictionary_encode("encode")
        of = coded.indices.to_numpy()
        each = np.unique(of[t.doc] * np.int64(len(t.names)) + t.number)
        pick = each // max(len(t.names), 1), each % max(len(t.names), 1)
        return [coded.dictionary.take(pa.array(pick[0])), t.names.take(pa.array(pick[1]))]

    return by_slice(docs.select("text", group), work, f"{group} int, term string")


def text_pairs(docs: DataFrame) -> DataFrame:
    """(first, second, n) of each slice: terms at one position and the next, how often."""

    def work(rows, tokens):
        t = Terms.of(tokens)
        follows = np.flatnonzero((t.doc[1:] == t.doc[:-1]) & (t.position[1:] == t.position[:-1] + 1))
        each, n = np.unique(t.number[follows] * len(t.names) + t.number[follows + 1], return_counts=True)
        return [t.names.take(pa.array(each // max(len(t.names), 1))), t.names.take(pa.array(each % max(len(t.names), 1))), pa.array(n)]

    return by_slice(docs.where("file_id IS NOT NULL").select("text"), work, "first string, second string, n long")
