"""What the operators of this subpackage share: the shared folder, word scanning, hashing.

Words are ``[^\\x20\\x09-\\x0D]+`` and are found on UTF-8 bytes: none of those
separators occurs inside a multi-byte character.
"""

from __future__ import annotations

import ctypes
import uuid
import weakref
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.sources.shared import shared_dir


#: Where the tables that ``settle`` gave are.
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage, so that a lost executor costs a re-read and not a
    recomputation, and a later step that needs few columns reads only those.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Remove tables of ``settle``, after all that was made from them is written itself; others are left alone.

    What is written no longer depends on them, so a lost executor does not need them either.
    """
    for df in tables:
        path = _written.pop(df, None) if df is not None else None
        if path is not None:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Return freed memory of this Python worker to the system: it is reused by later tasks, whose needs are others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


# ---------------------------------------------------------------- word scanning

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: One random 64-bit value for each byte; A-Z take the values of a-z.
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: tuple[np.ndarray, np.ndarray] | None = None

#: Bytes of text that are scanned at once (a longer text is a slice of its own).
SLICE_BYTES = 1 << 20


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)

        def table(base: int) -> np.ndarray:
            out = np.full(size, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        tables = (table(_BASE), table(_BASE_INV))
        if size > 4 * SLICE_BYTES:  # not worth keeping for one long text
            return tables
        _powers = tables
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer on an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges (i, j) of texts whose bytes together stay near ``limit``."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


@dataclass
class Words:
    """Words of some texts: byte starts and ends, and where each text's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # n + 1: words of text i are first[i] .. first[i + 1]


def scan_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    if not len(data):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    word = ~_SPACE[data]
    begins = np.ones(len(data) + 1, bool)
    begins[1:-1] = ~word[:-1]
    begins[offsets] = True  # a word never crosses from one text to the next
    starts = np.flatnonzero(word & begins[:-1])
    ends = np.flatnonzero(word & np.append(begins[1:-1] | ~word[1:], True)) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of a polynomial mod 2**64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[: len(data)], out=sums[1:])
    got = (sums[ends] - sums[starts]) * down[starts]
    return mix(got + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words that start at each word but the last n - 1."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out) * np.uint64(0xA24BAED4963EE407) + words[k : len(words) - n + 1 + k]
    return mix(out + np.uint64(n))


def shingle_sets(col: pa.Array, n: int):
    """For each text of a string column: its sorted distinct n-word shingles, as uint64.

    ASCII letters count as lower case.  A text of fewer than ``n`` words has its
    whole word sequence as one shingle; one without words has none.
    """
    data, offsets = text_buffers(col)
    for i, j in slices(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        w = scan_words(part, off)
        words = span_hashes(part, w.starts, w.ends)
        grams = gram_hashes(words, n)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield gram_hashes(words[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)
