"""Posting compression: gaps and LEB128 varints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.scan import Terms, Tokens, text_slices


def varint_size(v: Column) -> Column:
    """Bytes of a varint."""
    size = F.lit(1)
    for k in range(1, 9):
        size = size + F.when(v >= (1 << 7 * k), 1).otherwise(0)
    return size


def encode_varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def decode_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("truncated or overlong varint")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if not b & 128:
            if value >= 1 << 64:
                raise ValueError("overlong varint")
            return value, at
        shift += 7


def encode(rows: list[tuple[int, int, list[int]]]) -> bytes:
    """Postings (doc_id, tf, positions) by ascending doc_id."""
    out, last = [encode_varint(len(rows))], 0
    for doc, tf, positions in rows:
        out += [encode_varint(doc - last), encode_varint(tf), encode_varint(len(positions))]
        last, before = doc, 0
        for p in positions:
            out.append(encode_varint(p - before))
            before = p
    return b"".join(out)


def decode(data: bytes) -> list[tuple[int, int, list[int]]]:
    n, at = decode_varint(data, 0)
    if n > len(data) - at:
        raise ValueError("more postings than bytes")
    out, doc = [], 0
    for _ in range(n):
        gap, at = decode_varint(data, at)
        tf, at = decode_varint(data, at)
        m, at = decode_varint(data, at)
        if m > len(data) - at:
            raise ValueError("more positions than bytes")
        doc, place, positions = doc + gap, 0, []
        for _ in range(m):
            step, at = decode_varint(data, at)
            place += step
            positions.append(place)
        out.append((doc, tf, positions))
    return out


# --- the same on arrays, a slice of the texts at a time


def sizes(values: np.ndarray) -> np.ndarray:
    """Bytes of each varint."""
    out = np.ones(len(values), np.int64)
    for k in range(1, 9):
        out += values >= (1 << 7 * k)
    return out


def encode_array(values: np.ndarray) -> np.ndarray:
    """Varints of ``values``, one after the other."""
    size = sizes(values)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at, left, last = ends - size, values.astype(np.uint64), size - 1
    for k in range(int(size.max(initial=0))):
        more = np.flatnonzero(last >= k)
        byte = (left[more] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[more] + k] = byte.astype(np.uint8) | ((last[more] > k).astype(np.uint8) << 7)
    return out


def decode_array(data: np.ndarray) -> np.ndarray:
    """The values of varints that lie one after the other."""
    ends = np.flatnonzero(data < 128)
    if not len(ends):
        return np.zeros(0, np.uint64)
    begins = np.append(0, ends[:-1] + 1)
    place = np.arange(ends[-1] + 1) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((data[: ends[-1] + 1] & 127).astype(np.uint64) << (7 * place).astype(np.uint64), begins)


@dataclass
class Postings:
    """Postings of some texts in the order of ``doc_id``, by term, then document; a document of ``k`` rows has each k times."""

    term: np.ndarray  #: a number of names
    doc_id: np.ndarray
    tf: np.ndarray
    gaps: np.ndarray  #: to the term's last posting here; of its first, 0
    first: np.ndarray  #: postings that are their term's first
    pos_gaps: np.ndarray  #: of all postings, one after the other
    names: pa.Array

    @classmethod
    def of(cls, tokens: Tokens, ids: np.ndarray) -> Postings:
        t = Terms.of(tokens)
        distinct, file, rows = np.unique(ids, return_inverse=True, return_counts=True)
        key = t.number * len(distinct) + file[t.doc]
        # rows of one document follow each other, so only these have positions out of order
        order = np.argsort(key, kind="stable") if len(distinct) == len(ids) else np.lexsort((t.position, key))
        key, position = key[order], t.position[order].astype(np.int64)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(key)))
        gap = position.copy()
        gap[1:] -= np.where(new[1:], 0, position[:-1])
        term, file = key[at] // max(len(distinct), 1), key[at] % max(len(distinct), 1)
        if len(distinct) < len(ids):
            again = np.repeat(np.arange(len(at)), rows[file])
            at, tf, term, file = at[again], tf[again], term[again], file[again]
            gap = gap[np.repeat(at - np.append(0, np.cumsum(tf)[:-1]), tf) + np.arange(tf.sum())]
        first = np.ones(len(term), bool)
        first[1:] = term[1:] != term[:-1]
        doc_id = distinct[file]
        gaps = np.zeros(len(term), np.int64)
        gaps[1:] = np.where(first[1:], 0, doc_id[1:] - doc_id[:-1])
        return cls(term, doc_id, tf, gaps, first, gap, t.names)

    def last(self) -> np.ndarray:
        """Which postings are their term's last: one for each that is a first."""
        return np.append(np.flatnonzero(self.first)[1:] - 1, len(self.term) - 1)[: int(self.first.sum())]


#: Bytes of text of a slice. Postings of a term have a row for each slice where something is made for terms.
SLICE_BYTES = 1 << 23


def in_order(docs: DataFrame) -> DataFrame:
    """Documents that have a number ``seq``, by ascending number over the partitions and within each."""
    return docs.where("seq IS NOT NULL").select("seq", "text").repartitionByRange("seq").sortWithinPartitions("seq")


def _posted(docs: DataFrame, work: Callable[[Postings], list[pa.Array]], schema: str) -> DataFrame:
    """Rows that ``work`` makes of each slice of the documents in order; rows of one number are in one slice."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def made(rows: pa.Table) -> pa.RecordBatch:
            data = rows.combine_chunks()
            text = pa.concat_arrays(data.column("text").chunks).cast(pa.large_string())
            _, _, values, offsets = next(text_slices(text, 1 << 62))
            ids = data.column("seq").to_numpy()
            return pa.RecordBatch.from_arrays(work(Postings.of(Tokens.of(values, offsets), ids)), names)

        for batch in batches:
            text = batch.column("text")
            for i, j, values, _ in text_slices(text, SLICE_BYTES // 4):
                part = batch.slice(i, j - i)
                if size >= SLICE_BYTES:
                    ids, last = part.column("seq").to_numpy(), kept[-1].column("seq")[-1].as_py()
                    same = int(np.searchsorted(ids, last, "right"))
                    if same < len(part):  # rows of the last number end here
                        yield made(pa.Table.from_batches([*kept, part.slice(0, same)]))
                        kept, size, part = [], 0, part.slice(same)
                kept.append(part)
                size += len(values)
        if kept:
            yield made(pa.Table.from_batches(kept))

    return in_order(docs).mapInArrow(run, schema)


def _before(rows: DataFrame) -> DataFrame:
    """A term's rows of slices (term, first, last) with ``before``: its last document of the slices before, 0 at first."""
    return rows.withColumn("before", F.lag("last", 1, 0).over(Window.partitionBy("term").orderBy("first", "last")))


def gaps(docs: DataFrame) -> DataFrame:
    """(term, doc_id, doc_gap) of the postings of documents (seq, text).

    Gaps within a slice leave their task as they are; of each term and slice, one row is ordered by term.
    """

    def inner(p: Postings) -> list[pa.Array]:
        more = ~p.first
        return [p.names.take(pa.array(p.term[more])), pa.array(p.doc_id[more]), pa.array(p.gaps[more])]

    def ends(p: Postings) -> list[pa.Array]:
        return [p.names.take(pa.array(p.term[p.first])), pa.array(p.doc_id[p.first]), pa.array(p.doc_id[p.last()])]

    firsts = _before(_posted(docs, ends, "term string, first long, last long"))
    firsts = firsts.select("term", F.col("first").alias("doc_id"), (F.col("first") - F.col("before")).alias("doc_gap"))
    return _posted(docs, inner, "term string, doc_id long, doc_gap long").unionByName(firsts)


def roundtrip(docs: DataFrame, decoded: bool = True) -> DataFrame:
    """(term, bytes, same): encode the postings of each term, a slice of the documents at a time, and decode them.

    Bodies of slices, one after the other, are the term's encoding without its count. A slice does not know the gap
    of its first document: that varint is encoded and decoded once the slices are in order. Without ``decoded``,
    sizes only, and all counts as the same.
    """

    def work(p: Postings) -> list[pa.Array]:
        at = np.flatnonzero(p.first)
        ends = np.cumsum(p.tf)
        begins = ends - p.tf
        size = sizes(p.gaps) * ~p.first + 2 * sizes(p.tf)
        if len(at):
            size += np.add.reduceat(sizes(p.pos_gaps), begins)
        same = np.ones(len(at), bool)
        if decoded and len(at):
            same = np.logical_and.reduceat(_decodes(p, begins), at)
        total = np.add.reduceat(size, at) if len(at) else size
        return [p.names.take(pa.array(p.term[at])), pa.array(p.doc_id[at]), pa.array(p.doc_id[p.last()]), pa.array(total), pa.array(np.diff(np.append(at, len(p.term)))), pa.array(same)]

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gap = batch.column("gap").to_numpy()
            data = encode_array(gap)
            back = decode_array(data)
            ok = back.astype(np.int64) == gap if len(back) == len(gap) else np.zeros(len(gap), bool)
            same = pa.array(ok & batch.column("same").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(batch.column("size").to_numpy() + sizes(gap)), batch.column("n"), same], ["term", "size", "n", "same"])

    rows = _before(_posted(docs, work, "term string, first long, last long, size long, n long, same boolean"))
    rows = rows.select("term", (F.col("first") - F.col("before")).alias("gap"), "size", "n", "same")
    rows = rows.mapInArrow(heads, "term string, size long, n long, same boolean") if decoded else rows.withColumn("size", F.col("size") + varint_size(F.col("gap")))
    return rows.groupBy("term").agg((F.sum("size") + varint_size(F.sum("n"))).cast("long").alias("bytes"), F.every("same").alias("same"))


def _decodes(p: Postings, begins: np.ndarray) -> np.ndarray:
    """Whether each posting comes back from the encoding of all: numbers are read, then taken apart by the counts read."""
    n = len(p.tf)
    starts = 3 * np.arange(n) + begins
    values = np.zeros(3 * n + len(p.pos_gaps), np.int64)
    values[starts], values[starts + 1], values[starts + 2] = p.gaps, p.tf, p.tf
    values[np.arange(len(p.pos_gaps)) + 3 * np.repeat(np.arange(1, n + 1), p.tf)] = p.pos_gaps
    back = decode_array(encode_array(values)).astype(np.int64)
    if len(back) != len(values):
        return np.zeros(n, bool)
    # a posting begins where the one before ends by its own count, so equal counts mean equal places
    ok = back[starts + 2] == np.diff(np.append(starts, len(values))) - 3
    return ok & np.logical_and.reduceat(back == values, starts)


def compressed_size(docs: DataFrame) -> DataFrame:
    """(term, bytes) of the encoded postings of each term."""
    return roundtrip(docs, decoded=False).select("term", "bytes")
