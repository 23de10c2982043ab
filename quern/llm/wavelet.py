"""Token-id output as one wavelet matrix per shard (operator 2).

A shard is one Parquet file.  Its rows are blocks in token order; a block is a
self-contained image that answers ``access``, ``rank``, ``select``, ``count``
and ``locate`` without being expanded:

    b"QWM1" | u32 n | u32 sigma | u32 planes | u32 docs
    | alphabet u32[sigma]          the distinct ids, ascending
    | zeros u32[planes]            zero bits of each plane
    | doc ends u32[docs]           tokens before the end of each document
    | planes * ceil(n / 64) u64    bit planes, most significant first

and is kept zstd-compressed.  Rank directories are made when a block is opened
(a running count for each 64-bit word), so the file holds nothing redundant.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._shared import give_back, settle, text_buffers

MAGIC = b"QWM1"
_HEAD = struct.Struct("<4sIIII")
#: Tokens of a block; it ends with the document that reaches this number.
BLOCK_TOKENS = 1 << 20


# ------------------------------------------------------------------- the matrix


class WaveletMatrix:
    """An opened block.  Positions are 0-based; ranges are end-exclusive."""

    def __init__(self, alphabet, zeros, doc_ends, planes, n):
        self.alphabet, self.zeros, self.doc_ends, self.planes, self.n = alphabet, zeros, doc_ends, planes, n
        self._ranks: dict[int, np.ndarray] = {}

    @staticmethod
    def encode(ids: np.ndarray, doc_lengths: np.ndarray) -> bytes:
        """Image of ``ids``, which are the ids of documents of these lengths."""
        ids = np.asarray(ids, np.uint32)
        n = len(ids)
        top = int(ids.max()) + 1 if n else 0
        if top <= 1 << 20:  # a table by id beats a sort
            seen = np.zeros(top, bool)
            seen[ids] = True
            alphabet = np.flatnonzero(seen).astype(np.uint32)
            code = np.zeros(top, np.uint32)
            code[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
            x = code[ids]
        else:
            alphabet, x = np.unique(ids, return_inverse=True)
        x = x.astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        depth = max(1, int(len(alphabet) - 1).bit_length()) if n else 0
        zeros, planes = np.zeros(depth, np.uint32), []
        words = (n + 63) // 64
        for k in range(depth):
            bit = (x & x.dtype.type(1 << (depth - 1 - k))) != 0
            packed = np.zeros(words * 8, np.uint8)
            b = np.packbits(bit, bitorder="little")
            packed[: len(b)] = b
            planes.append(packed.tobytes())
            low = np.flatnonzero(~bit)  # taking by index is three times as fast as by mask
            zeros[k] = len(low)
            x = x.take(np.concatenate([low, np.flatnonzero(bit)]))
        ends = np.cumsum(np.asarray(doc_lengths, np.int64)).astype(np.uint32)
        head = _HEAD.pack(MAGIC, n, len(alphabet), depth, len(ends))
        raw = b"".join([head, alphabet.astype("<u4").tobytes(), zeros.astype("<u4").tobytes(), ends.astype("<u4").tobytes(), *planes])
        return zstandard.ZstdCompressor(level=1).compress(raw)

    @classmethod
    def open(cls, image: bytes) -> WaveletMatrix:
        raw = zstandard.ZstdDecompressor().decompress(image)
        magic, n, sigma, depth, docs = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix block")
        at, parts = _HEAD.size, []
        for size in (sigma, depth, docs):
            parts.append(np.frombuffer(raw, "<u4", size, at))
            at += 4 * size
        words = (n + 63) // 64
        planes = [np.frombuffer(raw, np.uint8, words * 8, at + k * words * 8) for k in range(depth)]
        return cls(*parts, planes, n)

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3]) >> (i & 7) & 1

    def _rank1(self, k: int, i: int) -> int:
        """Ones among the first ``i`` bits of plane ``k``."""
        if k not in self._ranks:
            ones = np.bitwise_count(self.planes[k].view("<u8")).astype(np.int64)
            self._ranks[k] = np.concatenate([[0], np.cumsum(ones)])
        word, rest = i >> 6, i & 63
        out = int(self._ranks[k][word])
        if rest:
            out += (int(self.planes[k][word * 8 : word * 8 + 8].view("<u8")[0]) & ((1 << rest) - 1)).bit_count()
        return out

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for k in range(len(self.planes)):
            bit = self._bit(k, i)
            code = code << 1 | bit
            ones = self._rank1(k, i)
            i = int(self.zeros[k]) + ones if bit else i - ones
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def _descend(self, code: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(len(self.planes)):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            if code >> (len(self.planes) - 1 - k) & 1:
                lo, hi = int(self.zeros[k]) + a, int(self.zeros[k]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``token`` in positions lo .. hi."""
        code, hi = self._code(token), self.n if hi is None else hi
        if code is None or lo >= hi:
            return 0
        a, b = self._descend(code, lo, hi)
        return b - a

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def _select_bit(self, k: int, want: int, nth: int) -> int:
        """Position of the nth (0-based) bit equal to ``want`` in plane ``k``."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank1(k, mid + 1)
            if (ones if want else mid + 1 - ones) > nth:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, token: int, nth: int) -> int:
        """Position of the nth (0-based) occurrence of ``token``."""
        code = self._code(token)
        if code is None:
            raise IndexError(nth)
        lo, hi = self._descend(code, 0, self.n)
        if not 0 <= nth < hi - lo:
            raise IndexError(nth)
        i = lo + nth
        for k in reversed(range(len(self.planes))):
            if code >> (len(self.planes) - 1 - k) & 1:
                i = self._select_bit(k, 1, i - int(self.zeros[k]))
            else:
                i = self._select_bit(k, 0, i)
        return i

    def locate(self, token: int) -> list[int]:
        """All positions of ``token``, ascending."""
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids: the planes undone from the least significant one."""
        code = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in reversed(range(len(self.planes))):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            code[int(self.zeros[k]) :] |= code.dtype.type(1 << (len(self.planes) - 1 - k))
            before = np.empty_like(code)
            before[np.concatenate([np.flatnonzero(~bit), np.flatnonzero(bit)])] = code
            code = before
        return self.alphabet[code] if self.n else np.zeros(0, np.uint32)


# ---------------------------------------------------------------- the tokenizer


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class ChunkEncoder:
    """Byte-level BPE of whole texts through the tokenizers library, word by word.

    Byte-level pre-tokenization never joins a non-space to a space that follows
    it, nor an ASCII letter to a comma or full stop, so a text is cut there and each distinct piece is encoded once.
    Pieces with the text of an added token go through the whole tokenizer.
    """

    KEEP, KEEP_WORDS = 400_000, 800_000  # pieces and words remembered; when full they are met anew

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        added = [re.escape(t.content.encode()) for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(added) or b"(?!)")
        self.marks = not any(re.search(r"[A-Za-z]\\?[,.]", t.decode()) for t in added)  # no added token goes over such a cut
        self.kind = "H" if self.whole.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype(np.uint16 if self.kind == "H" else np.uint32)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.visible = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[bytes, int] = {}
        self.old: dict[bytes, bytes] = {}
        self.flat, self.at = bytearray(), np.zeros(1, np.int64)
        self._reset()

    _of_path: dict[str, ChunkEncoder] = {}

    @classmethod
    def of(cls, path: str) -> ChunkEncoder:
        """The encoder of this process: what it has learned serves the worker's next tasks."""
        if path not in cls._of_path:
            cls._of_path[path] = cls(path)
        return cls._of_path[path]

    def _reset(self):
        """Forget pieces, but for the ids of a quarter that came first: the frequent ones."""
        width, at, flat = self.dtype.itemsize, self.at.tolist(), bytes(self.flat)
        first = itertools.islice(self.pieces.items(), self.KEEP // 4)
        self.old = {p: flat[at[c] * width : at[c + 1] * width] for p, c in first}
        self.pieces = {}
        self.flat = bytearray()
        self.at = np.zeros(self.KEEP + 1, np.int64)

    def _whole(self, text: str) -> bytes:
        return array(self.kind, self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        if len(word) > 200:  # long runs are rare and not worth keeping
            return self._whole(word)
        ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.visible))]
        got = array(self.kind, ids).tobytes()
        if len(self.words) >= self.KEEP_WORDS:
            self.words.clear()
        self.words[word] = got
        return got

    def _encode(self, piece: bytes) -> bytes:
        text = piece.decode()
        if self.added.search(piece):
            return self._whole(text)
        known = self.words.get
        bare = text[1:] if text[0] == " " else text
        if bare.isalpha():  # by far the most: letters, or letters and one mark
            return known(text) or self._word(text)
        if bare[:-1].isalpha() and bare[-1] in ",.":
            return (known(text[:-1]) or self._word(text[:-1])) + (known(bare[-1]) or self._word(bare[-1]))
        return b"".join([known(w) or self._word(w) for w in self.pattern.findall(text)])

    def _number(self, pieces: list[bytes]) -> np.ndarray:
        known, old = self.pieces, self.old
        out = list(map(known.get, pieces))
        if None in out:
            width = self.dtype.itemsize
            for k, code in enumerate(out):
                if code is None:
                    piece = pieces[k]
                    self.flat += old.get(piece) or self._encode(piece)
                    code = out[k] = known[piece] = len(known)
                    self.at[code + 1] = len(self.flat) // width
        return np.array(out, np.int64)

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the texts in a row, ids of each text)."""
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(texts, np.int64)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        cut = np.empty(len(data), bool)
        cut[0] = True
        cut[1:] = space[1:] & ~space[:-1]
        if self.marks:
            cut[1:] |= ((data[1:] == 44) | (data[1:] == 46)) & _LETTER[data[:-1]]
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts, len(data)).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        del space, cut
        coded = column.dictionary_encode()
        del column, ends
        distinct = coded.dictionary.to_pylist()
        coded = coded.indices.to_numpy()
        if len(distinct) + len(self.pieces) > self.KEEP:
            self._reset()
            if len(distinct) > self.KEEP:
                self.at = np.zeros(len(distinct) + 1, np.int64)
        number = self._number(distinct)
        del distinct
        begin = self.at[number]
        length = (self.at[number + 1] - begin)[coded]
        total = np.zeros(len(coded) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        # places in ``flat``, whose length the pieces remembered bound, so 32 bits nearly always do
        width = np.int32 if max(len(self.flat) // self.dtype.itemsize, int(total[-1])) < 1 << 31 else np.int64
        take = np.repeat((begin[coded] - total[:-1]).astype(width), length)
        del begin, length, coded
        take += np.arange(total[-1], dtype=width)
        of_text = np.searchsorted(starts, offsets)
        return np.frombuffer(self.flat, self.dtype)[take], np.diff(total[of_text])


# ------------------------------------------------------------------ the operator

SHARD_SCHEMA = "shard int, block int, block_start long, doc_ids binary, n_tokens long, n_docs long, image binary"


def write_shards(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, shards: int | None = None, name: str = "tokens") -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shard files, ascending by doc_id; the table of shards.

    Documents are dealt by ranges of doc_id (equal ids by text as well), so shard
    order is document order and no shard depends on another.  ``shards`` is
    by default the session's number of shuffle partitions.  A null or
    empty text has the end id alone; a null doc_id sorts first; repeated rows
    are kept, ordered by text; other columns are not read.  An empty table gives
    no shard.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ranged = picked.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def encode(batches):
        give_back()  # what the worker's earlier tasks freed
        encoder, shard = ChunkEncoder.of(tokenizer_path), TaskContext.get().partitionId()
        ids, lengths, names, waiting, block, start = [], [], [], 0, 0, 0

        def image():
            nonlocal ids, lengths, names, waiting, block, start
            image = WaveletMatrix.encode(np.concatenate(ids), np.concatenate(lengths))
            keys = pa.concat_arrays(names)
            out = {"shard": [shard], "block": [block], "block_start": [start], "doc_ids": [_pack_ids(keys)], "n_tokens": [waiting], "n_docs": [len(keys)], "image": [image]}
            start, block = start + waiting, block + 1
            ids, lengths, names, waiting = [], [], [], 0
            return pa.RecordBatch.from_pydict(out, _shard_arrow())

        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            step = 1 << 23
            i = 0
            while i < len(offsets) - 1:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, "right")) - 1)
                got, each = encoder.batch(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = np.cumsum(each)
                full = np.insert(got.astype(np.uint32), ends, np.uint32(end_id))
                each = each + 1
                ids.append(full)
                lengths.append(each)
                names.append(batch.column("doc_id").slice(i, j - i))
                waiting += len(full)
                if waiting >= BLOCK_TOKENS:
                    yield image()
                i = j
            del batch, data
        if waiting:
            yield image()
        give_back()

    return settle(ranged.mapInArrow(encode, SHARD_SCHEMA), name)


def _shard_arrow() -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("block_start", pa.int64()), ("doc_ids", pa.binary()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("image", pa.binary())])


def _pack_ids(keys: pa.Array) -> bytes:
    """A validity byte for each id, then the ids as little-endian 64-bit integers."""
    valid = np.asarray(keys.is_valid().to_numpy(zero_copy_only=False), np.uint8)
    return valid.tobytes() + keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()


def _unpack_ids(blob: bytes, n: int) -> pa.Array:
    valid = np.frombuffer(blob, np.uint8, n).astype(bool)
    return pa.array(np.frombuffer(blob, "<i8", n, n), pa.int64(), mask=~valid)


def read_documents(shards: DataFrame) -> DataFrame:
    """Every document as the shard files hold it: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it.  What is summed on the
    driver is one number for each shard, and their number is a parameter.
    """
    spark = shards.sparkSession
    totals = {r["shard"]: r["n"] for r in shards.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    base, run = {}, 0
    for shard in sorted(totals):
        base[shard] = run
        run += totals[shard]

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                matrix = WaveletMatrix.open(row["image"])
                flat = matrix.ids().astype("<u4")
                view = memoryview(flat).cast("B")
                ends = matrix.doc_ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        _unpack_ids(row["doc_ids"], row["n_docs"]),
                        pa.array(starts + (base[row["shard"]] + row["block_start"]), pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )
        give_back()

    # Arrow batches of a few images bound the memory of a task.
    few = shards.select("shard", "block_start", "doc_ids", "n_docs", "image")
    return few.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def locate(shards: DataFrame, token: int) -> DataFrame:
    """Positions of ``token`` in every block: shard, block, n, positions in the shard."""

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                matrix = WaveletMatrix.open(row["image"])
                at = [row["block_start"] + p for p in matrix.locate(token)]
                yield pa.RecordBatch.from_pydict(
                    {"shard": [row["shard"]], "block": [row["block"]], "n": [len(at)], "positions": [at]},
                    pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n", pa.int64()), ("positions", pa.list_(pa.int64()))]),
                )

    return shards.select("shard", "block", "block_start", "image").mapInArrow(search, "shard int, block int, n long, positions array<long>")


def token_wavelet(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as wavelet shards and read every document back from them."""
    import public_tokenizers

    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    return read_documents(write_shards(docs, path, **options))
