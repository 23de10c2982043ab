"""N-gram Jaccard join (operator 3): exact near-copy components of whole texts.

The document-by-shingle incidence matrix A is cut into blocks of the shingle
axis, and a block of all documents is one task.  It keeps the shingles that
several distinct sets have.  From them follow size bounds: a set can only link if
``percent`` of its *own* size is shared with others, and only by a shingle among the
rarest it has (a prefix whose length its size gives).

Products A x A' are then made in cells.  Sets that meet within those prefixes, and whose sizes
allow a link, form families; a family is a cell, or a grid of cells if it
is large.  A cell goes over blocks of its shingles, adds up the overlaps of all its pairs in one matrix,
and drops rows and columns whose overlaps cannot reach what their sizes ask for any more.  What
leaves a cell are exact links, at most one fewer than it has sets; pairs never leave it.

Equal sets are one node from the start, and a few rounds in which each set meets only one other
find most components before: sets of one component are not multiplied, so a group of thousands
of copies costs a link for each copy and not for each pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._shared import drop, give_back, mix, settle, shingle_sets
from quern.llm.components import components

#: Shingles of a block or of a part of the sets, about: what one task holds at a time.
BLOCK_SHINGLES = 1 << 20
#: Names of sets that a task remembers, so as to send a set's copies once.
REMEMBERED = 1 << 18
_LOW48 = 48


def _signature(s: np.ndarray) -> int:
    """A signed 63-bit name of a set of hashes; equal sets have equal names."""
    with np.errstate(over="ignore"):
        x = mix(np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64).reshape(1) + np.uint64(len(s)))
    return int(x[0] >> np.uint64(1))


def shingle_table(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, node): node names the shingle set, null if it is empty."""

    def measure(batches):
        for batch in batches:
            sizes, nodes = [], []
            for s in shingle_sets(batch.column("text"), n):
                sizes.append(len(s))
                nodes.append(_signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())], ["doc_id", "n_shingles", "node"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, "doc_id long, n_shingles long, node long")


def block_bits(shingles: int) -> int:
    """Blocks are the first so many bits of a shingle's hash, parts those of a set's name; both follow the data's size."""
    return max(5, (max(0, shingles - 1) // BLOCK_SHINGLES).bit_length())


def _rest_bits(bits: int) -> int:
    """Bits of a hash that are kept besides the block: 48, fewer where the block has more than 16."""
    return min(_LOW48, 64 - bits)


def _split(h: np.ndarray) -> tuple[bytes, bytes]:
    return (h >> np.uint64(16)).astype(np.uint32).tobytes(), h.astype(np.uint16).tobytes()


def _joined(high, low) -> np.ndarray:
    return np.frombuffer(high, np.uint32).astype(np.uint64) << np.uint64(16) | np.frombuffer(low, np.uint16).astype(np.uint64)


def _cuts(sorted_keys: np.ndarray):
    """(key, begin, end) of each run of equal keys."""
    if len(sorted_keys):
        first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
        yield from zip(sorted_keys[first].tolist(), first.tolist(), np.append(first[1:], len(sorted_keys)).tolist())


_BLOCK = "block long, nodes binary, sizes binary, high binary, low binary, who binary"


def _incidence(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """The incidence matrix in pieces: for a slice of documents and a block of
    shingles, the shingles (without the block's bits) and whose they are."""

    def pack(batches):
        known: set[int] = set()
        sets, names, held = [], [], 0
        for batch in batches:
            for s in shingle_sets(batch.column("text"), n):
                if not len(s):
                    continue
                name = _signature(s)
                if name in known:
                    continue
                if len(known) >= REMEMBERED:
                    known.clear()
                known.add(name)
                sets.append(s)
                names.append(name)
                held += len(s)
                if held >= BLOCK_SHINGLES or len(sets) >= 65_000:
                    yield piece(sets, names)
                    sets, names, held = [], [], 0
        if sets:
            yield piece(sets, names)
        del sets, names, known
        give_back()

    def piece(sets, names):
        sizes = np.array([len(s) for s in sets], np.uint32)
        names = np.array(names, np.int64)
        flat = mix(np.concatenate(sets))
        who = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        block = (flat >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        order = np.argsort(block, kind="stable")
        flat, who, block = flat[order] & np.uint64((1 << _rest_bits(bits)) - 1), who[order], block[order]
        out = {k: [] for k in ("block", "nodes", "sizes", "high", "low", "who")}
        for b, i, j in _cuts(block):
            there, local = np.unique(who[i:j], return_inverse=True)
            out["block"].append(b)
            out["nodes"].append(names[there].tobytes())
            out["sizes"].append(sizes[there].tobytes())
            high, low = _split(flat[i:j])
            out["high"].append(high)
            out["low"].append(low)
            out["who"].append(local.astype(np.uint16).tobytes())
        return pa.RecordBatch.from_pydict(out, pa.schema([("block", pa.int64()), *((k, pa.binary()) for k in ("nodes", "sizes", "high", "low", "who"))]))

    return docs.select("text").mapInArrow(pack, _BLOCK)


def _shared(incidence: DataFrame, bits: int) -> DataFrame:
    """For each block, the entries whose shingle at least two nodes have, by part of the nodes."""

    def common(key, table):
        block = key[0].as_py()
        nodes, sizes, owners, hashes, seen = [], [], [], [], 0
        for row in table.select(["nodes", "sizes", "high", "low", "who"]).to_batches():
            for names, lens, high, low, who in zip(*(row.column(k) for k in range(5))):
                nodes.append(np.frombuffer(names.as_buffer(), np.int64))
                sizes.append(np.frombuffer(lens.as_buffer(), np.uint32))
                owners.append(np.frombuffer(who.as_buffer(), np.uint16) + np.uint32(seen))
                seen += len(nodes[-1])
                hashes.append(_joined(high.as_buffer(), low.as_buffer()))
        h = np.concatenate(hashes)
        del hashes
        order = np.argsort(h)  # entries of one shingle together; most shingles go at once
        h = h[order]
        again = np.zeros(len(h) + 1, bool)
        again[1:-1] = h[1:] == h[:-1]
        some = again[1:] | again[:-1]
        owner = np.concatenate(owners)[order[some]]
        h, node, size = h[some], np.concatenate(nodes)[owner], np.concatenate(sizes)[owner]
        del owners, nodes, sizes, owner, order, again, some
        order = np.lexsort((node, h))
        h, node, size = h[order], node[order], size[order]
        first = np.ones(len(h), bool)  # copies of a set count once
        first[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, node, size = h[first], node[first], size[first]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        df = np.diff(np.append(starts, len(h)))
        df = np.repeat(df, df)
        keep = df > 1
        h, node, size, df = h[keep], node[keep], size[keep], df[keep].astype(np.uint32)
        order = np.argsort(node, kind="stable")
        h, node, size, df = h[order], node[order], size[order], df[order]
        out = {k: [] for k in ("part", "block", "nodes", "sizes", "counts", "high", "low", "df")}
        for p, i, j in _cuts(node >> np.int64(63 - bits)):
            names, at, counts = np.unique(node[i:j], return_index=True, return_counts=True)
            out["part"].append(p)
            out["block"].append(block)
            out["nodes"].append(names.tobytes())
            out["sizes"].append(size[i:j][at].tobytes())
            out["counts"].append(counts.astype(np.uint32).tobytes())
            high, low = _split(h[i:j])
            out["high"].append(high)
            out["low"].append(low)
            out["df"].append(df[i:j].tobytes())
        give_back()
        return pa.Table.from_pydict(out, pa.schema([("part", pa.int64()), ("block", pa.int64()), *((k, pa.binary()) for k in ("nodes", "sizes", "counts", "high", "low", "df"))]))

    return incidence.groupBy("block").applyInArrow(common, "part long, block long, nodes binary, sizes binary, counts binary, high binary, low binary, df binary")


def _candidates(shared: DataFrame, bits: int, percent: int) -> DataFrame:
    """(node, size, shared, shingles, prefix): nodes of which enough is shared to link at all.

    ``shingles`` are the shared ones, packed and ascending; ``shared`` counts them; ``prefix`` has the keys of those
    by which a link must show: the rarest, after those that nobody shares.
    """
    shift = np.uint64(_rest_bits(bits))

    def gather(key, table):
        names, sizes, keys, dfs = [], [], [], []
        for row in table.to_pylist():
            counts = np.frombuffer(row["counts"], np.uint32)
            names.append(np.repeat(np.frombuffer(row["nodes"], np.int64), counts))
            sizes.append(np.repeat(np.frombuffer(row["sizes"], np.uint32), counts))
            keys.append(_joined(row["high"], row["low"]) | np.uint64(row["block"]) << shift)
            dfs.append(np.frombuffer(row["df"], np.uint32))
        node, size, h, df = map(np.concatenate, (names, sizes, keys, dfs))
        del names, sizes, keys, dfs
        order = np.lexsort((h, df, node))
        node, size, h = node[order], size[order], h[order]
        out = {"node": [], "size": [], "shared": [], "shingles": [], "prefix": []}
        for name, i, j in _cuts(node):
            n = int(size[i])
            need = -(-percent * n // 100)
            if j - i < need:  # too much of it is its own
                continue
            out["node"].append(name)
            out["size"].append(n)
            out["shared"].append(j - i)
            out["shingles"].append(np.sort(h[i:j]).tobytes())
            out["prefix"].append(h[i : i + j - i - need + 1].astype(np.int64).tolist())
        give_back()
        return pa.Table.from_pydict(out, pa.schema([("node", pa.int64()), ("size", pa.int64()), ("shared", pa.int64()), ("shingles", pa.binary()), ("prefix", pa.list_(pa.int64()))]))

    return shared.groupBy("part").applyInArrow(gather, "node long, size long, shared long, shingles binary, prefix array<long>")


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose overlap is at least ``percent`` of their union."""
    sets = nodes.select("node", "size", "shingles")
    left = sets.toDF("a", "size_a", "set_a")
    right = sets.toDF("b", "size_b", "set_b")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", "set_a", "set_b")

    def decide(batches):
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(batch.column("size_a").to_pylist(), batch.column("size_b").to_pylist(), batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0
                keep.append(100 * both >= percent * (na + nb - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return both.mapInArrow(decide, "a long, b long")


# ------------------------------------------------------- products of cells

#: What a side of a cell holds: shingles, and so many for each set beside its own.
CELL_LOAD, SET_LOAD = 1 << 19, 256
#: Columns of a dense block of a product; pairs that are worked on at once, besides a bit and a count for each pair of a cell.
_COLUMNS = 1024
_PAIRS = 1 << 19


class Cell:
    """Some sets of a family: which stand in the rows, which in the columns of the product."""

    def __init__(self, nodes, roots, top, sizes, sets, in_rows, in_columns, percent: int):
        self.nodes, self.percent = nodes, percent
        self.x, self.y = np.flatnonzero(in_rows), np.flatnonzero(in_columns)
        self.size_x, self.size_y = sizes[self.x][:, None], sizes[self.y][None, :]
        rx, ry = roots[self.x][:, None], roots[self.y][None, :]
        self.live = np.zeros((len(self.x), len(self.y)), bool)
        self.counts = np.zeros(self.live.shape, np.float32)
        for s in self._strips(len(self.x)):
            alike = 100 * np.minimum(self.size_x[s], self.size_y) >= percent * np.maximum(self.size_x[s], self.size_y)
            # a pair of two small components is met from its lesser root only
            self.live[s] = alike & (rx[s] != ry) & ((ry == top) | (rx[s] < ry))
        self.left = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.left)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        size = np.diff(np.append(first, len(flat)))
        column = np.repeat(np.argsort(np.argsort(size, kind="stable"), kind="stable"), size)  # rare shingles first
        order = np.argsort(column, kind="stable")
        self.column, self.owner, self.size = column[order], owner[order], np.sort(size)

    def _strips(self, rows: int):
        """Slices of so many rows whose pairs are worked on at once."""
        step = max(1, _PAIRS // max(1, len(self.y)))
        return (slice(i, min(i + step, rows)) for i in range(0, rows, step))

    def links(self) -> np.ndarray:
        """Which pairs link, after the overlaps of all columns are added up."""
        x_of, y_of = np.full(len(self.nodes), -1), np.full(len(self.nodes), -1)
        x_of[self.x], y_of[self.y] = np.arange(len(self.x)), np.arange(len(self.y))
        rows, columns = self.live.shape
        first = np.concatenate([[0], np.cumsum(self.size)])
        # the few sets of a rare shingle are paired at once; frequent shingles go through dense blocks
        alone = int(np.searchsorted(self.size, 2))
        dense = max(alone, int(np.searchsorted(self.size, math.sqrt(rows * columns) / 10)))
        self._sparse(first, alone, dense, x_of, y_of)
        self.left -= np.bincount(self.owner[: first[dense]], minlength=len(self.nodes))
        at = dense
        while at < len(self.size):
            if not self._discard():
                return self.live
            end = min(at + _COLUMNS, len(self.size))
            column, owner = self.column[first[at] : first[end]] - at, self.owner[first[at] : first[end]]
            both = np.zeros((len(self.nodes), end - at), np.float32)
            both[owner, column] = 1
            r, c = np.flatnonzero(self.live.any(axis=1)), np.flatnonzero(self.live.any(axis=0))
            across = both[self.y[c]].T
            for s in self._strips(len(r)):
                self.counts[np.ix_(r[s], c)] += both[self.x[r[s]]] @ across
            self.left -= np.bincount(owner, minlength=len(self.nodes))
            at = end
        self._discard()
        return self.live

    def _discard(self) -> bool:
        """Drop the pairs that cannot reach their bound with what is left of their shingles."""
        left_x, left_y = self.left[self.x][:, None], self.left[self.y][None, :]
        for s in self._strips(len(self.x)):
            room = self.counts[s].astype(np.int64) + np.minimum(left_x[s], left_y)
            self.live[s] &= (100 + self.percent) * room >= self.percent * (self.size_x[s] + self.size_y)
        return bool(self.live.any())

    def _sparse(self, first, begin, end, x_of, y_of):
        at = begin
        shape = self.counts.shape
        while at < end:
            pairs = np.cumsum(self.size[at:end].astype(np.int64) ** 2)
            stop = at + max(1, int(np.searchsorted(pairs, _PAIRS)))
            size = self.size[at:stop]
            each = np.repeat(size, size)  # partners of each entry, itself included
            entry = np.arange(first[at], first[stop])
            begins = np.repeat(first[at:stop], size)
            a = np.repeat(entry, each)
            b = np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begins, each)
            i, j = x_of[self.owner[a]], y_of[self.owner[b]]
            met = (i >= 0) & (j >= 0)
            flat, times = np.unique(i[met] * shape[1] + j[met], return_counts=True)
            self.counts.reshape(-1)[flat] += times
            at = stop

    def forest(self):
        """Links (a, b) that connect whatever the links connect, fewer than the sets."""
        links = self.links()
        if np.count_nonzero(links) <= len(self.nodes):
            rows, columns = np.nonzero(links)
            yield from zip(self.nodes[self.x[rows]].tolist(), self.nodes[self.y[columns]].tolist())
            return
        seen_x, seen_y = np.zeros(len(self.x), bool), np.zeros(len(self.y), bool)
        x_of = {int(k): i for i, k in enumerate(self.x)}
        for start in np.flatnonzero(links.any(axis=1)).tolist():
            if seen_x[start]:
                continue
            seen_x[start] = True
            waiting = [start]
            while waiting:
                i = waiting.pop()
                new = np.flatnonzero(links[i] & ~seen_y)
                seen_y[new] = True
                for j in new.tolist():
                    yield int(self.nodes[self.x[i]]), int(self.nodes[self.y[j]])
                    same = x_of.get(int(self.y[j]))
                    if same is not None and not seen_x[same]:
                        seen_x[same] = True
                        waiting.append(same)
                    for k in np.flatnonzero(links[:, j] & ~seen_x).tolist():
                        seen_x[k] = True
                        yield int(self.nodes[self.x[k]]), int(self.nodes[self.y[j]])
                        waiting.append(k)


def _families(met: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """(family, class, node, root, load): sets of different components that meet in a prefix, by classes of size.

    A family is named by the least set of a shingle's list, so all its sets have a shingle in common with that one, and
    there are at most as many rows as prefixes have entries.  Sizes of a link are of one class or of two that follow each other;
    each set is in its own class and the next.
    """
    here = _labelled(met, labels)
    mixed = here.groupBy("h").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("h")
    step = math.log(100 / percent * 1.01)  # a little more than the largest ratio of a link
    size_class = F.floor(F.log("size") / step).cast("int")
    here = settle(here.join(mixed, "h").select("h", "node", "root", (F.col("shared") + SET_LOAD).alias("load"), F.explode(F.array(size_class, size_class + 1)).alias("class")), "met")
    lists = here.groupBy("h", "class").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.min("node").alias("family")).where("r1 != r2").select("h", "class", "family")
    lists = settle(lists, "lists")
    families = settle(here.join(lists, ["h", "class"]).select("family", "class", "node", "root", "load").distinct(), "families")
    drop(here, lists)
    return families


def _product_links(families: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Exact links (a, b) of the families' cells, written."""
    # a pair of two components has a side that is not of the family's largest: that side is the rows
    each = families.groupBy("family", "class", "root").agg(F.sum("load").alias("load"))
    grid = each.groupBy("family", "class").agg(F.sum("load").alias("load"), F.max(F.struct("load", "root")).alias("top"))
    cells = lambda load: F.ceil(load / CELL_LOAD).cast("int")
    grid = grid.select("family", "class", F.col("top.root").alias("top"), cells(F.col("load") - F.col("top.load")).alias("tall"), cells(F.col("load")).alias("wide"), "load", (F.col("load") - F.col("top.load")).alias("rows_load"))
    grid = settle(grid, "grid")
    work = grid.agg(F.sum(F.col("rows_load") * F.col("wide") + F.col("load") * F.col("tall"))).first()[0] or 0
    tasks = max(1, -(-work // (2 * CELL_LOAD)))
    placed = families.join(grid.drop("load", "rows_load"), ["family", "class"])
    placed = placed.withColumn("row", F.when(F.col("root") != F.col("top"), F.pmod(F.xxhash64("node", F.lit(0)), "tall")).cast("int"))
    placed = placed.withColumn("column", F.pmod(F.xxhash64("node", F.lit(1)), "wide").cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    across = F.transform(every("wide"), lambda j: F.struct(F.col("row").alias("i"), j.alias("j"), F.lit(True).alias("in_rows"), (j == F.col("column")).alias("in_columns")))
    down = F.transform(every("tall"), lambda i: F.struct(i.alias("i"), F.col("column").alias("j"), F.lit(False).alias("in_rows"), F.lit(True).alias("in_columns")))
    both = F.when(F.col("row").isNull(), down).otherwise(F.concat(across, F.filter(down, lambda c: c["i"] != F.col("row"))))
    placed = placed.select("family", "class", "top", "node", "root", F.inline(both))
    placed = placed.withColumn("task", F.pmod(F.xxhash64("family", "class", "i", "j"), F.lit(tasks)))
    sent = placed.join(nodes.select("node", "size", "shingles"), "node")

    def multiply(key, table):
        a, b = [], []
        table = table.sort_by([(k, "ascending") for k in ("family", "class", "i", "j")])
        get = {k: table.column(k).to_numpy() for k in ("family", "class", "i", "j", "top", "node", "root", "size")}
        flags = [table.column(k).to_numpy(zero_copy_only=False) for k in ("in_rows", "in_columns")]
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("shingles")]
        change = np.zeros(len(table), bool)
        for k in ("family", "class", "i", "j"):
            change[1:] |= get[k][1:] != get[k][:-1]
        for _, s, e in _cuts(np.cumsum(change)):
            if flags[0][s:e].any() and flags[1][s:e].any():
                cell = Cell(get["node"][s:e], get["root"][s:e], get["top"][s], get["size"][s:e], sets[s:e], flags[0][s:e], flags[1][s:e], percent)
                for x, y in cell.forest():
                    a.append(x)
                    b.append(y)
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    columns = ("task", "family", "class", "i", "j", "top", "node", "root", "size", "in_rows", "in_columns", "shingles")
    links = settle(sent.select(*columns).groupBy("task").applyInArrow(multiply, "a long, b long"), "links")
    drop(grid)
    return links


# ------------------------------------------------------------ the operator

#: Rounds in which each node meets one partner of another component.
HUB_ROUNDS = 3


def ngram_jaccard_join(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id.

    Two texts link if 100 * |A & B| >= percent * |A | B| for their sets of
    distinct n-word shingles (A-Z lowered; a shorter text is one shingle).
    component_id is the least doc_id reachable by links, the row's own included.

    A null or empty text, or one without words, has the empty set and links with
    nothing.  Equal texts, repeated rows and repeated ids each keep their row.
    A row with a null doc_id takes part, but names a component only if no other can.
    Other columns are not read.  An empty table gives an empty result.
    """
    table = settle(shingle_table(docs, n), "shingle-sets")
    reached = _components_of_sets(docs, table, n, percent)
    mapped = table.join(reached, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("root"))
    # written: as a table of its own it is joined by two exchanges, and a hot root is split by the skew join
    least = settle(mapped.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    return mapped.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def _components_of_sets(docs: DataFrame, table: DataFrame, n: int, percent: int) -> DataFrame:
    bits = block_bits(table.agg(F.sum("n_shingles")).first()[0] or 0)
    nodes = settle(_candidates(_shared(_incidence(docs, n, bits), bits), bits, percent), "candidate-sets")
    met = settle(nodes.select("node", "size", "shared", F.explode("prefix").alias("h")), "prefixes")
    spark = docs.sparkSession
    found = spark.createDataFrame([], "a long, b long")
    labels = None
    tried = None
    parts, partners = [], []
    for k in range(HUB_ROUNDS):
        here = _labelled(met, labels)
        # of each shingle, one node, another in each round; a node's partner is the one that most of its shingles name
        order = F.xxhash64("root", F.lit(k)).alias("o") if k else F.col("root").alias("o")
        hub = here.groupBy("h").agg(F.min(F.struct(order, "root", "node", "size")).alias("hub"), F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("h", "hub")
        named = here.join(hub, "h").where("root != hub.root").where(_sizes("size", "hub.size", percent))
        named = named.groupBy("node", F.col("hub.node").alias("other")).agg(F.count("*").alias("times"))
        if tried is not None:
            named = named.join(tried, (named["node"] == tried["t_node"]) & (named["other"] == tried["t_other"]), "left_anti")
        picked = named.groupBy("node").agg(F.max(F.struct("times", (-F.col("other")).alias("minus"))).alias("best")).select("node", (-F.col("best.minus")).alias("other"))
        picked = settle(picked, "partners")
        partners.append(picked)
        new = settle(_verified(picked.select(F.col("node").alias("a"), F.col("other").alias("b")), nodes, percent), "links")
        if new.isEmpty():
            break
        now_tried = picked.select(F.col("node").alias("t_node"), F.col("other").alias("t_other"))
        tried = now_tried if tried is None else tried.union(now_tried)
        parts.append(new)
        found = found.union(new)
        before, labels = labels, settle(components(found), "labels")
        drop(before)
    # whatever pair of different components is left
    drop(*partners)
    families = _families(met, labels, percent)
    drop(met, labels)
    parts.append(_product_links(families, nodes, percent))
    drop(families, nodes)
    reached = settle(components(found.union(parts[-1])), "components")
    drop(*parts)
    return reached


def _labelled(met: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return met.select("h", "node", "size", "shared", F.col("node").alias("root"))
    return met.join(labels, "node", "left").select("h", "node", "size", "shared", F.coalesce("root", "node").alias("root"))


def _sizes(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)
