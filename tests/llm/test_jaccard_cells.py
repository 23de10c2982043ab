"""The products of the n-gram join: exact overlaps in a cell, and the whole join without the rounds before them."""

import random
import re

import numpy as np
from test_operators import WORD, documents, prose


def _brute(texts, percent=80):
    sets = []
    for t in texts:
        w = re.findall(WORD, t.lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links += 1
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return links, [(k, len(sets[k]), find(k)) for k in range(len(texts))]


def test_a_cell_finds_every_link_and_emits_a_forest():
    from quern.llm.jaccard_join import Cell

    rnd = np.random.default_rng(4)
    for trial in range(12):
        n, percent = int(rnd.integers(2, 260)), 80
        base = [rnd.choice(1 << 20, int(rnd.integers(5, 120)), replace=False) for _ in range(3)]
        sets = []
        for k in range(n):
            s = base[k % 3].copy()
            change = rnd.random(len(s)) < rnd.choice([0.02, 0.1, 0.3])
            s[change] = rnd.integers(0, 1 << 21, change.sum())
            sets.append(np.unique(s).astype(np.uint64))
        nodes = rnd.permutation(10 * n)[:n].astype(np.int64)
        roots = rnd.integers(0, max(2, n // 2), n)
        sizes = np.array([len(s) for s in sets]) + rnd.integers(0, 2, n)
        top = int(np.bincount(roots).argmax())
        in_rows = (roots != top) & (rnd.random(n) < 0.9)
        in_columns = rnd.random(n) < 0.9
        if not in_rows.any() or not in_columns.any():
            continue
        cell = Cell(nodes, roots, top, sizes, sets, in_rows, in_columns, percent)
        links = cell.links()
        want = set()
        for i in np.flatnonzero(in_rows):
            for j in np.flatnonzero(in_columns):
                both = len(np.intersect1d(sets[i], sets[j]))
                if roots[i] != roots[j] and (roots[j] == top or roots[i] < roots[j]) and 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    want.add((int(nodes[i]), int(nodes[j])))
        assert {(int(nodes[cell.x[i]]), int(nodes[cell.y[j]])) for i, j in zip(*np.nonzero(links))} == want
        out = set(Cell(nodes, roots, top, sizes, sets, in_rows, in_columns, percent).forest())
        assert out <= want and len(out) <= n
        for a, b in want:  # what the links connect, the forest connects
            reach, new = {a}, {a}
            while new:
                new = {y for x, y in out if x in reach} | {x for x, y in out if y in reach}
                new -= reach
                reach |= new
            assert b in reach


def test_products_alone_equal_brute_force(spark, monkeypatch):
    from quern.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "HUB_ROUNDS", 0)
    monkeypatch.setattr(jaccard_join, "CELL_LOAD", 3000)  # grids of cells on few texts
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 50)  # many blocks and parts
    rnd, texts = random.Random(8), []
    for base in range(4):
        words = prose(base, rnd.randint(30, 90)).split()
        for _ in range(30):
            w = list(words)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(["x", "y", "z", "w"])
            texts.append(" ".join(w[rnd.randint(0, 3) :]))
    passage = prose(99, 60)  # one passage in many texts, most of them else different
    texts += [f"{prose(200 + k, rnd.choice([2, 8, 40]))} {passage}" for k in range(40)]
    links, want = _brute(texts)
    got = sorted(tuple(r) for r in jaccard_join.ngram_jaccard_join(documents(spark, texts)).collect())
    assert links > 100 and got == want
