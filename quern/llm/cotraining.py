"""Quality classifier (operator 8) by co-training of two views.

One view sees the text (shares of symbols, capitals, repeated words and so on, and hashed words), the
other the page's metadata (language, source, length).  Each round, each view labels
the unlabelled documents it is surest of, and the other learns from them too.  Both views are then calibrated on
labels held out from training, and their log odds are summed by how much each view is worth there.

Fitting takes a bounded sample of labelled documents (``most_labelled``); every round scores every other document, and so
does the result.  Features are written once, and rounds and result read those.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._shared import give_back, mix, scan_words, settle, slices, span_hashes, text_buffers

#: Log odds beyond which a view is sure.
SURE = 3.0
HASHED = 128
SHARES = 9
TEXT_DIMS, META_DIMS = SHARES + HASHED, 96
_CLASSES = np.zeros((6, 256), bool)
_CLASSES[0, [ord(c) for c in "#*$%&|<>"]] = True
_CLASSES[1, 65:91] = True
_CLASSES[2, 48:58] = True
_CLASSES[3, [ord(c) for c in ".,;:!?"]] = True
_CLASSES[4, 10] = True
_CLASSES[5, 128:] = True


def text_features(col: pa.Array) -> np.ndarray:
    """A row of TEXT_DIMS for each text."""
    data, offsets = text_buffers(col)
    out = np.zeros((len(offsets) - 1, TEXT_DIMS), np.float32)
    for i, j in slices(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = j - i
        w = scan_words(part, off)
        size = np.maximum(1, np.diff(off)).astype(np.float32)
        words = np.diff(w.first)
        count = np.maximum(1, words).astype(np.float32)
        for k in range(len(_CLASSES)):
            sums = np.concatenate([[0], np.cumsum(_CLASSES[k][part])])
            out[i:j, k] = (sums[off[1:]] - sums[off[:-1]]) / (count if k < 2 else size)
        h = span_hashes(part, w.starts, w.ends)
        owner = np.repeat(np.arange(n), words)
        # words that a text has said before, and neighbours that are equal
        order = np.lexsort((h, owner))
        again = np.zeros(len(h), bool)
        if len(h) > 1:
            again[1:] = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
            twin = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
            out[i:j, 7] = np.bincount(owner[1:][twin], minlength=n)[:n] / count
        out[i:j, 6] = np.bincount(owner[order][again], minlength=n)[:n] / count
        out[i:j, 8] = np.log1p(words) / 10
        slot = owner * HASHED + (mix(h) % np.uint64(HASHED)).astype(np.int64)
        bag = np.bincount(slot, minlength=n * HASHED)[: n * HASHED].reshape(n, HASHED)
        out[i:j, SHARES:] = np.sqrt(bag / count[:, None])
    return out


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """A row of META_DIMS for each page: hashed language and source, and its length in steps."""
    import zlib

    out = np.zeros((len(lang), META_DIMS), np.float32)
    for k, (a, b, c) in enumerate(zip(lang, source, n_chars)):
        out[k, zlib.crc32(f"lang={a}".encode()) % 16] = 1
        out[k, 16 + zlib.crc32(f"source={b}".encode()) % 64] = 1
        out[k, 80 + min(15, int(np.log2(max(1, c or 0))))] = 1
    return out


@dataclass
class Linear:
    """Logistic regression on standardized features; ``scale`` and ``shift`` calibrate its log odds."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 3.0, steps: int = 12) -> Linear:
        mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.column_stack([(x - mean) / spread, np.ones(len(x))]).astype(np.float64)
        theta = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], penalty)
        ridge[-1] = 1e-3
        for _ in range(steps):  # Newton's steps
            p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
            grad = z.T @ (weight * (p - y)) + ridge * theta
            hess = (z * (weight * p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(hess, grad)
            theta -= step
            if np.abs(step).max() < 1e-6:
                break
        return Linear(mean, spread, theta)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights[:-1] + self.weights[-1]

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.scale * self.raw(x) + self.shift, -30, 30)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on held-out labels."""
        r = self.raw(x)
        a = Linear.fit(r[:, None], y, np.ones(len(y)), penalty=0.1)
        self.scale = float(a.weights[0] / a.spread[0])
        self.shift = float(a.weights[1] - a.weights[0] * a.mean[0] / a.spread[0])


@dataclass
class QualityModel:
    text: Linear
    meta: Linear
    joint: np.ndarray  # weights of both views' log odds, and a constant
    cutoff: float

    def score(self, x_text: np.ndarray, x_meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.odds(x_text), self.meta.odds(x_meta)
        sure = lambda o: 1 / (1 + np.exp(-np.clip(o, -30, 30)))
        return sure(self.joint[0] * a + self.joint[1] * b + self.joint[2]), sure(a), sure(b)


def cotrain(xt, xm, y, surest, *, rounds: int = 4, max_lost: float = 0.005) -> QualityModel | None:
    """Fit both views on a labelled sample; None if a class is missing.

    ``surest(text, meta, known)`` gives the documents without a label that a view is surest of and that are not ``known``, as rows
    (key, view, label, text features, metadata features). The other view learns them with that label.
    A third of the labels is held out for calibration and for the cutoff: the highest at which at most
    ``max_lost`` of good held-out documents fall, and at most 0.5.
    """
    y = np.asarray(y, float)
    held = np.arange(len(y)) % 3 == 2
    if min((y[~held] == 0).sum(), (y[~held] == 1).sum(), (y[held] == 0).sum(), (y[held] == 1).sum()) < 2:
        return None
    learned_t, learned_m = {}, {}  # key -> (features, pseudo-label that the other view gave)

    def fit(x, learned):
        rows = [learned[k] for k in sorted(learned)]
        both = np.concatenate([x[~held], np.array([f for f, _ in rows], np.float32)]) if rows else x[~held]
        label = np.concatenate([y[~held], [label for _, label in rows]])
        weight = np.concatenate([np.ones((~held).sum()), np.full(len(rows), 0.3)])
        return Linear.fit(both, label, weight)

    for _ in range(rounds):
        text, meta = fit(xt, learned_t), fit(xm, learned_m)
        text.calibrate(xt[held], y[held])
        meta.calibrate(xm[held], y[held])
        found = surest(text, meta, frozenset(learned_t) | frozenset(learned_m))
        if not found:
            break
        for key, view, label, t, m in found:
            if view == "text":
                learned_m[key] = (m, label)
            else:
                learned_t[key] = (t, label)
    text, meta = fit(xt, learned_t), fit(xm, learned_m)
    text.calibrate(xt[held], y[held])
    meta.calibrate(xm[held], y[held])
    views = np.column_stack([text.odds(xt[held]), meta.odds(xm[held])])
    joint = Linear.fit(views, y[held], np.ones(held.sum()), penalty=1.0)
    w = joint.weights[:2] / joint.spread
    w = np.append(w, joint.weights[2] - (w * joint.mean).sum())
    model = QualityModel(text, meta, w, 0.5)
    good = np.sort(model.score(xt[held], xm[held])[0][y[held] == 1])
    model.cutoff = float(min(0.5, good[int(max_lost * len(good))]))
    return model


_FEATURES = "doc_id long, key long, t binary, m binary"


def _unpack(col, dims: int) -> np.ndarray:
    """Features of rows; they are kept with half precision."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.frombuffer(b"".join(col.to_pylist()), np.float16).reshape(-1, dims).astype(np.float32)


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, key, t, m) of each document, written; key names a row by its id and text."""

    def run(batches):
        for batch in batches:
            t = text_features(batch.column("text")).astype(np.float16)
            m = meta_features(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars"))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([r.tobytes() for r in t], pa.binary()), pa.array([r.tobytes() for r in m], pa.binary())], ["doc_id", "key", "t", "m"])
        give_back()

    return settle(_picked(docs).withColumn("key", F.xxhash64("doc_id", "text")).mapInArrow(run, _FEATURES), "features")


def _picked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def _labelled(features: DataFrame, labels: DataFrame, most_labelled: int) -> DataFrame:
    """``features`` with y: the label of the documents of a sample, by hash, of at most ``most_labelled`` ids, half of each class."""
    best = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("quality").alias("quality"))
    order = F.xxhash64("label_id")
    some = [best.where(F.col("quality") == k).orderBy(order, "label_id").limit(most_labelled // 2) for k in (0, 1)]
    ids = some[0].union(some[1]).select("label_id", F.col("quality").cast("double").alias("y"))
    return features.join(F.broadcast(ids), F.col("doc_id") == F.col("label_id"), "left").drop("label_id")  # most_labelled rows at most


def _surest(unlabelled: DataFrame, each: int):
    """The ``each`` documents of each view and class that the view is surest of: those of every partition, then of all."""
    spark = unlabelled.sparkSession
    schema = "view string, label double, sure double, key long, t binary, m binary"

    def pick(text, meta, known):
        sent = spark.sparkContext.broadcast((text, meta, np.array(sorted(known), np.int64)))

        def run(batches):
            text, meta, known = sent.value
            best: dict[tuple[str, float], dict[int, tuple]] = {}
            for batch in batches:
                key = batch.column("key").to_numpy()
                fresh = ~np.isin(key, known)
                odds = {"text": text.odds(_unpack(batch.column("t"), TEXT_DIMS)), "meta": meta.odds(_unpack(batch.column("m"), META_DIMS))}
                for view, o in odds.items():
                    for label, sure in ((1.0, o), (0.0, -o)):
                        rows = np.flatnonzero(fresh & (sure > SURE))
                        rows = rows[np.lexsort((key[rows], -sure[rows]))][: 4 * each]
                        top = best.setdefault((view, label), {})
                        for r in rows.tolist():
                            top[int(key[r])] = (float(sure[r]), int(key[r]), batch.column("t")[r].as_py(), batch.column("m")[r].as_py())
                        if len(top) > each:
                            keep = sorted(top.values(), key=lambda x: (-x[0], x[1]))[:each]
                            best[view, label] = {x[1]: x for x in keep}
            rows = [(*group, *x) for group, top in best.items() for x in top.values()]
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["view", "label", "sure", "key", "t", "m"])
            give_back()

        near = settle(unlabelled.select("key", "t", "m").mapInArrow(run, schema), "surest")
        out = []
        for view in ("text", "meta"):
            for label in (1.0, 0.0):
                top = near.where((F.col("view") == view) & (F.col("label") == label)).groupBy("key").agg(F.first("sure").alias("sure"), F.first("t").alias("t"), F.first("m").alias("m"))
                for r in top.orderBy(F.desc("sure"), "key").limit(each).collect():  # ``each`` rows at most
                    out.append((r["key"], view, label, np.frombuffer(r["t"], np.float16).astype(np.float32), np.frombuffer(r["m"], np.float16).astype(np.float32)))
        return out

    return pick


def fit_quality(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 6000, each: int = 50) -> tuple[QualityModel | None, DataFrame]:
    """The model, and the features (doc_id, key, t, m) of every document.

    At most ``most_labelled`` rows of labelled documents come to the driver, and in each round at most ``each`` documents of each
    view and class, of all that have no label in the sample.
    """
    features = _features(docs)
    both = _labelled(features, labels, most_labelled)
    rows = both.where("y IS NOT NULL").orderBy(F.xxhash64("key"), "key", "y").limit(most_labelled).toArrow()
    y = rows.column("y").to_numpy()
    t, m = (_unpack(rows.column(c), d) for c, d in (("t", TEXT_DIMS), ("m", META_DIMS)))
    return cotrain(t, m, y, _surest(both.where("y IS NULL"), each)), features


def classify_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, score, text_score, meta_score, kept.

    ``score`` is the chance that the document is good, from both calibrated views; ``kept`` is whether it reaches
    the cutoff.  Without labels of both classes nothing is learned: scores are null and all is kept.
    Options are those of ``fit_quality``.

    A null text counts as empty; null ids, languages, sources and lengths are values like others; repeated rows are
    kept; documents that a view is equally sure of are taken by a hash of id and text; other columns are not read; an empty table gives an empty result.
    """
    model, features = fit_quality(docs, labels, **options)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            n = len(batch)
            if model is None:
                none = pa.nulls(n, pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), none, none, none, pa.array(np.ones(n, bool))], ["doc_id", "score", "text_score", "meta_score", "kept"])
                continue
            both, a, b = model.score(_unpack(batch.column("t"), TEXT_DIMS), _unpack(batch.column("m"), META_DIMS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.asarray(v, np.float64)) for v in (both, a, b)), pa.array(both >= model.cutoff)], ["doc_id", "score", "text_score", "meta_score", "kept"])

    return features.mapInArrow(run, "doc_id long, score double, text_score double, meta_score double, kept boolean")


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all columns, that the classifier keeps; each is judged where it is read, so nothing is joined."""
    model, _ = fit_quality(docs, labels, **options)
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            t = text_features(batch.column("text")).astype(np.float16).astype(np.float32)  # as the model has seen them
            m = meta_features(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
            yield batch.filter(pa.array(model.score(t, m)[0] >= model.cutoff, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
