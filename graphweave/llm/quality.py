"""Quality classifier: Naive Bayes support vectors over hashed n-gram indicators.

Indicators are 1- and 2-grams of words and 1- to 3-grams of word shapes, and the
share of each shape in powers of two.  They are scaled by class log-count ratios
(Naive Bayes) and go into a linear hinge-loss model fitted by dual coordinate
descent.  It is fitted on a bounded sample of labelled rows; every text is scored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 20
#: The fit is on a bounded sample: labelled rows in order of the hashes of their ids, at most SAMPLE, as long as all their
#: features, of 4 bytes, fit into SAMPLE_BYTES.  A row that doesn't fit is passed over.
SAMPLE, SAMPLE_BYTES = 6000, 64 << 20

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _grams(h: np.ndarray, doc: np.ndarray, n: int):
    """Hashes of the n-grams that stay inside a text."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[:m].copy()
    for k in range(1, n):
        out = C.mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m])
    same = doc[:m] == doc[n - 1 :]
    return out[same], doc[:m][same]


def indicators(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket), repeats included, of all indicators of some texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data, starts, ends, doc = C.word_spans(b"\n".join(texts), sizes)
    count = np.bincount(doc, minlength=len(texts))
    parts = [(np.full(len(texts), 0, np.int64), np.log2(count + 1).astype(np.uint64), np.arange(len(texts)))]
    if len(starts):
        lens = ends - starts
        inside = ~C._SPACE[data]
        body = data[inside]
        word = C.hash_runs(_LOWER[body], lens)
        kind = _CLASS[body]
        at = np.cumsum(lens) - lens
        new = np.ones(len(kind), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[at] = True
        shape = C.hash_runs(kind[new], np.add.reduceat(new.astype(np.int64), at))
        again = np.zeros(len(word), bool)
        again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        shape = C.mix64(shape + again.astype(np.uint64))
        parts += [(1, word, doc), (2, *_grams(word, doc, 2)), (3, shape, doc), (4, *_grams(shape, doc, 2)), (5, *_grams(shape, doc, 3))]
        # Text and shape in one number: sorting that is cheaper than sorting by two.
        both = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (shape >> np.uint64(24)))
        first = np.ones(len(both), bool)
        first[1:] = both[1:] != both[:-1]
        where = np.flatnonzero(first)
        s, d = both[where] & np.uint64((1 << 40) - 1), (both[where] >> np.uint64(40)).astype(np.int64)
        share = np.diff(np.append(where, len(both))) / count[d]
        rate = np.floor(-np.log2(share)).astype(np.uint64)
        parts.append((6, C.mix64(s + (rate + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)), d))
    docs, buckets = [], []
    for stream, h, d in parts:
        salt = C.mix64(np.uint64(1) + np.asarray(stream).astype(np.uint64).reshape(-1)[:1])
        buckets.append((C.mix64(h ^ salt) >> np.uint64(64 - BITS)).astype(np.int64))
        docs.append(d)
    return np.concatenate(docs), np.concatenate(buckets)


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct buckets of each text."""
    doc, bucket = indicators(texts)
    key = np.unique((doc << BITS) | bucket)
    cut = np.searchsorted(key >> BITS, np.arange(1, len(texts)))
    return [x & ((1 << BITS) - 1) for x in np.split(key, cut)]


@dataclass
class Model:
    weight: np.ndarray  # of an indicator, ratio included
    square: np.ndarray  # of its ratio
    bias: float
    scale: float

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Of whole texts; indicators that no fitted row has count nothing."""
        doc, bucket = indicators(texts)
        known = self.square[bucket] > 0
        key = np.unique((doc[known] << BITS) | bucket[known])
        doc, bucket = key >> BITS, key & ((1 << BITS) - 1)
        dot = np.bincount(doc, self.weight[bucket], len(texts))
        norm = np.sqrt(np.bincount(doc, self.square[bucket], len(texts)))
        return self.bias + dot / np.maximum(norm, 1e-9)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.scale * self.margins(texts)))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, alpha: float = 1.0, epochs: int = 30, scale: float = 3.0, seed: int = 7, tolerance: float = 1e-3) -> Model:
    """Log-count ratios, then dual coordinate descent for the hinge loss on rows of unit length.

    With one class or no row at all, every text gets that class, or 1.
    """
    labels = np.asarray(labels, np.int64)
    good = labels == 1
    zeros = np.zeros(1 << BITS)
    if not len(labels) or good.all() or not good.any():
        return Model(zeros, zeros, 1.0 if not len(labels) or good.all() else -1.0, scale)
    p, q = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for r, g in zip(rows, good):
        np.add.at(p if g else q, r, 1)
    ratio = np.log((p + alpha) / (good.sum() + 2 * alpha)) - np.log((q + alpha) / ((~good).sum() + 2 * alpha))
    ratio[p + q == 0] = 0
    norm = np.array([max(np.linalg.norm(ratio[r]), 1e-9) for r in rows])
    unit = lambda i: ratio[rows[i]] / norm[i]  # noqa: E731  made anew each time: all of them take twice the bytes of the features
    y = np.where(good, 1.0, -1.0)
    w, bias, dual = zeros.copy(), 0.0, np.zeros(len(rows))
    diagonal = np.array([(x := unit(i)) @ x + 1 for i in range(len(rows))])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x = unit(i)
            g = y[i] * (w[rows[i]] @ x + bias) - 1
            new = min(max(dual[i] - g / diagonal[i], 0.0), cost)
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                w[rows[i]] += step * x
                bias += step
                moved = max(moved, abs(step))
                dual[i] = new
        if moved < tolerance:
            break
    return Model((w * ratio).astype(np.float64), ratio**2, float(bias), scale)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on labelled rows outside the held-out fold (crc32 of the id modulo 3 is 1), bounded in rows and in bytes.

    Null labels and ids don't count; of several labels of one id the mean decides,
    of several documents the text with the smallest hash.  Empty texts and those
    without words are rows like others.  Executors make the features; the driver
    gets at most ``sample_bytes`` of them.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isNotNull())
    known = known.where(C.remainder(F.col("_id"), 3) != 1).groupBy("_id").agg((F.avg("_label") >= 0.5).cast("int").alias("_label"))
    picked = C.cut(C.smallest_hashes(C.cut(known), "_id", sample))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")  # at most ``sample`` rows

    def run(batches):
        for batch in batches:
            for first, texts in C.chunks(batch, "_text", C.SLICE):
                got = [f.astype(np.int32) for f in features(texts)]
                marks = pa.array([zlib.crc32(t) for t in texts], pa.int64())
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_label"), marks, pa.array(got, pa.list_(pa.int32()))], names=["id", "label", "mark", "f"])

    kind = rows.schema["_id"].dataType.simpleString()
    made = C.cut(rows.select("_id", "_text", "_label").mapInArrow(C.lean(run), f"id {kind}, label int, mark long, f array<int>"))
    made = made.withColumn("size", F.size("f"))
    sizes = made.groupBy("id").agg(F.min(F.struct("mark", "size")).alias("x")).select("id", "x.*").orderBy(F.xxhash64("id"), "id").collect()  # a row a picked id
    room, fits = sample_bytes // 4, []
    for r in sizes:
        if r.size <= room:
            room, fits = room - r.size, [*fits, (r.id, r.mark)]
    if not fits:
        return fit([], np.zeros(0, np.int64))
    chosen = docs.sparkSession.createDataFrame(fits, f"id {kind}, mark long")
    model = fit_table(made.drop("size").dropDuplicates(["id", "mark"]).join(F.broadcast(chosen), ["id", "mark"]).select("id", "label", "f").toArrow())
    C.give_back()  # else the driver keeps what the fit has taken
    return model


def fit_table(got: pa.Table) -> Model:
    """fit() on rows (id, label, f), in order of their ids; the features stay where they are."""
    found = []
    for lists in got.column("f").chunks:
        flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        found += [flat[a:b] for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0])]
    order = pc.sort_indices(got.column("id")).to_numpy()
    return fit([found[i] for i in order], got.column("label").to_numpy()[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of ``docs``; null text scores as empty.

    Texts are scored whole; of a very long one, memory holds about 200 bytes a word.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of 2 ** BITS numbers

    def run(batches):
        m = shared.value
        for batch in batches:
            for first, texts in C.chunks(batch, "text", C.SLICE):
                s = m.scores(texts)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (C.remainder(F.col(id_col), 3) == 1).alias("held_out"))
    return rows.mapInArrow(C.lean(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns as they were.

    Null text is judged as empty; equal rows fare alike.  Texts are judged whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for first, texts in C.chunks(batch, text_col, C.SLICE):
                yield batch.slice(first, len(texts)).filter(pa.array(m.scores(texts) >= 0.5))

    return docs.mapInArrow(C.lean(run), docs.schema)
