"""Language-model scoring with a log-bilinear model.

The words before a token, by position, predict it: their vectors, each weighted
by its position's vector, add up to a context c, and the score of an outcome o is
q_o . c + b_o.  A token's probability has two normalised factors: of its group
among all groups, and of the word inside its group.  The most frequent words are
dealt to groups of equal mass and have vectors of their own; all others form a
group for each surface (last bytes and length), inside which a word's share comes
from the corpus counts.  These are never capped: the most frequent words are
looked up in a broadcast table of fixed size, all others are joined.

Training is noise-contrastive estimation with sampled noise, in numpy.  Every
partition runs over all its training texts from one start, and the weights are
averaged by tokens, in a tree, so one pass covers the corpus in bounded memory.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words with vectors of their own, groups that they are dealt to, and groups of all other words.
WORDS, GROUPS, SURFACES = 4096, 48, 80
#: Preceding words that predict a token, and numbers of a vector.
CONTEXT, DIM = 2, 16
#: Tokens of the first steps and the most of a step, which takes 1 / GROWTH of those before it; noise of a step among groups
#: and, for each group, among its words.
FIRST, STEP, GROWTH, NOISE, WORD_NOISE = 128, 4096, 16, 24, 8
#: Weights that one task averages.
FAN = 16
#: Words whose counts are broadcast (16 bytes each); the counts of all others are joined.
HEAD = 1 << 18
#: Training leaves out the texts whose crc32 of the id modulo FOLDS is HELD_OUT.
FOLDS, HELD_OUT = 7, 2


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all tokens of some texts, each text closed by END; the low byte of a word's hash is its surface."""
    h, doc, ends = C.words_of(texts, ends=True)
    surface = C.mix64(ends.astype(np.uint64)) % np.uint64(SURFACES)
    h = (h & ~np.uint64(255)) | surface
    n = len(texts)
    at = np.searchsorted(doc, np.arange(n), "right")
    return np.insert(h, at, C.END), np.insert(doc, at, np.arange(n))


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs and how often each occurs."""
    order = np.lexsort((h, doc))
    d, k = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    return d[at], k[at], np.diff(np.append(at, len(d)))


class Counter:
    """Counts of 64-bit keys in bounded memory: full() tells when to hand them on."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.keys, self.counts, self.parts = most, np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, h: np.ndarray) -> None:
        self.parts.append(np.unique(h, return_counts=True))
        if sum(len(k) for k, _ in self.parts) > self.most // 2:
            self.fold()

    def fold(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.parts]])
        counts = np.concatenate([self.counts, *[c for _, c in self.parts]])
        self.parts = []
        self.keys, inverse = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(inverse, counts, len(self.keys)).astype(np.int64)

    def full(self) -> bool:
        return len(self.keys) > self.most

    def take(self) -> pa.RecordBatch:
        self.fold()
        out = pa.RecordBatch.from_arrays([pa.array(self.keys.view(np.int64)), pa.array(self.counts)], names=["h", "c"])
        self.keys, self.counts = self.keys[:0], self.counts[:0]
        return out


def count_tokens(texts: DataFrame) -> DataFrame:
    """(h, c): how often each token occurs in all rows of the column ``text``."""

    def run(batches):
        got = Counter()
        for batch in batches:
            for _, part in C.chunks(batch, "text"):
                got.add(tokens(part)[0])
                if got.full():
                    yield got.take()
        yield got.take()

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, head: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the most frequent words, most frequent first: at most ``head``, or the first ``least``.

    A histogram by size of count, of a few hundred rows, tells from which count on
    words fit into ``head``; no sort of all words is needed.  Where equal counts
    leave fewer than ``least``, those are taken by count and hash.
    """
    step = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    room, start = head, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.col("step").desc()).collect():
        if r.n > room:
            break
        room, start = room - r.n, r.step
    picked = counts.where(step >= start) if start is not None else counts.limit(0)
    if head - room < least:
        picked = counts.orderBy(F.col("c").desc(), "h").limit(least)
    got = picked.toArrow()
    h, c = got.column("h").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.lexsort((h, -c))
    return h[order], c[order]


# ---------------------------------------------------------------- the model


class Lexicon:
    """Items: the frequent words from 0, by falling count, then a surface each, then the start of a text.

    Groups: runs of words of about equal mass, then a surface each.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rest: np.ndarray, groups: int = GROUPS):
        """Hashes and counts of the words, END among them, most frequent first; tokens of all other words by surface."""
        self.n, at = len(hashes), np.argsort(hashes)
        self.hashes, self.order = hashes[at], at
        self.start = self.n + SURFACES
        mass = np.cumsum(counts) - counts
        bins = (mass * groups // max(counts.sum(), 1)).astype(np.int64)
        self.first = np.flatnonzero(np.diff(bins, prepend=-1)) if self.n else np.zeros(0, np.int64)
        self.words_of = np.append(self.first, self.n)  # where each group's words begin
        self.heads, self.groups = len(self.first), len(self.first) + SURFACES
        self.group = np.concatenate([np.searchsorted(self.first, np.arange(self.n), "right") - 1, self.heads + np.arange(SURFACES)])
        by_word = counts + 0.5
        total = np.add.reduceat(by_word, self.first) if self.n else np.zeros(0)
        self.word_share = by_word / total[self.group[: self.n]] if self.n else by_word
        mass = np.concatenate([total, rest + 0.5])
        self.group_share = mass / mass.sum()

    def items(self, h: np.ndarray) -> np.ndarray:
        out = self.n + (h & np.uint64(255)).astype(np.int64)
        if self.n:
            at = np.minimum(np.searchsorted(self.hashes, h), self.n - 1)
            hit = self.hashes[at] == h
            out[hit] = self.order[at[hit]]
        return out

    def contexts(self, items: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """(token, position): the items before each token, the nearest first."""
        begin = np.flatnonzero(np.diff(doc, prepend=-1))
        inside = np.arange(len(doc)) - np.repeat(begin, np.diff(np.append(begin, len(doc))))
        out = np.full((len(items), CONTEXT), self.start, np.int64)
        for k in range(1, CONTEXT + 1):
            there = np.flatnonzero(inside >= k)
            out[there, k - 1] = items[there - k]
        return out


class Weights:
    """All numbers of a model in one flat array, and their views: vectors r of items, c of positions, g of groups and w of
    words; the last two end in the outcome's bias."""

    def __init__(self, lexicon: Lexicon, flat: np.ndarray | None = None, seed: int = 3):
        shapes = {"r": (lexicon.start + 1, DIM), "c": (CONTEXT, DIM), "g": (lexicon.groups, DIM + 1), "w": (lexicon.n, DIM + 1)}
        ends = np.cumsum([int(np.prod(s)) for s in shapes.values()])
        self.flat = np.zeros(ends[-1], np.float32) if flat is None else flat.astype(np.float32)
        for (name, shape), b in zip(shapes.items(), ends):
            setattr(self, name, self.flat[b - int(np.prod(shape)) : b].reshape(shape))
        if flat is None:  # at first the model is the unigram distribution
            self.r[:] = np.random.default_rng(seed).normal(0, 0.3, self.r.shape)
            self.c[:] = 1 / CONTEXT
            self.g[:, -1], self.w[:, -1] = np.log(lexicon.group_share), np.log(lexicon.word_share)

    def hidden(self, contexts: np.ndarray) -> np.ndarray:
        """The vector that a context predicts with, and 1 for the bias."""
        out = np.ones((len(contexts), DIM + 1), np.float32)
        out[:, :-1] = self.r[contexts[:, 0]] * self.c[0]
        for k in range(1, CONTEXT):
            out[:, :-1] += self.r[contexts[:, k]] * self.c[k]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _by_row(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sum of the rows of each."""
    order = np.argsort(keys.astype(np.uint16) if len(keys) and keys.max() < 1 << 16 else keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[at], np.add.reduceat(values[order], at)


class Trainer:
    """Steps of noise-contrastive estimation, by Adagrad."""

    def __init__(self, lexicon: Lexicon, flat: np.ndarray, rate: float = 0.1, seed: int = 0):
        self.lexicon, self.w, self.rate = lexicon, Weights(lexicon, flat.copy()), np.float32(rate)
        self.square = Weights(lexicon, np.full(len(flat), 1e-8))
        self.rng, self.seen = np.random.default_rng(seed), 0
        self.group_sum, self.word_sum = np.cumsum(lexicon.group_share), np.cumsum(lexicon.word_share)
        self.group_log = np.log(NOISE * lexicon.group_share).astype(np.float32)
        self.word_log = np.log(WORD_NOISE * lexicon.word_share).astype(np.float32)

    def _move(self, name: str, rows, grad: np.ndarray) -> None:
        square, value = getattr(self.square, name), getattr(self.w, name)
        total = square[rows] + grad * grad
        square[rows] = total
        value[rows] += self.rate * grad / np.sqrt(total)

    @staticmethod
    def _contrast(hidden, vectors, mine, mine_log, noise, noise_log):
        """Pulls of the tokens' own outcomes and of noise: on the hidden vectors, and on the outcomes' vectors."""
        own = vectors[mine]
        up = 1 - _sigmoid(np.einsum("ij,ij->i", hidden, own) - mine_log)[:, None]
        down = -_sigmoid(hidden @ vectors[noise].T - noise_log)
        own *= up
        own += down @ vectors[noise]
        return own, up * hidden, down.T @ hidden

    def step(self, items: np.ndarray, contexts: np.ndarray) -> None:
        """One step on some tokens; gradients are means over them."""
        x, w = self.lexicon, self.w
        order = np.argsort(items.astype(np.uint16) if x.start < 1 << 16 else items, kind="stable")
        items, contexts = items[order], contexts[order]
        n, groups, hidden = np.float32(1 / len(items)), x.group[items], w.hidden(contexts)
        # Groups: all tokens share one set of noise.
        noise = np.minimum(np.searchsorted(self.group_sum, self.rng.random(NOISE) * self.group_sum[-1]), x.groups - 1)
        back, own, other = self._contrast(hidden, w.g, groups, self.group_log[groups], noise, self.group_log[noise])
        moves = {"g": ([groups, noise], [own, other])}
        # Words: the tokens of a group share noise from it.
        ends = np.searchsorted(groups, np.arange(x.heads + 1))
        keys, values = [], []
        for g in np.flatnonzero((np.diff(ends) > 0) & (np.diff(x.words_of) > 1)):
            a, b, lo, hi = ends[g], ends[g + 1], x.words_of[g], x.words_of[g + 1]
            below = self.word_sum[lo - 1] if lo else 0.0
            noise = np.clip(np.searchsorted(self.word_sum, below + self.rng.random(WORD_NOISE)), lo, hi - 1)
            pull, own, other = self._contrast(hidden[a:b], w.w, items[a:b], self.word_log[items[a:b]], noise, self.word_log[noise])
            back[a:b] += pull
            keys += [items[a:b], noise]
            values += [own, other]
        if keys:
            moves["w"] = (keys, values)
        back = back[:, :-1] * n
        at = [contexts[:, k] for k in range(CONTEXT)]
        shift = np.stack([np.einsum("ij,ij->j", back, w.r[k]) for k in at])
        self._move("r", *_by_row(np.concatenate(at), np.concatenate([back * w.c[k] for k in range(CONTEXT)])))
        self._move("c", slice(None), shift)
        for name, (keys, values) in moves.items():
            rows, grad = _by_row(np.concatenate(keys), np.concatenate(values))
            self._move(name, rows, grad * n)
        self.seen += len(items)

    def train(self, items: np.ndarray, contexts: np.ndarray) -> None:
        """Steps over some tokens in random order: small ones at first, which learn more from the same tokens."""
        mixed, i = self.rng.permutation(len(items)), 0
        while i < len(items):
            part = mixed[i : i + min(STEP, max(FIRST, self.seen // GROWTH))]
            self.step(items[part], contexts[part])
            i += len(part)


@dataclass
class Model:
    lexicon: Lexicon
    weights: Weights
    train_tokens: int
    distinct: int
    rest_tokens: np.ndarray  # of the words without vectors, by surface
    rest_distinct: np.ndarray
    head: np.ndarray  # hashes of the most frequent words, sorted
    head_counts: np.ndarray
    train_ends: int  # training texts

    def log_probabilities(self, items: np.ndarray, contexts: np.ndarray, most: int = 1 << 14) -> np.ndarray:
        """log P of each token: of its group, and of the word inside a group of frequent words; batched matrix products, normalised."""
        x, w = self.lexicon, self.weights
        out = np.zeros(len(items))
        for i in range(0, len(items), most):
            order = np.argsort(items[i : i + most], kind="stable")
            mine = items[i : i + most][order]
            groups, hidden = x.group[mine], w.hidden(contexts[i : i + most][order])
            got = _log_softmax(hidden @ w.g.T, groups)
            ends = np.searchsorted(groups, np.arange(x.heads + 1))
            for g in np.flatnonzero((np.diff(ends) > 0) & (np.diff(x.words_of) > 1)):
                a, b, lo, hi = ends[g], ends[g + 1], x.words_of[g], x.words_of[g + 1]
                got[a:b] += _log_softmax(hidden[a:b] @ w.w[lo:hi].T, mine[a:b] - lo)
            out[i + order] = got
        return out


def _log_softmax(s: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """log of the normalised share of the picked outcome of each row; scores above 80 are levelled first."""
    if s.max() > 80:
        s -= s.max(axis=1, keepdims=True)
    taken = s[np.arange(len(s)), pick].astype(np.float64)
    np.exp(s, out=s)
    return taken - np.log(s.sum(axis=1))


def train_nce(rows: DataFrame, lexicon: Lexicon) -> Weights:
    """Weights averaged over the partitions of ``rows`` (column text), by their tokens.

    A partition goes over its texts once, whatever the size of the corpus; the
    weights are averaged FAN at a time until FAN are left.
    """
    start = Weights(lexicon)
    shared = rows.sparkSession.sparkContext.broadcast((lexicon, start.flat))  # WORDS bounds its size
    schema = "part long, seen long, flat binary"

    def one(part, seen, flat):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seen], pa.int64()), pa.array([flat.astype(np.float32).tobytes()], pa.binary())], names=["part", "seen", "flat"])

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        lexicon, flat = shared.value
        t = Trainer(lexicon, flat, seed=part)
        for batch in batches:
            for _, texts in C.chunks(batch, "text"):
                h, doc = tokens(texts)
                items = lexicon.items(h)
                t.train(items, lexicon.contexts(items, doc))
        if t.seen:
            yield one(part, t.seen, t.w.flat)

    def mean(table: pa.Table) -> pa.Table:
        seen = table.column("seen").to_numpy()
        order = np.argsort(table.column("part").to_numpy())
        flat = sum(np.frombuffer(table.column("flat")[int(i)].as_py(), np.float32) * (seen[i] / seen.sum()) for i in order)
        return pa.Table.from_batches([one(int(table.column("part").to_numpy().min()), int(seen.sum()), flat)])

    made = C.cut(rows.mapInArrow(run, schema))
    n = made.count()
    while n > FAN:
        groups = -(-n // FAN)
        made = C.cut(made.groupBy(F.pmod("part", F.lit(groups)).alias("g")).applyInArrow(mean, schema))
        n = made.count()
    return Weights(lexicon, np.frombuffer(mean(made.toArrow()).column("flat")[0].as_py(), np.float32)) if n else start


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, head: int = HEAD, folds: int = FOLDS, held_out: int = HELD_OUT) -> tuple[Model, DataFrame]:
    """The model, and the counts (h, c) of all training tokens."""
    rows = docs.where(C.remainder(F.col(id_col), folds) != held_out).select(F.col(text_col).alias("text"))
    end = int(np.array(C.END, np.uint64).view(np.int64))
    counts = C.cut(count_tokens(rows))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("h") == end, F.col("c"))), F.lit(0)).alias("ends")).first()
    others = counts.where(F.col("h") != end)
    h, c = frequent(others, head, words)
    rest_tokens, rest_distinct = np.zeros(SURFACES, np.int64), np.zeros(SURFACES, np.int64)
    for r in others.groupBy(F.col("h").bitwiseAND(F.lit(255)).cast("int").alias("s")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # a row a surface
        rest_tokens[r.s], rest_distinct[r.s] = r.n, r.v
    surface = (h[:words] & np.uint64(255)).astype(np.int64)
    rest_tokens -= np.bincount(surface, c[:words], SURFACES).astype(np.int64)
    rest_distinct -= np.bincount(surface, minlength=SURFACES)
    named, times = np.append(h[:words], C.END), np.append(c[:words], totals.ends)
    order = np.lexsort((named, -times))
    lexicon = Lexicon(named[order], times[order], rest_tokens)
    weights = train_nce(rows, lexicon)
    order = np.argsort(h)
    return Model(lexicon, weights, int(totals.n), int(totals.v), rest_tokens, rest_distinct, h[order], c[order], int(totals.ends)), counts


def _partial(shared):
    """Rows to sum by document: one with what is known at once, and one per word whose count must be joined."""

    def run(batches):
        m = shared.value
        x, head, head_log = m.lexicon, m.head, np.log10(m.head_counts + 1.0)
        ends_log = math.log10(m.train_ends + 1)
        rest_log = np.log10(m.rest_tokens + m.rest_distinct + 1.0)
        for batch in batches:
            for first, texts in C.chunks(batch, "text"):
                ids = batch.column("uid").slice(first, len(texts)).to_numpy()
                h, doc = tokens(texts)
                items = x.items(h)
                size = len(texts)
                count = np.bincount(doc, minlength=size)
                rest = items >= x.n
                logs = m.log_probabilities(items, x.contexts(items, doc)) / math.log(10)
                logs[rest] -= rest_log[items[rest] - x.n]
                lbl = np.bincount(doc, logs, size)
                at = np.minimum(np.searchsorted(head, h), max(len(head) - 1, 0))
                hit = head[at] == h if len(head) else np.zeros(len(h), bool)
                logs = np.zeros(len(h))
                if len(head):
                    logs[hit] = head_log[at[hit]]
                ends = h == C.END
                logs[ends] = ends_log
                known = hit | (ends & (m.train_ends > 0))
                base = np.bincount(doc, logs, size)
                lbl += np.bincount(doc, np.where(rest, logs, 0.0), size)
                n_known = np.bincount(doc, known, size).astype(np.int64)
                tail = ~hit & ~ends
                key_doc, key, times = distinct(doc[tail], h[tail])
                k, none = len(key), np.zeros(len(key))
                named = pa.chunked_array([batch.column("doc_id").slice(first, size), pa.nulls(k, batch.column("doc_id").type)]).combine_chunks()
                cols = [
                    np.concatenate([ids, ids[key_doc]]), named, np.concatenate([C.mix64(ids.astype(np.uint64)), key]).view(np.int64), np.concatenate([np.zeros(size, np.int64), times]),
                    np.concatenate([count, np.zeros(k, np.int64)]), np.concatenate([n_known, np.zeros(k, np.int64)]), np.concatenate([base, none]), np.concatenate([lbl, none]),
                ]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=["uid", "doc_id", "h", "times", "n_tokens", "n_known", "base", "lbl"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, fitted: tuple[Model, DataFrame] | None = None, **how) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row of ``docs``.

    Null text counts as empty: one token, the end.  Scores are log10 probabilities
    of the whole text; a word never seen has the probability of a count of zero
    (for ``score``, among the words of its surface).  Words are told apart by their
    surface and 56 bits of hash.  A text is never cut; of a very long one, memory
    holds about 150 bytes a word.  Without ``fitted`` a model is fitted on ``docs``.
    """
    model, counts = fitted or fit(docs, id_col, text_col, folds=folds, held_out=held_out, **how)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WORDS and HEAD bound its size
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("uid", F.monotonically_increasing_id())
    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = rows.mapInArrow(_partial(shared), f"uid long, doc_id {kind}, h long, times long, n_tokens long, n_known long, base double, lbl double")
    tail = counts.select(F.col("h").alias("h2"), "c")
    met = parts.join(tail, (parts.h == tail.h2) & (parts.times > 0), "left")
    log = F.when(F.col("times") > 0, F.log10(F.coalesce("c", F.lit(0)).cast("double") + 1) * F.col("times")).otherwise(F.lit(0.0))
    seen = F.when(F.col("c") > 0, F.col("times")).otherwise(F.lit(0))
    sums = met.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + seen).alias("n_known"),
        F.sum(F.col("base") + log).alias("base"), F.sum(F.col("lbl") + log).alias("lbl"),
    )
    per_token = math.log10(model.train_tokens + model.distinct + 1)
    return sums.select(
        "doc_id", (C.remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * per_token).alias("base_score"), F.col("lbl").alias("score"),
    )
