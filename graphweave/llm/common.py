"""Shared pieces: text expressions, word hashing in numpy, checkpoints, connected components."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, shared_dir, sweep

#: A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col):
    return F.translate(col, UPPER, LOWER)


def n_words(col):
    """Number of words; null text counts as empty."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(col, n: int):
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def smallest_hashes(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of their ids.

    A bound on the hash, from the number of rows, leaves about twice as many, so
    that not every partition sends ``most`` rows to the task that picks them.  The
    rows picked are the same with and without it.  ``rows`` are read up to three
    times.
    """
    h, total, room = F.xxhash64(id_col), rows.count(), 2 * most + 1000
    if total > room:
        near = rows.where(h <= F.lit(int(room / total * 2**64) - (1 << 63)))
        rows = near if near.count() >= most else rows
    return rows.orderBy(h, id_col).limit(most)


# ---------------------------------------------------------------- words in numpy

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Stands for the end of a text among word hashes.
END = np.uint64(0x5851F42D4C957F2D)


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def _raised(base: np.uint64, to: np.ndarray) -> np.ndarray:
    """base to the power of each number, from tables of a square root of the largest."""
    low = powers(base, 1 << 12)
    far = powers((low[-1:] * base)[0], int(to.max() >> 12) + 1)
    return low[to & 4095] * far[to >> 12]


def hash_runs(data: np.ndarray, lens: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each of the consecutive runs of data; lens are above zero.

    Sums over the bytes of a run, ``most`` bytes at a time, so that memory follows
    the number of runs, not of bytes.
    """
    at = np.cumsum(lens) - lens
    one, two = np.zeros(len(lens), np.uint64), np.zeros(len(lens), np.uint64)
    for a in range(0, len(data), most):
        b = min(a + most, len(data))
        i, j = np.searchsorted(at, a, "right") - 1, np.searchsorted(at, b)
        begin = np.maximum(at[i:j], a) - a
        inside = np.arange(a, b) - np.repeat(at[i:j], np.diff(np.append(begin, b - a)))
        wide = data[a:b].astype(np.uint64) + np.uint64(1)
        one[i:j] += np.add.reduceat(wide * _raised(_M1, inside), begin)
        two[i:j] += np.add.reduceat(wide * _raised(_M2, inside), begin)
    return mix64(one ^ mix64(two + lens.astype(np.uint64)))


def word_spans(joined: bytes, sizes: np.ndarray):
    """Of texts joined by line feeds: all bytes, and the start, the end and the text of each word."""
    data = np.frombuffer(joined, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    return data, starts, ends, np.searchsorted(first, starts, "right") - 1


def words_of(texts: list[bytes], ends: bool = False):
    """Lower-cased words of some texts: hash, and number of its text, of each word; with ``ends`` also a number for its
    last two bytes and whether it has up to 4, 8 or more of them."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data, starts, stops, doc = word_spans(b"\n".join(texts).lower(), sizes)
    lens = stops - starts
    h = hash_runs(data[~_SPACE[data]], lens)
    if not ends:
        return h, doc
    last = data[stops - 1].astype(np.int64)
    before = np.where(lens > 1, data[np.maximum(stops - 2, 0)], 0).astype(np.int64) if len(lens) else last
    return h, doc, (last << 16) | (before << 8) | np.minimum((lens - 1) // 4, 2)


#: Bytes of text of a slice where the arrays of its words take many times their bytes.
SLICE = 1 << 18


def chunks(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Slices of a batch with about so many bytes of text: (first row, texts in UTF-8; null is empty)."""
    col = batch.column(column).cast(pa.binary())
    texts, size, first = [], 0, 0
    for i, x in enumerate(col):
        texts.append(x.as_py() or b"")
        size += len(texts[-1]) + 64
        if size >= most:
            yield first, texts
            texts, size, first = [], 0, i + 1
    if texts:
        yield first, texts


@functools.cache
def _trim():
    """glibc's malloc_trim; None with another C library."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hand memory that nothing uses, of Arrow and of the C library, back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def lean(run):
    """``run``, a function of Arrow batches, that gives memory back after each batch and at its end.

    Workers outlive their tasks; what an idle one has kept would add to what the
    next stages take.
    """

    def over(batches):
        def each():
            for batch in batches:
                yield batch
                del batch
                give_back()

        yield from run(each())
        give_back()

    return over


# ---------------------------------------------------------------- connected components


def _settled(e: DataFrame) -> bool:
    """Whether the edges (u > v) are stars: every u has one v, and no v is a u."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(e.select("v", F.lit(0), F.lit(1)))
    odd = ends.groupBy("x").agg(F.sum("a").alias("a"), F.max("b").alias("b")).where("a > 1 or (a = 1 and b = 1)")
    return odd.agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges`` (u, v: long).

    Alternating large-star and small-star rounds: every round replaces edges by
    edges to the smallest neighbour, until only stars are left; the number of
    rounds grows with the logarithm of the longest path.  Each round is two
    aggregations with map-side combine and two joins whose hot keys Spark can
    split, and one table; nothing but a count comes to the driver.
    """
    e = cut(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for k in range(max_rounds + 1):
        if _settled(e):
            break
        if k == max_rounds:
            raise RuntimeError("components did not settle")
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
