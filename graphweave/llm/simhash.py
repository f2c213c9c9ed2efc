"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint is the bitwise majority of the XXH64 of its word shingles.
Every distinct fingerprint emits all variants within half the radius; two
fingerprints within the radius meet at some variant, and only there.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint of a text in UTF-8; zero if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    n = max(1, len(words) - width + 1)
    hash_of = xxhash.xxh64_intdigest
    pairs = zip(starts[:n].tolist(), ends[-n:].tolist())
    h = np.fromiter((hash_of(line[a:b], seed) for a, b in pairs), np.uint64, n)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = h[at : at + (1 << 15)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, mark, fp): the fingerprint of each row as a signed 64-bit integer; mark tells texts of one id apart.

    Null text counts as empty.
    """

    def run(batches):
        for batch in batches:
            got = [fingerprint(x.as_py() or b"", width, seed) for x in batch.column(2).cast(pa.binary())]
            fp = pa.array(np.array(got, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp], names=["doc_id", "mark", "fp"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return rows.mapInArrow(C.lean(run), "doc_id long, mark long, fp long")


def ball(radius: int) -> list[int]:
    """Masks of at most ``radius`` bits, as signed 64-bit integers."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Star edges (u, v) between distinct fingerprints (column fp) whose components are those of all links.

    All fingerprints that share a variant lie within ``radius`` of each other, if
    it is even; so each is linked with the smallest only, and a bucket holds no
    more than a ball of half the radius (65 for radius 2), however many texts
    there are.  For an odd radius the verification decides, pair by pair.
    """
    half = (radius + 1) // 2
    masks = F.array(*[F.lit(m).cast("long") for m in ball(half)])
    out = fps.select("fp", F.explode(masks).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("variant"), "fp")
    if radius % 2:
        pairs = out.alias("a").join(out.alias("b"), "variant").where("a.fp > b.fp").select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    else:
        pairs = out.select(F.col("fp").alias("u"), F.min("fp").over(W.partitionBy("variant")).alias("v")).where("u != v")
    return pairs.distinct().where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def components(rows: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, component, least): of each distinct fingerprint its component and its smallest doc_id.

    Equal fingerprints are one node, so groups of copies cost one row.
    """
    nodes = C.cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = C.connected_components(links(nodes.select("fp"), radius))
    return C.cut(nodes.join(found, nodes.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("component"), "least"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most
    ``radius`` differing bits.  Texts without words have fingerprint zero and link
    like any other.  A null doc_id keeps its row and never is the smallest, unless
    its component has no other (then component_id is null).
    """
    rows = C.cut(fingerprints(docs, id_col, text_col, width))
    found = components(rows, radius)
    smallest = found.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = C.cut(found.select("fp", "component").join(smallest, "component").select("fp", "component_id"))
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 3) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays.

    Rows without id come last; of rows with one id the one with the smallest mark
    stays, of equal rows one.  Texts are read whole, one at a time.
    """
    rows = C.cut(fingerprints(docs, id_col, text_col, width))
    found = components(rows, radius).select("fp", "component")
    return first_of_each(docs, rows.join(found, "fp").select("component", "doc_id", "mark"), id_col, text_col)


def first_of_each(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each component of ``rows`` (component, doc_id, mark) the row of ``docs`` that keep_one names."""
    last = F.lit((1 << 63) - 1)
    kept = rows.groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("id"), "mark")).alias("first"))
    kept = C.cut(kept.select(F.col("first.id").alias("_id"), F.col("first.mark").alias("_mark")))
    # Columns by position while internal ones are about, whatever their names are.
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    marked = docs.toDF(*at.values()).withColumn("_id0", F.coalesce(F.col(at[id_col]).cast("long"), last)).withColumn("_mark0", F.xxhash64(F.coalesce(F.col(at[text_col]), F.lit(""))))
    met = marked.join(kept, (F.col("_id0") == F.col("_id")) & (F.col("_mark0") == F.col("_mark")))
    met = met.withColumn("_nth", F.row_number().over(W.partitionBy("_id0", "_mark0").orderBy(F.lit(0))))
    return met.where("_nth = 1").select(*at.values()).toDF(*docs.columns)
