"""Line de-duplication by a range-partitioned sort of line hashes.

Lines travel as 128-bit hashes with document and position, never as text.  What
comes back is a compressed bitmap per document, one bit per line.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_EDGE = "part int, h1 long, h2 long, docs long, first_doc long, last_doc long, whole boolean"


def line_rows(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(h1, h2, doc, mark, pos) of the lines whose key has enough code points; mark tells texts of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(doc.alias("doc"), F.xxhash64(text).alias("mark"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    key = C.lower_ascii(F.trim(F.col("line"), F.lit(C.BLANKS)))
    rows = rows.select("doc", "mark", "pos", key.alias("key")).where(F.length("key") >= max(1, least_chars) if least_chars else F.lit(True))
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "mark", "pos")


def _runs(cols: list[np.ndarray]) -> np.ndarray:
    """Where a new value of the columns together begins."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return new


def _columns(batch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]


def _edges(batches):
    """Of a sorted partition: a row for its first and for its last hash, with how many documents hold it there."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    runs: list[list] = []  # [h1, h2, documents, first, last] of the first and of the latest hash
    for batch in batches:
        h1, h2, doc = _columns(batch)[:3]
        if not len(h1):
            continue
        at = np.flatnonzero(_runs([h1, h2]))
        fresh = _runs([h1, h2, doc])
        many = np.add.reduceat(fresh.astype(np.int64), at)
        stop = np.append(at[1:], len(h1)) - 1
        for i in sorted({0, len(at) - 1}):
            a, z = at[i], stop[i]
            run = [int(h1[a]), int(h2[a]), int(many[i]), int(doc[a]), int(doc[z])]
            if runs and runs[-1][:2] == run[:2]:
                runs[-1][2] += run[2] - (runs[-1][4] == run[3])
                runs[-1][4] = run[4]
            else:
                runs = runs[:1] + [run]
    out = [(part, *r, len(runs) == 1) for r in runs]
    names = ["part", "h1", "h2", "docs", "first_doc", "last_doc", "whole"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    cols = list(zip(*out)) if out else [[]] * 7
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _merged(edges: list) -> dict:
    """Documents of every hash that stands at an end of a partition; edges in order of partition."""
    total: dict = {}
    last: dict = {}
    for e in edges:
        k = (e.h1, e.h2)
        total[k] = total.get(k, 0) + e.docs - (last.get(k) == e.first_doc)
        last[k] = e.last_doc
    return total


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 10, least_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc, mark, bits): of each text that loses lines, the zlib-packed bits of the lines it keeps.

    Rows are range-partitioned by (hash, document, position), so that even a line
    found everywhere spreads over many partitions, and streamed in that order.  A
    hash that reaches over partitions is counted from two rows a partition.
    ``keep_first`` keeps the first occurrence of a line that goes elsewhere.
    """
    rows = line_rows(docs, id_col, text_col, least_chars)
    order = ["h1", "h2", "doc", "mark", "pos"]
    rows = C.cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    edges = sorted(rows.mapInArrow(C.lean(_edges), _EDGE).collect(), key=lambda e: e.part)  # two rows a partition
    total, first_of = _merged(edges), {}
    for e in edges:
        first_of.setdefault((e.h1, e.h2), e.part)

    def drop(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list = []  # rows of the latest hash while it may go on
        begun = None  # the latest hash, if some of its rows have been decided

        def decide(h1, h2, doc, mark, pos, last: bool):
            """Dropped rows; those of the latest hash stay held unless this is the end."""
            at = np.flatnonzero(_runs([h1, h2]))
            many = np.add.reduceat(_runs([h1, h2, doc]).astype(np.int64), at)
            for i in (0, len(at) - 1):
                many[i] = total.get((int(h1[at[i]]), int(h2[at[i]])), many[i])
            size = np.diff(np.append(at, len(h1)))
            gone = np.repeat(many >= least_docs, size)
            if keep_first:
                keys = [(int(h1[a]), int(h2[a])) for a in at]
                gone[at[[k != begun and first_of.get(k, part) == part for k in keys]]] = False
            stop = len(h1) if last else at[-1]
            return gone, stop

        for batch in batches:
            cols = _columns(batch)
            if not len(cols[0]):
                continue
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            h1, h2 = cols[0], cols[1]
            latest = (int(h1[-1]), int(h2[-1]))
            if latest in total:  # its count is known: no need to hold
                gone, stop = decide(*cols, True)
                held, begun = [], latest
            else:
                gone, stop = decide(*cols, False)
                held, begun = [c[stop:] for c in cols], None
            gone = gone[:stop]
            yield pa.RecordBatch.from_arrays([pa.array(c[:stop][gone]) for c in cols[2:]], names=["doc", "mark", "pos"])
        if held:
            gone, _ = decide(*held, True)
            yield pa.RecordBatch.from_arrays([pa.array(c[gone]) for c in held[2:]], names=["doc", "mark", "pos"])

    out = rows.mapInArrow(C.lean(drop), "doc long, mark long, pos int")
    return out.groupBy("doc", "mark").agg(F.collect_set("pos").alias("gone"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc, mark, bits): compressed keep bitmaps of the documents that lose lines; a set bit is a line that goes."""
    gone = dropped_lines(docs, id_col, text_col, **how)

    def pack(batches):
        for batch in batches:
            bits = [pack_bits(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], names=["doc", "mark", "bits"])

    return gone.mapInArrow(C.lean(pack), "doc long, mark long, bits binary")


def pack_bits(positions: list[int]) -> bytes:
    at = np.asarray(positions, np.int64)
    flags = np.zeros(int(at.max()) + 1 if len(at) else 0, np.uint8)
    flags[at] = 1
    return zlib.compress(np.packbits(flags, bitorder="little").tobytes(), 6)


def unpack_bits(bits: bytes | None, n: int) -> np.ndarray:
    """True for the lines that go."""
    gone = np.zeros(n, bool)
    if bits:
        flags = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), bitorder="little")[:n]
        gone[: len(flags)] = flags.astype(bool)
    return gone


def kept_text(text: str, bits: bytes | None) -> tuple[int, int, str]:
    """Lines before, lines dropped, and the kept lines joined by line feeds."""
    lines = text.split("\n")
    if not bits:
        return len(lines), 0, text
    gone = unpack_bits(bits, len(lines))
    return len(lines), int(gone.sum()), "\n".join([x for x, g in zip(lines, gone) if not g])


def _with_bits(docs: DataFrame, id_col: str, text_col: str, carry: list[str], **how) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    left = docs.select(doc.alias("_doc"), F.xxhash64(text).alias("_mark"), text.alias("_text"), *[F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)])
    bits = keep_bitmaps(docs, id_col, text_col, **how)
    return left.join(bits, (left._doc == bits.doc) & (left._mark == bits.mark), "left").drop("_doc", "_mark", "doc", "mark")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256), one row per row of ``docs``.

    Null or empty text is one empty line.  Rows with one doc_id count as one
    document when documents of a line are counted (rows without doc_id likewise).
    """

    def run(batches):
        for batch in batches:
            got = [kept_text(t.as_py(), b.as_py()) for t, b in zip(batch.column("_text"), batch.column("bits"))]
            cols = [batch.column("c_0"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([hashlib.sha256(g[2].encode()).hexdigest() for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return _with_bits(docs, id_col, text_col, [id_col], **how).mapInArrow(C.lean(run), f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without the lines that go; n_chars, if there, follows the text; null text becomes empty.

    ``docs`` has columns named doc_id and text; others stay as they are, whatever
    their names.  Equal rows stay as often as they are there; a text is held whole
    by one task, its lines go elsewhere as hashes only.
    """
    columns = docs.columns
    carry = [c for c in columns if c != "text"]
    schema = docs.select(carry).schema
    out_schema = ", ".join([*[f"`c_{i}` {f.dataType.simpleString()}" for i, f in enumerate(schema)], "_text string"])

    def run(batches):
        for batch in batches:
            got = [kept_text(t.as_py(), b.as_py())[2] for t, b in zip(batch.column("_text"), batch.column("bits"))]
            names = [f"c_{i}" for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(got, pa.string())], names=[*names, "_text"])

    rows = _with_bits(docs, "doc_id", "text", carry, **how).mapInArrow(C.lean(run), out_schema)
    named = {c: F.col(f"c_{i}") for i, c in enumerate(carry)} | {"text": F.col("_text")}
    if "n_chars" in named:
        named["n_chars"] = F.length("_text").cast("long")
    return rows.select(*[v.alias(k) for k, v in named.items()]).select(*columns)
