"""Byte-level BPE: encoding with a priority queue of merge ranks, decoding by concatenation."""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Fixed value: the pattern that byte-level BPE vocabularies of this format split texts with.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts above so many characters are split piece by piece instead of into a list.
LONG = 1 << 20


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in such vocabularies: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of pieces already merged: two generations, so that memory stays bounded and frequent pieces stay."""

    def __init__(self, merge, most: int):
        super().__init__()
        self.merge, self.most, self.old = merge, most, {}

    def __missing__(self, piece):
        got = self.old.get(piece)
        if got is None:
            got = self.merge(piece.encode())
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


class Bpe:
    """Vocabulary and merges of a tokenizer file, as the driver has read them."""

    def __init__(self, path: str, most_cached: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a byte-level BPE vocabulary without normaliser")
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab = model["vocab"]
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(vocab[a] << 20) | vocab[b]: r for r, (a, b) in reversed(list(enumerate(merges)))}
        self.made = [vocab[a + b] for a, b in merges]
        self.strings = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.most_cached = most_cached
        self._start()

    def _start(self):
        self.find = regex.compile(SPLIT)
        longest = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.pieces = _Pieces(self.merge, self.most_cached)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "split", "pieces")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._start()

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece.  The queue holds (rank, position); an entry whose symbols have changed since is stale."""
        ids = [self.byte_ids[b] for b in piece]
        n, ranks, made = len(ids), self.ranks, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            r = ranks.get((ids[i] << 20) | ids[i + 1])
            if r is not None:
                queue.append((r, i))
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n or ranks.get((ids[i] << 20) | ids[j]) != r:
                continue
            ids[i], ids[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = ranks.get((ids[i] << 20) | ids[k])
                if r is not None:
                    heapq.heappush(queue, (r, i))
            h = before[i]
            if h >= 0:
                r = ranks.get((ids[h] << 20) | ids[i])
                if r is not None:
                    heapq.heappush(queue, (r, h))
        return tuple([x for x in ids if x >= 0])

    def encode(self, text: str) -> array:
        """Ids of a text; strings of special tokens in it are those tokens."""
        if not self.special or not any(s in text for s in self.special):
            return self._plain(text)
        out = array("I")
        for i, part in enumerate(self.split.split(text)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                out.extend(self._plain(part))
        return out

    def _plain(self, text: str) -> array:
        found = self.find.findall(text) if len(text) < LONG else (m.group() for m in self.find.finditer(text))
        return array("I", chain.from_iterable(map(self.pieces.__getitem__, found)))

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def little_endian(ids: array) -> bytes:
    if array("I", [1]).tobytes() != b"\1\0\0\0":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each row's whole text; null text has none."""
    model = docs.sparkSession.sparkContext.broadcast(Bpe(path))  # as large as the vocabulary file

    def run(batches):
        bpe = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(x.as_py() or "") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([i.tolist() for i in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(C.lean(run), f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with the decoded text of ``ids_col`` in ``decoded``; null ids give null."""
    model = rows.sparkSession.sparkContext.broadcast(Bpe(path))

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        bpe = model.value
        return pd.Series([None if x is None else bpe.decode([int(i) for i in x]) for x in ids], dtype=object)

    return rows.withColumn("decoded", text(ids_col))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again, in one pass.

    ``with_ids`` adds the ids themselves.  Null text counts as empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(Bpe(path))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches):
        bpe = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, ids_sha, text_sha, flat = [], [], [], array("I")
                for x in part.column(1):
                    ids = bpe.encode(x.as_py() or "")
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(little_endian(ids)).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                    if with_ids:
                        flat.extend(ids)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(flat, np.uint32).astype(np.int32) if len(flat) else np.zeros(0, np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(C.lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
