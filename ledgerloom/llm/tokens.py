"""Token ids of whole texts by a public byte-level BPE vocabulary, with forced boundaries.

A text is cut into pretokens by the vocabulary's pattern. Inside a pretoken, a pair of neighbouring bytes that occurs inside
no token of the vocabulary marks a certain cut: no merge can ever cross it. The fragments between such cuts are encoded
independently, remembered, and their ids put together, so a long run without blanks costs no more than its parts.
Fragments are merged with a heap, in n log n steps however long they are.

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary text; equal
texts give equal ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter everywhere below.
VOCABULARIES = os.environ.get("LEDGERLOOM_TOKENIZERS", "/opt/tokenizers")
#: The pattern that byte-level vocabularies of this family cut text with before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """A vocabulary of ranks: base64 token and rank on each line."""

    def __init__(self, ranks: bytes):
        import regex

        self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines()) if t}
        self.joined = np.zeros((256, 256), bool)
        for token in self.ranks:
            if len(token) > 1:
                b = np.frombuffer(token, np.uint8)
                self.joined[b[:-1], b[1:]] = True
        self.find = regex.compile(PATTERN).findall
        outer = self

        class Pretokens(dict):
            def __missing__(self, piece: str) -> tuple[int, ...]:
                ids = tuple(outer.piece(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= 64:
                    if len(self) > 400_000:
                        self.clear()
                    self[piece] = ids
                return ids

        self.known = Pretokens()
        self.fragments: dict[bytes, list[int]] = {}

    def cuts(self, raw: bytes) -> list[int]:
        """Where certain cuts lie: before each byte that never follows its neighbour inside a token."""
        b = np.frombuffer(raw, np.uint8)
        return (np.flatnonzero(~self.joined[b[:-1], b[1:]]) + 1).tolist()

    def piece(self, raw: bytes) -> list[int]:
        if (rank := self.ranks.get(raw)) is not None:
            return [rank]
        ids: list[int] = []
        at = 0
        for end in [*self.cuts(raw), len(raw)]:
            part, at = raw[at:end], end
            if (got := self.fragments.get(part)) is None:
                got = self._merge(part)
                if len(part) <= 64:
                    if len(self.fragments) > 200_000:
                        self.fragments.clear()
                    self.fragments[part] = got
            ids += got
        return ids

    def _merge(self, raw: bytes) -> list[int]:
        """Always the pair of lowest rank, leftmost first."""
        ranks = self.ranks
        if (rank := ranks.get(raw)) is not None:
            return [rank]
        n = len(raw)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part begins at its index; 0 as end: merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(raw[before[i] : stop])) is not None:
                heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.find(text)))) if text else []


_ENCODERS: dict[int, Encoder] = {}


def _encoder(ranks: bytes) -> Encoder:
    """One encoder per vocabulary and Python worker: it outlives the task, with the pieces it remembers."""
    import xxhash

    key = xxhash.xxh3_128_intdigest(ranks)
    if key not in _ENCODERS:
        if len(_ENCODERS) > 3:
            _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks)
    return _ENCODERS[key]


def _vocabulary(spark: SparkSession, path: str):
    """The file's bytes as a broadcast: its size is that of one vocabulary, checked here."""
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) > 64 << 20:
        raise ValueError(f"{path} is no vocabulary: over 64 MB")
    return spark.sparkContext.broadcast(raw)


def encode(df: DataFrame, id_col: str, text_col: str, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES, count_only: bool = False) -> DataFrame:
    """``id_col`` and ids (array<int>), or n_tokens with ``count_only``, for every row. Narrow: no shuffle; one vocabulary
    per Python worker, reused across batches."""
    spark = df.sparkSession
    held = _vocabulary(spark, os.path.join(folder, vocabulary + ".tiktoken"))
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(held.value)
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, batch.num_rows, 500):
                part = [enc.encode(t) for t in texts.slice(lo, 500).to_pylist()]
                sizes = np.fromiter(map(len, part), np.int32, len(part))
                ids = batch.column(0).slice(lo, 500)
                if count_only:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(sizes)], names=["id", "n_tokens"])
                    continue
                values = np.fromiter(chain.from_iterable(part), np.int32, int(sizes.sum()))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "ids"])

    out = src.mapInArrow(run, f"id {kind}, n_tokens int" if count_only else f"id {kind}, ids array<int>")
    return out if id_col in ("ids", "n_tokens") else out.withColumnRenamed("id", id_col)
