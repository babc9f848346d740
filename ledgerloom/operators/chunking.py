"""Overlapping sentence chunks with a byte limit.

Sentences and their token counts are made in Catalyst as arrays; one fold per document turns them into chunks. A document
is one row, so there is no shuffle; documents stream through Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ledgerloom.functions import rules, text as T

_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def fold(sentences: list[str], tokens: list[int], size: int, budget: int) -> list[tuple[str, int]]:
    """(text, tokens) of each chunk. A chunk is closed when the next sentence would exceed ``size``; the next one starts with
    the longest run of whole last sentences that fits ``budget``. A sentence over ``size`` stays whole."""
    out: list[tuple[str, int]] = []
    buf: list[tuple[str, int]] = []
    total = 0
    for s, n in zip(sentences, tokens):
        if buf and total + n > size:
            out.append((" ".join(x for x, _ in buf), total))
            kept, room = len(buf), budget
            while kept and buf[kept - 1][1] <= room:
                kept -= 1
                room -= buf[kept][1]
            buf, total = buf[kept:], budget - room
        buf.append((s, n))
        total += n
    if buf:
        out.append((" ".join(x for x, _ in buf), total))
    return out


def split_bytes(text: str, limit: int) -> list[str]:
    """Parts of at most ``limit`` UTF-8 bytes, cut at sentences and, in a sentence that is too large, at words. A single
    larger word stays whole."""
    parts: list[str] = []

    def pack(items: list[str], deeper: Callable | None) -> None:
        held: list[str] = []
        size = 0
        for item in items:
            n = len(item.encode("utf-8", "surrogatepass"))
            if held and size + 1 + n > limit:
                parts.append(" ".join(held))
                held, size = [], 0
            if n > limit and deeper:
                if held:
                    parts.append(" ".join(held))
                    held, size = [], 0
                deeper(item)
                continue
            size += n + (1 if held else 0)
            held.append(item)
        if held:
            parts.append(" ".join(held))

    pack([s for s in _SENTENCE.split(text) if s.strip()], lambda s: pack(s.split(), None))
    return parts


def metadata_bytes(row: dict) -> int:
    """Size of the stored metadata as JSON, years as text."""
    names = ("doc_id", "ticker", "filing_type", "accession_number", "year", "start_token", "end_token")
    return len(json.dumps({k: str(row[k]) if k == "year" and row[k] is not None else row[k] for k in names if k in row}, default=str).encode())


@F.pandas_udf(IntegerType())
def metadata_size(rows: pd.DataFrame) -> pd.Series:
    """``metadata_bytes`` of a struct of metadata columns."""
    plain = rows.astype(object).where(rows.notna(), None)
    whole = lambda k, v: int(v) if k in ("year", "start_token", "end_token") and v is not None else v
    return pd.Series([metadata_bytes({k: whole(k, v) for k, v in row.items()}) for row in plain.to_dict("records")], dtype="int32")


def long_enough(df: DataFrame, text_col: str) -> DataFrame:
    """Rows whose stripped text has the characters a document must have to be chunked."""
    return df.filter(F.length(T.strip(text_col)) >= rules.MIN_CHUNK_LENGTH)


def chunk_documents(
    df: DataFrame,
    doc_col: str,
    text_col: str,
    size: int = rules.CHUNK_TOKENS,
    overlap: float = rules.CHUNK_OVERLAP,
    max_bytes: int = rules.MAX_CHUNK_BYTES,
    metadata: tuple[str, ...] = (),
    counter: Callable[[Column], Column] = T.token_count,
    keep_bad: bool = False,
) -> DataFrame:
    """doc_id, chunk_id, start_token, end_token, text and the named metadata columns. Documents of fewer than 50 stripped
    characters yield nothing; ids are given before the quality filter, so they may have gaps."""
    src = df.select(F.col(doc_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(m) for m in metadata])
    src = long_enough(src, "text").withColumn("s", T.sentences("text"))
    src = src.select("doc_id", "s", F.transform("s", lambda x: counter(x)).alias("n"), F.to_json(F.struct(F.lit(0).alias("_"), *metadata)).alias("meta"))
    budget = int(size * overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, ss, ns, meta in zip(*(c.to_pylist() for c in batch.columns)):
                info = json.loads(meta)
                info.pop("_")
                number = 0
                for text, n in fold(ss, ns, size, budget):
                    base = f"{doc}_chunk_{number}"
                    used = metadata_bytes({"doc_id": doc, "start_token": 0, "end_token": n, **info})
                    if len(text.encode("utf-8", "surrogatepass")) + used > max_bytes:
                        parts = split_bytes(text, max(max_bytes - used, 1))
                        rows += [(doc, f"{base}_split_{i}", 0, 0, p, meta) for i, p in enumerate(parts)]
                        number += len(parts)
                    else:
                        rows.append((doc, base, 0, n, text, meta))
                        number += 1
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "chunk_id", "start_token", "end_token", "text", "meta"])

    out = src.mapInArrow(run, "doc_id string, chunk_id string, start_token int, end_token int, text string, meta string")
    if metadata:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*metadata).schema)
        out = out.withColumn("m", F.from_json("meta", kinds)).select("doc_id", "chunk_id", "start_token", "end_token", "text", *[F.col(f"m.{m}").alias(m) for m in metadata if m != "doc_id"])
    else:
        out = out.drop("meta")
    return out if keep_bad else out.filter(T.is_good_chunk("text"))
