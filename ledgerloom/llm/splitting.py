"""Splitting oversized texts at natural boundaries (structure-tree packing).

A text is parsed into a tree: headings open nodes of their depth (numbers of # or =, heading elements, parts over items over
notes), lists nest by indent; below lie paragraphs, lines, sentences, clauses and words. Sibling subtrees are merged
bottom-up while they fit; only nodes over the limit are opened, and what an opened node leaves over is never merged with
anything outside of it. Each piece but the first repeats the last words of the piece before it.

Defined results: a null, empty or blank text, and a text within the limits, yields no piece (one whole piece with
``keep_whole=True``); repeated rows are split independently; an empty table gives an empty result with the same columns;
columns of the input other than the id and the text never reach the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_WORDS, MAX_BYTES, OVERLAP = 400, 16_384, 80

_WORD = re.compile(r"[^ \t\r\n]+")
_HEADING = re.compile(r"(#{1,6})[ \t]|(={2,6})[ \t]*[^=\s]|<h([1-6])\b|(?:(part|chapter)|(item|article)|(note|section))\s+[0-9ivxlc]+[a-z]?\b", re.I)
_BULLET = re.compile(r"(?:[-*+•–·]|\(?[0-9]{1,3}[.)]|\(?[a-zA-Z][.)]|\||<(?:li|tr|dt|dd)\b[^<>]*>?)(?=\s|[^<]*$|<)", re.I)
_BLOCK_TAG = re.compile(r"<(?:p|div|table|ul|ol|dl|blockquote|pre)\b", re.I)
_SENTENCE_END = re.compile(r"[.!?。！？…][\"'”’»)\]]*$")
_CLAUSE_END = re.compile(r"[,;:][\"'”’»)\]]*$")

#: Levels of the tree, outermost first: headings of depth 1 to 6 are 1 to 6; items of deeper lists lie between ITEM and LINE.
PARAGRAPH, ITEM, DEEPEST, LINE, SENTENCE, CLAUSE, WORD = 10, 11, 30, 31, 32, 33, 34
#: A heading's line is a short one; longer lines that begin like one are prose.
HEADING_CHARS = 200


def _depth(m: re.Match) -> int:
    marks, equals, element, part, item, _ = m.groups()
    if marks or equals:
        return len(marks or equals)
    return int(element) if element else 1 if part else 2 if item else 3


class _Doc:
    """Word spans of a text, the byte offset of each word, and the level of the gap before each word."""

    def __init__(self, text: str):
        self.text = text
        self.spans = [m.span() for m in _WORD.finditer(text)]
        ascii_only = text.isascii()
        self.byte_at: list[tuple[int, int]] = []
        at = pos = 0
        for s, e in self.spans:
            if ascii_only:
                self.byte_at.append((s, e))
                continue
            at += len(text[pos:s].encode("utf-8", "surrogatepass"))
            b = at + len(text[s:e].encode("utf-8", "surrogatepass"))
            self.byte_at.append((at, b))
            at, pos = b, e

    def size(self, s: int, e: int) -> int:
        return self.byte_at[e - 1][1] - self.byte_at[s][0] if e > s else 0

    def levels(self) -> list[int]:
        """What the gap before each word separates. The gap behind a heading's line binds like one between words, so a
        heading stays with what it heads."""
        out = [0] * len(self.spans)
        below_heading = self._heading(0) is not None if self.spans else False
        for i in range(1, len(self.spans)):
            (_, before), (start, _) = self.spans[i - 1], self.spans[i]
            sep = self.text[before:start]
            if "\n" in sep or "\r" in sep:
                heading = self._heading(i)
                if heading is not None:
                    out[i] = heading
                elif below_heading:
                    out[i] = WORD
                else:
                    out[i] = self._break(sep, start)
                below_heading = heading is not None
            else:
                word = self.text[self.spans[i - 1][0] : before]
                out[i] = SENTENCE if _SENTENCE_END.search(word) else CLAUSE if _CLAUSE_END.search(word) else WORD
        return out

    def _heading(self, i: int) -> int | None:
        start = self.spans[i][0]
        m = _HEADING.match(self.text, start)
        if not m:
            return None
        ends = [e for e in (self.text.find("\n", start), self.text.find("\r", start)) if e >= 0]
        return _depth(m) if min(ends, default=len(self.text)) - start <= HEADING_CHARS else None

    def _break(self, sep: str, start: int) -> int:
        if sep.replace("\r\n", "\n").replace("\r", "\n").count("\n") > 1 or _BLOCK_TAG.match(self.text, start):
            return PARAGRAPH
        if _BULLET.match(self.text, start):
            indent = len(re.split(r"[\r\n]", sep)[-1].expandtabs(4))
            return min(ITEM + indent // 2, DEEPEST)
        return LINE


def _pack(doc: _Doc, levels: list[int], s: int, e: int, words: int, size: int, first: tuple[int, int]) -> list[tuple[int, int]]:
    """Ranges of words that cover [s, e), each within ``words`` and ``size`` unless it is one word; a range from the first
    word on, which repeats nothing, within ``first``.

    Children of a node are the parts between gaps of the outermost level inside it. Children that fit are merged left to
    right while they fit; a child that does not is opened, and its ranges stay as they are."""

    def fits(a: int, b: int) -> bool:
        most, room = first if a == 0 else (words, size)
        return b - a <= most and doc.size(a, b) <= room

    if fits(s, e) or e - s == 1:
        return [(s, e)]
    top = min(levels[s + 1 : e])
    cuts = [s, *(i for i in range(s + 1, e) if levels[i] == top), e]
    out: list[tuple[int, int]] = []
    whole = False  # the last range is made of whole children
    for a, b in zip(cuts, cuts[1:]):
        if not fits(a, b) and b - a > 1:
            out += _pack(doc, levels, a, b, words, size, first)
            whole = False
        elif whole and fits(out[-1][0], b):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
            whole = True
    return out


def _cut(text: str, at: int, end: int, max_bytes: int) -> Iterator[tuple[int, int, str]]:
    """text[at:end] between characters, at most ``max_bytes`` each."""
    while at < end:
        to, used = at, 0
        while to < end and used + (k := len(text[to].encode("utf-8", "surrogatepass"))) <= max_bytes:
            used, to = used + k, to + 1
        yield at, to, text[at:to]
        at = to


def split_text(text: str | None, max_words: int = MAX_WORDS, max_bytes: int = MAX_BYTES, overlap: int = OVERLAP) -> list[tuple]:
    """Pieces as (start_token, end_token, start_char, end_char, text); tokens are words, ends exclusive.

    Neighbours share ``overlap`` words, or as many of them as fit beside the new words. A word longer than the byte limit
    is cut between characters; its pieces share nothing and name the same token. So is a text of blanks only beyond the byte
    limit, whose pieces name no token (0, 0); a shorter one has no pieces."""
    if not 0 <= overlap < max_words or max_bytes < 8:
        raise ValueError("overlap must be below max_words, max_bytes at least 8")
    doc = _Doc(text or "")
    n = len(doc.spans)
    if not n:
        whole = text or ""
        return [(0, 0, *cut) for cut in _cut(whole, 0, len(whole), max_bytes)] if len(whole.encode("utf-8", "surrogatepass")) > max_bytes else []
    if n <= max_words and len(text.encode("utf-8", "surrogatepass")) <= max_bytes:
        return [(0, n, 0, len(text), text)]
    room = max_bytes - max_bytes // 4 if overlap else max_bytes
    out = []
    for s, e in _pack(doc, doc.levels(), 0, n, max_words - overlap, room, (max_words, max_bytes)):
        (c, _), (_, d) = doc.spans[s], doc.spans[e - 1]
        if doc.size(s, e) > max_bytes:  # one word
            out += [(s, e, *cut) for cut in _cut(text, c, d, max_bytes)]
            continue
        o = s
        while out and o > 0 and s - o < overlap and doc.size(o - 1, e) <= max_bytes:
            o -= 1
        out.append((o, e, doc.spans[o][0], d, text[doc.spans[o][0] : d]))
    return out


def _piece_fields(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField("id", id_type)]
        + [T.StructField(c, T.IntegerType()) for c in ("piece_no", "n_pieces", "start_token", "end_token", "start_char", "end_char", "n_bytes")]
        + [T.StructField("text", T.StringType())]
    )


def is_oversized(text, max_words: int = MAX_WORDS, max_bytes: int = MAX_BYTES):
    """Column: the text has more words or UTF-8 bytes than allowed. The words are counted only where the length makes
    an excess possible at all."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce((F.octet_length(text) > max_bytes) | ((F.length(text) > 2 * max_words) & (F.regexp_count(text, F.lit(r"[^ \t\r\n]+")) > max_words)), F.lit(False))


def split_oversized(df: DataFrame, id_col: str, text_col: str, max_words: int = MAX_WORDS, max_bytes: int = MAX_BYTES, overlap: int = OVERLAP, keep_whole: bool = False) -> DataFrame:
    """One row per piece: ``id_col``, piece_no, n_pieces, start_token, end_token, start_char, end_char, n_bytes, text.

    Narrow: no shuffle; texts within the limits never leave the JVM unless ``keep_whole``. If the id column is named as
    one of the result's columns it comes out as ``id``."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    src = src.filter(F.col("text").isNotNull()) if keep_whole else src.filter(is_oversized("text", max_words, max_bytes))
    schema = _piece_fields(src.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                pieces = split_text(text, max_words, max_bytes, overlap)
                ids += [k] * len(pieces)
                rows += [(i, len(pieces), *p[:4], len(p[4].encode("utf-8", "surrogatepass")), p[4]) for i, p in enumerate(pieces)]
            cols = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, pa.int32()) for c in cols[:7]), pa.array(cols[7], pa.string())], names=schema.names)

    out = src.mapInArrow(run, schema)
    return out if id_col in schema.names else out.withColumnRenamed("id", id_col)
