"""Model-backed steps behind small interfaces, each with a deterministic stand-in that needs no network."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import rules, text as T
from ledgerloom.operators import verify


class Embedder(Protocol):
    dim: int

    def embed(self, text: Column) -> Column: ...


class HashedWords:
    """Bag of hashed words with signs, unit length: texts that share words get similar vectors."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def vector(self, text: str | None, known: dict | None = None) -> np.ndarray:
        known = {} if known is None else known
        words = re.findall(r"\w+", (text or "").lower())
        for w in words:
            if w not in known:
                h = zlib.crc32(w.encode())
                known[w] = h % self.dim if h >> 31 else h % self.dim + self.dim
        n = np.bincount([known[w] for w in words], minlength=2 * self.dim)
        v = (n[: self.dim] - n[self.dim :]).astype(float)
        n = np.sqrt(v @ v)
        return v / n if n else v

    def embed(self, text: Column) -> Column:
        @F.pandas_udf("array<float>")
        def run(s: pd.Series) -> pd.Series:
            known: dict = {}
            return s.map(lambda t: self.vector(t, known).astype("float32"))

        return run(text)


class Reranker(Protocol):
    def score(self, query: Column, text: Column) -> Column: ...


class WordOverlap:
    """Share of the question's words found in the text."""

    def score(self, query: Column, text: Column) -> Column:
        return verify.overlap(query, text)


class Generator(Protocol):
    def answer(self, query: Column, prompt: Column, sources: Column) -> Column: ...


class Extractive:
    """Names the first source in a citation tag and quotes the first sentence of its text."""

    def answer(self, query: Column, prompt: Column, sources: Column) -> Column:
        s = F.element_at(sources, 1)
        quote = F.coalesce(F.get(T.sentences(s["text"]), F.lit(0)), F.lit(""))
        tag = F.format_string('<source ticker="%s" year="%s" chunk_id="%s">%s</source>', F.coalesce(s["ticker"], F.lit("Unknown")), F.coalesce(s["year"].cast("string"), F.lit("Unknown")), s["chunk_id"], quote)
        return F.when(F.size(sources) > 0, tag).otherwise(F.lit(rules.EMPTY_ANSWER))


class Remote:
    """Answers of a remote model: ``call`` takes the whole prompt. Calls are repeated on quota errors; questions without sources
    are not asked. ``call`` must be picklable and runs on the executors, one prompt after another."""

    def __init__(self, call: Callable[[str], str], attempts: int = 3, first_delay: float = 5.0):
        self.call = with_retry(call, attempts, first_delay)

    def answer(self, query: Column, prompt: Column, sources: Column) -> Column:
        call = self.call

        @F.pandas_udf("string")
        def run(prompts: pd.Series) -> pd.Series:
            return prompts.map(call, na_action="ignore")

        asked = F.size(sources) > 0
        return F.when(asked, run(F.when(asked, prompt))).otherwise(F.lit(rules.EMPTY_ANSWER))


class Captioner(Protocol):
    def caption(self, kind: Column, context: Column) -> Column: ...


class TitleCaption:
    def caption(self, kind: Column, context: Column) -> Column:
        return F.concat_ws(": ", kind, F.substring(F.coalesce(context, F.lit("no context")), 1, 200))


class Judge(Protocol):
    def reply(self, query: Column, answer: Column, context: Column) -> Column: ...


class NoJudge:
    """Replies nothing: alignment falls back to word overlap, facts to 0.5."""

    def reply(self, query: Column, answer: Column, context: Column) -> Column:
        return F.lit(None).cast("string")


def with_retry(call: Callable[[str], str], attempts: int = 3, first_delay: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """Repeats a call that fails for its quota (429, quota, rate limit), after the delay the error names plus one second or
    a doubling one; other errors pass at once."""

    def run(prompt: str) -> str:
        delay = first_delay
        for k in range(attempts):
            try:
                return call(prompt)
            except Exception as e:
                said = str(e).lower()
                if k + 1 == attempts or not any(x in said for x in ("429", "quota", "rate limit")):
                    raise
                named = re.search(r"retry in (\d+(?:\.\d+)?)\s*s", said)
                sleep(float(named.group(1)) + 1 if named else delay)
                delay *= 2
        raise RuntimeError("no attempt was made")

    return run
