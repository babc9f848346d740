"""Top-k retrieval: exact, filtered, batched, partitioned and by cells (IVF)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import rules
from ledgerloom.runtime import materialize

#: Queries that travel to every task at once: 4,096 vectors of 1,024 numbers are 16 MB.
QUERY_BLOCK = 4096


def matches(filters: dict | None) -> Column:
    """All filters hold; a null value never equals one. Years compare as numbers, whatever type the column has."""
    conds = [F.col(k).try_cast("int") == int(v) if k == "year" else F.col(k) == F.lit(v) for k, v in (filters or {}).items()]
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def cosine(vector: Column, query: list[float]) -> Column:
    """By NumPy on Arrow batches; a null or all-zero vector, or one of another length, scores 0."""
    q = np.asarray(query, np.float64)
    q = q / (math.sqrt(float(q @ q)) or 1.0)

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        out = np.zeros(len(v))
        at = [i for i, x in enumerate(v) if x is not None and len(x) == len(q)]
        if at:
            m = np.stack([np.asarray(v.iloc[i], np.float64) for i in at])
            n = np.sqrt((m * m).sum(1))
            out[at] = m @ q / np.where(n > 0, n, 1)
        return pd.Series(out)

    return run(vector)


def top_k(df: DataFrame, id_col: str, vector_col: str, query: list[float], k: int = rules.TOP_K, filters: dict | None = None) -> DataFrame:
    """The k most similar rows that satisfy ``filters``: filtered before the search, so never fewer than there are. The
    filter reaches the scan; the limit is taken per task and merged."""
    return df.filter(matches(filters)).withColumn("score", cosine(F.col(vector_col), query)).orderBy(F.desc("score"), id_col).limit(k or rules.TOP_K)


def _query_matrix(rows: list) -> tuple[list, np.ndarray]:
    m = np.array([r[1] for r in rows], np.float64)
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return [r[0] for r in rows], m / np.where(n > 0, n, 1)


def top_k_batch(df: DataFrame, id_col: str, vector_col: str, queries: DataFrame, q_id: str, q_vector: str, k: int = rules.TOP_K, on: list[str] | None = None) -> DataFrame:
    """q_id, id, score, rank of a batch of questions against all rows.

    Any number of questions: they are fetched in blocks of at most QUERY_BLOCK, and each block is multiplied with every Arrow
    batch of the corpus; a task keeps only its k best per question, so what is shuffled is tasks x questions x k rows, not
    corpus x questions. ``on`` names columns (metadata) in which a question's value, where not null, must equal the row's."""
    on = on or []
    kinds = (queries.schema[q_id].dataType.simpleString(), df.schema[id_col].dataType.simpleString())
    asked = queries.select(F.col(q_id), F.col(q_vector).cast("array<double>"), *on)
    parts = [_top_k_block(df, id_col, vector_col, list(rows), kinds, k, on) for rows in batched(asked.toLocalIterator(), QUERY_BLOCK)]
    return reduce(DataFrame.unionByName, parts) if parts else queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, score double, rank int")


def _top_k_block(df: DataFrame, id_col: str, vector_col: str, rows: list, kinds: tuple[str, str], k: int, on: list[str]) -> DataFrame:
    qid, matrix = _query_matrix(rows)
    want = [[r[2 + i] for r in rows] for i in range(len(on))]
    src = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), *on).filter("v is not null")

    free = [q for q in range(len(qid)) if all(w[q] is None for w in want)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_i: list[list] = [[] for _ in qid]

        def keep(q: int, s: np.ndarray, rows: np.ndarray | None, ids: list) -> None:
            top = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
            best_i[q] = sorted([*best_i[q], *((-s[j], ids[j if rows is None else rows[j]]) for j in top)])[:k]

        for batch in batches:
            if not batch.num_rows or not qid:
                continue
            v = batch.column(1)
            m = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            n = np.sqrt((m * m).sum(1, keepdims=True))
            m /= np.where(n > 0, n, 1)
            ids = batch.column(0).to_pylist()
            if free:
                sims = matrix[free] @ m.T
                for i, q in enumerate(free):
                    keep(q, sims[i], None, ids)
            where: list[dict] = []  # of each column: value -> rows of the batch
            for c in range(len(on)):
                at: dict = {}
                for r, x in enumerate(batch.column(2 + c).to_pylist()):
                    at.setdefault(x, []).append(r)
                where.append({x: np.array(r) for x, r in at.items() if x is not None})
            none = np.array([], int)
            for q in range(len(qid)):
                parts = [where[c].get(w[q], none) for c, w in enumerate(want) if w[q] is not None]
                if parts:
                    rows = reduce(lambda x, y: np.intersect1d(x, y, assume_unique=True), parts)
                    if len(rows):
                        keep(q, m[rows] @ matrix[q], rows, ids)
        out = [(qid[q], i, -s) for q, found in enumerate(best_i) for s, i in found]
        yield pa.RecordBatch.from_pylist([{"q": a, "id": b, "score": float(c)} for a, b, c in out], schema=pa.schema([("q", _arrow(kinds[0])), ("id", _arrow(kinds[1])), ("score", pa.float64())]))

    scored = src.mapInArrow(run, f"q {kinds[0]}, id {kinds[1]}, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("q").alias("query_id"), "id", "score", "rank")


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]


def top_k_per_partition(df: DataFrame, keys: list[str], id_col: str, vector_col: str, query: list[float], k: int) -> DataFrame:
    """The k best of each partition (ticker, year ...): a window with a group limit on both sides of the shuffle."""
    d = df.withColumn("score", cosine(F.col(vector_col), query))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), id_col))).filter(F.col("rank") <= k)


def merge_partitions(per_part: DataFrame, id_col: str, k: int) -> DataFrame:
    return per_part.orderBy(F.desc("score"), id_col).limit(k)


class CellIndex:
    """Vectors by nearest of ``cells`` centroids. Centroids are fitted on a bounded sample (documented bound
    ``sample`` rows); every vector is assigned to its cell. A search reads the ``probes`` nearest cells first, then every other
    cell whose widest angle (``reach``) leaves room for a score at least as good as the k-th found so far, so the result is
    that of brute force; how much is skipped depends on how well the vectors cluster."""

    def __init__(self, df: DataFrame, id_col: str, vector_col: str, cells: int | None = None, probes: int = rules.IVF_PROBES, sample: int = 50_000, seed: int = 11):
        n = df.count()
        self.id_col, self.vector_col, self.probes = id_col, vector_col, probes
        self.cells = cells or max(1, min(rules.IVF_MAX_CELLS, int(math.sqrt(n))))
        picked = df.select(id_col, vector_col).filter(F.col(vector_col).isNotNull())
        if n > sample:
            picked = picked.orderBy(F.xxhash64(F.col(id_col), F.lit(seed))).limit(sample)
        rows = sorted(picked.collect(), key=lambda r: r[0])
        m = np.array([r[1] for r in rows], np.float64)
        m /= np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-30)
        rng = np.random.default_rng(seed)
        c = m[rng.choice(len(m), min(self.cells, len(m)), replace=False)]
        for _ in range(15):
            near = (m @ c.T).argmax(1)
            for j in range(len(c)):
                if (near == j).any():
                    c[j] = m[near == j].mean(0)
            c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-30)
        self.centroids = c
        # each cell is a partition on disk: a search reads the folders of its cells only
        assigned = materialize(self._assign(df).hint("rebalance", F.col("cell")), "cells", ("cell",))
        self.reach = np.full(len(c), -np.inf)  # of a cell without rows
        for r in assigned.groupBy("cell").agg(F.min("cell_cosine").alias("least")).collect():
            self.reach[r.cell] = math.acos(min(1.0, max(-1.0, r.least)))
        self.table = assigned.drop("cell_cosine")

    def _assign(self, df: DataFrame) -> DataFrame:
        """A vector of zeros has cosine 0 to everything: it counts as at a right angle to its centroid."""
        c, col = self.centroids, self.vector_col

        @F.pandas_udf("cell int, cosine double")
        def nearest(v):
            if not len(v):
                return pd.DataFrame({"cell": np.array([], "int32"), "cosine": np.array([], "float64")})
            m = np.stack([np.asarray(x, np.float64) for x in v])
            s = m @ c.T
            return pd.DataFrame({"cell": s.argmax(1).astype("int32"), "cosine": s.max(1) / np.maximum(np.sqrt((m * m).sum(1)), 1e-30)})

        found = df.filter(F.col(col).isNotNull()).withColumn("nearest", nearest(F.col(col)))
        return found.select(*df.columns, F.col("nearest.cell").alias("cell"), F.col("nearest.cosine").alias("cell_cosine"))

    def _open(self, near: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Cells (columns) that can hold a score of ``least`` or more; near: cosines of questions (rows) and centroids."""
        best = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - np.maximum(self.reach, 0), 0))
        return (best >= least[:, None] - 1e-6) & (self.reach >= 0)

    def _first(self, near: np.ndarray) -> np.ndarray:
        mask = np.zeros(near.shape, bool)
        np.put_along_axis(mask, np.argsort(-near, axis=1)[:, : self.probes], True, axis=1)
        return mask

    def _of(self, mask: np.ndarray) -> DataFrame:
        return self.table.filter(F.col("cell").isin(*[int(x) for x in np.flatnonzero(mask.any(0))]))

    def search(self, query: list[float], k: int = rules.TOP_K, filters: dict | None = None) -> DataFrame:
        k = k or rules.TOP_K
        _, q = _query_matrix([(0, query)])
        near = q @ self.centroids.T
        first = self._first(near)
        found = top_k(self._of(first), self.id_col, self.vector_col, query, k, filters).agg(F.count(F.lit(1)), F.min("score")).first()
        least = np.array([found[1] if found[0] == k else -np.inf])
        return top_k(self._of(first | self._open(near, least)), self.id_col, self.vector_col, query, k, filters)

    def search_batch(self, queries: DataFrame, q_id: str, q_vector: str, k: int = rules.TOP_K, filters: dict | None = None) -> DataFrame:
        """query_id, id, cell, score, rank of any number of questions with unique ids, in blocks of QUERY_BLOCK: the nearest
        cells, then those the k-th score of a question does not exclude."""
        asked = queries.select(F.col(q_id), F.col(q_vector).cast("array<double>")).filter(F.col(q_vector).isNotNull())
        kinds = (queries.schema[q_id].dataType.simpleString(), self.table.schema[self.id_col].dataType.simpleString())
        parts = []
        for block in batched(asked.toLocalIterator(), QUERY_BLOCK):
            qid, matrix = _query_matrix(list(block))
            near = matrix @ self.centroids.T
            first = self._first(near)
            found = materialize(self._best(qid, matrix, first, kinds, k, filters), "cells-first")
            kth = {r.query_id: r.score for r in found.filter(F.col("rank") == k).select("query_id", "score").collect()}
            rest = self._open(near, np.array([kth.get(q, -np.inf) for q in qid])) & ~first
            parts += [found, self._best(qid, matrix, rest, kinds, k, filters)] if rest.any() else [found]
        if not parts:
            return queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, cell int, score double, rank int")
        return self._ranked(reduce(DataFrame.unionByName, parts).drop("rank"), k)

    @staticmethod
    def _ranked(df: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def _best(self, qid: list, matrix: np.ndarray, mask: np.ndarray, kinds: tuple[str, str], k: int, filters: dict | None) -> DataFrame:
        """The k best per question in the cells its row of ``mask`` names; a task keeps only its k best."""
        src = self._of(mask).filter(matches(filters)).select(F.col(self.id_col), F.col(self.vector_col), "cell")
        schema = pa.schema([("query_id", _arrow(kinds[0])), ("id", _arrow(kinds[1])), ("cell", pa.int32()), ("score", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[list] = [[] for _ in qid]
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                n = np.sqrt((m * m).sum(1, keepdims=True))
                m /= np.where(n > 0, n, 1)
                ids, cells = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
                for q, s in enumerate(matrix @ m.T):
                    at = np.flatnonzero(mask[q, cells])
                    if len(at) > k:
                        at = at[s[at] >= np.partition(s[at], -k)[-k]]
                    best[q] = sorted([*best[q], *((-s[j], ids[j], cells[j]) for j in at)])[:k]
            out = [{"query_id": qid[q], "id": i, "cell": int(c), "score": float(-s)} for q, found in enumerate(best) for s, i, c in found]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

        return self._ranked(src.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, cell int, score double"), k)


def plan_search(n_rows: int) -> str:
    """The access path the row count asks for."""
    return "cells" if n_rows > rules.IVF_FROM else "exact"


def search(df: DataFrame, id_col: str, vector_col: str, queries: DataFrame, q_id: str, q_vector: str, k: int = rules.TOP_K, on: list[str] | None = None) -> DataFrame:
    """query_id, id, score, rank by the access path the corpus asks for: cells for large ones, all rows for small ones and where
    questions name metadata (each such question reads its own part of the rows)."""
    named = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in on], F.lit(False)) if on else F.lit(False)
    if plan_search(df.count()) == "cells" and queries.filter(named).isEmpty():
        return CellIndex(df, id_col, vector_col).search_batch(queries, q_id, q_vector, k).drop("cell")
    return top_k_batch(df, id_col, vector_col, queries, q_id, q_vector, k, on)


def rerank(candidates: DataFrame, score: Column | None, query_id: str = "query_id", cut: int = rules.RERANK_CUT) -> DataFrame:
    """The ``cut`` best by the reranker's score, ties by dense rank; without a reranker the candidates stay uncut."""
    if score is None:
        return candidates
    w = Window.partitionBy(query_id).orderBy(F.desc("rerank_score"), "rank")
    return candidates.withColumn("rerank_score", score).withColumn("final_rank", F.row_number().over(w)).filter(F.col("final_rank") <= cut)
