"""The k most similar vectors of every vector: NN-descent over Spark joins, and greedy search in the graph it builds.

Vectors of the same direction (equal unit vectors) are one node of the graph, whatever their number. Nodes are numbered along
random hyperplanes, so that numbers close to each other are likely close in direction, and runs of numbers are blocks. A
first graph comes from several trees of such hyperplanes: nodes of one leaf are compared with each other. Every round then
joins each node with its neighbours and with those that name it, by blocks: what is sent are ids, and each vector travels
once to a block that needs it, not once to each of its nodes. There neighbours of neighbours are compared; only pairs with at
least one neighbour that is new since the last round count, only results better than a node's worst neighbour leave the
block, and each task keeps the best of a node before anything is shuffled. Rounds end when few lists change. Queries descend
greedily through the graph from the leaves they would fall into.

Similarity is the cosine. Vectors are 4-byte floats of unit length; no product of all with all is formed. A leaf over ``block``
nodes is cut by finer hyperplanes; the nodes on both sides of the cut meet in the other trees and in the rounds. The
neighbourhood of a block that over ``hub`` nodes name is dealt into parts, anew in every round; every node takes part.

Defined results: null, empty and all-zero vectors, vectors with a null or non-finite number and vectors of another length
than most take no part; an id stored several times counts once (the smallest of its vectors by bytes); ties are settled by
the smaller id; with fewer than k other vectors all of them are named; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.skew import join_groups
from ledgerloom.runtime import discard, materialize


def _unit(dim: int):
    """(id, values) -> (id, v: unit length, 4-byte floats) of the usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if batch.num_rows else np.zeros((0, dim))
            norm = np.sqrt((flat * flat).sum(1))
            ok = np.isfinite(norm) & (norm > 0)
            unit = np.ascontiguousarray((flat[ok] / norm[ok, None]).astype(np.float32))
            raw, w = unit.tobytes(), 4 * dim
            take = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array([raw[i : i + w] for i in range(0, len(raw), w)], pa.binary())], names=["name", "v"])

    return run


def _rows(batch_col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch_col.to_pylist()), np.float32).reshape(-1, dim)


def _planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables * bits, dim)).astype(np.float32)


def _leaves(dim: int, tables: int, bits: int, seed: int):
    """(node, v) -> one row per table: (leaf, fine, node, v); fine holds more bits to order a large leaf by."""
    total = bits + 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _planes(dim, tables, total, seed)
        weights = (1 << np.arange(total, dtype=np.int64))[::-1]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            side = (_rows(batch.column(1), dim) @ planes.T > 0).reshape(n, tables, total)
            code = (side * weights).sum(2)
            for t in range(tables):
                leaf = (code[:, t] >> 16) * tables + t
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array((code[:, t] & 0xFFFF).astype(np.int32)), batch.column(0), batch.column(1)], names=["leaf", "fine", "node", "v"])

    return run


def _codes(dim: int, bits: int, seed: int):
    """(v, ...) -> (..., code): the side of ``bits`` hyperplanes as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, weights = _planes(dim, 1, bits, seed), (1 << np.arange(bits, dtype=np.int64))[::-1]
        for batch in batches:
            code = ((_rows(batch.column(0), dim) @ planes.T > 0) * weights).sum(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=[*batch.schema.names, "code"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: int, block: int) -> Iterator[list]:
    """Consecutive rows that agree in the first ``keys`` columns, in blocks of at most ``block`` rows."""
    held: list[pa.RecordBatch] = []
    mark = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(starts, starts[1:]):
            key = tuple(c[s] for c in cols)
            if held and key != mark:
                yield held
                held = []
            mark = key
            while s < e:
                room = block - sum(h.num_rows for h in held)
                held.append(batch.slice(s, min(room, e - s)))
                s += min(room, e - s)
                if sum(h.num_rows for h in held) == block:
                    yield held
                    held = []
    if held:
        yield held


def _order(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray, old: np.ndarray, width: int) -> np.ndarray:
    """Rows by node and falling similarity: the ``width`` best different neighbours of each node."""
    one = np.lexsort((-old, nbr, node))
    first = np.ones(len(one), bool)
    first[1:] = (node[one][1:] != node[one][:-1]) | (nbr[one][1:] != nbr[one][:-1])
    one = one[first]
    one = one[np.lexsort((nbr[one], -sim[one], node[one]))]
    n = node[one]
    starts = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]])) if len(n) else np.zeros(0, int)
    rank = np.arange(len(n)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(n)]])))
    return one[rank < width]


class _Emit:
    """Collects (node, nbr, sim); what leaves are the best of each node among what was collected."""

    def __init__(self, width: int, size: int = 400_000):
        self.width, self.size, self.held, self.rows = width, size, [], 0

    def add(self, node: np.ndarray, nbr: np.ndarray, sim: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((node, nbr, sim))
        self.rows += len(node)
        if self.rows >= self.size:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            node, nbr, sim = (np.concatenate(c) for c in zip(*self.held))
            keep = _order(node, nbr, sim, np.zeros(len(node), np.int8), self.width)
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(nbr[keep]), pa.array(sim[keep].astype(np.float32))], names=["node", "nbr", "sim"])
        self.held, self.rows = [], 0


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest of each row."""
    n, m = sims.shape
    if m <= k:
        return np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    cols = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(n), k), cols.ravel()


def _within_leaves(dim: int, k: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Emit(k)
        for rows in _runs(batches, 1, block):
            node = np.concatenate([b.column(2).to_numpy() for b in rows])
            if len(node) < 2:
                continue
            m = np.concatenate([_rows(b.column(3), dim) for b in rows])
            sims = m @ m.T
            np.fill_diagonal(sims, -2)
            x, y = _best(sims, k)
            real = sims[x, y] > -2
            yield from out.add(node[x[real]], node[y[real]], sims[x[real], y[real]])
        yield from out.flush()

    return run


def _local_join(dim: int, k: int, most: int):
    """(home, salt, member, new, worst, v) -> better neighbours among the members of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Emit(k)
        for rows in _runs(batches, 2, most):
            member = np.concatenate([b.column(2).to_numpy() for b in rows])
            new = np.concatenate([b.column(3).to_numpy(zero_copy_only=False) for b in rows]).astype(bool)
            if len(member) < 2 or not new.any():
                continue
            worst = np.concatenate([b.column(4).to_numpy() for b in rows])
            m = np.concatenate([_rows(b.column(5), dim) for b in rows])
            for lo in range(0, len(m), 1024):
                sims = m[lo : lo + 1024] @ m.T
                hit = sims > worst[lo : lo + 1024, None]
                hit &= new[lo : lo + 1024, None] | new
                x, y = np.nonzero(hit)
                apart = member[lo + x] != member[y]
                x, y = x[apart], y[apart]
                if len(x):
                    yield from out.add(member[lo + x], member[y], sims[x, y])
        yield from out.flush()

    return run


def _merge(width: int):
    """(node, nbr, sim, old) sorted by node -> (node, nbrs, sims, new): the ``width`` best per node."""

    def lists(node, nbr, sim, old) -> pa.RecordBatch:
        keep = _order(node, nbr, sim, old, width)
        n = node[keep]
        starts = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
        at = pa.array(np.concatenate([starts, [len(n)]]).astype(np.int32))
        cols = (pa.array(nbr[keep]), pa.array(sim[keep]), pa.array(old[keep] == 0))
        return pa.RecordBatch.from_arrays([pa.array(n[starts]), *(pa.ListArray.from_arrays(at, c) for c in cols)], names=["node", "nbrs", "sims", "new"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            node = cols[0]
            cut = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
            if cut:
                yield lists(*(np.concatenate(c) for c in zip(*held, tuple(c[:cut] for c in cols))))
                held = []
            elif held and held[-1][0][-1] != node[0]:
                yield lists(*(np.concatenate(c) for c in zip(*held)))
                held = []
            held.append(tuple(c[cut:] for c in cols))
        if held:
            yield lists(*(np.concatenate(c) for c in zip(*held)))

    return run


#: Nodes of a block are 2^HOME consecutive numbers.
HOME = 6


class NeighbourGraph:
    """``k`` answers per vector out of lists of ``width`` neighbours; ``tables`` hyperplane trees with leaves of about ``leaf`` nodes
    start the graph."""

    def __init__(
        self, df: DataFrame, id_col: str, vector_col: str, k: int = 5, width: int = 10, tables: int = 4, leaf: int = 96, rounds: int = 6, stop: float = 0.002, seed: int = 7, block: int = 512, hub: int = 2048
    ):
        self.k, self.width, self.tables, self.seed, self.block, self.hub = k, max(width, k), tables, seed, block, hub
        src = df.select(F.col(id_col).alias("name"), F.col(vector_col).cast("array<float>").alias("x")).filter("name is not null and size(x) > 0")
        self.dim = src.agg(F.mode(F.size("x"))).first()[0] or 1
        usable = src.filter((F.size("x") == self.dim) & ~F.exists("x", lambda e: e.isNull()))
        kind = src.schema["name"].dataType.simpleString()
        unit = usable.mapInArrow(_unit(self.dim), f"name {kind}, v binary").groupBy("name").agg(F.min("v").alias("v"))
        self.members = materialize(unit.select("name", "v", F.unhex(F.md5("v")).alias("key")), "knn_members")
        self.vectors = self._numbered(kind)
        self.n = self.vectors.count()
        self.bits = max(0, math.ceil(math.log2(max(self.n, 1) / leaf)))
        self.graph = self._first()
        for r in range(rounds):
            changed = self._descend(r)
            if changed <= stop * self.n * self.width:
                break

    def _numbered(self, kind: str) -> DataFrame:
        """node, v, n, firsts (its k + 1 smallest ids), key: one row per different unit vector, numbered along hyperplanes. Of a
        direction that very many share each task keeps k + 1 ids before the shuffle."""
        ranked = self.members.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("name"))).filter(F.col("r") <= self.k + 1)
        firsts = ranked.groupBy("key").agg(F.min("v").alias("v"), F.array_sort(F.collect_list("name")).alias("firsts"))
        several = self.members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        one = firsts.join(several, "key", "left").select("v", "key", "firsts", F.coalesce("n", F.lit(1)).alias("n"))
        coded = one.mapInArrow(_codes(self.dim, 40, self.seed + 1), f"v binary, key binary, firsts array<{kind}>, n bigint, code bigint")
        return materialize(coded.repartitionByRange("code", "key").sortWithinPartitions("code", "key").select(F.monotonically_increasing_id().alias("node"), "v", "key", "firsts", "n"), "knn_vectors")

    def _top(self, edges: DataFrame, label: str) -> DataFrame:
        """node, nbrs, sims, new: the best ``width`` of (node, nbr, sim, old) rows per node, in one shuffle. Tasks have kept the
        best of each node already, so a hub brings at most ``width`` rows from each of them."""
        rows = edges.select("node", "nbr", "sim", F.col("old").cast("int")).repartition("node").sortWithinPartitions("node")
        return materialize(rows.mapInArrow(_merge(self.width), "node bigint, nbrs array<bigint>, sims array<float>, new array<boolean>"), label)

    def _first(self) -> DataFrame:
        rows = self.vectors.select("node", "v").mapInArrow(_leaves(self.dim, self.tables, self.bits, self.seed), "leaf bigint, fine int, node bigint, v binary")
        # a leaf that holds a large part of the vectors is cut by its finer bits and spread over tasks by range
        ranged = rows.repartitionByRange("leaf", "fine", "node").sortWithinPartitions("leaf", "fine", "node")
        edges = ranged.mapInArrow(_within_leaves(self.dim, self.width, self.block), "node bigint, nbr bigint, sim float")
        return self._top(edges.withColumn("old", F.lit(0)), "knn_graph0")

    def _descend(self, r: int) -> int:
        g = self.graph
        fwd = g.select("node", F.explode(F.arrays_zip("nbrs", "new")).alias("e")).select(F.col("node").alias("pivot"), F.col("e.nbrs").alias("member"), F.col("e.new").alias("new"))
        both = fwd.unionByName(fwd.select(F.col("member").alias("pivot"), F.col("pivot").alias("member"), "new"))
        needs = both.select(F.shiftright("pivot", HOME).alias("home"), "member", "new").repartition("member").groupBy("home", "member").agg(F.max("new").alias("new"))
        homes = needs.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.max("new").alias("fresh")).filter("fresh").select("home", F.ceil(F.col("n") / self.hub).alias("parts"))
        # a block that very many nodes name is dealt out to several tasks, anew in every round
        dealt = needs.join(homes, "home").withColumn("salt", F.pmod(F.xxhash64("member", F.lit(r)), F.col("parts")).cast("int")).drop("parts")
        worst = g.select(F.col("node"), F.when(F.size("sims") >= self.width, F.element_at("sims", -1)).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
        known = self.vectors.select("node", "v").join(worst, "node").withColumnRenamed("node", "member")
        rows = dealt.join(known, "member").select("home", "salt", "member", "new", "worst", "v").repartition("home", "salt").sortWithinPartitions("home", "salt")
        better = rows.mapInArrow(_local_join(self.dim, self.width, 2 * self.hub), "node bigint, nbr bigint, sim float")
        old = g.select("node", F.explode(F.arrays_zip("nbrs", "sims")).alias("e")).select("node", F.col("e.nbrs").alias("nbr"), F.col("e.sims").alias("sim"), F.lit(1).alias("old"))
        self.graph = self._top(old.unionByName(better.withColumn("old", F.lit(0))), "knn_graph")
        discard(g)
        return self.graph.agg(F.sum(F.size(F.filter("new", lambda x: x)))).first()[0] or 0

    def neighbours(self) -> DataFrame:
        """id, neighbour, rank (1 = most similar), cosine: at most k rows per id. A node's answers are its own other ids, then
        those of its neighbours; k + 1 of each suffice."""
        k = self.k
        # with the k-th neighbour go those of equal similarity: the smaller id decides between them
        near = F.filter(F.arrays_zip("nbrs", "sims"), lambda e: e["sims"] >= F.element_at("sims", F.least(F.size("sims"), F.lit(k))))
        top = self.graph.select("node", F.explode(near).alias("e")).select("node", F.col("e.nbrs").alias("nbr"), F.col("e.sims").cast("double").alias("cosine"))
        named = top.join(self.vectors.select(F.col("node").alias("nbr"), "firsts"), "nbr").select("node", F.explode("firsts").alias("name"), "cosine")
        own = self.vectors.filter("n > 1").select("node", F.explode("firsts").alias("name"), F.lit(1.0).alias("cosine"))
        entry = F.struct((-F.col("cosine")).alias("d"), "name")
        lists = named.unionByName(own).groupBy("node").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("l"))
        lists = materialize(lists.join(self.vectors.select("node", "key", "n"), "node").select("key", "n", "l"), "knn_lists")
        rows = join_groups(self.members.select(F.col("name").alias("id"), "key"), lists, ["key"])
        rest = F.slice(F.filter("l", lambda e: e["name"] != F.col("id")), 1, k)
        return rows.select("id", F.posexplode(rest).alias("p", "e")).select("id", F.col("e.name").alias("neighbour"), (F.col("p") + 1).alias("rank"), (-F.col("e.d")).alias("cosine"))

    def search(self, queries: DataFrame, id_col: str, vector_col: str, beam: int = 16, rounds: int = 4) -> DataFrame:
        """id, neighbour, rank, cosine for vectors from outside (or inside: a vector never names its own id). The search
        starts in the leaves the query falls into and expands, round by round, the neighbours of its ``beam`` best nodes."""
        kind = queries.schema[id_col].dataType.simpleString()
        q = queries.select(F.col(id_col).alias("name"), F.col(vector_col).cast("array<float>").alias("x")).filter((F.size("x") == self.dim) & F.col("name").isNotNull() & ~F.exists("x", lambda e: e.isNull()))
        q = materialize(q.mapInArrow(_unit(self.dim), f"name {kind}, v binary").dropDuplicates(["name"]).withColumn("q", F.monotonically_increasing_id()), "knn_queries")
        leaves = lambda t, c: t.mapInArrow(_leaves(self.dim, self.tables, self.bits, self.seed), "leaf bigint, fine int, node bigint, v binary").select("leaf", F.col("node").alias(c))
        # entries: the queries' leaves; a leaf over ``block`` nodes is dealt into parts, and a query enters one of them
        here = leaves(self.vectors.select("node", "v"), "node")
        parts = here.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / self.block).alias("parts"))
        part = lambda c: F.pmod(F.xxhash64(c), F.col("parts")).alias("part")
        mine = leaves(q.select(F.col("q").alias("node"), "v"), "q").join(parts, "leaf").select("leaf", part("q"), "q")
        seeds = mine.join(here.join(parts, "leaf").select("leaf", part("node"), "node"), ["leaf", "part"]).select("q", "node").distinct()
        state = self._scored(seeds, q, beam, None)
        for _ in range(rounds):
            fresh = state.filter("not seen").select("q", "node")
            near = fresh.join(self.graph.select("node", "nbrs"), "node").select("q", F.explode("nbrs").alias("node")).distinct()
            near = near.join(state.select("q", "node"), ["q", "node"], "left_anti")
            last, state = state, self._scored(near, q, beam, state)
            discard(last)
        named = state.join(self.vectors.select("node", "firsts"), "node").select("q", F.explode("firsts").alias("neighbour"), F.col("sim").cast("double").alias("cosine"))
        named = named.join(q.select("q", F.col("name").alias("id")), "q").filter("id <> neighbour")
        w = Window.partitionBy("q").orderBy(F.desc("cosine"), "neighbour")
        return named.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= self.k).select("id", "neighbour", "rank", "cosine")

    def _scored(self, pairs: DataFrame, q: DataFrame, beam: int, state: DataFrame | None) -> DataFrame:
        rows = pairs.join(self.vectors.select("node", "v"), "node").join(q.select("q", F.col("v").alias("w")), "q").select("q", "node", "v", "w")
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sims = np.einsum("ij,ij->i", _rows(b.column(2), dim), _rows(b.column(3), dim)) if b.num_rows else np.zeros(0, np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sims.astype(np.float32))], names=["q", "node", "sim"])

        new = rows.mapInArrow(run, "q bigint, node bigint, sim float").withColumn("seen", F.lit(False))
        both = new if state is None else state.withColumn("seen", F.lit(True)).unionByName(new)
        kept = both.withColumn("rank", F.row_number().over(_by_query())).filter(F.col("rank") <= beam).drop("rank")
        return materialize(kept, "knn_beam")


def _by_query():
    return Window.partitionBy("q").orderBy(F.desc("sim"), "node")


def brute_force(queries: DataFrame, q_id: str, q_vec: str, df: DataFrame, id_col: str, vector_col: str, k: int = 5, block: int = 2048) -> DataFrame:
    """Exact id, neighbour, rank, cosine of a stated query set against all rows: queries are packed into blocks, every row
    is compared with one block after another, and each partition keeps its k best before the merge."""
    src = df.select(F.col(id_col).alias("name"), F.col(vector_col).cast("array<float>").alias("x")).filter("name is not null and size(x) > 0")
    dim = src.agg(F.mode(F.size("x"))).first()[0] or 1
    kind, qkind = src.schema["name"].dataType.simpleString(), queries.schema[q_id].dataType.simpleString()
    whole = lambda t, kd: t.filter((F.size("x") == dim) & ~F.exists("x", lambda e: e.isNull())).mapInArrow(_unit(dim), f"name {kd}, v binary").dropDuplicates(["name"])
    q = whole(queries.select(F.col(q_id).alias("name"), F.col(q_vec).cast("array<float>").alias("x")).filter("name is not null"), qkind)
    q = materialize(q, "brute_queries")
    n = q.count()
    parts = max(1, math.ceil(n / block))
    q = q.withColumn("b", F.pmod(F.xxhash64("name"), F.lit(parts)))
    packed = q.groupBy("b").agg(F.collect_list(F.struct("name", "v")).alias("qs"))  # a block is bounded by its size
    rows = materialize(whole(src, kind), "brute_rows")
    rows = rows.withColumn("g", F.pmod(F.xxhash64("name"), F.lit(max(8, math.ceil(rows.count() / (4 * block)))))).groupBy("g").agg(F.collect_list(F.struct("name", "v")).alias("rs"))
    paired = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("b", F.col("b").cast("bigint")).join(packed, "b")

    def run(batches):
        for batch in batches:
            for qs, rs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = np.frombuffer(b"".join(x["v"] for x in qs), np.float32).reshape(-1, dim)
                o = np.frombuffer(b"".join(x["v"] for x in rs), np.float32).reshape(-1, dim)
                sims = m @ o.T
                x, y = _best(sims, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array([qs[i]["name"] for i in x]), pa.array([rs[j]["name"] for j in y]), pa.array(sims[x, y].astype(np.float64))], names=["id", "neighbour", "cosine"])

    scored = paired.select("qs", "rs").mapInArrow(run, f"id {qkind}, neighbour {kind}, cosine double").filter("id <> neighbour")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))).filter(F.col("rank") <= k).select("id", "neighbour", "rank", "cosine")
