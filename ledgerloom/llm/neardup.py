"""Near-duplicate texts: minhash with tensored banding, exact verification, pairs and groups.

A text's words are maximal runs of letters or digits, lower-cased; its set is its distinct runs of ``shingle`` words. From
``2 * halves`` minhashes a small collection of ``halves`` half-keys (two minhashes each) is formed; a table key is a pair
of half-keys, so that ``halves * (halves - 1) / 2`` tables of four minhashes each need only ``2 * halves`` minhashes. Two
texts are candidates if they agree in at least one table, that is in at least two half-keys; candidates are then verified
exactly on the whole texts. With 12 half-keys (66 tables from 24 minhashes) a pair of similarity s is found with probability
1 - (1-p)^12 - 12 p (1-p)^11, p = s^2: 0.963 at 0.6, 0.996 at 0.7, 0.9999 at 0.8; with ``halves=16`` 0.992 at 0.6.

Texts of the same word sequence are collapsed into one class before any table is built, so a group of copies takes part as
one row, whatever its size. The tables are not written out one by one: a row travels once per half-key, with 16 bits of
every other half-key, and the second half of each table key is matched where the first half met.

Defined results: null texts and texts with fewer than ``min_words`` words (or than ``shingle`` words) take no part; a row
repeated with the same id makes a pair only with other ids; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import connected_components
from ledgerloom.llm.skew import HOT_ROWS, join_groups, parts
from ledgerloom.runtime import materialize

_WORD = re.compile(r"[^\W_]+")
_M = (1 << 64) - 1


class _Hashes(dict):
    """Word -> 64-bit hash, kept while it stays small; the same on every machine."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def words_of(text: str) -> list[str]:
    return list(map(str.lower, _WORD.findall(text)))


def _shingles(docs: list[list[str]], shingle: int, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all docs, and where each doc begins; every doc has at least ``shingle`` words."""
    lens = np.fromiter(map(len, docs), np.int64, len(docs))
    flat = np.fromiter((hashes[w] for d in docs for w in d), np.uint64, int(lens.sum()))
    n = len(flat) - shingle + 1
    mult = _odd(shingle)
    s = flat[:n] * mult[0]
    for k in range(1, shingle):
        s += flat[k : n + k] * mult[k]
    ends = np.cumsum(lens)
    inside = np.ones(len(flat), bool)
    for k in range(1, shingle):
        inside[ends - k] = False
    at = np.concatenate([[0], np.cumsum(lens - shingle + 1)[:-1]])
    return _mix(s[inside[:n]]), at


def _half_keys(s: np.ndarray, at: np.ndarray, halves: int) -> np.ndarray:
    mult = _odd(4 * halves + 7)[7:]
    out = np.empty((halves, len(at)), np.uint64)
    for h in range(halves):
        a = np.minimum.reduceat(s * mult[2 * h], at)
        b = np.minimum.reduceat(s * mult[2 * h + 1], at)
        out[h] = _mix(a * np.uint64(0x9E3779B97F4A7C15) + b)
    return out


def _sign(shingle: int, min_words: int, halves: int):
    """(id, text) -> (id, class: 16 bytes, hk: the half-keys, 8 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, least = _Hashes(), max(min_words, shingle)
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, batch.num_rows, 4000):
                keep, docs = [], []
                for k, text in enumerate(texts.slice(lo, 4000).to_pylist(), lo):
                    if text and len(w := words_of(text)) >= least:
                        keep.append(k)
                        docs.append(w)
                if not docs:
                    continue
                s, at = _shingles(docs, shingle, hashes)
                hk = np.ascontiguousarray(_half_keys(s, at, halves).T)
                cls = [xxhash.xxh3_128_digest(" ".join(d).encode("utf-8", "surrogatepass")) for d in docs]
                raw = hk.tobytes()
                rows = [raw[i : i + 8 * halves] for i in range(0, len(raw), 8 * halves)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(cls, pa.binary()), pa.array(rows, pa.binary())], names=["id", "cls", "hk"])

    return run


def _spread(halves: int):
    """(rep, hk) -> one row per half-key: (k, rep, tail: 2 bytes of every half-key). The lowest 4 bits of k name the half."""
    if halves > 16:
        raise ValueError("at most 16 half-keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            hk = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(n, halves)
            k = ((hk & ~np.uint64(15)) | np.arange(halves, dtype=np.uint64)).view(np.int64).ravel()
            raw = np.ascontiguousarray((hk >> np.uint64(20)).astype(np.uint16)).tobytes()
            tails = [raw[i : i + 2 * halves] for i in range(0, len(raw), 2 * halves)]
            who = np.repeat(np.arange(n), halves)
            yield pa.RecordBatch.from_arrays([pa.array(k), batch.column(0).take(pa.array(who)), pa.array(tails, pa.binary()).take(pa.array(who))], names=["k", "rep", "tail"])

    return run


def _match(halves: int):
    """Rows sorted by k -> candidate pairs (a < b): rows of one k that also agree in a later half-key."""

    def pairs(k: np.ndarray, rep: np.ndarray, tail: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All rows of each k are here."""
        group = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        first = (k.view(np.uint64) & np.uint64(15)).astype(np.int64)
        for j in range(1, halves):
            use = np.flatnonzero(first < j)
            key = (group[use].astype(np.int64) << 16) | tail[use, j]
            order = np.argsort(key, kind="stable")
            key, who = key[order], use[order]
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            big = sizes > 1
            for size in np.unique(sizes[big]):
                base = starts[sizes == size]
                for d in range(1, int(size)):  # the pairs at distance d of all runs of this size at once
                    for lo in range(0, int(size) - d, 1 << 16):
                        off = np.arange(lo, min(int(size) - d, lo + (1 << 16)))
                        x = who[(base[:, None] + off).ravel()]
                        y = who[(base[:, None] + off + d).ravel()]
                        yield rep[x], rep[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(k, rep, tail):
            keep = np.zeros(len(k), bool)
            same = k[1:] == k[:-1]
            keep[1:] |= same
            keep[:-1] |= same
            if not keep.any():
                return
            for x, y in pairs(k[keep], rep[keep], tail[keep]):
                real = x != y
                a, b = np.minimum(x, y)[real], np.maximum(x, y)[real]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k, rep = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            tail = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, halves)
            if held and k[-1] == held[0][0][0] and len(k):
                held.append((k, rep, tail))
                continue
            cut = 0 if k[0] == k[-1] else int(np.flatnonzero(k != k[-1])[-1]) + 1
            parts = [*held, (k[:cut], rep[:cut], tail[:cut])]
            yield from out(*(np.concatenate(c) for c in zip(*parts)))
            held = [(k[cut:], rep[cut:], tail[cut:])]
        if held:
            yield from out(*(np.concatenate(c) for c in zip(*held)))

    return run


def _tables(halves: int):
    """(k, rep, tail) -> (t, rep): the table keys a half-key takes part in, one for every later half-key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k, rep = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)
            tail = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, halves).astype(np.uint64)
            first = k & np.uint64(15)
            for j in range(1, halves):
                use = first < np.uint64(j)
                if use.any():
                    t = _mix(k[use] * np.uint64(0x9E3779B97F4A7C15) + (tail[use, j] << np.uint64(4) | np.uint64(j)))
                    yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(rep[use])], names=["t", "rep"])

    return run


def _between_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, lo, hi, b, rep) sorted by all: the pairs between blocks lo and hi of a table, or within the block if they
    are one. A run is two blocks at most."""

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        b, rep = (np.concatenate(c) for c in zip(*(r[1] for r in rows)))
        lo, hi = rows[0][0][1:]
        if lo == hi:
            i, j = np.triu_indices(len(rep), 1)
            x, y = rep[i], rep[j]
        else:
            left, right = rep[b == lo], rep[b == hi]
            x, y = np.repeat(left, len(right)), np.tile(right, len(left))
        real = x != y
        if real.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[real]), pa.array(np.maximum(x, y)[real])], names=["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t, lo, hi, b, rep = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        change = np.flatnonzero((t[1:] != t[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        for s, e in zip([0, *change.tolist()], [*change.tolist(), len(t)]):
            key = (t[s], lo[s], hi[s])
            if held and held[0][0] != key:
                yield from out(held)
                held = []
            held.append((key, (b[s:e], rep[s:e])))
    if held:
        yield from out(held)


def _verify(shingle: int, threshold: float):
    """(a, b, text_a, text_b) -> (a, b, similarity) of the pairs that reach the threshold, on the sets of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sims = [], []
            known: dict[str, frozenset] = {}
            for i, texts in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                sets = []
                for t in texts:
                    if (g := known.get(t)) is None:
                        w = words_of(t)
                        g = known[t] = frozenset(zip(*(w[k:] for k in range(shingle))))
                        if len(known) > 5000:
                            known.clear()
                    sets.append(g)
                both = len(sets[0] & sets[1])
                sim = both / (len(sets[0]) + len(sets[1]) - both)
                if sim >= threshold:
                    keep.append(i)
                    sims.append(sim)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])

    return run


#: Rows of a table that are compared in one piece; a larger table is compared block against block, in many tasks.
BLOCK = 512
#: Half-keys are held for hot if this many of one in HOT_SAMPLE rows have them. It only decides the way, not the result.
HOT_SAMPLE, HOT_COUNT = 64, 8
#: Ids are broadcast to filter the second scan only up to this many (16 bytes each); beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000


class NearDuplicates:
    """The stages over one table with BIGINT ids; each is written once to the shared folder and used by every result."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, shingle: int = 5, threshold: float = 0.8, min_words: int = 0, halves: int = 12, hot_sample: int = HOT_SAMPLE, hot_count: int = HOT_COUNT, hot_rows: int = HOT_ROWS, part_rows: int = 4096):
        self.src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
        self.shingle, self.threshold, self.halves, self.hot = shingle, threshold, halves, (hot_sample, hot_count)
        self.hot_rows, self.part_rows = hot_rows, part_rows
        # a text with w words of at least one character has at least 2 w - 1 characters
        long = self.src.filter(F.length("text") >= 2 * max(min_words, shingle) - 1)
        self.signed = materialize(long.mapInArrow(_sign(shingle, min_words, halves), "id bigint, cls binary, hk binary"), "neardup_signed")

    def classes(self) -> DataFrame:
        """rep (smallest id), cls, n: one row per distinct word sequence, counted with map-side combining."""
        return self.signed.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))

    def members(self) -> DataFrame:
        """id, rep, n (rows of the class) of the rows whose class has several. Rows of a hot class stay where they are."""
        if not hasattr(self, "_members"):
            several = materialize(self.classes().filter("n > 1"), "neardup_classes")
            self._members = materialize(join_groups(self.signed.select("id", "cls"), several, ["cls"], "n", self.hot_rows).select("id", "rep", "n").distinct(), "neardup_members")
        return self._members

    def candidates(self) -> DataFrame:
        """Pairs (a < b) of class representatives that share a table key.

        A half-key that very many rows have (found by a sample, counted with map-side combining) does not go to one task:
        its rows are dealt out by whole table keys, and a table that is still large is cut into blocks."""
        copies = self.classes().filter("n > 1").select("cls", "rep")
        reps = self.signed.join(copies, "cls", "left").filter("rep is null or rep = id").select(F.col("id").alias("rep"), "hk")
        rows = lambda r: r.mapInArrow(_spread(self.halves), "k bigint, rep bigint, tail binary")
        sample = rows(reps.filter(F.pmod(F.xxhash64("rep"), F.lit(self.hot[0])) == 0)).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        hot = materialize(sample.filter(F.col("n") >= self.hot[1]).select("k"), "neardup_hot")
        n_hot = hot.count()
        every = rows(reps)
        if not n_hot:
            return self._met(every).distinct()
        hot = F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot
        return self._met(every.join(hot, "k", "left_anti")).unionByName(self._met_hot(every.join(hot, "k", "left_semi"))).distinct()

    def _met(self, rows: DataFrame) -> DataFrame:
        return rows.select("k", "rep", "tail").repartition("k").sortWithinPartitions("k").mapInArrow(_match(self.halves), "a bigint, b bigint")

    def _met_hot(self, rows: DataFrame) -> DataFrame:
        t = rows.select("k", "rep", "tail").mapInArrow(_tables(self.halves), "t bigint, rep bigint")
        sizes = t.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("t", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
        d = t.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(16)).cast("int")).join(sizes, ["t", "salt"])
        d = d.withColumn("b", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        d = d.select("t", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "rep")
        return d.repartition("t", "lo", "hi").sortWithinPartitions("t", "lo", "hi", "b").mapInArrow(_between_blocks, "a bigint, b bigint")

    def pairs(self) -> DataFrame:
        """a, b, similarity: every verified pair of representatives with different texts."""
        if not hasattr(self, "_pairs"):
            cand = materialize(self.candidates(), "neardup_candidates")
            ids = cand.select(F.col("a").alias("id")).unionByName(cand.select(F.col("b").alias("id"))).distinct()
            if cand.count() <= BROADCAST_IDS // 2:
                ids = F.broadcast(ids)
            texts = self.src.join(ids, "id", "left_semi").dropDuplicates(["id"])
            left = cand.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            full = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            checked = full.select("a", "b", "text_a", "text_b").mapInArrow(_verify(self.shingle, self.threshold), "a bigint, b bigint, similarity double")
            self._pairs = materialize(checked, "neardup_pairs")
        return self._pairs

    def row_pairs(self) -> DataFrame:
        """uid_a < uid_b for every pair of rows, copies included: representatives' pairs expanded by their members, and
        the pairs within a class."""
        members = self.members()
        k = parts(F.col("n"), self.part_rows)
        dealt = members.select("rep", "id", F.pmod(F.xxhash64("id"), k).cast("int").alias("salt"))
        sizes = members.filter("id = rep").select("rep", k.alias("parts"))
        out = self.pairs().select("a", "b")
        for end in ("a", "b"):
            # a large class is dealt into parts by its count, and a pair meets each part; a class of one row has one part
            n = sizes.select(F.col("rep").alias(end), F.col("parts"))
            out = out.join(n, end, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
            m = dealt.select(F.col("rep").alias(end), "salt", F.col("id").alias("member"))
            out = out.join(m, [end, "salt"], "left").withColumn(end, F.coalesce("member", end)).drop("member", "salt")
        between = out.select(F.least("a", "b").alias("uid_a"), F.greatest("a", "b").alias("uid_b"))
        # the pairs of one large class are made in many tasks: each member meets the others part by part
        m = dealt.select("rep", F.col("id").alias("uid_a"), "salt")
        o = members.select("rep", F.col("id").alias("uid_b"), F.explode(F.sequence(F.lit(0), k - 1)).alias("salt"))
        within = m.join(o, ["rep", "salt"]).filter("uid_a < uid_b").select("uid_a", "uid_b")
        return between.unionByName(within)

    def groups(self) -> DataFrame:
        """id, group_id (smallest id), n_links (verified links of its text to different texts), n_copies of its text; for
        every row that has a copy or a link."""
        pairs = self.pairs()
        comp = connected_components(pairs, "a", "b")
        degree = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
        members = self.members().select("id", "rep")
        alone = comp.join(members.select(F.col("rep").alias("node")).distinct(), "node", "left_anti").select(F.col("node").alias("id"), F.col("node").alias("rep"))
        n = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n_copies"))
        rows = members.unionByName(alone)
        out = rows.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left").join(n, "rep", "left")
        return out.select("id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"))
