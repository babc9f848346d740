"""Copies, near-duplicates, lines, mixtures and neighbours against brute force on small tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import components, copies, lines, mixing, neardup, neighbours


def _canon(text):
    keep = lambda s: "".join(c for c in s.lower() if c.isalnum())
    import re

    parts = [p for p in re.split("[\t\n\r;|]", text) if p.strip()]
    return "".join(sorted(map(keep, parts))) if len(parts) > 1 and all(":" in p or "=" in p for p in parts) else keep(text)


def test_copies_by_brute_force(spark):
    rnd = random.Random(3)
    base = ["Name: A; State: TX", "state = tx\tNAME: a", "Name: A. State: TX", "Hello, World", "hello  world!", "Ünit 5", "ÜNIT 5", "a:b|c", "a b c", "x:1;y:2", "y:2;x:1", "y2x1"]
    rows = [(i, rnd.choice(base), rnd.choice(["1-2", "12", " 1 2 ", "3", None]), "h") for i in range(300)] + [(900, None, "12", "h"), (901, "...", "12", "h"), (902, "", "12", None)]
    df = spark.createDataFrame(rows, "uid bigint, text string, acc string, h string")
    got = {(r.keep_id, r.copy_id) for r in copies.copy_pairs(df, "uid", "text", copies.digits_of("acc")).collect()}
    groups = defaultdict(list)
    for uid, text, acc, _ in rows:
        if text and acc and _canon(text):
            groups["".join(c for c in acc if c.isdigit()), _canon(text)].append(uid)
    assert got == {(min(g), u) for g in groups.values() for u in g if u != min(g)}
    counts = copies.copy_groups(df, "uid", "text", copies.digits_of("acc"))
    assert sorted((r.keep_id, r.n_copies) for r in counts.collect()) == sorted((min(g), len(g)) for g in groups.values())
    assert copies.copy_pairs(df.limit(0), "uid", "text").count() == 0


def test_a_hot_key_is_spread(spark):
    df = spark.range(3000).select(F.col("id").alias("uid"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    for hot_rows in (100, 10_000):  # hot keys are broadcast, or joined like all others
        got = copies.copy_pairs(df, "uid", "text", hot_rows=hot_rows)
        assert got.agg(F.count("*"), F.countDistinct("copy_id"), F.max("keep_id")).first() == (999, 999, 0)


def _sets(text, k=3):
    w = neardup.words_of(text)
    return frozenset(zip(*(w[i:] for i in range(k))))


@pytest.fixture(scope="module")
def near_rows():
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(60):
        text = [rnd.choice(vocab) for _ in range(rnd.randint(45, 120))]
        for _ in range(rnd.randint(1, 4)):
            t = list(text)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 9])):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(t).title() if rnd.random() < 0.3 else ", ".join(t), g))
    return [*rows, (9000, None, 0), (9001, "", 0), (9002, "too short", 0), (9003, "long " * 30_000, 0), (9004, "long " * 30_000, 0)]


def test_near_duplicates_by_brute_force(spark, near_rows):
    df = spark.createDataFrame(near_rows, "uid bigint, text string, id bigint")
    nd = neardup.NearDuplicates(df, "uid", "text", shingle=3, threshold=0.6, min_words=40, halves=16)
    got = {(r.uid_a, r.uid_b) for r in nd.row_pairs().collect()}
    sets = {u: _sets(t) for u, t, _ in near_rows if t and len(neardup.words_of(t)) >= 40}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert got <= want and len(got) >= 0.98 * len(want) and (9003, 9004) in got
    groups = {r.id: r.group_id for r in nd.groups().collect()}
    assert all(groups[a] == groups[b] for a, b in got) and set(groups) == {u for p in got for u in p}


def test_large_classes_are_dealt_into_parts(spark, near_rows):
    df = spark.createDataFrame(near_rows, "uid bigint, text string, id bigint")
    make = lambda **k: set(map(tuple, neardup.NearDuplicates(df, "uid", "text", 3, 0.6, 40, **k).row_pairs().collect()))
    assert make(hot_rows=2, part_rows=1) == make()


def test_a_source_that_may_not_be_used_limits_nobody(spark):
    docs = spark.createDataFrame([(i, "ore and coal " * 5, "a" if i % 2 else "b") for i in range(40)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 0), ("b", 0.5, 2), ("b2", 0.0, None)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(docs, targets, "doc_id", "text", "source")
    shares = {r.source: (r.tokens_drawn, r.actual_share) for r in m.shares().collect()}
    assert shares["a"] == (0, 0.0) and shares["b2"] == (0, 0.0) and shares["b"][1] == 1.0
    assert {tuple(r)[1:] for r in m.checked().collect()} == {(True, True, True)}


@pytest.mark.parametrize("block", [2, 512])
def test_hot_keys_take_another_way_to_the_same_pairs(spark, near_rows, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    df = spark.createDataFrame(near_rows, "uid bigint, text string, id bigint")
    plain = neardup.NearDuplicates(df, "uid", "text", 3, 0.6, 40)
    hot = neardup.NearDuplicates(df, "uid", "text", 3, 0.6, 40, hot_sample=1, hot_count=2)
    assert set(map(tuple, hot.candidates().collect())) == set(map(tuple, plain.candidates().collect()))


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "uid bigint, text string")
    nd = neardup.NearDuplicates(df, "uid", "text")
    assert nd.row_pairs().count() == 0 and nd.groups().count() == 0


def test_copies_enter_the_tables_once(spark):
    text = " ".join(f"t{i}" for i in range(60))
    df = spark.range(400).select(F.col("id").alias("uid"), F.lit(text).alias("text"))
    nd = neardup.NearDuplicates(df, "uid", "text", 3, 0.6, 40)
    assert nd.candidates().count() == 0 and nd.row_pairs().count() == 400 * 399 // 2
    assert nd.groups().agg(F.countDistinct("group_id"), F.max("n_copies"), F.max("n_links")).first() == (1, 400, 0)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {x: find(x) for x in list(parent)}


LINES = [(i, f"Legal notice\nBody {i}\r\nShare   THIS\tpage\n\nlegal  notice", " zz ") for i in range(12)] + [(20, "Share this page\nonly here", "ZZ"), (21, None, "zz"), (22, "", "zz"), (23, "Legal notice", None), (24, "Legal notice", "Other")]


@pytest.mark.parametrize("limit", [0, 500_000])
def test_repeated_lines(spark, monkeypatch, limit):
    monkeypatch.setattr(lines, "BROADCAST_LINES", limit)
    df = spark.createDataFrame(LINES, "uid bigint, text string, ticker string")
    nodes = {(r.source, r.line): r.support for r in lines.line_nodes(df, "uid", "ticker", "text").collect()}
    assert nodes == {("ZZ", "legal notice"): 12, ("ZZ", "share this page"): 13}
    blocks = lines.line_blocks(df, "uid", "ticker", "text").collect()
    assert len({b.block for b in blocks}) == 1
    out = {r.id: (r.text, r.n_removed) for r in lines.without_repeated_lines(df, "uid", "ticker", "text").collect()}
    assert out[0] == ("Body 0\r\n", 3) and out[20] == ("only here", 1) and out[21] == (None, 0) and out[23] == ("Legal notice", 0) and out[24] == ("Legal notice", 0)
    assert lines.line_nodes(df.limit(0), "uid", "ticker", "text").count() == 0 and lines.without_repeated_lines(df.limit(0), "uid", "ticker", "text").count() == 0


def test_mixture_reaches_its_targets(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["ore", "coal", "the price of steel"]) for _ in range(rnd.randint(5, 60))), rnd.choice(["big"] * 8 + ["mid", "mid", "small"]), "x") for i in range(1500)]
    rows += [(9001, None, "big", "x"), (9002, "", "big", "x"), (9003, "lost", None, "x"), (9004, "no target", "other", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, src string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.15, 4), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(docs, targets, "doc_id", "text", "src")
    shares = {r.source: r for r in m.shares().collect()}
    assert set(shares) == {"big", "mid", "small", "none"} and shares["none"].tokens_drawn == 0
    for s, t in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert abs(shares[s].actual_share - t / 0.95) < 0.01
    drawn = m.drawn().collect()
    cap = {"big": 1, "mid": 3, "small": 4}
    assert all(1 <= r.copies <= cap[r.source] for r in drawn) and not {r.id for r in drawn} & {9001, 9002, 9003, 9004}
    budget = {r.source: r.budget for r in m.plan.collect()}
    sizes = Counter()
    for r in drawn:
        sizes[r.source] += r.copies * r.n_tokens
    assert all(sizes[s] <= budget[s] and budget[s] - sizes[s] < 200 for s in cap)
    less = mixing.Mixture(docs, targets, "doc_id", "text", "src", total_tokens=4000)
    a, b = ({r.id: r.copies for r in x.drawn().filter("source = 'big'").collect()} for x in (less, m))
    assert all(b.get(k, 0) >= v for k, v in a.items())  # nested
    empty = mixing.Mixture(docs.limit(0), targets, "doc_id", "text", "src")
    assert empty.drawn().count() == 0 and empty.shares().count() == 4


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((120, 16))
    x = np.repeat(centres, 9, axis=0) + 0.25 * rng.standard_normal((1080, 16))
    return x * rng.uniform(0.1, 5, (1080, 1))


def test_neighbours_by_brute_force(spark, cloud):
    rows = [(f"c{i:04d}", [float(v) for v in x], "n") for i, x in enumerate(cloud)]
    extra = [("nul", None, "n"), ("zero", [0.0] * 16, "n"), ("short", [1.0], "n"), ("hole", [None] + [1.0] * 15, "n"), ("inf", [float("inf")] + [1.0] * 15, "n"), (None, [1.0] * 16, "n"), rows[0]]
    df = spark.createDataFrame(rows + extra, "id string, vec array<float>, node string")
    g = neighbours.NeighbourGraph(df, "id", "vec", k=5, leaf=40)
    got = defaultdict(set)
    for r in g.neighbours().collect():
        got[r.id].add(r.neighbour)
    u = cloud / np.linalg.norm(cloud, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1)[:, :5]
    want = {f"c{i:04d}": {f"c{j:04d}" for j in t} for i, t in enumerate(top)}
    assert set(got) == set(want) and sum(len(got[k] & want[k]) for k in want) >= 0.99 * 5 * len(want)
    asked = df.filter("id like '%50'")
    found = defaultdict(set)
    for r in g.search(asked, "id", "vec").collect():
        found[r.id].add(r.neighbour)
    assert sum(len(found[k] & want[k]) for k in found) >= 0.9 * 5 * asked.count()
    exact = {(r.id, r.neighbour) for r in neighbours.brute_force(asked, "id", "vec", df, "id", "vec").collect()}
    assert exact == {(k, n) for k in found for n in want[k]}


def test_few_equal_and_no_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [3.0, 0.1])], "id string, v array<float>")
    out = neighbours.NeighbourGraph(df, "id", "v").neighbours().collect()
    assert len(out) == 6
    assert neighbours.NeighbourGraph(df.limit(0), "id", "v").neighbours().count() == 0
    same = spark.range(1300).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0), F.lit(1.0)).alias("v"))
    assert neighbours.NeighbourGraph(same, "id", "v", rounds=2).neighbours().groupBy("id").count().filter("count = 5").count() == 1300


def test_repeated_lines_come_from_the_blocks_of_the_graph(spark, tmp_path, monkeypatch):
    from ledgerloom.llm import lines, queries

    text = "Head\nSecond\nown {}\nTail"
    df = spark.createDataFrame([(i, "a ", text.format(i)) for i in range(12)], "chunk_uid bigint, ticker string, text string")
    df.write.parquet(f"{tmp_path}/sec_chunks.parquet")
    calls, real = [], lines.line_blocks

    def blocks(*args):
        calls.append(args)
        return real(*args)

    monkeypatch.setattr(lines, "line_blocks", blocks)
    assert sorted(tuple(r) for r in queries.p6_found(spark, str(tmp_path)).collect()) == [("A", "head"), ("A", "second"), ("A", "tail")]
    assert {(r.text, r.n_removed) for r in queries.p6_cleaned(spark, str(tmp_path)).collect()} == {(f"own {i}", 3) for i in range(12)}
    assert len(calls) == 2


def test_equal_vectors_are_settled_by_the_smaller_id(spark):
    same = spark.range(2000).select(F.format_string("e%04d", "id").alias("id"), F.array(F.lit(1.0), F.lit(1.0), F.lit(0.5)).alias("v"))
    few = spark.createDataFrame([("a", [1.0, 1.0, 0.5]), ("z", [0.0, 1.0, 0.0]), ("z", [0.0, 1.0, 0.0]), ("y", [0.0, 2.0, 0.0])], "id string, v array<double>")
    got = defaultdict(list)
    for r in neighbours.NeighbourGraph(same.unionByName(few).repartition(20), "id", "v", k=3).neighbours().orderBy("id", "rank").collect():
        got[r.id].append(r.neighbour)
    assert len(got) == 2003 and got["a"] == ["e0000", "e0001", "e0002"] and got["e0001"] == ["a", "e0000", "e0002"] and got["e1999"] == ["a", "e0000", "e0001"]
    assert got["z"] == ["y", "a", "e0000"] and got["y"] == ["z", "a", "e0000"]


def test_small_blocks_and_hubs_lose_little(spark, cloud):
    df = spark.createDataFrame([(f"c{i:04d}", [float(v) for v in x]) for i, x in enumerate(cloud)], "id string, vec array<float>")
    made = [{(r.id, r.neighbour) for r in neighbours.NeighbourGraph(df, "id", "vec", leaf=40, **k).neighbours().collect()} for k in ({}, {"block": 16, "hub": 64})]
    assert len(made[0]) == len(made[1]) == 5 * 1080 and len(made[0] & made[1]) >= 0.95 * len(made[0])


def test_records_without_id(spark):
    rows = [(None if i % 3 == 0 else i, f"Legal notice\nbody {i}", "zz") for i in range(18)] + [(None, "only here\nx", "yy")] * 12
    df = spark.createDataFrame(rows, "uid bigint, text string, ticker string")
    assert {(r.source, r.line, r.support) for r in lines.line_blocks(df, "uid", "ticker", "text").collect()} == {("ZZ", "legal notice", 12)}
    out = lines.without_repeated_lines(df, "uid", "ticker", "text")
    assert out.count() == 30 and out.filter("n_removed = 1").count() == 18 and out.filter("text = 'only here\nx'").count() == 12
    same = spark.createDataFrame([(None, "a", "s"), (None, "a", "s"), (2, "A", "s"), (3, "a.", "s")], "uid bigint, text string, scope string")
    assert [tuple(r) for r in copies.copy_pairs(same, "uid", "text", F.col("scope")).collect()] == [(2, 3)]
