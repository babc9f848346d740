"""Text, quality, chunk and section operators."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import rules, text as T
from ledgerloom.operators import chunking, sections


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


BAD = {
    "short": "tiny",
    "few letters": "123-45-67 " * 8,
    "xbrl numbers": "us-gaap: 10% " + "12345678 " * 10,
    "symbols": "ab # ! ? " * 20,
    "gibberish": "some words in the text **** more words in the text follow here",
    "labels": "ACCESSION NUMBER: 12 FORM TYPE: 10-K FILM NUMBER: 77 and then some more words of the text",
    "urls": "http://a http://b https://c https://d " + "1234567 " * 5 + "5% profit",
}
GOOD = ["The company reported that the plant was closed in the year and will not open again.", "Revenue 2021 2022 2023 rose 12% to $1,234 " + "9,999 " * 3 + "in the quarter of the year", "some words **** but the revenue of the firm is named in the same text here"]


@pytest.mark.parametrize("name", sorted(BAD))
def test_each_rule_drops(spark, name):
    assert one(spark, T.is_good_chunk("x"), BAD[name]) is False


@pytest.mark.parametrize("text", GOOD)
def test_good_chunks_stay(spark, text):
    assert one(spark, T.is_good_chunk("x"), text) is True


def test_null_text_is_dropped(spark):
    assert one(spark, T.is_good_chunk("x"), None) is False


def test_encoded_runs(spark):
    line = "A" * 60
    for n, kept in ((2, True), (3, False), (5, False)):
        text = "\n".join(["before", *[line] * n, "after"])
        assert one(spark, T.remove_encoded_runs("x"), text) == (text if kept else "before\nafter")
    assert one(spark, T.remove_encoded_runs("x"), "\n".join([line] * 4)) == ""
    assert one(spark, T.remove_encoded_runs("x"), None) is None


def test_cleaning_steps(spark):
    assert one(spark, T.decode_entities(F.col("x")), "a &amp; b &#8217; &hellip;") == "a & b ’ …"
    assert one(spark, T.strip_tags("x"), "<p>a</p>b") == "ab"
    assert one(spark, T.remove_header_labels("x"), "FORM TYPE: 10-K\nkept\n2020-01-01 10:10:10") == "\nkept"
    assert one(spark, T.remove_boilerplate("x"), "(Mark One) Page 7 text") == "  text"
    assert one(spark, T.remove_xbrl("x"), '<link:loc a="b"/>keep\n' + "x" * 201 + " http://a") == "keep"
    assert one(spark, T.normalize_ws("x"), "  a b \n c ") == "a b c"
    assert one(spark, T.main_content("x"), "cover\nPART I\nbody\nSIGNATURES\nend") == "PART I\nbody"
    assert one(spark, T.main_content("x"), "PART I\nbody") == "PART I\nbody"
    assert one(spark, T.clean_text("x"), "<html>cover\nItem 1. Business\nWe sell &amp; buy.\nSIGNATURES\n</html>") == "Business We sell & buy."
    assert one(spark, T.drop_image_lines("x"), " image: a.png\n text \nImage:b") == "text"
    assert one(spark, T.drop_image_lines("x"), "Image: a") is None
    assert one(spark, T.mime_type("x"), ".PNG") == "image/png" and one(spark, T.mime_type("x"), ".pdf") is None


def test_source_tags(spark):
    tags = one(spark, T.source_tags("x"), 'a <source ticker="T" chunk_id="c">b</source> <source>z</source>')
    assert [tuple(t) for t in tags] == [("T", None, "c", "b")]


def loop_chunks(sentences, tokens, size, budget):
    """The chunker's definition, written plainly."""
    out, buf, total = [], [], 0
    for s, n in zip(sentences, tokens):
        if total + n > size and buf:
            out.append([x for x, _ in buf])
            tail, used = [], 0
            for x in reversed(buf):
                if used + x[1] > budget:
                    break
                tail.insert(0, x)
                used += x[1]
            buf, total = tail, used
        buf.append((s, n))
        total += n
    return [*out, [x for x, _ in buf]] if buf else out


def test_fold_equals_the_definition():
    rnd = random.Random(6)
    for _ in range(300):
        n = rnd.randint(0, 30)
        s, t = [f"s{i}" for i in range(n)], [rnd.randint(0, 50) for _ in range(n)]
        size, budget = rnd.randint(1, 80), rnd.randint(0, 40)
        got = chunking.fold(s, t, size, budget)
        assert [g[0].split() for g in got] == loop_chunks(s, t, size, budget)
        assert all(total == sum(t[int(x[1:])] for x in text.split()) for text, total in got)


def test_split_bytes():
    text = "Short one. " + "é" * 30 + ". " + " ".join(["word"] * 50) + " end."
    parts = chunking.split_bytes(text, 40)
    assert all(len(p.encode()) <= 40 or " " not in p for p in parts) and " ".join(parts).split() == text.split()


def test_chunk_table(spark):
    text = " ".join(f"The firm sold {i} tons of coal in the year." for i in range(120))
    df = spark.createDataFrame([("d1", text, "AA", 2020), ("d2", None, None, None), ("d3", "short", "B", 1), ("d4", "Coal! " * 4000, None, 2021)], "doc_id string, text string, ticker string, year int")
    out = chunking.chunk_documents(df, "doc_id", "text", size=100, overlap=0.2, max_bytes=2000, metadata=("ticker", "year"), keep_bad=True).collect()
    assert {r.doc_id for r in out} == {"d1", "d4"} and all(r.ticker == "AA" and r.year == 2020 for r in out if r.doc_id == "d1")
    assert all(r.end_token <= 120 for r in out) and out[0].chunk_id == "d1_chunk_0"
    assert chunking.chunk_documents(df.limit(0), "doc_id", "text").count() == 0


def brute_clusters(points, eps=6, least=5):
    core = {p for p in points if sum(abs(p - q) <= eps for q in points) >= least}
    labels, c, prev = {}, -1, None
    for p in sorted(core):
        if prev is None or p - prev > eps:
            c += 1
        labels[p], prev = c, p
    for p in points:
        if p not in core:
            before = [q for q in core if q < p and p - q <= eps]
            after = [q for q in core if q > p and q - p <= eps]
            labels[p] = labels[max(before)] if before else labels[min(after)] if after else -1
    return labels


def test_title_clusters(spark):
    rnd = random.Random(8)
    docs = {d: sorted(rnd.sample(range(120), rnd.randint(1, 45))) for d in range(25)}
    df = spark.createDataFrame([(d, p) for d, ps in docs.items() for p in ps], "doc_id int, pos int")
    got = {(r.doc_id, r.pos): r.cluster for r in sections.title_clusters(df).collect()}
    assert got == {(d, p): c for d, ps in docs.items() for p, c in brute_clusters(ps).items()}


def test_titles_and_sections(spark):
    df = spark.createDataFrame([("Item 1A. Risk Factors", "10-K"), ("ITEM 2 - PROPERTIES.", "10-K"), ("Legal Proceedings", "10-Q/A"), ("Risk Factors Summary", "10-K"), ("risk factors", "S-1"), ("Nothing", "10-K"), (None, "10-K"), ("Underwriting", "8-K")], "t string, form string")
    got = [r.section for r in sections.match_sections(df, "t", "form").collect()]
    assert got == ["RISK_FACTORS", "PROPERTIES", "LEGAL_PROCEEDINGS", None, "RISK_FACTORS", None, None, None]
    assert sections.section_catalog(spark).count() == 52
    sections.validate_section_names(["_ALL"])
    for bad in (["_ALL", "BUSINESS"], ["NOPE"]):
        with pytest.raises(ValueError):
            sections.validate_section_names(bad)
    assert len({n for n, _, _ in rules.SECTIONS}) == 40


def test_tables_and_headings():
    page = "<h1>Item 7 Results</h1><table><tr><td>a<table><tr><td>in</td></tr></table></td></tr></table><h3>Other</h3><TABLE><tr><td> </td></tr></TABLE><table>open"
    got = [(o, s, h, t) for o, s, h, t, _ in sections.scan_tables(page)]
    assert got == [(0, "ITEM 7", "Item 7 Results", "a in"), (1, "ITEM 7", "Item 7 Results", "in"), (2, None, "Other", "open")]


def test_items(spark):
    df = spark.createDataFrame([(1, "head Item 1A. Risks <b>x</b> ITEM 7 Results"), (2, None), (3, "none")], "k int, t string")
    assert [(r.item, r.text) for r in sections.item_blocks(df, "k", "t").orderBy("ord").collect()] == [("ITEM 1A", "Item 1A. Risks x"), ("ITEM 7", "ITEM 7 Results")]


def test_toc_location(spark):
    docs = {
        "t": ("10-K", [("Table of Contents", 1), ("Part I", 1), ("Item 1A. Risk Factors", 1), ("Item 2. Properties", 1), ("Part I", 1), ("Item 1A. Risk Factors", 1), ("text", 0)]),
        "u": ("10-Q", [("a", 0), ("Part I", 0), ("b", 0), ("c", 0), ("d", 0), ("part i", 1)]),
        "v": ("10-K", [("Part I", 1), ("x", 0)]),
    }
    rows = [(d, form, i, t, bool(k)) for d, (form, es) in docs.items() for i, (t, k) in enumerate(es)]
    e = spark.createDataFrame(rows, "doc_id string, form string, pos int, text string, is_title boolean")
    got = {(r.doc_id, r.pos) for r in sections.toc_location(e).collect()}
    assert got == {("t", 1), ("t", 2), ("u", 1), ("u", 2), ("u", 3)}


def test_carried_sections_reset_at_a_title_without_section(spark):
    rows = [("d", 0, "title", "Business", "BUSINESS"), ("d", 1, "table", "t1", None), ("d", 2, "title", "Odd", None), ("d", 3, "table", "t2", None), ("e", 0, "table", "t0", None)]
    e = spark.createDataFrame(rows, "doc_id string, pos int, kind string, text string, section string")
    got = {r.text: (r.section, r.section_title) for r in sections.carry_section(e).collect()}
    assert got == {"t1": ("BUSINESS", "Business"), "t2": (None, "Odd"), "t0": (None, None)}


def test_narrative_state_machine_equals_the_loop(spark):
    rnd = random.Random(12)
    kinds = [("title", "Item 1A. Risk Factors"), ("title", "Item 2. Properties"), ("title", "Market"), ("narrative", "n"), ("list", "l"), ("table", "t")]
    docs = {f"d{k}": [rnd.choice(kinds) for _ in range(rnd.randint(1, 14))] for k in range(60)}
    rows = [(d, "10-K", i, k, t, k == "title") for d, es in docs.items() for i, (k, t) in enumerate(es)]
    e = spark.createDataFrame(rows, "doc_id string, form string, pos int, kind string, text string, is_title boolean")
    got = {(r.doc_id, r.pos) for r in sections.narrative_without_toc(e, sections.is_risk_title(F.col("text"), F.col("form"))).collect()}
    want = set()
    for d, es in docs.items():
        inside, found = False, []
        for i, (k, t) in enumerate(es):
            item = k == "title" and t.startswith("Item")
            if inside:
                if item:
                    if found:
                        break
                    inside = False
                elif k in ("narrative", "list"):
                    found.append((d, i))
            if k == "title" and "Risk" in t:
                inside = True
        want |= set(found)
    assert got == want


RAW = """<SEC-DOCUMENT><TYPE>10-K
<html><head><title>x</title><style>p {}</style></head><body>
<div><b>Item 1. Business</b></div><div>Item 1A. Risk Factors</div>
<h2>Item 1. Business</h2><p>We make cars and batteries for people in many parts of the world.</p><h3>Plants</h3><ul><li>Austin</li><li>Berlin &amp; more</li></ul>
<table><tr><td>a</td><td><p>1</p><table><tr><td>in</td></tr></table></td></tr></table>
<p><strong>Item 1A. Risk Factors</strong></p><p>Much may fail in the coming year, and rates may rise.<br>We say so.</p>
<h2>Item 99. Odd</h2><p>This belongs to no section of the list, however long it may be in the end.</p></body></html>"""


def test_elements_and_sections_of_a_raw_filing(spark):
    df = spark.createDataFrame([("a", "10-K", RAW), ("b", "10-K", None), ("c", "10-Q", ""), ("d", "10-K", "ITEM 1. BUSINESS\n\nWe dig for ore in the north and sell it to the south.\n\nshort")], "doc_id string, form string, raw string")
    e = sections.html_elements(df, "doc_id", "raw", "form")
    kinds = [(r.kind, r.text) for r in e.filter("doc_id = 'a'").orderBy("pos").collect()]
    assert ("table", "a 1 in") in kinds and ("list", "Berlin & more") in kinds and kinds.count(("title", "Item 1A. Risk Factors")) == 2 and ("title", "Plants") in kinds
    got = {(r.doc_id, r.section): (r.section_title, r.text) for r in sections.narrative_sections(e).collect()}
    assert got == {
        ("a", "BUSINESS"): ("Business", "We make cars and batteries for people in many parts of the world.\n\nAustin\n\nBerlin & more"),
        ("a", "RISK_FACTORS"): ("Risk Factors", "Much may fail in the coming year, and rates may rise. We say so."),
        ("d", "BUSINESS"): ("Business", "We dig for ore in the north and sell it to the south."),
    }
    assert sections.html_elements(df.limit(0), "doc_id", "raw").count() == 0


def test_one_pass_equals_the_state_machine_of_each_section(spark):
    from ledgerloom.plans.queries_text import elements

    e = elements(spark).filter("doc_id <> 'b'")
    one = {(r.doc_id, r.text) for r in sections.narrative_sections(e).filter("section = 'RISK_FACTORS'").collect()}
    each = sections.narrative_without_toc(e, sections.is_risk_title(F.col("text"), F.col("form")))
    assert one == {(r.doc_id, r.text) for r in sections.join_blocks(each, ["doc_id"], "pos", "text").collect()}


@pytest.mark.parametrize(("names", "bad"), [(["_ALL"], False), (["BUSINESS", "EXPERTS"], False), ([], False), (["_ALL", "BUSINESS"], True), (["NOPE"], True), (["BUSINESS", "nope"], True)])
def test_section_names(names, bad):
    if not bad:
        return sections.validate_section_names(names)
    with pytest.raises(ValueError):
        sections.validate_section_names(names)


def test_contents_and_narrative_of_hand_made_filings(spark):
    from ledgerloom.plans.queries_text import elements

    e = elements(spark)
    at = lambda df, *cols: sorted(tuple(r[c] for c in cols) for r in df.collect())
    assert at(sections.toc_slice(e), "doc_id", "pos") == [*(("a", i) for i in range(1, 7)), ("b", 0), ("b", 1), ("b", 2)]
    assert at(sections.narrative_without_toc(e, sections.is_risk_title(F.col("text"), F.col("form"))), "doc_id", "pos") == [("a", 13), ("b", 6), ("c", 3), ("c", 4)]
    toc = sections.toc_slice(e).filter("doc_id = 'a' and kind = 'title' and pos < 5").select("doc_id", F.col("pos").alias("toc_pos"), F.col("text").alias("toc_text"))
    assert at(sections.heading_positions(e, toc), "doc_id", "toc_pos", "start_pos") == [("a", 2, 9), ("a", 3, 12), ("a", 4, 14)]
    bounds = spark.createDataFrame([("a", 9, 12), ("c", 2, None)], "doc_id string, start_pos int, end_pos int")
    assert at(sections.narrative_between(e, bounds), "doc_id", "pos") == [("a", 10), ("a", 11), ("c", 3), ("c", 4)]
