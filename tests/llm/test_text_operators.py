"""Splitting, markup, encoding and tokens: pure functions first, then their tables."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import encoding, markup, splitting, tokens

WORDS = st.lists(st.sampled_from(["alpha", "beta.", "gamma,", "\n\n", "\n- item", "é" * 7, "x" * 90, "\r\n", "Item 1.", "\t"]), max_size=120)


@settings(max_examples=60, deadline=None)
@given(WORDS, st.integers(2, 40), st.integers(0, 12), st.sampled_from([64, 200, 4000]))
def test_pieces_cover_and_fit(parts, words, overlap, size):
    overlap = min(overlap, words - 1)
    text = " ".join(parts)
    n = len(text.split())
    pieces = splitting.split_text(text, words, size, overlap)
    assert bool(pieces) == bool(n)
    covered, before = 0, None
    for s, e, a, b, t in pieces:
        assert text[a:b] == t and len(t.encode()) <= size and e - s <= words
        assert s <= covered and e >= covered
        if before and before[1] - before[0] > 0 and s < before[1]:
            assert before[1] - s <= max(overlap, 1)
        covered, before = max(covered, e), (s, e)
    assert covered == n


def test_overlap_is_exact_and_cuts_are_natural():
    text = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(99)) + " end." for i in range(12))
    pieces = splitting.split_text(text)
    assert all(x[1] - y[0] == 80 for x, y in zip(pieces, pieces[1:]))
    assert all(p[4].endswith("end.") for p in pieces)


def test_word_longer_than_the_limit_is_cut_between_characters():
    pieces = splitting.split_text("a " + "é" * 20_000 + " b")
    assert "".join(p[4] for p in pieces if p[0] == 1 and p[1] == 2) .startswith("é" * 100)
    assert sum(p[4].count("é") for p in pieces) == 20_000 and all(len(p[4].encode()) <= 16_384 for p in pieces)


def test_split_table(spark):
    long = "word " * 900
    rows = [(1, long, "x"), (2, None, None), (3, "", "y"), (4, "  \n ", "y"), (5, "short", None), (1, long, "x"), (None, long, "z")]
    df = spark.createDataFrame(rows, "uid bigint, text string, piece_no string")
    out = splitting.split_oversized(df, "uid", "text")
    assert out.columns[:2] == ["uid", "piece_no"] and out.filter("uid = 1").count() == 2 * out.filter("uid is null").count() == 6
    assert splitting.split_oversized(df, "uid", "text", keep_whole=True).filter("uid = 5").count() == 1
    assert splitting.split_oversized(df.limit(0), "uid", "text").count() == 0
    assert "id" in splitting.split_oversized(df, "piece_no", "text").columns


PLAIN = ["R&D and S&P-style textile 4 * 4", "(p < 0.02; n > 79)", "10-K/A \\ insurance ~87 <= 130", "see note [8] and shipment_resin", "between $4 and $36 per payroll", "<3 years; 9^th steel; A&O steel;", "#9 warranty, 'as internal' {net}", "- a - b == n/a", "a | b", "5 > 3", "it's 'so'"]
MARKED = ["a <b>b</b>", "x&nbsp;y", "&#8217;", "<!-- c -->", "**b** c", "__x__ y", "use `a_b` now", "```\ncode\n```", "[t](https://a.example/b)", "![a](b.png)", "## Head", "~~old~~", "|a|b|\n|---|:--:|\n|1|2|", "[[Page|word]]", "{{note|x=1}}", "== Head ==", "'''bold'''", '{| class="wikitable"\n|-\n| a || b\n|}', "$\\frac{a}{b}$", "\\[ x_{t} = \\sum_{i} p_i \\]", "\\section*{Top}", "\\textbf{b}", "\\begin{tabular}{ll} a & b \\\\ \\end{tabular}", "</td> left", "<td align=\"right\"> open"]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_signs_are_no_markup(text):
    assert markup.clean(text) == (text, {}, 0)


@pytest.mark.parametrize("text", MARKED)
def test_markup_is_found_and_gone(text):
    clean, found, _ = markup.clean(text)
    assert found and not markup.marks(clean), (text, clean)


def test_structure_stays_readable():
    page = "<h2>Costs</h2><p>The costs of the plant were <b>high</b> in this year, as we said.</p><ul><li>ore</li><li>coal</li></ul><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2<sup>3</sup></td></tr></table><pre>x = 1\n  y</pre><script>no()</script>"
    assert markup.clean(page)[0] == "Costs\n\nThe costs of the plant were high in this year, as we said.\n\n- ore\n- coal\n\nA | B\n1 | 2^3\n\n    x = 1\n      y"


def test_two_passes_drop_link_lists_and_what_lies_between():
    nav = "".join(f"<p><a href='/{i}'>Another page of this site, number {i}</a></p>" for i in range(3))
    page = nav[: len(nav) // 3] + "<p><a href='/x'>More</a></p>" + nav[len(nav) // 3 :] + "<p>The report of the year is that we were able to pay all of the debt and more.</p>"
    clean, _, dropped = markup.clean(page)
    assert clean.startswith("The report") and dropped == 4


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<table>", "<tr>", "<td>", "</td>", "</table>", "<p", ">", "&", ";", "**", "`", "\\begin{tabular}", "{|", "|}", "|-", "$", "\n", "text", "<!--", "[[", "]]", "<li>", "</ul>", "<pre>", "é"]), max_size=40))
def test_broken_markup_never_raises(parts):
    markup.clean("".join(parts))


def test_markup_table(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "<b>x</b>" * 3000, 3), (4, "plain", 4), (4, "plain", 4)], "k int, text string, n_html int")
    rows = {r.k: r for r in markup.clean_markup(df, "k", "text").collect()}
    assert rows[1].clean_text is None and rows[2].clean_text == "" and rows[3].n_html == 6000 and rows[4].n_html == 0
    assert [r.k for r in markup.clean_markup(df, "k", "text", marked_only=True).collect()] == [3]
    assert markup.clean_markup(df.limit(0), "k", "text").count() == 0


TEXTS = {
    "fr": "Notre filiale étrangère a révisé le coût des matières premières — grâce à l’exercice différé, déjà clôturé.",
    "de": "Das Geschäftsjahr verlängerte die künftigen Erlöse gemäß der Vereinbarung; die Fördermaßnahme kürzte Vorräte.",
    "es": "La compañía revisó el préstamo según ubicación y la línea de crédito durante el último período del año.",
    "ru": "Страховая программа передала долгосрочные обязательства до конца квартала, группа оценила выручку сегмента.",
    "pl": "Spółka zwiększyła środki pieniężne, należności handlowe według średniego kursu; zaległa wartość zapasów.",
    "ja": "同部門は為替の影響により保証債務を増加させた。経営陣は契約に基づき見直した。",
}


@pytest.mark.parametrize("lang", sorted(TEXTS))
@pytest.mark.parametrize("name", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman"])
def test_utf8_read_wrongly_comes_back(lang, name):
    text = TEXTS[lang]
    affected, restored, _, how = encoding.restore("".join(encoding._table(name)[b] for b in text.encode()))
    assert affected and how
    same = sum(a == b for a, b in zip(restored, text))
    assert len(restored) == len(text) and same == len(text)


@pytest.mark.parametrize(("lang", "true", "read"), [("ru", "cp1251", "cp1252"), ("ru", "koi8-r", "cp1251"), ("pl", "cp1250", "cp1252"), ("fr", "cp1252", "cp437"), ("de", "cp1252", "mac_roman"), ("es", "cp1252", "cp1251")])
def test_one_byte_encodings_read_wrongly_come_back(lang, true, read):
    text = TEXTS[lang].replace("—", "-")
    garbled = "".join(encoding._table(read)[b] for b in text.encode(true))
    affected, restored, _, _ = encoding.restore(garbled)
    assert affected and sum(a == b for a, b in zip(restored, text)) >= 0.95 * len(text)


@pytest.mark.parametrize("text", [*TEXTS.values(), "SÃO PAULO, AÇÕES, À VISTA, L’ÂGE", "5 µm ± 3 °C © 2020 § 12", "blank (????) here", "http://a.example/x?y=z", "MAẞNAHMEN", "🙂 👩‍🔧", "سياسة", "why? not"])
def test_right_text_is_left_alone(text):
    assert encoding.restore(text)[:3] == (False, text, False)


def test_mixed_text_keeps_its_right_parts_and_losses_are_seen():
    affected, restored, lost, _ = encoding.restore("Le café reste; la sociÃ©tÃ© paie. ÃÇ")
    assert affected and restored.startswith("Le café reste; la société paie.")
    assert encoding.restore("MA?NAHMEN f�r")[0:3:2] == (True, True)
    assert encoding.restore("rÃƒÂ©sumÃƒÂ©")[1] == "résumé"


def test_encoding_table(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "rÃ©sumÃ© " * 5000, "c"), (4, "ok", "d"), (3, "x", None)], "doc int, text string, path string")
    out = encoding.restore_encoding(df, "doc", "text")
    assert out.count() == 5 and out.filter("affected").select("restored").first()[0].startswith("résumé ")
    assert encoding.restore_encoding(df, "doc", "text", affected_only=True).count() == 1
    assert encoding.restore_encoding(df.limit(0), "doc", "text").count() == 0


@pytest.fixture(scope="module")
def encoder():
    with open(f"{tokens.VOCABULARIES}/byte_bpe_50k.tiktoken", "rb") as f:
        return tokens.Encoder(f.read())


def test_ids_equal_the_public_library(encoder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rnd = random.Random(5)
    texts = [*TEXTS.values(), "<|endoftext|> a", "!'s it's I'LL", "=" * 3001, "ab" * 4000, " 　 x \n\n y", "".join(chr(rnd.choice([rnd.randint(32, 0xD7FF), rnd.randint(0xE000, 0x10FFFF), rnd.randint(32, 126)])) for _ in range(4000))]
    assert [encoder.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=200))
def test_ids_decode_to_the_text(encoder, text):
    back = {v: k for k, v in encoder.ranks.items()}
    assert b"".join(back[i] for i in encoder.encode(text)) == text.encode("utf-8", "surrogatepass")


def test_no_merge_crosses_a_forced_cut(encoder):
    raw = "Ünïcode…naïve".encode()
    for c in encoder.cuts(raw):
        assert encoder._merge(raw) == encoder._merge(raw[:c]) + encoder._merge(raw[c:])


def test_token_table(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "hello world", 0), (3, "hello world", 1), (4, "a" * 50_000, 0)], "d int, text string, ids int")
    rows = tokens.encode(df, "d", "text").collect()
    by = {r.d: r.ids for r in rows}
    assert len(rows) == 5 and by[1] == [] and by[2] == [] and by[3] == [31373, 995]
    n = tokens.encode(df, "d", "text", count_only=True).agg(F.sum("n_tokens")).first()[0]
    assert n == sum(len(r.ids) for r in rows)
    assert tokens.encode(df.limit(0), "d", "text").count() == 0


def test_long_quotations_are_restored():
    import time

    from ledgerloom.llm import encoding

    long = "We expect the demand for coal and ore to stay as strong in the coming year as it was in the year before that one"
    for inner in (long, "We agree.", "We agree,", "We agree\nto sell coal", "x"):
        for a, b in ("ôö", "ìî"):
            affected, text, *_ = encoding.restore(f"They said {a}{inner}{b} in the report.")
            assert affected and text == f"They said “{inner}” in the report."
    apart = "They said ôWe agree\n\nto sell coalö in the report."
    assert encoding.restore(apart)[1] == apart
    start = time.time()
    encoding.restore("ôa " * 200_000 + "ôa" + " b" * 200_000)
    assert time.time() - start < 5


def test_blanks_beyond_the_byte_limit_are_cut(spark):
    from ledgerloom.llm import splitting

    df = spark.createDataFrame([(1, " \n\t" * 12_000), (2, "  "), (3, "a b")], "id bigint, text string")
    got = splitting.split_oversized(df, "id", "text").orderBy("piece_no").collect()
    assert [(r.id, r.piece_no, r.start_token, r.end_token, r.n_bytes) for r in got] == [(1, 0, 0, 0, 16_384), (1, 1, 0, 0, 16_384), (1, 2, 0, 0, 36_000 - 2 * 16_384)]
    assert "".join(r.text for r in got) == " \n\t" * 12_000


LONG = [
    ("html", "a <img src='data:image/png;base64," + "A" * 3000 + "' alt='chart'> b", "a chart b"),
    ("wiki", "a {{infobox\n" + "".join(f"| k{i} = a long value of this field\n" for i in range(25)) + "| {{nested|x}}\n}} b", "a b"),
    ("markdown", "a **" + "bold words " * 200 + "end** b", "a " + "bold words " * 200 + "end b"),
    ("markdown", "a __" + "under lined " * 200 + "end__ b", "a " + "under lined " * 200 + "end b"),
    ("markdown", "a `" + "x" * 900 + "` b", "a " + "x" * 900 + " b"),
    ("markdown", "a [" + "t" * 900 + "](https://a.example/" + "p" * 900 + ") b", "a " + "t" * 900 + " b"),
    ("latex", "a $$" + "x_1 + " * 300 + "y$$ b", None),
    ("html", "a &lt;b&gt;cell&lt;/b&gt; b", "a cell b"),
]


@pytest.mark.parametrize(("kind", "text", "want"), LONG)
def test_constructs_of_any_length_are_found_and_gone(kind, text, want):
    clean, found, _ = markup.clean(text)
    assert kind in found and not markup.marks(clean)
    assert want is None or " ".join(clean.split()) == want


@pytest.mark.parametrize("text", ["<" * 60_000, "a <b " * 30_000, "__a " * 30_000, "{{" * 30_000, "**a " * 30_000, "\\[ a " * 20_000, "[a](" * 20_000, "'' a" * 20_000, "`a" * 30_000, "$a_ " * 20_000, "== a " * 20_000, "\\frac{a}" * 10_000, "&amp" * 30_000, "<!-- " * 20_000, "\\begin{math} " * 10_000])
def test_unclosed_markup_costs_no_more_than_its_length(text):
    import time

    start = time.time()
    markup.clean(text)
    assert time.time() - start < 20


def test_blocks_with_hardly_a_stop_word_inherit():
    links = "<p><a href='/a'>Another page of this site that is to be read, number one</a></p>"
    numbers = "<p>" + "Turbine 4,512 resin 990 gasket 71,002 valve 3,300 smelter 5,120 fleet 88 timber" + "</p>"
    prose = "<p>The report of the year is that we were able to pay all of the debt and more of it.</p>"
    assert markup.clean(prose + numbers + links)[0].count("\n\n") == 1
    assert markup.clean(links + numbers + links + prose)[0].startswith("The report")
    assert markup.clean(links)[0].startswith("Another page")  # the only block stays
    assert markup.clean(prose + "<ul><li><a href='/x'>A long title of some filing here</a></li></ul>")[0].endswith("- A long title of some filing here")


def _words(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_pieces_respect_the_depth_of_headings():
    text = "# A\n" + "".join(f"## A{k}\n{_words(f'a{k}_', 150)}\n" for k in range(3)) + "# B\n" + _words("b", 150)
    starts = [t.split()[80 if k else 0 :][:2] for k, (*_, t) in enumerate(splitting.split_text(text))]
    assert starts == [["#", "A"], ["##", "A2"], ["#", "B"]]


def test_the_first_piece_uses_the_whole_limit_and_headings_stay_with_their_text():
    text = "\n\n".join(_words(f"p{k}_", 100) for k in range(6)) + "\n## Head\n\n" + _words("x", 500)
    pieces = splitting.split_text(text)
    assert pieces[0][:2] == (0, 400) and all(b[0] == a[1] - 80 for a, b in zip(pieces, pieces[1:]))
    assert pieces[1][4].endswith("p5_99") and pieces[2][4].split()[80:84] == ["##", "Head", "x0", "x1"]


def test_lists_are_cut_between_their_outer_items():
    text = "Intro.\n" + "".join(f"- item {k}\n" + "".join(f"    - sub {k}.{j} {_words('w', 40)}\n" for j in range(3)) for k in range(4))
    for *_, piece in splitting.split_text(text)[1:]:
        assert re.sub(r"\s+", " ", piece).split(" ")[80:82] == ["-", "item"]


SIGNED = [
    ("pages 4–5 and 6 – 7 • last", "pages 4{0}5 and 6 {0} 7 {1} last", "–•"),
    ("cost €5 (€6) today", "cost {0}5 ({0}6) today", "€"),
    ("The “strong” firm, “new”.", "The {0}strong{1} firm, {0}new{1}.", "“”"),
]


@pytest.mark.parametrize(("want", "shape", "signs"), SIGNED)
@pytest.mark.parametrize("name", ["cp437", "mac_roman"])
def test_lone_signs_come_back_from_the_code_pages(want, shape, signs, name):
    turned = encoding._turned(("cp1252", name), signs)
    affected, text, _, how = encoding.restore(shape.format(*(turned[c] for c in signs)))
    assert affected and text == want and how == f"cp1252>{name}"


def test_blocks_that_were_signs_and_stray_central_letters():
    assert encoding.restore("5 ▒ 3 m▓, ⌐ 2020")[1] == "5 ± 3 m², © 2020"
    assert encoding.restore("░▒▓ shades ▒▒")[1] == "░▒▓ shades ▒▒"
    west = "La société espagnole a été créée par l’Espańa, mécènes et délégués."
    assert encoding.restore(west)[1] == west.replace("ń", "ñ")
    assert encoding.restore("Gdańsk i Poznań, więcej dań")[0] is False


@pytest.mark.parametrize("pair", [*((u, n) for u in ("utf-8",) for n in encoding.READ_AS[:7]), *encoding.ONE_BYTE[:3], *encoding.CYRILLIC[:6]])
def test_round_trip_of_every_pair_restores_most_words(pair):
    true, read = pair
    langs = ("ru",) if true in ("cp1251", "koi8-r", "cp866") else ("fr", "de", "es")
    for lang in langs:
        text = TEXTS[lang].replace("—", "-").replace("’", "'") if true != "utf-8" else TEXTS[lang]
        garbled = "".join(encoding._table(read)[b] for b in text.encode(true))
        affected, got, *_ = encoding.restore(garbled)
        words = list(zip(text.split(), got.split()))
        assert affected and sum(a == b for a, b in words) >= 0.9 * len(text.split()), (lang, pair, got)


@pytest.mark.parametrize("part", ["rÃ©sumÃ© ", "SpÃ³Å‚ka zwiÄ™kszyÅ‚a ", "Ñòðàõîâàÿ ïðîãðàììà ", "soci\u201at\u201a ", "5 ▒ 3 ", "ôa\u00f6 "])
def test_very_long_garbled_texts_cost_no_more_than_their_length(part):
    import time

    start = time.time()
    affected, *_ = encoding.restore(part * (400_000 // len(part)))
    assert affected and time.time() - start < 30
