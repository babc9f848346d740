"""Sections, items and tables of filings as windows over document elements (doc_id, pos, kind, text)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import rules, text as T


def section_catalog(spark: SparkSession) -> DataFrame:
    """form, ord, section, title, pattern: 52 rows; a dimension of fixed size."""
    known = {n: (t, p) for n, t, p in rules.SECTIONS}
    rows = [(form, i, n, *known[n]) for form, names in (("10-K", rules.SECTIONS_10K), ("10-Q", rules.SECTIONS_10Q), ("S-1", rules.SECTIONS_S1)) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "form string, ord int, section string, title string, pattern string")


EVERY_SECTION = "_ALL"


def validate_section_names(names: list[str]) -> None:
    """ValueError unless the names are catalog sections, or EVERY_SECTION and nothing else."""
    unknown = set(names).difference({EVERY_SECTION}, (name for name, *_ in rules.SECTIONS))
    mixed = EVERY_SECTION in names and len(set(names)) > 1
    problems = [f"{EVERY_SECTION} stands for every section and excludes other names"] * mixed + [f"no such section: {', '.join(sorted(unknown))}"] * bool(unknown)
    if problems:
        raise ValueError("; ".join(problems))


def form_family(form: Column) -> Column:
    return F.when(form.startswith("10-K"), "10-K").when(form.startswith("10-Q"), "10-Q").when(form.startswith("S-1"), "S-1")


def split_by_validity(df: DataFrame, form_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a valid form, and the rejected rows with a reason."""
    form = F.col(form_col)
    reason = F.when(F.coalesce(form, F.lit("")) == "", "Filing type is empty.").when(~form.isin(*rules.VALID_FORMS), F.concat(F.lit("Unexpected filing type: "), form))
    return df.filter(reason.isNull()), df.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def form_from_text(raw: Column) -> Column:
    """The first <type> tag of a submission."""
    return F.nullif(T.strip(F.regexp_extract(raw, r"(?i)<type>([^<\n]*)", 1)), F.lit(""))


def is_risk_title(t: Column, form: Column) -> Column:
    low = F.lower(t)
    report = (low.contains("1a") | low.contains("risk factors")) & ~low.contains("summary")
    return F.when(form.isin(*rules.REPORT_FORMS), report).when(form.isin(*rules.S1_FORMS), F.lower(T.strip(t)) == "risk factors").otherwise(False)


def is_toc_title(t: Column) -> Column:
    return T.clean_title(t).isin("table of contents", "index")


def is_item_title(t: Column, form: Column) -> Column:
    item = T.clean_title(t).rlike("^" + rules.ITEM_TITLE)
    caps = (F.upper(t) == t) & t.rlike(r"\p{L}")
    return F.when(form.isin(*rules.REPORT_FORMS), item).when(form.isin(*rules.S1_FORMS), caps).otherwise(False)


def strip_item(t: Column) -> Column:
    return T.strip(F.regexp_replace(t, rules.ITEM_TITLE, ""))


def match_sections(titles: DataFrame, text_col: str, form_col: str) -> DataFrame:
    """section and section_title beside each row: the first section of the form's list whose pattern is found.

    The catalog becomes one ordered CASE of literals, so the match is a projection: no join, no shuffle."""
    t, form = F.col(text_col), F.col(form_col)
    known = {n: (title, p) for n, title, p in rules.SECTIONS}
    # columns of their own: computed once, and the generated code stays small
    titles = titles.withColumn("_k", T.clean_title(F.when(form.isin(*rules.REPORT_FORMS), strip_item(t)).otherwise(t))).withColumn("_f", form_family(form)).withColumn("_r", is_risk_title(t, form))
    cleaned, family = F.col("_k"), F.col("_f")
    hit = F.lit(None).cast("string")
    for fam, names in (("10-K", rules.SECTIONS_10K), ("10-Q", rules.SECTIONS_10Q), ("S-1", rules.SECTIONS_S1)):
        case = None
        for n in names:
            cond = F.col("_r") if n == "RISK_FACTORS" else cleaned.rlike(known[n][1])
            case = F.when(cond, n) if case is None else case.when(cond, n)
        hit = F.when(family == fam, case).otherwise(hit)
    named = F.create_map(*[F.lit(x) for n, (title, _) in known.items() for x in (n, title)])
    return titles.withColumn("section", hit).withColumn("section_title", F.element_at(named, F.col("section"))).drop("_k", "_f", "_r")


def _doc(doc: str = "doc_id", pos: str = "pos") -> Window:
    return Window.partitionBy(doc).orderBy(pos)


def title_clusters(df: DataFrame, doc: str = "doc_id", pos: str = "pos", eps: int = 6, least: int = 5) -> DataFrame:
    """One-dimensional density clusters of positions by windows: ``cluster`` is -1 for noise. A core has ``least`` points
    within ``eps``; cores at most ``eps`` apart share a cluster; a border point joins the core before it, else after it."""
    w = _doc(doc, pos)
    near = F.count(F.lit(1)).over(w.rangeBetween(-eps, eps))
    d = df.withColumn("_core", near >= least)
    at = F.when(F.col("_core"), F.col(pos))
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    d = d.withColumn("_prev", F.last(at, True).over(before)).withColumn("_next", F.first(at, True).over(after))
    starts = F.col("_core") & (F.col("_prev").isNull() | (F.col(pos) - F.col("_prev") > eps))
    d = d.withColumn("_cid", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    cluster = F.when(F.col("_core"), F.col("_cid")).when(F.col(pos) - F.col("_prev") <= eps, F.col("_cid")).when(F.col("_next") - F.col(pos) <= eps, F.col("_cid") + 1).otherwise(-1)
    return d.withColumn("cluster", cluster.cast("int")).drop("_core", "_prev", "_next", "_cid")


def duplicate_titles(df: DataFrame, doc: str, pos: str, text_col: str, needle: str = "prospectus") -> DataFrame:
    """Titles that occur exactly twice in a document and contain ``needle``: doc, title, first, second position."""
    t = df.withColumn("title", T.clean_title(text_col)).filter(F.col("title").contains(needle))
    return t.groupBy(doc, "title").agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first_pos"), F.max(pos).alias("second_pos")).filter("n = 2").drop("n")


def toc_slice(elements: DataFrame, form_col: str = "form") -> DataFrame:
    """Elements of the table of contents: reports from the first "part i" up to but without the one before the second;
    S-1 between the two occurrences of a title with "prospectus". Fewer than two hits leave nothing."""
    part = F.col(form_col).isin(*rules.REPORT_FORMS) & T.clean_title("text", lower=False).rlike(r"(?i)^part i\b")
    hits = elements.withColumn("_hit", part).filter("_hit").withColumn("_n", F.row_number().over(_doc()))
    reports = hits.groupBy("doc_id").agg(F.min(F.when(F.col("_n") == 1, F.col("pos"))).alias("a"), F.min(F.when(F.col("_n") == 2, F.col("pos"))).alias("b")).filter("b is not null")
    twice = duplicate_titles(elements.filter(F.col(form_col).isin(*rules.S1_FORMS)), "doc_id", "pos", "text")
    s1 = twice.groupBy("doc_id").agg(F.min(F.struct("first_pos", "second_pos")).alias("x")).select("doc_id", F.col("x.first_pos").alias("a"), F.col("x.second_pos").alias("b"))
    return elements.join(reports.unionByName(s1), "doc_id").filter("pos >= a and pos < b - 1").drop("a", "b")


def toc_location(elements: DataFrame, form_col: str = "form") -> DataFrame:
    """Elements of the first title cluster that holds both a risk title and a contents title, sliced; documents without
    such a cluster are sliced as a whole."""
    titles = title_clusters(elements.filter("is_title"))
    both = titles.filter("cluster >= 0").groupBy("doc_id", "cluster").agg(F.max(is_risk_title(F.col("text"), F.col(form_col))).alias("risk"), F.max(is_toc_title(F.col("text"))).alias("toc"))
    first = both.filter("risk and toc").groupBy("doc_id").agg(F.min("cluster").alias("cluster"))
    chosen = titles.join(first, ["doc_id", "cluster"], "left_semi").drop("cluster")
    rest = elements.join(first, "doc_id", "left_anti")
    return toc_slice(chosen.unionByName(rest), form_col)


def narrative_without_toc(elements: DataFrame, is_section: Column, form_col: str = "form") -> DataFrame:
    """The section state machine as windows: a matching title opens a run, the next item title closes it; the first run
    that holds narrative or list text wins; the closing title may open again."""
    form, t = F.col(form_col), F.col("text")
    w = _doc().rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = F.col("is_title") & is_section, F.col("is_title") & is_item_title(t, form)
    d = elements.withColumn("_open", opens).withColumn("_run", F.sum((opens | closes).cast("int")).over(w))
    d = d.withColumn("_on", F.max(F.when(opens, 1).when(closes, 0)).over(Window.partitionBy("doc_id", "_run")))
    # a run opened by a title that is no item title stays open over further matching titles
    d = d.withColumn("_seg", F.sum(closes.cast("int")).over(w))
    body = d.filter((F.col("_on") == 1) & ~F.col("_open") & F.col("kind").isin("narrative", "list"))
    first = body.groupBy("doc_id").agg(F.min("_seg").alias("_seg"))
    return body.join(first, ["doc_id", "_seg"]).select("doc_id", "pos", "kind", "text")


def narrative_sections(elements: DataFrame, form_col: str = "form") -> DataFrame:
    """doc_id, section, section_title, text, n_blocks: the narrative of every section of the form's list.

    The state machine of ``narrative_without_toc`` for all sections at once: a title that matches a section opens a run, an item
    title without a match closes it, other titles belong to the run they stand in. The first run of a section that holds
    narrative or list text wins, so entries of a table of contents, which hold none, open nothing. One shuffle by document."""
    form = F.col(form_col)
    titled = match_sections(elements.withColumn("_t", F.when(F.col("kind") == "title", F.col("text"))), "_t", form_col)
    opens = (F.col("kind") == "title") & F.col("section").isNotNull()
    closes = (F.col("kind") == "title") & is_item_title(F.col("text"), form)
    mark = F.when(opens | closes, F.struct("pos", "section", "section_title"))
    w = _doc().rowsBetween(Window.unboundedPreceding, 0)
    d = titled.withColumn("_run", F.last(mark, True).over(w)).filter(F.col("kind").isin("narrative", "list") & F.col("_run.section").isNotNull())
    d = d.select("doc_id", "pos", "text", F.col("_run.pos").alias("_at"), F.col("_run.section").alias("section"), F.col("_run.section_title").alias("section_title"))
    first = d.withColumn("_first", F.min("_at").over(Window.partitionBy("doc_id", "section"))).filter("_at = _first")
    return join_blocks(first, ["doc_id", "section", "section_title"], "pos", "text")


def heading_positions(elements: DataFrame, toc: DataFrame, form_col: str = "form") -> DataFrame:
    """For each table-of-contents entry (doc_id, toc_pos, toc_text): start_pos, the last element of the document after the
    entry whose cleaned text matches it."""
    e = elements.select("doc_id", "pos", form_col, T.clean_title("text", lower=False).alias("t"))
    k = toc.select("doc_id", "toc_pos", "toc_text", T.clean_title("toc_text", lower=False).alias("k"))
    item = F.col("k").rlike("^" + rules.ITEM_TITLE)
    report = F.when(item, F.col("t").startswith(F.col("k"))).otherwise(strip_item(F.col("t")).startswith(F.col("k")))
    cond = F.when(F.col(form_col).isin(*rules.REPORT_FORMS), report).otherwise(F.col("t") == F.col("k"))
    return k.join(e, "doc_id").filter((F.col("pos") > F.col("toc_pos")) & cond).groupBy("doc_id", "toc_pos", "toc_text").agg(F.max("pos").alias("start_pos"))


def narrative_between(elements: DataFrame, bounds: DataFrame) -> DataFrame:
    """Narrative and list elements of (doc_id, start_pos, end_pos); with a null end up to the next other element."""
    d = elements.join(bounds, "doc_id").filter("pos > start_pos and (end_pos is null or pos < end_pos)")
    d = d.withColumn("_text", F.col("kind").isin("narrative", "list"))
    stop = F.min(F.when(~F.col("_text"), F.col("pos"))).over(Window.partitionBy("doc_id", "start_pos"))
    return d.withColumn("_stop", stop).filter(F.col("_text") & (F.col("end_pos").isNotNull() | F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")))).drop("_text", "_stop")


def join_blocks(df: DataFrame, keys: list[str], order: str, text_col: str, sep: str = "\n\n") -> DataFrame:
    """Texts of a group joined in order; blank ones are left out. A group is a section of one document."""
    d = df.withColumn("_t", T.strip(text_col)).filter("_t <> ''")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_t").alias("t")))), lambda x: x["t"])
    return d.groupBy(*keys).agg(F.array_join(parts, sep).alias("text"), F.count(F.lit(1)).alias("n_blocks"))


def carry_section(elements: DataFrame) -> DataFrame:
    """Tables with the section of the title before them; a title that matches nothing resets the section to null."""
    w = _doc().rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == "title", F.struct("section", F.col("text").alias("title"))), True).over(w)
    return elements.withColumn("_s", last).filter("kind = 'table'").select("doc_id", "pos", "text", F.col("_s.section").alias("section"), F.col("_s.title").alias("section_title"))


def item_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ord, item, text: blocks from each item label up to the next one (10-K family); text before the first is dropped."""
    parts = F.split(F.col(text_col), rf"(?={rules.ITEM_LABEL})")
    d = df.select(F.col(id_col), F.posexplode(parts).alias("ord", "block"))
    item = F.upper(F.regexp_extract("block", "^" + rules.ITEM_LABEL.replace(r"\s+(", r"\s+(?:").replace("(?i)", "(?i)(") + ")", 1))
    return d.withColumn("item", item).filter("item <> ''").select(id_col, "ord", "item", T.normalize_ws(html_to_text(F.col("block"))).alias("text")).filter("text <> ''")


def html_to_text(block: Column) -> Column:
    """Scripts and styles removed, tags to blanks, the common entities decoded (ampersand last)."""
    t = F.regexp_replace(block, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for k, v in (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&")):
        t = F.replace(t, F.lit(k), F.lit(v))
    return t


_TAGS = re.compile(r"<(/?)(h[1-6]|table)\b[^>]*>", re.I)
_ITEM = re.compile(rules.ITEM_LABEL)


def scan_tables(source: str) -> list[tuple[int, str | None, str | None, str, str]]:
    """(ordinal, item label, heading, text, html) of every table with text, with the nearest heading that begins before it.
    Nested tables count by themselves."""
    plain = lambda s: re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", s)))).strip()
    heading, open_heading, stack, out = None, None, [], []
    for m in _TAGS.finditer(source):
        close, name = m.group(1), m.group(2).lower()
        if name != "table":
            if close and open_heading is not None:
                heading, open_heading = plain(source[open_heading : m.start()]), None
            elif not close:
                open_heading = m.end()
        elif not close:
            stack.append((m.start(), heading if open_heading is None else plain(source[open_heading : m.start()]), len(out)))
            out.append(None)
        elif stack:
            start, h, slot = stack.pop()
            out[slot] = (start, h, source[start : m.end()])
    for start, h, slot in stack:  # never closed
        out[slot] = (start, h, source[start:])
    rows = []
    for part in out:
        if part and (text := plain(part[2])):
            label = _ITEM.search(part[1] or "")
            rows.append((len(rows), label.group().strip().upper() if label else None, part[1], text, part[2]))
    return rows


def html_tables(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, ord, section, section_title, text, html of each table of an HTML column. Narrow; rows without a table stay in
    the JVM."""
    src = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).filter(F.col("html").rlike("(?i)<table"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for k, h in enumerate(batch.column(1).to_pylist()):
                found = scan_tables(h)
                take += [k] * len(found)
                rows += found
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["id", "ord", "section", "section_title", "text", "html"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, ord int, section string, section_title string, text string, html string").withColumnRenamed("id", id_col)


_BREAK = re.compile(r"<(/?)(h[1-6]|p|div|li|ul|ol|table|title|blockquote|center|tr|td|th|br|hr|body|html|document|text|type)\b[^<>]*>", re.I)
_BOLD = re.compile(r"\s*<(b|strong|u)\b[^<>]*>(.*)</\1\s*>\s*", re.I | re.S)
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_RUN = re.compile(f"[{T.BLANKS}]+")
#: A paragraph of so many words is narrative, one of fewer needs the end of a sentence; a title has at most TITLE_WORDS.
NARRATIVE_WORDS, SENTENCE_WORDS, TITLE_WORDS = 15, 8, 14


def element_kind(tag: str, text: str, bold: bool) -> str:
    """What a block is: by its element where that says it, else by its words."""
    if tag[0] == "h" and tag[1:].isdigit() or tag == "title":
        return "title"
    if tag in ("li", "table"):
        return "list" if tag == "li" else "table"
    n = text.count(" ") + 1
    if n >= NARRATIVE_WORDS or n >= SENTENCE_WORDS and text[-1] in ".!?":
        return "narrative"
    heading = bold or re.match(r"(?i)(?:item|part)\s+[0-9ivx]+[a-c]?\b", text) or text.isupper()
    return "title" if heading and n <= TITLE_WORDS and text[-1] not in ",;" else "text"


def scan_elements(source: str) -> list[tuple[str, str]]:
    """(kind, text) of the blocks of a filing in order. A table is one block; text without tags is cut at blank lines."""
    source = _HIDDEN.sub(" ", source)
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    tag, tables, skip, at = "", 0, False, 0

    def close() -> None:
        raw = "".join(parts)
        parts.clear()
        bold = _BOLD.fullmatch(raw) is not None
        for piece in [raw] if tag else re.split(r"\n[ \t\r]*\n", raw):
            if text := _RUN.sub(" ", unescape(re.sub(r"<[^<>]+>", "" if not tables else " ", piece))).strip(" "):
                out.append((element_kind(tag or "p", text, bold), text))

    for m in _BREAK.finditer(source):
        if not skip:
            parts.append(source[at : m.start()])
        at, end, name = m.end(), bool(m.group(1)), m.group(2).lower()
        skip = False
        if name == "type" and not tables:  # the form's tag has no closing one: its value ends with the line
            close()
            at = re.compile(r"[^<\n]*").match(source, at).end()
        elif name == "table":
            if not tables or end and tables == 1:
                close()
                tag = "" if end else "table"
            tables = max(0, tables + (-1 if end else 1))
        elif tables or name in ("br", "tr", "td", "th"):
            parts.append(" ")
        else:
            close()
            tag = "" if end or name in ("ul", "ol", "body", "html", "document", "text", "hr", "center") else name
    parts.append(source[at:])
    close()
    return out


def html_elements(df: DataFrame, id_col: str, html_col: str, *keep: str) -> DataFrame:
    """doc_id, pos, kind (title, narrative, list, table, text), text, is_title and the columns ``keep`` of every block of raw
    filings: the input of the section operators. Narrow: no shuffle."""
    src = df.select(F.col(html_col).cast("string").alias("raw"), F.col(id_col).alias("doc_id"), *keep).filter("raw is not null")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.drop("raw").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for k, raw in enumerate(batch.column(0).to_pylist()):
                found = scan_elements(raw)
                take += [k] * len(found)
                rows += [(i, *e) for i, e in enumerate(found)]
            cols = list(zip(*rows)) if rows else [[]] * 3
            at = pa.array(take, pa.int64())
            names = [*batch.schema.names[1:], "pos", "kind", "text"]
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[1:]), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=names)

    return src.mapInArrow(run, f"{kinds}, pos int, kind string, text string").withColumn("is_title", F.col("kind") == "title")
