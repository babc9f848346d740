"""Markup residue: HTML, Markdown, wiki and LaTeX turned into clean text that keeps headings, lists, cells, code and formulas.

A text is first cut into blocks (heading, list item, table row, code, formula, paragraph), whatever markup it is written
in. The block parser counts every construct where it turns it into text; a text in which it found none has no markup. No
construct is bounded in length: openers and closers are paired within their paragraph, line or tag by scans that are linear
in the text. The blocks are then judged in two passes. Pass one looks at each alone: lists, tables, code and formulas are
kept; the share of characters inside links and the share of stop words, with the length, make a block good, bad or undecided
(short, or long with hardly a stop word). Pass two gives undecided blocks the label of the nearest decided neighbours: bad
only between bad ones. The only block of a text always stays.

Signs in their plain sense (``R&D``, ``p < 0.02``, ``4 * 4``, ``[8]``, ``{net}``, ``$4 and $36``, ``a_b``) are no markup.

Defined results: a null text gives null with no markup; empty and blank texts give themselves; a text without markup comes
out unchanged; malformed, nested or unclosed markup is cut at the end of the text at the latest, nothing raises; repeated
rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: LaTeX commands that are markup by their name alone (fixed values).
_COMMANDS = (
    "begin end section subsection subsubsection chapter paragraph textbf textit texttt textsc textsf textrm textup textsl textmd textnormal emph frac dfrac tfrac sqrt underline mathrm mathbf mathit item label ref cite "
    "footnote caption href url title author multicolumn hline cline toprule midrule bottomrule sum prod int cdot times alpha beta gamma delta Delta epsilon lambda mu sigma theta pi infty leq geq neq approx pm left right quad "
    "hspace vspace noindent par documentclass usepackage overline hat bar vec partial nabla ldots dots"
).split()
_COMMAND = re.compile(r"\\(?:" + "|".join(sorted(_COMMANDS, key=len, reverse=True)) + r")(?![A-Za-z])\*?")
_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


class Found(dict):
    """How often each kind of markup was turned into text."""

    def add(self, kind: str, n: int = 1) -> None:
        if n:
            self[kind] = self.get(kind, 0) + n

    def decode(self, s: str) -> str:
        """Character references that HTML knows; others are plain text."""
        if "&" not in s:
            return s

        def one(m: re.Match) -> str:
            name = m.group()[1:]
            if name[0] != "#" and name not in html5:
                return m.group()
            self.add("html")
            return html.unescape(m.group())

        return _ENTITY.sub(one, s)


def marks(text: str | None) -> dict[str, int]:
    """How often each kind of markup occurs: what the block parser finds."""
    found = Found()
    if text:
        to_blocks(text, found)
    return found


_STOP = frozenset(
    "a an and are as at be by for from had has have in is it its no not of on or our such that the their these this to under was we were which will with any each every may could "
    "der die das und ist mit von den im für le la les des et en un une du que el los las y de por con o e do da em".split()
)
_WORDS = re.compile(r"[^\W\d_]+")
LINK_BAD, LINK_SOME, STOP_GOOD, STOP_SOME, SHORT = 0.5, 0.2, 0.2, 0.05, 70
KEPT = frozenset(("row", "code", "formula"))


class Block:
    __slots__ = ("kind", "text", "linked", "level")

    def __init__(self, kind: str, text: str, linked: int = 0, level: int = 0):
        self.kind, self.text, self.linked, self.level = kind, text, linked, level


def classify(blocks: list[Block]) -> list[bool]:
    """True for the blocks that stay."""
    first: list[bool | None] = []
    for b in blocks:
        size = max(len(b.text), 1)
        density = b.linked / size
        if b.kind in KEPT or b.kind.startswith("item") or len(blocks) == 1:
            first.append(True)
            continue
        if size < SHORT and not b.linked:
            first.append(None)
            continue
        words = _WORDS.findall(b.text.lower())
        stops = sum(w in _STOP for w in words) / max(len(words), 1)
        if density > LINK_BAD:
            first.append(False if size >= 25 or stops < STOP_GOOD else None)
        elif size < SHORT or density > LINK_SOME:
            first.append(None)
        else:
            first.append(True if stops >= (STOP_GOOD if b.linked else STOP_SOME) else None)
    out: list[bool] = []
    after: list[bool | None] = [None] * len(first)
    nxt = None
    for i in range(len(first) - 1, -1, -1):
        after[i] = nxt
        nxt = first[i] if first[i] is not None else nxt
    before = None
    for i, label in enumerate(first):
        if label is None:
            near = {x for x in (before, after[i]) if x is not None}
            out.append(near != {False} or blocks[i].kind == "heading" and after[i] is not False)
        else:
            out.append(label)
            before = label
    return out


#: Elements whose tags are residue even where their brackets were written as references (fixed values).
_ELEMENTS = "a b br div em font h1 h2 h3 h4 h5 h6 hr i img li ol p span strong sub sup table tbody td th thead tr u ul".split()
_WRITTEN_OUT = re.compile(r"&lt;(/?(?:" + "|".join(_ELEMENTS) + r")(?:\s[^<>&]*)?/?)&gt;", re.I)
_SPACE = re.compile(r"[ \t\r\f\v\u00a0\u2000-\u200b\u202f\u205f\u3000\ufeff]+")
_GONE = re.compile(r"<!--.*?(?:-->|\Z)|-->|<(script|style|noscript|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[|\]\]>|<[!?][A-Za-z][^<>]*>", re.I | re.S)
_TOKEN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:\s[^<>]*)?)/?>")
_BREAKS = frozenset("p div section article header footer main aside nav ul ol dl table thead tbody tfoot form fieldset figure figcaption address blockquote hr body html head title center".split())
_MARK_UP = {"sup": "^", "sub": "_"}


def _tidy(s: str) -> str:
    return _SPACE.sub(" ", s).strip()


def _html_blocks(source: str, found: Found) -> list[Block]:
    """Blocks of an HTML text: a scanner over tags, so malformed and unclosed markup needs no tree."""
    if "&lt;" in source and "<pre" not in source.lower():
        source = _WRITTEN_OUT.sub(r"<\1>", source)
    source, n = _GONE.subn(" ", source)
    found.add("html", n)
    blocks: list[Block] = []
    buf: list[str] = []
    cells: list[str] | None = None
    depth_row, linked, in_link, code, kind, level = 0, 0, 0, 0, "text", 0
    lists: list[list] = []

    def flush(next_kind: str = "text", next_level: int = 0) -> None:
        nonlocal linked, kind, level
        raw = "".join(buf)
        buf.clear()
        if kind == "code":
            text = raw.strip("\n").rstrip()
            if text.strip():
                blocks.append(Block("code", text))
        else:
            for k, part in enumerate(raw.split("\n\n")):
                if text := "\n".join(t for t in map(_tidy, part.split("\n")) if t):
                    blocks.append(Block(kind if k == 0 else "text", text, min(linked, len(text)), level))
        linked, kind, level = 0, next_kind, next_level

    def end_cell() -> None:
        if cells is not None:
            cells.append(_tidy("".join(buf).replace("\n", " ")))
            buf.clear()

    def end_row() -> None:
        nonlocal cells, linked
        if cells is not None:
            if "".join(buf).strip():
                end_cell()
            buf.clear()
            if any(cells):
                while cells and not cells[-1]:
                    cells.pop()
                blocks.append(Block("row", " | ".join(cells)))
            cells, linked = None, 0

    pos = 0
    for m in _TOKEN.finditer(source):
        piece = found.decode(source[pos : m.start()])
        pos = m.end()
        found.add("html")
        if piece:
            buf.append(piece if code else piece.replace("\r\n", "\n").replace("\r", "\n"))
            if in_link:
                linked += len(piece)
        close, name, attrs = m.group(1), m.group(2).lower(), m.group(3)
        if name in ("pre", "code", "samp", "kbd") and (name == "pre" or code):
            if name == "pre" and cells is None:
                code = 0 if close else 1
                flush("text" if close else "code")
        elif name == "code":
            pass
        elif code and name != "br":
            pass
        elif name == "tr":
            if not close and cells is not None and buf:
                end_cell()  # a table inside a cell
            end_row()
            if not close:
                flush()
                cells = []
        elif name in ("td", "th"):
            if cells is None and not close:
                flush()
                cells = []
            if close or "".join(buf).strip():
                end_cell()
        elif name == "table":
            end_row()
            flush()
        elif re.fullmatch("h[1-6]", name):
            end_row()
            flush(*(("text", 0) if close else ("heading", int(name[1]))))
        elif name == "caption":
            end_row()
            flush("text" if close else "heading", 0 if close else 4)
        elif name in ("ul", "ol", "dl", "menu"):
            if cells is None:
                flush()
            if close:
                lists[-1:] = []
            else:
                lists.append([name, 0])
        elif name in ("li", "dt", "dd"):
            if cells is not None:
                buf.append(" ")
            elif close:
                flush()
            else:
                if lists:
                    lists[-1][1] += 1
                    flush("item" if lists[-1][0] != "ol" else f"item{lists[-1][1]}", len(lists))
                else:
                    flush("item", 1)
        elif name == "br":
            buf.append(" " if cells is not None else "\n")
        elif name in _BREAKS:
            if cells is None:
                flush()
            else:
                buf.append(" ")
        elif name in _MARK_UP:
            if not close and buf and buf[-1][-1:].strip():
                buf.append(_MARK_UP[name])
        elif name == "a":
            in_link = 0 if close else 1
        elif name == "img" and (alt := re.search(r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", attrs, re.I)):
            buf.append(alt.group(1) or alt.group(2) or "")
    rest = found.decode(re.sub(r"<[/!]?[A-Za-z][^<>]*\Z", "", source[pos:]))
    if rest:
        buf.append(rest)
    end_row()
    flush()
    return blocks


_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]\n]*\|)?([^\[\]|\n]*)\]\]")
_URL = r"(?:[a-z]{2,10}:|#|/|\.|[\w.-]+\.[a-z]{2,4}\b)[^()\s]*(?:\s\"[^\"\n]*\")?"
#: (kind, pattern, text): runs exclude their own sign, so each part of a text is looked at once.
_INLINE = [
    ("markdown", re.compile(r"!\[([^\[\]\n]*)\]\([^()\n]*\)"), r"\1"),
    ("markdown", re.compile(rf"\[([^\[\]\n]*)\]\({_URL}\)"), "\x02\\1\x03"),
    ("wiki", _WIKI_LINK, "\x02\\1\x03"),
    ("markdown", re.compile(r"!?\[([^\[\]\n]+)\]\[[^\[\]\n]*\]"), r"\1"),
    ("markdown", re.compile(r"(?m)^\[([^\]\n]+)\]:[ \t]+(?=\S)"), r"\1: "),
    ("wiki", re.compile(r"(?<!\w)\[(?:https?|ftp)://[^\s\]]+(?:\s([^\]\n]*))?\]"), "\x02\\1\x03"),
    ("markdown", re.compile(r"\*\*(?=\S)((?:[^*\n]|\n(?!\n))+)(?<=\S)\*\*"), r"\1"),
    ("markdown", re.compile(r"(?<![\w*])\*(?=[^\s*\d])([^*\n]+)(?<=[^\s*])\*(?![\w*])"), r"\1"),
    ("markdown", re.compile(r"~~(?=\S)((?:[^~\n]|\n(?!\n))+)(?<=\S)~~"), r"\1"),
    ("wiki", re.compile(r"'''?(?=\S)((?:[^'\n]|\n(?!\n))+)(?<=\S)'''?"), r"\1"),
    ("markdown", re.compile(r"```+"), " "),
    ("markdown", re.compile(r"(?<![`\w])`([^`\n]+)`(?![`\w])"), r"\1"),
    ("wiki", re.compile(r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__"), " "),
    ("wiki", re.compile(r"\{\|(?:[ \t\u00a0])*(?:(?:class|style|border)[^\n]*|$)"), " "),
]
_UNDERLINED = re.compile(r"(?<![\w_])__(?=[^\s_])|(?<=[^\s_])__(?![\w_])|\n\n")
_BRACES = re.compile(r"\{\{|\}\}")


def _underlined(s: str, found: Found) -> str:
    """``__x__`` within a paragraph: the first opener meets the next closer."""
    if "__" not in s:
        return s
    cut: list[int] = []
    opened = None
    for m in _UNDERLINED.finditer(s):
        if m.group() == "\n\n":
            opened = None
        elif opened is not None and m.start() > opened + 2 and s[m.start() - 1] not in " \t\n_" and not (s[m.end() : m.end() + 1].isalnum() or s[m.end() : m.end() + 1] == "_"):
            cut += [opened, m.start()]
            opened = None
            found.add("markdown")
        elif opened is None and s[m.end() : m.end() + 1].strip() and not (m.start() and (s[m.start() - 1].isalnum() or s[m.start() - 1] == "_")):
            opened = m.start()
    if not cut:
        return s
    return "".join(s[a:b] for a, b in zip([0, *(c + 2 for c in cut)], [*cut, len(s)]))


def _templates(s: str, found: Found) -> str:
    """``{{...}}`` of any length, over several lines and nested, is removed; what is not closed stays."""
    if "{{" not in s:
        return s
    stack: list[int] = []
    gone: list[tuple[int, int]] = []
    for m in _BRACES.finditer(s):
        if m.group() == "{{":
            stack.append(m.start())
        elif stack:
            start = stack.pop()
            if m.start() > start + 2:
                while gone and gone[-1][0] > start:
                    gone.pop()
                gone.append((start, m.end()))
    found.add("wiki", len(gone))
    if not gone:
        return s
    return "".join(s[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(b for b, _ in gone), len(s)]))


_FRAC = re.compile(r"\\[dt]?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}")
_SQRT = re.compile(r"\\sqrt\s*\{([^{}]*)\}")
_WRAP = re.compile(r"\\(?:text[a-z]{2}|textnormal|text|emph|underline|math[a-z]{2,3}|overline|hat|bar|vec|footnote|caption|title|author|ref|cite|url)\*?\s*\{([^{}]*)\}")
_HREF = re.compile(r"\\href\s*\{[^{}]*\}\s*\{([^{}]*)\}")
_DROPPED = re.compile(r"\\(?:label|hspace|vspace|documentclass|usepackage)\*?(?:\[[^\]]*\])?\{[^{}]*\}|\\(?:noindent|par|left|right|quad|hline|cline\{[^{}]*\}|toprule|midrule|bottomrule|begin\{[^{}]*\}|end\{[^{}]*\})(?![A-Za-z])")
_SYMBOL = {
    "sum": "∑", "prod": "∏", "int": "∫", "cdot": "·", "times": "×", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "Delta": "Δ", "epsilon": "ε", "lambda": "λ", "mu": "μ", "sigma": "σ", "theta": "θ",
    "pi": "π", "infty": "∞", "leq": "≤", "geq": "≥", "neq": "≠", "approx": "≈", "pm": "±", "ldots": "…", "dots": "…", "partial": "∂", "nabla": "∇",
}
_SYMBOLS = re.compile(r"\\(" + "|".join(sorted(_SYMBOL, key=len, reverse=True)) + r")(?![A-Za-z])")


def _formula(s: str, found: Found) -> str:
    """A readable line for LaTeX mathematics; tags, references and links inside it are residue as anywhere else."""
    s = _WIKI_LINK.sub(r"\1", _TOKEN.sub("", found.decode(s)))
    s = re.sub(r"\\[\[\]]", " ", s)
    while True:  # each step takes a command away
        new = _SQRT.sub(r"√(\1)", _FRAC.sub(lambda m: f"({m.group(1)})/({m.group(2)})", _WRAP.sub(r"\1", s)))
        if new == s:
            break
        s = new
    s = _SYMBOLS.sub(lambda m: _SYMBOL[m.group(1)], _DROPPED.sub("", s))
    s = re.sub(r"([_^])\{([^{}]{1,3})\}", r"\1\2", s)
    s = re.sub(r"([_^])\{([^{}]*)\}", r"\1(\2)", s)
    return _tidy(re.sub(r"\\([&%$#_{}])", r"\1", s).replace("{", "").replace("}", ""))


_TABULAR = re.compile(r"\\begin\{(tabular|array|longtable)\*?\}(?:\[[^\]]*\])?(?:\{[^{}\n]*\})?(.*?)(?:\\end\{\1\*?\}|\Z)", re.S)
_DISPLAY = re.compile(r"\\\[((?:(?!\\[\[\]]).)*)\\\]|\$\$((?:[^$\n]|\n(?!\s*\n))+)\$\$|\\begin\{(equation|align|gather|displaymath|math)\*?\}((?:(?!\\begin\{).)*?)\\end\{\3\*?\}", re.S)
_MATH = re.compile(r"(?<![\\$\w])\$(?=[^\s$\d])(?=[^$\n]*[\\^_={}])([^$\n]*)(?<=\S)\$(?![\d$])|\\\(([^()\n]*)\\\)")
_SECTION = re.compile(r"\\((?:sub){0,2})(?:section|chapter|paragraph)\*?\s*\{([^{}]*)\}[ \t]*")
_ESCAPED = re.compile(r"(?<=[A-Za-z0-9 ])\\([&%$#_])(?=[\s\w])")
_FENCE = re.compile(r"(?m)^[ \t]{0,3}(```|~~~)[^\n`]*\n(.*?)(?:^[ \t]{0,3}\1[ \t]*$|\Z)", re.S)
_WIKI_TABLE = re.compile(r"(?m)^[ \t]*\{\|.*?(?:^[ \t]*\|\}[ \t]*|\Z)", re.S)
_RULE = re.compile(r"[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*")
_CODES = re.compile("\x00([0-9]+)\x01")


def _latex_rows(body: str, found: Found) -> str:
    rows = []
    for row in re.split(r"\\\\(?:\[[^\]]*\])?|\n", body):
        cells = [_formula(c, found) for c in re.split(r"(?<!\\)&", row)]
        if any(cells):
            rows.append(" | ".join(cells))
    return "\n".join(rows)


def _wiki_rows(source: str) -> str:
    rows: list[list[str]] = [[]]
    for line in source.split("\n")[1:]:
        line = line.strip()
        if line.startswith("|}"):
            break
        if line.startswith("|-"):
            rows.append([])
        elif line.startswith("|+"):
            rows.insert(0, [line[2:].strip()])
        elif line[:1] in "|!":
            for cell in re.split(r"\|\||!!", line[1:]):
                cell = re.sub(r"^\s*(?:[a-z]+\s*=\s*\"[^\"]*\"\s*)+\|(?!\|)", "", cell)
                rows[-1].append(cell.strip())
        elif line and rows[-1]:
            rows[-1][-1] += " " + line
    return "\n".join(" | ".join(r) for r in rows if any(r))


def _cells(rows: str, found: Found) -> str:
    """Rows of a table of another markup without the residue inside their cells."""
    rows = found.decode(_TOKEN.sub(" ", _GONE.sub(" ", _WRITTEN_OUT.sub(r"<\1>", rows))))
    return "\n".join(_inline(r, found)[0] for r in rows.split("\n"))


def to_blocks(text: str, found: Found) -> list[Block]:
    """Blocks of a text in any mixture of the four kinds of markup; ``found`` counts what was turned into text."""
    held: list[Block] = []

    def hold(what: str, kind: str, body: str) -> str:
        found.add(what)
        held.append(Block(kind, body))
        return f"\n\x00{len(held) - 1}\x01\n"

    def math(m: re.Match) -> str:
        found.add("latex")
        return _formula(m.group(1) or m.group(2) or "", found)

    def section(m: re.Match) -> str:
        found.add("latex")
        return f"\n{'#' * (1 + m.group(1).count('sub'))} {m.group(2)}\n"

    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "").replace("\x01", "")
    text = _FENCE.sub(lambda m: hold("markdown", "code", m.group(2).strip("\n").rstrip()), text)
    text = _WIKI_TABLE.sub(lambda m: hold("wiki", "row", _cells(_wiki_rows(m.group()), found)), text)
    if "\\" in text or "$" in text:
        text = _TABULAR.sub(lambda m: hold("latex", "row", _cells(_latex_rows(m.group(2), found), found)), text)
        text = _DISPLAY.sub(lambda m: hold("latex", "formula", _formula(m.group(1) or m.group(2) or m.group(4) or "", found)), text)
        text = _SECTION.sub(section, text)
        text = _MATH.sub(math, text)
    text = _templates(text, found)
    out: list[Block] = []
    for block in _html_blocks(text, found):
        if block.kind == "code":
            out.append(block)
            continue
        lines = block.text.split("\n")
        para: list[str] = []
        linked = block.linked

        def close(kind: str = "text") -> None:
            nonlocal linked
            if para:
                body, links = _inline("\n".join(para), found)
                if body:
                    out.append(Block(kind if not block.kind.startswith("item") else block.kind, body, min(len(body), links + linked), block.level))
                para.clear()
                linked = 0

        for n, line in enumerate(lines):
            if m := _CODES.fullmatch(line.strip()):
                close()
                out.append(held[int(m.group(1))])
            elif m := re.fullmatch(r"[ \t]{0,3}(#{1,6})[ \t]+(?=\S)(.+)", line):
                found.add("markdown")
                close()
                out.append(Block("heading", _inline(m.group(2).rstrip(" \t#"), found)[0], 0, len(m.group(1))))
            elif m := re.fullmatch(r"[ \t]*(={2,6})([^=\n]*[^=\s][^=\n]*)={2,6}[ \t]*", line):
                found.add("wiki")
                close()
                out.append(Block("heading", _inline(m.group(2).strip(), found)[0], 0, len(m.group(1))))
            elif re.fullmatch(r"(?:={3,}|-{3,})[ \t]*", line):
                if para and "|" not in para[-1]:
                    found.add("markdown")
                if len(para) == 1:
                    body = _inline(para.pop(), found)[0]
                    out.append(Block("heading", body, 0, 1 if line[0] == "=" else 2))
                else:
                    close()
            elif _RULE.fullmatch(line):
                found.add("markdown")
            elif re.match(r"\|[}-]", line):  # what is left of a wiki table
                found.add("wiki")
                close()
            elif line.strip().startswith("|") and line.count("|") > 1 or n + 1 < len(lines) and "|" in line and _RULE.fullmatch(lines[n + 1]):
                close()
                cells = [_inline(c.strip(), found)[0] for c in line.strip().strip("|").split("|")]
                if any(cells):
                    out.append(Block("row", " | ".join(cells)))
            elif m := re.match(r"([ \t]*)([*+-]|\*{2,4}|#{2,4}(?=\S))[ \t]+(?=\S)", line):
                if m.group(2) in ("*", "+") and len(m.group(1)) < 4:
                    found.add("markdown")
                close()
                body, links = _inline(line[m.end() :], found)
                if body:
                    out.append(Block("item", body, links, 1))
            elif m := re.match(r"[ \t]{0,3}>[ \t]+([A-Za-z]?)", line):
                if m.group(1):
                    found.add("markdown")
                para.append(line[m.start(1) :])
            else:
                if m := re.match(r"[ \t]*\\item(?![A-Za-z])[ \t]*", line):
                    found.add("latex")
                    line = "- " + line[m.end() :]
                para.append(line)
        if block.kind in ("row", "heading"):
            body, links = _inline(" ".join(para), found)
            if body:
                out.append(Block(block.kind, body, links, block.level))
            para.clear()
        close()
    return [Block(b.kind, _CODES.sub(lambda m: held[int(m.group(1))].text.replace("\n", "; "), b.text), b.linked, b.level) for b in out]


def _inline(s: str, found: Found) -> tuple[str, int]:
    """Inline signs removed, and the number of characters that were a link's."""
    s = _underlined(s, found)
    for kind, p, to in _INLINE:
        s, n = p.subn(to, s)
        found.add(kind, n)
    if "\\" in s:
        found.add("latex", len(_COMMAND.findall(s)))
        s = _HREF.sub("\x02\\1\x03", s)
        while (new := _FRAC.sub(r"(\1)/(\2)", _WRAP.sub(r"\1", s))) != s:  # each step takes a command away
            s = new
        s = _COMMAND.sub(" ", _SYMBOLS.sub(lambda m: _SYMBOL[m.group(1)], _DROPPED.sub("", s)))
        s, n = _ESCAPED.subn(r"\1", s)
        found.add("latex", n)
        s, n = re.subn(r"\\[\[\]]", " ", s)
        found.add("latex", n)
    linked = sum(len(x) for x in re.findall("\x02([^\x02\x03]*)\x03", s))
    s = s.replace("\x02", "").replace("\x03", "")
    return "\n".join(t for t in map(_tidy, s.split("\n")) if t), linked


def clean(text: str | None) -> tuple[str | None, dict[str, int], int]:
    """(clean text, occurrences of markup by kind, blocks dropped)."""
    found = Found()
    blocks = to_blocks(text, found) if text else []
    if not found:
        return text, {}, 0
    keep = classify(blocks)
    out, before = [], ""
    for b, k in zip(blocks, keep):
        if not k or not b.text:
            continue
        body = b.text
        if b.kind.startswith("item"):
            body = "  " * (max(b.level, 1) - 1) + (b.kind[4:] + ". " if b.kind[4:] else "- ") + body
        elif b.kind == "code":
            body = "\n".join("    " + x for x in body.split("\n"))
        tight = b.kind == before and b.kind in ("row", "code") or b.kind[:4] == before[:4] == "item"
        out.append(("\n" if tight else "\n\n") + body if out else body)
        before = b.kind
    return "".join(out), found, len(keep) - sum(keep)


def clean_markup(df: DataFrame, id_col: str, text_col: str, marked_only: bool = False) -> DataFrame:
    """``id_col``, clean_text, n_html, n_markdown, n_wiki, n_latex, n_dropped for every row (or those with markup).
    Narrow: no shuffle. With ``marked_only`` rows that hold none of the signs all markup is written with stay in the JVM."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if marked_only:
        src = src.filter(F.col("text").rlike(r"[<>&#*_`~\[\]{}|=\\$]|''|(?m)^[+>-]"))
    counts = ["n_html", "n_markdown", "n_wiki", "n_latex"]
    schema = f"id {src.schema['id'].dataType.simpleString()}, clean_text string, {', '.join(c + ' int' for c in counts)}, n_dropped int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [clean(t) for t in batch.column(1).to_pylist()]
            cols = [batch.column(0), pa.array([d[0] for d in done], pa.string())]
            cols += [pa.array([d[1].get(c[2:], 0) for d in done], pa.int32()) for c in counts] + [pa.array([d[2] for d in done], pa.int32())]
            out = pa.RecordBatch.from_arrays(cols, names=["id", "clean_text", *counts, "n_dropped"])
            yield out.filter(pa.array([bool(d[1]) for d in done], pa.bool_())) if marked_only else out

    out = src.mapInArrow(run, schema)
    return out if id_col in ("clean_text", "n_dropped", *counts) else out.withColumnRenamed("id", id_col)
