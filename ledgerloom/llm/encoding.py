"""Text decoded with the wrong character encoding: find it and restore the original where that is possible.

For every pair (true encoding, wrong encoding) the garbled sequences are computed once and put into one multi-pattern
automaton. Two families:

* UTF-8 read as a one-byte encoding: a character becomes two or three odd ones. Each match is decoded on its own, and the
  run of odd characters around it as far as it decodes; text read wrongly twice is restored by a second round.
* One one-byte encoding read as another: a letter becomes one odd character. The automaton holds the odd character beside
  a plain letter (Latin alphabets) and the garbled frequent letter pairs (Cyrillic); a match makes its word a suspect,
  and the word is replaced only if it looks wrong as it stands and right after the repair.

* Signs (quotation marks, dashes, currency) read as letters or blocks, and Western letters read as Central European ones:
  the automaton holds them with the plain characters beside which they can only be wrong; marks must come in pairs, letters
  in the company of Western words.

All sequences are computed from the code pages and found in one run of the automaton over the characters beyond ASCII and
their neighbours. Only matched spans are replaced; correct text between them stays. Whether something is lost is a separate
step: a text with replacement characters (U+FFFD), with question marks between letters, or with a garbled sequence of which
a part is gone is affected but lost there.

Defined results: null, empty and plain ASCII texts (but for question marks between letters) are unaffected and come out
as they are; repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One-byte encodings that UTF-8 was read as.
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8-r", "cp866", "cp1250", "iso8859-2", "cp1254", "iso8859-15")
#: (true, read as) among one-byte encodings.
ONE_BYTE = (
    ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "cp1250"),
    ("cp1250", "cp1252"), ("cp1250", "latin-1"), ("iso8859-2", "cp1252"), ("cp437", "cp1252"), ("cp437", "latin-1"), ("cp850", "cp1252"), ("cp850", "latin-1"), ("mac_roman", "cp1252"), ("mac_roman", "latin-1"),
)
CYRILLIC = (("cp1251", "cp1252"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp1252"), ("koi8-r", "latin-1"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1252"), ("cp1251", "mac_roman"), ("cp1251", "cp437"), ("cp1251", "cp850"))

#: (true, read as) of lone signs, and the signs by the company in which they are known.
SIGN_PAIRS = (("cp1252", "cp437"), ("cp1252", "mac_roman"))
_DASHES, _MONEY, _NO_LETTERS = "–—•", "€£", "±²½×©"
_DIGITS, _BLANK, _BEFORE, _AFTER = "0123456789", " \n\t\r", " \n\t\r([{-/\"':;,.", " \n\t\r)]}-/\"':;,.!?"
#: Letters that are words by themselves in the languages at hand (fixed values).
_OWN_WORDS = frozenset("àáèéêíóôú")

_LATIN1 = "".join(chr(c) for c in range(0xA0, 0x100))
_EXT_A = "ĄąĆćČčĎďĐđĘęĚěĞğİıŁłŃńŇňŐőŒœŔŕŘřŚśŞşŠšŤťŮůŰűŹźŻżŽžŸĀāĒēĪīŪūŅņĻļĶķĢģ"
_RUSSIAN = "".join(chr(c) for c in range(0x410, 0x450)) + "Ёё"
_GREEK = "".join(chr(c) for c in [*range(0x391, 0x3A2), *range(0x3A3, 0x3AA), *range(0x3AC, 0x3CF)])
_SIGNS = "–—‘’‚“”„†‡•…‰‹›€™−≤≥≠≈№→←↑↓■●✓"
_KANA = "".join(chr(c) for c in [*range(0x3001, 0x3012), *range(0x3041, 0x3097), *range(0x30A1, 0x30FD), 0xFF08, 0xFF09, 0xFF0C, 0xFF1A, 0xFF1B])
#: Frequent pairs of letters in Russian words.
_PAIRS = "ст но то на ен ов ни ра во ко по пр ро ал ер ре ли не ос та ор от го ль ет ка ва ол ла ло ан ат ом те ол ть ел ле ин да ая ой ия ие ны ри ам мо ти ве од об бо за до ск че ци ит ак ес он".split()

_ASCII = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters that words of the Latin alphabets at hand are made of.
_LETTERS = frozenset(_ASCII + "äöüßéèêëàâáãåçñóòôõøíìîïúùûýœæÿÄÖÜÉÈÊËÀÂÁÃÅÇÑÓÒÔÕØÍÌÎÏÚÙÛÝŒÆ" + "ąćęłńśźżĄĆĘŁŃŚŹŻčďěňřšťůžőűČĎĚŇŘŠŤŮŽŐŰ")
_EDGE = "'’‘\"“”„«».,;:!?()[]{}…–—-/  "


@lru_cache(maxsize=None)
def _table(name: str) -> tuple[str, ...]:
    """The 256 characters of an encoding; bytes without one stand for the control character of their number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@lru_cache(maxsize=None)
def _back(name: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_table(name)))) if b >= 0x80}


def _read(raw: bytes, name: str) -> str:
    t = _table(name)
    return "".join(t[b] for b in raw)


#: Second characters of two that also follow the first in correct text: such a match counts only beside another one.
_WEAK = {
    "cp1251": "»«–—…„“”‘’ёЁ№§°±• ·®©",
    "koi8-r": "ёЁ©°· ",
    "cp866": "".join(_RUSSIAN) + " °·",
    "mac_roman": "",
    "cp1252": "", "latin-1": "", "cp1250": "", "iso8859-2": "", "cp1254": "", "iso8859-15": "", "cp437": "", "cp850": "",
}


def _boxes(s: str) -> bool:
    return all("─" <= c <= "▟" for c in s)


def _turned(pair: tuple[str, str], chars: str) -> dict[str, str]:
    """What each character of the true encoding looks like in the one it was read as."""
    back, to = _back(pair[0]), _table(pair[1])
    return {c: to[back[c]] for c in chars if c in back and to[back[c]] != c}


#: Letters that only Central European words have, and those that Western ones turn into and that are not of these.
_ONLY_EAST = re.compile("[łąęśżźćěšžůťďňŁĄĘŚŻŹĆĚŠŽŮŤĎŇ]")
_WESTERN = "".join(c for c in _LATIN1 if c.isalpha() and c not in "ªµº")
_EAST = frozenset(g for g in _turned(("cp1252", "cp1250"), _WESTERN).values() if g.isalpha() and not _ONLY_EAST.match(g))
_WEST = re.compile(r"\w*[éèçíóáâêãöüßàñ]\w*")


@lru_cache(maxsize=1)
def _automaton():  # built once in each worker process
    """Pattern -> (kind, what, weak): kind "u" with the encodings UTF-8 was read as, "l" with Latin and "c" with Cyrillic pairs."""
    import ahocorasick

    found: dict[str, dict[str, dict]] = {}

    def add(seq: str, kind: str, what, weak: bool = False) -> None:
        if not seq.isascii():
            at = found.setdefault(seq, {}).setdefault(kind, {})
            at[what] = at.get(what, True) and weak

    for name in READ_AS:
        for c in _LATIN1 + _EXT_A + _RUSSIAN + _GREEK + _SIGNS + _KANA:
            seq = _read(c.encode("utf-8"), name)
            two_dashes = name == "mac_roman" and seq[0] in "–—"
            weak = _boxes(seq) or two_dashes or len(seq) == 2 and (name in ("cp437", "cp850") and seq.isalpha() or seq[1] in _WEAK[name] or seq.isalpha() and seq.islower() and name in ("cp866", "koi8-r"))
            add(seq, "u", name, weak)
        for lead in (b"\xe2\x80", b"\xe2\x82", b"\xe2\x84", b"\xe3\x80", b"\xe3\x81", b"\xe3\x82", b"\xe3\x83", b"\xef\xbf"):  # a third byte may be gone
            if not (seq := _read(lead, name)).isalpha() or seq[0] in "âã" and seq[1] in "ƒ":
                add(seq, "u", name, _boxes(seq))
    for true, read in ONE_BYTE:
        to, back = _table(read), _back(true)
        for c in [*sorted(_LETTERS - set(_ASCII)), "’"]:
            if c in back and (g := to[back[c]]) != c and not g.isascii() and not (g in _LETTERS and g.islower() and g != "ÿ"):
                for a in _ASCII:  # a small letter with an accent is never taken for wrong by itself
                    if g not in _LETTERS or g.isupper():
                        add(a + g, "l", (true, read))
                    if g not in _LETTERS or g == "ÿ":
                        add(g + a, "l", (true, read))
    for true, read in CYRILLIC:
        to, back = _table(read), _back(true)
        for p in _PAIRS:
            for q in (p, p.upper()):
                add("".join(to[back[c]] for c in q), "c", (true, read))
    for pair in SIGN_PAIRS:
        for c, g in _turned(pair, _DASHES).items():
            if c == "–":
                for x in _DIGITS:
                    for y in _DIGITS:
                        add(x + g + y, "s", (pair, g, c, 1))
            if g not in _OWN_WORDS:
                for x in _BLANK:
                    for y in _BLANK:
                        add(x + g + y, "s", (pair, g, c, 1))
        for c, g in _turned(pair, _MONEY).items():
            for x in _BEFORE:
                for y in _DIGITS:
                    add(x + g + y, "s", (pair, g, c, 1))
        for c, g in _turned(pair, _NO_LETTERS).items():
            if not g.isalpha() and ("─" <= g <= "▟" or "⌀" <= g <= "⏿"):
                add(g, "s", (pair, g, c, 0))
        marks = _turned(pair, "“”")
        for x in _BEFORE:
            add(x + marks["“"], "q", (pair, "“"))
        for x in _AFTER:
            add(marks["”"] + x, "q", (pair, "”"))
    for g in _EAST:
        add(g, "e", ("cp1252", "cp1250"))
    machine = ahocorasick.Automaton()
    for seq, kinds in found.items():
        machine.add_word(seq, (len(seq), kinds))
    machine.make_automaton()
    return machine


def _decode_run(run: str, name: str) -> tuple[str, int, int]:
    """The run of characters with every complete UTF-8 sequence decoded; how many were, and how many characters were not."""
    back = _back(name)
    raw = [back.get(c, 0) for c in run]
    out, i, good, bad = [], 0, 0, 0
    while i < len(raw):
        b = raw[i]
        n = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        if n and i + n <= len(raw):
            try:
                out.append(bytes(raw[i : i + n]).decode("utf-8"))
                i, good = i + n, good + 1
                continue
            except (UnicodeDecodeError, ValueError):
                pass
        out.append(run[i])
        i, bad = i + 1, bad + 1
    return "".join(out), good, bad


def _replaced(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text with every span (start, end, new) replaced; spans do not overlap. Linear, however many there are."""
    out, at = [], 0
    for s, e, new in sorted(edits):
        out += (text[at:s], new)
        at = e
    out.append(text[at:])
    return "".join(out)


def _utf8_round(text: str, hits: list[tuple[int, int, dict]]) -> tuple[str, list[str], bool]:
    """Decodes what was UTF-8; the encodings used, and whether some of it was incomplete."""
    spans: dict[str, list[tuple[int, int, bool]]] = {}
    for end, n, kinds in hits:
        for name, weak in kinds.get("u", {}).items():
            spans.setdefault(name, []).append((end + 1 - n, end + 1, weak))
    best: dict[str, list[tuple[int, int]]] = {}
    for name, found in spans.items():
        found.sort()
        keep = []
        for k, (s, e, weak) in enumerate(found):
            near = _boxes(text[s:e]) and (text[s - 1 : s].isalpha() or text[e : e + 1].isalpha()) and s > 0
            near = near or any(0 <= k + d < len(found) and (found[k + d][0] <= e and found[k + d][1] >= s) for d in (-2, -1, 1, 2))
            if not weak or near:
                keep.append((s, e))
        if strong := any(not weak for _, _, weak in found) or keep and _boxes(text[keep[0][0] : keep[0][1]]) or len(keep) > 3:
            best[name] = [(s, e) for s, e, _ in found] if strong else keep
    if not best:
        return text, [], False
    order = sorted(best, key=lambda x: (-sum(e - s for s, e in best[x]), READ_AS.index(x)))
    used, lost, taken, edits = [], False, bytearray(len(text)), []
    for name in order:
        back, mine = _back(name), False
        for s, e in best[name]:
            if taken.find(1, s, e) >= 0:
                continue
            while s > 0 and text[s - 1] in back and not taken[s - 1]:
                s -= 1
            while e < len(text) and text[e] in back and not taken[e]:
                e += 1
            new, good, bad = _decode_run(text[s:e], name)
            taken[s:e] = b"\x01" * (e - s)
            if good:
                edits.append((s, e, new))
                mine = True
            else:
                lost = True
        if mine:
            used.append(name)
    return _replaced(text, edits), used, lost


def _core(word: str) -> str:
    return word.strip(_EDGE)


def _right(word: str) -> bool:
    """The parts of a Latin word between hyphens and apostrophes are letters in an ordinary mixture of cases."""
    parts = [p for p in re.split(r"[-'’/&.,;:()0-9]+", _core(word)) if p]
    return bool(parts) and all(all(c in _LETTERS for c in p) and (p.islower() or p.isupper() or p[0].isupper() and p[1:].islower() or p.isascii()) for p in parts)


def _wrong_chars(word: str) -> bool:
    """Something that is no Latin letter stands between letters, or a capital with an accent among small letters."""
    w = _core(word)
    for i, c in enumerate(w):
        if c.isascii():
            continue
        left, right = w[i - 1 : i] if i else "", w[i + 1 : i + 2]
        beside = (left.isalpha() and left.isascii()) + (right.isalpha() and right.isascii())
        if "\x80" <= c <= "\x9f" or c == "ÿ" and not left:
            return True
        if c not in _LETTERS and c not in "’‘–—-…·“”„ªº®™©°²³¹½¼¾§¶•»«€£µ":
            if beside:
                return True
        elif c == "·" and beside == 2 and (left.lower(), right.lower()) != ("l", "l"):
            return True
        elif c not in _LETTERS and right.isalpha() and left.isalpha() and c not in "’‘–—-…·“”„µ":
            return True
        elif c.isupper() and left.isalpha() and (right.islower() or not right and left.islower()):
            return True
    return False


_TOKEN = re.compile(r"[^\s ]+")


def _latin_round(text: str, hits: list[tuple[int, int, dict]]) -> tuple[str, list[str]]:
    words: dict[int, tuple[int, int, str]] = {}
    at: dict[int, set] = {}
    spans = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    starts = [s for s, _ in spans]
    from bisect import bisect_right

    for end, n, kinds in hits:
        if "l" in kinds:
            i = bisect_right(starts, end) - 1
            words[i] = (*spans[i], text[spans[i][0] : spans[i][1]])
            at.setdefault(i, set()).update(kinds["l"])
    votes: Counter = Counter()
    repairs: dict[int, dict[tuple, str]] = {}
    for i, (s, e, word) in words.items():
        if not _wrong_chars(word):
            continue
        for pair in at[i]:
            new = _convert(word, pair)
            if new != word and _right(new):
                votes[pair] += 1
                repairs.setdefault(i, {})[pair] = new
    if not votes:
        return text, []
    rank = sorted(votes, key=lambda p: (-votes[p], ONE_BYTE.index(p)))
    if votes[rank[0]] >= 3:  # a text that is wrong throughout: words that only look odd in its company
        for i, (s, e) in enumerate(spans):
            word = text[s:e]
            if i not in repairs and not word.isascii() and (new := _convert(word, rank[0])) != word and _right(new):
                words[i], repairs[i] = (s, e, word), {rank[0]: new}
    used, edits = [], []
    for i in sorted(repairs, reverse=True):
        pair = next(p for p in rank if p in repairs[i])
        used.append(f"{pair[0]}>{pair[1]}")
        edits.append((words[i][0], words[i][1], repairs[i][pair]))
    return _replaced(text, edits), used


def _convert(word: str, pair: tuple[str, str]) -> str:
    back, to = _back(pair[1]), _table(pair[0])
    return "".join(to[back[c]] if c in back else c for c in word)


_PAIR_SET = frozenset(_PAIRS)
_NOT_ASCII_WORD = re.compile(r"[^\x00-\x7f]{2,}")


def _pairs_in(word: str) -> int:
    w = word.lower()
    return sum(w[i : i + 2] in _PAIR_SET for i in range(len(w) - 1))


def _cyrillic_round(text: str, hits: list[tuple[int, int, dict]]) -> tuple[str, list[str]]:
    """Repairs the words of a text in one pair of encodings if far more of its letter pairs are Russian after it."""
    votes = Counter(pair for _, _, kinds in hits for pair in kinds.get("c", ()))
    for pair, n in sorted(votes.items(), key=lambda x: (-x[1], CYRILLIC.index(x[0])))[:4]:
        if n < 3:
            break
        runs = [(m.start(), m.end(), m.group()) for m in _NOT_ASCII_WORD.finditer(text)]
        before = after = mass = 0
        new = []
        for s, e, run in runs:
            fixed = _convert(run, pair)
            letters = sum(c in _RUSSIAN for c in fixed)
            if letters < 0.8 * len(fixed):
                continue
            before += _pairs_in(run)
            after += _pairs_in(fixed)
            mass += letters * (letters > 3)
            new.append((s, e, fixed))
        if after >= 6 and after > 2 * before and mass >= 8:
            text = _replaced(text, new)
            back, to = _back(pair[1]), _table(pair[0])
            text = re.sub(r"(?<![^\s(])[^\x00-\x7f](?![^\s).,;:])", lambda m: to[back[m.group()]] if m.group() in back else m.group(), text)
            return text, [f"{pair[0]}>{pair[1]}"]
    return text, []


def _boxed(c: str) -> bool:
    return bool(c) and "─" <= c <= "▟"


def _sign_round(text: str, hits: list[tuple[int, int, dict]]) -> tuple[str, list[str]]:
    """Repairs lone signs and pairs of quotation marks. A mark counts only with its partner in the same paragraph, no other
    mark's letter between them; a sign that two pairs of encodings explain is taken as the first of them."""
    edits: dict[int, tuple[str, str]] = {}
    marks: list[tuple[int, tuple, str]] = []
    for end, n, kinds in hits:
        for (pair, g, c, shift), _ in kinds.get("s", {}).items():
            at = end + 1 - n + shift
            if not shift and (_boxed(text[at - 1 : at]) or _boxed(text[at + 1 : at + 2])):
                continue
            if at not in edits or SIGN_PAIRS.index(pair) < SIGN_PAIRS.index(edits[at][1]):
                edits[at] = (c, pair)
        for pair, c in kinds.get("q", {}):
            marks.append((end if c == "“" else end - 1, pair, c))
    opened: dict[tuple, int] = {}
    for at, pair, c in sorted(marks):
        if c == "“":
            if text[at + 1 : at + 2].isalnum() or text[at + 1 : at + 2] == "_":
                opened[pair] = at
        elif (start := opened.get(pair)) is not None and (text[at - 1].isalnum() or text[at - 1] in "_.,;:!?)%"):
            inside = text[start + 1 : at]
            if inside and not _QUOTE_LETTERS.search(inside) and not _PARAGRAPH.search(inside):
                edits[start], edits[at] = ("“", pair), ("”", pair)
            del opened[pair]
    if not edits:
        return text, []
    out = list(text)
    for at, (c, _) in edits.items():
        out[at] = c
    return "".join(out), list(dict.fromkeys(f"{p[0]}>{p[1]}" for _, (_, p) in sorted(edits.items())))


_QUOTE_LETTERS = re.compile("[" + "".join(sorted({g for p in SIGN_PAIRS for g in _turned(p, "“”").values()})) + "]")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


def _east_round(text: str, hits: list[tuple[int, int, dict]]) -> tuple[str, list[str]]:
    """Western text read in the Central European encoding: its stray letters in the company of Western words only."""
    at = [end for end, _, kinds in hits if "e" in kinds]
    if not at or _ONLY_EAST.search(text) or sum(1 for w in _WEST.findall(text) if not _EAST.intersection(w)) < 3:
        return text, []
    edits, done = [], -1
    for i in at:
        if i < done:
            continue
        s = i
        while s and not text[s - 1].isspace():
            s -= 1
        done = i + 1
        while done < len(text) and not text[done].isspace():
            done += 1
        new = _convert(text[s:done], ("cp1252", "cp1250"))
        if new != text[s:done] and _right(new):
            edits.append((s, done, new))
    return _replaced(text, edits), ["cp1252>cp1250"] if edits else []


_LOST = re.compile("�|(?<![\\w/?=&%])[^\\W\\d_]*[^\\W\\d_]\\?[^\\W\\d_]+(?![\\w/=&%])")
_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")


def restore(text: str | None) -> tuple[bool, str | None, bool, str]:
    """(affected, restored text, part of the original is lost, the encodings undone in order)."""
    if not text:
        return False, text, False, ""
    how, lost, now = [], False, text
    hits = [] if text.isascii() else _hits(text)
    if hits:
        if any("c" in kinds for _, _, kinds in hits):
            now, how = _cyrillic_round(text, hits)
            hits = _hits(now) if how else hits
        while any("u" in kinds for _, _, kinds in hits):  # every round shortens the text
            new, used, gone = _utf8_round(now, hits)
            lost |= gone
            how += [f"utf-8>{x}" for x in used]
            if new == now:
                break
            now, hits = new, _hits(new)
        for kinds_of, step in (("l", _latin_round), ("sq", _sign_round), ("e", _east_round)):
            if any(k in kinds for _, _, kinds in hits for k in kinds_of):
                new, used = step(now, hits)
                how += used
                if new != now:
                    now, hits = new, _hits(new)
    if not text.isascii():
        lost |= bool(_CONTROL.search(now))
    lost |= ("?" in now or "\ufffd" in now) and bool(_LOST.search(now))
    return bool(how) or lost, now, lost, ",".join(dict.fromkeys(how))


#: Characters beyond ASCII with what lies between close ones: each sequence has one, and two plain neighbours at most.
_ODD = re.compile(r"[^\x00-\x7f]+(?:[\x00-\x7f]{1,4}[^\x00-\x7f]+)*")
_SEEN: dict[str, list] = {}


def _hits(text: str) -> list[tuple[int, int, dict]]:
    """(index of the last character, length, kinds) of every sequence. Short stretches, such as an apostrophe in a word, are
    remembered; a text begins as if after a line end and ends as if before a bracket."""
    out, find = [], _automaton().iter
    for m in _ODD.finditer(text):
        s, e = m.start() - 2, m.end() + 2
        part = text[max(s, 0) : e]
        if s < 0:
            part, s = "\n" * -s + part, s
        if e > len(text):
            part += ")" * (e - len(text))
        if (got := _SEEN.get(part)) is None:
            got = [(end, n, kinds) for end, (n, kinds) in find(part)]
            if len(part) <= 48:
                if len(_SEEN) > 100_000:
                    _SEEN.clear()
                _SEEN[part] = got
        out += [(s + end, n, kinds) for end, n, kinds in got]
    return out


def restore_encoding(df: DataFrame, id_col: str, text_col: str, affected_only: bool = False) -> DataFrame:
    """``id_col``, affected, restored, lost, path for every row (or the affected ones). Narrow: no shuffle. Texts that
    cannot be affected (ASCII without a question mark between letters) are settled in the JVM if only affected rows are
    wanted."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if affected_only:
        src = src.filter(F.col("text").rlike(r"[^\x00-\x7F]|[A-Za-z]\?[A-Za-z]"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*map(restore, batch.column(1).to_pylist()))) or [[]] * 4
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.bool_()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.bool_()), pa.array(rows[3], pa.string())], names=["id", "affected", "restored", "lost", "path"])
            yield out.filter(out.column(1)) if affected_only else out

    out = src.mapInArrow(run, f"id {kind}, affected boolean, restored string, lost boolean, path string")
    return out if id_col in ("affected", "restored", "lost", "path") else out.withColumnRenamed("id", id_col)
