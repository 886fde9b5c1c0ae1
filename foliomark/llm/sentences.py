"""Sentence units of a text in any script (problem 4).

The rules are those of the standard sentence-break property: the terminators of all scripts (classes STerm and
ATerm), closing punctuation that stays with the sentence, and no break before a lower-case letter. They are
tailored by the abbreviations of the language of the paragraph, by quotations, by ordinals before a month, by the
Tibetan shad, and for Thai by the space that parts sentences. Page furniture is taken out before and sentences
are followed across it.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame

from .furniture import BLANK, BODY, FURNITURE, HEADING, TABLE, classify
from ..plans.session import arrow_map

# Abbreviations that are followed by more of their sentence, by language.
_NEVER = {
    "en": "dr prof mr mrs ms st cf fig figs e.g i.e vs approx no nos sec secs vol ed eds pp ch eq ref refs ca viz jr sr dept univ",
    "de": "z.b d.h bzw vgl abb s.o s.u u.a nr ca bd hrsg sog ggf evtl inkl tab kap dr prof",
    "fr": "m mm mme mlle cf fig c.-à-d p.ex env éd chap art vol",
    "es": "sr sra dr dra pág págs p.ej fig cf núm art ed cap aprox",
    "pt": "sr sra dr dra pág fig cf p.ex núm ex art cap ed aprox",
    "it": "dott prof sig cfr fig es pag art cap ad.es vol",
    "ru": "рис см стр табл гл напр т.е т.к им проф ул",
    "ar": "د أ م ص",
    "hi": "डॉ श्री पृ",
    "other": "dr",
}
# Abbreviations that are words too and shorten only before a number.
_BEFORE_NUMBER = "no nos art cap sec secs ch fig figs"
# Abbreviations of one language that are words of another.
_ALSO_WORDS = "art cap es ex sig ref refs m mm st ed no nos sec ch pag"
# The most common words of the languages whose abbreviations differ.
_COMMON = {
    "en": "the of and to in is that was with are this from by which on as he she then",
    "de": "der die das und ist nicht den mit von ein eine werden im des zu auf als",
    "fr": "le la les des et est dans une un que pour sur ne pas du au de en qui",
    "es": "el la los las del de que en y es una un por con se su como más al",
    "pt": "o a os as do da de que e em dos das um uma não com ao mais por se",
    "it": "il lo la gli di che e un una della del per non nel sono dei è con le i a",
}
# Abbreviations that may also close a sentence.
_MAYBE = "etc usw ecc al т.д т.п др г гг inc ltd co a.m p.m"
# Month names after which German ordinals have no break before.
_MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember"
# Thai words that carry a sentence on after a space, and words before a quoted or listed part.
_THAI_ON = "แล้ว และ หรือ แต่ ซึ่ง เพราะ เนื่องจาก ขณะที่ ทั้งที่ ดังที่ จน จึง กรณี เปอร์เซ็นต์ ว่า"

#: Abbreviation -> the languages that have it.
NEVER = {w: frozenset(lang for lang, words in _NEVER.items() if w in words.split()) for words in _NEVER.values() for w in words.split()}
BEFORE_NUMBER = frozenset(_BEFORE_NUMBER.split())
ALSO_WORDS = frozenset(_ALSO_WORDS.split())
_NUMBER_NEXT = re.compile(r"[A-Z]?\d|[IVXLC]+\b|\(\d")
_LATIN_WORD = re.compile(r"[^\W\d_]+")
_LANGUAGES_OF: dict[str, list[str]] = {}
for _lang, _words in _COMMON.items():
    for _w in _words.split():
        _LANGUAGES_OF.setdefault(_w, []).append(_lang)
MAYBE = frozenset(_MAYBE.split())
MONTHS = frozenset(_MONTHS.split())
THAI_ON = tuple(_THAI_ON.split())



def _matching(pattern: str) -> str:
    """All characters that a property pattern matches."""
    return "".join(regex.findall(pattern, "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))))


def _class(chars: str) -> str:
    return "[" + "".join(map(re.escape, chars)) + "]"


#: Terminators that need a space after them, as they also stand inside numbers, names and addresses.
_SPACED = ".!?…‼⁇⁈⁉‽․"
TERMINATORS = "…།༎" + _matching(r"[\p{SB=STerm}\p{SB=ATerm}]")
_UNSPACED = "".join(c for c in TERMINATORS if c not in _SPACED)
_TERM = re.compile(f"{_class(_SPACED)}+|{_class(_UNSPACED)}+")
#: The same for texts within the basic plane, which a table of characters decides.
_BASIC_TERM = re.compile(f"{_class(_SPACED)}+|{_class(''.join(c for c in _UNSPACED if c <= '\uffff'))}+")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_CLOSE = re.compile(_class("\"'“«「" + _matching(r"[\p{Pe}\p{Pf}]")) + "*")
_OPEN_END = re.compile(f"{_class(TERMINATORS)}[\"'”’»)\\]」“]*$")
_NEXT = re.compile("[\\s\u200b\u200c\u200d\u2060\ufeff\u00ad]*[“„«\"'(\\[¿¡‘「『（”–—-]*[\\s\u200b\u2060\ufeff\u00ad]*")
_WORD = regex.compile("(?:[\\p{L}\\p{M}\u00ad\u200b\u2060\ufeff]+(?:[.]\\s?|-))*[\\p{L}\\p{M}\\p{N}\u00ad\u200b\u2060\ufeff]+$")
_PLAIN = re.compile("[A-Za-z]{8}$")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\xad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
_LEAD = re.compile("[\\s\u00ad\u200b-\u200f\u2060\ufeff]*")
_THAI = re.compile("[\u0e01-\u0e7f]")
_QUOTE = re.compile("[“”„«»「」『』\"]")
_VISIBLE = re.compile(r"\w")
_AFTER_QUOTE = re.compile(r"[)\]）」』»”]*[.。]?")
_SPACE = re.compile("[ \u00a0\u2000-\u200a\u202f\u3000]+")
REFERENCE = regex.compile(r"\s*(?:\[\w{1,3}\]\s*|\d+\.\s+)?\p{Lu}[\p{L}\p{M}’'-]+,\s(?:\p{Lu}\.[ -]?)+.{0,160}?\(\w{4}[a-z]?\)[.,:]")
_OPENERS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "”": "“”"}


def quotations(s: str) -> list[tuple[int, int]]:
    """Outermost quotations as (position of the opening mark, position of the closing mark)."""
    out, open_at, wanted = [], -1, ""
    for m in _QUOTE.finditer(s):
        c, i = m[0], m.start()
        if open_at < 0:
            if c == '"':
                open_at, wanted = i, '"'
            elif c in _OPENERS:
                open_at, wanted = i, _OPENERS[c]
        elif c in wanted:
            out.append((open_at, i))
            open_at = -1
    return out


def _starts(s: str, i: int) -> tuple[str, int]:
    """The first letter or digit after closing and opening marks at i, and its place."""
    j = _NEXT.match(s, i).end()
    return (s[j] if j < len(s) else ""), j


def _lower(s: str, j: int) -> bool:
    return s[j].islower() and not (j + 1 < len(s) and s[j + 1].isupper())


def common_language(text: str) -> str | None:
    """Of the languages with abbreviations in Latin letters the one whose common words the text has most of.

    None unless they are three at least and twice as many as those of any other.
    """
    counts: Counter[str] = Counter()
    for w in _LATIN_WORD.findall(text.lower()):
        for lang in _LANGUAGES_OF.get(w, ()):
            counts[lang] += 1
    best = counts.most_common(2)
    return best[0][0] if best and best[0][1] >= 3 and (len(best) == 1 or best[0][1] >= 2 * best[1][1]) else None


class _Language:
    """The language of a paragraph, else of its document, found when an abbreviation asks for it."""

    def __init__(self, text: str, wider: Callable[[], str | None] = lambda: None):
        self.text, self.wider, self.known, self.found = text, wider, False, None

    def __call__(self) -> str | None:
        if not self.known:
            self.known, self.found = True, common_language(self.text) or self.wider()
        return self.found


def _never(word: str, language: _Language, s: str, j: int) -> bool:
    """Whether a word before a full stop is an abbreviation, in this language, that its sentence follows."""
    langs = NEVER.get(word)
    if langs is None:
        return False
    if word in BEFORE_NUMBER and not _NUMBER_NEXT.match(s, j):
        return False
    return word not in ALSO_WORDS or (lang := language()) is None or lang in langs


def _full_stop_ends(s: str, i: int, j: int, language: _Language) -> bool:
    """Whether the single full stop at i, with the next letter or digit at j, ends a sentence."""
    if _PLAIN.search(s, i - 8 if i > 8 else 0, i):
        return True
    m = _WORD.search(s, max(0, i - 16), i)
    nxt = s[j]
    if m:
        word = _INVISIBLE.sub("", m[0]).replace(" ", "").replace(" ", "").casefold()
        last = word.rsplit(".", 1)[-1]
        if _never(word, language, s, j) or last != word and len(word) <= 8 and _never(last, language, s, j):
            return False
        if word in MAYBE or last in MAYBE:
            return nxt.isupper() or nxt.islower() and not _lower(s, j) or not nxt.isdigit() and not nxt.islower() and last == "etc"
        if len(last) == 1 and last.isalpha() and (m.start() == 0 or not s[m.start() - 1].isalnum()):
            return False
        if _never(last, language, s, j):
            return False
        if word.isdigit() and len(word) <= 2:
            following = regex.match(r"\p{L}+", s[j : j + 12])
            if following and following[0] in MONTHS:
                return False
    return True


def sentence_ends(s: str, wider: Callable[[], str | None] = lambda: None) -> list[int]:
    """Ends of the sentences of one paragraph, each just after its last visible character.

    ``wider`` tells the language of the document where the paragraph does not show its own.
    """
    language = _Language(s, wider)
    stop = len(s.rstrip(_BLANKS))
    if stop == 0:
        return []
    if "(" in s and ". " in s and REFERENCE.match(s):
        return [stop]
    quotes = quotations(s)
    thai = bool(_THAI.search(s)) and len(_THAI.findall(s)) * 4 > stop
    ends: list[int] = []
    inner: list[int] = []
    start, q = 0, 0
    for m in (_TERM if _BEYOND.search(s) else _BASIC_TERM).finditer(s, 0, stop):
        i, e = m.start(), m.end()
        if e <= start:
            continue
        while q < len(quotes) and quotes[q][1] < i:
            q += 1
            inner = []
        marks = m[0]
        spaced = marks[0] in _SPACED
        if q < len(quotes) and quotes[q][0] < i < quotes[q][1]:
            o, c = quotes[q]
            own = _NEXT.match(s, start).end() >= o  # the quotation opens the sentence
            if s[e:c].strip(_BLANKS + ")]"):
                if own and (not spaced or s[e : e + 1].isspace()):
                    first, j = _starts(s, e)
                    if first and not _lower(s, j) and (marks != "." or _full_stop_ends(s, i, j, language)) and "…" not in marks and ".." not in marks:
                        inner.append(_CLOSE.match(s, e, c).end())
                continue
            e = c + 1
            e = _AFTER_QUOTE.match(s, e).end()
            first, j = _starts(s, e)
            if not first or j >= stop:
                ends += inner if own else []
                ends.append(e)
                start, inner = e, []
                continue
            if first.isupper() or _lower(s, j) is False and s[j].islower():
                done = True
            elif first.islower():
                done = False
            elif not first.isalnum():
                done = own and first not in ",，、;；:"
            else:  # letters without case, digits
                done = own and first not in "とって"
            if done:
                ends += inner if own else []
                ends.append(e)
                start, inner = e, []
            continue
        close = _CLOSE.match(s, e)
        # an opening mark directly after the end belongs to the next sentence
        e2 = close.end()
        for o, c in quotes[q : q + 2]:
            if e <= o < e2:
                e2 = o
        first, j = _starts(s, e2)
        if not first or j >= stop:
            ends.append(min(stop, max(e2, e)))
            start = e2
            continue
        if spaced:
            if not s[e2].isspace() and s[e2] not in "“„«「『”" and not (e2 < len(s) and _INVISIBLE.match(s[e2]) and s[e2 + 1 : e2 + 2].isspace()):
                continue
            if _lower(s, j):
                continue
            if "…" in marks or ".." in marks:
                if not first.isupper():
                    continue
            elif marks == ".":
                if not _full_stop_ends(s, i, j, language):
                    continue
            if not first.isalnum() and first in ",;:)–—-":
                continue
        elif marks[0] in "．﹒" and not s[e2].isspace():
            continue
        elif _lower(s, j):
            continue
        ends.append(e2)
        start = e2
    if thai:
        ends = _thai_ends(s, stop, ends, quotes)
    if not ends or _LEAD.match(s, ends[-1]).end() < stop and _VISIBLE.search(s, ends[-1], stop):
        ends.append(stop)
    elif ends[-1] < stop:
        ends[-1] = stop
    return ends


def _thai_ends(s: str, stop: int, ends: list[int], quotes: list[tuple[int, int]]) -> list[int]:
    out = set(ends)
    for m in _SPACE.finditer(s, 0, stop):
        i, j = m.span()
        if i == 0 or j >= stop or any(o < i < c for o, c in quotes):
            continue
        prev, nxt = s[i - 1], s[j]
        if not (_THAI.match(prev) or prev in ")]”\"%" and _THAI.search(s[max(0, i - 14) : i])):
            continue
        if prev in "”\"" or s[:i].endswith("ว่า") or prev == ")":
            continue
        if nxt in "“\"":
            out.add(i)
        elif nxt.isascii() and nxt.isupper():
            if regex.match(r"[A-Z]\w+(?: (?:& |and |และ )?\w+| et al\.)? ?\(", s[j : j + 60]):
                out.add(i)
        elif _THAI.match(nxt) and not s.startswith(THAI_ON, j):
            out.add(i)
    return sorted(out)


def units(text: str) -> list[int]:
    """Ends of all sentence units of a document: sentences, headings, reference entries, table rows.

    Empty and blank texts have none. Page furniture belongs to no unit.
    """
    lines, kinds = classify(text)
    language = _Language(text)
    at, starts = 0, []
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    out: list[int] = []
    if FURNITURE not in kinds and not any(a == BODY and b == BODY for a, b in zip(kinds, kinds[1:])):
        for line, kind, begin in zip(lines, kinds, starts):
            if kind == TABLE:
                out.append(begin + len(line.rstrip()))
            elif kind != BLANK:
                out += [begin + e for e in sentence_ends(line, language)]
        return out
    block: list[int] = []

    def flush() -> None:
        if not block:
            return
        joined, offsets, n = [], [], 0
        for k in block:
            offsets.append(n)
            joined.append(lines[k])
            n += len(lines[k]) + 1
        for e in sentence_ends("\n".join(joined), language):
            r = bisect_right(offsets, e - 1) - 1
            out.append(starts[block[r]] + e - offsets[r])
        block.clear()

    furniture_since = False
    for k, kind in enumerate(kinds):
        if kind == BLANK:
            continue
        if kind == FURNITURE:
            furniture_since = True
            continue
        if kind in (TABLE, HEADING):
            flush()
            if kind == TABLE:
                out.append(starts[k] + len(lines[k].rstrip()))
            else:
                out.append(starts[k] + len(lines[k].rstrip(_BLANKS)))
            furniture_since = False
            continue
        if block and k > block[-1] + 1:
            last = lines[block[-1]].rstrip()
            open_end = not _OPEN_END.search(last)
            if not (furniture_since and (open_end or all(kinds[x] == FURNITURE for x in range(block[-1] + 1, k)))):
                flush()
        block.append(k)
        furniture_since = False
    flush()
    return sorted(out)


def sentence_units(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sentence unit: (id, sentence_index, sentence_start, sentence_end).

    Positions count code points of the stored text; ``sentence_start`` is the first visible character
    after the unit before, so it may lie before page furniture that interrupts the unit. Null, empty and
    blank texts give no rows; a repeated row gives its units again; further columns are ignored. Each text
    is handled whole and alone, in one pass without a shuffle.
    """

    def run(ids, texts):
        out = ([], [], [], [])
        for key, text in zip(ids, texts):
            if not text:
                continue
            before = 0
            for n, end in enumerate(units(text)):
                start = _LEAD.match(text, before).end()
                for column, value in zip(out, (key, n, start, end)):
                    column.append(value)
                before = end
        return out

    kind = documents.schema[id_col].dataType.simpleString()
    return arrow_map(documents.select(id_col, text_col), run, f"`{id_col}` {kind}, sentence_index int, sentence_start bigint, sentence_end bigint")
