"""Words as all operators of this package count them.

A word is a run of letters, digits and combining marks. Scripts written without spaces between words (Han,
Kana, Thai) give one unit for each letter or digit instead, and so does a text that is mostly in them.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

_UNSPACED = "ก-๿々-〇ぁ-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003134f"


def _ranges(categories: tuple[str, ...]) -> str:
    """A character class of all characters of some general categories."""
    out, begin = [], None
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        inside = unicodedata.category(chr(code)) in categories
        if inside and begin is None:
            begin = code
        elif not inside and begin is not None:
            out.append((begin, code - 1))
            begin = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if b > a else f"\\U{a:08x}" for a, b in out)


@functools.cache
def patterns() -> tuple[re.Pattern[str], re.Pattern[str], re.Pattern[str]]:
    """(words of spaced text, units of unspaced text, letters of unspaced scripts)."""
    marks = _ranges(("Mn", "Mc", "Me"))
    unspaced_marks = "ัิ-ฺ็-๎"
    spaced = re.compile(f"[^\\W_{unspaced_marks}](?<=[{_UNSPACED}])|[^\\W_{_UNSPACED}](?:[^\\W_{_UNSPACED}]|[{marks}])*")
    return spaced, re.compile("[^\\W_]"), re.compile(f"[{_UNSPACED}]")


_ASCII = re.compile("[A-Za-z0-9]+")
_SIMPLE = re.compile("[^\\W_]+")
#: Ranges that hold all marks and all letters of unspaced scripts.
_SPECIAL = re.compile("[\u0300-\u036f\u0483-\u1fff\u20d0-\u20ff\u2c00-\U0010ffff]")


def _pattern(text: str) -> re.Pattern[str]:
    """The cheapest pattern that finds the words of this text."""
    if text.isascii():
        return _ASCII
    spaced, single, _ = patterns()
    if not _SPECIAL.search(text):
        return _SIMPLE
    return single if is_unspaced(text) else spaced


def is_unspaced(text: str) -> bool:
    """Whether more than half of the words are single letters of scripts without spaces between words."""
    if text.isascii():
        return False
    unspaced = len(patterns()[2].findall(text))
    return unspaced > 0 and 2 * unspaced > len(patterns()[0].findall(text))


def words(text: str) -> list[str]:
    """The words of a text in lower case."""
    return _pattern(text).findall(text.lower())


def word_spans(text: str) -> list[tuple[int, int]]:
    """Positions of the words."""
    return [m.span() for m in _pattern(text).finditer(text)]
