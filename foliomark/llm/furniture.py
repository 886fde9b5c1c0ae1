"""What each line of a page is: running text, heading, table row, or page furniture.

Running headers, footers and page numbers are told from text by their form, by their recurrence in
the document or resemblance to its title, and by the way they interrupt a sentence.
"""

from __future__ import annotations

import re

import regex

BLANK, BODY, HEADING, TABLE, FURNITURE = "blank", "body", "heading", "table", "furniture"

#: A line that holds nothing but a page number in one of the usual dresses.
_NUMBER = r"(?:\d{1,4}|[ivxlcdm]{1,7}|[IVXLCDM]{1,7})"
_DRESSED = rf"(?:[-–—]\s*{_NUMBER}\s*[-–—]|\[\s*{_NUMBER}\s*\]|\(\s*{_NUMBER}\s*\)|\|\s*{_NUMBER}\s*\||{_NUMBER})"
_WORDED = r"(?:(?:p|pp|pág|s|стр|с|Page|Seite|Pagina|Página|Страница)\.?\s*\d{1,4}(?:\s*(?:of|/|von|de|di|sur|из)\s*\d{1,4})?|\w{2,7}\s\d{1,4}\s(?:o\w|von|de|di|sur|из)\s\d{1,4}|第\s*\d{1,4}\s*页|\d{1,4}\s*/\s*\d{1,4})"
PAGE = re.compile(rf"(?:{_DRESSED}|{_WORDED})", re.I)
#: Header text and page number on one line, parted by a bar or a wide gap.
_LEFT = re.compile(rf"(?:{_DRESSED}|{_WORDED})(?:\s*[|·•]\s*|\s{{2,}})(?P<text>\S.*)", re.I)
_RIGHT = re.compile(rf"(?P<text>\S.*?)(?:\s*[|·•]\s*|\s{{2,}})(?:{_DRESSED}|{_WORDED})", re.I)
#: Rows of a table: a label and two numbers in columns.
TABLE_ROW = re.compile(r"\S(?:.{0,40}?\S)?[ \t]{2,}\S?[\d.,%]+\S?(?:[ \t]{1,}\(?[\d.,]+[%)]*)+\s*")
#: Names as a running header gives them, and volumes of a journal.
_AUTHORS = regex.compile(r"\p{Lu}[\p{L}'’-]+(?: et \w{2}[.,]?|,? & \p{Lu}[\p{L}'’-]+)")
_JOURNAL = regex.compile(r"\p{Lu}\S+(?: \S+){0,6}(?:,? Vol\. ?\w+(?:, ?No\. ?\w+)?| \(\w{4}\)|,? \w{1,3}\(\w{1,2}\))")
_GOES_ON = regex.compile(r"[\p{Ll}\p{Lo}\d(“«„]")
_NO_LETTER = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_END = re.compile(r"[.!?。！？؟۔।…:;][\s\"'”’»)\]」』“]*$")
_BREAK = re.compile(r"[-‐‑¬­]\s*$")


def is_wrapped(text: str) -> bool:
    """Whether the text is laid out line by line: several line ends inside its blocks."""
    if text.count("\n") == 2 * text.count("\n\n"):
        return False
    return len(re.findall(r"[^\n]\n(?=[^\n])", text)) >= 4


def is_page(s: str) -> bool:
    return len(s) <= 24 and bool(PAGE.fullmatch(s))


def _beside(s: str) -> str | None:
    """The text of a line that holds text and a page number, parted by a bar or a wide gap."""
    if "  " not in s and "|" not in s and "·" not in s and "•" not in s and "\t" not in s:
        return None
    m = _LEFT.fullmatch(s) or _RIGHT.fullmatch(s)
    return m["text"] if m else None


def _numbered(s: str) -> bool:
    """Header text and page number on one line, in up to three parts."""
    text = _beside(s)
    if text is None and "   " not in s:
        return False
    parts = re.split(r"\s{3,}", s)
    if len(parts) == 2:
        pages = [is_page(p) or len(_beside(p) or "." * 40) < 40 for p in parts]
        if any(pages) and all(p or len(t) <= 80 and _LETTER.search(t) and not _END.search(t.rstrip(".")) for p, t in zip(pages, parts)):
            return True
    return text is not None and len(text) <= 80 and not re.search(r"\s{2,}", text) and bool(_LETTER.search(text)) and not _END.search(text.rstrip("."))


def is_header(line: str) -> bool:
    """Whether a line has the form of furniture, seen without its document."""
    s = line.strip()
    if is_page(s) or _named(s):
        return True
    return _numbered(s)


def _named(s: str) -> bool:
    """Names of authors, or a journal with its volume or year."""
    if len(s) > 90:
        return False
    return bool(s[-1:] in ".,)" or " " in s) and bool((" et " in s or " & " in s) and _AUTHORS.fullmatch(s) or ("Vol" in s or "V" in s or s[-1:] == ")") and _JOURNAL.fullmatch(s))


def _pairs(k: str) -> set[str]:
    return {k[i : i + 2] for i in range(len(k) - 1)}


def _key(s: str) -> str:
    return _NO_LETTER.sub("", s).casefold()


def _within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two short strings is at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0], least = row[0], i, i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            least = min(least, row[j])
        if least > most:
            return False
    return row[-1] <= most


def _alike(a: str, b: str) -> bool:
    """Equal but for two misread letters at most, or one the cut-off beginning of the other."""
    if len(a) < 6 or len(b) < 6:
        return a == b and bool(a)
    n = min(len(a), len(b))
    return _within(a, b, 2) or n >= 8 and _within(a[:n], b[:n], 2)


def classify(text: str) -> tuple[list[str], list[str]]:
    """The lines of a text (split at LF) and a kind for each.

    Only texts laid out line by line hold furniture; elsewhere every line is text or a table row.
    """
    lines = text.split("\n")
    n = len(lines)
    kinds = [BLANK if not line.strip() else TABLE if ("  " in line or "\t" in line) and TABLE_ROW.fullmatch(line.strip()) else BODY for line in lines]
    if not is_wrapped(text):
        return lines, kinds
    bare = [line.strip() for line in lines]
    lengths = sorted(len(b) for b, k in zip(bare, kinds) if k == BODY and len(b) > 12)
    width = lengths[int(len(lengths) * 0.9)] if lengths else 80
    title = next((i for i in range(n) if kinds[i] != BLANK and not is_page(bare[i])), 0)
    # the title may itself run over several lines
    stop = title
    while stop + 1 < n and kinds[stop + 1] == BODY:
        stop += 1
    title_key = "".join(_key(b) for b in bare[title : stop + 1]) if stop - title < 3 else _key(bare[title])

    head = _pairs(title_key[:9])

    def neighbour(i: int, step: int) -> int:
        i += step
        while 0 <= i < n and kinds[i] in (BLANK, FURNITURE):
            i += step
        return i

    def begins(k: str) -> bool:
        return len(k) >= 8 and len(_pairs(k[:9]) & head) >= 3 and _alike(k, title_key[: len(k)])

    def of_title(s: str, k: str) -> bool:
        if not title_key:
            return False
        if begins(k):
            return True
        first, _, rest = s.partition(", ")
        return bool(rest) and first.isupper() and begins(_key(rest))

    candidates: dict[int, str] = {}
    keys: dict[int, str] = {}
    for i in range(n):
        s = bare[i]
        if kinds[i] not in (BODY, TABLE) or i == title or len(s) > max(110, width):
            continue
        if kinds[i] == TABLE:
            kinds[i] = FURNITURE if _numbered(s) else TABLE
            continue
        if is_page(s):
            # alone in the last line of a paragraph it would end with a mark, which the pattern excludes
            kinds[i] = FURNITURE
            continue
        if _numbered(s):
            kinds[i] = FURNITURE
            continue
        if s[-1:] in ".!?;:-\u2010\u2011\u00ac\u00ad" and " et " not in s:
            continue  # ends like running text
        k = _key(s)
        if len(k) >= 3:
            candidates[i] = s
            keys[i] = k
    counts: dict[str, int] = {}
    for k in keys.values():
        counts[k] = counts.get(k, 0) + 1
    for i, s in candidates.items():
        if i <= stop and stop - title < 3:
            continue
        before, after = neighbour(i, -1), neighbour(i, 1)
        broken = before >= 0 and kinds[before] == BODY and not _END.search(bare[before]) and (len(bare[before]) > 0.6 * width or bool(_BREAK.search(bare[before])))
        goes_on = after < n and bool(_GOES_ON.match(bare[after]))
        beside_number = any(0 <= j < n and kinds[j] == FURNITURE and is_page(bare[j]) for j in (i - 1, i + 1))
        room = after < n and kinds[after] == BODY and len(s) + 1 + len(bare[after].split(" ")[0]) <= width - 3
        alone = (i == 0 or kinds[i - 1] in (BLANK, FURNITURE)) and (i + 1 == n or kinds[i + 1] in (BLANK, FURNITURE))
        known = _named(s) or of_title(s, keys[i])
        interrupts = room and not _END.search(s) and not _BREAK.search(s)
        if known and (broken or goes_on or beside_number or alone or interrupts or i + 1 == n):
            kinds[i] = FURNITURE
        elif counts[keys[i]] >= 2 and not _END.search(s) and len(s) < 0.8 * width and broken and (interrupts or goes_on):
            kinds[i] = FURNITURE
        elif beside_number and broken and (goes_on or room) and not _END.search(s) and not _BREAK.search(s) and len(s) < 0.75 * width and s[0].isupper():
            kinds[i] = FURNITURE
    # a heading stands alone between blank lines, is short and has no end mark
    for i in range(n):
        if kinds[i] == BODY and not _END.search(bare[i]) and len(bare[i]) < max(60, width):
            above = i == 0 or kinds[i - 1] == BLANK
            below = i + 1 == n or kinds[i + 1] == BLANK
            if above and below:
                before, after = neighbour(i, -1), neighbour(i, 1)
                cut = before >= 0 and kinds[before] == BODY and not _END.search(bare[before]) and bare[i][0].islower()
                tail = bare[i][0].islower() or (after < n and kinds[after] == BODY and bare[after][0].islower())
                interrupted = len(bare[i]) > 0.75 * width and i != title and any(k == FURNITURE for k in kinds[i + 1 : after])
                if not cut and not tail and not interrupted:
                    kinds[i] = HEADING
    return lines, kinds
