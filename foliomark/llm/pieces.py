"""Splitting oversized texts at natural boundaries, with overlap (problem 10).

A hierarchy of separators (section, paragraph, sentence, word, character) is descended only where a part is
still too long; the parts are then packed greedily, each piece after the first beginning with the last tokens
of the piece before.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from ..plans.session import arrow_map
from .sentences import units
from .tokens import DEFAULT_VOCABULARY, encoding, token_ends

LEVELS = ("whole", "section", "paragraph", "sentence", "word", "character")
#: A section begins with a short line between blank lines that ends without a mark.
_SECTION = re.compile(r"\n[ \t]*\n(?=[^\n]{1,80}(?<![.!?。！？؟۔।:,;])\n[ \t]*\n)")
_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")
_WORD_GAP = re.compile(r"\s+")


def _cuts(text: str, begin: int, end: int, level: int, sentences: list[int]) -> list[int]:
    """Inner boundaries of text[begin:end] at a level: places where a new part begins."""
    if level == 1:
        return [m.end() for m in _SECTION.finditer(text, begin, end) if begin < m.end() < end]
    if level == 2:
        return [m.end() for m in _PARAGRAPH.finditer(text, begin, end) if begin < m.end() < end]
    if level == 3:
        lo, hi = np.searchsorted(sentences, [begin, end], side="right")
        found = []
        for e in sentences[lo:hi]:
            m = _WORD_GAP.match(text, e)
            at = m.end() if m else e
            if begin < at < end:
                found.append(at)
        return found
    if level == 4:
        return [m.end() for m in _WORD_GAP.finditer(text, begin, end) if begin < m.end() < end]
    return list(range(begin + 1, end))


def split(text: str, max_tokens: int, overlap: int = 0, path: str = DEFAULT_VOCABULARY) -> list[tuple[int, int, int, str]]:
    """Pieces of a text as (start, end, tokens, level of the boundary at which the piece ends).

    Every piece has at most ``max_tokens`` tokens when tokenized by itself. Pieces without their overlap follow
    one another and together are the whole text. A piece after the first starts up to ``overlap`` tokens
    before the end of the piece before, exactly so many where a token boundary is a character boundary. Empty
    text has no piece.
    """
    if not 0 <= overlap < max_tokens:
        raise ValueError("overlap must be at least 0 and less than max_tokens")
    if not text:
        return []
    ends = token_ends(text, path)
    total = len(ends)
    if total <= max_tokens:
        return [(0, len(text), total, LEVELS[0])]
    encode = encoding(path).encode_ordinary
    sentences: list[int] = []
    room = max_tokens - overlap

    def tokens_to(position: int) -> int:
        return int(np.searchsorted(ends, position, side="left"))

    parts: list[tuple[int, int]] = []  # end of a part, level of that boundary
    stack = [(0, len(text), 1, 0)]
    while stack:
        begin, end, level, closing = stack.pop()
        if tokens_to(end) - tokens_to(begin) <= room - 2 and (level < 5 or end - begin == 1 or len(encode(text[begin:end])) <= room):
            parts.append((end, closing))
            continue
        if end - begin == 1:
            parts.append((end, closing))
            continue
        if level == 3 and not sentences:
            sentences = units(text)
        if level >= 5:  # characters: halves instead of single characters, packed again below
            middle = (begin + end) // 2
            stack.append((middle, end, 5, closing))
            stack.append((begin, middle, 5, 5))
            continue
        cuts = _cuts(text, begin, end, level, sentences)
        edges = [begin, *cuts, end]
        for a, b in reversed(list(zip(edges, edges[1:]))):
            stack.append((a, b, level + 1, closing if b == end else level))
    out: list[tuple[int, int, int, str]] = []
    start, covered, k = 0, 0, 0
    while k < len(parts):
        base, j = tokens_to(start), k
        while j + 1 < len(parts) and tokens_to(parts[j + 1][0]) - base <= max_tokens - 1:
            j += 1
        # the strongest boundary near the end is better than the last that fits
        best = min(range(max(k, j - 64), j + 1), key=lambda x: (parts[x][1] if parts[x][1] else 0, -x)) if j + 1 < len(parts) else j
        if j + 1 < len(parts) and tokens_to(parts[best][0]) - base >= 0.75 * max_tokens:
            j = best
        size = len(encode(text[start : parts[j][0]]))
        while size > max_tokens and j > k:
            j -= 1
            size = len(encode(text[start : parts[j][0]]))
        while size > max_tokens and start < covered:  # a long part after a long overlap
            start = min(covered, int(ends[min(tokens_to(start) + size - max_tokens, total - 1)]))
            size = len(encode(text[start : parts[j][0]]))
        end = parts[j][0]
        out.append((start, end, size, LEVELS[parts[j][1]]))
        covered, k = end, j + 1
        start = end
        if overlap and k < len(parts):
            start = max(out[-1][0], int(ends[max(tokens_to(end) - overlap - 1, 0)]))
            while start < end and len(encode(text[start:end])) > overlap:
                start += 1
    return out


def split_pieces(df: DataFrame, max_tokens: int, overlap: int = 0, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_VOCABULARY, only_oversized: bool = False) -> DataFrame:
    """One row per piece: (id, piece_index, piece_start, piece_end, n_tokens, ends_at, piece_text).

    A text within the limit is one piece. Null and empty texts give no rows; a repeated row gives its pieces
    again; further columns are ignored. ``only_oversized`` leaves out texts within the limit.
    """

    def run(ids, texts):
        out = ([], [], [], [], [], [], [])
        for key, text in zip(ids, texts):
            found = split(text, max_tokens, overlap, path) if text else []
            if only_oversized and len(found) < 2:
                continue
            for n, (start, end, size, level) in enumerate(found):
                for column, value in zip(out, (key, n, start, end, size, level, text[start:end])):
                    column.append(value)
        return out

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, text_col), run, f"`{id_col}` {kind}, piece_index int, piece_start bigint, piece_end bigint, n_tokens int, ends_at string, piece_text string")
