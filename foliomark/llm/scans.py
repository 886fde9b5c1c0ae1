"""Repair of text that was read from scanned pages (problem 1).

One pass over all texts counts words and trains skip-gram vectors, part by part, into hashed tables of fixed
size. Rare words of line-by-line texts are linked to frequent words that plausible glyph edits turn them into and
that are their neighbours by the skip-gram vectors: the words around an occurrence of the rare word must predict
the frequent one better than they predict other words. Among the linked the best in context is taken.
Furniture is removed, broken words are joined, and lines are put together into paragraphs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import arrow_map, ship, staged
from .furniture import BLANK, BODY, FURNITURE, HEADING, TABLE, classify, is_wrapped
from .textform import Model, normalize

ROWS, WIDTH, PARTS, NEGATIVE, WEIGHT = 1 << 14, 16, 16, 48, 2
# Glyphs as they are misread, and what stands there in truth.
EDITS = (
    ("c", "e"), ("@", "a"), ("!", "i"), ("ri", "n"), ("f", "t"), ("0", "o"), ("5", "s"), ("1", "l"), ("1", "i"), ("ii", "u"), ("cl", "d"), ("9", "g"), ("rn", "m"),
    ("b", "h"), ("h", "li"), ("vv", "w"), ("6", "é"), ("6", "b"), ("8", "b"), ("$", "s"), ("|", "l"), ("|", "i"), ("l", "i"), ("i", "l"), ("h", "b"), ("e", "c"),
    ("o", "c"), ("c", "o"), ("t", "f"), ("m", "rn"), ("d", "cl"), ("w", "vv"), ("u", "ii"), ("n", "ri"), ("li", "h"), ("nn", "m"), ("in", "m"), ("q", "g"), ("q", "9"),
    ("j", "i"), ("ni", "m"), ("ll", "u"), ("ii", "ü"), ("b", "ß"), ("6", "ó"), ("6", "ö"), ("c", "é"), ("0", "ö"), ("0", "ó"), ("a", "á"), ("4", "a"),
)
_ODD = frozenset("@!|$")
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|[̀-ًͯ-ٕऀ-ःऺ-ॏ@!|$]|[-'’](?=[^\W_]))*(?:[@$](?=\W|$))?|[@$|!][^\W\d_](?:[^\W_]|[@!|$])*")
_STRAY = re.compile(r"(?:^|(?<=\s))[|¦~•^_`]+(?=\s|$)")
_MARK = re.compile(r"[|¦~•^_`]")
_PLAIN = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_NUMBER = re.compile(r"(?:\d+[liob]\d+|[lio]\d+|\d+[lio]|\d{2,}b)(?:[.,]\d+)?$|\d+[.,]\d*[lio]\d*$")
_BREAK = re.compile(r"([^\W\d_][^\W_@]*(?:[@!|$][^\W_]+)*)([-‐‑¬­])[  ]*$")
_HYPHENS = frozenset("-\u2010\u2011\u00ac\u00ad")
_SURE = "¬­"


def tokens(text: str) -> list[str]:
    """Words in lower case, with misread marks inside them."""
    return [w.rstrip("!|") if w[-1] in "!|" else w for w in _TOKEN.findall(text.lower())]


_LETTER_OF = {BLANK: "_", BODY: "b", HEADING: "h", TABLE: "t", FURNITURE: "f"}
_KIND_OF = {letter: kind for kind, letter in _LETTER_OF.items()}


class Page:
    """A line-by-line text: its lines, what they are, and its running words with their places."""

    def __init__(self, text: str, model: Model | None, kinds: list[str] | None = None):
        self.raw, self.kinds = (text.split("\n"), kinds) if kinds else classify(text)
        self.lines = normalize("\n".join(line if kind != BLANK else "" for line, kind in zip(self.raw, self.kinds)), model).split("\n")
        self.lines = [line.strip() for line in self.lines]
        self.stray = {i for i, line in enumerate(self.lines) if _MARK.search(line) and self.kinds[i] != FURNITURE and _STRAY.search(line)}
        for i in self.stray:
            self.lines[i] = _STRAY.sub("", self.lines[i]).strip()
        self.body = [i for i, k in enumerate(self.kinds) if k not in (BLANK, FURNITURE)]
        self.breaks: dict[int, tuple[str, str, str, int]] = {}  # line -> (left part, mark, right part, next line)
        for i, j in zip(self.body, self.body[1:]):
            if self.kinds[i] in (HEADING, TABLE) or self.kinds[j] in (HEADING, TABLE):
                continue
            if self.lines[i][-1:] not in _HYPHENS:
                continue
            m = _BREAK.search(self.lines[i], max(0, len(self.lines[i]) - 60))
            following = _TOKEN.match(self.lines[j])
            if m and following and not following[0][0].isdigit():
                self.breaks[i] = (m[1].lower(), m[2], following[0].rstrip("!|").lower(), j)

    def words(self) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """(word in lower case, places): for each character its line; broken words are joined."""
        skip: dict[int, int] = {}  # line -> characters already taken by the word before
        for i in self.body:
            line = self.lines[i]
            end = len(line)
            if i in self.breaks:
                end = _BREAK.search(line, max(0, len(line) - 60)).start()
            for m in _TOKEN.finditer(line, skip.get(i, 0)):
                if m.start() >= end:
                    break
                inside = m[0][-1] == "!" and line[m.end() : m.end() + 1] == " " and (line[m.end() + 1 : m.end() + 2].islower() or line[m.end() + 1 : m.end() + 2] == "&")
                w = m[0] if inside else m[0].rstrip("!|")
                yield w.lower(), [(i, len(w))]
            if i in self.breaks:
                left, _, right, j = self.breaks[i]
                skip[j] = len(right)
                yield left + right, [(i, len(left)), (j, len(right))]


def _add(table: np.ndarray, rows: np.ndarray, steps: np.ndarray, rate: float) -> None:
    """Add to each row of the table the sum of its steps over their number to the power of three quarters; values stay within ten."""
    order = np.argsort(rows, kind="stable")
    ordered = rows.take(order)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    n = np.diff(np.append(first, len(rows))).astype(np.float32)
    changed = ordered.take(first)
    moved = np.add.reduceat(steps.take(order, axis=0), first, axis=0)
    moved *= (np.float32(rate) / n ** np.float32(0.75))[:, None]
    moved += table.take(changed, axis=0)
    table[changed] = np.clip(moved, -10, 10, out=moved)


def train(ids: list[np.ndarray], seed: int, v: np.ndarray, u: np.ndarray, rate: float = 0.3, window: int = 2, sub: float = 1e-4) -> None:
    """Skip-gram with negative sampling on runs of hashed words; changes ``v`` (words) and ``u`` (contexts).

    Frequent words are thinned out (``sub``); of what is left every pair within the window is trained on.
    """
    random = np.random.default_rng(seed)
    flat = np.concatenate(ids).astype(np.int16)  # two bytes are sorted by counting
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in ids])
    share = np.bincount(flat, minlength=ROWS) / max(1, len(flat))
    sub = max(sub, 0.01 / max(1, np.count_nonzero(share)))  # of few words none is frequent beside the others
    keep = random.random(len(flat), np.float32) < np.sqrt(sub / np.maximum(share, sub)).astype(np.float32)[flat]
    flat, owner = flat[keep], owner[keep]
    if len(flat) < 4:
        return
    left, right = [], []
    for step in range(1, window + 1):
        together = owner[step:] == owner[:-step]
        left.append(flat[:-step][together])
        right.append(flat[step:][together])
    a, b = np.concatenate([*left, *right]), np.concatenate([*right, *left])
    order = random.permutation(len(a))
    a, b = a[order], b[order]
    noise = np.cumsum(np.bincount(flat, minlength=ROWS).astype(np.float64) ** 0.75)
    size = min(8192, max(256, len(a) // 64))  # steps of one row that are taken together stay few
    for i in range(0, len(a), size):
        x, y = a[i : i + size], b[i : i + size]
        negative = np.searchsorted(noise, random.random(NEGATIVE) * noise[-1], side="right")
        vx, uy, un = v.take(x, axis=0), u.take(y, axis=0), u[negative]
        pull = 1 / (1 + np.exp(np.minimum(np.einsum("ij,ij->i", vx, uy), 30)))  # 1 - sigmoid
        push = vx @ -un.T
        np.exp(np.minimum(push, 30, out=push), out=push)
        push += 1
        np.divide(np.float32(WEIGHT / NEGATIVE), push, out=push)
        uy *= pull[:, None]
        uy -= push @ un
        _add(v, x, uy, rate)
        _add(u, y, pull[:, None] * vx, rate)
        u[negative] = np.clip(u[negative] - np.float32(rate) * (push.T @ vx) / np.float32(np.sqrt(len(x))), -10, 10)


def start() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(5)
    return (random.random((ROWS, WIDTH), np.float32) - 0.5) / WIDTH, (random.random((ROWS, WIDTH), np.float32) - 0.5) / WIDTH


def row_of(word: str) -> int:
    return xxhash.xxh32_intdigest(word) % ROWS


class _Rows(dict):
    """Rows of the words met so far."""

    def __missing__(self, word: str) -> int:
        row = self[word] = row_of(word)
        return row


def survey(documents: DataFrame, model: Model | None, id_col: str, text_col: str) -> DataFrame:
    """One pass over all texts: counted words, parts of the vector tables, and the line-by-line texts."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outside: Counter[str] = Counter()
        inside: Counter[str] = Counter()
        v, u = start()
        seen = np.zeros(ROWS, np.float32)
        rows, trained = _Rows(), 0
        schema = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = ["kind", "word", "a", "b", "payload"]

        def batch_of(columns: tuple[list, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema)], names=names)

        def counted() -> pa.RecordBatch:
            words = list(outside.keys() | inside.keys())
            return batch_of((["word"] * len(words), words, [inside[w] for w in words], [outside[w] for w in words], [None] * len(words)))

        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            kept, sequences = [], []
            for key, text in zip(ids, texts):
                if not text:
                    continue
                if is_wrapped(text):
                    page = Page(text, model)
                    found = [w for w, _ in page.words()]
                    inside.update(found)
                    kept.append(("page", text, key, None, "".join(_LETTER_OF[k] for k in page.kinds).encode()))
                    kept += [("use", w, key, 0, None) for w in set(found)]
                    kept += [("use", w, key, 1, None) for w in {x for left, _, right, _ in page.breaks.values() for x in (left + right, left + "-" + right)}]
                else:
                    found = _PLAIN.findall(normalize(text, model).lower())
                    outside.update(found)
                if len(found) > 1:
                    sequences.append(np.fromiter(map(rows.__getitem__, found), np.int64, len(found)))
            if sequences:
                seen += np.bincount(np.concatenate(sequences), minlength=ROWS)
                train(sequences, trained, v, u)
                trained += 1
            if kept:
                yield batch_of(tuple(map(list, zip(*kept))))
            if len(outside) + len(inside) > 500_000:
                yield counted()
                outside.clear()
                inside.clear()
                rows.clear()
        yield counted()
        if trained:
            task = TaskContext.get().partitionId()
            tables = np.concatenate([v, u, seen[:, None]], axis=1).reshape(PARTS, -1)
            yield batch_of((["part"] * PARTS, [None] * PARTS, list(range(PARTS)), [task] * PARTS, [_weighted(t, trained) for t in tables]))

    return documents.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(run, "kind string, word string, a bigint, b bigint, payload binary")


def _weighted(table: np.ndarray, weight: float) -> bytes:
    """A part of the tables of a task with its weight: columns of v, u and the counts of the rows."""
    return np.float32(weight).tobytes() + table.astype(np.float32).tobytes()


def vectors(surveyed: DataFrame, fan: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of fixed size (2 x 1 MB) and the counts of their rows: the mean of the tables of all tasks, weighted by how much each was trained.

    They are added up in a tree of at most ``fan`` (64 KB each) in a group, however many tasks there were.
    """

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total, counts, weight = 0.0, 0.0, 0.0
        for payload in pdf.payload:
            numbers = np.frombuffer(payload, np.float32)
            table = numbers[1:].reshape(-1, 2 * WIDTH + 1)
            total, counts, weight = total + numbers[0] * table[:, :-1], counts + table[:, -1], weight + numbers[0]
        mean = np.concatenate([total / weight, counts[:, None]], axis=1)
        return pd.DataFrame({"a": [key[0]], "b": [key[1]], "payload": [_weighted(mean, weight)]})

    parts = surveyed.filter("kind = 'part'").select("a", "b", "payload")
    tasks = (parts.agg(F.max("b")).first()[0] or 0) + 1
    while tasks > 1:
        parts = parts.withColumn("b", F.floor(F.col("b") / fan)).groupBy("a", "b").applyInPandas(merge, "a bigint, b bigint, payload binary")
        tasks = -(-tasks // fan)
    v, u = start()
    counts = np.zeros(ROWS, np.float32)
    size = ROWS // PARTS
    for row in parts.collect():
        part, at = np.frombuffer(row["payload"], np.float32)[1:].reshape(size, -1), row["a"] * size
        v[at : at + size], u[at : at + size], counts[at : at + size] = part[:, :WIDTH], part[:, WIDTH:-1], part[:, -1]
    return v, u, counts


def repairs(word: str) -> dict[str, int]:
    """Words that glyph edits lead to, with the number of edits.

    Two edits are plausible in words of nine characters or more, or of seven with a digit or mark inside; in shorter
    ones two edits lead from too many words to others.
    """
    found: dict[str, int] = {}
    layer = {word}
    for edits in range(1, 3 if len(word) >= 7 else 2):
        following = set()
        for w in layer:
            for wrong, right in EDITS:
                i = w.find(wrong)
                while i >= 0:
                    following.add(w[:i] + right + w[i + len(wrong) :])
                    i = w.find(wrong, i + 1)
        following -= found.keys() | {word}
        for w in following:
            if not _ODD & set(w):
                found[w] = edits
        layer = following
        if edits == 1 and not (_ODD | set("0123456789")) & set(word) and len(word) < 9:
            break
    return found


def link(words: DataFrame, least: int = 3, ratio: float = 12.0) -> DataFrame:
    """(word, outside, fixes) of rare words with frequent neighbours: fixes is a list of (fix, count, edits).

    ``words`` has word, inside, outside: counts within line-by-line texts and elsewhere.
    """
    rare = words.filter("inside > 0 and length(word) >= 2 and (word rlike '[a-z\\\\u00c0-\\\\u024f\\\\u0400-\\\\u04ff]')")

    def edges(keys, inside, outside):
        out = ([], [], [], [], [])
        for w, a, b in zip(keys, inside, outside):
            for fix, edits in repairs(w).items():
                for column, value in zip(out, (w, a, b, fix, edits)):
                    column.append(value)
        return out

    pairs = arrow_map(rare.select("word", "inside", "outside"), edges, "word string, inside bigint, outside bigint, fix string, edits int")
    known = words.filter(F.col("inside") + F.col("outside") >= least).select(F.col("word").alias("fix"), (F.col("inside") + F.col("outside")).alias("n"), F.col("outside").alias("fix_outside"))
    good = pairs.join(known, "fix").filter((F.col("n") >= F.lit(ratio) * F.col("outside")) & (F.col("n") >= F.col("inside") * 2) & (F.col("outside") <= 0.01 * F.col("fix_outside") + F.lit(0.2)))
    return good.groupBy("word").agg(F.first("outside").alias("outside"), F.collect_list(F.struct("fix", "n", "edits")).alias("fixes"))


class Reader:
    """Reads one page with the links and counts of its words."""

    def __init__(self, v: np.ndarray, u: np.ndarray, counts: np.ndarray | None = None):
        self.v, self.u = v, u
        known = v if counts is None or not (counts >= 5).any() else v[counts >= 5]
        self.mean, self.trained = known.mean(axis=0), bool(known.any())

    def nearness(self, word: str, context: np.ndarray) -> float:
        """How much more the context predicts the word than the mean of all words, as a logarithm; no vectors predict nothing."""
        return float((self.v[row_of(word)] - self.mean) @ context) if self.trained and context.any() else -np.inf

    def correct(self, word: str, around: list[str], outside: int, fixes: list[tuple[str, int, int]]) -> str | None:
        """The best reading in context, or None where the word had better stay.

        Fixes are neighbours of the context; the less frequent a fix is beside the word, the more the context has to
        speak for it: more than 0.25 for a word as frequent, 0.25 less for each factor of ten, -0.5 at least.
        """
        if not around:
            return None
        context = self.u[[row_of(w) for w in around]].mean(axis=0)
        near = [(self.nearness(w, context), w, n, edits) for w, n, edits in fixes]
        near = [(z, w, n, edits) for z, w, n, edits in near if z > max(-0.5, 0.25 - 0.25 * np.log10(n / (1 + outside)))]
        if not near:
            return None

        def score(z: float, n: int, edits: int) -> float:
            return z + 0.5 * float(np.log(n)) - edits

        best = max(near, key=lambda f: (score(f[0], f[2], f[3]), f[1]))
        if outside and score(best[0], best[2], best[3]) <= score(self.nearness(word, context), outside, 0) + 1.0:
            return None
        return best[1]

    def read(self, page: Page, fixes: dict[str, tuple[int, list[tuple[str, int, int]]]], counts: dict[str, int]) -> tuple[set[int], set[int], dict[tuple[int, str], str]]:
        """(broken lines, misread lines, corrections by (line, word))."""
        hyphen: set[int] = set()
        kept: set[int] = set()
        for i, (left, mark, right, _) in page.breaks.items():
            whole, compound = counts.get(left + right, 0), counts.get(left + "-" + right, 0)
            if mark in _SURE or whole >= compound:
                hyphen.add(i)
            else:
                kept.add(i)
        misread = set(page.stray)
        corrections: dict[tuple[int, str], str] = {}
        found = list(page.words())
        for k, (word, places) in enumerate(found):
            if word not in fixes and word.isalpha():
                continue
            if _NUMBER.fullmatch(word):
                misread.add(places[0][0])
                continue
            if len(places) > 1 and places[0][0] in kept:
                continue  # two words with their own hyphen
            odd = bool(_ODD & set(word.rstrip("!|")))
            fix = None
            if word in fixes:
                outside, options = fixes[word]
                around = [w for w, _ in found[max(0, k - 2) : k] + found[k + 1 : k + 3]]
                fix = self.correct(word, around, outside, options)
            if fix is None:
                if odd and re.search(r"[^\W\d_][@!|$][^\W\d_]|^[@$][^\W\d_]{2}|[^\W\d_]{2}[@$]$", word) or re.search(r"[^\W\d_]{2}\d[^\W\d_]+|^[05169][^\W\d_]{3,}$|[^\W\d_]{3}[0519]$", word) and not re.fullmatch(r"[a-z]{1,3}\d.*", word):
                    at = re.search(r"[@!|$\d]", word)
                    misread.add(_line(places, at.start()))
                continue
            at = next((x for x in range(min(len(fix), len(word))) if fix[x] != word[x]), min(len(fix), len(word)) - 1)
            misread.add(_line(places, at))
            corrections[(places[0][0], word)] = fix
        return hyphen, misread, corrections


def _line(places: list[tuple[int, int]], at: int) -> int:
    for line, size in places:
        if at < size:
            return line
        at -= size
    return places[-1][0]


def _recased(word: str, fix: str) -> str:
    return fix.upper() if word.isupper() and len(word) > 1 else fix[:1].upper() + fix[1:] if word[:1].isupper() else fix


def _corrected(token: str, line: int, corrections: dict[tuple[int, str], str]) -> str:
    word = token.rstrip("!|")
    fix = corrections.get((line, word.lower()))
    return token if fix is None else _recased(word, fix) + token[len(word) :]


def paragraphs(page: Page, hyphen: set[int], corrections: dict[tuple[int, str], str]) -> list[tuple[bool, str]]:
    """(is heading or table row, text) of the repaired page in order."""
    out: list[tuple[bool, str]] = []
    open_text, last = "", -2
    for i in page.body:
        line = _TOKEN.sub(lambda m, i=i: _corrected(m[0], i, corrections), page.lines[i])
        line = re.sub(r"\s+", " ", line).strip()
        if page.kinds[i] in (HEADING, TABLE):
            if open_text:
                out.append((False, open_text))
            out.append((True, line))
            open_text = ""
            continue
        gap = any(page.kinds[k] == BLANK for k in range(last + 1, i))
        between = any(page.kinds[k] == FURNITURE for k in range(last + 1, i))
        if open_text and gap and not (between and not re.search(r"[.!?。！？؟۔।][\"'”’»)\]」“]*$", open_text)):
            out.append((False, open_text))
            open_text = ""
        if open_text and last in hyphen:
            m = _BREAK.search(open_text)
            if m:
                left, _, right, j = page.breaks[last]
                whole = m[1] + line[: len(right)]
                open_text = open_text[: m.start()] + _recased(whole, corrections.get((last, left + right), whole.lower() if whole.islower() else whole)) + line[len(right) :]
                last = i
                continue
        if open_text and last in page.breaks and last not in hyphen:
            open_text += line
        else:
            open_text = f"{open_text} {line}" if open_text else line
        last = i
    if open_text:
        out.append((False, open_text))
    return out


def repair(documents: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Defects of line-by-line texts and their repaired paragraphs.

    Returns defects (id, line_no, defect) with defect furniture, hyphen or misread, and paragraphs (id,
    paragraph_index, is_body, text): running text without furniture, with broken words joined and misread words
    corrected. Texts that are not laid out line by line have no defects and keep their paragraphs. Null texts
    and null ids give no rows; a repeated id is read once for each row; an empty table gives empty results.
    """
    surveyed = staged(survey(documents.filter(F.col(id_col).isNotNull()), model, id_col, text_col), "survey")
    words = staged(surveyed.filter("kind = 'word'").groupBy("word").agg(F.sum("a").alias("inside"), F.sum("b").alias("outside")), "words")
    links = staged(link(words), "links")
    v, u, seen = vectors(surveyed)
    pages = surveyed.filter("kind = 'page'").select(F.col("a").alias("id"), F.col("word").alias("text"), F.col("payload").alias("kinds"))
    needed = surveyed.filter("kind = 'use'").select(F.col("a").alias("id"), "word", (F.col("b") == 1).alias("broken")).distinct()
    fixes = needed.filter("not broken").join(links, "word").select("id", F.struct("word", "outside", "fixes").alias("fix"), F.lit(None).cast("struct<word:string,n:bigint>").alias("count"))
    counts = needed.filter("broken").join(words, "word").select("id", F.lit(None).cast(fixes.schema["fix"].dataType).alias("fix"), F.struct("word", (F.col("inside") + F.col("outside")).alias("n")).alias("count"))
    known = fixes.unionByName(counts).groupBy("id").agg(F.collect_list("fix").alias("fix"), F.collect_list("count").alias("count"))
    reader = Reader(v, u, seen)

    def run(ids, texts, kinds, fixing, counting):
        out: tuple[list, ...] = ([], [], [], [], [])

        def put(*row) -> None:
            for column, value in zip(out, row):
                column.append(value)

        for key, text, kind_letters, fix, count in zip(ids, texts, kinds, fixing, counting):
            page = Page(text, model, [_KIND_OF[c] for c in kind_letters.decode()])
            table = {f["word"]: (f["outside"], [(x["fix"], x["n"], x["edits"]) for x in f["fixes"]]) for f in fix or []}
            hyphen, misread, corrections = reader.read(page, table, {c["word"]: c["n"] for c in count or []})
            for i, kind in enumerate(page.kinds):
                if kind == FURNITURE:
                    put(key, i, "furniture", None, None)
            for i in sorted(hyphen):
                put(key, i, "hyphen", None, None)
            for i in sorted(misread):
                put(key, i, "misread", None, None)
            for i, (apart, content) in enumerate(paragraphs(page, hyphen, corrections)):
                put(key, i, "paragraph", not apart, content)
        return out

    read = staged(arrow_map(pages.join(known, "id", "left").select("id", "text", "kinds", "fix", "count"), run, "id bigint, n bigint, kind string, is_body boolean, text string"), "read")
    defects = read.filter("kind <> 'paragraph'").select(F.col("id").alias(id_col), F.col("n").alias("line_no"), F.col("kind").alias("defect")).distinct()
    return defects, read.filter("kind = 'paragraph'").select(F.col("id").alias(id_col), F.col("n").cast("int").alias("paragraph_index"), "is_body", "text")


def unwrapped_paragraphs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph_index, is_body, text) of texts that are not laid out line by line."""

    def run(ids, texts):
        out: tuple[list, ...] = ([], [], [], [])
        for key, text in zip(ids, texts):
            if not text or key is None or is_wrapped(text):
                continue
            blocks = [b.strip() for b in re.split(r"\n\s*\n", text) if b.strip()]
            for i, b in enumerate(blocks):
                for column, value in zip(out, (key, i, bool(re.search(r"[.!?。！？؟۔।…][\"'”’»)\]」“]*$", b)), b)):
                    column.append(value)
        return out

    return arrow_map(documents.select(F.col(id_col).cast("bigint").alias(id_col), text_col), run, f"`{id_col}` bigint, paragraph_index int, is_body boolean, text string")
