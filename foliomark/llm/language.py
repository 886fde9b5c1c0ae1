"""Languages of documents and of their paragraphs (problem 6).

Discrimination is hierarchical: a linear support vector machine of each pair of language families votes for
the family, then one of each pair of languages within it votes for the language. All are trained here, on a
bounded table of labelled sentences.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import arrow_map, staged
from .furniture import TABLE_ROW, is_header
from .sentences import REFERENCE
from .textform import Model, normalize

# Families of languages.
_FAMILIES = {
    "germanic": "en de nl sv da no",
    "romance": "fr es pt it ro ca",
    "slavic": "ru uk bg sr",
    "arabic": "ar ur fa",
    "indic": "hi mr ne",
    "sinic": "zh ja",
    "tai": "th lo",
}
# Two-letter codes with other codes and names in use for them.
_NAMES = {
    "en": "eng english anglais inglés englisch",
    "fr": "fra fre french français francais französisch",
    "de": "deu ger german deutsch allemand",
    "es": "spa spanish español espanol castellano castilian",
    "pt": "por portuguese português portugues",
    "it": "ita italian italiano",
    "ru": "rus russian русский",
    "ar": "ara arb arabic العربية",
    "ur": "urd urdu اردو",
    "hi": "hin hindi हिन्दी हिंदी",
    "fa": "fas per pes prs persian farsi فارسی",
    "zh": "zho chi cmn chinese mandarin 中文 汉语",
    "ja": "jpn japanese 日本語",
    "th": "tha thai ไทย",
}
_FAMILY = {lang: family for family, langs in _FAMILIES.items() for lang in langs.split()}
_CODE = {name: code for code, names in _NAMES.items() for name in (code, *names.split())}
DIMENSIONS = 4096
_LETTERS = re.compile(r"[^\W\d_]+")
_ENDS = re.compile(r"[.!?。！？؟۔।…][\s\"'”’»)\]」』“]*$")


def code_of(label: str | None) -> str | None:
    """Two-letter code of a label in any usual spelling; another text in lower case; None for blank or null."""
    if label is None or not label.strip():
        return None
    low = label.strip().casefold()
    if low in _CODE:
        return _CODE[low]
    return _CODE.get(re.split(r"[-_ ]", low)[0], low)


def features(text: str) -> np.ndarray:
    """Length-one vector of hashed character n-grams (1 to 4) of the letters."""
    words = _LETTERS.findall(text.lower())
    # names and terms in Latin letters say nothing about a text in another script
    latin = sum(map(len, (w for w in words if w.isascii())))
    other = sum(map(len, words)) - latin
    if other and latin and not any("\u00c0" <= c <= "\u024f" for c in text):
        words = [w for w in words if not w.isascii()] if other * 2 > latin else [w for w in words if w.isascii()]
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(codes), np.uint64)
    cells = []
    for n in range(min(4, len(codes))):
        h = h[: len(codes) - n] * np.uint64(0x9E3779B97F4A7C15) + codes[n:] + np.uint64(n * 7919)
        cells.append(h)
    h = np.concatenate(cells)
    out = np.bincount((((h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(52)).astype(np.int64), minlength=DIMENSIONS).astype(np.float32)
    np.sqrt(out, out=out)
    norm = float(np.sqrt((out * out).sum()))
    return out / norm if norm else out


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, rounds: int = 60) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine, by dual coordinate descent."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1).astype(np.float64)
    w, alpha, norms = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1)
    random = np.random.default_rng(1)
    for _ in range(rounds):
        for i in random.permutation(len(x)):
            gradient = y[i] * (w @ x[i]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Identifier:
    """Families first, then languages of the family; each level by one-versus-one linear machines."""

    def __init__(self, texts: list[str], langs: list[str]):
        x = np.array([features(t) for t in texts], np.float32).reshape(len(texts), DIMENSIONS)
        family = np.array([_FAMILY.get(lang, lang) for lang in langs])
        lang = np.array(langs)
        self.families = sorted(set(family.tolist()))
        self.members = {f: sorted(set(lang[family == f].tolist())) for f in self.families}
        self.level: dict[str, tuple[list[str], list[tuple[int, int]], np.ndarray]] = {"": self._machines(x, family, self.families)}
        for f in self.families:
            own = family == f
            self.level[f] = self._machines(x[own], lang[own], self.members[f])

    @staticmethod
    def _machines(x: np.ndarray, y: np.ndarray, classes: list[str]) -> tuple[list[str], list[tuple[int, int]], np.ndarray]:
        pairs = list(combinations(range(len(classes)), 2))
        weights = []
        for a, b in pairs:
            rows = (y == classes[a]) | (y == classes[b])
            weights.append(train_svm(x[rows], np.where(y[rows] == classes[a], 1.0, -1.0)))
        return classes, pairs, np.array(weights, np.float32).reshape(len(pairs), DIMENSIONS + 1)

    def _vote(self, level: str, v: np.ndarray) -> tuple[str, float]:
        classes, pairs, weights = self.level[level]
        if len(classes) == 1:
            return classes[0], 1.0
        margins = weights[:, :-1] @ v + weights[:, -1]
        votes, least = np.zeros(len(classes)), np.full(len(classes), np.inf)
        for (a, b), m in zip(pairs, margins.tolist()):
            for k, s in ((a, m), (b, -m)):
                votes[k] += s > 0
                least[k] = min(least[k], s)
        best = int(np.lexsort((least, votes))[-1])
        return classes[best], float(1 / (1 + np.exp(-3 * least[best])))

    def identify(self, text: str) -> tuple[str | None, float]:
        """(language, confidence between 0 and 1); (None, 0) for a text without letters."""
        if not text or not _LETTERS.search(text):
            return None, 0.0
        v = features(text)
        family, sure = self._vote("", v)
        lang, surer = self._vote(family, v)
        return lang, sure * surer


def learn(samples: DataFrame, bound: int = 20_000) -> Identifier:
    """Train on labelled sentences of (lang, text): all, or about ``bound``, as many of each language, chosen by a hash of the text."""
    labelled = samples.select("lang", "text").filter("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("size"))
    share = F.lit(float(bound)) / F.greatest(F.lit(1), F.lit(sizes.count())) / F.col("size")
    chosen = labelled.join(F.broadcast(sizes), "lang").filter(F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(1_000_000)) < F.ceil(share * 1_000_000))
    rows = sorted(chosen.select("lang", "text").collect())
    return Identifier([r["text"] for r in rows], [r["lang"] for r in rows])


def is_body(text: str, is_heading: bool | None = None) -> bool:
    """Whether a paragraph is running text: no heading, reference entry, page furniture or table rows."""
    s = text.strip()
    if is_heading or not s or REFERENCE.match(s):
        return False
    lines = [line.strip() for line in s.split("\n") if line.strip()]
    lines = [line for line in lines if not is_header(line) and not TABLE_ROW.fullmatch(line)]
    letters = sum(len(w) for line in lines for w in _LETTERS.findall(line))
    if letters < 8:
        return False
    if any(_ENDS.search(line) for line in lines):
        return True
    s = " ".join(lines)
    if re.search("[\u0e01-\u0e2e]", s) and not re.search(" [–-] ", s):
        return len(s) >= 45
    return len(s) >= (60 if re.search(r"[.!?。！？؟۔।]\s", s) else 120)


def paragraph_languages(paragraphs: DataFrame, model: Identifier, form: Model | None = None, id_col: str = "doc_id", index_col: str = "paragraph_index", text_col: str = "text") -> DataFrame:
    """(id, index, lang, confidence, letters, body) for every distinct (id, index) with a text.

    Texts are brought to one form with ``form`` before. Paragraphs without letters have a null language. Rows delivered twice give one row; null texts give none.
    """
    heading = F.col("is_heading") if "is_heading" in paragraphs.columns else F.lit(None).cast("boolean")

    def run(ids, indexes, texts, headings):
        out = ([], [], [], [], [], [])
        for key, index, text, head in zip(ids, indexes, texts, headings):
            if text is None or key is None:
                continue
            text = normalize(text, form)
            lang, sure = model.identify(text)
            for column, value in zip(out, (key, index, lang, sure, sum(map(len, _LETTERS.findall(text))), is_body(text, head))):
                column.append(value)
        return out

    found = arrow_map(paragraphs.select(F.col(id_col).cast("bigint"), F.col(index_col).cast("bigint"), text_col, heading), run, f"`{id_col}` bigint, `{index_col}` bigint, lang string, confidence double, letters int, body boolean")
    return found.dropDuplicates([id_col, index_col])


def document_languages(per_paragraph: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, lang, confidence, share) by most letters of body text, or of all text where there is no body.

    ``share`` is the part of the counted letters that is in the language, ``confidence`` the mean confidence of its
    paragraphs times that share. Ties go to the language first in the alphabet.
    """
    weight = F.when(F.col("body"), F.col("letters").cast("double") * 1e6).otherwise(F.col("letters").cast("double") * 1e-6)
    by = per_paragraph.filter("lang is not null").groupBy(id_col, "lang").agg(F.sum(weight).alias("w"), (F.sum(F.col("confidence") * weight) / F.sum(weight)).alias("sure"))
    best = by.groupBy(id_col).agg(F.sum("w").alias("all"), F.max_by(F.struct("lang", "w", "sure"), F.struct(F.col("w"), -F.ascii(F.col("lang")) * 256 - F.ascii(F.substring("lang", 2, 1)))).alias("top"))
    share = F.col("top.w") / F.col("all")
    return best.select(id_col, F.col("top.lang").alias("lang"), (F.col("top.sure") * share).alias("confidence"), share.alias("share"))


def wrong_labels(documents: DataFrame, paragraphs: DataFrame, model: Identifier, form: Model | None = None, id_col: str = "doc_id", least_confidence: float = 0.6) -> DataFrame:
    """(id, paragraph_index, lang): -1 for documents whose label is missing or wrong, from 0 for body paragraphs
    in another language than their document with at least ``least_confidence``. Documents without any letters give no rows."""
    per_paragraph = staged(paragraph_languages(paragraphs, model, form, id_col), "langs")
    languages = document_languages(per_paragraph, id_col)
    labels = documents.select(F.col(id_col).cast("bigint").alias(id_col), F.col("lang").alias("label"))
    joined = labels.join(languages.select(id_col, "lang"), id_col)

    def judge(ids, given, langs):
        rows = [(key, lang) for key, label, lang in zip(ids, given, langs) if code_of(label) != lang]
        return [r[0] for r in rows], [-1] * len(rows), [r[1] for r in rows]

    schema = f"`{id_col}` bigint, paragraph_index bigint, lang string"
    whole = arrow_map(joined.select(id_col, "label", "lang"), judge, schema)
    parts = per_paragraph.filter("body and lang is not null").filter(F.col("confidence") >= F.lit(least_confidence)).join(languages.select(id_col, F.col("lang").alias("most")), id_col).filter("lang <> most")
    return whole.unionByName(parts.select(id_col, "paragraph_index", "lang")).distinct()
