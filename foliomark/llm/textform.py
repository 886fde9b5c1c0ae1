"""One consistent form for texts that look the same (problem 5).

Compatibility normalization and the deletion of ignorable characters come first. Then every token that mixes
alphabets, or consists of letters that all have a twin in another alphabet, is looked up in a lattice of its
look-alikes: for each alphabet the best path under that alphabet's character bigrams is found (Viterbi), and
the alphabet with the best path, given the alphabet around the token, wins.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import arrow_map

LATIN, CYRILLIC, GREEK = "latin", "cyrillic", "greek"
ARMENIAN, CHEROKEE, COPTIC = "armenian", "cherokee", "coptic"
# Letters and the Latin letter each looks like.
_TWINS = {
    CYRILLIC: "аa вb еe ёë іi їï јj оo рp сc уy хx ѕs һh ԁd ԛq ԝw пn кk ӏl мm тt гr АA ВB ЕE ЁË ІI ЇÏ ЈJ КK МM НH ОO РP СC ЅS ТT УY ХX ҮY ӓä ӧö ӱü ӒÄ ӦÖ",
    ARMENIAN: "օo ոn սu հh ցg զq յj ԼL ՍU ՏS ՕO",
    CHEROKEE: "ᎪA ᎬE ᎻH ᎫJ ᏦK ᎷM ᏢP ᎡR ᎢT ᎳW ᏃZ ᏟC ᏚS ᏴB ᏀG ᏞL ᏙV ᎠD",
    COPTIC: "ⲟo ⲣp ⲥc ⲩy ⲭx ⲓi ⲞO ⲢP ⲤC ⲨY ⲬX ⲎH ⲔK ⲘM ⲚN ⲦT ⲒI",
    GREEK: "αa νv οo υu ρp ιi κk ηn τt ωw γy χx ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX άá έé όó ύú ίí ϋü ϊï",
}
#: Twins that are alike in shape only roughly; they never make a token suspicious by themselves.
_ROUGH = frozenset("вмтгкηκτωγχιρ")
_TO_LATIN = {pair[0]: pair[1] for words in _TWINS.values() for pair in words.split()}
_FROM_LATIN: dict[str, dict[str, list[str]]] = {script: {} for script in _TWINS}
for _script, _words in _TWINS.items():
    for _pair in _words.split():
        _FROM_LATIN[_script].setdefault(_pair[1], []).append(_pair[0])

_WIDE = re.compile("[\uff21-\uff3a\uff41-\uff5a\uff10-\uff19]")
_ACCENT = re.compile("([A-Za-z\u00c0-\u024f\u1e00-\u1eff\uff21-\uff3a\uff41-\uff5a\u0370-\u04ff])[\u0300-\u036f]")
_IGNORABLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200e\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff"
#: Joiners stay between letters of scripts that need them.
_JOINING = "\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\u0900-\u0dff\u1820-\u18aa\ufb50-\ufdff\ufe70-\ufefc"
_DELETE = re.compile(f"(?<![{_JOINING}])[\u200c\u200d]|[\u200c\u200d](?![{_JOINING}])|[{_IGNORABLE}]")
_HIDDEN = re.compile(f"[{_IGNORABLE}\u200c\u200d]+")
_SPACES = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_TOKEN = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[\u0300-\u036f])*")
_CYRILLIC = re.compile("[\u0431\u0432\u0433\u0434\u0436\u0437\u0438\u0439\u043b\u043d\u0442\u0444\u0446-\u044f]")
_OTHER = re.compile("[\u0370-\u058f\u13a0-\u13fd\u2c80-\u2cee]")
_BEFORE_SPACE, _AFTER_SPACE = ",;.:)]}”’\"'", "([{“‘\"'"


def script_of(c: str) -> str | None:
    """The alphabet of a letter; None for anything else."""
    if c < "\u0370":
        return LATIN if c.isalpha() else None
    if c < "\u0400":
        return GREEK
    if c < "\u0530":
        return CYRILLIC
    if c < "\u0590":
        return ARMENIAN
    if "\u13a0" <= c <= "\u13fd":
        return CHEROKEE
    if "\u2c80" <= c <= "\u2cee":
        return COPTIC
    return LATIN if "\u1e00" <= c <= "\u1eff" else None


class Model:
    """Character bigrams of each alphabet, from clean samples."""

    def __init__(self, texts: Iterable[str] = (), pairs: dict[str, Counter[str]] | None = None):
        pairs = pairs or self.pairs(texts)
        self.logs: dict[str, dict[str, float]] = {}
        self.unseen: dict[str, float] = {}
        for kind, counts in pairs.items():
            total = sum(counts.values()) + 2000.0
            self.logs[kind] = {p: math.log((n + 0.5) / total) for p, n in counts.items()}
            self.unseen[kind] = math.log(0.5 / total) if counts else -9.0
        self.cache: dict[tuple[str, str], str] = {}

    @staticmethod
    def pairs(texts: Iterable[str]) -> dict[str, Counter[str]]:
        """Character bigrams of the words of one alphabet, by alphabet."""
        out: dict[str, Counter[str]] = {s: Counter() for s in (LATIN, CYRILLIC, GREEK)}
        for text in texts:
            for m in _TOKEN.finditer(unicodedata.normalize("NFKC", text).lower()):
                kinds = {script_of(c) for c in m[0]}
                if len(kinds) == 1 and (kind := kinds.pop()) in out:
                    w = f"^{m[0]}$"
                    out[kind].update(w[i : i + 2] for i in range(len(w) - 1))
        return out

    def best(self, token: str, around: str) -> str:
        """The token in the alphabet that fits best; ``around`` is the alphabet of the text near it."""
        key = (token, around)
        if key in self.cache:
            return self.cache[key]
        if len(self.cache) > 200_000:
            self.cache.clear()
        found, top = token, -math.inf
        for kind in (LATIN, CYRILLIC, GREEK):
            path = self._viterbi(token, kind)
            if path is None:
                continue
            score, word = path
            score += 1.5 * len(token) ** 0.5 * (kind == around) + (2.0 if kind == around else 0.0)
            if score > top + 1e-9:
                found, top = word, score
        self.cache[key] = found
        return found

    def _viterbi(self, token: str, kind: str) -> tuple[float, str] | None:
        logs, unseen = self.logs[kind], self.unseen[kind]
        states: dict[str, tuple[float, str]] = {"^": (0.0, "")}
        for c in token:
            if unicodedata.combining(c):
                states = {k: (s, w + c) for k, (s, w) in states.items()}
                continue
            options = lookalikes(c, kind)
            if not options:
                return None
            following: dict[str, tuple[float, str]] = {}
            for option, cost in options:
                low = option.lower()
                score, word = max((s + logs.get(before + low, unseen), w) for before, (s, w) in states.items())
                score -= cost
                if low not in following or score > following[low][0]:
                    following[low] = (score, word + option)
            states = following
        return max((s + logs.get(before + "$", unseen), w) for before, (s, w) in states.items())


def lookalikes(c: str, kind: str) -> list[tuple[str, float]]:
    """Letters of an alphabet that look like ``c``, with the cost of taking them."""
    own = script_of(c)
    if own == kind:
        return [(c, 0.0)]
    if own is None:
        return [(c, 0.0)] if kind == LATIN else []
    latin = c if own == LATIN else _TO_LATIN.get(c)
    if latin is None:
        return []
    if kind == LATIN:
        return [(latin, 1.0)]
    return [(x, 1.0) for x in _FROM_LATIN[kind].get(latin, ())]


def _suspicious(token: str) -> bool:
    """Mixed alphabets, or every letter has a close twin in another alphabet. Units such as \u03bcm are neither."""
    if token[0] == "\u03bc" and len(token) <= 3 and token[1:].isascii():
        return False
    kinds = {script_of(c) for c in token if not unicodedata.combining(c)}
    if len(kinds - {None}) > 1:
        return True
    if kinds == {GREEK}:
        return len(token) > 1 and all(c in _TO_LATIN for c in token if not unicodedata.combining(c))
    if kinds == {CYRILLIC}:
        return all(c in _TO_LATIN for c in token if not unicodedata.combining(c)) and any(c not in _ROUGH for c in token)
    return False


def _around(text: str, begin: int, end: int) -> str:
    """The alphabet of the text near a token, told by letters that have no twin in another alphabet."""
    latin = other = 0
    for m in _TOKEN.finditer(text, max(0, begin - 80), min(len(text), end + 80)):
        if m.start() < end and m.end() > begin:
            continue
        for c in m[0]:
            if "a" <= c <= "z" or "A" <= c <= "Z" or "\u00c0" <= c <= "\u024f":
                latin += c not in "aceiopxyABCEHIJKMOPSTXYjs"
            elif "\u0400" <= c <= "\u04ff":
                other += c not in _TO_LATIN or c in "вмтгк"
    return CYRILLIC if other > latin else LATIN


def _latin_twins(token: str) -> bool:
    """A Latin token of which every letter has a Cyrillic twin of the same look."""
    return all(c in "aceopxyABCEHKMOPTX" for c in token)


def _compatible(text: str) -> str:
    """Compatibility form without ignorable characters and with plain spaces only."""
    if _HIDDEN.search(text):
        text = _DELETE.sub("", text)
    if not unicodedata.is_normalized("NFKC", text):
        text = _DELETE.sub("", unicodedata.normalize("NFKC", text))
    return _SPACES.sub(" ", text) if _SPACES.search(text) else text


def normalize(text: str, model: Model | None) -> str:
    """The consistent form of a text. Case is kept; without a model look-alike letters are kept too."""
    if text.isascii():
        return text
    text = _compatible(text)
    if model is None or not _OTHER.search(text):
        return text
    out, at = [], 0
    for begin, end, word in _replacements(text, model):
        out += (text[at:begin], word)
        at = end
    if not out:
        return text
    out.append(text[at:])
    return unicodedata.normalize("NFC", "".join(out))


def _candidates(text: str) -> Iterable[tuple[int, int]]:
    """Tokens that hold a letter of another alphabet than Latin; where there is Cyrillic that has no twin all tokens."""
    if _CYRILLIC.search(text):
        yield from (m.span() for m in _TOKEN.finditer(text))
        return
    done = 0
    for m in _OTHER.finditer(text):
        i, j = m.span()
        if i < done:
            continue
        while i > 0 and (text[i - 1].isalpha() or "\u0300" <= text[i - 1] <= "\u036f"):
            i -= 1
        while j < len(text) and (text[j].isalpha() or "\u0300" <= text[j] <= "\u036f"):
            j += 1
        done = j
        yield i, j


def _replacements(text: str, model: Model) -> Iterable[tuple[int, int, str]]:
    """Tokens to be replaced, as (begin, end, replacement)."""
    for begin, end in _candidates(text):
        token = text[begin:end]
        if len(token) == 1 and (script_of(token) == GREEK or text[end : end + 1] == "."):
            continue  # a symbol, an initial
        if token.isascii():
            if not _latin_twins(token) or _around(text, begin, end) != CYRILLIC:
                continue
        elif not _OTHER.search(token) or not _suspicious(token):
            continue
        around = _around(text, begin, end)
        if around == CYRILLIC and all(script_of(c) == CYRILLIC for c in token):
            continue
        word = model.best(token, around)
        if word != token:
            yield begin, end, word


FORMS = ("width", "accent", "invisible", "space", "lookalike")


def forms(text: str, model: Model) -> list[str]:
    """Which of the forms in ``FORMS`` a text holds."""
    if text.isascii():
        return []
    out = []
    if _WIDE.search(text):
        out.append("width")
    for m in _ACCENT.finditer(text):
        if script_of(unicodedata.normalize("NFKC", m[1])) == LATIN or m[1] in _TO_LATIN and _around(text, *m.span()) == LATIN:
            out.append("accent")
            break
    for m in _HIDDEN.finditer(text):
        a, b = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if not a or not b or unicodedata.category(a)[0] not in "LM" or unicodedata.category(b)[0] not in "LM":
            continue
        if set(m[0]) <= {"\u200c", "\u200d"} and re.match(f"[{_JOINING}]", a) and re.match(f"[{_JOINING}]", b):
            continue
        out.append("invisible")
        break
    for m in _SPACES.finditer(text):
        i, j = m.start() - 1, m.end()
        while i >= 0 and text[i] in _BEFORE_SPACE:
            i -= 1
        while j < len(text) and text[j] in _AFTER_SPACE:
            j += 1
        if i < 0 or j >= len(text):
            continue
        a, b = text[i], text[j]
        if unicodedata.category(a)[0] in "LMN" and unicodedata.category(b)[0] in "LMN" and not (a.isdigit() and b.isdigit()):
            out.append("space")
            break
    if _OTHER.search(text):
        if any(True for _ in _replacements(_compatible(text), model)):
            out.append("lookalike")
    return out


def learn(samples: DataFrame, *more: DataFrame) -> Model:
    """The bigram model of all texts of clean sample tables, counted where they lie.

    What comes to the driver are counts of pairs of letters of one alphabet, whose number the alphabets bound.
    """
    texts = samples.select("text")
    for df in more:
        texts = texts.union(df.select("text"))

    def run(found):
        rows = [(kind, pair, n) for kind, counts in Model.pairs(t for t in found if t).items() for pair, n in counts.items()]
        return tuple(map(list, zip(*rows))) if rows else ([], [], [])

    pairs: dict[str, Counter[str]] = {s: Counter() for s in (LATIN, CYRILLIC, GREEK)}
    for r in arrow_map(texts, run, "kind string, pair string, n bigint").groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["kind"]][r["pair"]] = r["n"]
    return Model(pairs=pairs)


def found_forms(df: DataFrame, model: Model, kind: str, id_col: str, text_col: str) -> DataFrame:
    """(record_kind, record_id, form) for every row and form it holds; null and empty texts hold none."""

    def run(ids, texts):
        rows = [(key, form) for key, text in zip(ids, texts) if text for form in forms(text, model)]
        return [kind] * len(rows), [r[0] for r in rows], [r[1] for r in rows]

    return arrow_map(df.select(id_col, text_col), run, "record_kind string, record_id bigint, form string")


def consistent(df: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(id, consistent_text) for every row; null stays null."""

    def run(ids, texts):
        return ids, [None if t is None else normalize(t, model) for t in texts]

    type_ = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, text_col), run, f"`{id_col}` {type_}, consistent_text string")
