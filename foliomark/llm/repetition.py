"""Repetition inside one document, and cutoffs on it with a guaranteed error rate (problem 7).

Every document gets a score, the part of its runs of words that are duplicates, and a label. Cutoffs on that score
are chosen from all documents, stratum by stratum: the lowest cutoff whose false rejections are limited with
certainty by an exact binomial bound. Labels come from comparing the words themselves with those before them. The
levels are corrected for the strata (Bonferroni) and for the cutoffs tried (fixed sequence, strictest first).
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import arrow_map, staged
from .neardup import _mix, hashed
from .textform import Model, normalize
from .words import is_unspaced, words

RUN, RUN_UNSPACED = 6, 12
STRATA = ("latin", "other", "unspaced")
_LATIN = re.compile("[A-Za-z\u00c0-\u024f\u1e00-\u1eff]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(tokens: Sequence[str], run: int) -> np.ndarray:
    n = len(tokens) - run + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = hashed(list(tokens))
    grams = h[:n].copy()
    for k in range(1, run):
        grams = grams * _P + h[k : k + n]
    return _mix(grams)


def measured(tokens: Sequence[str], run: int) -> tuple[float, int]:
    """(part of the runs of ``run`` words that repeat an earlier one, how many words lie in such a run)."""
    grams = _gram_hashes(tokens, run)
    if len(grams) < 2:
        return 0.0, 0
    distinct, first, inverse = np.unique(grams, return_index=True, return_inverse=True)
    if len(distinct) == len(grams):
        return 0.0, 0
    again = np.flatnonzero(first[inverse] < np.arange(len(grams)))
    flags = np.zeros(len(tokens) + 1, np.int32)
    np.add.at(flags, again, 1)
    np.add.at(flags, again + run, -1)
    return 1 - len(distinct) / len(grams), int((np.cumsum(flags)[:-1] > 0).sum())


def repeated_words(tokens: Sequence[str], run: int) -> int:
    """How many words lie in a run of ``run`` words that begins at an earlier place too."""
    return measured(tokens, run)[1]


def repeated_words_exactly(tokens: Sequence[str], run: int) -> int:
    """The same by comparing the words themselves."""
    seen: set[tuple[str, ...]] = set()
    inside = [False] * len(tokens)
    for i in range(len(tokens) - run + 1):
        gram = tuple(tokens[i : i + run])
        if gram in seen:
            inside[i : i + run] = [True] * run
        seen.add(gram)
    return sum(inside)


def is_bad(tokens: Sequence[str], run: int, share: float, again: int) -> bool:
    """Whether at least ``share`` of the words lie in a run that begins at an earlier place too, by the words themselves.

    ``again`` words lie in runs whose hash is met earlier. Equal runs have equal hashes, so that no more can lie in
    equal ones; where each such run equals the first of its hash word by word, it is just as many.
    """
    least = share * len(tokens) - 1e-9
    if not tokens or again < least:
        return False
    grams = _gram_hashes(tokens, run)
    _, first, inverse = np.unique(grams, return_index=True, return_inverse=True)
    before = first[inverse]
    later = np.flatnonzero(before < np.arange(len(grams)))
    if all(tokens[i : i + run] == tokens[j : j + run] for i, j in zip(later.tolist(), before[later].tolist())):
        return True
    return repeated_words_exactly(tokens, run) >= least


def _prepared(text: str, model: Model | None) -> tuple[list[str], int, str]:
    form = normalize(text, model)
    unspaced = is_unspaced(form)
    tokens = words(form)
    latin = form.isascii() or 2 * sum(map(len, _LATIN.findall(form))) >= sum(map(len, tokens))
    return tokens, RUN_UNSPACED if unspaced else RUN, "unspaced" if unspaced else "latin" if latin else "other"


def repetition(df: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", share: float | None = None) -> DataFrame:
    """(id, stratum, n_words, score, repeated_words, repeated_share, repeated_paragraph_share) of every text.

    ``score`` is the part of the runs that are duplicates. ``repeated_share`` counts words in runs of six (12 letters or digits in scripts without spaces) met
    earlier in the text; ``repeated_paragraph_share`` counts characters of paragraphs met earlier. Texts
    without words have share 0; null texts give no rows; a repeated row is measured again. With a ``share`` each text
    has its label too (``is_bad``).
    """

    def run(ids, texts):
        out = ([], [], [], [], [], [], []) if share is None else ([], [], [], [], [], [], [], [])
        for key, text in zip(ids, texts):
            if text is None:
                continue
            tokens, length, stratum = _prepared(text, model)
            score, again = measured(tokens, length)
            blocks = [b.strip() for b in text.split("\n\n") if b.strip()]
            seen: set[str] = set()
            twice = 0
            for b in blocks:
                twice += len(b) if b in seen else 0
                seen.add(b)
            values = (key, stratum, len(tokens), score, again, again / len(tokens) if tokens else 0.0, twice / sum(map(len, blocks)) if blocks else 0.0)
            for column, value in zip(out, values if share is None else (*values, is_bad(tokens, length, share, again))):
                column.append(value)
        return out

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, text_col), run, f"`{id_col}` {kind}, stratum string, n_words int, score double, repeated_words int, repeated_share double, repeated_paragraph_share double" + ("" if share is None else ", is_bad boolean"))


def binomial_upper(failures: int, trials: int, delta: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a rate at confidence 1 - delta."""
    if failures >= trials:
        return 1.0
    k = np.arange(failures, -1, -1, dtype=np.float64)
    ways = math.lgamma(trials + 1) - math.lgamma(failures + 1) - math.lgamma(trials - failures + 1)
    ways += np.concatenate(([0.0], np.cumsum(np.log(k[:-1]) - np.log(trials - k[:-1] + 1))))

    def at_most(p: float) -> float:
        logs = ways + k * math.log(p) + (trials - k) * math.log1p(-p)
        top = float(logs.max())
        return math.exp(top) * float(np.exp(logs - top).sum())

    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        if at_most(middle) > delta:
            low = middle
        else:
            high = middle
    return high


def choose_cutoffs(rows: Sequence[tuple[str, float, bool] | tuple[str, float, bool, int]], grid: Sequence[float], alpha: float, delta: float, strata: Sequence[str] = STRATA) -> dict[str, tuple[float | None, int, int, float]]:
    """For each stratum (cutoff, false rejections, acceptable texts, bound) from (stratum, score, is_bad) rows; a fourth
    value is the number of texts that a row stands for.

    The cutoff is the lowest of the grid whose false-rejection rate among acceptable texts is at most ``alpha`` by
    the exact bound. Each stratum has confidence 1 - delta / strata; within it cutoffs are tried from the strictest
    on and the first that fails ends the sequence, so that all statements hold together with probability 1 - delta.
    A stratum whose strictest cutoff fails already, for want of labels, has no cutoff (None) and that cutoff's bound.
    """
    out: dict[str, tuple[float | None, int, int, float]] = {}
    for stratum in strata:
        good = [(s, n[0] if n else 1) for t, s, bad, *n in rows if t == stratum and not bad]
        scores, counts = np.array([s for s, _ in good]), np.array([n for _, n in good], np.int64)
        total = int(counts.sum())
        chosen = None
        for cutoff in sorted(grid, reverse=True):
            failures = int(counts[scores >= cutoff].sum())
            bound = binomial_upper(failures, total, delta / len(strata)) if total else 1.0
            if bound > alpha:
                chosen = chosen or (None, failures, total, bound)
                break
            chosen = (cutoff, failures, total, bound)
        out[stratum] = chosen
    return out


def labelled(scores: DataFrame, grid: Sequence[float]) -> list[tuple[str, float, bool, int]]:
    """(stratum, highest cutoff of the grid that the score reaches or 0, is_bad, number of texts) of all labelled scores.

    Rows that repeat an id with equal measures are one text.
    """
    reached = F.coalesce(F.array_max(F.filter(F.array(*map(F.lit, grid)), lambda cutoff: cutoff <= F.col("score"))), F.lit(0.0))
    return [tuple(r) for r in scores.distinct().groupBy("stratum", reached.alias("reached"), "is_bad").count().collect()]


def repetitive(df: DataFrame, model: Model | None = None, share: float = 0.4, alpha: float = 0.02, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", cutoffs: dict[str, float | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents rejected as repetitive, and the cutoffs.

    Returns rejected (id, stratum, score, repeated_share, cutoff, certain) and cutoffs (stratum, cutoff,
    false_rejections, acceptable, bound): a document is rejected from the cutoff of its stratum on, which wrongly
    rejects at most ``alpha`` of the acceptable documents. ``certain`` tells whether the exact share reaches
    ``share`` too. A stratum with too few labels for any cutoff (cutoff null) has no guarantee to give, so that only
    its certain documents are rejected. All documents are labelled for it; ``cutoffs`` takes the place of the cutoffs
    chosen from them. Null texts are not rejected; an empty table gives no rejected rows.
    """
    scores = staged(repetition(df, model, id_col, text_col, share if cutoffs is None else None), "repetition")
    grid = [k / 100 for k in range(1, 101)]
    found = choose_cutoffs(labelled(scores, grid), grid, alpha, delta) if cutoffs is None else {s: (c, None, None, None) for s, c in cutoffs.items()}
    table = df.sparkSession.createDataFrame([(s, *v) for s, v in found.items()], "stratum string, cutoff double, false_rejections int, acceptable int, bound double")
    certain = (F.col("n_words") > 0) & (F.col("repeated_words") >= F.lit(share) * F.col("n_words") - 1e-9)
    known = scores.withColumn("certain", certain).join(F.broadcast(table.select("stratum", "cutoff")), "stratum", "left")
    rejected = known.filter(F.coalesce(F.col("score") >= F.col("cutoff"), F.col("certain")))
    return rejected.select(id_col, "stratum", "score", "repeated_share", "cutoff", "certain"), table
