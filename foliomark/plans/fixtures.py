"""Texts that hold what the test tables lack, added to the documents of some queries and to the SQL that checks them."""

from __future__ import annotations

_SIGNALS = (
    "Certainly! It's worth noting that this multifaceted question plays a crucial role in the field. Furthermore, it is of use to navigate the complexities of the matter. "
    "As an AI model one may delve into the tapestry of results and embark on a comprehensive overview of them all, and in conclusion it is clear."
)
_CLAUSES = "I hope this helps. Here's a summary of the text, and let me know if more is needed. I'd be happy to add a list of all the parts that were left out of the first and the second draft of it."
_TERMS = "Machine learning is not artificial intelligence. Machine learning needs data; ML and AI differ, said the ML group of the AI lab. Machine learning, ML for short, is part of artificial intelligence, and AI of ML is artificial intelligence."
_CITED = (
    "The first result is known [1] and the second [2-4], as (Smith et al., 2020) show and [1,3] confirm. Studies show that the cost falls every year in all regions. The result [1] holds [1 9].\n\n"
    "References\n\n[1] Smith, J. (2020). A study of costs in regions. Nature, 12, 1-9. https://doi.org/10.1234/abcd.5678\n[2] Doe, J. (2031). Innovative breakthrough of next-generation methods. International Journal of Advanced Modern Research.\n"
    "[7] Brown, A. and Jones, B. (1850). Never cited in this text at all. Springer.\n"
)
_REPEATED = (
    "Results Of The Survey\nThe weighted interval of the regional sample narrows over the whole decade, as the raters of the second panel noted.\n"
    "Results Of The Survey\nThe weighted interval of the regional sample narrows over the whole decade, as the raters of the second panel noted.\nA short line."
)
#: (doc_id, text); ids are negative, so that they differ from all others.
TEXTS: tuple[tuple[int, str], ...] = ((-1, _SIGNALS), (-2, _CLAUSES), (-3, _TERMS), (-4, _CITED), (-5, _REPEATED))


def values_sql() -> str:
    """The rows as SQL."""
    return ", ".join("(" + str(i) + ", '" + text.replace("'", "''") + "')" for i, text in TEXTS)
