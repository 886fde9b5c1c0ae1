"""Text functions over columns: cleaning, words, sentences, paragraphs, headings, chunks, references.

White space is every Unicode space and control separator; words are runs of letters, digits and underscores,
lower-cased. Null texts give null or empty arrays, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and words in the dialects of the JVM and of RE2 alike.
WS = r"[\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"
#: Marks a full stop that belongs to an abbreviation while sentences are split.
_DOT = "\x01"
# Abbreviations after which no sentence ends.
ABBREVIATIONS = ("Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "etc.", "i.e.", "e.g.", "vs.", "Fig.", "Eq.", "No.", "U.S.", "U.K.", "al.")
# Titles of reference sections and of usual sections.
REFERENCE_TITLES = ("references", "bibliography", "works cited", "literature cited", "sources")
SECTION_TITLES = ("abstract", "introduction", "methodology", "results", "discussion", "conclusion", "references", "bibliography", "acknowledgements")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def clean_text(c: Column) -> Column:
    """Unix line ends, no control characters, at most one blank line, single blanks, no outer white space."""
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]+", " ")
    return trimmed(c)


def pieces(c: Column) -> Column:
    """What white space parts (the count of these is the plain word count)."""
    return F.filter(F.split(c, f"{WS}+"), lambda x: x != "")


def tokens(c: Column) -> Column:
    """Words in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, also where ``fn`` uses it inside a lambda."""
    return F.transform(F.array(value), fn)[0]


def grams(words: Column, n: int) -> Column:
    """Runs of n words, joined by blanks; empty for null and for fewer than n words."""

    def runs(w: Column) -> Column:
        m = F.size(w) - (n - 1)
        shifted = F.arrays_zip(*(F.slice(w, k, m).alias(f"w{k}") for k in range(1, n + 1)))
        return F.when(m > 0, F.transform(shifted, lambda x: F.concat_ws(" ", *(x[f"w{k}"] for k in range(1, n + 1))))).otherwise(F.array().cast("array<string>"))

    return bound(words, runs)


def sentences(c: Column, protect: bool = True) -> Column:
    """Sentences that end with a mark before white space and an ASCII capital."""
    if protect:
        for short in ABBREVIATIONS:
            c = F.replace(c, F.lit(short), F.lit(short.replace(".", _DOT)))
    parts = F.split(c, f"(?<=[.!?]){WS}+(?=[A-Z])")
    if protect:
        parts = F.transform(parts, lambda x: F.replace(x, F.lit(_DOT), F.lit(".")))
    return F.filter(F.transform(parts, trimmed), lambda x: x != "")


def document_sentences(c: Column, least: int = 20) -> Column:
    """Sentences of a whole document on collapsed white space, of more than ``least`` characters, without care for abbreviations."""
    parts = F.split(F.regexp_replace(c, f"{WS}+", " "), "(?<=[.!?]) +(?=[A-Z])")
    return F.filter(F.transform(parts, trimmed), lambda x: F.length(x) > least)


def style_sentences(c: Column) -> Column:
    """Sentences without care for abbreviations, of more than five characters, on collapsed white space."""
    return F.filter(sentences(F.regexp_replace(c, f"{WS}+", " "), protect=False), lambda x: F.length(x) > 5)


def paragraphs(c: Column, least: int = 40) -> Column:
    """Paragraphs by blank lines, or by lines where blank lines make fewer than three.

    Successive short pieces are joined by blanks; what stays below ``least`` characters is dropped.
    """
    clean = clean_text(c)
    blocks = F.split(clean, rf"\n{WS}*\n")
    raw = F.transform(F.when(F.size(blocks) < 3, F.split(clean, "\n")).otherwise(blocks), trimmed)
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("out"), F.lit("").alias("held"))

    def step(state: Column, piece: Column) -> Column:
        out, held = state["out"], state["held"]
        flushed = F.when(held != "", F.concat(out, F.array(held))).otherwise(out)
        short = F.length(piece) < least
        return (
            F.when(piece == "", F.struct(flushed.alias("out"), F.lit("").alias("held")))
            .when(short, F.struct(out.alias("out"), F.when(held != "", F.concat_ws(" ", held, piece)).otherwise(piece).alias("held")))
            .otherwise(F.struct(F.concat(flushed, F.array(piece)).alias("out"), F.lit("").alias("held")))
        )

    folded = F.aggregate(raw, start, step, lambda s: F.when(s["held"] != "", F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"]))
    return F.filter(folded, lambda x: F.length(x) >= least)


def is_heading(c: Column, most_words: int = 12) -> Column:
    """Whether a paragraph looks like a heading: short, no full stop, and numbered, titled, capital or in title case."""
    s = trimmed(c)
    words = pieces(s)
    n = F.size(words)
    stop = s.endswith(".") & ~s.endswith("...") & ~s.rlike(rf"^[0-9]+\.{WS}")
    shape = (
        s.rlike(rf"^(?i:chapter|section|part){WS}+[0-9]+") | s.rlike(rf"^[0-9]+\.([0-9]+)?{WS}+[A-Z]") | s.rlike(rf"^[IVX]+\.{WS}+[A-Z]")
        | F.lower(s).isin(*SECTION_TITLES)
    )
    capital = s.rlike(r"\p{Lu}") & ~s.rlike(r"\p{Ll}") & n.between(2, 10)
    title = n.between(2, 8) & (F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))) >= n * 0.8) & ~s.endswith(".")
    return F.coalesce((s != "") & (n <= most_words) & (F.length(s) <= 100) & ~stop & (shape | capital | title), F.lit(False))


def chunks(c: Column, size: int = 200, overlap: int = 40, least: int = 20) -> Column:
    """Overlapping chunks of ``size`` white-space words; later chunks of fewer than ``least`` words are left out."""

    def cut(words: Column) -> Column:
        n = F.size(words)
        starts = F.when(n > size, F.sequence(F.lit(1), n, F.lit(size - overlap))).otherwise(F.array(F.lit(1)))
        parts = F.transform(starts, lambda i: F.slice(words, i, size))
        kept = F.filter(parts, lambda p, i: (i == 0) | (F.size(p) >= least))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(kept, lambda p: F.array_join(p, " ")))

    return bound(pieces(c), cut)


def document_key(c: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the text."""
    return F.substring(F.sha2(c, 256), 1, 16)


def syllables(word: Column) -> Column:
    """Groups of vowels, without a final e, at least one."""
    groups = F.regexp_count(word, F.lit("[aeiouy]+"))
    return F.greatest(F.lit(1), groups - F.when(word.endswith("e") & (groups > 1), 1).otherwise(0))


def syllable_total(words: Column) -> Column:
    """Sum of ``syllables`` over an array of words, in three passes over the words as one string."""

    def counted(line: Column) -> Column:
        groups = F.regexp_count(line, F.lit("[aeiouy]+"))
        silent = F.regexp_count(line, F.lit(" [^ ]*?[aeiouy][^aeiouy ][^ ]*e(?= )"))  # a final e after another group
        none = F.regexp_count(line, F.lit(" [^aeiouy ]+(?= )"))
        return (groups - silent + none).cast("bigint")

    return bound(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), counted)


def domain(url: Column) -> Column:
    """Host of an address with its port, without user names."""
    return F.regexp_extract(url, r"^(?:web:)?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def html_text(html: Column) -> Column:
    """Visible text of a page: no scripts, styles, navigation, headers or footers; entities decoded; blanks collapsed."""
    c = html
    for tag in ("script", "style", "nav", "footer", "header"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return trimmed(F.regexp_replace(c, f"{WS}+", " "))
