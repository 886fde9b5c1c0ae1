"""Citations in running text, reference entries, and what is wrong with either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import REFERENCE_TITLES, WS, pieces, sentences, trimmed

# Patterns of citations, identifiers and claims.
NUMERIC = r"\[[0-9]+(?:\s*[,\-–]\s*[0-9]+)*\]"
AUTHOR_YEAR = r"\([A-Z][a-zA-Z\-]+(?:\s+(?:and|&|et\s+al\.?))?(?:\s+[A-Z][a-zA-Z\-]+)?(?:\s*,\s*[A-Z][a-zA-Z\-]+)*,?\s+[0-9]{4}[a-z]?\)"
AUTHOR_BESIDE_YEAR = r"[A-Z][a-zA-Z\-]+\s+\([0-9]{4}[a-z]?\)"
NUMERIC_INLINE = r"\[[0-9]+(?:[,\-\s]+[0-9]+)*\]"
AUTHOR_YEAR_INLINE = r"\([A-Z][a-zA-Z\-]+(?:\s+et\s+al\.?)?,?\s+[0-9]{4}[a-z]?\)"
DOI = r"\b10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+\b"
CLAIM = r"(?i)\b(?:studies\s+show|research\s+shows|it\s+has\s+been\s+(?:shown|proven|demonstrated|found)|according\s+to|researchers?\s+(?:found|reported|discovered)|evidence\s+suggests|data\s+(?:shows|indicates)|reported\s+that|found\s+that|[0-9]+(?:\.[0-9]+)?%)\b"
NEW_ENTRY = r"^\s*(?:\[[0-9]+\]|[0-9]+\.|[A-Z][a-zA-Z\-]+,\s+[A-Z]\.)"
# Names that make a journal known, a publisher known, a name template-like, an author common.
KNOWN_JOURNALS = (
    "nature", "science", "cell", "lancet", "jama", "bmj", "plos one", "scientific reports", "journal of machine learning research",
    "ieee transactions on pattern analysis and machine intelligence", "acm transactions on graphics", "artificial intelligence", "neural networks",
    "pattern recognition", "computer vision and image understanding", "journal of artificial intelligence research", "machine learning", "data mining and knowledge discovery",
)
KNOWN_PUBLISHERS = (
    "elsevier", "springer", "wiley", "taylor", "francis", "sage", "oxford", "cambridge", "ieee", "acm", "nature", "science", "plos", "frontiers", "mdpi", "emerald",
    "lippincott", "bmj", "jama", "lancet", "cell", "american", "royal", "iospress",
)
TEMPLATE_WORDS = (
    "advanced", "innovative", "cutting-edge", "emerging", "breakthrough", "revolutionary", "next-generation", "modern", "contemporary",
    "international journal of", "global journal of", "world journal of", "american journal of", "european journal of",
)
COMMON_NAMES = (
    "j", "john", "james", "smith", "doe", "johnson", "williams", "brown", "jones", "garcia", "miller", "davis", "rodriguez", "martinez", "hernandez", "lopez",
    "gonzalez", "wilson", "anderson", "thomas",
)
TEMPLATES = (
    r"(?i)\bJournal of (?:Advanced|Modern|Emerging|Innovative|Cutting-Edge|Next-Generation)\s+\w+\s+(?:Research|Studies|Science|Technology)\b",
    r"(?i)\bInternational Journal of (?:Advanced|Modern|Emerging)\b",
)
JOURNAL = r"(Journal of [A-Z][a-zA-Z\s]{2,60}|[A-Z][a-zA-Z]+ (?:Journal|Review|Reviews|Letters|Transactions|Proceedings|Reports|Studies|Research))"


def references_section(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> DataFrame:
    """(id, entry_index, entry): entries after the first line that is the title of a reference section.

    A blank line or a line that looks like the beginning of an entry closes the entry before; entries of
    ``least`` characters or fewer are dropped. Texts without such a line have none.
    """
    lines = df.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("n", "line")).withColumn("line", trimmed(F.col("line")))
    of_text = Window.partitionBy(id_col).orderBy("n")
    title = F.regexp_replace(F.lower("line"), r"\s+", " ").isin(*REFERENCE_TITLES)
    after = lines.withColumn("title", title).withColumn("begin", F.min(F.when(F.col("title"), F.col("n"))).over(Window.partitionBy(id_col))).filter(F.col("n") > F.col("begin"))
    blank = F.col("line") == ""
    opens = blank | F.col("line").rlike(NEW_ENTRY) | (F.lag(blank, 1, True).over(of_text))
    grouped = after.withColumn("entry", F.sum(opens.cast("int")).over(of_text)).filter(~blank)
    merged = grouped.groupBy(id_col, "entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " ").alias("text"))
    kept = merged.filter(F.length("text") > least)
    return kept.select(id_col, (F.row_number().over(Window.partitionBy(id_col).orderBy("entry")) - 1).alias("entry_index"), F.col("text").alias("entry"))


def inline_citations(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, raw) of every citation: numeric, author_year in either form, doi. A text may hold one twice.

    These are the plain forms of running text; ``placed_citations`` takes the wider ones, with several authors.
    """
    kinds = (("numeric", NUMERIC_INLINE), ("author_year", AUTHOR_YEAR_INLINE), ("author_year", AUTHOR_BESIDE_YEAR), ("doi", DOI))

    def tagged(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0)), lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("raw")))

    found = F.flatten(F.array(*(tagged(k, p) for k, p in kinds)))
    return df.select(id_col, F.explode(found).alias("c")).select(id_col, "c.kind", "c.raw")


def placed_citations(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100) -> DataFrame:
    """(id, kind, raw, position, context) in order of position; one citation of a position."""
    import re

    from ..plans.session import arrow_map

    compiled = (("numeric", re.compile(NUMERIC)), ("author_year", re.compile(AUTHOR_YEAR)))

    def run(ids, texts):
        out: tuple[list, ...] = ([], [], [], [], [])
        for key, text in zip(ids, texts):
            seen: dict[int, tuple[str, str]] = {}
            for kind, pattern in compiled:
                for m in pattern.finditer(text or ""):
                    seen.setdefault(m.start(), (kind, m[0]))
            for at, (kind, raw) in sorted(seen.items()):
                for column, value in zip(out, (key, kind, raw, at, text[max(0, at - window) : at + len(raw) + window].replace("\n", " "))):
                    column.append(value)
        return out

    return arrow_map(df.select(id_col, text_col), run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, kind string, raw string, position bigint, context string")


def cited_numbers(raw: Column) -> Column:
    """Numbers of a numeric citation; ranges are spelled out, a range that runs backwards is empty."""
    parts = F.split(F.regexp_replace(raw, r"[\[\]\s]", ""), ",")

    def expand(part: Column) -> Column:
        bounds = F.transform(F.split(part, "[-–]"), lambda x: F.try_to_number(x, F.lit("999999999")).cast("bigint"))
        low, high = bounds[0], F.element_at(bounds, -1)
        return F.when((F.size(bounds) <= 2) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    return F.flatten(F.transform(parts, expand))


def citation_numbers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, number, times) of the numbers that numeric citations of a text name."""
    numeric = df.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit(NUMERIC), F.lit(0))).alias("raw"))
    return numeric.select(id_col, F.explode(cited_numbers(F.col("raw"))).alias("number")).groupBy(id_col, "number").agg(F.count("*").alias("times"))


def citation_issues(cited: DataFrame, listed: DataFrame, id_col: str = "doc_id", many: int = 3) -> DataFrame:
    """(id, issue, number, times): missing_reference, unused_reference and excessive_citation.

    ``cited`` has (id, number, times), ``listed`` (id, number).
    """
    listed = listed.select(id_col, "number").filter("number is not null").distinct()
    missing = cited.join(listed, [id_col, "number"], "left_anti").select(id_col, F.lit("missing_reference").alias("issue"), "number", "times")
    unused = listed.join(cited, [id_col, "number"], "left_anti").select(id_col, F.lit("unused_reference").alias("issue"), "number", F.lit(0).cast("bigint").alias("times"))
    often = cited.filter(F.col("times") >= many).select(id_col, F.lit("excessive_citation").alias("issue"), "number", "times")
    return missing.unionByName(unused).unionByName(often)


def citation_coverage(cited: DataFrame, listed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, listed, coverage): the share of listed numbers that are cited."""
    listed = listed.select(id_col, "number").filter("number is not null").distinct()
    joined = listed.join(cited.select(id_col, "number", F.lit(1).alias("hit")), [id_col, "number"], "left")
    return joined.groupBy(id_col).agg(F.count("*").alias("listed"), (F.count("hit") / F.count("*")).alias("coverage"))


def uncited_claims(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 6) -> DataFrame:
    """(id, sentence, matched): sentences that read like claims and hold no citation, cut to 200 characters."""
    s = df.select(id_col, F.explode(sentences(F.col(text_col))).alias("sentence"))
    claims = s.filter(F.col("sentence").rlike(CLAIM) & ~F.col("sentence").rlike(NUMERIC) & ~F.col("sentence").rlike(AUTHOR_YEAR) & (F.size(pieces(F.col("sentence"))) >= least_words))
    return claims.select(id_col, F.substring("sentence", 1, 200).alias("sentence"), F.regexp_extract("sentence", f"({CLAIM})", 1).alias("matched"))


def parsed_reference(raw: Column) -> Column:
    """A struct (index, year, doi, authors, title, journal) of a reference entry."""
    empty = lambda c: F.when(c != "", c)
    bracketed = F.regexp_extract(raw, r"\(([0-9]{4}[a-z]?)\)", 1)
    loose = F.regexp_extract(raw, r"\b((?:19|20)[0-9]{2})\b", 1)
    year = F.coalesce(empty(bracketed), empty(loose))
    before = F.when(bracketed != "", F.regexp_extract(raw, r"^((?s:.*?))\([0-9]{4}[a-z]?\)", 1)).when(loose != "", F.regexp_extract(raw, r"^((?s:.*?))\b(?:19|20)[0-9]{2}\b", 1)).otherwise("")
    after = F.when(bracketed != "", F.regexp_extract(raw, r"\([0-9]{4}[a-z]?\)((?s:.*))$", 1)).when(loose != "", F.regexp_extract(raw, r"\b(?:19|20)[0-9]{2}\b((?s:.*))$", 1)).otherwise("")
    names = F.split(F.regexp_replace(F.regexp_replace(before, r"^\s*\[[0-9]+\]\s*", ""), r"^\s*[0-9]+\.\s*", ""), r",|&|\band\b")
    authors = F.transform(F.filter(F.transform(names, trimmed), lambda a: F.length(a).between(3, 49)), lambda a: F.regexp_replace(a, r"[.,&]+$", ""))
    title = F.substring(trimmed(F.regexp_extract(F.regexp_replace(after, r"^[\)\.\s]+", ""), r"^([^.\n]{10,200})", 1)), 1, 200)
    return F.struct(
        empty(F.regexp_extract(raw, r"^\s*\[([0-9]+)\]", 1)).cast("bigint").alias("index"), year.alias("year"),
        empty(F.regexp_extract(raw, r"\b(10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+)", 1)).alias("doi"),
        F.when(year.isNull(), F.array().cast("array<string>")).otherwise(F.slice(authors, 1, 6)).alias("authors"),
        title.alias("title"), trimmed(F.regexp_extract(raw, JOURNAL, 1)).alias("journal"),
    )


def reference_scores(df: DataFrame, as_of_year: int, id_cols: tuple[str, ...] = ("ref_id",), raw_col: str = "raw") -> DataFrame:
    """(ids, doi_score, journal_score, year_score, author_score, title_score, template_score, probability, risk).

    Scores of single signs add up; 1.5 is certainty. ``as_of_year`` replaces the clock.
    """
    p = df.select(*id_cols, F.col(raw_col).alias("_raw"), parsed_reference(F.col(raw_col)).alias("p"))
    journal, year = F.lower("p.journal"), F.substring("p.year", 1, 4).cast("int")

    def has(column: Column, words: tuple[str, ...]) -> Column:
        return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(column, w))

    authors = F.col("p.authors")
    common = F.forall(authors, lambda a: F.arrays_overlap(F.split(F.lower(a), r"\s+"), F.array(*(F.lit(n) for n in COMMON_NAMES))))
    scores = {
        "doi_score": F.when(F.col("p.doi").isNull(), 0.25).otherwise(0.0),
        "journal_score": F.when(journal == "", 0.15).when(has(journal, KNOWN_JOURNALS), 0.0).when(has(journal, KNOWN_PUBLISHERS), 0.05).when(has(journal, TEMPLATE_WORDS), 0.30).otherwise(0.15),
        "year_score": F.when(year.isNull(), 0.15).when(year < 1900, 0.4).when(year > as_of_year + 1, 0.5).when(year >= as_of_year - 1, 0.05).otherwise(0.0),
        "author_score": F.when(F.size(authors) == 0, 0.20).when((F.size(authors) >= 2) & common, 0.25).otherwise(0.0),
        "title_score": F.when(F.col("p.title") == "", 0.10).when(F.length("p.title") < 15, 0.15).otherwise(0.0),
        "template_score": F.when(F.col("_raw").rlike(TEMPLATES[0]) | F.col("_raw").rlike(TEMPLATES[1]), 0.4).otherwise(0.0),
    }
    scored = p.select(*id_cols, *(c.alias(n) for n, c in scores.items()))
    scored = scored.withColumn("probability", F.least(F.lit(1.0), sum((F.col(n) for n in scores), F.lit(0.0)) / 1.5))
    return scored.withColumn("risk", F.when(F.col("probability") >= 0.65, "critical").when(F.col("probability") >= 0.45, "high").when(F.col("probability") >= 0.25, "medium").otherwise("low"))
