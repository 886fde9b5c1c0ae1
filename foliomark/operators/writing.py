"""Signals of generated writing, marks of writing tools, and style fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import grams, pieces, style_sentences, syllable_total, tokens

# Phrases, marks, patterns and word lists.
PHRASES = (
    "furthermore", "moreover", "in conclusion", "it is important to note", "it is worth noting", "in summary", "additionally", "in today's world", "in the realm of",
    "when it comes to", "plays a crucial role", "plays a vital role", "delve into", "comprehensive understanding", "multifaceted", "in the ever-evolving", "cutting-edge",
    "groundbreaking", "paradigm shift", "leverage", "robust", "seamless", "navigate the complexities", "tapestry", "testament to",
)
MARKS = ".,;:!?—-\"'()"
STYLE_MARKS = ".,;:!?—-"
TOOLS = {
    "gemini": (r"\bas an ai\b", r"\bi cannot\b.*\bprovide\b", r"\bi'm unable to\b", r"\bhowever, it's important to note\b", r"\bin today's (?:world|digital age|fast-paced)\b", r"\bdelve into\b", r"\bembark on\b", r"\btapestry of\b"),
    "chatgpt": (r"\bcertainly!?\b", r"\bof course!?\b", r"\bit'?s worth noting that\b", r"\bin conclusion,? it is\b", r"\bfurthermore,? it is\b", r"\bmoreover,? it is\b", r"\bnavigate the complexities\b", r"\bplays a (?:crucial|vital|pivotal) role\b", r"\bmultifaceted\b", r"\bcomprehensive (?:understanding|overview|analysis)\b"),
    "claude": (r"\bi appreciate\b", r"\bi hope this helps\b", r"\bwould you like me to\b", r"\bhere'?s a (?:breakdown|summary|list)\b", r"\bi'd be happy to\b", r"\blet me know if\b"),
}
STYLE_PATTERNS = (
    r"(?:^|\n)\s*#{1,4}\s+", r"\n\s*1\.\s+.{20,}\n\s*2\.\s+", r"\n\s*[-•]\s+.{20,}\n\s*[-•]\s+", r"\bin conclusion\b", r"\bto summarize\b", r"\bin summary\b",
    r"\bmoreover\b.{10,}\bfurthermore\b", r"\btruly\b.{1,50}\btruly\b", r"\bvery\b.{1,50}\bvery\b.{1,50}\bvery\b",
)
FUNCTION_WORDS = (
    "the", "a", "an", "and", "or", "but", "if", "of", "to", "in", "on", "at", "by", "for", "with", "from", "as", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "can", "may", "might", "must", "this", "that", "these", "those", "i", "you", "he",
    "she", "it", "we", "they", "them", "their", "our", "your", "his", "her", "its", "my", "me", "us",
)
SUBORDINATORS = (
    "because", "although", "while", "since", "if", "when", "whereas", "unless", "until", "though", "that", "which", "who",
)
#: Weights of the six signals.
WEIGHTS = {"perplexity": 0.25, "burstiness": 0.20, "vocabulary": 0.15, "uniformity": 0.15, "phrases": 0.20, "punctuation": 0.05}
CUTS = {"perplexity": (0.65, 0.40), "burstiness": (0.6, 0.35), "vocabulary": (0.6, 0.35), "uniformity": (0.6, 0.35), "phrases": (0.6, 0.3), "punctuation": (0.6, 0.35)}


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x, lambda s: s / F.size(values))


def _deviation(values: Column) -> Column:
    """Standard deviation over all values, from exact sums of squares."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s + x)
    squares = F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s + x * x)
    return F.sqrt((n * squares - total * total).cast("double")) / n


def writing_signals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words, entropy, cv, ttr, top_start, phrases, marks, six scores, overall, level) of every text.

    Null texts count as empty. Texts of fewer than 30 white-space words are INCONCLUSIVE with score 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col), text.alias("_t")).withColumn("_w", tokens(F.col("_t"))).withColumn("_s", style_sentences(F.col("_t"))).withColumn("words", F.size(pieces(F.col("_t"))))
    base = base.withColumn("_len", F.transform("_s", lambda s: F.size(pieces(s)).cast("bigint"))).withColumn("_n", F.size("_w"))
    # entropy of word pairs: the counts of a text are made beside it, and only its counts move
    pairs = base.select(id_col, F.explode(F.transform(grams(F.col("_w"), 2), lambda g: F.xxhash64(g))).alias("g")).groupBy(id_col, "g").agg(F.count("*").alias("c"))
    entropy = pairs.groupBy(id_col).agg(F.sum("c").alias("total"), F.sum(F.col("c") * F.log2("c")).alias("weighted")).select(id_col, ((F.log2("total") - F.col("weighted") / F.col("total")) / F.log2(F.greatest(F.col("total"), F.lit(2)))).alias("entropy"))
    starts = base.select(id_col, F.explode(F.transform("_s", lambda s: F.lower(F.array_join(F.slice(pieces(s), 1, 2), " ")))).alias("start")).groupBy(id_col, "start").agg(F.count("*").alias("c")).groupBy(id_col).agg((F.max("c") / F.sum("c")).alias("top_start"))
    lower = F.lower("_t")
    facts = base.select(
        id_col, "words", F.col("_n").alias("n_tokens"), F.size("_s").alias("n_sentences"), F.length("_t").alias("n_chars"),
        F.when(F.size("_s") > 0, _deviation(F.col("_len")) / _mean(F.col("_len"))).alias("cv"),
        F.when(F.col("_n") > 0, F.size(F.array_distinct("_w")) / F.col("_n")).alias("ttr"),
        sum((F.contains(lower, F.lit(p)).cast("int") for p in PHRASES), F.lit(0)).alias("phrases"),
        sum((F.contains("_t", F.lit(m)).cast("int") for m in MARKS), F.lit(0)).alias("marks"),
    )
    joined = facts.join(entropy, id_col, "left").join(starts, id_col, "left")
    scores = {
        "perplexity": F.when(F.col("n_tokens") >= 20, _unit(1 - F.col("entropy") * 2)).otherwise(0.0),
        "burstiness": F.when(F.col("n_sentences") >= 5, _unit(1 - F.col("cv") * 1.8)).otherwise(0.0),
        "vocabulary": F.when(F.col("n_tokens") >= 30, _unit(1 - (F.col("ttr") - 0.35) * 2.5)).otherwise(0.0),
        "uniformity": F.when(F.col("n_sentences") >= 5, _unit(F.col("top_start") * 2 - 0.3)).otherwise(0.0),
        "phrases": F.when(F.col("words") >= 20, _unit(F.col("phrases") / F.greatest(F.col("words") / 100, F.lit(1.0)) / 4)).otherwise(0.0),
        "punctuation": F.when(F.col("n_chars") < 100, 0.0).when(F.col("marks") == 0, 0.5).otherwise(_unit(1 - F.col("marks") / 8)),
    }
    scored = joined.select("*", *(c.alias(f"{n}_score") for n, c in scores.items()))
    enough = F.col("words") >= 30
    overall = sum((F.col(f"{n}_score") * w for n, w in WEIGHTS.items()), F.lit(0.0))
    high = sum(((F.col(f"{n}_score") >= CUTS[n][0]).cast("int") for n in WEIGHTS), F.lit(0))
    low = sum(((F.col(f"{n}_score") < CUTS[n][1]).cast("int") for n in WEIGHTS), F.lit(0))
    level = F.when(~enough | ((high >= 2) & (low >= 2)), "INCONCLUSIVE").when((F.col("overall") >= 0.65) & (high >= 4), "HIGH").when((F.col("overall") >= 0.5) & (high >= 3), "MEDIUM").when(F.col("overall") >= 0.35, "LOW").otherwise("INCONCLUSIVE")
    return scored.withColumn("overall", F.when(enough, overall).otherwise(0.0)).withColumn("level", level).drop("n_chars", "n_tokens", "n_sentences")


def tool_marks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tool, hits, score, strength) of every tool whose marks a text of 30 words or more holds.

    A tool scores by its matches, the generic style by its distinct patterns.
    """
    t = df.select(F.col(id_col), F.lower(text_col).alias("t")).filter(F.size(pieces(F.col("t"))) >= 30)
    counts = {tool: sum((F.regexp_count("t", F.lit(p)) for p in patterns), F.lit(0)) for tool, patterns in TOOLS.items()}
    counts["generic_style"] = sum((F.col("t").rlike(p).cast("int") for p in STYLE_PATTERNS), F.lit(0))
    rows = t.select(id_col, F.explode(F.array(*(F.struct(F.lit(tool).alias("tool"), c.alias("hits")) for tool, c in counts.items()))).alias("x")).select(id_col, "x.tool", "x.hits").filter("hits > 0")
    generic = F.col("tool") == "generic_style"
    score = F.least(F.lit(1.0), F.col("hits") / F.when(generic, 4).otherwise(5))
    strength = F.when(generic, F.when(F.col("hits") >= 2, "medium").otherwise("weak")).when(F.col("hits") >= 4, "strong").when(F.col("hits") >= 2, "medium").otherwise("weak")
    return rows.withColumn("score", score).withColumn("strength", strength)


def style_fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 30) -> DataFrame:
    """Eight style measures and two counts of every text; all 0 for texts under ``least_words`` words or null."""
    base = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    base = base.withColumn("_w", tokens(F.col("_t"))).withColumn("_s", style_sentences(F.col("_t"))).withColumn("_ok", F.size(pieces(F.col("_t"))) >= least_words)
    base = base.withColumn("_len", F.transform("_s", lambda s: F.size(pieces(s)).cast("bigint"))).withColumn("_n", F.size("_w")).withColumn("_k", F.size("_s"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    vowels = syllable_total(F.col("_w"))
    function = F.size(F.filter("_w", lambda w: w.isin(*FUNCTION_WORDS)))
    clauses = total(F.transform("_s", lambda s: sum((F.lower(s).rlike(rf"\b{w}\b").cast("bigint") for w in SUBORDINATORS), F.lit(0).cast("bigint"))))
    marks = F.length("_t") - F.length(F.translate("_t", STYLE_MARKS, ""))
    has_w, has_s = F.col("_ok") & (F.col("_n") > 0), F.col("_ok") & (F.col("_k") > 0)
    zero = lambda when, c: F.when(when, c).otherwise(0.0)
    return base.select(
        id_col,
        zero(has_s, _mean(F.col("_len"))).alias("sentence_length"), zero(has_s, _deviation(F.col("_len"))).alias("sentence_deviation"),
        zero(has_w, F.size(F.array_distinct("_w")) / F.col("_n")).alias("richness"), zero(F.col("_ok"), marks / F.greatest(F.length("_t"), F.lit(1))).alias("punctuation"),
        zero(has_w, function / F.col("_n")).alias("function_words"), zero(has_w, F.length(F.array_join("_w", "")) / F.col("_n")).alias("word_length"),
        zero(has_w & has_s, _unit((206.835 - 1.015 * (F.col("_n") / F.col("_k")) - 84.6 * (vowels / F.col("_n"))) / 100)).alias("readability"),
        zero(has_s, clauses / F.col("_k")).alias("complexity"), F.when(F.col("_ok"), F.col("_n")).otherwise(0).alias("word_count"), F.when(F.col("_ok"), F.col("_k")).otherwise(0).alias("sentence_count"),
    )


SCALES = {"sentence_length": 1 / 30, "sentence_deviation": 1 / 15, "richness": 1.0, "punctuation": 20.0, "function_words": 1.0, "word_length": 0.1, "readability": 1.0, "complexity": 1.0}


def style_deviation(a: str, b: str) -> Column:
    """Mean absolute difference of two fingerprints (structs in columns a and b) on a common scale."""
    return sum((F.abs(F.col(f"{a}.{n}") - F.col(f"{b}.{n}")) * s for n, s in SCALES.items()), F.lit(0.0)) / len(SCALES)


def common_phrases(df: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, phrase, times) of the k commonest three-word runs that occur twice or more; ties by first place."""
    from pyspark.sql import Window

    rows = df.select(id_col, F.posexplode(grams(tokens(F.col(text_col)), 3)).alias("n", "phrase")).groupBy(id_col, "phrase").agg(F.count("*").alias("times"), F.min("n").alias("place")).filter("times >= 2")
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("times"), "place"))).filter(F.col("r") <= k).select(id_col, "phrase", "times")
