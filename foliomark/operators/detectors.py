"""Detectors: documents and their comparison sets in, findings out.

Every detector is a function of DataFrames and returns rows of one schema: finding_type, doc_id, source_id,
title, confidence, severity, evidence (array of submitted, source, similarity, method), metadata (JSON). ``register`` adds
one; ``run_all`` runs them apart, so that the failure of one leaves the others' findings.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, clean_text, pieces, sentences, tokens
from ..plans.session import ship, staged
from . import citations, paraphrase, writing
from .encoder import encode_sentences, hashed_vectors
from .graph import connected_components
from .similarity import best_sentence_match, clusters_above, feature_scores, gram_classes, group_tiles, jaccard_join, jaro_winkler, levenshtein_ratio, nearest, pair_scores, text_features, token_runs

FINDING = "finding_type string, doc_id bigint, source_id bigint, title string, confidence double, severity string, evidence array<struct<submitted:string,source:string,similarity:double,method:string>>, metadata string"


@dataclass
class Inputs:
    """The five sets of a run, each with doc_id, text, author_key, lang; empty ones may be None."""

    submitted: DataFrame
    sources: DataFrame | None = None
    history: DataFrame | None = None
    corpus: DataFrame | None = None
    classroom: DataFrame | None = None
    pages: DataFrame | None = None
    as_of_year: int = 2024
    options: dict = field(default_factory=dict)


REGISTRY: dict[str, Callable[[Inputs], DataFrame | None]] = {}


def register(name: str) -> Callable:
    def add(fn: Callable[[Inputs], DataFrame | None]) -> Callable:
        REGISTRY[name] = fn
        return fn

    return add


def graded(value: Column, *cuts: tuple[float, str], otherwise: str = "low") -> Column:
    """Severity by descending cuts."""
    out = F
    for least, name in cuts:
        out = out.when(value >= least, name)
    return out.otherwise(otherwise)


def best_evidence(rows: DataFrame, keys: list[str], k: int, top: int) -> DataFrame:
    """Of rows (keys, submitted, source, similarity, method): k of evidence, mean of the top similarities, count."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("similarity"), "submitted", "source")))
    item = F.struct("submitted", "source", "similarity", "method")
    kept = F.sort_array(F.collect_list(F.when(F.col("_r") <= k, F.struct("_r", item.alias("e")))))
    return ranked.groupBy(*keys).agg(F.transform(kept, lambda x: x["e"]).alias("evidence"), F.avg(F.when(F.col("_r") <= top, F.col("similarity"))).alias("strength"), F.count("*").alias("matches"))


def finding(kind: str, rows: DataFrame, title: str, confidence: Column, severity: Column, source: str | None = None, metadata: Column | None = None) -> DataFrame:
    return rows.select(
        F.lit(kind).alias("finding_type"), F.col("doc_id").cast("bigint").alias("doc_id"), (F.col(source) if source else F.lit(None)).cast("bigint").alias("source_id"),
        F.lit(title).alias("title"), confidence.cast("double").alias("confidence"), severity.alias("severity"), F.col("evidence"), (F.to_json(F.struct(metadata)) if metadata is not None else F.lit("{}")).alias("metadata"),
    )


def no_evidence() -> Column:
    return F.array().cast("array<struct<submitted:string,source:string,similarity:double,method:string>>").alias("evidence")


def sentence_rows(df: DataFrame, least_words: int) -> DataFrame:
    """(id, doc_id, sentence) with an id made of document and place: 2^24 sentences of each of 2^39 documents."""
    rows = df.select("doc_id", F.posexplode(sentences(clean_text(F.coalesce("text", F.lit(""))))).alias("n", "sentence"))
    return rows.filter(F.size(pieces(F.col("sentence"))) >= least_words).select((F.shiftleft(F.col("doc_id").cast("bigint"), 24) + F.col("n")).alias("id"), "doc_id", "sentence")


@register("exact_copy")
def exact_copy(inputs: Inputs) -> DataFrame | None:
    """Runs of eight words or more, and sentences that match nearly word for word."""
    if inputs.sources is None:
        return None
    sources = inputs.sources.select(F.col("doc_id").alias("source_id"), "text")
    runs = staged(token_runs(inputs.submitted, sources, 8, "doc_id", "source_id"), "copied")
    words = inputs.submitted.select("doc_id", tokens(F.col("text")).alias("w"))
    by_length = copied_runs(runs, words, 5)
    scores = whole_scores(runs, inputs.submitted, sources)
    a = finding(
        "exact_copy", by_length.join(scores, ["doc_id", "source_id"]), "Passages copied word for word", F.least(F.lit(0.99), 0.7 + 0.03 * F.least(F.col("matches"), F.lit(5))),
        graded(F.col("strength"), (25, "critical"), (15, "high"), (10, "medium")), "source_id", F.struct(F.col("matches").alias("spans"), "minhash", "simhash", "jaccard", "tfidf", "overall").alias("scores"),
    )
    left = sentence_rows(inputs.submitted, 6)
    right = sentence_rows(inputs.sources, 6)
    match = best_sentence_match(left.select("id", "sentence"), right.select("id", "doc_id", "sentence"), 0.75, of_each="doc_id")
    joined = match.join(left.select(F.col("id").alias("left_id"), "doc_id", F.col("sentence").alias("submitted")), "left_id").join(right.select(F.col("id").alias("right_id"), F.col("doc_id").alias("source_id"), F.col("sentence").alias("source")), "right_id")
    # a sentence of a source is taken by the first sentence of a document that it is best for
    first = F.row_number().over(Window.partitionBy("doc_id", "right_id").orderBy("left_id")) == 1
    joined = joined.withColumn("first", first).filter("first")
    both = F.col("submitted"), F.col("source")
    scored = joined.select("doc_id", "source_id", "submitted", "source", F.greatest("score", levenshtein_ratio(*both), jaro_winkler(*both)).alias("similarity"), F.lit("sentence_match").alias("method"))
    by_score = best_evidence(scored, ["doc_id", "source_id"], 5, 5)
    b = finding("exact_copy", by_score, "Sentences nearly equal to a source", F.least(F.lit(0.95), F.col("strength")), graded(F.col("strength"), (0.9, "high"), (0.75, "medium")), "source_id")
    return a.unionByName(b)


def copied_runs(runs: DataFrame, words: DataFrame, k: int, method: str = "token_run") -> DataFrame:
    """(doc_id, source_id, evidence, strength, matches) of runs of equal words: the k longest as evidence, the length of the longest, how many."""
    cut = runs.join(words, "doc_id").select("doc_id", "source_id", F.array_join(F.slice("w", F.col("start_a") + 1, F.col("length")), " ").alias("submitted"), F.col("length").cast("double").alias("similarity"), F.lit(method).alias("method"))
    found = best_evidence(cut.withColumn("source", F.col("submitted")), ["doc_id", "source_id"], k, 1)
    return found.withColumn("evidence", F.transform("evidence", lambda x: x.withField("similarity", F.lit(1.0))))


def whole_scores(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, source_id, minhash, simhash, jaccard, tfidf, overall) of whole texts, to four decimals."""
    names = ("minhash", "simhash", "jaccard", "tfidf", "overall")
    return pair_scores(pairs, left, right, "doc_id", "source_id").select("doc_id", "source_id", *(F.round(n, 4).alias(n) for n in names))


def semantic_matches(left: DataFrame, right: DataFrame, least: float, words: int) -> DataFrame:
    """For each sentence of the left the right one of the nearest vector, if near enough."""
    a, b = encode_sentences(sentence_rows(left, words)), encode_sentences(sentence_rows(right, words))
    found = nearest(a.select(F.col("id").alias("vec_id"), "embedding"), b.select(F.col("id").alias("vec_id"), "embedding"), 1, least, keep_self=True)
    return (
        found.join(a.select(F.col("id").alias("query_id"), "doc_id", F.col("sentence").alias("submitted")), "query_id")
        .join(b.select("id", F.col("doc_id").alias("source_id"), F.col("sentence").alias("source")), "id")
        .select("doc_id", "source_id", "submitted", "source", F.col("score").alias("similarity"), F.lit("vector").alias("method"))
    )


@register("semantic")
def semantic(inputs: Inputs) -> DataFrame | None:
    if inputs.sources is None:
        return None
    rows = best_evidence(semantic_matches(inputs.submitted, inputs.sources, inputs.options.get("semantic_min", 0.60), 6), ["doc_id", "source_id"], 8, 5)
    return finding("semantic_similarity", rows, "Sentences of the same meaning as a source", F.col("strength"), graded(F.col("strength"), (0.9, "critical"), (0.8, "high"), (0.7, "medium")), "source_id")


@register("paraphrase")
def paraphrased(inputs: Inputs) -> DataFrame | None:
    """Near sentences that also show a technique of rewording."""
    if inputs.sources is None:
        return None
    m = semantic_matches(inputs.submitted, inputs.sources, inputs.options.get("paraphrase_min", 0.65), 8)
    a, b = F.col("source"), F.col("submitted")
    signs = m.withColumn("syn", F.round(paraphrase.synonym_density(a, b), 4)).withColumn("voice", paraphrase.voice_changed(a, b)).withColumn("nom", F.round(paraphrase.nominalization(a, b), 4)).withColumn("order", F.round(paraphrase.word_order_change(a, b), 4)).withColumn("all", F.round(paraphrase.paraphrase_score(a, b), 4))
    kept = signs.filter((F.col("syn") >= 0.3) | F.col("voice") | (F.col("nom") >= 0.3) | (F.col("order") >= 0.3))
    scored = kept.select("doc_id", "source_id", "submitted", "source", (0.6 * F.col("similarity") + 0.4 * F.col("all")).alias("similarity"), F.lit("paraphrase").alias("method"))
    rows = best_evidence(scored, ["doc_id", "source_id"], 8, 8)
    return finding("paraphrase", rows, "Sentences reworded from a source", F.col("strength"), graded(F.col("strength"), (0.85, "critical"), (0.75, "high"), (0.65, "medium")), "source_id")


@register("cross_language")
def cross_language(inputs: Inputs) -> DataFrame | None:
    """Near sentences of documents whose languages differ."""
    if inputs.sources is None or "lang" not in inputs.sources.columns:
        return None
    langs = inputs.submitted.select("doc_id", F.col("lang").alias("la")), inputs.sources.select(F.col("doc_id").alias("source_id"), F.col("lang").alias("lb"))
    m = semantic_matches(inputs.submitted, inputs.sources, inputs.options.get("cross_language_min", 0.65), 5).join(langs[0], "doc_id").join(langs[1], "source_id").filter("la <> lb")
    rows = best_evidence(m.select("doc_id", "source_id", "submitted", "source", "similarity", "method"), ["doc_id", "source_id"], 8, 8)
    return finding("cross_language", rows, "Sentences translated from a source", F.col("strength"), graded(F.col("strength"), (0.85, "critical"), (0.78, "high"), (0.7, "medium")), "source_id")


@register("self_plagiarism")
def self_plagiarism(inputs: Inputs) -> DataFrame | None:
    """Overlap with earlier work of the same author: runs of ten equal words or more, and sentences near in meaning.

    Evidence are the three longest runs and the first five sentences; the mean of the five strongest pieces is the
    confidence. Whole-text scores of each pair are in the metadata. Only documents of one author are ever paired.
    """
    if inputs.history is None:
        return None
    least = inputs.options.get("self_plagiarism_min", 0.5)
    past = inputs.history.select(F.col("doc_id").alias("source_id"), "text", "author_key")
    known = inputs.submitted.join(past.select("author_key").distinct(), "author_key", "left_semi")
    runs = token_runs(known, past, 10, "doc_id", "source_id", within="author_key").filter("doc_id <> source_id")
    spans = copied_runs(runs, known.select("doc_id", tokens(F.col("text")).alias("w")), 3, "exact_self_copy").select("doc_id", "source_id", F.col("evidence").alias("spans"))
    both = earlier_work(known, past, spans, least).withColumn("evidence", F.concat(F.coalesce("spans", no_evidence()), F.coalesce("alike", no_evidence())))
    strongest = F.slice(F.reverse(F.array_sort(F.transform("evidence", lambda x: x["similarity"]))), 1, 5)
    rows = both.withColumn("strength", F.aggregate(strongest, F.lit(0.0), lambda s, x: s + x) / F.size(strongest)).withColumns({n: F.round(n, 4) for n in ("minhash", "simhash", "jaccard", "tfidf", "overall")})
    return finding("self_plagiarism", rows, "Text of the author's earlier work", F.col("strength"), graded(F.col("strength"), (0.85, "high"), (0.72, "medium")), "source_id", F.struct("minhash", "simhash", "jaccard", "tfidf", "overall").alias("scores"))


def earlier_work(submitted: DataFrame, past: DataFrame, spans: DataFrame, least: float, k: int = 5, encoder: Callable[[list[str]], np.ndarray] = hashed_vectors) -> DataFrame:
    """(doc_id, source_id, spans, alike, scores of ``pair_scores``) of each two documents of one author that have ``spans`` or like sentences.

    Alike are the first k sentences that have one near in meaning in the earlier work, each with the nearest; ties go
    to the earlier sentence. Texts are sent to tiles of their author, and what belongs to a pair is made there: vectors
    take ten times the room of their sentences, and an author's pairs grow with the square of the documents.
    """
    ship(submitted.sparkSession)
    one, two = (staged(x, "tiles") for x in group_tiles(submitted, past, "author_key", "doc_id", "source_id", 256, 128))
    key, nothing = F.xxhash64("_g", "_r", "_c").alias("_key"), no_evidence()
    item = "array<struct<id:bigint,sentence:string>>"

    def side(df: DataFrame, i: str, placed: DataFrame, other: str, times: str, number: int) -> DataFrame:
        used = df.select(F.col(i).alias("doc_id"), "text", "author_key").dropDuplicates(["doc_id"])
        said = sentence_rows(used, 8).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("id", "sentence"))).alias("said"))
        rows = text_features(used, "doc_id").join(used.select("doc_id", "author_key"), "doc_id").join(said, "doc_id", "left").join(placed.withColumnRenamed(i, "doc_id"), "doc_id")
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(times) - 1)))
        return rows.select(key, F.lit(number).alias("side"), "author_key", F.col("doc_id").cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("e"), F.transform(F.coalesce("said", F.array().cast(item)), lambda x: x["sentence"]).alias("said"), "words", "m", "s", nothing.alias("spans"))

    found = spans.join(one, "doc_id").join(two.select("source_id", "_c"), "source_id")
    found = found.select(key, F.lit(2).alias("side"), F.lit("").alias("author_key"), F.col("doc_id").cast("bigint").alias("d"), F.col("source_id").cast("bigint").alias("e"), F.array().cast("array<string>").alias("said"), F.lit("").alias("words"), F.array().cast("array<int>").alias("m"), F.lit(0).cast("bigint").alias("s"), "spans")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, copied = (pdf[pdf["side"] == i] for i in range(3))
        a, b = a.sort_values("d").reset_index(drop=True), b.sort_values("d").reset_index(drop=True)
        pairs: dict = {}
        at_b = b.groupby("author_key").indices
        for author, x in a.groupby("author_key").indices.items():
            x, y = ([(i, t) for i in rows for t in df["said"][i]] for rows, df in ((x, a), (at_b.get(author, ()), b)))
            if not x or not y:
                continue
            docs, sources = np.array([i for i, _ in x]), np.array([i for i, _ in y])
            matrix, vectors = encoder([t for _, t in y]).astype(np.float64).T, encoder([t for _, t in x])
            first = np.flatnonzero(np.append(True, sources[1:] != sources[:-1]))
            last = np.append(first[1:], len(sources))
            for begin in range(0, len(x), 1024):
                scores = vectors[begin : begin + 1024].astype(np.float64) @ matrix
                best = np.maximum.reduceat(scores, first, axis=1)
                for q, e in zip(*np.nonzero(best >= least)):
                    row = pairs.setdefault((docs[begin + q], sources[first[e]]), [])
                    if len(row) < k:
                        at = first[e] + int(np.argmax(scores[q, first[e] : last[e]]))
                        row.append({"submitted": x[begin + q][1], "source": y[at][1], "similarity": float(best[q, e]), "method": "self_plagiarism"})
        da, db = a["d"].to_numpy(), b["d"].to_numpy()
        place_a, place_b = {d: i for i, d in enumerate(da)}, {d: i for i, d in enumerate(db)}
        had = {(place_a[d], place_b[e]): list(x) for d, e, x in zip(copied["d"], copied["e"], copied["spans"])}
        chosen = [p for p in {**pairs, **had} if da[p[0]] != db[p[1]]]
        if not chosen:
            return pd.DataFrame({n: np.zeros(0, object) for n in ("doc_id", "source_id", "spans", "alike", "minhash", "simhash", "tfidf", "jaccard", "overall")})
        ia, ib = np.array(chosen).T
        return pd.DataFrame({"doc_id": da[ia], "source_id": db[ib], "spans": pd.Series([had.get(p) for p in chosen], dtype=object), "alike": pd.Series([pairs.get(p) for p in chosen], dtype=object), **feature_scores(a, b, ia, ib)})

    rows = side(submitted, "doc_id", one, "_c", "_nc", 0).unionByName(side(past, "source_id", two, "_r", "_nr", 1)).unionByName(found)
    evidence = "array<struct<submitted:string,source:string,similarity:double,method:string>>"
    cores = submitted.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(8 * cores, "_key").groupBy("_key").applyInPandas(product, f"doc_id bigint, source_id bigint, spans {evidence}, alike {evidence}, minhash double, simhash double, tfidf double, jaccard double, overall double")


@register("citation_integrity")
def citation_integrity(inputs: Inputs) -> DataFrame | None:
    cited = citations.citation_numbers(inputs.submitted)
    listed = citations.references_section(inputs.submitted).select("doc_id", citations.parsed_reference(F.col("entry"))["index"].alias("number"))
    issues = citations.citation_issues(cited, listed).groupBy("doc_id", "issue").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("number")), 1, 8).alias("numbers"))
    rows = issues.withColumn("evidence", F.transform("numbers", lambda x: F.struct(F.concat(F.lit("["), x.cast("string"), F.lit("]")).alias("submitted"), F.lit(None).cast("string").alias("source"), F.lit(1.0).alias("similarity"), F.lit("citation").alias("method"))))
    level = F.when(F.col("issue") == "missing_reference", 0.95).when(F.col("issue") == "unused_reference", 0.9).otherwise(0.55)
    severity = F.when(F.col("issue") == "missing_reference", "high").when(F.col("issue") == "unused_reference", "low").otherwise("info")
    a = finding("citation_issue", rows, "", level, severity).withColumn("title", F.when(F.col("severity") == "high", "Citations with missing references").when(F.col("severity") == "low", "References never cited").otherwise("References cited very often"))
    claims = citations.uncited_claims(inputs.submitted).groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list("sentence")), 1, 5).alias("s"))
    b = finding("citation_issue", claims.withColumn("evidence", F.transform("s", lambda x: F.struct(x.alias("submitted"), F.lit(None).cast("string").alias("source"), F.lit(1.0).alias("similarity"), F.lit("claim").alias("method")))), "Claims without a citation", F.lit(0.65), F.lit("medium"))
    return a.unionByName(b)


@register("fake_reference")
def fake_reference(inputs: Inputs) -> DataFrame | None:
    entries = citations.references_section(inputs.submitted)
    scored = citations.reference_scores(entries, inputs.as_of_year, ("doc_id", "entry_index"), "entry").filter("risk <> 'low'").join(entries, ["doc_id", "entry_index"])
    rows = best_evidence(scored.select("doc_id", F.substring("entry", 1, 300).alias("submitted"), F.lit(None).cast("string").alias("source"), F.col("probability").alias("similarity"), F.lit("reference").alias("method")), ["doc_id"], 8, 1_000_000)
    return finding("fake_citation", rows, "References that may be made up", F.least(F.lit(0.9), F.col("strength") + 0.2), graded(F.col("strength"), (0.6, "high"), (0.4, "medium")))


@register("ai_writing")
def ai_writing(inputs: Inputs) -> DataFrame | None:
    rows = writing.writing_signals(inputs.submitted).filter("words >= 50").withColumn("evidence", no_evidence())
    return finding("ai_writing", rows, "Signals of generated writing", F.when(F.col("level") == "HIGH", 0.75).when(F.col("level") == "MEDIUM", 0.55).otherwise(0.5), F.when(F.col("level") == "HIGH", "high").when(F.col("level") == "MEDIUM", "medium").otherwise("info"), metadata=F.col("level").alias("overall_level"))


@register("ai_tool")
def ai_tool(inputs: Inputs) -> DataFrame | None:
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("least"), "tool", "score")))
    top = writing.tool_marks(inputs.submitted).groupBy("doc_id").agg(order[0].alias("t")).filter("t.score >= 0.3")
    rows = top.withColumn("evidence", F.array(F.struct(F.col("t.tool").alias("submitted"), F.lit(None).cast("string").alias("source"), F.col("t.score").alias("similarity"), F.lit("marks").alias("method"))))
    return finding("ai_writing", rows, "Marks of a writing tool", F.col("t.score"), graded(F.col("t.score"), (0.7, "high"), (0.4, "medium")))


@register("style_deviation")
def style_deviation(inputs: Inputs) -> DataFrame | None:
    """Style against the mean style of the author's history."""
    if inputs.history is None:
        return None
    long = lambda df: df.filter(F.size(pieces(F.col("text"))) >= 100)
    names = list(writing.SCALES)
    own = writing.style_fingerprint(long(inputs.submitted)).select("doc_id", F.struct(*names).alias("a")).join(inputs.submitted.select("doc_id", "author_key"), "doc_id")
    past = writing.style_fingerprint(long(inputs.history)).join(inputs.history.select("doc_id", "author_key"), "doc_id").groupBy("author_key").agg(F.struct(*(F.avg(n).alias(n) for n in names)).alias("b"))
    rows = own.join(past, "author_key").withColumn("d", writing.style_deviation("a", "b")).filter("d >= 0.15").withColumn("evidence", no_evidence())
    return finding("style_deviation", rows, "Style unlike the author's earlier work", F.least(F.lit(0.8), 2 * F.col("d")), graded(F.col("d"), (0.3, "high"), otherwise="medium"))


@register("batch")
def batch(inputs: Inputs) -> DataFrame | None:
    """Documents of a class that are near one another as a whole, grouped into clusters."""
    if inputs.classroom is None:
        return None
    vectors = encode_sentences(inputs.classroom.select(F.col("doc_id").alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("sentence")))
    # most documents of one language may be near one another, so that no table of all pairs is made
    found = staged(clusters_above(vectors.select(F.col("id").alias("vec_id"), "embedding"), inputs.options.get("batch_min", 0.72), EVIDENCE_OF_CLUSTER), "near")
    edges = found.filter("not link").select("a", "b", F.col("score").alias("similarity"))
    return _clusters(edges, "Documents of the class resemble one another", 0.02, 0.5, 0.9, found.filter("link"))


@register("collusion")
def collusion(inputs: Inputs) -> DataFrame | None:
    """Pairs of class documents that share two or more near-equal sentences, grouped into clusters."""
    if inputs.classroom is None:
        return None
    edges = shared_sentences(inputs.classroom, inputs.options.get("collusion_min", 0.8))
    return _clusters(edges.select("a", "b", "similarity"), "Class documents share sentences", 0.05, 0.6, 0.92)


def shared_sentences(documents: DataFrame, least: float = 0.8, times: int = 2, words: int = 8) -> DataFrame:
    """(a, b, shared, similarity) of documents with at least ``times`` (2 or more) pairs of like sentences, equal ones included.

    Sentences with the same runs of three words are one class. A document whose classes are all those of another is
    a copy: it is compared with the first such document only. Of the others those are compared that share a class
    other than the most frequent one of either, as two shared sentences demand, or whose classes are near each
    other; so a sentence that everyone has, a header say, makes no pairs.
    """
    s = sentence_rows(documents, words).select("doc_id", F.col("id").alias("sid"), "sentence")
    grams = staged(gram_classes(s, 3, "sid", "sentence").select(F.col("id").alias("sid"), "key"), "sentences")
    names = grams.groupBy("key").agg(F.min("sid").alias("cls"))
    held = s.select("sid", "doc_id").join(grams, "sid").join(names, "key").groupBy("doc_id", "cls").agg(F.count("*").alias("n"))
    signed = held.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("cls", "n"))).alias("items"))
    signed = staged(signed.select("doc_id", "items", F.min("doc_id").over(Window.partitionBy(F.xxhash64("items"), "items")).alias("rep")), "holders")
    square = F.aggregate("items", F.lit(0).cast("bigint"), lambda t, x: t + x["n"] * x["n"])
    copies = signed.filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), square.alias("shared"), F.lit(1.0).alias("similarity"))
    rows = signed.filter("doc_id = rep").select("doc_id", F.explode("items").alias("x")).select("doc_id", "x.cls", "x.n")
    frequency = rows.groupBy("cls").agg(F.count("*").alias("df"))
    last = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("df"), F.desc("cls")))
    rows = staged(rows.join(frequency, "cls").withColumn("last", last == 1), "classes")
    side = lambda df, i: df.select(F.col("doc_id").alias(f"d{i}"), F.col("cls").alias(f"c{i}"), F.col("n").alias(f"n{i}"))
    many = rows.filter("df > 1")
    alike = staged(jaccard_join(s.select(F.col("sid").alias("doc_id"), F.col("sentence").alias("text")), least, 3).select(F.col("class_a").alias("ca"), F.col("class_b").alias("cb"), F.col("jaccard").alias("sim")), "alike")
    near = alike.unionByName(alike.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"), "sim"))
    ordered = F.col("d1") != F.col("d2")
    pair = [F.least("d1", "d2").alias("a"), F.greatest("d1", "d2").alias("b")]
    prefix = many.filter("not last")
    found = side(prefix, 1).join(side(prefix, 2), F.col("c1") == F.col("c2")).filter(ordered).select(*pair)
    several = side(many.filter("n > 1"), 1).join(side(many, 2), F.col("c1") == F.col("c2")).filter(ordered).select(*pair)
    through = side(rows, 1).join(near, F.col("c1") == F.col("ca")).join(side(rows, 2), F.col("cb") == F.col("c2")).filter(ordered).select(*pair)
    candidates = staged(found.unionByName(several).unionByName(through).distinct(), "candidates")
    one = candidates.join(side(rows, 1), F.col("a") == F.col("d1"))
    equal = one.join(side(rows, 2), (F.col("b") == F.col("d2")) & (F.col("c1") == F.col("c2"))).select("a", "b", (F.col("n1") * F.col("n2")).alias("n"), F.lit(1.0).alias("sim"))
    other = one.join(near, F.col("c1") == F.col("ca")).join(side(rows, 2), (F.col("b") == F.col("d2")) & (F.col("cb") == F.col("c2"))).select("a", "b", (F.col("n1") * F.col("n2")).alias("n"), "sim")
    counted = equal.unionByName(other).groupBy("a", "b").agg(F.sum("n").alias("shared"), F.round(F.sum(F.col("n") * F.col("sim")) / F.sum("n"), 9).alias("similarity"))
    return counted.unionByName(copies).filter(F.col("shared") >= times)


#: Pairs that the finding of a cluster shows.
EVIDENCE_OF_CLUSTER = 10


def _clusters(edges: DataFrame, title: str, step: float, base: float, most: float, links: DataFrame | None = None) -> DataFrame:
    """One finding for each cluster, under its smallest document, with its members.

    Where ``edges`` are only the best pairs, ``links`` (a, b, matches) connect the members and have the number of pairs.
    """
    nodes = connected_components(edges if links is None else links)
    members = nodes.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"))
    inside = lambda df: df.join(nodes.select(F.col("node").alias("a"), "component"), "a")
    rows = best_evidence(inside(edges).select(F.col("component").alias("doc_id"), F.col("a").cast("string").alias("submitted"), F.col("b").cast("string").alias("source"), "similarity", F.lit("cluster").alias("method")), ["doc_id"], EVIDENCE_OF_CLUSTER, 1)
    if links is not None:
        rows = rows.drop("matches").join(inside(links).groupBy(F.col("component").alias("doc_id")).agg(F.sum("matches").alias("matches")), "doc_id")
    rows = rows.join(members.withColumnRenamed("component", "doc_id"), "doc_id")
    return finding("collusion", rows, title, F.least(F.lit(most), base + step * F.col("matches")), graded(F.col("strength"), (0.85, "high"), otherwise="medium"), metadata=F.array("members").alias("clusters"))


@register("source_discovery")
def source_discovery(inputs: Inputs) -> DataFrame | None:
    """The ten nearest documents of the corpus by whole-document vectors."""
    if inputs.corpus is None:
        return None
    whole = lambda df: encode_sentences(df.select(F.col("doc_id").alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("sentence"))).select(F.col("id").alias("vec_id"), "embedding")
    found = nearest(whole(inputs.submitted), whole(inputs.corpus), 10, inputs.options.get("discovery_min", 0.60))
    rows = best_evidence(found.select(F.col("query_id").alias("doc_id"), F.col("id").cast("string").alias("submitted"), F.col("id").cast("string").alias("source"), F.col("score").alias("similarity"), F.lit("vector").alias("method")), ["doc_id"], 5, 1)
    return finding("source_match", rows, "Likely sources in the corpus", F.least(F.lit(0.9), F.col("strength")), graded(F.col("strength"), (0.85, "high"), otherwise="medium"))


@register("research_integrity")
def research_integrity(inputs: Inputs) -> DataFrame | None:
    """Paragraphs over 80 characters that a document repeats, repeated headings, terms used beside their short forms,
    and citations without a reference or references without a citation."""
    blocks = repeated_blocks(inputs.submitted)
    rows = best_evidence(blocks.select("doc_id", "kind", F.substring("block", 1, 300).alias("submitted"), F.lit(None).cast("string").alias("source"), F.col("times").cast("double").alias("similarity"), F.lit("repetition").alias("method")), ["doc_id", "kind"], 5, 1)
    repeated = finding("research_integrity", rows, "Parts of the document are repeated", F.when(F.col("kind") == "paragraph", 0.95).otherwise(0.85), F.when(F.col("kind") == "paragraph", "medium").otherwise("low"))
    terms = term_variance(inputs.submitted).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("term").alias("submitted"), F.col("short").alias("source"), F.lit(1.0).alias("similarity"), F.lit("term").alias("method")))).alias("evidence"))
    mixed = finding("research_integrity", terms, "Terms and their short forms are mixed", F.lit(0.55), F.lit("low"))
    listed = citations.references_section(inputs.submitted).select("doc_id", citations.parsed_reference(F.col("entry"))["index"].alias("number"))
    issues = citations.citation_issues(citations.citation_numbers(inputs.submitted), listed).groupBy("doc_id")
    numbers = lambda kind: F.slice(F.array_sort(F.collect_list(F.when(F.col("issue") == kind, F.col("number")))), 1, 10)
    rows = issues.agg(numbers("missing_reference").alias("missing"), numbers("unused_reference").alias("unused")).filter("size(missing) + size(unused) > 0").withColumn("evidence", no_evidence())
    unmatched = finding("research_integrity", rows, "Citations and references do not match", F.lit(0.9), F.lit("medium"), metadata=F.struct("missing", "unused").alias("numbers"))
    return repeated.unionByName(mixed).unionByName(unmatched)


# Terms and their short forms.
TERMS = {"artificial intelligence": "ai", "machine learning": "ml", "deep learning": "dl", "neural network": "nn", "natural language processing": "nlp"}


def term_variance(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3) -> DataFrame:
    """(id, term, short, term_count, short_count) where a text uses a term and its short form ``least`` times or more each."""
    lower = F.lower(text_col)
    times = lambda w: ((F.length(lower) - F.length(F.replace(lower, F.lit(w), F.lit("")))) / len(w)).cast("bigint")
    pairs = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(s).alias("short"), times(t).alias("term_count"), times(s).alias("short_count")) for t, s in TERMS.items()))
    return df.filter(F.col(text_col).isNotNull()).select(id_col, F.explode(pairs).alias("x")).select(id_col, "x.*").filter((F.col("term_count") >= least) & (F.col("short_count") >= least))


def repeated_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 80) -> DataFrame:
    """(id, kind, block, times): paragraphs of more than ``least_chars`` characters and headings of 3 to 10 words that occur twice or more."""
    block = df.select(id_col, F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("b")).withColumn("b", F.regexp_replace("b", f"^{WS}+|{WS}+$", ""))
    words = F.size(pieces(F.col("b")))
    heading = words.between(3, 10) & F.col("b").rlike(r"^\p{Lu}") & ~F.col("b").endswith(".") & (F.length("b") <= least_chars)
    kind = F.when(F.length("b") > least_chars, "paragraph").when(heading, "heading")
    key = F.when(F.col("kind") == "paragraph", F.regexp_replace(F.lower("b"), f"{WS}+", " ")).otherwise(F.lower("b"))
    return block.withColumn("kind", kind).filter("kind is not null").withColumn("block", key).groupBy(id_col, "kind", "block").agg(F.count("*").alias("times")).filter("times >= 2")


@register("web_match")
def web_match(inputs: Inputs) -> DataFrame | None:
    """Sentences found on pages of a given table (page_id, text); nothing is fetched."""
    if inputs.pages is None:
        return None
    pages = inputs.pages.select(F.col("page_id").alias("doc_id"), "text")
    rows = best_evidence(semantic_matches(inputs.submitted, pages, inputs.options.get("web_min", 0.78), 8), ["doc_id", "source_id"], 8, 5)
    return finding("source_match", rows, "Sentences found on a web page", F.least(F.lit(0.95), F.col("strength")), graded(F.col("strength"), (0.88, "high"), (0.82, "medium")), "source_id")


def web_queries(df: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, query): the k longest sentences of 40 to 200 characters, one for each beginning, cut to 150."""
    flat = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{WS}+", " ")
    s = df.select(id_col, F.posexplode(F.split(flat, f"(?<=[.!?]){WS}+")).alias("n", "s")).filter(F.length("s").between(40, 200))
    s = s.withColumn("q", F.regexp_replace("s", f"^[{WS[1:-1]}\"']+|[{WS[1:-1]}\"']+$", "")).withColumn("key", F.lower(F.substring("q", 1, 80)))
    order = [F.desc(F.length("s")), "n"]
    first = s.withColumn("r", F.row_number().over(Window.partitionBy(id_col, "key").orderBy(*order))).filter("r = 1")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select(id_col, "rank", F.substring("q", 1, 150).alias("query"))


def run_all(inputs: Inputs, names: list[str] | None = None) -> tuple[DataFrame, list[dict]]:
    """(findings of all detectors, one record for each: detector, status ok, skipped or failed, error, seconds).

    Planning errors of a detector are recorded, and the others go on; nothing is computed here.
    """
    spark = inputs.submitted.sparkSession
    found, runs = spark.createDataFrame([], FINDING), []
    for name in names or list(REGISTRY):
        began = time.time()
        try:
            rows = REGISTRY[name](inputs)
            if rows is not None:
                found = found.unionByName(rows)
            runs.append({"detector": name, "status": "skipped" if rows is None else "ok", "error": "", "seconds": time.time() - began})
        except Exception as error:  # the detector's own failure is a result
            runs.append({"detector": name, "status": "failed", "error": str(error)[:500], "seconds": time.time() - began})
    return found, runs
