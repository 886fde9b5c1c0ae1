"""Queries over the test tables, one per operator, with the SQL that checks each where SQL can express it.

Whole tables are read everywhere. Doubles are rounded to six decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import language as lang
from ..functions import text as tx
from ..operators import citations as ci
from ..operators import detectors as de
from ..operators import fusion, graph, paraphrase, store, writing
from ..operators import similarity as si
from ..operators import vector_store as vs
from . import fixtures, oracle
from .entry_support import Query
from .session import table

#: Year that the reference checks count from; no clock is read.
AS_OF_YEAR = 2024
#: The vectors of the test table are nearly orthogonal, so thresholds on them are lower than an encoder's.
VECTOR_MIN = 0.40


def finish(df: DataFrame) -> DataFrame:
    """Integers as bigint, doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(*(F.col(c).cast("bigint").alias(c) if k in ("int", "smallint") else F.round(F.col(c).cast("double"), 6).alias(c) if k in ("double", "float") else F.col(c) for c, k in kinds.items()))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def with_text(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).filter("text is not null")


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_items")


def clean_text(spark, sf):
    return with_text(spark, sf).select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


def word_counts(spark, sf):
    return with_text(spark, sf).select("doc_id", F.size(tx.pieces(F.col("text"))).alias("pieces"), F.size(tx.tokens(F.col("text"))).alias("words"))


def tokens_topk(spark, sf):
    return with_text(spark, sf).select(F.explode(tx.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)


def ngram_freq(spark, sf):
    rows = with_text(spark, sf).select("doc_id", F.explode(tx.grams(tx.tokens(F.col("text")), 3)).alias("gram"))
    return rows.groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).filter("docs >= 3")


def sentences(spark, sf):
    return with_text(spark, sf).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sentence_index", "sentence"))


def document_sentences(spark, sf):
    return with_text(spark, sf).select("doc_id", F.posexplode(tx.document_sentences(F.col("text"))).alias("sentence_index", "sentence"))


def paragraphs(spark, sf):
    return with_text(spark, sf).select("doc_id", F.posexplode(tx.paragraphs(F.col("text"))).alias("paragraph_index", "paragraph"))


def headings(spark, sf):
    return table(spark, sf, "paragraphs").filter(tx.is_heading(F.col("text"))).select("doc_id", "paragraph_index", "text").distinct()


def chunks_200_40(spark, sf):
    return with_text(spark, sf).select("doc_id", F.posexplode(tx.chunks(F.col("text"))).alias("chunk_index", "chunk"))


def document_keys(spark, sf):
    return with_text(spark, sf).select("doc_id", tx.document_key(F.col("text")).alias("key"))


def references_section(spark, sf):
    return ci.references_section(with_text(spark, sf))


def inline_citations(spark, sf):
    return ci.inline_citations(with_text(spark, sf)).groupBy("doc_id", "kind", "raw").agg(F.count("*").alias("times"))


def _cited(spark, sf):
    return ci.citation_numbers(with_text(spark, sf))


def _listed(spark, sf):
    return ci.references_section(with_text(spark, sf)).select("doc_id", ci.parsed_reference(F.col("entry"))["index"].alias("number"))


def citation_issues(spark, sf):
    return ci.citation_issues(_cited(spark, sf), _listed(spark, sf))


def citation_coverage(spark, sf):
    return ci.citation_coverage(_cited(spark, sf), _listed(spark, sf))


def uncited_claims(spark, sf):
    return ci.uncited_claims(with_text(spark, sf))


def reference_fields(spark, sf):
    p = ci.references_section(with_text(spark, sf)).select("doc_id", "entry_index", ci.parsed_reference(F.col("entry")).alias("p"))
    return p.select("doc_id", "entry_index", F.col("p.index").alias("ref_number"), "p.year", "p.doi", F.array_join("p.authors", "|").alias("authors"), "p.title", "p.journal")


def reference_scores(spark, sf):
    return ci.reference_scores(ci.references_section(with_text(spark, sf)), AS_OF_YEAR, ("doc_id", "entry_index"), "entry")


def script_detect(spark, sf):
    return docs(spark, sf).select("doc_id", lang.detect_script(F.col("text")).alias("script"))


def language_detect(spark, sf):
    found = with_text(spark, sf).select("doc_id", lang.detect_language(F.col("text")).alias("detected"))
    return found.withColumn("name", lang.language_name(F.col("detected")))


def lang_agreement(spark, sf):
    found = with_text(spark, sf).select(F.col("lang").alias("labelled"), lang.detect_language(F.col("text")).alias("detected"))
    return found.groupBy("labelled", "detected").agg(F.count("*").alias("n"))


def jaccard5_pairs(spark, sf):
    return si.jaccard_join(docs(spark, sf), 0.8)


def jaccard5_classes(spark, sf):
    classes = si.gram_classes(docs(spark, sf))
    return classes.select(F.col("id").alias("doc_id"), F.min("id").over(Window.partitionBy("key")).alias("class_id"))


def containment5_sources(spark, sf):
    return si.containment_join(docs(spark, sf), sources(spark, sf), 5, "doc_id", "source_key")


def exact_spans8(spark, sf):
    return si.token_runs(docs(spark, sf), sources(spark, sf), 8, "doc_id", "source_key")


def longest_span(spark, sf):
    runs = exact_spans8(spark, sf)
    order = Window.partitionBy("doc_id").orderBy(F.desc("length"), F.desc(F.col("start_a") + F.col("length")), F.desc(F.col("start_b") + F.col("length")), "source_key")
    return runs.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def minhash_signatures(spark, sf):
    return docs(spark, sf).filter("text is not null").select("doc_id", F.array_join(si.minhash(tx.tokens(F.col("text"))), ",").alias("signature"))


def minhash_similarity(spark, sf):
    e = table(spark, sf, "evidence").filter("source_text is not null and submitted_text is not null")
    return e.select("evidence_id", si.minhash_similarity(si.minhash(tx.tokens(F.col("submitted_text"))), si.minhash(tx.tokens(F.col("source_text")))).alias("similarity"))


def simhash(spark, sf):
    return si.simhash(docs(spark, sf))


def simhash_similarity(spark, sf):
    e = table(spark, sf, "evidence").filter("source_text is not null and submitted_text is not null")
    a = si.simhash(e, "evidence_id", "submitted_text").withColumnRenamed("simhash", "a")
    b = si.simhash(e, "evidence_id", "source_text").withColumnRenamed("simhash", "b")
    return a.join(b, "evidence_id").select("evidence_id", si.simhash_similarity(F.col("a"), F.col("b")).alias("similarity"))


def simhash_pairs(spark, sf):
    return si.simhash_pairs(si.simhash(docs(spark, sf)))


def tfidf_cosine(spark, sf):
    return si.tfidf_cosine(table(spark, sf, "evidence").filter("source_text is not null and submitted_text is not null"), "evidence_id", "submitted_text", "source_text")


def tfidf_fitted(spark, sf):
    """Quotes and their sources by a vocabulary of all documents."""
    return si.tfidf_fitted(_pairs(spark, sf), si.tfidf_vocabulary(docs(spark, sf)), "evidence_id", "submitted_text", "source_text")


def overlap_scores(spark, sf):
    return si.overlap_scores(_pairs(spark, sf), "evidence_id", "submitted_text", "source_text")


def levenshtein_ratio(spark, sf):
    return table(spark, sf, "part").select("p_partkey", si.levenshtein_ratio(F.col("p_name"), F.col("p_type")).alias("ratio"))


def jaro_winkler(spark, sf):
    return table(spark, sf, "part").select("p_partkey", si.jaro_winkler(F.col("p_name"), F.col("p_type")).alias("score"))


def sentence_match(spark, sf):
    e = table(spark, sf, "evidence")
    left = e.filter("submitted_text is not null").select(F.col("evidence_id").alias("id"), F.col("submitted_text").alias("sentence"))
    right = sources(spark, sf).select(F.col("source_key"), F.posexplode(tx.sentences(F.col("text"))).alias("n", "sentence")).select(F.format_string("%s/%06d", "source_key", "n").alias("id"), "sentence")
    return si.best_sentence_match(left, right)


def _vectors(spark, sf):
    return table(spark, sf, "embeddings")


def knn_batch(spark, sf):
    v = _vectors(spark, sf)
    return si.nearest(v.filter("vec_id % 100 = 0"), v, 10, -1.0)


def source_discovery(spark, sf):
    v = _vectors(spark, sf)
    return si.nearest(v.filter("vec_id % 100 = 0"), v, 10, VECTOR_MIN)


def semantic_best_match(spark, sf):
    v = _vectors(spark, sf)
    best = si.nearest(v.filter("vec_id % 100 = 0"), v, 1, 0.2)
    labels = v.select(F.col("vec_id").alias("id"), "label")
    return best.join(labels, "id").select("query_id", "id", "score", "label")


def batch_pairs(spark, sf):
    return si.pairs_above(_vectors(spark, sf), VECTOR_MIN)


def collusion_edges(spark, sf):
    v = _vectors(spark, sf)
    pairs = si.pairs_above(v, 0.35, label_col="label")
    label = v.select("vec_id", "label")
    joined = pairs.join(label.select(F.col("vec_id").alias("a"), F.col("label").alias("la")), "a").join(label.select(F.col("vec_id").alias("b"), F.col("label").alias("lb")), "b")
    return joined.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.count("*").alias("shared"), F.avg("score").alias("mean_score")).filter("shared >= 2")


def batch_clusters(spark, sf):
    return graph.connected_components(batch_pairs(spark, sf))


def compare_documents(spark, sf):
    """Documents (labels) divisible by 100 as the stated queries, against all others."""
    v = _vectors(spark, sf).withColumnRenamed("label", "doc_id")
    labels = v.select(F.col("doc_id").alias("b")).distinct()
    asked = labels.filter("b % 100 = 0").select(F.col("b").alias("a"))
    return vs.best_chunks(v, labels.join(F.broadcast(asked), F.col("a") != F.col("b")), VECTOR_MIN - 0.1)


def vectors_of_documents(spark, sf):
    return _vectors(spark, sf).groupBy(F.col("label").alias("doc_id")).agg(F.count("*").alias("vectors"), F.min("vec_id").alias("first_id"), F.min(F.size("embedding")).alias("width"))


def paragraph_chunks(spark, sf):
    return vs.paragraph_chunks(docs(spark, sf), table(spark, sf, "paragraphs"))


def with_fixtures(spark, sf):
    return with_text(spark, sf).select("doc_id", "text").unionByName(spark.createDataFrame(fixtures.TEXTS, "doc_id bigint, text string"))


def term_variance(spark, sf):
    return de.term_variance(with_fixtures(spark, sf))


def shown_evidence(spark, sf):
    return fusion.shown_evidence(table(spark, sf, "evidence")).select("evidence_id", "submitted_text", "source_text", "similarity")


def synonym_density(spark, sf):
    return _pairs(spark, sf).select("evidence_id", paraphrase.synonym_density(F.col("source_text"), F.col("submitted_text")).alias("density"))


def _pairs(spark, sf):
    return table(spark, sf, "evidence").filter("source_text is not null and submitted_text is not null").select("evidence_id", "source_text", "submitted_text")


def voice_change(spark, sf):
    a, b = F.col("source_text"), F.col("submitted_text")
    return _pairs(spark, sf).select("evidence_id", paraphrase.is_passive(b).alias("passive"), paraphrase.is_active(b).alias("active"), paraphrase.voice_changed(a, b).alias("changed"))


def nominalization(spark, sf):
    return _pairs(spark, sf).select("evidence_id", paraphrase.nominalization(F.col("source_text"), F.col("submitted_text")).alias("score"))


def word_order(spark, sf):
    return _pairs(spark, sf).select("evidence_id", paraphrase.word_order_change(F.col("source_text"), F.col("submitted_text")).alias("change"))


def structure_similarity(spark, sf):
    a, b = F.col("source_text"), F.col("submitted_text")
    return _pairs(spark, sf).select("evidence_id", paraphrase.structure_code(a).alias("code_a"), paraphrase.structure_code(b).alias("code_b"), paraphrase.structure_similarity(a, b).alias("similarity"))


def paraphrase_score(spark, sf):
    return _pairs(spark, sf).select("evidence_id", paraphrase.paraphrase_score(F.col("source_text"), F.col("submitted_text")).alias("score"))


def writing_signals(spark, sf):
    return writing.writing_signals(docs(spark, sf))


def tool_marks(spark, sf):
    return writing.tool_marks(with_fixtures(spark, sf))


def style_fingerprint(spark, sf):
    return writing.style_fingerprint(docs(spark, sf))


def style_deviation(spark, sf):
    d = docs(spark, sf).filter("text is not null and author_key is not null")
    names = list(writing.SCALES)
    prints = writing.style_fingerprint(d).join(d.select("doc_id", "author_key"), "doc_id")
    means = prints.groupBy("author_key").agg(F.struct(*(F.avg(n).alias(n) for n in names)).alias("b"))
    joined = prints.select("doc_id", "author_key", F.struct(*names).alias("a")).join(means, "author_key")
    return joined.select("doc_id", "author_key", writing.style_deviation("a", "b").alias("deviation"))


def common_phrases(spark, sf):
    return writing.common_phrases(with_text(spark, sf))


def repeated_blocks(spark, sf):
    return de.repeated_blocks(with_text(spark, sf))


def web_queries(spark, sf):
    return de.web_queries(with_text(spark, sf))


def evidence_domains(spark, sf):
    e = table(spark, sf, "evidence").filter("source_document like 'web:%'")
    return e.select(tx.domain(F.col("source_document")).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


def html_text(spark, sf):
    wrapped = sources(spark, sf).select("source_key", F.concat(F.lit("<html><head><style>p {x: y}</style></head><body><nav>menu</nav><h1>"), F.col("title"), F.lit("</h1>\n<p>"), F.col("text"), F.lit(" &amp; more</p><script>a < b</script><footer>end</footer></body></html>")).alias("html"))
    return wrapped.select("source_key", tx.html_text(F.col("html")).alias("text"))


def _latest_findings(spark, sf):
    return store.latest(table(spark, sf, "findings"), ["finding_id"], [F.desc("created_at"), F.desc("loaded_at"), F.desc("confidence")])


def store_upsert_latest(spark, sf):
    return _latest_findings(spark, sf).select("finding_id", "doc_id", "finding_type", "severity", "confidence")


def latest_runs(spark, sf):
    runs = store.latest(table(spark, sf, "agent_runs"), ["run_id"], [F.desc("created_at"), F.desc("loaded_at")])
    return runs.groupBy("agent", "status").agg(F.count("*").alias("runs"), F.sum("findings_count").alias("findings"), F.avg("duration_seconds").alias("mean_seconds"))


def store_stats(spark, sf):
    return store.statistics({t: table(spark, sf, t) for t in ("documents", "findings", "agent_runs")})


def store_cascade_delete(spark, sf):
    d = docs(spark, sf)
    parent, children = store.cascade_delete(d, {t: table(spark, sf, t) for t in ("findings", "agent_runs", "evidence")}, d.filter("text is null"), "doc_id")
    return store.statistics({"documents": parent, **children})


def fusion_report(spark, sf):
    return fusion.fuse(_latest_findings(spark, sf), table(spark, sf, "evidence"))


def shown_findings(spark, sf):
    return fusion.shown_findings(_latest_findings(spark, sf)).select("doc_id", "rank", "finding_id", "severity", "confidence")


def findings_by_type(spark, sf):
    return fusion.by_type(_latest_findings(spark, sf))


def top_evidence(spark, sf):
    return fusion.top_evidence(table(spark, sf, "evidence"))


def _inputs(spark, sf):
    d = with_text(spark, sf).select("doc_id", "text", "author_key", lang.detect_language(F.col("text")).alias("lang"), "doc_role")
    s = sources(spark, sf).select(F.substring("source_key", 5, 9).cast("bigint").alias("doc_id"), "text", F.lit(None).cast("string").alias("author_key"), "lang")
    part = lambda role: d.filter(F.col("doc_role") == role).drop("doc_role")
    pages = html_text(spark, sf).select(F.substring("source_key", 5, 9).cast("bigint").alias("page_id"), "text")
    more = spark.createDataFrame(fixtures.TEXTS, "doc_id bigint, text string").select("doc_id", "text", F.lit(None).cast("string").alias("author_key"), F.lit("en").alias("lang"))
    return de.Inputs(part("submitted").unionByName(more), s, part("history"), s, part("classroom"), pages, as_of_year=AS_OF_YEAR)


def _detector(name):
    def query(spark, sf):
        found = de.REGISTRY[name](_inputs(spark, sf))
        shown = F.array_join(F.transform("evidence", lambda x: x["submitted"]), " | ")
        return found.withColumn("pieces", F.size("evidence")).withColumn("evidence", shown)

    query.__name__ = f"detect_{name}"
    return query


_NAMED = (
    clean_text, word_counts, tokens_topk, ngram_freq, sentences, document_sentences, paragraphs, headings, chunks_200_40, document_keys, references_section, inline_citations, citation_issues, citation_coverage,
    uncited_claims, reference_fields, reference_scores, script_detect, language_detect, lang_agreement, jaccard5_pairs, jaccard5_classes, containment5_sources, exact_spans8, longest_span,
    minhash_signatures, minhash_similarity, simhash, simhash_similarity, simhash_pairs, tfidf_cosine, tfidf_fitted, overlap_scores, levenshtein_ratio, jaro_winkler, sentence_match, knn_batch, source_discovery, semantic_best_match,
    batch_pairs, batch_clusters, collusion_edges, compare_documents, vectors_of_documents, paragraph_chunks, term_variance, shown_evidence, synonym_density, voice_change, nominalization, word_order, structure_similarity, paraphrase_score, writing_signals, tool_marks,
    style_fingerprint, style_deviation, common_phrases, repeated_blocks, web_queries, evidence_domains, html_text, store_upsert_latest, latest_runs, store_stats, store_cascade_delete,
    fusion_report, shown_findings, findings_by_type, top_evidence,
)


def _finished(fn) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return finish(fn(spark, sf))

    query.__name__, query.__doc__ = fn.__name__, fn.__doc__
    return query


QUERIES: dict[str, Query] = {fn.__name__: _finished(fn) for fn in (*_NAMED, *(_detector(n) for n in de.REGISTRY))}
ORACLE: dict[str, str] = oracle.statements()
