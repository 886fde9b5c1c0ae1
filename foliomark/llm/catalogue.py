"""Queries of the ten problems over the test tables, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import staged, table
from . import language, mixing, neardup, packing, pieces, repetition, scans, sentences, spans, textform, tokens


def _model(spark: SparkSession, sf: str) -> textform.Model:
    return textform.learn(table(spark, sf, "lang_samples"), table(spark, sf, "source_items"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return scans.repair(table(spark, sf, "documents"), _model(spark, sf))[0]


def p1_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return scans.repair(documents, _model(spark, sf))[1].unionByName(scans.unwrapped_paragraphs(documents))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    groups = staged(neardup.near_duplicates(table(spark, sf, "documents"), 0.5, _model(spark, sf), tree=True)[0], "groups")
    left = groups.select(F.col("doc_id").alias("doc_id_a"), "group_id")
    right = groups.select(F.col("doc_id").alias("doc_id_b"), "group_id")
    return left.join(right, "group_id").filter("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"), 0.5, _model(spark, sf))[0]


def p2_links(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"), 0.5, _model(spark, sf))[1]


def p2_groups_at_080(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"), 0.8, _model(spark, sf))[0]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    documents = spans.shared_with_documents(table(spark, sf, "documents"), table(spark, sf, "source_items"))
    return documents.unionByName(spans.shared_in_evidence(table(spark, sf, "evidence")))


def p3_shares(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return spans.shared_share(documents, spans.shared_with_documents(documents, table(spark, sf, "source_items")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf, "documents")).select("doc_id", "sentence_end")


def p4_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf, "documents"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    model = _model(spark, sf)
    documents = textform.found_forms(table(spark, sf, "documents"), model, "document", "doc_id", "text")
    return documents.unionByName(textform.found_forms(table(spark, sf, "evidence"), model, "evidence", "evidence_id", "submitted_text"))


def p5_consistent_documents(spark: SparkSession, sf: str) -> DataFrame:
    return textform.consistent(table(spark, sf, "documents"), _model(spark, sf), "doc_id", "text")


def p5_consistent_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return textform.consistent(table(spark, sf, "evidence"), _model(spark, sf), "evidence_id", "submitted_text")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    model = language.learn(table(spark, sf, "lang_samples"))
    return language.wrong_labels(table(spark, sf, "documents"), table(spark, sf, "paragraphs"), model, _model(spark, sf))


def p6_document_languages(spark: SparkSession, sf: str) -> DataFrame:
    model = language.learn(table(spark, sf, "lang_samples"))
    return language.document_languages(staged(language.paragraph_languages(table(spark, sf, "paragraphs"), model, _model(spark, sf)), "langs"))


def p6_paragraph_languages(spark: SparkSession, sf: str) -> DataFrame:
    model = language.learn(table(spark, sf, "lang_samples"))
    return language.paragraph_languages(table(spark, sf, "paragraphs"), model, _model(spark, sf))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    rejected, _ = repetition.repetitive(table(spark, sf, "documents"), _model(spark, sf), 0.4)
    return rejected.filter("certain").select("doc_id").distinct()


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.repetition(table(spark, sf, "documents"), _model(spark, sf))


def p7_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.repetitive(table(spark, sf, "documents"), _model(spark, sf), 0.4)[1]


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    capacity, _ = tokens.limit(spark, sf, "container_capacity")
    return packing.pack(table(spark, sf, "documents"), capacity)


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    capacity, _ = tokens.limit(spark, sf, "container_capacity")
    return packing.container_fill(packing.pack(table(spark, sf, "documents"), capacity), capacity)


def p9_use_counts(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    uses, _ = mixing.mix(documents, table(spark, sf, "mix_targets"))
    return mixing.use_counts(documents, uses)


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p9_order(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    limit, overlap = tokens.limit(spark, sf, "piece_limit")
    return pieces.split_pieces(table(spark, sf, "documents"), limit, overlap, only_oversized=True).select("doc_id").distinct()


def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    limit, overlap = tokens.limit(spark, sf, "piece_limit")
    return pieces.split_pieces(table(spark, sf, "documents"), limit, overlap)


def p10_small_pieces(spark: SparkSession, sf: str) -> DataFrame:
    limit, overlap = tokens.limit(spark, sf, "small_piece_limit")
    return pieces.split_pieces(table(spark, sf, "documents"), limit, overlap)


QUERIES = {f.__name__: f for f in (p1_found, p1_paragraphs, p2_found, p2_groups, p2_links, p2_groups_at_080, p3_found, p3_shares, p5_found, p5_consistent_documents, p5_consistent_evidence, p6_found, p6_document_languages, p6_paragraph_languages, p7_found, p7_shares, p7_cutoffs, p4_found, p4_sentences, p8_containers, p8_fill, p9_use_counts, p9_shares, p9_order, p10_found, p10_pieces, p10_small_pieces)}

def _p3_sql(span: int = 160) -> str:
    """All windows of all texts, without anchors or sketches."""

    def windows(src: str, ident: str, text: str) -> str:
        return f"SELECT {ident} AS id, i, hash(substring(t, i::INT + 1, {span})) AS w FROM (SELECT {ident}, {text} AS t, unnest(range(length({text}) - {span - 1})) AS i FROM {src} WHERE length({text}) >= {span})"

    def stretches(name: str) -> str:
        gaps = f"SELECT id, i, CASE WHEN i - lag(i) OVER (PARTITION BY id ORDER BY i) <= {span} THEN 0 ELSE 1 END AS opens FROM (SELECT DISTINCT id, i FROM {name})"
        return f"SELECT id, min(i) AS a, max(i) + {span} AS b FROM (SELECT id, i, sum(opens) OVER (PARTITION BY id ORDER BY i) AS g FROM ({gaps})) GROUP BY id, g"

    return f"""WITH d AS ({windows('documents', 'doc_id', 'text')}), s AS ({windows('source_items', 'source_key', 'text')}),
hit AS (SELECT id, i FROM d SEMI JOIN s USING (w)), own AS ({stretches('hit')}),
free AS (SELECT * FROM d WHERE id NOT IN (SELECT id FROM own) UNION ALL SELECT d.* FROM d WHERE id IN (SELECT id FROM own) AND NOT EXISTS (SELECT 1 FROM own WHERE own.id = d.id AND d.i < own.b AND own.a < d.i + {span})),
many AS (SELECT w FROM free GROUP BY w HAVING min(id) <> max(id)), shared AS (SELECT id, i FROM free SEMI JOIN many USING (w)), other AS ({stretches('shared')}),
x AS ({windows('evidence', 'evidence_id', 'submitted_text')}), y AS ({windows('evidence', 'evidence_id', 'source_text')}), common AS (SELECT x.id, x.i FROM x SEMI JOIN y ON x.id = y.id AND x.w = y.w), quoted AS ({stretches('common')})
SELECT 'source' AS record_kind, id AS record_id, a::BIGINT AS span_start, b::BIGINT AS span_end FROM own UNION ALL SELECT 'document', id, a::BIGINT, b::BIGINT FROM other UNION ALL SELECT 'evidence', id, a::BIGINT, b::BIGINT FROM quoted"""


_P3_SHARES_SQL = f"""WITH found AS ({_p3_sql()}), covered AS (SELECT record_id, sum(span_end - span_start)::BIGINT AS c FROM found WHERE record_kind <> 'evidence' GROUP BY record_id)
SELECT doc_id, length(text) AS n_chars, coalesce(c, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(c, 0)::DOUBLE / length(text) ELSE 0.0 END::DOUBLE AS shared_share FROM documents LEFT JOIN covered ON record_id = doc_id WHERE text IS NOT NULL"""


def _p7_sql() -> str:
    """Words of every text and the runs met before, without hashing, scores or cutoffs; of the one form only what changes words here."""
    unspaced = r"\x{0E00}-\x{0E7F}\x{3005}-\x{3007}\x{3041}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{20000}-\x{3134F}"
    return rf"""WITH t AS (SELECT doc_id, lower(regexp_replace(text, '[\x{{00AD}}\x{{200B}}\x{{200E}}\x{{200F}}\x{{2060}}\x{{FEFF}}]', '', 'g')) AS t FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, t, regexp_extract_all(regexp_replace(t, '([{unspaced}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}\p{{M}}]+') AS w, len(regexp_extract_all(t, '[{unspaced}]')) AS n FROM t),
w AS (SELECT doc_id, CASE WHEN 2 * n > len(w) THEN 12 ELSE 6 END AS run, CASE WHEN 2 * n > len(w) THEN regexp_extract_all(t, '[\p{{L}}\p{{N}}]') ELSE w END AS w FROM u),
g AS (SELECT doc_id, run, i, list_slice(w, i, i + run - 1) AS g FROM (SELECT *, unnest(range(1, len(w) - run + 2)) AS i FROM w)),
again AS (SELECT doc_id, run, i FROM g QUALIFY i > min(i) OVER (PARTITION BY doc_id, g)),
inside AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(run)) AS k FROM again) GROUP BY doc_id)
SELECT doc_id FROM inside JOIN w USING (doc_id) WHERE n >= 0.4 * len(w)"""


#: A document above the limit has far more than four bytes for each token allowed, all others far fewer, so that bytes tell them apart.
_P10_SQL = "SELECT doc_id FROM documents, size_limits WHERE limit_name = 'piece_limit' AND strlen(text) > 4 * max_tokens"

#: SQL can express these; the rest is tested against brute force, round trips or held-out accuracy.
ORACLE: dict[str, str] = {"p3_found": _p3_sql(), "p3_shares": _P3_SHARES_SQL, "p7_found": _p7_sql(), "p10_found": _P10_SQL}
