"""One report for each document out of all findings about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Finding types and the report column each fills with its strongest confidence.
OVERLAPS = {
    "exact_copy": "exact_overlap", "semantic_similarity": "semantic_overlap", "paraphrase": "paraphrase_overlap", "cross_language": "cross_language_overlap",
    "self_plagiarism": "self_overlap", "style_deviation": "style_deviation",
}


def fuse(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per doc_id: the strongest confidence of each overlap, source_matches, citation_issues,
    reference_issues, ai_writing_signal, collusion_clusters, counts, overall_confidence and human_review.

    ``findings`` has finding_id, doc_id, finding_type, title, severity, confidence and metadata (JSON), one row per
    finding; ``evidence`` has finding_id. The signal of the last finding counts, by created_at where there is one
    and by finding_id among equals. Confidences that are null count as 0, metadata that is null as empty.
    """
    pieces = evidence.groupBy("finding_id").agg(F.count("*").alias("pieces"))
    rows = findings.join(pieces, "finding_id", "left").withColumn("_n", F.coalesce("pieces", F.lit(0))).withColumn("_c", F.coalesce("confidence", F.lit(0.0)))
    of = lambda kind: F.col("finding_type") == kind
    best = [F.coalesce(F.max(F.when(of(k), F.col("_c"))), F.lit(0.0)).alias(name) for k, name in OVERLAPS.items()]
    most = lambda kind: F.coalesce(F.max(F.when(of(kind), F.col("_n"))), F.lit(0))
    missing = of("citation_issue") & F.lower("title").contains("missing")
    level = F.get_json_object("metadata", "$.overall_level")
    made = F.col("created_at") if "created_at" in findings.columns else F.lit(0)
    report = rows.groupBy("doc_id").agg(
        *best, most("source_match").alias("source_matches"),
        (F.coalesce(F.max(F.when(missing, F.greatest("_n", F.lit(1)))), F.lit(0)) + F.count_if(of("citation_issue") & ~missing)).alias("citation_issues"),
        most("fake_citation").alias("reference_issues"),
        F.coalesce(F.max_by(level, F.when(of("ai_writing") & level.isin("HIGH", "MEDIUM", "LOW"), F.struct(made, "finding_id"))), F.lit("INCONCLUSIVE")).alias("ai_writing_signal"),
        F.coalesce(F.max(F.when(of("collusion"), F.json_array_length(F.get_json_object("metadata", "$.clusters")))), F.lit(0)).alias("collusion_clusters"),
        F.count("*").alias("findings"), F.count_if(F.col("severity").isin("high", "critical")).alias("high_findings"),
    )
    mean = (F.col("exact_overlap") + F.col("semantic_overlap") + F.col("paraphrase_overlap") + F.col("self_overlap")) / 4
    return report.withColumn("overall_confidence", F.when(mean >= 0.6, "HIGH").when(mean >= 0.3, "MEDIUM").otherwise("LOW")).withColumn("human_review", (F.col("high_findings") > 0) | (F.col("overall_confidence") == "HIGH"))


def by_type(findings: DataFrame, type_col: str = "finding_type") -> DataFrame:
    """(finding_type, severity, findings, documents, mean_confidence); the mean does not depend on the order of the rows."""
    mean = F.sum(F.col("confidence").cast("decimal(18,9)")).cast("double") / F.count("confidence")
    return findings.groupBy(F.col(type_col).alias("finding_type"), "severity").agg(F.count("*").alias("findings"), F.countDistinct("doc_id").alias("documents"), mean.alias("mean_confidence"))


# Severities from the gravest on, and those shown unless others are asked for.
SEVERITIES = ("critical", "high", "medium", "low", "info")
SHOWN = ("critical", "high", "medium")


def shown_findings(findings: DataFrame, severities: tuple[str, ...] = SHOWN) -> DataFrame:
    """Findings of the given severities with their rank within the document: gravest first, then most certain, then by finding_id. A null severity counts as info."""
    severity = F.coalesce("severity", F.lit("info"))
    grave = F.coalesce(F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), severity), F.lit(0))
    order = Window.partitionBy("doc_id").orderBy(grave, F.desc_nulls_last("confidence"), "finding_id")
    return findings.filter(severity.isin(*severities)).withColumn("rank", F.row_number().over(order))


def top_evidence(evidence: DataFrame, k: int = 3) -> DataFrame:
    """(finding_id, rank, evidence_id, similarity) of the k strongest pieces of each finding; quotes cut to 300 characters elsewhere."""
    rank = F.row_number().over(Window.partitionBy("finding_id").orderBy(F.desc("similarity"), "evidence_id"))
    return evidence.withColumn("rank", rank).filter(F.col("rank") <= k).select("finding_id", "rank", "evidence_id", "similarity")


def summary(report: DataFrame) -> DataFrame:
    """(doc_id, summary): the report as a few lines of text."""
    lines = F.format_string(
        "Document %d\nOverall: %s\nExact copy %.2f, meaning %.2f, paraphrase %.2f, own work %.2f\nFindings: %d, of high severity: %d\nHuman review: %s",
        "doc_id", "overall_confidence", "exact_overlap", "semantic_overlap", "paraphrase_overlap", "self_overlap", "findings", "high_findings", F.col("human_review").cast("string"),
    )
    return report.select("doc_id", lines.alias("summary"))


def as_json(report: DataFrame) -> DataFrame:
    """(doc_id, report) with the row as JSON."""
    return report.select("doc_id", F.to_json(F.struct("*")).alias("report"))


def shown_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence as reports show it: quotes of 300 characters at most, similarity to four decimals."""
    return evidence.withColumn("submitted_text", F.substring("submitted_text", 1, 300)).withColumn("source_text", F.substring("source_text", 1, 300)).withColumn("similarity", F.round("similarity", 4))
