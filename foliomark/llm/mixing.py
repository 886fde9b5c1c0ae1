"""Mixing sources to target weights by weighted fair queueing (problem 9).

Every use of a shuffled document gets a virtual finish time, the tokens of its source up to and including it
divided by the weight of the source. All uses are ordered by that time and the order is cut at the budget.
Running sums are taken in two levels (sums of buckets, then within buckets), so that no source or
time has to fit into one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import arrow_map, staged
from .tokens import DEFAULT_VOCABULARY, count

_HASHES = 2.0**64


def _running(df: DataFrame, groups: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Running sum of ``value`` within ``groups`` along (bucket, order), by buckets."""
    sums = df.groupBy(*groups, bucket).agg(F.sum(value).alias("_sum"))
    # as many rows as there are groups and buckets, one for every so many thousand rows of ``df``
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*groups, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(starts, [*groups, bucket]).withColumn(out, F.col("_start") + F.sum(value).over(inside)).drop("_start")


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0, bucket_rows: int = 50_000, id_col: str = "doc_id", path: str = DEFAULT_VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The order of uses and the shares reached.

    ``documents`` has ``id_col``, source and text, ``targets`` has source, target_share (relative weights) and
    max_repeats; it is a list of sources written by hand and is broadcast. Without a budget the largest is
    taken at which every source can keep its share within its repeats.

    Returns uses (id, source, n_tokens, use_number, virtual_finish, running_tokens) and
    shares (source, target_share, documents, source_tokens, used_tokens, actual_share, most_uses).
    Rows without a source, of a source without target, or without tokens are never used. Repeated rows count as
    documents of their own. Ties of the shuffle are broken by the id.
    """
    counted = _counted(documents, id_col, path)
    wanted = targets.groupBy("source").agg(F.max("target_share").cast("double").alias("target_share"), F.max("max_repeats").alias("max_repeats")).filter("source is not null and target_share > 0 and max_repeats > 0")
    totals = counted.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("documents"), F.max("n_tokens").alias("largest"))
    facts = [r.asDict() for r in wanted.join(F.broadcast(totals), "source", "left").collect()]  # one row per source
    weight = sum(r["target_share"] for r in facts) or 1.0
    for r in facts:
        r["share"], r["source_tokens"], r["documents"] = r["target_share"] / weight, r["source_tokens"] or 0, r["documents"] or 0
        r["largest"] = r["largest"] or 0
    if budget is None:
        budget = math.floor(min((r["source_tokens"] * r["max_repeats"] / r["share"] for r in facts), default=0))
    spark = documents.sparkSession
    schema = "source string, share double, rounds int, buckets int"
    end = _last_time(facts, budget)
    plan = []
    for r in facts:
        rounds = min(r["max_repeats"], math.ceil(end * r["share"] / r["source_tokens"])) if r["source_tokens"] else 0
        plan.append((r["source"], r["share"], rounds, max(1, math.ceil(r["documents"] / bucket_rows))))
    plans = spark.createDataFrame(plan, schema)
    uses = (
        counted.join(F.broadcast(plans), "source").filter("rounds > 0 and n_tokens > 0")
        .withColumn("use_number", F.explode(F.sequence(F.lit(1), F.col("rounds"))))
        .withColumn("_key", F.xxhash64(F.lit(seed), "use_number", id_col))
    )
    # bucket of the shuffle order: rounds follow one another, each is ordered by its hash
    uses = uses.withColumn("_bucket", (F.col("use_number") - 1) * F.col("buckets") + F.least(F.floor((F.col("_key").cast("double") / F.lit(_HASHES) + 0.5) * F.col("buckets")), F.col("buckets") - 1))
    uses = _running(uses, ["source"], "_bucket", ["_key", id_col], "n_tokens", "_done")
    # what finishes later is beyond the budget in any case, so that no bucket of times gathers it
    uses = uses.withColumn("virtual_finish", F.col("_done") / F.col("share")).filter(F.col("virtual_finish") <= F.lit(end))
    steps = max(1, sum(p[2] * p[3] for p in plan))
    uses = uses.withColumn("_one", F.lit(1)).withColumn("_time", F.floor(F.col("virtual_finish") / F.lit(max(end, 1.0)) * F.lit(steps)).cast("long"))
    uses = _running(uses, ["_one"], "_time", ["virtual_finish", "source", "_key", id_col], "n_tokens", "running_tokens")
    chosen = uses.filter(F.col("running_tokens") <= F.lit(budget)).select(id_col, "source", "n_tokens", "use_number", "virtual_finish", "running_tokens")
    chosen = staged(chosen, "mixed")
    per_source = chosen.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.max("use_number").alias("most_uses"))
    known = spark.createDataFrame([(r["source"], float(r["share"]), r["documents"], r["source_tokens"]) for r in facts], "source string, target_share double, documents bigint, source_tokens bigint")
    shares = known.join(F.broadcast(per_source), "source", "left").fillna(0, ["used_tokens", "most_uses"])
    whole = Window.partitionBy(F.lit(1))
    shares = shares.withColumn("actual_share", F.coalesce(F.col("used_tokens") / F.nullif(F.sum("used_tokens").over(whole), F.lit(0)), F.lit(0.0)))
    return chosen, shares.select("source", "target_share", "documents", "source_tokens", "used_tokens", "actual_share", "most_uses")


def _last_time(facts: list[dict], budget: int) -> float:
    """A virtual time by which the budget is used up, whatever the sizes of the documents.

    At time t source s has used min(t * share, all its tokens in all its rounds), less one document at most.
    """
    caps = sorted((r["source_tokens"] * r["max_repeats"] / r["share"], r["share"]) for r in facts)
    now, left, rate = 0.0, float(budget), sum(share for _, share in caps)
    for until, share in caps:
        if rate <= 1e-12 or left <= (until - now) * rate:
            break
        left, now, rate = left - (until - now) * rate, until, rate - share
    fair = now + left / rate if rate > 1e-12 else now
    return (fair + max((r["largest"] / r["share"] for r in facts), default=0.0)) * (1 + 1e-9) + 1


def _counted(documents: DataFrame, id_col: str, path: str) -> DataFrame:
    def run(ids, sources, texts):
        return ids, sources, [count(t, path) for t in texts]

    kind = documents.schema[id_col].dataType.simpleString()
    return staged(arrow_map(documents.select(id_col, "source", "text"), run, f"`{id_col}` {kind}, source string, n_tokens int"), "mix")


def use_counts(documents: DataFrame, uses: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, source, use_count) for every document, 0 where it is not used."""
    counts = uses.groupBy(id_col).agg(F.count("*").cast("int").alias("use_count"))
    return documents.select(id_col, "source").join(counts, id_col, "left").fillna(0, ["use_count"])
