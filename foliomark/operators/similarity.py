"""Set, string and vector similarity, and joins on it."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from ..functions.text import grams, tokens
from ..plans.session import ship, staged

# Modulus, width and seed of the MinHash family.
MINHASH_MODULUS, MINHASH_WIDTH, MINHASH_SEED = 2**31 - 1, 128, 42


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Share of the distinct values of ``a`` that ``b`` has; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def hashed_grams(df: DataFrame, id_col: str, text_col: str, n: int = 5) -> DataFrame:
    """(id, grams): distinct 64-bit hashes of the runs of n words of every text that has one."""
    long = df.filter(F.size(tokens(F.col(text_col))) >= n)  # a filter on the grams would make Spark compute them twice
    return long.select(F.col(id_col).alias("id"), F.array_distinct(F.transform(grams(tokens(F.col(text_col)), n), lambda g: F.xxhash64(g))).alias("grams"))


def jaccard_join(df: DataFrame, least: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(class_a, class_b, shared, jaccard) of all pairs of different gram sets at least ``least`` alike, and
    the class of every document through ``gram_classes``.

    Exact by prefix filtering: with the grams of each text ordered from rare to frequent, two texts as alike
    share one of the first size - ceil(least * size) + 1, so that frequent grams are hardly ever joined on.
    Texts with equal gram sets are one class, named by its smallest id.
    """
    classes = staged(gram_classes(df, n, id_col, text_col).groupBy("key").agg(F.min("id").alias("id"), F.first("grams").alias("grams")).select("id", "grams"), "classes")
    exploded = classes.select("id", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    frequency = exploded.groupBy("gram").agg(F.count("*").alias("df"))
    # grams of one text alone come first in the order and never match, so only their number counts
    shared = exploded.join(frequency.filter("df > 1"), "gram").groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    prefix = shared.withColumn("length", (F.size("grams") - F.ceil(F.col("size") * least) + 1).cast("int")).filter("length > 0")
    prefix = prefix.select("id", "size", F.explode(F.slice("grams", 1, F.col("length"))).alias("x")).select("id", "size", "x.gram")
    a, b = prefix.select(F.col("id").alias("class_a"), F.col("size").alias("size_a"), "gram"), prefix.select(F.col("id").alias("class_b"), F.col("size").alias("size_b"), "gram")
    candidates = a.join(b, "gram").filter((F.col("class_a") < F.col("class_b")) & (F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * least)).select("class_a", "class_b").distinct()
    full = classes.select("id", "grams")
    pairs = candidates.join(full.select(F.col("id").alias("class_a"), F.col("grams").alias("ga")), "class_a").join(full.select(F.col("id").alias("class_b"), F.col("grams").alias("gb")), "class_b")
    scored = pairs.withColumn("shared", F.size(F.array_intersect("ga", "gb"))).withColumn("jaccard", F.col("shared") / (F.size("ga") + F.size("gb") - F.col("shared")))
    return scored.filter(F.col("jaccard") >= least).select("class_a", "class_b", "shared", "jaccard")


def gram_classes(df: DataFrame, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, grams): texts with equal gram sets have equal keys."""
    return hashed_grams(df, id_col, text_col, n).withColumn("grams", F.array_sort("grams")).withColumn("key", F.struct(F.xxhash64("grams").alias("a"), F.xxhash64(F.lit(1), "grams").alias("b")))


def containment_join(left: DataFrame, right: DataFrame, n: int, left_id: str, right_id: str, left_text: str = "text", right_text: str = "text", within: str | None = None) -> DataFrame:
    """(left id, right id, shared, jaccard, containment) of all pairs that share a gram of n words.

    With ``within``, a column of both sides, only rows that agree in it are paired: the join is on both, so a frequent
    gram meets the rows of its own group only. Spark broadcasts the grams of a small side and splits skewed keys.
    """

    def side(df: DataFrame, id_col: str, text_col: str, size: str) -> DataFrame:
        rows = hashed_grams(df, id_col, text_col, n).select(F.col("id").alias(id_col), F.size("grams").alias(size), F.explode("grams").alias("gram"))
        return rows.join(df.select(id_col, F.col(within).alias("_within")), id_col) if within else rows

    a, b = side(left, left_id, left_text, "size_a"), side(right, right_id, right_text, "size_b")
    shared = a.join(b, ["gram", "_within"] if within else "gram").groupBy(left_id, right_id, "size_a", "size_b").agg(F.count("*").alias("shared"))
    return shared.select(left_id, right_id, "shared", (F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.col("size_a")).alias("containment"))


def token_runs(left: DataFrame, right: DataFrame, least: int, left_id: str, right_id: str, left_text: str = "text", right_text: str = "text", within: str | None = None) -> DataFrame:
    """(left id, right id, start_a, start_b, length): maximal runs of at least ``least`` equal words, from 0.

    With ``within``, a column of both sides, only rows that agree in it are compared.

    Grams of ``least`` words are joined; successive matches of one diagonal are one run. No table of all
    positions by all positions is made.
    """

    def placed(df: DataFrame, id_col: str, text_col: str, side: str) -> DataFrame:
        group = [F.col(within).alias("_within")] if within else []
        return df.select(F.col(id_col), *group, F.posexplode(F.transform(grams(tokens(F.col(text_col)), least), lambda g: F.xxhash64(g))).alias(f"at_{side}", "gram"))

    matches = placed(left, left_id, left_text, "a").join(placed(right, right_id, right_text, "b"), ["gram", "_within"] if within else "gram").select(left_id, right_id, "at_a", "at_b").withColumn("diagonal", F.col("at_b") - F.col("at_a"))
    keys = [left_id, right_id, "diagonal"]
    island = matches.withColumn("island", F.col("at_a") - F.row_number().over(Window.partitionBy(*keys).orderBy("at_a")))
    return island.groupBy(*keys, "island").agg(F.min("at_a").alias("start_a"), F.min("at_b").alias("start_b"), (F.count("*") + F.lit(least - 1)).alias("length")).drop("diagonal", "island")


def minhash_constants() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(MINHASH_SEED)
    return random.integers(1, MINHASH_MODULUS, MINHASH_WIDTH, dtype=np.int64), random.integers(0, MINHASH_MODULUS, MINHASH_WIDTH, dtype=np.int64)


def minhash(words: Column, n: int = 5) -> Column:
    """MinHash signature (128 numbers) of the distinct runs of n words; of texts without a run all largest."""
    ship(SparkSession.active())
    a, b = minhash_constants()

    @F.pandas_udf(ArrayType(LongType()))
    def signature(runs: pd.Series) -> pd.Series:
        out = []
        for found in runs:
            least = np.full(MINHASH_WIDTH, np.iinfo(np.int64).max)
            if found is not None and len(found):
                h = np.array([int.from_bytes(hashlib.md5(g.encode()).digest()[:8], "little") & (2**63 - 1) for g in set(found)], np.int64)
                with np.errstate(over="ignore"):
                    for i in range(0, len(h), 1024):
                        least = np.minimum(least, ((a * h[i : i + 1024, None] + b) % MINHASH_MODULUS).min(axis=0))
            out.append(least)
        return pd.Series(out)

    return signature(grams(words, n))


def minhash_similarity(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(MINHASH_WIDTH))


def simhash(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(id, simhash): 64 votes of the MD5 bits of all runs of n words; 0 without a run. Null texts count as empty."""
    ship(df.sparkSession)

    @F.pandas_udf(ArrayType(LongType()))
    def voted(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            words = text.split(" ")
            digests = [hashlib.md5(" ".join(run).encode()).digest()[:8] for run in zip(*(words[k:] for k in range(n)))] if text else []
            bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8), bitorder="little").reshape(-1, 64)
            out.append(np.append(bits.sum(axis=0, dtype=np.int64), len(bits)))
        return pd.Series(out)

    source = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = source.select(id_col, voted(F.array_join(tokens(F.col("_t")), " ")).alias("_v"))  # words hold no blank
    votes = rows.groupBy(id_col).agg(F.sum(F.col("_v")[64]).alias("_n"), *(F.sum(F.col("_v")[i]).alias(f"_v{i}") for i in range(64)))
    value = F.lit(0).cast("bigint")
    for i in range(64):
        value = value.bitwiseOR(F.when(2 * F.col(f"_v{i}") > F.col("_n"), F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return source.select(id_col).join(votes.select(id_col, value.alias("simhash")), id_col, "left").fillna(0, ["simhash"])


def simhash_similarity(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def simhash_pairs(signatures: DataFrame, most: int = 9, id_col: str = "doc_id", hash_col: str = "simhash", together: int = 3, rows_per_tile: int = 1 << 17) -> DataFrame:
    """(a, b, distance) of all pairs of different signatures at most ``most`` bits apart, between class representatives.

    Exact by the pigeonhole principle: of ``most`` + ``together`` pieces of the bits such a pair has ``together`` in
    common, so signatures meet on every choice of so many pieces (220 keys of 15 to 18 bits for nine bits and three
    pieces; more pieces together give more and longer keys). Equal signatures are one class, named by its smallest id.

    Only the signatures are sent, to each pair of tiles that theirs is part of; the keys are made and sorted within it,
    so that no table of all keys is written, joined or broadcast.
    """
    spark = signatures.sparkSession
    ship(spark)
    kind = signatures.schema[id_col].dataType.simpleString()
    classes = staged(signatures.groupBy(F.col(hash_col).cast("bigint").alias("h")).agg(F.min(id_col).alias("id")).filter("h is not null and id is not null"), "signatures")
    n = min(64, most + together)
    edges = [round(64 * i / n) for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    choices = list(itertools.combinations(range(n), max(0, min(together, n - most))))
    count, cores = classes.count(), spark.sparkContext.defaultParallelism
    tiles = max(1, math.ceil(count / rows_per_tile), min(math.ceil(math.sqrt(8 * cores)), math.ceil(count / 2048)))

    def near(one: np.ndarray, two: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for chosen in choices:
            mask = np.uint64(sum(masks[i] for i in chosen))
            before = [np.uint64(masks[i]) for i in range(chosen[-1] if chosen else 0) if i not in chosen]
            left = np.argsort(one & mask, kind="stable")
            right = left if same else np.argsort(two & mask, kind="stable")
            ha, hb = one[left], two[right]
            begin, end = np.searchsorted(hb & mask, ha & mask, "left"), np.searchsorted(hb & mask, ha & mask, "right")
            if same:
                begin = np.arange(1, len(ha) + 1)
            total = np.concatenate([[0], np.cumsum(end - begin)])
            at = 0
            while at < len(ha):  # about a million pairs at a time, and the matches of one signature at most beyond
                stop = max(at + 1, int(np.searchsorted(total, total[at] + (1 << 20), "right")) - 1)
                times = end[at:stop] - begin[at:stop]
                x = np.repeat(np.arange(at, stop), times)
                y = np.arange(total[at], total[stop]) + np.repeat(begin[at:stop] - total[at:stop], times)
                apart = ha[x] ^ hb[y]
                kept = np.flatnonzero(np.bitwise_count(apart) <= most)
                for other in before:  # a pair is taken at the first choice of pieces it has in common
                    kept = kept[apart[kept] & other != 0]
                if len(kept):
                    yield left[x[kept]], right[y[kept]], np.bitwise_count(apart[kept])
                at = stop

    def run(key: tuple[Any, ...], pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = key
        pdf = pd.concat(pdfs)
        one, two = pdf[pdf.tile == low], pdf[pdf.tile == high]
        a, b = one.id.to_numpy(), two.id.to_numpy()
        for x, y, d in near(one.h.to_numpy().view(np.uint64), two.h.to_numpy().view(np.uint64), low == high):
            i, j = a[x], b[y]
            differ = i != j
            yield pd.DataFrame({"a": np.minimum(i, j), "b": np.maximum(i, j), "distance": d.astype(np.int32)})[differ]

    placed = classes.withColumn("tile", F.pmod(F.xxhash64("h"), F.lit(tiles)).cast("int"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
    # a stated number of partitions: the few bytes would be put into one task, but its work is that of all pairs
    sent = sent.drop("other").repartition(min(tiles * (tiles + 1) // 2, 8 * cores + tiles), "low", "high")
    return sent.groupBy("low", "high").applyInPandas(run, f"a {kind}, b {kind}, distance int")


def tfidf_cosine(pairs: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """(id, tfidf_cosine) of the two texts of each row: words of two letters or more and pairs of them,
    weighted by frequency times ln(3 / (1 + df)) + 1 over just the two texts."""
    alone = math.log(1.5) + 1

    def terms(col: str, side: str) -> DataFrame:
        words = F.filter(tokens(F.col(col)), lambda w: F.length(w) >= 2)
        return pairs.select(F.col(id_col), F.explode(F.concat(words, grams(words, 2))).alias("term"), F.lit(side).alias("side"))

    counts = terms(a, "a").unionByName(terms(b, "b")).groupBy(id_col, "term").agg(F.count_if(F.col("side") == "a").alias("ta"), F.count_if(F.col("side") == "b").alias("tb"))
    weight = F.when((F.col("ta") > 0) & (F.col("tb") > 0), 1.0).otherwise(alone)
    sums = counts.groupBy(id_col).agg(F.sum(F.col("ta") * F.col("tb")).alias("dot"), F.sum((F.col("ta") * weight) ** 2).alias("na"), F.sum((F.col("tb") * weight) ** 2).alias("nb"))
    scored = sums.select(id_col, F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("dot") / F.sqrt(F.col("na") * F.col("nb"))).otherwise(0.0).alias("tfidf_cosine"))
    return pairs.select(id_col).join(scored, id_col, "left").fillna(0.0, ["tfidf_cosine"])


def tfidf_vocabulary(df: DataFrame, text_col: str = "text", most: int = 10_000) -> DataFrame:
    """(term, idf) of the ``most`` most frequent words of two letters or more and pairs of them, counted over all texts.

    idf is ln((1 + texts) / (1 + texts with the term)) + 1. Terms as frequent are taken in their order; null texts do not count.
    """
    texts = df.select(F.monotonically_increasing_id().alias("_i"), F.col(text_col).alias("_t")).filter("_t is not null")
    words = F.filter(tokens(F.col("_t")), lambda w: F.length(w) >= 2)
    counts = texts.select("_i", F.explode(F.concat(words, grams(words, 2))).alias("term")).groupBy("_i", "term").agg(F.count("*").alias("n"))
    terms = counts.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("df")).orderBy(F.desc("n"), "term").limit(most)
    total = df.filter(F.col(text_col).isNotNull()).agg(F.count("*").alias("texts"))
    return terms.join(F.broadcast(total)).select("term", (F.log((1 + F.col("texts")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_fitted(pairs: DataFrame, vocabulary: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """(id, tfidf) of the two texts of each row by a vocabulary made before; 0 where either has none of its terms.

    The vocabulary has as many rows as were asked for when it was made; Spark broadcasts it where it is small.
    """

    def terms(col: str, side: str) -> DataFrame:
        words = F.filter(tokens(F.col(col)), lambda w: F.length(w) >= 2)
        return pairs.select(F.col(id_col), F.explode(F.concat(words, grams(words, 2))).alias("term"), F.lit(side).alias("side"))

    counts = terms(a, "a").unionByName(terms(b, "b")).groupBy(id_col, "term").agg(F.count_if(F.col("side") == "a").alias("ta"), F.count_if(F.col("side") == "b").alias("tb"))
    weighed = counts.join(vocabulary, "term").select(id_col, (F.col("ta") * F.col("idf")).alias("wa"), (F.col("tb") * F.col("idf")).alias("wb"))
    sums = weighed.groupBy(id_col).agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.sum(F.col("wa") ** 2).alias("na"), F.sum(F.col("wb") ** 2).alias("nb"))
    scored = sums.select(id_col, F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("dot") / F.sqrt(F.col("na") * F.col("nb"))).otherwise(0.0).alias("tfidf"))
    return pairs.select(id_col).join(scored, id_col, "left").fillna(0.0, ["tfidf"])


def overlap_scores(pairs: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """(id, minhash, simhash, tfidf, jaccard, overall): four similarities of the two texts of each row and the largest."""
    x, y = tokens(F.col(a)), tokens(F.col(b))
    direct = pairs.select(id_col, minhash_similarity(minhash(x), minhash(y)).alias("minhash"), jaccard(F.array_distinct(grams(x, 5)), F.array_distinct(grams(y, 5))).alias("jaccard"))
    hashes = simhash(pairs, id_col, a).withColumnRenamed("simhash", "_a").join(simhash(pairs, id_col, b).withColumnRenamed("simhash", "_b"), id_col)
    joined = direct.join(hashes.select(id_col, simhash_similarity(F.col("_a"), F.col("_b")).alias("simhash")), id_col).join(tfidf_cosine(pairs, id_col, a, b).withColumnRenamed("tfidf_cosine", "tfidf"), id_col)
    return joined.select(id_col, "minhash", "simhash", "tfidf", "jaccard", F.greatest("minhash", "simhash", "tfidf", "jaccard").alias("overall"))


def pair_scores(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str, text_col: str = "text") -> DataFrame:
    """(left id, right id, minhash, simhash, tfidf, jaccard, overall) as ``overlap_scores``, for pairs of ids of two tables.

    What belongs to one text (signatures, runs, terms) is made once for each text of a pair, not for each pair.
    """
    pairs = staged(pairs.select(left_id, right_id).distinct(), "pairs")
    alone = (math.log(1.5) + 1) ** 2

    def features(df: DataFrame, key: str, side: str) -> tuple[DataFrame, DataFrame]:
        used = staged(df.select(key, F.col(text_col).alias("_text")).join(pairs.select(key).distinct(), key, "left_semi").dropDuplicates([key]), f"texts_{side}")
        words = tokens(F.col("_text"))
        whole = used.select(key, minhash(words).alias(f"_m{side}"), F.array_distinct(F.transform(grams(words, 5), lambda g: F.xxhash64(g))).alias(f"_g{side}"))
        whole = whole.join(simhash(used, key, "_text").withColumnRenamed("simhash", f"_s{side}"), key)
        long = F.filter(words, lambda w: F.length(w) >= 2)
        terms = used.select(key, F.explode(F.concat(long, grams(long, 2))).alias("_term")).groupBy(key, "_term").agg(F.count("*").alias(f"_t{side}"))
        return whole, terms

    (a, ta), (b, tb) = features(left, left_id, "a"), features(right, right_id, "b")
    norms = [t.groupBy(key).agg(F.sum(F.col(c) * F.col(c)).alias(n)) for t, key, c, n in ((ta, left_id, "_ta", "_na"), (tb, right_id, "_tb", "_nb"))]
    common = pairs.join(ta, left_id).join(tb, [right_id, "_term"]).groupBy(left_id, right_id).agg(F.sum(F.col("_ta") * F.col("_tb")).alias("_dot"), F.sum(F.col("_ta") * F.col("_ta")).alias("_ca"), F.sum(F.col("_tb") * F.col("_tb")).alias("_cb"))
    rows = pairs.join(a, left_id).join(b, right_id).join(norms[0], left_id, "left").join(norms[1], right_id, "left").join(common, [left_id, right_id], "left")
    # terms of both texts weigh 1, others more
    size = lambda n, c: F.sqrt(alone * (F.col(n) - F.col(c)) + F.col(c))
    tfidf = F.coalesce(F.col("_dot") / (size("_na", "_ca") * size("_nb", "_cb")), F.lit(0.0))
    scored = rows.select(left_id, right_id, minhash_similarity(F.col("_ma"), F.col("_mb")).alias("minhash"), simhash_similarity(F.col("_sa"), F.col("_sb")).alias("simhash"), tfidf.alias("tfidf"), jaccard(F.col("_ga"), F.col("_gb")).alias("jaccard"))
    return scored.withColumn("overall", F.greatest("minhash", "simhash", "tfidf", "jaccard"))


def group_tiles(left: DataFrame, right: DataFrame, within: str, left_id: str, right_id: str, left_rows: int, right_rows: int) -> tuple[DataFrame, DataFrame]:
    """(left id, _g, _r, _nc) and (right id, _g, _c, _nr): rows of two tables in tiles of buckets of the groups ``within``.

    Rows of one group and side are in one bucket, and a bucket's rows of either side in tiles by their ids, so that
    each two rows of a group meet in just one (_g, _r, _c), whatever part of all rows a group has.
    """
    buckets = max(4 * left.sparkSession.sparkContext.defaultParallelism, math.ceil(right.count() / right_rows))
    g = F.pmod(F.xxhash64(F.col(within).cast("string")), F.lit(buckets)).cast("int")
    a, b = (df.filter(F.col(within).isNotNull() & F.col(i).isNotNull()).select(i, g.alias("_g")) for df, i in ((left, left_id), (right, right_id)))
    size = lambda df, n, name: df.groupBy("_g").agg(F.ceil(F.count("*") / F.lit(n)).cast("int").alias(name))
    sizes = staged(size(a, left_rows, "_nr").join(size(b, right_rows, "_nc"), "_g"), "sizes")
    tile = lambda i, n: F.pmod(F.xxhash64(i), F.col(n)).cast("int")
    one = a.join(sizes, "_g").select(left_id, "_g", tile(left_id, "_nr").alias("_r"), "_nc").dropDuplicates([left_id])
    two = b.join(sizes, "_g").select(right_id, "_g", tile(right_id, "_nc").alias("_c"), "_nr").dropDuplicates([right_id])
    return one, two


def text_features(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, words, m, s) of each text: its words joined by blanks, its MinHash signature (-1 without a run) and its SimHash."""
    words = tokens(F.col(text_col))
    signed = F.transform(minhash(words), lambda x: F.when(x > MINHASH_MODULUS, -1).otherwise(x).cast("int"))
    whole = df.select(id_col, F.coalesce(F.array_join(words, " "), F.lit("")).alias("words"), F.coalesce(signed, F.array_repeat(F.lit(-1), MINHASH_WIDTH)).alias("m"))
    return whole.join(simhash(df, id_col, text_col).select(id_col, F.col("simhash").alias("s")), id_col)


def feature_scores(one: pd.DataFrame, two: pd.DataFrame, ia: np.ndarray, ib: np.ndarray) -> dict[str, np.ndarray]:
    """The scores of ``pair_scores`` for pairs of rows of two tables of ``text_features``."""
    codes: dict = {}
    alone = (math.log(1.5) + 1) ** 2

    def coded(words: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = words.split(" ") if words else []
        runs = {codes.setdefault(x, len(codes)) for x in zip(*(w[k:] for k in range(5)))}
        long = [x for x in w if len(x) >= 2]
        terms = Counter([codes.setdefault(x, len(codes)) for x in long])
        terms.update([codes.setdefault(x, len(codes)) for x in zip(long, long[1:])])
        return np.fromiter(runs, np.int64, len(runs)), np.fromiter(terms.keys(), np.int64, len(terms)), np.fromiter(terms.values(), np.float64, len(terms))

    fa, fb = [coded(x) for x in one["words"]], [coded(x) for x in two["words"]]
    ma, mb, sa, sb = np.stack(one["m"].to_numpy()), np.stack(two["m"].to_numpy()), one["s"].to_numpy(np.int64), two["s"].to_numpy(np.int64)
    n = len(ia)
    same, both, dot, ca, cb = (np.zeros(n) for _ in range(5))
    for begin in range(0, n, 8192):
        same[begin : begin + 8192] = (ma[ia[begin : begin + 8192]] == mb[ib[begin : begin + 8192]]).sum(axis=1)
    held, weight, at_a = np.zeros(len(codes), bool), np.zeros(len(codes)), -1
    for at in np.argsort(ia, kind="stable"):
        if ia[at] != at_a:
            if at_a >= 0:
                held[fa[at_a][0]], weight[fa[at_a][1]] = False, 0
            at_a = ia[at]
            held[fa[at_a][0]], weight[fa[at_a][1]] = True, fa[at_a][2]
        r, t, c = fb[ib[at]]
        both[at], w = np.count_nonzero(held[r]), weight[t]
        dot[at], ca[at], cb[at] = w @ c, w @ w, c[w > 0] @ c[w > 0]
    size_a, size_b = (np.array([len(f[0]) for f in fs], float) for fs in (fa, fb))
    norm_a, norm_b = (np.array([f[2] @ f[2] for f in fs], float) for fs in (fa, fb))
    lengths = np.sqrt(alone * (norm_a[ia] - ca) + ca) * np.sqrt(alone * (norm_b[ib] - cb) + cb)
    jac, tfidf = np.zeros(n), np.zeros(n)
    np.divide(both, size_a[ia] + size_b[ib] - both, out=jac, where=(size_a[ia] > 0) & (size_b[ib] > 0))
    np.divide(dot, lengths, out=tfidf, where=lengths > 0)
    out = {"minhash": same / MINHASH_WIDTH, "simhash": 1 - np.bitwise_count((sa[ia] ^ sb[ib]).view(np.uint64)) / 64.0, "tfidf": tfidf, "jaccard": jac}
    return out | {"overall": np.maximum.reduce(list(out.values()))}


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def jaro_winkler_value(a: str, b: str, scale: float = 0.1) -> float:
    """Jaro similarity, raised for a common beginning of up to four characters whatever its value."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[j] and b[j] == c), None)
        if j is not None:
            taken[j] = True
            left.append(c)
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    moved = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    start = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + start * scale * (1 - jaro)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler of two columns; null where either is null."""
    ship(SparkSession.active())

    @F.pandas_udf(DoubleType())
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro_winkler_value(p, q) for p, q in zip(x, y)], dtype="float64")

    return score(a, b)


def best_sentence_match(left: DataFrame, right: DataFrame, least: float = 0.6, share: float = 0.6, of_each: str | None = None) -> DataFrame:
    """For each sentence of ``left`` the best of ``right``, if it scores ``least``: (left_id, right_id, score).

    Both have id and sentence. With ``of_each``, a column of ``right``, the best of each of its values. The score is ``share`` times the Jaccard similarity of the words plus the rest times
    Jaro-Winkler of the first 200 characters, so the Jaccard part alone bounds it: only pairs that reach the bound
    (found on a prefix of rare words) are scored. Ties go to the smaller id.
    """
    bound = (least - (1 - share)) / share - 1e-9
    if bound <= 0:
        raise ValueError("least must exceed 1 - share, else every pair is a candidate")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("id").alias(f"{name}_id"), F.col("sentence").alias(f"{name}_s"), F.array_distinct(tokens(F.col("sentence"))).alias(f"{name}_w"))

    a, b = side(left, "left"), side(right, "right")
    every = a.select(F.explode("left_w").alias("word")).unionByName(b.select(F.explode("right_w").alias("word"))).groupBy("word").agg(F.count("*").alias("df"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(f"{name}_id", F.size(f"{name}_w").alias("size"), F.explode(f"{name}_w").alias("word")).join(every, "word")
        rank = F.row_number().over(Window.partitionBy(f"{name}_id").orderBy("df", "word"))
        return rows.withColumn("rank", rank).filter(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * bound) + 1).select(f"{name}_id", "word")

    candidates = prefix(a, "left").join(prefix(b, "right"), "word").select("left_id", "right_id").distinct()
    pairs = candidates.join(a, "left_id").join(b, "right_id").withColumn("j", jaccard(F.col("left_w"), F.col("right_w"))).filter(F.col("j") >= bound)
    scored = pairs.withColumn("score", share * F.col("j") + (1 - share) * jaro_winkler(F.substring("left_s", 1, 200), F.substring("right_s", 1, 200))).filter(F.col("score") >= least)
    group = ["left_id"]
    if of_each:
        scored, group = scored.join(right.select(F.col("id").alias("right_id"), F.col(of_each).alias("_each")), "right_id"), ["left_id", "_each"]
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "right_id")
    return scored.withColumn("r", F.row_number().over(order)).filter("r = 1").select("left_id", "right_id", "score")


def cosine(a: Column, b: Column) -> Column:
    """Inner product of two vectors of length one, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, least: float = -1.0, id_col: str = "vec_id", vec_col: str = "embedding", keep_self: bool = False, block_rows: int = 4096) -> DataFrame:
    """(query_id, id, score, rank): for each query the k vectors of the largest inner product, of at least ``least``.

    Exact. Queries and vectors are cut by a hash of their ids into tiles of about ``block_rows`` rows; every tile of
    queries meets every tile of vectors in a group of its own, one product of two bounded matrices, which keeps its
    own k best of each query, so that a final ranking sees few rows. Nothing passes through the driver, and either
    side may be the larger. Ties go to the smaller id. Vectors that are null or of another dimension match nothing.
    """
    ship(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    pick = lambda df: df.select(F.col(id_col).alias("i"), F.col(vec_col).alias("v")).filter("i is not null")
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    asked, there = queries.select(id_col).count(), vectors.select(id_col).count()
    rows_ = max(1, math.ceil(asked / block_rows))
    columns = max(1, math.ceil(there / block_rows), min(math.ceil(cores / rows_), math.ceil(there / 256)))

    def tiled(df: DataFrame, own: str, n: int, other: str, times: int) -> DataFrame:
        # the vectors are made before a row is sent to several tiles
        return pick(df).withColumn(own, F.pmod(F.xxhash64("i"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))

    def product(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        one, two = one[one["v"].notna()], two[two["v"].notna()]
        found = []
        for width in sorted({len(v) for v in one["v"]} & {len(v) for v in two["v"]}):
            q, v = one[[len(x) == width for x in one["v"]]], two[[len(x) == width for x in two["v"]]]
            q_ids, v_ids = q["i"].to_numpy(), v["i"].to_numpy()
            matrix = np.stack(v["v"].to_numpy()).astype(np.float64).T
            for begin in range(0, len(q), 1024):
                ids = q_ids[begin : begin + 1024]
                scores = np.stack(q["v"].to_numpy()[begin : begin + 1024]).astype(np.float64) @ matrix
                if not keep_self:
                    scores[ids[:, None] == v_ids[None, :]] = -np.inf
                # all that reach the k-th score, so that ties are settled by the ranking
                floor = np.partition(scores, len(v_ids) - k, axis=1)[:, len(v_ids) - k] if k < len(v_ids) else np.full(len(ids), -np.inf)
                x, y = np.nonzero((scores >= np.maximum(floor, least)[:, None]) & (scores > -np.inf))
                found.append(pd.DataFrame({"query_id": ids[x], "id": v_ids[y], "score": scores[x, y]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": one["i"][:0], "id": two["i"][:0], "score": np.zeros(0)})

    out = tiled(queries, "r", rows_, "c", columns).groupBy("r", "c").cogroup(tiled(vectors, "c", columns, "r", rows_).groupBy("r", "c")).applyInPandas(product, f"query_id {kind}, id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest_in_groups(queries: DataFrame, vectors: DataFrame, within: str, of_each: str, least: float, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 4096) -> DataFrame:
    """(query_id, id, score): for each query the nearest vector of each value of ``of_each`` among those of its own group ``within``.

    Exact. A group is cut into tiles of about ``block_rows`` rows of either side, and each tile of its queries meets
    each tile of its vectors in a task's group of its own, so that a group may hold any part of all rows. Ties go to
    the smaller id; rows without a group or a vector match nothing.
    """
    ship(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    sizes = [df.filter(F.col(within).isNotNull()).groupBy(F.col(within).alias("g")).agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias(n)) for df, n in ((queries, "nq"), (vectors, "nv"))]
    tiles = sizes[0].join(sizes[1], "g")

    def tiled(df: DataFrame, own: str, n: str, other: str, times: str, *more: str) -> DataFrame:
        rows = df.select(F.col(within).alias("g"), F.col(id_col).alias("i"), F.col(vec_col).alias("v"), *more).filter("i is not null").join(tiles, "g")
        return rows.withColumn(own, F.pmod(F.xxhash64("i"), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(times) - 1))).drop("nq", "nv")

    def product(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        one, two = one[one["v"].notna()], two[two["v"].notna()]
        if not len(one) or not len(two):
            return pd.DataFrame({"query_id": one["i"][:0], "id": two["i"][:0], "score": np.zeros(0)})
        two = two.sort_values(["e", "i"])
        first = np.flatnonzero(np.concatenate([[True], two["e"].to_numpy()[1:] != two["e"].to_numpy()[:-1]]))
        matrix, ids, found = np.stack(two["v"].to_numpy()).astype(np.float64).T, two["i"].to_numpy(), []
        for begin in range(0, len(one), 1024):
            scores = np.stack(one["v"].to_numpy()[begin : begin + 1024]).astype(np.float64) @ matrix
            best = np.maximum.reduceat(scores, first, axis=1)
            for q, e in zip(*np.nonzero(best >= least)):
                a, b = first[e], first[e + 1] if e + 1 < len(first) else len(ids)
                found.append((one["i"].to_numpy()[begin + q], ids[a + int(np.argmax(scores[q, a:b]))], best[q, e]))
        return pd.DataFrame(found, columns=["query_id", "id", "score"])

    out = tiled(queries, "r", "nq", "c", "nv").groupBy("g", "r", "c").cogroup(tiled(vectors.withColumn("e", F.col(of_each)), "c", "nv", "r", "nq", "e").groupBy("g", "r", "c")).applyInPandas(product, f"query_id {kind}, id {kind}, score double")
    labelled = out.join(vectors.select(F.col(id_col).alias("id"), F.col(of_each).alias("_e")), "id")
    best = F.row_number().over(Window.partitionBy("query_id", "_e").orderBy(F.desc("score"), "id"))
    return labelled.withColumn("_r", best).filter("_r = 1").select("query_id", "id", "score")


def pairs_above(vectors: DataFrame, least: float, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = None, rows_per_tile: int = 2048) -> DataFrame:
    """(a, b, score) of all pairs a < b whose inner product is at least ``least``; with a label only across labels.

    Exact: vectors are cut into tiles and each pair of tiles is one matrix product; a tile is sent to every
    pair it is part of. The work grows with the square of the rows, so this is for sets of bounded size (a class, a
    folder, a batch); ``nearest`` serves queries against a corpus.
    """
    ship(vectors.sparkSession)
    base = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), (F.col(label_col) if label_col else F.col(id_col)).cast("string").alias("label")).filter("id is not null and v is not null")
    tiles = max(1, math.ceil(base.count() / rows_per_tile))
    placed = base.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = key
        one, two = pdf[pdf.tile == low], pdf[pdf.tile == high]
        scores = np.stack(one.v.to_numpy()).astype(np.float64) @ np.stack(two.v.to_numpy()).astype(np.float64).T if len(one) and len(two) else np.zeros((0, 0))
        x, y = np.nonzero(scores >= least)
        a, b = one.id.to_numpy()[x], two.id.to_numpy()[y]
        keep = (a < b) if low == high else np.ones(len(a), bool)
        if label_col:
            keep &= one.label.to_numpy()[x] != two.label.to_numpy()[y]
        a, b, s = a[keep], b[keep], scores[x, y][keep]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": s})

    kind = vectors.schema[id_col].dataType.simpleString()
    return sent.groupBy("low", "high").applyInPandas(run, f"a {kind}, b {kind}, score double")


def clusters_above(vectors: DataFrame, least: float, k: int, id_col: str = "vec_id", vec_col: str = "embedding", rows_per_tile: int = 20_480) -> DataFrame:
    """(link, a, b, score, matches): what clusters of the pairs of ``pairs_above`` need, without a row for each pair.

    Rows with ``link`` connect what the pairs connect, and their ``matches`` add up to the number of pairs; the others
    hold, among more, the k pairs of the largest score (to twelve decimals; ties go to the smaller ids as text) of every
    cluster. Exact: all pairs are scored, each pair of tiles sums up its own. The work grows with the square of the
    rows; what is sent grows with the rows as long as a few tiles of at most ``rows_per_tile`` hold them.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    base = staged(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter("id is not null and v is not null"), "vectors")
    count, cores = base.count(), spark.sparkContext.defaultParallelism
    tiles = max(1, math.ceil(count / rows_per_tile), min(math.ceil(math.sqrt(8 * cores)), math.ceil(count / 1024)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = key
        one, two = pdf[pdf.tile == low], pdf[pdf.tile == high]
        ids, others = one.id.to_numpy(), two.id.to_numpy()
        left, right = (np.stack(x.v.to_numpy()) if len(x) else np.zeros((0, 0), np.float32) for x in (one, two))
        empty = pd.DataFrame({"link": np.zeros(0, bool), "a": pdf.id.to_numpy()[:0], "b": pdf.id.to_numpy()[:0], "score": np.zeros(0), "matches": np.zeros(0, np.int64)})
        if not len(ids) or not len(others):
            return empty
        right = right.astype(np.float64).T
        step = max(16, (1 << 22) // len(others))

        def scored(rows: np.ndarray) -> np.ndarray:
            scores = left[rows].astype(np.float64) @ right
            if low == high:  # each pair once
                scores[(np.arange(len(others)) <= rows[:, None]) | (others == ids[rows, None])] = -np.inf
            return scores

        # columns that a row joins get one label; a row keeps one of its columns
        label, column = np.arange(len(others)), np.full(len(ids), -1)
        number, top = np.zeros(len(ids), np.int64), np.full(len(ids), -np.inf)
        for begin in range(0, len(ids), step):
            scores = scored(rows := np.arange(begin, min(begin + step, len(ids))))
            near = scores >= least
            number[rows], top[rows] = near.sum(axis=1), scores.max(axis=1)
            for r in np.flatnonzero(number[rows]):
                cols = np.flatnonzero(near[r])
                column[begin + r], labels = cols[0], label[cols]
                first = labels.min()
                if (labels != first).any():
                    joined = np.zeros(len(others), bool)
                    joined[labels] = True
                    label[joined[label]] = first
        used = np.flatnonzero(column >= 0)
        if not len(used):
            return empty
        group = np.full(len(ids), -1)
        group[used] = label[column[used]]
        # links: a star of each label around its column; the number of pairs stands at one of its rows
        total = np.bincount(group[used], number[used], len(others)).astype(np.int64)
        shown = np.zeros(len(used), np.int64)
        names, where = np.unique(group[used], return_index=True)
        shown[where] = total[names]
        inner = np.flatnonzero(label != np.arange(len(others)))
        a, b = np.concatenate([ids[used], others[inner]]), np.concatenate([others[group[used]], others[label[inner]]])
        links = pd.DataFrame({"link": True, "a": a, "b": b, "score": 0.0, "matches": np.concatenate([shown, np.zeros(len(inner), np.int64)])})
        # a pair among the k best of its label lies in a row whose best is not below the k-th best of the rows
        order = used[np.lexsort((-top[used], group[used]))]
        start = np.searchsorted(group[order], names)
        size = np.append(start[1:], len(order)) - start
        floor = np.full(len(others), least)
        full = size >= k
        floor[names[full]] = np.maximum(least, top[order[start[full] + k - 1]] - 1e-11)
        chosen = np.sort(order[top[order] >= floor[group[order]]])
        text = np.concatenate([ids, others]).astype(str)
        place = np.unique(text, return_inverse=True)[1]
        place_one, place_two = place[: len(ids)], place[len(ids) :]

        def best(x: np.ndarray, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ahead = ids[x] < others[y]
            first, second = np.where(ahead, place_one[x], place_two[y]), np.where(ahead, place_two[y], place_one[x])
            at = np.lexsort((second, first, -score, group[x]))
            begun = np.searchsorted(group[x][at], group[x][at])
            at = at[np.arange(len(at)) - begun < k]
            return x[at], y[at], score[at]

        pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for begin in range(0, len(chosen), step):
            rows = chosen[begin : begin + step]
            scores = scored(rows)
            x, y = np.nonzero(scores >= floor[group[rows]][:, None])
            found = np.round(scores[x, y], 12)
            pool = best(*(np.concatenate(p) for p in zip(pool, (rows[x], y, found))))
        x, y, score = pool
        pairs = pd.DataFrame({"link": False, "a": np.minimum(ids[x], others[y]), "b": np.maximum(ids[x], others[y]), "score": score, "matches": 0})
        return pd.concat([links, pairs])

    placed = base.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
    sent = sent.drop("other").repartition(min(tiles * (tiles + 1) // 2, 8 * cores + tiles), "low", "high")
    return sent.groupBy("low", "high").applyInPandas(run, f"link boolean, a {kind}, b {kind}, score double, matches bigint")
