"""Groups of texts that differ by small edits (problem 2).

Texts are brought to one form and become sets of five-word runs. Each set gets a sketch of 256 bits (one
bit of each of 256 minima), whose Hamming distance follows the similarity. Sketches are compared tile by tile
with exclusive-or and bit counts inside blocks of texts that share a pair of minima; tile pairs whose
population counts differ beyond the radius are skipped, and so are those whose run sets differ in size beyond
the similarity. Pairs within the radius are then checked exactly on their run sets, and groups are the connected
components of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..plans.session import arrow_map, ship, staged
from .textform import Model, normalize
from .words import words

RUN = 5
BITS = 256
#: Pairs of minima that make blocks. At similarity 0.5 a pair of texts shares no block with probability 0.75 ** 32 = 1e-4, at 0.6 6e-7.
BANDS = 32
_RANDOM = np.random.default_rng(20240229)
_MULTIPLIERS = _RANDOM.integers(0, 2**31, BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADDENDS = _RANDOM.integers(0, 2**32, BITS, dtype=np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hashes of words met so far."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hash_of = _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hashed(tokens: list[str]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(_hash_of.__getitem__, tokens), np.uint64, len(tokens))


def runs(tokens: list[str], length: int = RUN) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``length`` words; empty for shorter texts."""
    h = hashed(tokens)
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, length):
        out = out * _P + h[k : k + n]
    return np.unique(_mix(out))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each of 256 hash functions, as 32-bit numbers."""
    out = np.full(BITS, np.iinfo(np.uint32).max, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 128):  # parts that stay in the cache
        part = short[i : i + 128, None] * _MULTIPLIERS
        part += _ADDENDS
        np.minimum(out, part.min(axis=0), out=out)
    return out


def sketch(mins: np.ndarray) -> np.ndarray:
    """One well mixed bit of each minimum, as 4 words of 64 bits."""
    bits = (mins * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def radius(similarity: float, deviations: float) -> int:
    """Hamming distance that a pair of this similarity exceeds with the given number of standard deviations."""
    p = (1 - similarity) / 2
    return math.ceil(BITS * p + deviations * math.sqrt(BITS * p * (1 - p)))


def _features(df: DataFrame, id_col: str, text_col: str, model: Model | None) -> DataFrame:
    def run(ids, uids, texts):
        out = ([], [], [], [], [], [])
        for key, uid, text in zip(ids, uids, texts):
            if text is None or key is None:
                continue
            form = normalize(text, model)
            tokens = words(form)
            found = runs(tokens)
            if len(found):
                mins = minima(found)
                same, bands, bits = xxhash.xxh3_128_digest(" ".join(tokens)), mins[: 2 * BANDS].tobytes(), sketch(mins).tobytes()
            else:
                same, bands, bits = xxhash.xxh3_128_digest("\0" + form), b"", b""
            for column, value in zip(out, (key, uid, same, len(found), bands, bits)):
                column.append(value)
        return out

    return arrow_map(df.select(F.col(id_col).cast("bigint"), _uid(id_col, text_col), text_col), run, "id bigint, uid bigint, same binary, n int, bands binary, bits binary")


def _uid(id_col: str, text_col: str) -> Column:
    """A key of each different pair of id and text, as an id may come again with another text."""
    return F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col))


def _blocks(classes: DataFrame) -> DataFrame:
    """One row per text and band: (block, id, n, bits)."""

    def run(ids, sizes, bands, bits):
        count = len(ids)
        if not count:
            return [], [], [], []
        mins = np.frombuffer(b"".join(bands), np.uint32).reshape(count, BANDS, 2).astype(np.uint64)
        keys = _mix((mins[:, :, 0] << np.uint64(32) | mins[:, :, 1]) + np.arange(BANDS, dtype=np.uint64) * _P).view(np.int64)
        return pa.array(keys.ravel()), np.repeat(ids, BANDS), np.repeat(sizes, BANDS), [b for b in bits for _ in range(BANDS)]

    return arrow_map(classes.filter("n > 0").select("rep", "n", "bands", "bits"), run, "block bigint, id bigint, n int, bits binary")


def near(ids: np.ndarray, sizes: np.ndarray, bits: np.ndarray, similarity: float, other: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, tile: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of a block to be checked, as (smaller ids, larger ids, distances) of each tile pair.

    Rows are ordered by the size of their run sets. Of a tile pair nothing is computed when its population counts
    differ by more than the radius, which bounds the distance from below, or when even the nearest sizes make the
    similarity impossible.
    """
    outer = radius(similarity, 4.5)
    order = np.argsort(sizes, kind="stable")
    ids, sizes, bits = ids[order], sizes[order], bits[order]
    if other is None:
        ids2, sizes2, bits2 = ids, sizes, bits
    else:
        order = np.argsort(other[1], kind="stable")
        ids2, sizes2, bits2 = (x[order] for x in other)
    ones, ones2 = (np.bitwise_count(x).sum(axis=1).astype(np.int64) for x in (bits, bits2))
    for i in range(0, len(ids), tile):
        low, high = sizes[i], sizes[min(i + tile, len(ids)) - 1]
        for j in range(i if other is None else 0, len(ids2), tile):
            low2, high2 = sizes2[j], sizes2[min(j + tile, len(ids2)) - 1]
            if high < similarity * low2 or high2 < similarity * low:
                continue
            if max(ones2[j : j + tile].min() - ones[i : i + tile].max(), ones[i : i + tile].min() - ones2[j : j + tile].max()) > outer:
                continue  # beyond the radius whatever the bits
            distance = np.zeros((len(ids[i : i + tile]), len(ids2[j : j + tile])), np.uint16)
            for w in range(bits.shape[1]):
                distance += np.bitwise_count(bits[i : i + tile, w, None] ^ bits2[None, j : j + tile, w])
            within = distance <= outer
            if other is None and i == j:
                within = np.triu(within, 1)
            x, y = np.nonzero(within)
            m, n, a, b = sizes[i + x], sizes2[j + y], ids[i + x], ids2[j + y]
            keep = (np.minimum(m, n) >= similarity * np.maximum(m, n)) & (a != b)
            if keep.any():
                a, b = a[keep], b[keep]
                yield np.minimum(a, b), np.maximum(a, b), distance[x, y][keep]


def compare(ids: np.ndarray, sizes: np.ndarray, bits: np.ndarray, similarity: float, other: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, tile: int = 256, tree: bool = False) -> list[tuple[int, int]]:
    """Pairs of a block to be checked: tiled exclusive-or and bit counts.

    With ``tree``, for groups only, pairs so near that they surely are alike are linked by a spanning tree, and
    doubtful pairs are returned unless such links join them already.
    """
    found = ((a, b, d) for part in near(ids, sizes, bits, similarity, other, tile) for a, b, d in zip(*(x.tolist() for x in part)))
    if not tree:
        return [(a, b) for a, b, _ in found]
    inner = min(radius(similarity, 0) - 1, max(0, 2 * radius(similarity, 0) - radius(similarity, 4.5)))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    out, doubtful = [], []
    for a, b, d in found:
        if d <= inner:
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
        else:
            doubtful.append((a, b))
    return out + [(a, b) for a, b in doubtful if root(a) != root(b)]


def candidates(classes: DataFrame, similarity: float, hot: int = 2048, tree: bool = False) -> DataFrame:
    """Distinct pairs (a, b) whose sketches lie within the radius; with ``tree`` only as many as groups need.

    Blocks above ``hot`` rows are cut into levels of set size and by hash into parts of about ``hot`` rows; every two
    parts of levels within the similarity are a group of their own, so no block has to fit into one task. Rows are
    sent to parts that exist only.
    """
    rows = staged(_blocks(classes), "blocks")
    counts = staged(rows.groupBy("block").agg(F.count("*").alias("c")).filter("c > 1"), "counts")
    step = math.log(1.25)
    reach = math.ceil(-math.log(similarity) / step)
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")
    together = rows.join(counts.filter(F.col("c") <= hot), "block").select("block", "id", "n", "bits", F.lit(0).alias("side"))
    if not counts.filter(F.col("c") > hot).isEmpty():
        large = rows.join(counts.filter(F.col("c") > hot).select("block"), "block").withColumn("level", part)
        levels = large.groupBy("block", "level").agg(F.ceil(F.count("*") / F.lit(hot)).cast("int").alias("parts"))
        large = large.join(levels, ["block", "level"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        # a part meets the parts of its level and of the levels within reach, each pair once: the lower is side 0, the higher side 1
        near_levels = levels.select("block", F.col("level").alias("other"), F.col("parts").alias("other_parts"))
        meets = large.join(near_levels, "block").filter(F.abs(F.col("level") - F.col("other")) <= reach).withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
        first = (F.col("level") < F.col("other")) | ((F.col("level") == F.col("other")) & (F.col("part") <= F.col("other_part")))
        own, that = F.struct("level", "part"), F.struct(F.col("other").alias("level"), F.col("other_part").alias("part"))
        meets = meets.select(F.xxhash64("block", F.when(first, own).otherwise(that), F.when(first, that).otherwise(own)).alias("block"), "id", "n", "bits", F.when(own == that, 0).when(first, 1).otherwise(2).alias("side"))
        together = together.unionByName(meets)
    ship(classes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(block: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(block).combine_chunks()
            keys, ids, sizes, side = (t.column(c).to_numpy() for c in ("block", "id", "n", "side"))
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(ids), -1)
            edges = np.flatnonzero(np.diff(keys)) + 1
            parts: list[tuple[np.ndarray, np.ndarray]] = []
            waiting = 0

            def sent() -> pa.RecordBatch:
                found = np.unique(np.stack([np.concatenate(x) for x in zip(*parts)], axis=1), axis=0)
                return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
                if b - a < 2:
                    continue
                one, two, other = np.arange(a, b), np.flatnonzero(side[a:b] == 2) + a, None
                if side[a] != 0:
                    one, other = np.flatnonzero(side[a:b] < 2) + a, (ids[two], sizes[two], bits[two])
                    if not (len(one) and len(two)):
                        continue
                if tree:
                    joined = np.array(compare(ids[one], sizes[one], bits[one], similarity, other, tree=True), np.int64).reshape(-1, 2)
                    found = iter([(joined[:, 0], joined[:, 1])] if len(joined) else [])
                else:
                    found = ((x, y) for x, y, _ in near(ids[one], sizes[one], bits[one], similarity, other))
                for part in found:
                    parts.append(part)
                    waiting += len(part[0])
                    if waiting >= 200_000:
                        yield sent()
                        parts, waiting = [], 0
            if parts:
                yield sent()

        held: list[pa.RecordBatch] = []  # whole blocks and the beginning of the next
        rows_held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))
            if last or (held and held[-1].column(0)[-1].as_py() != keys[0]):
                if last:
                    held.append(batch.slice(0, last))
                    yield from pairs(held)
                    held, rows_held = [batch.slice(last)], 0
                else:
                    yield from pairs(held)
                    held, rows_held = [batch], 0
            else:
                held.append(batch)
            rows_held += batch.num_rows
        if held:
            yield from pairs(held)

    return together.repartition("block").sortWithinPartitions("block", "side").mapInArrow(run, "a bigint, b bigint").distinct()


def verified(df: DataFrame, id_col: str, text_col: str, pairs: DataFrame, similarity: float, model: Model | None) -> DataFrame:
    """The pairs of row keys whose run sets reach the similarity, with it: (a, b, similarity)."""
    needed = pairs.select(F.col("a").alias("_id")).union(pairs.select(F.col("b").alias("_id"))).distinct()
    chosen = df.filter(F.col(id_col).isNotNull()).select(_uid(id_col, text_col).alias("_id"), F.col(text_col).alias("_text")).join(needed, "_id", "left_semi").filter("_text is not null").dropDuplicates(["_id"])

    def shingled(ids, texts):
        return ids, [runs(words(normalize(t, model))).tobytes() for t in texts]

    sets = staged(arrow_map(chosen, shingled, "_id bigint, runs binary"), "runs")
    joined = pairs.join(sets.select(F.col("_id").alias("a"), F.col("runs").alias("ra")), "a").join(sets.select(F.col("_id").alias("b"), F.col("runs").alias("rb")), "b")

    def check(a, b, left, right):
        out = ([], [], [])
        for x, y, p, q in zip(a, b, left, right):
            u, v = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(u, v, assume_unique=True))
            j = both / max(1, len(u) + len(v) - both)
            if j >= similarity:
                for column, value in zip(out, (x, y, j)):
                    column.append(value)
        return out

    return arrow_map(joined.select("a", "b", "ra", "rb"), check, "a bigint, b bigint, similarity double")


def near_duplicates(df: DataFrame, similarity: float = 0.8, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", hot: int = 2048, tree: bool = False) -> tuple[DataFrame, DataFrame]:
    """Groups of alike texts and the links behind them.

    Returns groups (id, class_id, group_id, n_links), one row per text, and links (a, b, similarity) between class
    representatives. A class is texts with the same words, its id the smallest id; a group is all that is
    linked, its id the smallest class; ``n_links`` is the number of other classes its class is linked to, copies
    not counted. Texts of under five words are alike only if their form is equal. Null
    texts and null ids give no rows; a repeated id keeps its rows, each in the class of its own text; an empty table
    gives empty results. All pairs
    within the sketch radius are checked; a missed link of similarity s has probability (1 - s * s) ** 32, on top of
    what the sketch radius of 4.5 standard deviations loses. With ``tree`` the groups are the same, but links hold
    spanning trees of surely alike texts only, and groups have no ``n_links``.
    """
    features = staged(_features(df, id_col, text_col, model), "features")
    classes = staged(
        features.groupBy("same").agg(F.min("id").alias("class_id"), F.min("uid").alias("rep"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("bits").alias("bits")), "classes"
    )
    pairs = staged(candidates(classes, similarity, hot, tree), "pairs")
    links = staged(verified(df, id_col, text_col, pairs, similarity, model), "links")
    names = classes.select("rep", "class_id")
    nodes = connected_components(links).join(names.withColumnRenamed("rep", "node"), "node")
    heads = nodes.groupBy("component").agg(F.min("class_id").alias("head"))
    groups = (
        features.select("id", "same").join(classes.select("same", "class_id", "rep"), "same")
        .join(nodes.join(heads, "component").select(F.col("node").alias("rep"), "head"), "rep", "left")
        .select(F.col("id").alias(id_col), "rep", "class_id", F.coalesce("head", "class_id").alias("group_id"))
    )
    named = links.join(names.select(F.col("rep").alias("a"), F.col("class_id").alias("x")), "a").join(names.select(F.col("rep").alias("b"), F.col("class_id").alias("y")), "b")
    named = named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    if tree:
        return groups.drop("rep"), named
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    return groups.join(ends, "rep", "left").select(id_col, "class_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), named
