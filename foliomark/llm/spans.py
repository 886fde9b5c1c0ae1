"""Long stretches that records share character by character (problem 3).

The anchor of a span of 160 characters is the least hash among its 61 windows of 100 characters; equal spans have
equal anchors, and neighbouring spans mostly share theirs. Every partition counts its anchors in a count-min
sketch, which is cut into slices of the hash range whose number follows the number of anchors; the merged sketch
overestimates and so loses no repeated anchor. A second pass sends the anchors to their slices, groups exactly
those estimated repeated, and then the spans of those anchors that more than one text has.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import arrow_map, staged

#: Cells in each row of a slice of the sketch.
CELLS = 1 << 22
_CELL = np.uint64(CELLS - 1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SECOND = np.uint64(0xD1B54A32D192ED03)


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, _INVERSE))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix(text: str) -> np.ndarray:
    """Prefix sums of a polynomial hash over the code points."""
    codes = _mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(77))
    power = _powers(1 << max(12, (len(codes) + 1).bit_length()))[0]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[: len(codes)])])


def windows(sums: np.ndarray, length: int, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Hashes of all windows of a length that lie in [begin, end)."""
    end = len(sums) - 1 if end is None else end
    n = end - begin - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    inverse = _powers(1 << max(12, len(sums).bit_length()))[1]
    return _mix((sums[begin + length : end + 1] - sums[begin : begin + n]) * inverse[begin : begin + n])


def _sliding(a: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum (maximum) of every w successive values."""
    n, op, fill = len(a), np.minimum if least else np.maximum, np.uint64(2**64 - 1 if least else 0)
    padded = np.concatenate([a, np.full(-n % w, fill, np.uint64)]).reshape(-1, w)
    ahead = op.accumulate(padded, axis=1).ravel()
    back = op.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - w + 1], ahead[w - 1 : n])


def anchor_length(span: int) -> int:
    return span * 5 // 8


def anchors(sums: np.ndarray, begin: int, end: int, span: int) -> np.ndarray:
    """For every span (by its start) within [begin, end) the hash of its anchor, the least of its windows of anchor length; equal spans have equal anchors."""
    k = anchor_length(span)
    return _sliding(windows(sums, k, begin, end), span - k + 1, True) if end - begin >= span else np.zeros(0, np.uint64)


def stretches(starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    """The union of [s, s + span) over sorted starts, as maximal stretches of characters each in a span."""
    return _united(starts, starts + span)


def _united(begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of stretches in any order; such as touch become one."""
    if not len(begins):
        return []
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(begins[1:] > ends[:-1])
    return list(zip(begins[np.concatenate([[0], cut + 1])].tolist(), ends[np.concatenate([cut, [len(ends) - 1]])].tolist()))


class Sources:
    """All windows of known sources of bounded size."""

    def __init__(self, texts: list[str], span: int):
        found = [windows(prefix(t), span) for t in texts if t]
        self.hashes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.near[(h >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.hashes, h[maybe])
        return maybe[(at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == h[maybe])] if len(self.hashes) else maybe[:0]


def _free(size: int, known: list[tuple[int, int]], span: int) -> list[tuple[int, int]]:
    """Stretches of at least ``span`` characters outside the known ones."""
    free, at = [], 0
    for a, b in [*known, (size, size)]:
        if a - at >= span:
            free.append((at, a))
        at = b
    return free


def _by_slice(h: np.ndarray, slices: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the hashes by slice, and (slice, begin, end) of each slice in it."""
    slice_ = ((h >> np.uint64(40)) % np.uint64(slices)).astype(np.int64)
    order = np.argsort(slice_, kind="stable")
    found = slice_[order]
    edges = [0, *(np.flatnonzero(np.diff(found)) + 1).tolist(), len(h)]
    return order, [(int(found[a]), a, b) for a, b in zip(edges, edges[1:]) if a < b]


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each hash in both rows of its slice."""
    return (h & _CELL).astype(np.uint32), (_mix(h * _SECOND) & _CELL).astype(np.uint32)


def _chunks(batches: Iterator[pa.RecordBatch], size: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, texts) of about ``size`` anchors at a time, ordered by hash and text; batches hold (same, anchors)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def sent() -> tuple[np.ndarray, np.ndarray]:
        h, same = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((same, h))
        return h[order], same[order]

    for batch in batches:
        for same, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if packed:
                held.append((np.frombuffer(packed, np.uint64), np.full(len(packed) // 8, same, np.int64)))
                n += len(packed) // 8
            if n >= size:
                yield sent()
                held, n = [], 0
    if held:
        yield sent()


def _twice(h: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Which anchors of a chunk ordered by hash and text are in two of its texts."""
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    last = np.append(first[1:], len(h)) - 1
    return np.repeat(same[first] != same[last], last - first + 1)


def _sketch(anchored: DataFrame, slices: int) -> DataFrame:
    """The merged count-min sketch as (slice, bits): in both rows the cells that at least two texts may have.

    Every partition counts its anchors slice by slice; the slices of all partitions are added up where they meet.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, same in _chunks(batches):
            twice = _twice(h, same)
            new = np.concatenate([[True], h[1:] != h[:-1]])
            h, twice = h[new], twice[new]
            order, found = _by_slice(h, slices)
            h, twice = h[order], twice[order]
            rows: tuple[list, ...] = ([], [], [])
            for number, a, b in found:
                once, more = [], []
                for cells in _cells(h[a:b]):
                    cells = np.concatenate([cells, cells[twice[a:b]]])
                    cells, n = np.unique(cells, return_counts=True)
                    once.append(cells[n == 1].tobytes())
                    more.append(cells[n > 1].tobytes())
                for column, value in zip(rows, (number, once, more)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.list_(pa.binary())), pa.array(rows[2], pa.list_(pa.binary()))], names=["slice", "once", "more"])

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros((2, CELLS), np.uint8)
        for once, more in zip(pdf.once, pdf.more):
            for row in range(2):
                cells = np.frombuffer(once[row], np.uint32)
                seen[row][cells] = np.minimum(seen[row][cells] + 1, 2)
                seen[row][np.frombuffer(more[row], np.uint32)] = 2
        return pd.DataFrame({"slice": [key[0]], "bits": [np.packbits(seen > 1).tobytes()]})

    partial = anchored.mapInArrow(count, "slice bigint, once array<binary>, more array<binary>")
    return partial.groupBy("slice").applyInPandas(merge, "slice bigint, bits binary")


def _estimated_repeated(anchored: DataFrame, slices: int) -> DataFrame:
    """(anchor, same) of all anchors that the sketch takes for repeated, of (same, anchors) rows.

    Anchors meet the slice of the sketch they fall into, so that neither is ever in one place as a whole. An anchor
    that a chunk has in two of its texts is repeated for certain and asks no slice: a hot one sends one row a chunk.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, same in _chunks(batches):
            twice = _twice(h, same)
            rows: tuple[list, ...] = ([], [], [], [])
            sure = np.flatnonzero(twice)
            for begin in range(0, len(sure), 100_000):
                part = sure[begin : begin + 100_000]
                for column, value in zip(rows, (-1 - int(h[part[0]] >> np.uint64(2)), None, h[part].tobytes(), same[part].tobytes())):
                    column.append(value)
            h, same = h[~twice], same[~twice]
            order, found = _by_slice(h, slices)
            for number, a, b in found:
                part = order[a:b]
                for column, value in zip(rows, (number, None, h[part].tobytes(), same[part].tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), *[pa.binary()] * 3))], names=["slice", "bits", "anchor", "same"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen = None, None
        for batch in batches:
            for s, bits, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                if bits is not None:
                    number, seen = s, np.frombuffer(bits, np.uint8).reshape(2, -1)
                    continue
                h, same = (np.frombuffer(x, t) for x, t in zip(packed, (np.uint64, np.int64)))
                if s >= 0:
                    keep = np.ones(len(h), bool)
                    for row, cells in enumerate(_cells(h)):
                        keep &= number == s and (seen[row][cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 > 0
                    h, same = h[keep], same[keep]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(same)], names=["anchor", "same"])

    nothing = F.lit(None).cast("binary")
    asking = anchored.mapInArrow(ask, "slice bigint, bits binary, anchor binary, same binary")
    sketch = _sketch(anchored, slices).select("slice", "bits", nothing.alias("anchor"), nothing.alias("same"))
    together = sketch.unionByName(asking).repartition(math.ceil(slices / 2) + 2, "slice").sortWithinPartitions("slice", F.col("bits").isNull())
    return together.mapInArrow(answer, "anchor bigint, same bigint")


_RUN = np.dtype([("same", "<i8"), ("start", "<u4"), ("size", "<u4")])
_PACKED = "bucket bigint, salt int, hashes binary, runs binary, marks binary"


def _as_runs(same: np.ndarray, start: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Windows as (runs of successive starts of one text, index of the first window of each)."""
    new = (np.diff(same) != 0) | (np.diff(start) != 1)
    if group is not None:
        new |= np.diff(group) != 0
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(same)), bool), new]))
    runs = np.zeros(len(first), _RUN)
    runs["same"], runs["start"], runs["size"] = same[first], start[first], np.diff(np.append(first, len(same)))
    return runs, first


def _of_runs(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, starts) of the windows of runs."""
    size = runs["size"].astype(np.int64)
    before = np.cumsum(size) - size
    return np.repeat(runs["same"], size), np.arange(int(size.sum())) - np.repeat(before - runs["start"].astype(np.int64), size)


def _settled(h: np.ndarray, same: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which windows more than one text has, hashes of those): ``marks`` are hashes known to be shared."""
    order = np.argsort(h, kind="stable")
    found = h[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), found[1:] != found[:-1]]))
    if not len(first):
        return np.zeros(0, bool), np.unique(marks)
    shared = np.minimum.reduceat(same[order], first) != np.maximum.reduceat(same[order], first)
    shared |= np.isin(found[first], marks)
    out = np.zeros(len(h), bool)
    out[order] = np.repeat(shared, np.diff(np.append(first, len(h))))
    return out, np.union1d(found[first][shared], marks)


def _groups(packed: DataFrame, final: bool) -> DataFrame:
    """Exact groups of the windows of each bucket: rows without hashes are runs of shared windows.

    Before the ``final`` level, which has one salt, rows with the windows undecided so far and marks of those decided go on.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        done = [np.frombuffer(r, _RUN) for h, r in zip(pdf.hashes, pdf.runs) if h is None]
        held = [(np.frombuffer(h, np.uint64), np.frombuffer(r, _RUN)) for h, r in zip(pdf.hashes, pdf.runs) if h is not None]
        rows: list[tuple] = []
        if held:
            h = np.concatenate([x[0] for x in held])
            same, start = _of_runs(np.concatenate([x[1] for x in held]))
            marks = np.concatenate([np.frombuffer(m, np.uint64) for m in pdf.marks if m is not None] or [np.zeros(0, np.uint64)])
            shared, marks = _settled(h, same, marks)
            done.append(_as_runs(same[shared], start[shared])[0])
            if not final:
                rest = ~shared
                rows.append((key[0], 0, h[rest].tobytes(), _as_runs(same[rest], start[rest])[0].tobytes(), marks.tobytes()))
        runs = np.concatenate(done) if done else np.zeros(0, _RUN)
        if final:
            return pd.DataFrame({"same": runs["same"], "start": runs["start"].astype(np.int64), "size": runs["size"].astype(np.int64)})
        if len(runs):
            rows.append((-1 - int(runs["same"][0]) % 1_000_003, 0, None, runs.tobytes(), None))
        return pd.DataFrame(rows, columns=["bucket", "salt", "hashes", "runs", "marks"])

    return packed.groupBy(*(["bucket"] if final else ["bucket", "salt"])).applyInPandas(run, "same bigint, start bigint, size bigint" if final else _PACKED)


def _source_starts(docs: DataFrame, sources: DataFrame, span: int) -> DataFrame:
    """(same, starts) of the texts with windows that a source has: anchors are joined first, then the windows around them."""

    def anchored(same, texts):
        found = [np.unique(anchors(prefix(text), 0, len(text), span)) for text in texts]
        flat = np.concatenate([np.zeros(0, np.uint64), *found])
        return [pa.array(flat.view(np.int64)), pa.array(np.repeat(np.array(same, np.int64), [len(f) for f in found]))]

    def near(same, texts, wanted):
        hashes, places = [np.zeros(0, np.uint64)], [np.zeros((2, 0), np.int64)]
        for key, text, some in zip(same, texts, wanted):
            sums = prefix(text)
            starts = np.flatnonzero(np.isin(anchors(sums, 0, len(text), span), np.array(some, np.int64).view(np.uint64)))
            hashes.append(windows(sums, span)[starts])
            places.append(np.stack([np.full(len(starts), key, np.int64), starts]))
        at = np.concatenate(places, axis=1)
        return [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(at[0]), pa.array(at[1])]

    def hashed(texts):
        return [pa.array(np.concatenate([np.zeros(0, np.uint64), *(windows(prefix(t), span) for t in texts)]).view(np.int64))]

    of_sources = arrow_map(sources.select(F.xxhash64("t").alias("same"), "t"), anchored, "anchor bigint, same bigint").select("anchor").distinct()
    wanted = arrow_map(docs.select("same", "text"), anchored, "anchor bigint, same bigint").join(of_sources, "anchor", "left_semi").groupBy("same").agg(F.collect_set("anchor").alias("wanted"))
    found = arrow_map(docs.join(wanted, "same").select("same", "text", "wanted"), near, "w bigint, same bigint, start bigint")
    return found.join(arrow_map(sources.select("t"), hashed, "w bigint").distinct(), "w", "left_semi").groupBy("same").agg(F.sort_array(F.collect_set("start")).alias("starts"))


def shared_with_documents(documents: DataFrame, sources: DataFrame, span: int = 160, id_col: str = "doc_id", text_col: str = "text", source_text_col: str = "text", hot: int = 200_000, broadcast_chars: int = 5_000_000) -> DataFrame:
    """(record_kind, record_id, span_start, span_end) of the kinds source and document.

    ``source``: stretches of characters each in a span of at least ``span`` characters that a source has too.
    ``document``: the same for spans of another document, where spans that touch a source stretch do not count.
    Null texts, null ids and shorter texts give no rows; equal texts share all of it. The windows of the sources
    are broadcast (8 bytes each) where the sources have at most ``broadcast_chars`` characters, which is counted
    first; beyond that they are joined by hash, with the same result. The sketch has 16 cells for each anchor, so
    that it lets equally few single anchors through at every size.
    """
    source_texts = sources.select(F.col(source_text_col).alias("t")).filter("t is not null").distinct()
    docs = documents.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("same"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    known = None
    if (source_texts.agg(F.sum(F.length("t"))).first()[0] or 0) <= broadcast_chars:
        known = documents.sparkSession.sparkContext.broadcast(Sources([r["t"] for r in source_texts.collect()], span))

    def analyse(ids, same, texts, starts):
        out = ([], [], [], [], [], [])
        for key, text_key, text, at in zip(ids, same, texts, starts):
            if len(text) < span:
                values = (key, text_key, b"", b"", b"", 0)
            else:
                sums = prefix(text)
                own = stretches(known.value.hits(windows(sums, span)) if known else np.array(at or [], np.int64), span)
                free = _free(len(text), own, span)
                found = [low[np.concatenate([[True], low[1:] != low[:-1]])] for a, b in free for low in [anchors(sums, a, b, span)]]
                h = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
                values = (key, text_key, np.array(own, np.int64).tobytes(), np.array(free, np.int64).tobytes(), h.tobytes(), len(h))
            for column, value in zip(out, values):
                column.append(value)
        return out

    given = docs.withColumn("starts", F.lit(None).cast("array<bigint>")) if known else docs.join(_source_starts(docs, source_texts, span), "same", "left").select("id", "same", "text", "starts")
    records = staged(arrow_map(given, analyse, "id bigint, same bigint, own binary, free binary, anchors binary, n int"), "spans")
    # one document stands for all with its text; the others get their stretches from it
    copies = records.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1")
    reps = records.join(copies, "same", "left").filter("n > 0 and (rep is null or rep = id)").select("id", "same", "free", "anchors")
    slices = max(1, math.ceil(16 * (records.agg(F.sum("n")).first()[0] or 0) / CELLS))
    rows = staged(_estimated_repeated(reps.select("same", "anchors"), slices), "anchors")
    groups = staged(rows.groupBy("anchor").agg(F.min("same").alias("low"), F.max("same").alias("high"), F.count("*").alias("c")).filter("low <> high").select("anchor", "c"), "repeated")
    size = groups.agg(F.sum("c").alias("total"), F.max("c").alias("top")).first()
    total, top = size["total"] or 0, size["top"] or 0
    wanted = rows.join(groups.select("anchor"), "anchor").groupBy("same").agg(F.collect_set("anchor").alias("wanted"))
    buckets = max(4, math.ceil(total * (span - anchor_length(span)) / 500_000))
    salts = max(1, math.ceil(top / hot))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # window hashes, anchors, texts, starts
        n = chunk = 0

        def sent() -> pa.RecordBatch:
            h, low, same, start = (np.concatenate(x) for x in zip(*held))
            shared, _ = _settled(h, same, np.zeros(0, np.uint64))
            rows: tuple[list, ...] = ([], [], [], [], [])

            def put(*row) -> None:
                for column, value in zip(rows, row):
                    column.append(value)

            if shared.any():
                runs = _as_runs(same[shared], start[shared])[0]
                put(-1 - int(h[0] >> np.uint64(2)), 0, None, runs.tobytes(), None)
            # of a window that the chunk has in two texts, a mark goes on for all
            decided = np.zeros(len(h), bool)
            decided[np.unique(h, return_index=True)[1]] = True
            decided &= shared
            go = ~shared
            bucket = ((low >> np.uint64(36)) % np.uint64(buckets)).astype(np.int64)
            order = np.flatnonzero(go)[np.argsort(bucket[go], kind="stable")]
            runs, first = _as_runs(same[order], start[order], bucket[order])
            marked = np.flatnonzero(decided)[np.argsort(bucket[decided], kind="stable")]
            of_runs, of_marks = bucket[order][first], bucket[marked]
            salt = xxhash.xxh32_intdigest(h[:1].tobytes()) % salts
            for k in np.union1d(of_runs, of_marks).tolist():
                a, b = np.searchsorted(of_runs, [k, k + 1])
                x, y = (first[a], first[b] if b < len(first) else len(order)) if a < b else (0, 0)
                c, d = np.searchsorted(of_marks, [k, k + 1])
                put(k, salt, h[order[x:y]].tobytes(), runs[a:b].tobytes(), h[marked[c:d]].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), *[pa.binary()] * 3))], names=["bucket", "salt", "hashes", "runs", "marks"])

        for batch in batches:
            for same, segments, some, text in zip(*(c.to_pylist() for c in batch.columns)):
                sums, some = prefix(text), np.sort(np.array(some, np.int64).view(np.uint64))
                for a, b in np.frombuffer(segments, np.int64).reshape(-1, 2).tolist():
                    low = anchors(sums, a, b, span)
                    at = np.flatnonzero(some[np.minimum(np.searchsorted(some, low), len(some) - 1)] == low)
                    if len(at):
                        held.append((windows(sums, span, a, b)[at], low[at], np.full(len(at), same, np.int64), at + a))
                        n += len(at)
                if n >= 1_000_000:
                    yield sent()
                    held, n = [], 0
        if held:
            yield sent()

    chosen = reps.select("id", "same", "free").join(wanted, "same").join(docs, ["id", "same"]).select("same", "free", "wanted", "text")
    packed = chosen.mapInArrow(pack, _PACKED)
    if salts > 1:
        packed = _groups(packed.repartition(math.ceil(buckets * salts / 2), "bucket", "salt"), False)
    # about two buckets of half a million windows to a task, at every size
    decided = _groups(packed.repartition(math.ceil(buckets / 2), "bucket"), True)
    reps = decided.groupBy("same").agg(F.collect_list(F.struct("start", "size")).alias("found"))

    # of each document: its source stretches, and its share with others
    def report(ids, own, free, runs_, copied):
        out = ([], [], [], [])
        for key, spans_, segments, found, more in zip(ids, own, free, runs_, copied):
            for a, b in np.frombuffer(spans_, np.int64).reshape(-1, 2).tolist():
                for column, value in zip(out, ("source", key, a, b)):
                    column.append(value)
            if more:
                shared = np.frombuffer(segments, np.int64).reshape(-1, 2).tolist()
            else:
                runs = np.array([(r["start"], r["size"]) for r in found or []], np.int64).reshape(-1, 2)
                shared = _united(runs[:, 0], runs[:, 0] + runs[:, 1] - 1 + span)
            for a, b in shared:
                for column, value in zip(out, ("document", key, a, b)):
                    column.append(value)
        return out

    joined = records.select("id", "same", "own", "free").join(reps, "same", "left").join(copies.select("same", F.lit(True).alias("copied")), "same", "left")
    return arrow_map(joined.select("id", "own", "free", "found", "copied"), report, "record_kind string, record_id bigint, span_start bigint, span_end bigint").distinct()


def shared_pair_spans(a: str | None, b: str | None, span: int) -> list[tuple[int, int]]:
    """Stretches of ``a`` in spans of at least ``span`` characters that ``b`` has too."""
    if not a or not b or min(len(a), len(b)) < span:
        return []
    half = span // 2
    if not any(a[i : i + half] in b for i in range(0, len(a) - half + 1, half)):
        return []  # a span of this length holds one of these blocks
    there = {b[i : i + span] for i in range(len(b) - span + 1)}
    return stretches(np.array([i for i in range(len(a) - span + 1) if a[i : i + span] in there], np.int64), span)


def shared_in_evidence(evidence: DataFrame, span: int = 160, id_col: str = "evidence_id", a: str = "submitted_text", b: str = "source_text") -> DataFrame:
    """(record_kind, record_id, span_start, span_end) of stretches that a row's two quotes share; null quotes share nothing."""

    def run(ids, left, right):
        rows = [(key, s, e) for key, x, y in zip(ids, left, right) for s, e in shared_pair_spans(x, y, span)]
        return ["evidence"] * len(rows), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]

    return arrow_map(evidence.select(F.col(id_col).cast("bigint"), a, b), run, "record_kind string, record_id bigint, span_start bigint, span_end bigint").distinct()


def shared_share(documents: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, shared_chars, shared_share) of every document with a text; stretches of a record never overlap within a kind."""
    covered = found.filter("record_kind <> 'evidence'").groupBy(F.col("record_id").alias(id_col)).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sizes = documents.select(id_col, F.length(text_col).cast("bigint").alias("n_chars")).filter("n_chars is not null")
    return sizes.join(covered, id_col, "left").fillna(0, ["shared_chars"]).withColumn("shared_share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))
