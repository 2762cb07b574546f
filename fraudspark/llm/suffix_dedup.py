"""Exact repeated strings: removes every byte covered by a string of `LENGTH` bytes that also starts elsewhere.

Sorting the suffixes of a whole corpus needs many times the input in memory and network, so suffixes
are first put into small groups that hold all their possible partners:

1. Every window of LENGTH bytes has an anchor, the gram of GRAM bytes in it whose prefix-polynomial hash
   is smallest (the rightmost on ties). Equal windows have equal anchors at equal offsets. Neighbouring
   windows with one anchor are a run; anchors that occur once in the corpus are dropped.
2. Runs that are equal as a whole are one class. A class of two or more runs is repeated throughout.
3. The other classes are compared with the classes of the same anchor: a task sorts their suffixes from
   the anchor on by merge sort. Two suffixes are compared by their longest common extension, found by
   binary search on prefix polynomial hashes and then verified on the bytes. Neighbours in that order share the
   longest extensions, so partners are looked up outward from each suffix and the walk ends where the extension is
   too short for any window; the extension to the left is found likewise.
4. Anchors with more than GROUP classes are split by the bytes that all windows of a block of offsets share, for
   ever smaller blocks (BLOCKS). Equal contexts are counted and go on as one, and groups that became small are
   compared as in 3; single windows are only counted. This is exact, and no group, however common, meets in one task.

Classes carry a second hash of their bytes (xxh3) besides the polynomial one of the anchor, so two
different runs are not taken as equal unless both hashes collide.

Nulls are read as empty texts; texts shorter than LENGTH bytes are kept whole. Repeated rows repeat each other.
An empty table gives an empty table. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import as_bytes, map_batches, mix, signed
from fraudspark.session import cut_lineage

LENGTH, GRAM = 400, 200
SPAN = LENGTH - GRAM + 1  # places of a gram in a window
GROUP, BLOCKS = 64, (25, 5, 1)
CHUNK = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(400).integers(1, 1 << 63, 256, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POWERS = _powers(_BASE, CHUNK + LENGTH + 1)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), CHUNK + LENGTH + 1)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h[i]: polynomial hash of the first i bytes; (h[i + n] - h[i]) / base**i is that of n bytes from i on."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTES[data] * _POWERS[:len(data)], out=out[1:])
    return out


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor place, anchor hash) of each window of `data`."""
    sums = prefix_hashes(data)
    grams = len(data) - GRAM + 1
    with np.errstate(over="ignore"):
        hashed = mix((sums[GRAM:] - sums[:grams]) * _INVERSE[:grams])
    low = np.uint64((1 << 24) - 1)
    marked = (hashed & ~low) | (low - np.arange(grams, dtype=np.uint64))
    blocks = -(-grams // SPAN)
    padded = np.full(blocks * SPAN, np.iinfo(np.uint64).max, np.uint64)
    padded[:grams] = marked
    square = padded.reshape(blocks, SPAN)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(data) - LENGTH + 1
    least = np.minimum(behind[:windows], ahead[SPAN - 1:SPAN - 1 + windows])
    place = (low - (least & low)).astype(np.int64)
    return place, hashed[place]


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, class, first window, last window, anchor place) of every run."""
    parts = []
    for at in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        piece = np.frombuffer(data, np.uint8)[at:at + CHUNK + LENGTH - 1]
        place, hashed = _anchors(piece)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:], len(place)) - 1
        parts.append((hashed[first], first + at, last + at, place[first] + at))
    if not parts:
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), np.empty(0, np.uint64), empty, empty, empty
    anchor, first, last, place = (np.concatenate(p) for p in zip(*parts))
    whole = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist())), np.uint64, len(first))
    with np.errstate(over="ignore"):
        shape = ((place - first) << 8 | (place - last)).astype(np.uint64)
        return anchor, mix(mix(mix(anchor) + whole) + shape), first, last, place


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows with a key of id and text; equal rows have one key, and one result."""
    return docs.select(F.xxhash64(id_column, text_column).alias("key"), F.col(id_column).alias("id"), F.col(text_column).alias("text"))


def run_rows(keyed: DataFrame) -> DataFrame:
    """(anchor, class, key, place, far, near, n): the different runs of each text, with their number.

    `place` is the anchor of the first one; the windows start `far` to `near` bytes before it.
    """

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            columns: list[list[np.ndarray]] = [[] for _ in range(7)]
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                anchor, kind, first, last, place = runs(as_bytes(text))
                kind, at, n = np.unique(kind, return_index=True, return_counts=True)
                made = (signed(anchor[at]), signed(kind), np.full(len(at), key, np.int64), place[at], place[at] - first[at], place[at] - last[at], n)
                for column, values in zip(columns, made):
                    column.append(values)
            arrays = [np.concatenate(c) for c in columns]
            return pa.RecordBatch.from_arrays(
                [pa.array(a, t) for a, t in zip(arrays, [pa.int64()] * 4 + [pa.int32()] * 3, strict=True)],
                names=["anchor", "class", "key", "place", "far", "near", "n"])

        return work

    return map_batches(keyed.select("key", "text"), make, "anchor long, class long, key long, place long, far int, near int, n int")


class _Contexts:
    """Prefix hashes of the contexts of one group, for common extensions from an anchor."""

    def __init__(self, contexts: list[bytes], anchors: list[int]):
        self.contexts, self.anchors = contexts, anchors
        self.sums = [prefix_hashes(np.frombuffer(c, np.uint8)).tolist() for c in contexts]

    def _same(self, x: int, i: int, y: int, j: int, n: int) -> bool:
        a, b = self.sums[x], self.sums[y]
        left, right = (a[i + n] - a[i]) & _MASK, (b[j + n] - b[j]) & _MASK
        return (left * _POWER_LIST[j]) & _MASK == (right * _POWER_LIST[i]) & _MASK if i != j else left == right

    def right(self, x: int, y: int) -> int:
        """Equal bytes from the anchors on."""
        i, j = self.anchors[x], self.anchors[y]
        a, b = self.contexts[x], self.contexts[y]
        low, high = 0, min(len(a) - i, len(b) - j)
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if self._same(x, i, y, j, n) else (low, n - 1)
        if a[i:i + low] != b[j:j + low]:  # the hashes collided
            low = next(k for k in range(low) if a[i + k] != b[j + k])
        return low

    def left(self, x: int, y: int, most: int) -> int:
        """Equal bytes before the anchors, `most` at most."""
        i, j = self.anchors[x], self.anchors[y]
        a, b = self.contexts[x], self.contexts[y]
        low, high = 0, min(i, j, most)
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if self._same(x, i - n, y, j - n, n) else (low, n - 1)
        if a[i - low:i] != b[j - low:j]:
            low = next(k for k in range(low) if a[i - 1 - k] != b[j - 1 - k])
        return low

    def compare(self, x: int, y: int) -> int:
        n = self.right(x, y)
        a, b = self.contexts[x][self.anchors[x] + n:self.anchors[x] + n + 1], self.contexts[y][self.anchors[y] + n:self.anchors[y] + n + 1]
        return (a > b) - (a < b)


_POWER_LIST = _POWERS[:4 * LENGTH].tolist()


def partners(contexts: list[bytes], far: list[int], near: list[int]) -> list[list[tuple[int, int]]]:
    """For each context the ranges (from, to) of window offsets, counted back from the anchor, that another context has too.

    A context starts `far` bytes before its anchor; its windows start `near` to `far` bytes before it.
    """
    held = _Contexts(contexts, far)
    order = sorted(range(len(contexts)), key=cmp_to_key(held.compare))
    shared = [held.right(a, b) for a, b in zip(order, order[1:])]
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for at, x in enumerate(order):
        for step in (1, -1):
            other, most = at + step, 1 << 30
            while 0 <= other < len(order):
                most = min(most, shared[min(other, other - step)])
                if most < LENGTH - far[x]:
                    break
                y = order[other]
                low, high = max(near[x], near[y], LENGTH - most), min(far[x], far[y])
                if low <= high:
                    high = held.left(x, y, high)
                    if low <= high:
                        out[x].append((low, high))
                other += step
    return out


def _grouped(batches, columns: int):
    """Lists of rows with equal first column, from rows sorted by it; only one group is held at a time."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[:columns])):
            if row[0] != key and rows:
                yield rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield rows


def _solve(contexts: DataFrame) -> DataFrame:
    """(key, class, low, high) of the repeated windows of rows (grp, class, c, key, far, near, context), groups of GROUP at most."""

    def run(batches):
        out: list[tuple] = []
        for rows in _grouped(batches, 7):
            for row, found in zip(rows, partners([r[6] for r in rows], [r[4] for r in rows], [r[5] for r in rows])):
                if row[2] == 1:
                    out += [(row[3], row[1], low, high) for low, high in set(found)]
            if len(out) > 10_000:
                yield _marks(out)
                out = []
        yield _marks(out)

    return contexts.select("grp", "class", "c", "key", "far", "near", "context").repartition("grp").sortWithinPartitions("grp").mapInArrow(
        run, "key long, class long, low int, high int")


def _marks(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                      names=["key", "class", "low", "high"])


def _split(contexts: DataFrame, width: int) -> DataFrame:
    """Rows of large groups by blocks of `width` offsets; a new group shares the bytes that all windows of the block have."""

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for grp, kind, c, key, far, near, context in zip(*(x.to_pylist() for x in part.columns)):
                for low in range(near // width * width, far + 1, width):
                    a, b = min(far, low + width - 1), max(near, low)
                    top = low + width - 1  # the shared bytes start `low` before the anchor and end with the window `top` before it
                    core = context[far - low:far - top + LENGTH]
                    mark = xxhash.xxh3_64_intdigest(core, seed=(grp ^ low) & _MASK)
                    own = context[far - a:far - b + LENGTH]
                    whole = xxhash.xxh3_64_intdigest(own, seed=a << 8 | b)
                    out.append((mark - (1 << 64) if mark >> 63 else mark, kind, c, key, a, b, own, whole - (1 << 64) if whole >> 63 else whole))
            columns = list(zip(*out)) if out else [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)],
                                              names=["grp", "class", "c", "key", "far", "near", "context", "whole"])

        return work

    return map_batches(contexts.select("grp", "class", "c", "key", "far", "near", "context"), make,
                       "grp long, class long, c int, key long, far int, near int, context binary, whole long")


def _level(contexts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Splits large groups; (marks of the contexts that occur twice as a whole, the others with their group's size m)."""
    rows = cut_lineage(_split(contexts, width), "blocks")
    same = cut_lineage(rows.groupBy("grp", "whole").agg(
        F.count("*").alias("n"), F.max("c").alias("c"), F.min(F.struct("key", "class", "far", "near", "context")).alias("first")), "same")
    done = rows.filter("c = 1").join(same.filter("n > 1").select("grp", "whole"), ["grp", "whole"]).select(
        "key", "class", F.col("near").alias("low"), F.col("far").alias("high"))
    left = same.select("grp", F.when(F.col("n") > 1, 2).otherwise(F.col("c")).alias("c"), "first.*")
    sizes = cut_lineage(left.groupBy("grp").agg(F.count("*").alias("m"), F.min("c").alias("least")).filter("m > 1 and least = 1").select("grp", "m"), "sizes")
    return done, left.join(sizes, "grp")


def repeated(docs: DataFrame, *, id_column: str, text_column: str) -> DataFrame:
    """(key, class, low, high): window offsets of the runs of each text that occur elsewhere; low = -1 for the whole run."""
    keyed = _keyed(docs, id_column, text_column)
    found = run_rows(keyed)
    twice = found.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    live = cut_lineage(found.join(twice, "anchor"), "runs")
    first = F.min(F.struct("key", "place", "far", "near")).alias("first")
    classes = cut_lineage(live.groupBy("anchor", "class").agg(F.sum("n").alias("c"), first), "classes")
    full = live.select("class", "key").join(classes.filter("c > 1").select("class"), "class").select(
        "key", "class", F.lit(-1).alias("low"), F.lit(-1).alias("high"))

    # Stored, so that the join can split the classes of a common anchor at run time.
    groups = cut_lineage(classes.groupBy("anchor").agg(F.count("*").alias("m"), F.min("c").alias("least"))
                         .filter("m > 1 and least = 1").select("anchor", "m"), "groups")
    unsure = classes.join(groups, "anchor").select(
        "first.key", F.struct(F.col("anchor").alias("grp"), "class", F.least("c", F.lit(2)).cast("int").alias("c"), "m",
                              "first.place", "first.far", "first.near").alias("run"))
    wanted = unsure.groupBy("key").agg(F.collect_list("run").alias("runs"))
    texts = keyed.select("key", "text").join(wanted, "key")

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for key, text, wanted in zip(*(c.to_pylist() for c in part.columns)):
                data = as_bytes(text)
                for r in wanted:
                    start = r["place"] - r["far"]
                    out.append((r["grp"], r["class"], r["c"], key, r["far"], r["near"], r["m"], data[start:r["place"] - r["near"] + LENGTH]))
            columns = list(zip(*out)) if out else [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)],
                                              names=["grp", "class", "c", "key", "far", "near", "m", "context"])

        return work

    contexts = cut_lineage(map_batches(texts, make, "grp long, class long, c int, key long, far int, near int, m long, context binary"), "contexts")
    marks = full.unionByName(_solve(contexts.filter(F.col("m") <= GROUP)))
    for width in BLOCKS:
        done, contexts = _level(contexts.filter(F.col("m") > GROUP), width)
        marks = marks.unionByName(done)
        if width > 1:
            contexts = cut_lineage(contexts, "contexts")
            marks = marks.unionByName(_solve(contexts.filter(F.col("m") <= GROUP)))
    return marks


def remove_repeated(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, removed array<struct<start, end>>, kept binary) of every row; `removed` are the maximal removed runs."""
    kind = docs.schema[id_column].dataType.simpleString()
    marks = repeated(docs, id_column=id_column, text_column=text_column)
    by_text = marks.groupBy("key").agg(F.collect_set(F.struct("class", "low", "high")).alias("marks"))
    rows = _keyed(docs, id_column, text_column).join(by_text, "key", "left").select("id", "text", "marks")
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            sizes, spans, kept = [], [], []
            for text, marks in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                data = as_bytes(text)
                found = removed_spans(data, [(m["class"], m["low"], m["high"]) for m in marks]) if marks else []
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in found])
                ends = [0] + [x for s in found for x in s] + [len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2])))
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, shape), pa.array(kept, pa.binary())],
                                              names=[id_column, "n_bytes", "removed", "kept"])

        return work

    return map_batches(rows, make, f"`{id_column}` {kind}, n_bytes long, removed array<struct<start: bigint, end: bigint>>, kept binary")


def removed_spans(data: bytes, marks: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Union of the marked windows of a text."""
    _, kinds, first, last, place = runs(data)
    kinds = signed(kinds)
    order = np.argsort(kinds, kind="stable")
    sorted_kinds = kinds[order]
    cover = np.zeros(len(data) + 1, np.int32)
    for kind, low, high in marks:
        a, b = (int(np.searchsorted(sorted_kinds, kind, side)) for side in ("left", "right"))
        for at in order[a:b].tolist():
            start, end = (first[at], last[at]) if low < 0 else (place[at] - high, place[at] - low)
            cover[start] += 1
            cover[end + LENGTH] -= 1
    inside = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))

