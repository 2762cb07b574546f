"""Training-order materialisation: every sequence gets a slot by a keyed permutation, and shards are written in slot order.

A sequence is `length` ids of one document (the last one may be shorter). Sequences are numbered in
reading order, 0 to N - 1: per-partition counts come first, so the number is the partition's base plus a
running count. A Feistel network over the next even power of two permutes the numbers; values of N or
more walk on along their cycle until they fall below N. Slot s lies in shard s // per_shard, record
s % per_shard; every record has the same stride (a 4-byte count, then `length` ids, padded), so a reader
starts anywhere by seeking. A task writes the shards of a range of slots, each to a temporary name
first, so a repeated task replaces what it wrote before.

The reading order is that of the input's partitions: `docs` must give the same rows in the same partitions
each time it is computed, as a table does. Nulls and empty texts have no sequences. Repeated rows have
sequences of their own. An empty table writes nothing. Columns other than id and text are not read.
"""

from __future__ import annotations

import os
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import as_bytes, slices

ROUNDS = 6


class Permutation:
    """A keyed bijection of 0 .. n - 1."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        draw = np.random.default_rng(key)
        self.keys = draw.integers(0, 1 << 63, ROUNDS, np.uint64)

    def _mixed(self, half: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (half + key) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return (x ^ (x >> np.uint64(29))) & self.mask

    def _once(self, values: np.ndarray, keys) -> np.ndarray:
        left, right = values >> np.uint64(self.half), values & self.mask
        for key in keys:
            left, right = right, left ^ self._mixed(right, key)
        return (left << np.uint64(self.half)) | right

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        """Slots of sequence numbers; cycle-walking until every slot is below n."""
        out = self._once(numbers.astype(np.uint64), self.keys)
        while (far := out >= np.uint64(self.n)).any():
            out[far] = self._once(out[far], self.keys)
        return out.astype(np.int64)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        """Sequence numbers of slots: the rounds backwards, walking the cycle the other way."""

        def back(values: np.ndarray) -> np.ndarray:
            left, right = values >> np.uint64(self.half), values & self.mask
            for key in self.keys[::-1]:
                left, right = right ^ self._mixed(left, key), left
            return (left << np.uint64(self.half)) | right

        out = back(slots.astype(np.uint64))
        while (far := out >= np.uint64(self.n)).any():
            out[far] = back(out[far])
        return out.astype(np.int64)


def _local(path: str) -> str:
    """Path of a shared folder that tasks reach as files."""
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{path} is not a folder that tasks can open")
    return parsed.path


def byte_ids(text: str | None) -> np.ndarray:
    """Ids of the byte vocabulary: the UTF-8 bytes."""
    return np.frombuffer(as_bytes(text), np.uint8)


def sequence_counts(docs: DataFrame, ids_of, *, text_column: str, length: int) -> list[int]:
    """Number of sequences of each partition, in order: one number a partition reaches the driver."""

    def count(batches):
        n = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += -(-len(ids_of(text)) // length)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n])], names=["task", "n"])

    rows = docs.select(text_column).mapInArrow(count, "task long, n long").collect()
    counts = [0] * (max((r["task"] for r in rows), default=-1) + 1)
    for r in rows:
        counts[r["task"]] = r["n"]
    return counts


def materialise(docs: DataFrame, path: str, *, key: int = 7, length: int = 512, per_shard: int = 8192, ids_of=byte_ids,
                dtype: str = "uint8", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes the shards below `path` when the result is computed: (slot, id, part, n_ids, shard, byte_offset) of every sequence."""
    folder = _local(path)
    os.makedirs(folder, exist_ok=True)
    counts = sequence_counts(docs, ids_of, text_column=text_column, length=length)
    bases, total = np.append(0, np.cumsum(counts, dtype=np.int64)), int(sum(counts))
    order, kind, stride = Permutation(max(total, 1), key), docs.schema[id_column].dataType.simpleString(), 4 + length * np.dtype(dtype).itemsize
    shards = max(1, -(-total // per_shard))
    tasks = min(shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))
    per_task = -(-shards // tasks)

    def assign(batches):
        number = int(bases[TaskContext.get().partitionId()]) if len(counts) else 0
        # Sequences meet strangers in the shuffle, so each is packed by itself.
        pack = zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=False, write_dict_id=False).compress
        for batch in batches:
            for part in slices(batch):
                owner, place, size, data = [], [], [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    ids = ids_of(text).astype(dtype)
                    for p, at in enumerate(range(0, len(ids), length)):
                        owner.append(k)
                        place.append(p)
                        size.append(min(length, len(ids) - at))
                        data.append(pack(ids[at:at + length].tobytes()))
                slots = order.slots(np.arange(number, number + len(owner)))
                number += len(owner)
                yield pa.RecordBatch.from_arrays([
                    pa.array(slots, pa.int64()), part.column(0).take(pa.array(owner, pa.int64())), pa.array(place, pa.int64()),
                    pa.array(size, pa.int32()), pa.array(data, pa.binary()),
                ], names=["slot", "id", "part", "n_ids", "data"])

    placed = docs.select(id_column, text_column).mapInArrow(assign, f"slot long, id {kind}, part long, n_ids int, data binary")
    # Slots are spread evenly by the permutation, so equal ranges of shards are equal shares.
    ranged = placed.repartitionById(tasks, F.floor(F.col("slot") / (per_shard * per_task)).cast("int")).sortWithinPartitions("slot")

    def write(batches):
        task, shard, file = TaskContext.get().taskAttemptId(), None, None
        unpack = zstandard.ZstdDecompressor().decompress
        name = lambda: os.path.join(folder, f"shard-{shard:08d}.bin")

        def close():
            if file is not None:
                file.close()
                os.replace(f"{name()}.{task}", name())

        for batch in batches:
            slots = batch.column(0).to_numpy()
            for slot, size, data in zip(slots.tolist(), batch.column(3).to_pylist(), batch.column(4)):
                if slot // per_shard != shard:
                    close()
                    shard = slot // per_shard
                    file = open(f"{name()}.{task}", "wb")
                file.write(size.to_bytes(4, "little") + unpack(data.as_buffer(), max_output_size=stride).ljust(stride - 4, b"\0"))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2), batch.column(3),
                pa.array(slots // per_shard), pa.array(slots % per_shard * stride),
            ], names=["slot", id_column, "part", "n_ids", "shard", "byte_offset"])
        close()

    return ranged.mapInArrow(write, f"slot long, `{id_column}` {kind}, part long, n_ids int, shard long, byte_offset long")


def read(path: str, start: int, count: int, *, length: int = 512, per_shard: int = 8192, dtype: str = "uint8") -> list[np.ndarray]:
    """Ids of the slots start .. start + count - 1, by seeking; a reader resumes with the next slot."""
    folder, stride, out = _local(path), 4 + length * np.dtype(dtype).itemsize, []
    slot, end = start, start + count
    while slot < end:
        shard, first = divmod(slot, per_shard)
        n = min(end - slot, per_shard - first)
        with open(os.path.join(folder, f"shard-{shard:08d}.bin"), "rb") as file:
            file.seek(first * stride)
            data = file.read(n * stride)
        for at in range(0, len(data), stride):
            size = int.from_bytes(data[at:at + 4], "little")
            out.append(np.frombuffer(data[at + 4:at + stride], dtype)[:size])
        if len(data) < n * stride:
            break
        slot += n
    return out
