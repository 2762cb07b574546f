"""What the operators share: batches of bounded size, words as hashes, and sums on the driver side."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whitespace of the word rule `[^\x20\x09-\x0D]+`; `bytes.split()` splits at exactly these.
GAPS = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 8 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def slices(batch: pa.RecordBatch, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of `batch` whose rows hold about `limit` bytes; a longer row is a part of its own."""
    rows = batch.num_rows
    if not rows:
        return
    each = max(1, int(rows * limit / max(limit, batch.nbytes)))
    for start in range(0, rows, each):
        yield batch.slice(start, each)


def gathered(batches: Iterable[pa.RecordBatch], limit: int = BATCH_BYTES, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """The rows of a task in parts of about `limit` bytes and at most `rows` rows; a longer row is a part of its own."""
    held, size, count = [], 0, 0
    for batch in batches:
        for part in slices(batch, limit):
            if held and (size + part.nbytes > limit or count + part.num_rows > rows):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, count = [], 0, 0
            held.append(part)
            size, count = size + part.nbytes, count + part.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch]],
                schema: str) -> DataFrame:
    """Run `make()` once per task and its result on every part of the task's rows."""

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch):
                made = work(part)
                yield from ([made] if isinstance(made, pa.RecordBatch) else made)

    return df.mapInArrow(run, schema)


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (values ^ (values >> np.uint64(31))) * _MIX
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def word_grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of `n` words, by position; none when there are fewer words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = words[:count].copy()
    for k in range(1, n):
        out = mix(out) + words[k:k + count]
    return mix(out)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def held_out(id_column: str, folds: int, fold: int):
    """Rows whose crc32 of the id as text leaves `fold`; a row without an id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds == fold
