"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are hashes of its words, word pairs, word shapes (letter case, digits, marks) and
runs of equal neighbours, each weighted by the root of its share of the text. The score of a text is
the logistic value of the sparse dot product of its features with the weights.

Training uses a bounded sample: at most `sample` labelled rows, those of smallest id hash; their
features alone reach the driver. Scoring reads every whole text. Nulls and empty texts have only the
bias feature; their score is that of the bias. Without labelled rows every score is 0.5. Repeated
rows are scored one by one; columns other than id and text are not read, and of the label table
only its id and label columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import as_bytes, hash_words, map_batches, mix

BITS = 18
SIZE = 1 << BITS
_SHAPES = bytes(
    120 if 97 <= c <= 122 else 88 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else 117 if c >= 128 else c for c in range(256))


def features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashed indices, weights) of a text given as UTF-8."""
    words = data.lower().split()
    if not words:
        return np.zeros(1, np.int32), np.ones(1, np.float32)
    hashed = hash_words(words)
    shapes = hash_words([w[:2] + w[-3:] for w in data.translate(_SHAPES).split()])
    same = np.flatnonzero(hashed[1:] == hashed[:-1])
    shift = np.uint64(64 - BITS)
    with np.errstate(over="ignore"):
        parts = [
            mix(hashed), mix(mix(hashed[:-1]) + hashed[1:]), mix(shapes + np.uint64(7)),
            mix(mix(shapes[:-1] + np.uint64(11)) + shapes[1:]), np.full(len(same), mix(np.array([13], np.uint64))[0]),
        ]
    index, counts = np.unique((np.concatenate(parts) >> shift).astype(np.int32), return_counts=True)
    weights = np.sqrt(counts / counts.sum(), dtype=np.float64).astype(np.float32)
    return np.append(index, 0).astype(np.int32), np.append(weights, 1).astype(np.float32)


class Leader:
    """Follow-the-regularised-leader with per-weight rates, an L1 and an L2 term."""

    def __init__(self, rate: float = 0.5, smooth: float = 1.0, l1: float = 1e-4, l2: float = 1e-4):
        self.rate, self.smooth, self.l1, self.l2 = rate, smooth, l1, l2
        self.z, self.n = np.zeros(SIZE), np.zeros(SIZE)

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        active = np.abs(z) > self.l1
        return np.where(active, -(z - np.sign(z) * self.l1) / ((self.smooth + np.sqrt(n)) / self.rate + self.l2), 0.0)

    def update(self, index: np.ndarray, values: np.ndarray, label: int, weight: float = 1.0) -> None:
        z, n = self.z[index], self.n[index]
        w = self._weights(z, n)
        grad = weight * (_logistic(float(w @ values)) - label) * values
        step = (np.sqrt(n + grad * grad) - np.sqrt(n)) / self.rate
        self.z[index] = z + grad - step * w
        self.n[index] = n + grad * grad

    def weights(self) -> np.ndarray:
        return self._weights(self.z, self.n).astype(np.float32)


def _logistic(x: float) -> float:
    return 1 / (1 + np.exp(-min(max(x, -40.0), 40.0)))


def train(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
          label_column: str = "quality", sample: int = 12_000, passes: int = 3) -> np.ndarray:
    """Weights learned from the rows of `docs` that `labels` marks 0 or 1.

    At most `sample` labels are used, those of smallest id hash. Both labels get half of the total weight.
    """
    marked = (
        labels.select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1)).groupBy("_id").agg(F.max("_y").alias("_y"))
        .withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(sample)
    )
    # At most `sample` ids and labels, so a broadcast of known size.
    chosen = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_t")).join(F.broadcast(marked), "_id")

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            made = [features(as_bytes(t)) for t in part.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array([i.tobytes() for i, _ in made], pa.binary()),
                pa.array([v.astype(np.float16).tobytes() for _, v in made], pa.binary()),
            ], names=["h", "y", "i", "v"])

        return work

    rows = map_batches(chosen.select("_h", "_y", "_t"), make, "h long, y int, i binary, v binary").toArrow()
    order = sorted(range(rows.num_rows), key=lambda k: (rows["h"][k].as_py(), rows["i"][k].as_py()))
    ys = rows["y"].to_numpy()
    positive = int((ys == 1).sum()) if len(ys) else 0
    share = {0: len(ys) / 2 / max(1, len(ys) - positive), 1: len(ys) / 2 / max(1, positive)}
    leader = Leader()
    for _ in range(passes):
        for k in order:
            index = np.frombuffer(rows["i"][k].as_buffer(), np.int32)
            values = np.frombuffer(rows["v"][k].as_buffer(), np.float16).astype(np.float64)
            leader.update(index, values, int(ys[k]), share[int(ys[k])])
    return leader.weights()


def score(docs: DataFrame, weights: np.ndarray, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score): the chance that a whole text is of good quality."""
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # SIZE numbers

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            made = np.empty(part.num_rows)
            for k, text in enumerate(part.column(1).to_pylist()):
                index, values = features(as_bytes(text))
                made[k] = _logistic(float(shared.value[index] @ values))
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(made)], names=[id_column, "score"])

        return work

    return map_batches(docs.select(id_column, text_column), make, f"`{id_column}` {kind}, score double")


def keep(docs: DataFrame, weights: np.ndarray, least: float, *, text_column: str = "text") -> DataFrame:
    """The rows of `docs` with a score of `least` or more."""
    at = docs.columns.index(text_column)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            scores = [features(as_bytes(t)) for t in part.column(at).to_pylist()]
            return part.filter(pa.array([_logistic(float(shared.value[i] @ v)) >= least for i, v in scores], pa.bool_()))

        return work

    return map_batches(docs, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
