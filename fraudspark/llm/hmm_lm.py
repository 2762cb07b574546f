"""Language-model scoring with a hidden Markov model over word classes.

A word's class is its hash modulo `CLASSES`; the end of a text is a class of its own. Latent states emit
classes, and a class gives its words by their add-one counts in the training texts. Transitions, starts
and class emissions are trained by Baum-Welch: each task sums expected counts over its texts, the sums
are added up by Spark, and only the model (fixed in size) reaches the driver. Training sequences are
texts cut every `CUT` tokens; the score of a text is the scaled forward recursion over the whole text.

Word counts are taken over all training texts and joined back by word, once for each batch of
texts, so no vocabulary is held in one place. The places of the words stay in one row per batch.

Nulls and empty texts have the one end token. Repeated rows are scored one by one and count each.
Without training texts all counts are 0 and the states keep their starting values. An empty table gives an
empty table. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import as_bytes, gathered, hash_words, signed, slices
from fraudspark.session import cut_lineage

STATES, CLASSES, CUT = 4, 4096, 64
END = CLASSES


class Chain:
    """Start, transition and class-emission chances of the latent states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # (K), (K, K), (CLASSES + 1, K)

    @classmethod
    def initial(cls, seed: int = 11) -> Chain:
        """Slow changes of state, and emissions that differ by chance so that training can tell states apart."""
        draw = np.random.default_rng(seed)
        emit = draw.uniform(0.5, 1.5, (CLASSES + 1, STATES))
        move = np.full((STATES, STATES), 0.05 / max(1, STATES - 1))
        np.fill_diagonal(move, 0.95)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Chain:
        start, move, emit = start + 0.1, move + 0.1, emit + 0.01
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def log10_chances(self, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Forward recursion over whole sequences, scaled at each token; `classes` has them one after another."""
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order]
        first = (np.cumsum(lengths) - lengths)[order]
        out, n = np.zeros(len(lengths)), len(lengths)
        alpha = np.empty((n, STATES))
        active = n - np.searchsorted(size[::-1], np.arange(1, size[0] + 1) if n else [], "left")
        for t, k in enumerate(active.tolist()):
            emitted = self.emit[classes[first[:k] + t]]
            now = emitted * (alpha[:k] @ self.move if t else self.start)
            total = now.sum(axis=1)
            out[:k] += np.log10(total)
            alpha[:k] = now / total[:, None]
        result = np.empty(n)
        result[order] = out
        return result

    def expected(self, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts over sequences cut every CUT tokens."""
        pieces = -(-lengths // CUT)
        first = np.repeat(np.cumsum(lengths) - lengths, pieces) + CUT * (
            np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.minimum(CUT, np.repeat(np.cumsum(lengths), pieces) - first)
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        n = len(size)
        active = n - np.searchsorted(size[::-1], np.arange(1, CUT + 1), "left")
        alpha, scale, held = [], [], []
        for t in range(CUT):
            k = int(active[t])
            if not k:
                break
            seen = classes[first[:k] + t]
            now = self.emit[seen] * (alpha[-1][:k] @ self.move if t else self.start)
            total = now.sum(axis=1, keepdims=True)
            alpha.append(now / total)
            scale.append(total)
            held.append(seen)
        start, move = np.zeros(STATES), np.zeros((STATES, STATES))
        shares: list[np.ndarray] = [np.empty(0)] * len(alpha)
        beta = np.ones((0, STATES))
        for t in range(len(alpha) - 1, -1, -1):
            k = len(alpha[t])
            here = np.ones((k, STATES))
            if len(beta):
                ahead = self.emit[held[t + 1]] * beta / scale[t + 1]
                move += (alpha[t][:len(beta)].T @ ahead) * self.move
                here[:len(beta)] = ahead @ self.move.T
            shares[t], beta = alpha[t] * here, here
        if alpha:
            start += shares[0].sum(axis=0)
        flat = np.concatenate(held) if held else np.empty(0, np.int64)
        gamma = np.concatenate(shares) if shares else np.empty((0, STATES))
        emit = np.stack([np.bincount(flat, gamma[:, s], CLASSES + 1) for s in range(STATES)], axis=1)
        return start, move, emit


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts one after another, words per text)."""
    words, lengths = [], np.empty(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = as_bytes(text).lower().split()
        lengths[k] = len(own)
        words += own
    return hash_words(words), lengths


def with_ends(hashed: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the tokens, with the end after each text."""
    classes = (hashed % np.uint64(CLASSES)).astype(np.int64)
    return np.insert(classes, np.cumsum(lengths), END), lengths + 1


def train(docs: DataFrame, held: Column, *, text_column: str = "text", rounds: int = 3) -> Chain:
    """Baum-Welch over the whole texts of the rows that are not held out."""
    texts = docs.filter(~held).select(text_column)
    chain = Chain.initial()
    for _ in range(rounds):
        now = chain

        def sums(batches, now=now):
            start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES + 1, STATES))
            for batch in batches:
                for part in slices(batch, 4 << 20):
                    more = now.expected(*with_ends(*tokens(part.column(0).to_pylist())))
                    start, move, emit = start + more[0], move + more[1], emit + more[2]
            flat = np.concatenate([start, move.ravel(), emit.ravel()])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at])], names=["at", "count"])

        rows = texts.mapInArrow(sums, "at long, count double").groupBy("at").agg(F.sum("count").alias("count")).toPandas()
        flat = np.zeros(STATES + STATES ** 2 + (CLASSES + 1) * STATES)
        flat[rows["at"].to_numpy()] = rows["count"].to_numpy()
        chain = Chain.from_counts(flat[:STATES], flat[STATES:STATES + STATES ** 2].reshape(STATES, STATES),
                                  flat[STATES + STATES ** 2:].reshape(CLASSES + 1, STATES))
    return chain


def _postings(docs: DataFrame, chain: Chain, kind: str) -> DataFrame:
    """Per batch of texts: a row for each word with its number `at`, and one row with the texts and the places of all words."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        for part in gathered(batches, 6 << 20):
            hashed, lengths = tokens(part.column(2).to_pylist())
            out = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            chances = chain.log10_chances(*with_ends(hashed, lengths))
            words, place = np.unique(hashed, return_inverse=True)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            pairs, counts = np.unique(place * len(lengths) + owner, return_counts=True)
            word, doc = pairs // max(1, len(lengths)), pairs % max(1, len(lengths))
            learned = np.bincount(word, counts * ~out[doc], len(words)).astype(np.int64)
            # Two bytes each for place and count; a larger count takes several entries.
            times = -(-counts // 65535)
            last = np.cumsum(times) - 1
            word, doc = np.repeat(word, times), np.repeat(doc, times)
            packed = np.stack([doc, np.full(len(doc), 65535)], axis=1).astype(np.uint16)
            packed[last, 1] = counts - 65535 * (times - 1)
            each = np.bincount(word, minlength=len(words)).astype(np.uint32)
            n, key = len(words), task << 20 | number
            number += 1
            none = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array(signed(words)), pa.array(np.full(n, key)), pa.array(np.arange(n, dtype=np.int32)), pa.array(learned),
                none, none, none, pa.nulls(n, pa.list_(part.column(0).type)),
            ], names=names)
            about = np.stack([lengths + 1, out.astype(np.int64), chances.view(np.int64)])
            yield pa.RecordBatch.from_arrays([
                pa.nulls(1, pa.int64()), pa.array([key]), pa.nulls(1, pa.int32()), pa.array([int((~out).sum())]),
                *[pa.array([x.tobytes()], pa.binary()) for x in (about, each, packed)],
                pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), part.column(0)),
            ], names=names)

    names = ["h", "batch", "at", "n", "about", "each", "posts", "ids"]
    return docs.mapInArrow(run, f"h long, batch long, at int, n long, about binary, each binary, posts binary, ids array<{kind}>")


def score(docs: DataFrame, held: Column, chain: Chain, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    `base_score` is the add-one word model and `score` the hidden Markov model, both as log10 of the chance of the text.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), held.alias("out"), F.col(text_column).alias("text"))
    posts = cut_lineage(_postings(rows, chain, kind), "postings")
    counts = cut_lineage(posts.filter("h is not null").groupBy("h").agg(F.sum("n").alias("c")), "counts")
    ends = posts.filter("h is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    total, distinct = size[0] + ends, size[1] + (1 if ends else 0)
    # Unsigned remainder of the hash, as the classes have it.
    high, low = F.shiftrightunsigned("h", 32), F.col("h").bitwiseAND(0xFFFFFFFF)
    word_class = F.pmod(F.pmod(high, F.lit(CLASSES)) * ((1 << 32) % CLASSES) + F.pmod(low, F.lit(CLASSES)), F.lit(CLASSES))
    sized = counts.groupBy(word_class.cast("int").alias("class")).agg(F.sum("c").alias("c"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).collect()
    norms = np.zeros(CLASSES)
    for r in sized:  # one row for each class at most
        norms[r["class"]] = np.log10(r["c"] + r["v"] + 1)
    least = float(np.log10(total + distinct + 1))

    # Count and class in one number: the shuffle by batch needs no hashes, which do not compress.
    known = (F.col("c") * (2 * CLASSES) + word_class).alias("known")
    joined = posts.filter("h is not null").join(counts, "h").select("batch", "at", known).unionByName(
        posts.filter("h is null").drop("h", "n"), allowMissingColumns=True)

    def add_up(table: pa.Table) -> pa.Table:
        marks = table["at"].is_null().combine_chunks()
        head = table.filter(marks).slice(0, 1)
        ids = head["ids"][0].values
        about, times, pairs = (np.frombuffer(head[k][0].as_buffer(), kind) for k, kind in (
            ("about", np.int64), ("each", np.uint32), ("posts", np.uint16)))
        about, pairs = about.reshape(3, -1), pairs.reshape(-1, 2)
        n = about.shape[1]
        words = table.select(["at", "known"]).filter(pc.invert(marks))
        known, logs, inner = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        if words.num_rows:
            doc, tf = pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.float64)
            met = np.empty(len(times), np.int64)
            met[words["at"].to_numpy()] = words["known"].to_numpy()
            c, classes = np.divmod(met, 2 * CLASSES)
            one = np.log10(c + 1.0)
            logs = np.bincount(doc, tf * np.repeat(one, times), n)
            inner = np.bincount(doc, tf * np.repeat(one - norms[classes], times), n)
            known = np.bincount(doc, tf * np.repeat(c > 0, times), n).round().astype(np.int64)
        lengths, out, chances = about[0], about[1].astype(bool), about[2].view(np.float64)
        return pa.table({
            "id": ids, "held_out": pa.array(out), "n_tokens": pa.array(lengths), "n_known": pa.array(known + ends_known),
            "train_tokens": pa.array(np.full(n, total, np.int64)),
            "base_score": pa.array(logs + np.log10(ends_count + 1.0) - lengths * least), "score": pa.array(chances + inner),
        })

    ends_count, ends_known = int(ends), int(ends > 0)
    total = int(total)
    made = joined.groupBy("batch").applyInArrow(
        add_up, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return made.withColumnRenamed("id", id_column)
