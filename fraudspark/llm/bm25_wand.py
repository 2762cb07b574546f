"""Benchmark decontamination: passages of the corpus as queries against a BM25 index of test items.

Every passage (a window of words, overlapping so that no item falls between two) is looked up in an
inverted index of the items with block-max WAND, which returns all items whose score, as a share of
the item's score for its own text, is at least `least_score`. A hit counts when enough of both the
item's question and its answer is found in the passage as word triples. A side of one or two words has no
triples; it must stand as a whole next to where the other side is found, in the item's order. An item's
question ends at its first question mark, or else with two thirds of its words.

Before WAND, the impacts of a passage's rarer words are added up by item; a passage is skipped when, for every item,
they and all of the item's common words together stay under the threshold. No hit is lost by that.

Items are indexed in blocks of about `block_bytes` of text, each an index of its own that is sent to
all executors; word counts, mean length and passages are those of all items, so blocks do not change a hit.
Items longer than `ITEM_WORDS` words are indexed in parts of about equal length. Parts only find such an item: where
they are found, the stretches of the document that can hold the whole item are put together, and score, question and
answer are those of the whole item on them. Nulls and empty texts have no
passages and match nothing; items without words, or without an id, are left out. Repeated documents
and items are matched one by one, and a pair is reported once. Columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import as_bytes, hash_words, map_batches, signed

ITEM_WORDS, STEP = 192, 64
POSTING_BLOCK = 64
K1, B = 1.2, 0.75
#: Words by which a side of one or two words may be off the place that the other side gives it ("the answer is").
NEAR = 4
#: Marks count as gaps, so that punctuation does not hide a match.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> np.ndarray:
    return hash_words(as_bytes(text).lower().translate(_PLAIN).split())


def _runs(words: np.ndarray, n: int) -> list[int]:
    """Hashes of all runs of `n` words, by position."""
    count = max(0, len(words) - n + 1)
    return [hash(x) for x in zip(*(words[k:count + k].tolist() for k in range(n)))]


def _beside(text: np.ndarray, side: np.ndarray, other: np.ndarray, ahead: bool) -> bool:
    """Whether `side`, of one or two words, stands in `text` after (`ahead`: before) `other`, near the place that a run of `other` gives it."""
    size, n = len(side), min(3, len(other))
    count = max(0, len(text) - size + 1)
    spots = np.flatnonzero(np.all([text[k:count + k] == side[k] for k in range(size)], axis=0))
    if not n or not len(spots):
        return bool(len(spots))
    at: dict[int, list[int]] = {}
    for place, run in enumerate(_runs(other, n)):
        at.setdefault(run, []).append(place)
    for place, run in enumerate(_runs(text, n)):
        for own in at.get(run, ()):
            begin = place - own  # of the other side, as this run has it
            due = begin - size if ahead else begin + len(other)
            for spot in spots[(spots >= due - NEAR) & (spots <= due + NEAR)].tolist():
                apart = spot + size <= place if ahead else spot >= place + n
                if apart and not any(0 <= k - begin < len(other) and text[k] == other[k - begin] for k in range(spot, spot + size)):
                    return True
    return False


def _cut(words: np.ndarray) -> list[np.ndarray]:
    """Parts of about equal length, of at most `ITEM_WORDS` words; none without words."""
    return np.array_split(words, -(-len(words) // ITEM_WORDS)) if len(words) else []


class Counts:
    """Of all parts of all items: how many, their words, the longest, and in how many each word is."""

    def __init__(self, parts: int, words: int, longest: int, terms: np.ndarray, df: np.ndarray):
        self.parts, self.words, self.longest, self.terms, self.df = parts, words, longest, terms, df

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> Counts:
        lengths = [len(p) for p in parts]
        terms, df = np.unique(np.concatenate([np.empty(0, np.uint64), *map(np.unique, parts)]), return_counts=True)
        return cls(len(parts), sum(lengths), max(lengths, default=0), terms, df)


class ItemIndex:
    """Inverted index of items with impacts as shares of each part's own score; `counts` when there are other items besides."""

    def __init__(self, items: list[tuple], least_score: float, counts: Counts | None = None):
        self.least_score = least_score
        self.items, self.words, self.borders = [], [], []
        self.owners, self.starts, parts = [], [], []
        for item, text in items:
            words = words_of(text)
            mark = (text or "").find("?")
            at = 0
            for part in _cut(words):
                self.owners.append(len(self.items))
                self.starts.append(at)
                at += len(part)
                parts.append(part)
            self.items.append(item)
            self.words.append(words)
            self.borders.append(len(words_of(text[:mark + 1])) if mark >= 0 else (2 * len(words) + 2) // 3)
        n, self.lengths = len(parts), [len(p) for p in parts]
        counts = Counts.of(parts) if counts is None else counts
        self.window = counts.longest + STEP
        counted = [np.unique(p, return_counts=True) for p in parts]
        self.terms = np.unique(np.concatenate([np.empty(0, np.uint64), *(t for t, _ in counted)]))
        df = counts.df[np.searchsorted(counts.terms, self.terms)]
        idf = np.log(1 + (counts.parts - df + 0.5) / (df + 0.5))
        mean = counts.words / counts.parts if counts.parts else 1.0
        #: Of items in parts: words and their impacts as shares of the whole item's score.
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        raw: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        common = np.zeros(n)
        rare = np.zeros(len(self.terms), bool)
        impacts = []
        for i, (terms, tf) in enumerate(counted):
            at = np.searchsorted(self.terms, terms)
            impact = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.lengths[i] / mean))
            if len(self.words[self.owners[i]]) > ITEM_WORDS:
                raw.setdefault(self.owners[i], []).append((terms, impact))
            impact = impact / impact.sum()
            impacts.append((at, impact))
            for t, x in zip(at.tolist(), impact.tolist()):
                postings[t].append((i, x))
            by_df = np.argsort(df[at], kind="stable")
            rest = 1 - np.cumsum(impact[by_df])
            rare[at[by_df[:int(np.argmax(rest <= least_score / 4)) + 1]]] = True
        for i, (at, impact) in enumerate(impacts):
            common[i] = impact[~rare[at]].sum()
        for owner, found in raw.items():
            terms, where = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
            impact = np.bincount(where, np.concatenate([x for _, x in found]))
            self.whole[owner] = terms, impact / impact.sum()
        self.postings = [(np.array([i for i, _ in p], np.int32), np.array([x for _, x in p])) for p in postings]
        self.most = np.array([x.max() for _, x in self.postings]) if postings else np.zeros(0)
        #: What an item needs from its rarer words, and their postings one after another; common words have none.
        self.needed = least_score - common - 1e-9
        own = [self.postings[t] if rare[t] else (np.empty(0, np.int32), np.empty(0)) for t in range(len(postings))]
        self.rare_ends = np.append(0, np.cumsum([len(i) for i, _ in own])).astype(np.int64)
        self.rare_parts = np.concatenate([np.empty(0, np.int32), *(i for i, _ in own)]).astype(np.int64)
        self.rare_impacts = np.concatenate([np.empty(0), *(x for _, x in own)])
        self.block_most = [np.maximum.reduceat(x, np.arange(0, len(x), POSTING_BLOCK)) for _, x in self.postings]
        self.block_last = [i[np.append(np.arange(POSTING_BLOCK, len(i), POSTING_BLOCK) - 1, len(i) - 1)] for i, _ in self.postings]

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """Block-max WAND: all (part, score) whose score for the distinct `terms` reaches the threshold."""
        lists = [[0, int(t)] for t in terms.tolist()]  # place in the posting list, term
        found, limit = [], self.least_score - 1e-9
        heads = lambda c: self.postings[c[1]][0][c[0]]

        def move(cursor: list[int], to: int) -> None:
            ids = self.postings[cursor[1]][0]
            cursor[0] += int(np.searchsorted(ids[cursor[0]:], to))

        while lists:
            lists.sort(key=heads)
            total, pivot = 0.0, -1
            for k, cursor in enumerate(lists):
                total += self.most[cursor[1]]
                if total >= limit:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = int(heads(lists[pivot]))
            while pivot + 1 < len(lists) and heads(lists[pivot + 1]) == item:
                pivot += 1
            bound, end = 0.0, 1 << 60
            for cursor in lists[:pivot + 1]:
                block = int(np.searchsorted(self.block_last[cursor[1]], item))
                if block < len(self.block_last[cursor[1]]):
                    bound += self.block_most[cursor[1]][block]
                    end = min(end, int(self.block_last[cursor[1]][block]))
            if bound < limit:
                to = max(item + 1, end + 1) if pivot + 1 == len(lists) else max(item + 1, min(end + 1, int(heads(lists[pivot + 1]))))
                for cursor in lists[:pivot + 1]:
                    move(cursor, to)
            elif heads(lists[0]) == item:
                score = sum(self.postings[c[1]][1][c[0]] for c in lists[:pivot + 1])
                if score >= limit:
                    found.append((item, float(score)))
                for cursor in lists[:pivot + 1]:
                    cursor[0] += 1
            else:
                for cursor in lists[:pivot]:
                    move(cursor, item)
            lists = [c for c in lists if c[0] < len(self.postings[c[1]][0])]
        return found

    def passages(self, words: np.ndarray):
        """(start, end, distinct terms) of the passages that may reach the threshold."""
        if not len(words) or not len(self.terms):
            return
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        hit = self.terms[at] == words
        places = np.flatnonzero(hit & (self.rare_ends[at + 1] > self.rare_ends[at]))
        if not len(places):
            return
        count, size = len(range(0, max(1, len(words) - self.window + STEP), STEP)), len(self.terms)
        pairs = []  # of passage and term
        for back in range(-(-self.window // STEP)):
            passage = places // STEP - back
            inside = (passage >= 0) & (passage < count) & (passage * STEP + self.window > places)
            pairs.append(passage[inside] * size + at[places[inside]])
        pairs = np.unique(np.concatenate(pairs))
        first, times = self.rare_ends[pairs % size], self.rare_ends[pairs % size + 1] - self.rare_ends[pairs % size]
        entry = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        key, where = np.unique(np.repeat(pairs // size, times) * len(self.lengths) + self.rare_parts[entry], return_inverse=True)
        total = np.bincount(where, self.rare_impacts[entry], len(key))
        for k in np.unique(key[total >= self.needed[key % len(self.lengths)]] // len(self.lengths)).tolist():
            a, b = k * STEP, min(k * STEP + self.window, len(words))
            yield a, b, np.unique(at[a:b][hit[a:b]])

    def matches(self, text: str | None, least_overlap: float) -> dict:
        """Best hit by item: (score, question overlap, answer overlap, first word, end word of the passage)."""
        best: dict = {}
        stretches: dict[int, list[tuple[int, int]]] = {}
        words = words_of(text)

        def judge(owner: int, score: float, runs: list[tuple[int, int]], there: set[int]) -> None:
            own, border = self.words[owner], self.borders[owner]
            shares = _shares(own[:border], own[border:], [words[a:b] for a, b in runs], there)
            hit = (score, *shares, runs[0][0], runs[-1][1])
            if min(shares) >= least_overlap and hit > best.get(self.items[owner], (0,)):
                best[self.items[owner]] = hit

        for start, end, terms in self.passages(words):
            there = None
            for part, score in self.search(terms):
                owner, at = self.owners[part], self.starts[part]
                if owner in self.whole:
                    last = end - at - self.lengths[part] + len(self.words[owner])
                    stretches.setdefault(owner, []).append((max(0, start - at), min(len(words), last)))
                else:
                    there = set(_runs(words[start:end], 3)) if there is None else there
                    judge(owner, score, [(start, end)], there)
        for owner, found in stretches.items():
            runs: list[tuple[int, int]] = []
            for a, b in sorted(found):
                if runs and a <= runs[-1][1]:
                    runs[-1] = runs[-1][0], max(b, runs[-1][1])
                else:
                    runs.append((a, b))
            terms, impact = self.whole[owner]
            score = float(impact[np.isin(terms, np.concatenate([words[a:b] for a, b in runs]))].sum())
            if score >= self.least_score - 1e-9:
                judge(owner, score, runs, {x for a, b in runs for x in _runs(words[a:b], 3)})
        return best


def _shares(question: np.ndarray, answer: np.ndarray, texts: list[np.ndarray], there: set[int]) -> list[float]:
    """How much of question and answer is in `texts`, whose triples are `there`; an empty side has all."""
    out = []
    for side, other, ahead in ((question, answer, True), (answer, question, False)):
        if len(side) in (1, 2):
            out.append(float(any(_beside(text, side, other, ahead) for text in texts)))
        else:
            own = set(_runs(side, 3))
            out.append(len(own & there) / len(own) if own else 1.0)
    return out


def contaminated(docs: DataFrame, items: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                 item_column: str = "item_id", item_text_column: str = "text", least_score: float = 0.5,
                 least_overlap: float = 0.6, block_bytes: int = 8 << 20) -> DataFrame:
    """(id, item, score, question_overlap, answer_overlap, first_word, end_word) of every document and item that match."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_column].dataType.simpleString(), items.schema[item_column].dataType.simpleString()
    items = items.select(F.col(item_column).alias("item"), F.col(item_text_column).alias("text")).filter("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    schema = (f"`{id_column}` {kind}, `{item_column}` {item_kind}, score double, question_overlap double, answer_overlap double, "
              "first_word long, end_word long")
    found, counts = None, _counts(items) if blocks > 1 else None
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else items
        index = spark.sparkContext.broadcast(ItemIndex(sorted(map(tuple, own.collect()), key=str), least_score, counts))

        def make(index=index):
            def work(part: pa.RecordBatch) -> pa.RecordBatch:
                out: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    out += [(doc, item, *hit) for item, hit in index.value.matches(text, least_overlap).items()]
                columns = list(zip(*out)) if out else [()] * 7
                kinds = [part.column(0).type, _arrow(item_kind), *[pa.float64()] * 3, *[pa.int64()] * 2]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                  names=[id_column, item_column, *schema_names])

            return work

        schema_names = ["score", "question_overlap", "answer_overlap", "first_word", "end_word"]
        hits = map_batches(docs.select(id_column, text_column), make, schema)
        found = hits if found is None else found.unionByName(hits)
    return found


def _counts(items: DataFrame) -> Counts:
    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            own = Counts.of([p for text in part.column(0).to_pylist() for p in _cut(words_of(text))])
            return pa.RecordBatch.from_arrays([
                pa.array([None, *signed(own.terms).tolist()], pa.int64()), pa.array([own.parts, *own.df.tolist()], pa.int64()),
                pa.array([own.words] + [0] * len(own.df), pa.int64()), pa.array([own.longest] + [0] * len(own.df), pa.int64()),
            ], names=["term", "parts", "words", "longest"])

        return work

    made = map_batches(items.select("text"), make, "term long, parts long, words long, longest long").groupBy("term").agg(
        F.sum("parts").alias("parts"), F.sum("words").alias("words"), F.max("longest").alias("longest"))
    whole = made.filter("term is null").first()
    each = made.filter("term is not null").select("term", "parts").toArrow()
    terms, df = each["term"].to_numpy().astype(np.int64).view(np.uint64), each["parts"].to_numpy().astype(np.int64)
    order = np.argsort(terms)
    return Counts(whole["parts"], whole["words"], whole["longest"], terms[order], df[order])


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
