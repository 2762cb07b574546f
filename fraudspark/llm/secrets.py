"""Secret scan: base patterns, and a linear-chain conditional random field that adds spans.

Base kinds are fixed patterns. The field tags the pieces (runs of letters, runs of digits, single
marks) of a whole text as begin, inside or outside of a secret, from shapes, neighbouring words and
file features, and is decoded by Viterbi over all pieces of the text. What depends on a word alone is worked
out once per word. Words that no best path can tag as part of a secret, by an upper bound of what any stretch
through them could gain, are outside without being decoded; the tags are those of the whole chain (`Scorer`).

The field learns from the base spans of a bounded sample: of texts with and of texts without a sign of a
base span, `texts` different ones of smallest hash. They are cut into windows of at most `longest` pieces, not
within a span that fits. Of windows with and of windows without a span, `sample` / 2 at most are used, those of
smallest hash of text and tags, each different window once. Texts with spans are also learned with made secrets of other
alphabets and lengths in place of their own (`varied`). So that the field finds what the patterns miss, windows with
spans are learned in four views: whole, without the context of their secrets, without the form of them, and by their length and number of pieces alone; long words
of mixed letters and digits outside base spans are left unlabelled, and their tags are summed over. A fifth of the
windows is held out: the cost of opening a span is the least one at which no held-out window without a
span gets one, and `MARGIN` more. Spans of fewer than `least` characters are not added. Scanning reads every text.

Nulls are read as empty texts, which have no spans. Repeated rows are scanned one by one. An empty
table, one without any word, or one with or without spans in every window gives a field that adds nothing. Other columns are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import map_batches
from fraudspark.session import cut_lineage

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: The longest run from its first place, as one pattern with its least length.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
_HEX_MARKS = bytes(104 if chr(c) in "0123456789abcdef" else 46 for c in range(256))

#: What every text with a base span contains.
SIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]|[0-9a-f]{24}"
NOT_HEX = re.compile(r"[^\W_0-9a-f]")
PIECE = re.compile(r"[A-Za-z]+|[0-9]+|[^\s]")
BEGIN, INSIDE, OUTSIDE, UNKNOWN = 0, 1, 2, 3
#: A word that may be a secret although no pattern says so: long, of letters and digits, no address.
DOUBT = re.compile(r"(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}")
WIDTH = 1 << 12
FEATURES = 16
DROPPED = WIDTH  # a feature without weight
#: By view: the features left out of the pieces of secrets (nothing; context; own form; context and letters used).
VIEWS = [], [2, 3, 10, 11, 12, 13, 14], [0, 1, 4, 5, 6, 7, 8, 9, 15], [1, 2, 3, 5, 6, 9, 10, 11, 12, 13, 14]
LEAST_ADDED = 8
HELD_OUT, COSTS, MARGIN = 5, [0.5 * k for k in range(41)], 1.0
WIDE = 16
GROUP = 1 << 20


def _base(text: str) -> list[tuple[int, int, str, int]]:
    """base_spans() with the place where the whole match starts: for an assignment, its key word."""
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(*m.span(2), "assign", m.start()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access", m.start()) for m in ACCESS.finditer(text)]
    if b"h" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX_MARKS):
        found += [(*m.span(), "hex", m.start()) for m in HEX.finditer(text)]
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points; an assignment's span is its value, group 2."""
    return [s[:3] for s in _base(text)]


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def segments(text: str) -> Iterator[list[tuple[int, int]]]:
    """Piece borders of the one chain of a text; none without words."""
    borders = [m.span() for m in PIECE.finditer(text)]
    if borders:
        yield borders


def _shape(piece: str) -> str:
    kind = "9" if piece.isdigit() else "a" if piece.islower() else "A" if piece.isupper() else "m" if piece.isalpha() else piece
    return f"{kind}{min(len(piece), 20).bit_length()}"


def _text_shape(text: str) -> tuple[str, str]:
    """File features: whether a key word occurs, and how dense digits are."""
    low = text.lower()
    words = "k" if any(word in low for word in ASSIGN_WORDS) else "-"
    digits = sum(map(text.count, "0123456789"))
    return words, str(int(np.log2(1 + 1000 * digits / max(1, len(text)))))


_SIZES = [str(n.bit_length()) for n in range(21)]


def _name(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % WIDTH


class Words:
    """What a word alone gives: its pieces' features, and those it gives to its neighbours."""

    KEPT, LONGEST = 1 << 15, 64
    P, N, W, B, B2, A, F, D = 2, 3, 5, 10, 11, 12, 13, 14
    #: By file features, and at the ends of a text.
    START, END = [_name(x) for x in ("p^", "n$", "b^", "b2^", "a^")], [_name(x) for x in ("p^", "n$", "b$", "b2$", "a$")]

    def __init__(self):
        self.known: dict[str, tuple[np.ndarray, tuple]] = {}
        self.shapes: dict[tuple, tuple[np.ndarray, int, int]] = {}

    def of(self, word: str) -> tuple[np.ndarray, tuple]:
        """(features of its pieces, names as (previous, next, left, left of left, right) of another word)."""
        low = word.lower()
        whole = xxhash.xxh3_64_intdigest(low[:12])
        if word.isalpha() and word.isascii():  # one piece, as most words are
            size = len(word)
            key = (min(size, 63) // 4, max(low) <= "f", ("a" if word == low else "A" if word.isupper() else "m") + _SIZES[min(size, 20)])
            rows, last, first = self.shapes.get(key) or self.of_shape(key)
            rows = rows.copy()
            rows[0, self.W] = (whole if size <= 8 else xxhash.xxh3_64_intdigest(low[:8])) >> 36 & WIDTH - 1
        else:
            pieces = PIECE.findall(word)
            key = (min(len(word), 63) // 4, NOT_HEX.search(low) is None, *map(_shape, pieces))
            rows, last, first = self.shapes.get(key) or self.of_shape(key)
            rows = rows.copy()
            rows[:, self.W] = [xxhash.xxh3_64_intdigest(p.lower()[:8]) >> 36 & WIDTH - 1 for p in pieces]
        made = rows, (last, first, whole & WIDTH - 1, whole >> 12 & WIDTH - 1, whole >> 24 & WIDTH - 1)
        if len(word) <= self.LONGEST:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            self.known[word] = made
        return made

    def of_shape(self, key: tuple) -> tuple[np.ndarray, int, int]:
        """What words of one size and shape have in common: features, and the names of the last and the first shape."""
        size, is_hex, *shapes = key
        last = len(shapes) - 1
        about = [_name("k" + "".join(sorted({s[0] for s in shapes}))), _name(f"l{size}"), _name(f"c{min(last, 15)}"),
                 _name(f"h{'x' if is_hex else 'n'}{size}")]
        rows = [[
            _name("bias"), _name("s" + shape), _name("p" + shapes[k - 1]) if k else 0, _name("n" + shapes[k + 1]) if k < last else 0,
            _name(f"g{k > 0}{k < last}"), 0, *about, 0, 0, 0, 0, 0, _name(f"i{min(k, 8)}{k > 0}"),
        ] for k, shape in enumerate(shapes)]
        made = np.array(rows, np.int16), _name("p" + shapes[-1]), _name("n" + shapes[0])
        if len(shapes) <= 8:
            if len(self.shapes) >= self.KEPT:
                self.shapes.clear()
            self.shapes[key] = made
        return made

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(FEATURES hashed features of every piece of the texts one after another, pieces by text)."""
        local: dict[str, int] = {}
        split = [text.split() for text in texts]
        ids = np.fromiter((local.setdefault(w, len(local)) for words in split for w in words), np.int64)
        counts = np.array([len(words) for words in split], np.int64)
        if not len(ids):
            return np.empty((0, FEATURES), np.int16), counts
        found = [self.known.get(w) or self.of(w) for w in local]
        near = np.array([*(n for _, n in found), self.START, self.END], np.int16)
        start, end = len(found), len(found) + 1
        sizes = np.array([len(m) for m, _ in found], np.int64)
        offsets = np.cumsum(sizes) - sizes
        n = sizes[ids]
        ends = np.cumsum(n)
        out = np.concatenate([m for m, _ in found])[np.repeat(offsets[ids] - (ends - n), n) + np.arange(ends[-1])]
        own = counts[counts > 0]
        heads = np.cumsum(own) - own
        left, right = np.append(start, ids[:-1]), np.append(ids[1:], end)
        left[heads], right[heads + own - 1] = start, end
        left2 = np.append(start, left[:-1])
        left2[heads] = start
        out[ends - n, self.P] = near[left, 0]
        out[ends - 1, self.N] = near[right, 1]
        for column, value in ((self.B, near[left, 2]), (self.B2, near[left2, 3]), (self.A, near[right, 4])):
            out[:, column] = np.repeat(value, n)
        text_ends = np.append(0, ends)[np.cumsum(counts)]
        pieces = np.diff(text_ends, prepend=0)
        files = np.array([[_name("f" + a), _name("d" + b)] for a, b in map(_text_shape, texts)], np.int16)
        out[:, self.F:self.D + 1] = np.repeat(files, pieces, axis=0)
        return out, pieces


def features(text: str, borders: list[tuple[int, int]], file: tuple[str, str]) -> np.ndarray:
    """FEATURES hashed features of every piece of a chain."""
    rows = Words().rows([text[borders[0][0]:borders[-1][1]]])[0]
    rows[:, Words.F], rows[:, Words.D] = _name("f" + file[0]), _name("d" + file[1])
    return rows


def labels(borders: list[tuple[int, int]], spans: list[tuple[int, int, str]]) -> np.ndarray:
    tags = np.full(len(borders), OUTSIDE, np.int8)
    if spans:
        starts, ends = np.array(borders, np.int64).T
        for start, end, _ in spans:
            first, stop = np.searchsorted(ends, start, side="right"), np.searchsorted(starts, end)
            tags[first:stop] = INSIDE
            tags[first:min(first + 1, stop)] = BEGIN
    return tags


def doubtful(text: str, borders: list[tuple[int, int]], tags: np.ndarray) -> np.ndarray:
    """`tags` with UNKNOWN for the pieces outside spans that are part of a doubtful word."""
    words = [(*m.span(), "") for m in DOUBT.finditer(text)]
    return np.where((tags == OUTSIDE) & (labels(borders, words) != OUTSIDE), np.int8(UNKNOWN), tags) if words else tags


class Field:
    """Weights of a linear-chain conditional random field with three tags."""

    def __init__(self, emit: np.ndarray | None = None, step: np.ndarray | None = None):
        self.emit = np.zeros((WIDTH, 3)) if emit is None else emit
        self.step = np.zeros((4, 3)) if step is None else step  # the last row: from the start

    def decode(self, rows: np.ndarray) -> np.ndarray:
        """Viterbi: the tags of highest total score; the tag with the smaller number on ties."""
        score = self.emit[rows].sum(axis=1)
        inside_first = np.array([0.0, -np.inf, 0.0])
        best = score[0] + self.step[3] + inside_first
        step = self.step[:3].copy()
        step[OUTSIDE, INSIDE] = -np.inf
        back = np.empty((len(rows), 3), np.int8)
        for t in range(1, len(rows)):
            paths = best[:, None] + step
            back[t] = paths.argmax(axis=0)
            best = paths.max(axis=0) + score[t]
        tags = np.empty(len(rows), np.int8)
        tags[-1] = best.argmax()
        for t in range(len(rows) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags

    def decode_all(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """decode() of chains one after another: side by side while `WIDE` or more go on, then each by itself."""
        score = np.zeros((len(rows), 3))
        for k in range(FEATURES):
            score += self.emit[rows[:, k]]
        return self.best_paths(score, sizes[sizes > 0], self.step[3] + [0.0, -np.inf, 0.0], np.zeros(3))

    def best_paths(self, score: np.ndarray, sizes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tags of chains of `sizes` pieces; `start` and `end` are added at the ends of all chains or, as rows, of each."""
        step = self.step[:3].copy()
        step[OUTSIDE, INSIDE] = -np.inf
        sizes = sizes.astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        first, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        start, end = (np.broadcast_to(x, (len(sizes), 3))[order] for x in (start, end))
        back, tags = np.zeros((len(score), 3), np.int8), np.zeros(len(score), np.int8)
        if not len(first):
            return tags
        best = score[first] + start
        going = np.searchsorted(-sizes, -np.arange(sizes[0] + 1), side="left")  # chains of more than t pieces
        t = 1
        while t < sizes[0] and going[t] >= WIDE:
            n = going[t]
            paths = best[:n, :, None] + step
            back[first[:n] + t] = paths.argmax(axis=1)
            best[:n] = paths.max(axis=1) + score[first[:n] + t]
            t += 1
        (bb, bi, bo), (ib, ii, io), (ob, _, oo) = step.tolist()
        for chain in range(going[t] if t < sizes[0] else 0):
            b, i, o = best[chain].tolist()
            at, kept = first[chain], []
            for sb, si, so in score[at + t:at + sizes[chain]].tolist():
                x, y, z = b + bb, i + ib, o + ob
                kb, top_b = (0, x) if x >= y and x >= z else (1, y) if y >= z else (2, z)
                x, y = b + bi, i + ii
                ki, top_i = (0, x) if x >= y else (1, y)
                x, y, z = b + bo, i + io, o + oo
                ko, top_o = (0, x) if x >= y and x >= z else (1, y) if y >= z else (2, z)
                b, i, o = top_b + sb, top_i + si, top_o + so
                kept.append((kb, ki, ko))
            best[chain] = b, i, o
            tag = int((best[chain] + end[chain]).argmax())
            own = [tag]
            for k in reversed(kept):
                tag = k[tag]
                own.append(tag)
            tags[at + t - 1:at + sizes[chain]] = own[::-1]
        lasts = sizes <= t
        tags[(first + sizes - 1)[lasts]] = (best + end)[lasts].argmax(axis=1)
        for k in range(t - 1, 0, -1):
            at = first[:going[k]] + k
            tags[at - 1] = back[at, tags[at]]
        return tags

    def fit(self, chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = 80, rate: float = 0.3, ridge: float = 1e-3,
            weights: np.ndarray | None = None) -> Field:
        """Likelihood ascent with per-weight step sizes; forward and backward sums over all chains at once.

        Pieces tagged UNKNOWN may have any tag: the likelihood is that of the other tags.
        """
        if not chains:
            return self
        weights = np.ones(len(chains)) if weights is None else weights
        n, longest = len(chains), max(len(tags) for _, tags in chains)
        idx = np.full((n, longest, FEATURES), DROPPED, np.int32)
        gold = np.full((n, longest), -1, np.int64)
        for i, (rows, tags) in enumerate(chains):
            idx[i, :len(tags)], gold[i, :len(tags)] = rows, tags
        real, open_ = gold >= 0, (gold == UNKNOWN).any(axis=1)
        told = real & (gold != UNKNOWN)
        truth = np.zeros((n, longest, 3))
        truth[told, gold[told]] = 1
        barred = np.where(told[open_][:, :, None] & (truth[open_] == 0), -1e6, 0.0)
        pairs = truth[:, :-1, :, None] * truth[:, 1:, None, :]
        seen_emit, seen_step = np.full(self.emit.shape, 1e-6), np.full(self.step.shape, 1e-6)
        cells = idx[real]
        flat, by_feature, score = cells.ravel(), np.ascontiguousarray(cells.T), np.zeros((n, longest, 3))
        for _ in range(rounds):
            table, summed = np.vstack([self.emit, np.zeros(3)]), np.zeros((len(cells), 3))
            for column in by_feature:
                summed += table[column]
            score[real] = summed
            share, both = self._expected(score, real)
            if open_.any():
                truth[open_], pairs[open_] = self._expected(score[open_] + barred, real[open_])
            gap = ((truth - share) * weights[:, None, None])[real] / n
            grad = np.stack([np.bincount(flat, np.repeat(gap[:, y], FEATURES), WIDTH + 1)[:WIDTH] for y in range(3)], axis=1) - ridge * self.emit
            steps = np.tensordot(weights, (pairs - both).sum(1), 1)
            grad_step = np.vstack([steps, weights @ (truth - share)[:, 0]]) / n - ridge * self.step
            seen_emit += grad ** 2
            seen_step += grad_step ** 2
            self.emit = self.emit + rate * grad / np.sqrt(seen_emit)
            self.step = self.step + rate * grad_step / np.sqrt(seen_step)
        return self

    def _expected(self, score: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of every tag at every piece, and of every pair of tags at neighbouring pieces."""
        n, longest = real.shape
        forward = np.empty((n, longest, 3))
        forward[:, 0] = self.step[3] + score[:, 0]
        for t in range(1, longest):
            moved = _log_sum(forward[:, t - 1, :, None] + self.step[:3], 1) + score[:, t]
            forward[:, t] = np.where(real[:, t, None], moved, forward[:, t - 1])
        total = _log_sum(forward[:, -1], 1)[:, None]
        backward = np.zeros((n, longest, 3))
        for t in range(longest - 2, -1, -1):
            moved = _log_sum(self.step[:3] + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(real[:, t + 1, None], moved, 0.0)
        share = np.exp(forward + backward - total[:, :, None]) * real[:, :, None]
        both = forward[:, :-1, :, None] + self.step[:3] + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, :, None, None]
        return share, np.exp(np.where(real[:, 1:, None, None], both, -np.inf))


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.log(np.exp(values - top).sum(axis=axis)) + np.squeeze(top, axis)


class Scorer:
    """Tags of whole texts by a field, as `Field.decode_all` gives them, decoding only where a span is possible.

    A stretch of begin and inside tags replaces outside tags. What it gains is at most what its pieces gain by their
    better tag, plus the dearest steps. Only words that lie in a stretch whose bound is not below zero can
    be tagged; runs of such words are decoded between outside tags, which is where the whole chain's best path has them.
    """

    KEPT = 1 << 16
    SLACK = 1e-6
    #: Features that the shape of a word gives.
    SHAPE = [0, 1, 2, 3, 4, 6, 7, 8, 9, 15]

    def __init__(self, field: Field, least: int = LEAST_ADDED):
        self.field, self.least, self.words = field, least, Words()
        self.gains = field.emit[:, :2] - field.emit[:, 2:]  # over outside
        step = field.step
        self.inner = (step[:2, :2] - step[OUTSIDE, OUTSIDE]).max()
        opens = max(step[OUTSIDE, BEGIN] - step[OUTSIDE, OUTSIDE], step[3, BEGIN] - step[3, OUTSIDE])
        self.ends = opens + max(0.0, (step[:2, OUTSIDE] - step[OUTSIDE, OUTSIDE]).max()) - self.inner
        self.pieces: dict[str, tuple[str, int]] = {}
        self.shapes: dict[tuple, int] = {}
        self.of_shape: list[tuple[np.ndarray, int, int]] = []
        self.held = 0

    def _shape(self, key: tuple) -> int:
        rows, last, first = self.words.of_shape(key)
        own = self.gains[rows[:, self.SHAPE]].sum(axis=1)
        # The names of the neighbours of the first and the last piece are added where the word occurs.
        own[0] -= self.gains[0]
        own[-1] -= self.gains[0]
        self.shapes[key] = len(self.of_shape)
        self.of_shape.append((own, last, first))
        self.held += len(own)
        return self.shapes[key]

    def _piece(self, piece: str) -> tuple[str, int]:
        made = _shape(piece), xxhash.xxh3_64_intdigest(piece.lower()[:8]) >> 36 & WIDTH - 1
        if len(piece) <= Words.LONGEST:
            if len(self.pieces) >= self.KEPT:
                self.pieces.clear()
            self.pieces[piece] = made
        return made

    def _distinct(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gains of the pieces of the words one after another, pieces by word, names that each word gives its neighbours)."""
        if self.held > self.KEPT:
            self.shapes, self.of_shape, self.held = {}, [], 0
        digest, shapes, known = xxhash.xxh3_64_intdigest, self.shapes, self.pieces
        ids, own_names, names = [], [], []
        for word in words:
            low = word.lower()
            name = digest(low[:12])
            if word.isalpha() and word.isascii():
                size = len(word)
                key = (min(size, 63) // 4, max(low) <= "f", ("a" if word == low else "A" if word.isupper() else "m") + _SIZES[min(size, 20)])
                own_names.append((name if size <= 8 else digest(low[:8])) >> 36 & WIDTH - 1)
            else:
                found = [known.get(p) or self._piece(p) for p in PIECE.findall(word)]
                key = (min(len(word), 63) // 4, NOT_HEX.search(low) is None, *[f[0] for f in found])
                own_names += [f[1] for f in found]
            at = shapes.get(key)
            ids.append(self._shape(key) if at is None else at)
            names.append(name)
        ids, names = np.array(ids, np.int64), np.array(names, np.uint64).view(np.int64)
        size = np.array([len(x[0]) for x in self.of_shape], np.int64)
        first, n = (np.cumsum(size) - size)[ids], size[ids]
        ends = np.cumsum(n)
        own = np.concatenate([x[0] for x in self.of_shape])[np.repeat(first - ends + n, n) + np.arange(ends[-1])] + self.gains[own_names]
        edges = np.array([x[1:] for x in self.of_shape], np.int64)[ids]
        return own, n, np.column_stack([edges, names & WIDTH - 1, names >> 12 & WIDTH - 1, names >> 24 & WIDTH - 1])

    def tags(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tags of the pieces of the texts one after another, pieces by text)."""
        local: dict[str, int] = {}
        split = [text.split() for text in texts]
        ids = np.fromiter((local.setdefault(w, len(local)) for words in split for w in words), np.int64)
        counts = np.array([len(words) for words in split], np.int64)
        if not len(ids):
            return np.empty(0, np.int8), counts
        gains, size, near = self._distinct(list(local))
        near = np.vstack([near, Words.START, Words.END])
        start, end = len(size), len(size) + 1
        last, first, left1, left2, right1 = (self.gains[near[:, k]] for k in range(5))
        # Bounds of all pieces of a word, and of any run of its pieces.
        origin, bound = np.cumsum(size) - size, gains.max(axis=1) + self.inner
        all_, most = np.add.reduceat(bound, origin), np.add.reduceat(np.maximum(bound, 0.0), origin)
        most = np.where(most > 0, most, np.maximum.reduceat(bound, origin))

        text_of = np.repeat(np.arange(len(texts)), counts)
        own = counts[counts > 0]
        heads = np.cumsum(own) - own
        tails = heads + own - 1
        left, right = np.append(start, ids[:-1]), np.append(ids[1:], end)
        left[heads], right[tails] = start, end
        before = np.append(start, left[:-1])
        before[heads] = start
        files = np.array([[_name("f" + a), _name("d" + b)] for a, b in map(_text_shape, texts)], np.int64)
        around = left1[left] + left2[before] + right1[right] + self.gains[files].sum(axis=1)[text_of]
        edge = np.maximum(0.0, last[left].max(axis=1)) + np.maximum(0.0, first[right].max(axis=1))

        n, each = size[ids], around.max(axis=1)
        whole = all_[ids] + n * each + edge
        part = np.maximum(whole, most[ids] + np.where(each > 0, n * each, each) + edge)
        # The best stretch that ends before, and that begins after a word; texts are kept apart by a deep gap.
        level = np.cumsum(whole)
        gap = (np.abs(whole).sum() + np.abs(part).sum() + 1.0) * text_of
        reach = np.maximum.accumulate(part - level + gap)
        behind = np.append(0.0, level[:-1] + reach[:-1] - gap[1:])
        behind[heads] = 0.0
        turned = level - whole
        back = np.maximum.accumulate((part + turned + gap[-1] - gap)[::-1])[::-1]
        ahead = np.append(back[1:] - turned[1:] - (gap[-1] - gap[:-1]), 0.0)
        ahead[tails] = 0.0
        live = np.maximum(0.0, behind) + part + np.maximum(0.0, ahead) + self.ends >= -self.SLACK - 1e-12 * (gap[-1] + 1.0)

        stops = np.cumsum(n)
        tags = np.full(stops[-1], OUTSIDE, np.int8)
        at = np.flatnonzero(live)
        if len(at):
            opens = np.append(True, (np.diff(at) > 1) | (np.diff(text_of[at]) > 0))
            word_stops = np.cumsum(n[at])
            score = np.zeros((word_stops[-1], 3))
            score[:, :2] = gains[np.repeat(origin[ids[at]] - word_stops + n[at], n[at]) + np.arange(len(score))] + np.repeat(around[at], n[at], axis=0)
            score[word_stops - n[at], :2] += last[left[at]]
            score[word_stops - 1, :2] += first[right[at]]
            runs = np.add.reduceat(n[at], np.flatnonzero(opens))
            step = self.field.step
            begins = np.where((left[at[opens]] == start)[:, None], step[3], step[OUTSIDE]) + [0.0, -np.inf, 0.0]
            closing = np.append(opens[1:], True)
            ends = np.where((right[at[closing]] == end)[:, None], 0.0, step[:3, OUTSIDE])
            places = np.repeat(stops[at] - word_stops, n[at]) + np.arange(len(score))
            tags[places] = self.field.best_paths(score, runs, begins, ends)
        return tags, np.diff(np.append(0, stops)[np.cumsum(counts)], prepend=0)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts of about GROUP characters together; a longer text is a group of its own."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > GROUP:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _windows(tags: np.ndarray, longest: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(tags):
        end = min(len(tags), at + longest)
        if end < len(tags) and tags[end] == INSIDE:
            begin = end
            while begin > at and tags[begin] == INSIDE:
                begin -= 1
            end = begin if begin > at else end
        yield at, end
        at = end


#: Alphabets of made secrets, and their lengths.
_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = (_LETTERS + _LETTERS.upper() + _DIGITS, _LETTERS + _LETTERS.upper() + _DIGITS + "-_", _LETTERS.upper() + _DIGITS, _LETTERS + _DIGITS)
LENGTHS = (16, 64)


def varied(text: str, spans: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """`text` with each secret replaced by a made one of another alphabet and length, drawn from a hash of the old one."""
    out, made, done, size = [], [], 0, 0
    for start, end, kind in spans:
        if start < done:
            continue
        draw = random.Random(xxhash.xxh3_64_intdigest(text[start:end]))
        value = "".join(draw.choices(draw.choice(ALPHABETS), k=draw.randint(*LENGTHS)))
        out += [text[done:start], value]
        size += start - done
        made.append((size, size + len(value), kind))
        size, done = size + len(value), end
    return "".join(out) + text[done:], made


def _within(words: Words, text: str, start: int, end: int) -> np.ndarray:
    """Features of the pieces of text[start:end], as the whole text has them."""
    low, high = start, end
    for k in range(3):  # the word of `start` and two before it
        while k and low > 0 and text[low - 1].isspace():
            low -= 1
        while low > 0 and not text[low - 1].isspace():
            low -= 1
    for k in range(2):
        while k and high < len(text) and text[high].isspace():
            high += 1
        while high < len(text) and not text[high].isspace():
            high += 1
    rows, file = words.rows([text[low:high]])[0], _text_shape(text)
    first = len(PIECE.findall(text, low, start))
    rows = rows[first:first + len(PIECE.findall(text, start, end))]
    rows[:, Words.F], rows[:, Words.D] = _name("f" + file[0]), _name("d" + file[1])
    return rows


def _texts_to_learn_from(docs: DataFrame, text_column: str, count: int) -> DataFrame:
    """(_t, _share): of texts with and of texts without a sign of a base span, the `count` different ones of smallest hash.

    `_share` is how many different texts of its kind one of them stands for. Only hashes are compared over
    the whole table, in the executors; two numbers a kind reach the driver.
    """
    texts = docs.select(F.col(text_column).alias("_t")).filter("_t is not null").withColumn("_m", F.shiftrightunsigned(F.xxhash64("_t"), 1))
    marks = cut_lineage(texts.select("_m", F.col("_t").rlike(SIGN).alias("sign")).distinct(), "marks")
    wanted = None
    for kind in (marks.filter("sign"), marks.filter("not sign")):
        lowest = kind.orderBy("_m").limit(count).agg(F.max("_m").alias("top"), F.count("*").alias("n")).first()
        share = 1.0 if lowest["n"] < count else max(1.0, 2.0 ** 63 / (lowest["top"] + 1))
        own = kind.filter(F.col("_m") <= F.lit(lowest["top"])).select("_m", F.lit(share).alias("_share"))
        wanted = own if wanted is None else wanted.unionByName(own)
    # At most 2 x `count` rows.
    chosen = texts.join(F.broadcast(wanted), "_m")
    return chosen.groupBy("_m").agg(F.first("_t").alias("_t"), F.first("_share").alias("_share")).select("_t", "_share")


def train(docs: DataFrame, *, text_column: str = "text", sample: int = 3000, longest: int = 64, texts: int = 3000) -> Field:
    """A field fitted to at most `sample` windows of 2 x `texts` texts at most, half of them with a span.

    Without a window of either label there is nothing to tell apart, and the field adds nothing.
    """
    half = max(1, sample // 2)

    def make():
        words = Words()

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            made = []
            for text, share in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                spans = base_spans(text)
                for text, spans in [(text, spans), *([varied(text, spans)] if spans else [])]:
                    borders = [m.span() for m in PIECE.finditer(text)]
                    tags = doubtful(text, borders, labels(borders, spans))
                    for a, b in _windows(tags, longest):
                        own = text[borders[a][0]:borders[b - 1][1]].encode("utf-8", "surrogatepass") + b" " + tags[a:b].tobytes()
                        made.append((xxhash.xxh3_64_intdigest(own) >> 1, int(bool((tags[a:b] < OUTSIDE).any())), share,
                                     _within(words, text, borders[a][0], borders[b - 1][1]).tobytes(), tags[a:b].tobytes()))
            columns = list(zip(*made)) if made else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["mark", "label", "share", "rows", "tags"])

        return work

    chosen = _texts_to_learn_from(docs, text_column, texts)
    found = cut_lineage(map_batches(chosen, make, "mark long, label int, share double, rows binary, tags binary"), "windows")
    counted = found.groupBy("label", "mark").agg(F.max("share").alias("share"))
    chains, weights, held = [], [], []
    for label in (0, 1):
        own = counted.filter(F.col("label") == label)
        total = own.agg(F.sum("share")).first()[0]
        if total is None:
            return Field()
        # At most `half` numbers are sorted; those of each partition are merged in the executors.
        limit = own.select("mark").orderBy("mark").limit(half).agg(F.max("mark")).first()[0]
        kept = found.filter((F.col("label") == label) & (F.col("mark") <= limit)).groupBy("mark").agg(
            F.max("share").alias("share"), F.first("rows").alias("rows"), F.first("tags").alias("tags"))
        kept = sorted(kept.collect())
        shares = np.array([r["share"] for r in kept])
        for r, share in zip(kept, shares / shares.mean()):
            rows, tags = np.frombuffer(r["rows"], np.int16).reshape(-1, FEATURES), np.frombuffer(r["tags"], np.int8)
            if r["mark"] % HELD_OUT == 0 and label == 0:
                held.append(rows)
            else:
                chains.append((_viewed(rows, tags, r["mark"] // HELD_OUT % len(VIEWS)), tags))
                weights.append(share)
    return _costed(Field().fit(chains, weights=np.array(weights)), held)


def _viewed(rows: np.ndarray, tags: np.ndarray, view: int) -> np.ndarray:
    """Features as in one of VIEWS."""
    rows = rows.copy()
    rows[np.ix_(tags < OUTSIDE, np.array(VIEWS[view], int))] = DROPPED
    return rows


def _costed(field: Field, held: list[np.ndarray]) -> Field:
    """`field` with the least cost of opening a span at which no held-out window without a span has one, and MARGIN."""
    if not held:
        return field
    rows, sizes = np.concatenate(held), np.array([len(h) for h in held])

    def at(cost: float) -> Field:
        step = field.step.copy()
        step[:, BEGIN] -= cost
        return Field(field.emit, step)

    enough = next((c for c in COSTS if (at(c).decode_all(rows, sizes) == OUTSIDE).all()), COSTS[-1])
    return at(enough + MARGIN)


def all_spans(texts: list[str | None], scorer: Scorer) -> Iterator[list[tuple[int, int, str]]]:
    """By text, base spans and spans of the field that touch none of them, by start and kind."""
    return ([s[:3] for s in spans] for spans in _all_matches(texts, scorer))


def _all_matches(texts: list[str | None], scorer: Scorer) -> Iterator[list[tuple[int, int, str, int]]]:
    """all_spans() with the place where the whole match of each span starts."""
    for group in _groups([t or "" for t in texts]):
        if not scorer.field.emit.any():
            yield from map(_base, group)
            continue
        tags, pieces = scorer.tags(group)
        for text, end, size in zip(group, np.cumsum(pieces).tolist(), pieces.tolist()):
            yield _with_added(text, tags[end - size:end], scorer.least)


def spans_of(text: str, field: Field) -> list[tuple[int, int, str]]:
    return next(all_spans([text], Scorer(field)))


def _with_added(text: str, tags: np.ndarray, least: int) -> list[tuple[int, int, str, int]]:
    found, begins = _base(text), np.flatnonzero(tags == BEGIN)
    if not len(begins):
        return found
    borders = [m.span() for m in PIECE.finditer(text)]
    ends = np.append(np.flatnonzero(tags != INSIDE), len(tags))
    stops = ends[np.searchsorted(ends, begins, side="right")]
    base = list(found)
    for first, stop in zip(begins.tolist(), stops.tolist()):
        span = borders[first][0], borders[stop - 1][1], "crf", borders[first][0]
        if span[1] - span[0] >= least and all(span[1] <= a or span[0] >= b for a, b, *_ in base):
            found.append(span)
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def scan(docs: DataFrame, field: Field, *, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST_ADDED) -> DataFrame:
    """(id, spans array<struct<start, end, kind>>, matched array<int>) of every row; offsets in code points, end exclusive.

    `matched` says by span where its whole match starts; an assignment's span is its value, its match begins with the key word.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, spans array<struct<start: int, end: int, kind: string>>, matched array<int>"
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def make():
        scorer = Scorer(field, least)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            found = list(_all_matches(part.column(1).to_pylist(), scorer))
            made = [[dict(zip(("start", "end", "kind"), s)) for s in spans] for spans in found]
            matched = pa.array([[s[3] for s in spans] for spans in found], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(made, shape), matched], names=[id_column, "spans", "matched"])

        return work

    return map_batches(docs.select(id_column, text_column), make, schema)


def redact(docs: DataFrame, field: Field, *, text_column: str = "text", by: str = "[SECRET]", least: int = LEAST_ADDED) -> DataFrame:
    """`docs` with every span replaced by `by`; overlapping spans are replaced as one. A null text stays null."""
    at = docs.columns.index(text_column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def hide(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
        out, done = [], 0
        for start, end, _ in spans:
            if start >= done:
                out += [text[done:start], by]
            done = max(done, end)
        return "".join(out) + text[done:] if spans else text

    def make():
        scorer = Scorer(field, least)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part.column(at).to_pylist()
            hidden = pa.array(map(hide, texts, all_spans(texts, scorer)), pa.string())
            return pa.RecordBatch.from_arrays([hidden if k == at else c for k, c in enumerate(part.columns)], names=part.schema.names)

        return work

    return map_batches(docs, make, schema)
