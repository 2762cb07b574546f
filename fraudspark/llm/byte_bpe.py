"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one token can end its encoding: the one whose own merges give
back that token and which stays apart from the last token of what comes before it. The table of
these last tokens is filled from left to right, so bytes can be appended without looking at
earlier ones again, and the encoding is read from the end.

Nulls are read as empty texts and give no ids. Repeated rows are encoded one by one. Empty tables
give empty tables; columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import re
from array import array
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from fraudspark.llm.common import map_batches, slices

CACHE_ENTRIES, APART_ENTRIES = 240_000, 300_000
KEPT_LENGTH = 48
#: Of these the pattern makes a match of its own after a word.
SIGNS = tuple(".,;:!?")
#: A space before something that is no white space always starts a match, so a text may be cut there.
CUT = re.compile(r" (?=\S)")
UNEVEN = re.compile(r" (?!\S)")


class PrefixEncoder:
    """Encodes single pieces with the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: The two tokens whose join makes a token; a byte is its own halves.
        self._halves: dict[int, tuple[int, int]] = {}
        for token, rank in ranks.items():
            parts = self.merged(token, 2)
            if len(parts) < 3:
                self._halves[rank] = (rank, rank) if len(token) == 1 else (ranks[parts[0]], ranks[parts[1]])
        #: Finds the tokens that merges can make; the others only stand for a whole piece. Each comes with its size
        #: and with what is known so far: whether it stays apart from a token before it.
        self.tokens = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if rank in self._halves:
                self.tokens.add_word(token.decode("latin-1"), (rank, len(token), {}))
        self.tokens.make_automaton()
        self._known = 0

    def merged(self, piece: bytes, least: int = 1) -> list[bytes]:
        """The plain definition: join the neighbours of lowest rank, leftmost first, until none join
        or `least` parts are left."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        rank_of = self.ranks.get
        while len(parts) > least:
            ranks = [rank_of(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
            low = min(ranks)
            if low == 1 << 40:
                break
            at = ranks.index(low)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stay_apart(self, left: int, right: int, known: dict[int, bool]) -> bool:
        """Whether no merge crosses the border of two neighbouring tokens; noted in `known`, that of `right`.

        Undo the later of the two merges again and again: a join of the two tokens then at the
        border comes first exactly when its rank is below that of the merge undone last.
        """
        first, halves = left, self._halves
        rank_of, token_bytes, limit, apart = self.ranks.get, self.token_bytes, 1 << 40, True
        while True:
            joined = rank_of(token_bytes[left] + token_bytes[right])
            if joined is not None and joined < limit:
                apart = False
                break
            left_half, right_half = halves[left][1], halves[right][0]
            if left_half == left and right_half == right:
                break
            # At equal ranks the left one was merged first, so a border join of the right one's rank still precedes it.
            if right_half == right or left > right and left_half != left:
                limit, left = left, left_half
            else:
                limit, right = right + 1, right_half
        self._known += 1
        if self._known > APART_ENTRIES:
            for _, _, noted in self.tokens.values():
                noted.clear()
            self._known = 1
        known[first] = apart
        return apart

    def extend(self, piece: bytes, last: list[int]) -> None:
        """Fill `last` (last[i]: the token that ends piece[:i + 1]) up to the end of `piece`."""
        done = len(last)
        from_here = max(0, done - self.longest)
        # Every token that ends at a byte, longest first, byte by byte.
        for end, (rank, size, known) in self.tokens.iter(piece.decode("latin-1"), from_here):
            if end < done:
                continue
            if end >= size:
                before = last[end - size]
                try:
                    apart = known[before]
                except KeyError:
                    apart = self._stay_apart(before, rank, known)
                if not apart:
                    continue
            last.append(rank)
            done += 1
        if done != len(piece):
            raise ValueError(f"the vocabulary does not have all bytes of {piece!r}")

    def read(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(self.token_bytes[token])
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        """A piece that is a token is that token; any other is encoded by the table."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.extend(piece, last)
        return self.read(last)


class Piece:
    """A piece that grows: appended bytes only add to the table."""

    def __init__(self, encoder: PrefixEncoder, start: bytes = b""):
        self.encoder, self.bytes, self.last = encoder, b"", []
        self.append(start)

    def append(self, more: bytes) -> None:
        self.bytes += more
        self.encoder.extend(self.bytes, self.last)

    def ids(self) -> list[int]:
        whole = self.encoder.ranks.get(self.bytes)
        return [whole] if whole is not None else self.encoder.read(self.last)


def packed(ids: list[int]) -> bytes:
    """Ids as the bytes of 32-bit numbers: small to keep, and joined without a look at each."""
    return array("i", ids).tobytes()


class _Cached(dict):
    """Packed ids by text. Beyond half of `most` entries they turn old, and old ones not asked for again are forgotten."""

    def __init__(self, make, most: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = self.make(text)
        if 2 * len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(text) <= KEPT_LENGTH:
            self[text] = ids
        return ids


class TextEncoder:
    """Splits a text by a pattern and encodes each match separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoder = PrefixEncoder(ranks)
        # White space as Unicode has it, which differs from Python's own class.
        spelled = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(spelled)
        self.pieces = _Cached(lambda piece: packed(self.encoder.encode(piece.encode("utf-8", "surrogatepass"))), CACHE_ENTRIES // 4)
        self.spaced = _Cached(self._spaced)

    def _spaced(self, part: str) -> bytes:
        """Of a part after a space; that of a word with one sign behind it is the word's, then the sign's."""
        if part.isalpha():
            return packed(self.encoder.encode((" " + part).encode("utf-8")))
        if part[-1:] in SIGNS and part[:-1].isalpha():
            return self.spaced[part[:-1]] + self.pieces[part[-1]]
        return self._matches(" " + part)

    def _matches(self, text: str) -> bytes:
        pieces, spaced = self.pieces, self.spaced
        # A word after a space is kept once, whatever follows it.
        return b"".join([spaced[piece[1:]] if piece[0] == " " and piece[1:].isalpha() else pieces[piece]
                         for piece in self.pattern.findall(text)])

    def packed(self, text: str) -> bytes:
        parts = CUT.split(text) if UNEVEN.search(text) else text.split(" ")
        return b"".join(chain((self._matches(parts[0]),), map(self.spaced.__getitem__, parts[1:])))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def forget(self) -> None:
        """Drop the kept ids; the vocabulary stays."""
        for cache in (self.pieces, self.spaced):
            cache.clear()
            cache.old = {}

    def decode(self, ids) -> bytes:
        return b"".join(map(self.encoder.token_bytes.__getitem__, ids))


class EditableText:
    """A text with its ids that encodes again only the pieces near an edit."""

    def __init__(self, coder: TextEncoder, text: str = ""):
        self.coder, self.text = coder, text
        self.starts = [m.start() for m in coder.pattern.finditer(text)]
        self.encoded = 0

    def _piece(self, k: int) -> str:
        end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
        return self.text[self.starts[k]:end]

    def edit(self, start: int, end: int, by: str) -> None:
        """Replace text[start:end]; `append` is an edit at the end.

        A match ends by what it holds and the one character that follows, so matches that end more
        than one character before the edit stay. After the edit, matches are the old ones again
        from the first place where an old match and a new one start together.
        """
        shift = len(by) - (end - start)
        text = self.text[:start] + by + self.text[end:]
        keep = int(np.searchsorted(self.starts, start, "left"))
        keep = max(0, keep - 2)
        at = self.starts[keep] if keep < len(self.starts) else 0
        old = {s + shift: k for k, s in enumerate(self.starts) if s > end}
        fresh: list[int] = []
        tail: list[int] = []
        for m in self.coder.pattern.finditer(text, at):
            if m.start() in old:
                tail = [s + shift for s in self.starts[old[m.start()]:]]
                break
            fresh.append(m.start())
        self.encoded = len(fresh)
        self.starts = self.starts[:keep] + fresh + tail
        self.text = text

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        out: list[int] = []
        for k in range(len(self.starts)):
            out += array("i", self.coder.pieces[self._piece(k)])
        return out


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Vocabulary:
    """A rank file, read once by the driver and sent to the executors.

    Its size is that of the vocabulary and does not depend on the corpus; files above
    `limit` bytes are refused.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str, limit: int = 64 << 20):
        with open(path, "rb") as file:
            content = file.read(limit + 1)
        if len(content) > limit:
            raise ValueError(f"{path} is larger than {limit} bytes")
        self.content = spark.sparkContext.broadcast(content)
        self.pattern = pattern

    def coder(self) -> TextEncoder:
        key = (hash(self.content.value), self.pattern)
        if key not in _CODERS:
            _CODERS.clear()
            _CODERS[key] = TextEncoder(read_ranks(self.content.value), self.pattern)
        return _CODERS[key]

    def token_bytes(self) -> dict[int, bytes]:
        """All a decoder needs."""
        key = hash(self.content.value)
        if key not in _TOKENS:
            _TOKENS.clear()
            _TOKENS[key] = {rank: token for token, rank in read_ranks(self.content.value).items()}
        return _TOKENS[key]

    def __getstate__(self):
        return {"content": self.content, "pattern": self.pattern}


_CODERS: dict[tuple, TextEncoder] = {}
_TOKENS: dict[int, dict[int, bytes]] = {}


def encode(docs: DataFrame, vocabulary: Vocabulary, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        coder = vocabulary.coder()
        try:
            for batch in batches:
                for part in slices(batch):
                    lists = [coder.packed(text) if text else b"" for text in part.column(1).to_pylist()]
                    offsets = np.zeros(len(lists) + 1, np.int32)
                    np.cumsum([len(x) // 4 for x in lists], out=offsets[1:])
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(lists), np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_column, "ids"])
        finally:
            coder.forget()  # the worker lives on, and later stages need the memory

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary, *, id_column: str = "doc_id") -> DataFrame:
    """(id, ids, decoded binary): the bytes of `ids`; null ids give empty bytes."""
    kind = encoded.schema[id_column].dataType.simpleString()

    def make():
        token = vocabulary.token_bytes().__getitem__

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = part.column(1)
            values, offsets = ids.values.to_numpy().tolist(), ids.offsets.to_numpy().tolist()
            made = [b"".join(map(token, values[a:b])) for a, b in zip(offsets, offsets[1:])]
            return pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(made, pa.binary())], names=[id_column, "ids", "decoded"])

        return work

    return map_batches(encoded.select(id_column, "ids"), make, f"`{id_column}` {kind}, ids array<int>, decoded binary")
