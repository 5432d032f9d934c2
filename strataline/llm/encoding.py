"""Token ids of a corpus by a public byte-level BPE vocabulary.

Pre-tokenisation works on the code points of a whole batch as one array: every code point
has a class, and the places where a token starts follow from neighbouring classes. What
depends on all that stands before, whether an apostrophe begins a token, is a transition
function of each candidate, and a prefix scan composes these by doubling; so no regular
expression and no loop runs over the texts. Each slice is then looked up in a cache of merged
pieces; only unseen slices are merged. Slices keep their offsets, which
``encode_with_offsets`` returns for decoding.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_ENTRIES = 1 << 18

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
# Contractions of the vocabulary's pattern, a fixed value of the public tokenizer.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# White space of the pattern (the Unicode property White_Space).
_WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point, from the Unicode general category."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = _LETTER
        elif kind == "N":
            table[code] = _NUMBER
    table[list(_WHITE)] = _SPACE
    return table


def composed(keep: np.ndarray, set_: np.ndarray) -> np.ndarray:
    """State after each of a row of transition functions ``state -> set or (keep and state)``, from a state of false.

    Such functions are closed under composition, which is associative, so all prefixes are
    composed by doubling: after round k each function covers 2**k predecessors.
    """
    keep, set_ = keep.copy(), set_.copy()
    step = 1
    while step < len(keep) and keep[step:].any():
        set_[step:], keep[step:] = set_[step:] | (keep[step:] & set_[:-step]), keep[step:] & keep[:-step]
        keep[:step] = False  # these reach the beginning
        step *= 2
    return set_


def token_starts(codes: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Start of each pre-token of texts given as code points, one text after the other; ``first`` has where texts begin.

    A run of one class is a token; one plain space before a run of another class belongs
    to that run; the last character of a longer run of white space is split off when
    something follows it; an apostrophe that a token begins with takes a contraction.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = _classes()[codes]
    begins = np.zeros(n + 1, dtype=bool)
    begins[0] = begins[n] = True
    if first is not None:
        begins[first] = True
    start = begins[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # The last white space before something else: a plain space joins what follows,
    # another kind stands alone.
    last = np.zeros(n, dtype=bool)
    last[:-1] = space[:-1] & ~space[1:] & ~begins[1:n]
    start |= last
    start[1:] &= ~(last[:-1] & (codes[:-1] == 32))
    quotes = np.flatnonzero(codes == 39)
    if len(quotes):
        _contract(codes, kind, begins, start, quotes)
    return np.flatnonzero(start)


def _contract(codes: np.ndarray, kind: np.ndarray, begins: np.ndarray, start: np.ndarray, quotes: np.ndarray) -> None:
    """Contractions: an apostrophe that starts a token, of itself or right behind a former contraction, and one of the endings after it."""
    n = len(codes)
    length = np.zeros(len(quotes), dtype=np.int64)
    for ending in reversed(_CONTRACTIONS):
        hit = quotes + len(ending) < n
        for k, c in enumerate(ending, 1):
            place = np.minimum(quotes + k, n - 1)
            hit &= (codes[place] == ord(c)) & ~begins[place]
        length[hit] = len(ending)
    at, size = quotes[length > 0], length[length > 0]
    if not len(at):
        return
    end = at + 1 + size
    behind = np.zeros(len(at), dtype=bool)
    behind[1:] = (end[:-1] == at[1:]) & ~begins[at[1:]]
    taken = composed(behind, start[at])
    at, end = at[taken], end[taken]
    for k in range(1, 1 + max(map(len, _CONTRACTIONS))):
        inside = at + k
        start[inside[inside < end]] = False
    end = end[end < n]
    start[end[kind[end] != _SPACE]] = True


class ByteBPE:
    """Cached pair merging by the ranks of a vocabulary file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) > 200:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges from a heap over linked neighbours, for pieces without any break."""
        import heapq

        ranks, n = self.ranks, len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return tuple(ranks[p] for p in parts if p is not None)

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self.cache.get(text)
        if ids is None:
            ids = self.merge(text.encode("utf-8", "replace"))
            if len(text) <= 64:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[text] = ids
        return ids

    def encode_with_offsets(self, text: str) -> list[tuple[int, int, tuple[int, ...]]]:
        """(start, end, ids) of each pre-token; the slices join to the text."""
        starts = token_starts(_codes(text)).tolist()
        return [(a, b, self.piece(text[a:b])) for a, b in zip(starts, [*starts[1:], len(text)])]

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the end of each text's ids."""
        held = [t or "" for t in texts]
        joined = "".join(held)
        first = np.cumsum([0, *map(len, held)])
        starts = token_starts(_codes(joined), first[:-1][first[:-1] < len(joined)])
        piece = self.piece
        pieces = [piece(joined[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(joined)])]
        ends = np.cumsum([0, *map(len, pieces)])[np.searchsorted(starts, first[1:])]
        return np.fromiter(chain.from_iterable(pieces), dtype=np.int32), ends

    def decode(self, ids: list[int]) -> str:
        tokens = {v: k for k, v in self.ranks.items()}
        return b"".join(tokens[i] for i in ids).decode("utf-8", "replace")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def vocabulary_ranks(path: str) -> dict[bytes, int]:
    """Rank of each token of a vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=4)
def tokenizer(path: str = DEFAULT_VOCABULARY) -> ByteBPE:
    """The tokenizer of a vocabulary file."""
    return ByteBPE(vocabulary_ranks(path))


_LOADED: dict[str, ByteBPE] = {}


def _of_worker(path: str, shared) -> ByteBPE:
    """The tokenizer of a broadcast vocabulary, made once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(shared.value)
    return _LOADED[path]


def encode_corpus(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)`` for every row: the token ids of its text.

    An empty and a null text both give an empty list, a blank text is encoded as it is, and
    strings that look like special tokens are ordinary text. A null or repeated key is kept
    as it stands. ``vocabulary`` is a ranks file that the driver can read; its 50,000 entries
    are broadcast. Work is per row, so there is no shuffle.
    """
    kind = documents.schema[key].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(tokenizer(vocabulary).ranks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of_worker(vocabulary, shared)
        for batch in batches:
            flat, ends = bpe.encode_batch(batch.column(1).to_pylist())
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=[key, "ids"])

    return documents.select(key, F.col(text)).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")
