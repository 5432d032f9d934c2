"""Splitting of oversized texts at natural boundaries, with overlap.

Every boundary of a text is joined to its farthest legal successor (the start of the
piece after the one that begins there), which gives one successor table for a whole
batch of texts. Squaring that table by pointer doubling marks all greedy cuts of all
texts in log2(pieces) gathers, with no loop over texts or pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SIZE = 2048
DEFAULT_OVERLAP = 256

PIECES = "id string, pieces array<struct<piece_no:int,start_pos:int,n_chars:int,piece:string>>"
_PIECES_ARROW = pa.list_(
    pa.struct([("piece_no", pa.int32()), ("start_pos", pa.int32()), ("n_chars", pa.int32()), ("piece", pa.string())])
)

_SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
_STOPS = np.array([ord(c) for c in ".!?;:…"], dtype=np.uint32)
_WIDE_STOPS = np.array([ord(c) for c in "。！？｡؟।"], dtype=np.uint32)


def effective_overlap(size: int, overlap: int) -> int:
    """The overlap that can be met: half the size where the wanted one is not smaller than the size."""
    return max(0, overlap) if overlap < size else size // 2


def _marks(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions before which the text may be cut: all natural ones, and those of a line or sentence."""
    space = np.isin(text, _SPACES)
    after_space = np.zeros(len(text), dtype=bool)
    after_space[1:] = space[:-1] & ~space[1:]
    wide = np.zeros(len(text), dtype=bool)
    wide[1:] = np.isin(text[:-1], _WIDE_STOPS) & ~np.isin(text[1:], _WIDE_STOPS)
    # The last character before each run of spaces, and whether the run holds a line end.
    at = np.arange(len(text))
    solid = np.maximum.accumulate(np.where(space, -1, at))
    line = np.maximum.accumulate(np.where(text == 10, at, -1))
    cuts = np.flatnonzero(after_space)
    before = solid[cuts - 1]
    strong = (line[cuts - 1] > before) | ((before >= 0) & np.isin(text[before], _STOPS))
    wide_cuts = np.flatnonzero(wide)
    return np.union1d(cuts, wide_cuts), np.union1d(cuts[strong], wide_cuts)


def _joins_back(text: np.ndarray) -> np.ndarray:
    """Code points that belong to the one before: combining marks, selectors, joiners and what follows a joiner."""
    back = ((text >= 0x300) & (text <= 0x36F)) | ((text >= 0xFE00) & (text <= 0xFE0F)) | (text == 0x200D) | ((text >= 0x1F3FB) & (text <= 0x1F3FF))
    back[1:] |= text[:-1] == 0x200D
    return back


def _filled(cuts: np.ndarray, text: np.ndarray, step: int) -> np.ndarray:
    """The cuts and, in stretches without any, forced ones at most ``step`` apart, outside character clusters where possible."""
    edges = np.concatenate([[0], cuts, [len(text)]])
    gaps = np.diff(edges)
    if gaps.max(initial=0) <= step:
        return cuts
    wide = np.flatnonzero(gaps > step)
    half = max(1, step // 2)
    counts = (gaps[wide] - 1) // half
    forced = np.repeat(edges[wide], counts) + half * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + 1)
    back = _joins_back(text)
    # The last place at or before each that does not belong to what stands before it, if it is near enough.
    free = np.maximum.accumulate(np.where(back, -1, np.arange(len(text))))
    moved = free[forced]
    forced = np.where((moved >= 0) & (forced - moved < half), moved, forced)
    return np.union1d(cuts, forced[(forced > 0) & (forced < len(text))])


def split_points(texts: list[np.ndarray], sizes: list[int], overlaps: list[int]) -> list[list[tuple[int, int]]]:
    """The (start, end) of the pieces of each text."""
    starts_all, next_all, end_all, first = [], [], [], []
    total = 0
    for text, size, overlap in zip(texts, sizes, overlaps):
        keep = effective_overlap(size, overlap)
        natural, strong = _marks(text)
        step = max(1, (size - keep) // 2)
        cuts = np.concatenate([[0], _filled(natural, text, step)])
        cuts = np.unique(cuts)
        ends = np.concatenate([cuts[1:], [len(text)]])
        farthest = ends[np.searchsorted(ends, cuts + size, side="right") - 1]
        if len(strong):
            k = np.searchsorted(strong, cuts + size, side="right") - 1
            best = strong[np.maximum(k, 0)]
            good = (k >= 0) & (best > cuts + max(keep + step, size // 2)) & (farthest < len(text))
            farthest = np.where(good, best, farthest)
        after = np.searchsorted(cuts, farthest - keep, side="left")
        after = np.where(farthest >= len(text), len(cuts), np.maximum(after, np.arange(len(cuts)) + 1))
        first.append(total)
        starts_all.append(np.append(cuts, -1))
        end_all.append(np.append(farthest, -1))
        next_all.append(total + after)
        next_all.append(np.array([total + len(cuts)]))  # the end is its own successor
        total += len(cuts) + 1
    if not texts:
        return []
    starts, ends, jump = np.concatenate(starts_all), np.concatenate(end_all), np.concatenate(next_all)
    reached = np.zeros(total, dtype=bool)
    frontier = np.array(first)
    reached[frontier] = True
    while True:
        new = jump[frontier]
        new = np.unique(new[~reached[new]])
        if not len(new):
            break
        reached[new] = True
        frontier = np.flatnonzero(reached)
        jump = jump[jump]
    bounds = [*first, total]
    out = []
    for a, b in zip(bounds, bounds[1:]):
        at = a + np.flatnonzero(reached[a : b - 1])
        out.append(list(zip(starts[at].tolist(), ends[at].tolist())))
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def split_text(text: str, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> list[str]:
    """The pieces of one text; a text within the limit is its own only piece, an empty one has none."""
    if len(text) <= size:
        return [text] if text else []
    return [text[a:b] for a, b in split_points([_codes(text)], [size], [overlap])[0]]


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        cuts = split_points([_codes(t) for t in texts], batch.column(2).to_pylist(), batch.column(3).to_pylist())
        pieces = [
            [{"piece_no": k, "start_pos": a + 1, "n_chars": b - a, "piece": t[a:b]} for k, (a, b) in enumerate(pairs)]
            for t, pairs in zip(texts, cuts)
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, type=_PIECES_ARROW)], names=["id", "pieces"])


def split_oversized(chunks: DataFrame, options: DataFrame) -> DataFrame:
    """One row ``(id, pieces)`` for each text longer than the limit of its collection.

    ``chunks`` has ``id, collection_id, content``; ``options`` has ``dataset, chunk_size,
    chunk_overlap`` in characters. A null or non-positive size stands for 2048, a null or
    negative overlap for 256; a collection without options has both defaults. Null, empty
    and short texts give no row. Several option rows of a dataset: the largest size counts.
    No piece is above the limit, pieces cover the text without gaps, and each repeats about
    the overlap of the one before. Other columns of both frames are ignored.
    """
    size = F.when(F.col("chunk_size") > 0, F.col("chunk_size")).otherwise(F.lit(DEFAULT_SIZE))
    limits = options.groupBy(F.col("dataset").alias("_dataset")).agg(F.max(F.struct(size.alias("size"), "chunk_overlap")).alias("_o"))
    limits = limits.select("_dataset", F.col("_o.size").alias("_size"), F.col("_o.chunk_overlap").alias("_overlap"))
    long_texts = (
        chunks.select("id", F.col("collection_id").alias("_collection"), "content")
        .join(limits, F.col("_collection") == F.col("_dataset"), "left")
        .select(
            "id",
            "content",
            F.when(F.col("_size") > 0, F.col("_size")).otherwise(F.lit(DEFAULT_SIZE)).cast("int").alias("size"),
            F.when(F.col("_overlap") >= 0, F.col("_overlap")).otherwise(F.lit(DEFAULT_OVERLAP)).cast("int").alias("overlap"),
        )
        .where(F.char_length("content") > F.col("size"))
    )
    return long_texts.mapInArrow(_split_batches, PIECES)


def pieces_of(split: DataFrame) -> DataFrame:
    """One row per piece: ``id, piece_no`` (from 0), ``start_pos`` (code points from 1), ``n_chars, piece``."""
    return split.select("id", F.inline("pieces"))
