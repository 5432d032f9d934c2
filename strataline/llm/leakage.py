"""Held-out test items inside training texts.

The test items form a BM25 inverted index. Posting lists are cut into segments, one for
each block of items, that keep their largest weight. Every passage of a training text is a
query (WAND): terms whose largest weights cannot reach any item's threshold together open
no block; each block that another term opens is bounded by the segment maxima of the whole
passage; and only blocks whose bound reaches a threshold are scored. An item's threshold
is the least score that any text with ``run`` consecutive words of it must have, taken from
its own windows, so retrieval loses no case. Shared word runs are then verified.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.words import word_hashes, words

RUN = 10
K1, B = 1.2, 0.75
BLOCK = 32
#: Words of a passage; passages overlap by a run less one word, so each run lies in one of them.
PASSAGE = 48
#: Texts that are searched together.
GROUP = 512
#: Characters of test items in one index (about 0.5 GB of it at most); more items make more indexes, each a pass of its own.
INDEX_CHARS = 48_000_000

FOUND = "doc_id {key}, item_id {item}, score double, run_words int, covered double, answer_covered double"

_ANSWER = re.compile(r"(?s)^.*?\?|^.*?(?=\(A\)|\bA\.\s)")


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``first, first + 1, ...`` of each range, one after the other."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def _grams(hashes: np.ndarray, run: int) -> np.ndarray:
    """A hash of each window of ``run`` words."""
    if len(hashes) < run:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - run + 1, np.uint64)
    for k in range(run):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)]
    return out


class BlockMaxIndex:
    """BM25 index of test items in blocks, with the least score of each item."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN):
        self.run = run
        hashes, owner = word_hashes([t for _, t in items])
        bounds = np.searchsorted(owner, np.arange(len(items) + 1))
        kept = [k for k in range(len(items)) if bounds[k + 1] - bounds[k] >= run]
        self.terms = np.sort(hashes[np.isin(owner, kept)])
        self.terms = self.terms[_starts(self.terms)]
        own = [hashes[bounds[k] : bounds[k + 1]] for k in kept]
        ids = [np.searchsorted(self.terms, h) for h in own]
        n = len(kept)
        lengths = np.array([len(h) for h in own], np.float64)
        key = np.sort(np.concatenate([i.astype(np.int64) * n + k for k, i in enumerate(ids)]) if n else np.zeros(0, np.int64))
        at = _starts(key)
        tf = np.diff(np.append(at, len(key))).astype(np.float64)
        term, item = key[at] // max(1, n), key[at] % max(1, n)
        df = np.bincount(term, minlength=len(self.terms))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / max(1.0, lengths.mean()))) if n else np.zeros(0)
        first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        least = np.empty(n)
        for k, i in enumerate(ids):
            # The weights of the item's words in order; a window counts each word once.
            place = np.array([first[t] + np.searchsorted(item[first[t] : first[t + 1]], k) for t in i])
            w = weight[place].copy()
            windows = np.lib.stride_tricks.sliding_window_view(np.arange(len(i)), run)
            before = {}
            last = np.full(len(i), -1)
            for j, t in enumerate(i.tolist()):
                last[j] = before.get(t, -1)
                before[t] = j
            least[k] = np.where(last[windows] >= windows[:, :1], 0.0, w[windows]).sum(axis=1).min() * (1 - 1e-5) - 1e-6
        # Items of like thresholds and words share a block.
        order = np.lexsort((np.array([int(i.max()) for i in ids] or [], np.int64), np.round(np.log2(np.maximum(least, 1e-6)))))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.ids = [items[kept[k]][0] for k in order]
        self.hashes = [own[k] for k in order]
        self.answers = []
        for k in order:
            text = items[kept[k]][1]
            head = _ANSWER.match(text)
            self.answers.append(len(words(head.group())) if head else len(own[k]))
        self.least = least[order]
        self.blocks = max(1, -(-n // BLOCK))
        self.block_least = np.minimum.reduceat(self.least, np.arange(0, n, BLOCK)) if n else np.full(1, np.inf)
        by = np.lexsort((rank[item], term)) if n else np.zeros(0, np.int64)
        term, self.post_item, self.post_weight = term[by], rank[item[by]].astype(np.int32) if n else np.zeros(0, np.int32), weight[by].astype(np.float32)
        seg = term * self.blocks + self.post_item // BLOCK
        self.seg_start = _starts(seg)
        self.seg_key = seg[self.seg_start]
        self.seg_size = np.diff(np.append(self.seg_start, len(seg)))
        self.seg_max = np.maximum.reduceat(self.post_weight, self.seg_start).astype(np.float64) if len(seg) else np.zeros(0)
        self.seg_at = np.searchsorted(self.seg_key, np.arange(len(self.terms) + 1, dtype=np.int64) * self.blocks)
        self.most = np.maximum.reduceat(self.post_weight, _starts(term)).astype(np.float64) if len(term) else np.zeros(0)

    def _segments(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which (term, block) pairs have a segment, and where."""
        at = np.minimum(np.searchsorted(self.seg_key, keys), len(self.seg_key) - 1)
        there = np.flatnonzero(self.seg_key[at] == keys)
        return there, at[there]

    def retrieve(self, word: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, item position and score of every pair whose score reaches the item's least one; ``word`` and ``query`` are word hashes and their queries."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(self.terms) or not len(word):
            return none
        term = np.minimum(np.searchsorted(self.terms, word), len(self.terms) - 1)
        known = self.terms[term] == word
        pair = np.sort(query[known].astype(np.int64) * len(self.terms) + term[known])
        pair = pair[_starts(pair)]
        q, t = pair // len(self.terms), pair % len(self.terms)
        lowest = self.block_least.min()
        heads = _starts(q)
        good = np.repeat(np.add.reduceat(self.most[t], heads) >= lowest, np.diff(np.append(heads, len(q)))) if len(q) else np.zeros(0, bool)
        q, t = q[good], t[good]
        if not len(q):
            return none
        # Terms of a query by their largest weight: the first ones that stay below every threshold together open nothing.
        by = np.lexsort((self.most[t], q))
        q, t = q[by], t[by]
        heads = _starts(q)
        sizes = np.diff(np.append(heads, len(q)))
        run = np.cumsum(self.most[t])
        run -= np.repeat(run[heads] - self.most[t[heads]], sizes)
        opens = np.flatnonzero(run >= lowest)
        counts = self.seg_at[t[opens] + 1] - self.seg_at[t[opens]]
        block = self.seg_key[_ranges(self.seg_at[t[opens]], counts)] % self.blocks
        opened = np.sort(np.repeat(q[opens], counts) * self.blocks + block)
        opened = opened[_starts(opened)]
        # Bound of each opened block over all terms of its query.
        first = np.searchsorted(q, opened // self.blocks)
        count = np.searchsorted(q, opened // self.blocks, side="right") - first
        owner, at = np.repeat(np.arange(len(opened)), count), _ranges(first, count)
        there, seg = self._segments(t[at] * self.blocks + opened[owner] % self.blocks)
        bound = np.bincount(owner[there], self.seg_max[seg], len(opened))
        reach = bound >= self.block_least[opened % self.blocks]
        live = reach[owner[there]]
        owner, seg = owner[there][live], seg[live]
        sizes = self.seg_size[seg]
        post = _ranges(self.seg_start[seg], sizes)
        key = np.repeat(opened[owner] // self.blocks, sizes) * len(self.ids) + self.post_item[post]
        by = np.argsort(key, kind="stable")
        key = key[by]
        heads = _starts(key)
        if not len(heads):
            return none
        scores = np.add.reduceat(self.post_weight[post][by].astype(np.float64), heads)
        found, item = key[heads] // len(self.ids), key[heads] % len(self.ids)
        hit = np.flatnonzero(scores >= self.least[item])
        return found[hit], item[hit], scores[hit]

    def shared(self, text: np.ndarray, item: int) -> tuple[int, float, float | None] | None:
        """Words of the longest run that a text shares with an item, the share of the item's words in shared runs, and that of the words behind its question; None without a run."""
        own, run = self.hashes[item], self.run
        grams, others = _grams(own, run), _grams(text, run)
        if not len(others):
            return None
        where: dict[int, list[int]] = {}
        for j in np.flatnonzero(np.isin(others, grams)).tolist():
            where.setdefault(int(others[j]), []).append(j)
        if not where:
            return None
        best, covered = 0, np.zeros(len(own), bool)
        before: dict[int, int] = {}
        for i, gram in enumerate(grams.tolist()):
            now = {j: before.get(j - 1, 0) + 1 for j in where.get(gram, ())}
            if now:
                covered[i : i + run] = True
                best = max(best, max(now.values()))
            before = now
        answer = covered[self.answers[item] :]
        return best + run - 1, float(covered.mean()), float(answer.mean()) if len(answer) else None


def _indexes(items: DataFrame, item_id: str, item_text: str, run: int) -> Iterator[BlockMaxIndex]:
    """Indexes of bounded size over all items, read one partition at a time."""
    held: list[tuple[int, str]] = []
    size = 0
    rows = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(item_id, item_text).dropDuplicates()
    for row in rows.toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1])
        if size >= INDEX_CHARS:
            yield BlockMaxIndex(held, run)
            held, size = [], 0
    yield BlockMaxIndex(held, run)


def search_texts(index: BlockMaxIndex, texts: list[str | None]) -> list[tuple[int, int, float, int, float, float | None]]:
    """(text, item position, best passage's score, run words, covered, answer covered) of the leaked items."""
    out = []
    for first in range(0, len(texts), GROUP):
        word, owner = word_hashes(texts[first : first + GROUP])
        if not len(word):
            continue
        bounds = np.searchsorted(owner, np.arange(min(GROUP, len(texts) - first) + 1))
        place = np.arange(len(word)) - bounds[owner]
        # A word is in the passage that it falls into and, among its first words, in the one before too.
        step = PASSAGE - index.run + 1
        passage = place // step
        again = np.flatnonzero((place % step < index.run - 1) & (passage > 0))
        per = int(passage.max()) + 1
        query = np.concatenate([owner * per + passage, owner[again] * per + passage[again] - 1])
        q, item, score = index.retrieve(np.concatenate([word, word[again]]), query)
        best: dict[tuple[int, int], float] = {}
        for d, i, s in zip((q // per).tolist(), item.tolist(), score.tolist()):
            best[d, i] = max(s, best.get((d, i), 0.0))
        for (d, i), s in sorted(best.items()):
            found = index.shared(word[bounds[d] : bounds[d + 1]], i)
            if found:
                out.append((first + d, i, s, *found))
    return out


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    run: int = RUN,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, score, run_words, covered, answer_covered)`` for each document with ``run`` consecutive words of an item.

    ``score`` is that of the best passage, ``run_words`` the longest shared run, ``covered`` the
    share of the item's words in shared runs, and ``answer_covered`` that of the words behind its
    question mark or before its options end; null for an item without such a part. Null and
    empty texts and items of fewer than ``run`` words have no cases; repeated rows give repeated
    cases. Words are compared by 64-bit hashes. The corpus is scanned once per index and never
    shuffled. Items are sent in indexes of at most ``INDEX_CHARS`` characters, so what is
    broadcast is bounded however many items there are.
    """
    spark = documents.sparkSession
    schema = FOUND.format(key=documents.schema[doc_id].dataType.simpleString(), item=items.schema[item_id].dataType.simpleString())
    corpus = documents.where(F.length(doc_text) > 0).select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    found = None
    for index in _indexes(items, item_id, item_text, run):
        shared = spark.sparkContext.broadcast(index)
        item_type = pa.int64() if items.schema[item_id].dataType.simpleString() in ("bigint", "long") else None

        def search(batches: Iterator[pa.RecordBatch], shared=shared, item_type=item_type) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                hits = search_texts(index, batch.column(1).to_pylist())
                at, item, scores, runs, covered, answers = zip(*hits) if hits else ((),) * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at, pa.int64())),
                        pa.array([index.ids[i] for i in item], item_type),
                        pa.array(scores, pa.float64()),
                        pa.array(runs, pa.int32()),
                        pa.array(covered, pa.float64()),
                        pa.array(answers, pa.float64()),
                    ],
                    names=["doc_id", "item_id", "score", "run_words", "covered", "answer_covered"],
                )

        part = corpus.mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    return found
