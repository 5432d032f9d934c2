"""Abusive, hateful or sexual content, scored by the nearest labelled passages.

A document is as abusive as its worst passage. A passage is scored by its nearest labelled
passages in exact TF-IDF cosine, each voting with the square of its similarity; the
nearest one is the evidence. Examples lie in an inverted index whose blocks keep the
largest weight of every feature. A passage that can reach no abusive example is settled by
a bound; for the others the block maxima of their features close most blocks, features that
cannot make a passage near even together name no candidates, and only what is left is scored.

Labels are of documents, noisy, and an abusive document is mostly harmless text. So the
passages of abusive documents are edited by their own neighbours: those that look like
passages of harmless documents become harmless examples. Labelled documents are scored
once more without their own passages, which gives the probability that belongs to a score.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.core.runtime import cores

#: Labelled documents that examples are taken from, at most, in the order of a hash of their id.
MOST_ABUSIVE, MOST_OTHER = 1_200, 6_000
NEIGHBOURS = 11
#: Rounds of editing the examples.
EDITS = 3
#: Similarity below which an example says nothing about a passage.
NEAR = 0.22
THRESHOLD = 0.5
BLOCK = 64

_INVISIBLE = dict.fromkeys([0xAD, 0x180E, 0xFEFF, 0x2060, *range(0x200B, 0x2010), *range(0x202A, 0x202F)])
# Letters of other scripts that look like Latin ones; a fixed value.
_ALIKE = str.maketrans("абвгеёзкмнорстухіїјѕԁαβεικνορτυχ", "aбbгeeзkmнopcтyxiijsdaбeikvoptux")
_LEET = str.maketrans("013457@$!€|", "oieastasiel")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*]){2,}[^\W_](?![^\W_])")
_WORD = re.compile(r"(?:[@$€](?=[^\W\d_]))?[^\W_]+(?:[@$!€|*]+[^\W_]+)*[@$€*]*")
_RUNS = re.compile(r"(.)\1+")
_END = re.compile(r"(?<=[.!?…。])[\"'”»)]*\s+|\n+")
_MARKUP = re.compile(r"<[^<>]{1,40}>|&[a-z]{2,6};")
_FOLDED = {**_INVISIBLE, **_ALIKE}
_TO_FOLD = re.compile("[" + "".join(re.escape(chr(c)) for c in _FOLDED) + "]")


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which code points are combining marks; which are letters or digits; which ASCII ones part spaced letters."""
    points = [chr(c) for c in range(sys.maxunicode + 1)]
    marks, alnum = (np.fromiter(map(f, points), bool, len(points)) for f in (unicodedata.combining, str.isalnum))
    return marks, alnum, np.isin(np.arange(128), [ord(c) for c in " .-_*"])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _text(codes: np.ndarray) -> str:
    return codes.tobytes().decode("ascii") if codes.dtype == np.uint8 else codes.tobytes().decode("utf-32-le", "surrogatepass")


def plain_text(text: str) -> str:
    """A text in lower case with its disguises taken off: look-alikes, stretched and spaced letters, accents, invisible characters."""
    marks, alnum, parting = _tables()
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_FOLDED) if _TO_FOLD.search(text) else text)
    codes = _codes(text)
    if codes.dtype != np.uint8 and (mark := marks[codes]).any():
        codes = codes[~mark]
        text = ""
    letter = alnum[codes]
    alone = letter.copy()
    alone[1:] &= ~letter[:-1]
    alone[:-1] &= ~letter[1:]
    # Three single letters with a parting character between them make a spaced word.
    three = np.flatnonzero(alone[:-4] & alone[2:-2] & alone[4:])
    if len(three) and (parting[np.minimum(codes[three + 1], 127)] & parting[np.minimum(codes[three + 3], 127)]).any():
        text = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()), text or _text(codes))
        codes = _codes(text)
    once = np.ones(len(codes), bool)
    once[1:] = (codes[1:] != codes[:-1]) | (codes[1:] == 10)
    return text if text and once.all() else _text(codes[once])


def _words(plain: str) -> list[str]:
    out = []
    for word in _WORD.findall(plain):
        if not word.isalpha():
            # Numbers, numbers with a unit and codes say nothing.
            if word.isdigit() or word[0].isdigit() and (word[1].isdigit() or word[1] == "x"):
                continue
            word = _RUNS.sub(r"\1", word.translate(_LEET))
        out.append(word)
    return out


def plain_words(text: str) -> list[str]:
    return _words(plain_text(text))


def passages(text: str) -> list[list[str]]:
    """The words of each sentence or line of a text; those of fewer than two words join the next."""
    out, held = [], []
    for part in _END.split(plain_text(text)):
        if not part:
            continue
        held = held + _words(part)
        if len(held) >= 2:
            # A long line is taken in overlapping stretches, so that one abusive clause in it is not thinned out.
            if len(held) <= 40:
                out.append(held)
            else:
                out.extend(held[k : k + 30] for k in range(0, len(held) - 9, 20))
            held = []
    if held:
        out.append(held)
    return out


def features(words: list[str]) -> list[str]:
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]


class Values:
    """A value for some features; pairs are looked up by their words, without joining them."""

    def __init__(self, values: dict[str, float]):
        self.single: dict[str, float] = {}
        self.pairs: dict[str, dict[str, float]] = {}
        for f, v in values.items():
            a, space, b = f.partition(" ")
            if space:
                self.pairs.setdefault(a, {})[b] = v
            else:
                self.single[f] = v

    def of(self, words: list[str]) -> list[float]:
        single, pairs = self.single, self.pairs
        out = [single[w] for w in words if w in single]
        for k, word in enumerate(words[:-1]):
            if word in pairs:
                v = pairs[word].get(words[k + 1])
                if v is not None:
                    out.append(v)
        return out


class Examples:
    """Labelled passages as unit TF-IDF vectors in an inverted index of blocks.

    A feature's posting list is cut into segments, one for each block of examples that holds
    it, with the largest weight of each segment.
    """

    def __init__(
        self, texts: list[list[str]], abusive: np.ndarray, documents: np.ndarray, vocabulary: dict[str, int], idf: np.ndarray, unknown: float, owners: list[tuple] | None = None
    ):
        # Like examples share a block, which keeps the maxima low, and those of abusive documents come first. Of each distinct passage: in how many abusive documents it stands, and in how many at all.
        order = sorted(range(len(texts)), key=lambda k: (not abusive[k], texts[k][:3]))
        self.texts = [texts[k] for k in order]
        self.abusive, self.documents = (np.asarray(x, np.float64)[order] for x in (abusive, documents))
        self.owners = [owners[k] for k in order] if owners else [()] * len(texts)
        self.labels = self.abusive > 0
        self.vocabulary, self.idf, self.unknown = vocabulary, idf, unknown
        rows, cols, weights = [], [], []
        for k, words in enumerate(self.texts):
            ids, w = self.vector(words)
            rows.append(np.full(len(ids), k, np.int64))
            cols.append(ids)
            weights.append(w)
        row, col, weight = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rows, np.int64), (cols, np.int64), (weights, np.float64)))
        by = np.lexsort((row, col))
        row, col = row[by], col[by]
        self.post_row, self.post_weight = row.astype(np.int32), weight[by].astype(np.float32)
        self.blocks = max(1, -(-len(texts) // BLOCK))
        key = col * self.blocks + row // BLOCK
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.seg_at = np.searchsorted(col[heads], np.arange(len(vocabulary) + 1))
        self.seg_block = (row[heads] // BLOCK).astype(np.int64)
        self.post_at = np.searchsorted(col, np.arange(len(vocabulary) + 1))
        self.post_key = col * len(texts) + row
        self.most = np.maximum.reduceat(self.post_weight, self.post_at[:-1]).astype(np.float64) if len(vocabulary) else np.zeros(0)
        self.seg_max = np.maximum.reduceat(self.post_weight, heads) if len(heads) else np.zeros(0, np.float32)
        self.bound()

    def vector(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Known features and their weights in the unit vector, of which unknown ones are a part too."""
        counts: dict[int, int] = {}
        rest = 0.0
        for f in features(words):
            k = self.vocabulary.get(f)
            if k is None:
                rest += self.unknown * self.unknown
            else:
                counts[k] = counts.get(k, 0) + 1
        ids = np.fromiter(counts, np.int64, len(counts))
        w = self.idf[ids] * (1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))) if counts else np.zeros(0)
        norm = np.sqrt((w * w).sum() + rest)
        return ids, w / norm if norm > 0 else w

    def bound(self) -> None:
        """Largest weight of each feature in abusive examples, and the blocks that hold any."""
        bad = self.labels[self.post_row]
        best = np.zeros(len(self.vocabulary), np.float32)
        np.maximum.at(best, self.post_key[bad] // len(self.texts), self.post_weight[bad])
        names = list(self.vocabulary)
        self.reach = Values({names[k]: float(best[k]) ** 2 for k in np.flatnonzero(best)})
        # Segments of the blocks that hold abusive examples, which are the first ones of every posting list.
        self.bad_blocks = int(np.flatnonzero(self.labels).max(initial=-1)) // BLOCK + 1
        early = np.concatenate([[0], np.cumsum(self.seg_block < self.bad_blocks)])
        self.bad_segments = early[self.seg_at[1:]] - early[self.seg_at[:-1]]

    def near(self, words: list[str]) -> bool:
        """Whether a passage may be similar to an abusive example at all.

        Its weights have norm 1 at most, so its product with the largest weights of its
        features is at most the norm of those.
        """
        return sum(self.reach.of(words)) >= NEAR * NEAR

    def nearest(self, ids: np.ndarray, w: np.ndarray, without: object = None, only_bad: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples of a passage and their similarities, of at least ``NEAR``; none where no abusive one can be that near."""
        none = np.zeros(0, np.int64), np.zeros(0, np.float32)
        if only_bad:
            counts = self.bad_segments[ids]
            seg = np.repeat(self.seg_at[ids] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            if not len(seg) or np.bincount(self.seg_block[seg], np.repeat(w, counts) * self.seg_max[seg]).max() < NEAR - 1e-6:
                return none
        counts = self.seg_at[ids + 1] - self.seg_at[ids]
        seg = np.repeat(self.seg_at[ids] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        bounds = np.bincount(self.seg_block[seg], np.repeat(w, counts) * self.seg_max[seg], self.blocks)
        open_ = bounds >= NEAR - 1e-6
        # Features that can give no more than a part of that together name no candidates; they are looked up for those that the others bring far enough.
        order = np.argsort(w * self.most[ids])
        ids, w = ids[order], w[order].astype(np.float32)
        reach = np.cumsum(w * self.most[ids])
        few = int(np.searchsorted(reach, 0.2 * NEAR))
        counts = self.post_at[ids[few:] + 1] - self.post_at[ids[few:]]
        at = np.repeat(self.post_at[ids[few:]] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        rows = self.post_row[at]
        kept = np.flatnonzero(open_[rows // BLOCK])
        if not len(kept):
            return none
        sums = np.bincount(rows[kept], np.repeat(w[few:], counts)[kept] * self.post_weight[at[kept]], len(self.texts))
        rows = np.flatnonzero(sums >= NEAR - 1e-6 - (reach[few - 1] if few else 0.0))
        rows = rows[sums[rows] > 0]
        if without is not None and len(rows):
            rows = rows[np.array([self.owners[k] != (without,) for k in rows], bool)]
        if not len(rows):
            return none
        scores = sums[rows]
        if few:
            key = (ids[:few, None] * len(self.texts) + rows).ravel()
            place = np.minimum(np.searchsorted(self.post_key, key), len(self.post_key) - 1)
            scores = scores + (np.where(self.post_key[place] == key, self.post_weight[place], 0).reshape(few, -1) * w[:few, None]).sum(axis=0)
        near = np.flatnonzero(scores >= NEAR)
        top = near[np.lexsort((rows[near], -scores[near]))[:NEIGHBOURS]]
        return rows[top], scores[top]

    def score(self, words: list[str], without: object = None) -> tuple[float, int]:
        """Share of the votes of the nearest examples that say abusive, and the nearest of those; ``without`` leaves out the passages of one document."""
        if not self.labels.any() or not self.near(words):
            return 0.0, -1
        near, scores = self.nearest(*self.vector(words), without)
        bad = self.labels[near]
        if not bad.any():
            return 0.0, -1
        votes = scores.astype(np.float64) ** 2
        return float(votes[bad].sum() / votes.sum()), int(near[bad][np.argmax(scores[bad])])

    def edited(self, around: dict[int, tuple[np.ndarray, np.ndarray]]) -> Examples:
        """Examples that keep the label abusive only where their neighbours, and their own other documents, share it; ``around`` has the neighbours of those labelled so."""
        for _ in range(EDITS):
            trusted = np.where(self.labels, self.abusive, 0.0)  # what the former round left
            new = self.labels.copy()
            for k in np.flatnonzero(self.labels).tolist():
                near, scores = around[k]
                weight = scores.astype(np.float64) ** 2
                own = near == k  # without the document that the passage was taken from
                votes = (weight * (self.documents[near] - own)).sum()
                new[k] = votes > 0 and (weight * (trusted[near] - own)).sum() / votes >= 0.5
            self.labels = new
        self.bound()
        return self


def _best_passage(examples: Examples, text: str | None, without: object = None) -> tuple[float, list[str], int]:
    """Score, words and evidence of the worst passage of a text."""
    best: tuple[float, list[str], int] = (0.0, [], -1)
    for words in passages(text) if text else ():
        value, nearest = examples.score(words, without)
        if value > best[0]:
            best = value, words, nearest
    return best


def calibrated(scores: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores in order and the probability of each, never falling: neighbours that would fall are pooled."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum, count, highest score
    for x, y in zip(scores[order].tolist(), truth[order].tolist()):
        if blocks and blocks[-1][2] == x:
            blocks[-1][0] += y
            blocks[-1][1] += 1
        else:
            blocks.append([float(y), 1, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], last[2]]
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text, abusive)`` of the bounded sample of labelled documents; contradictory labels count by majority, ties not at all."""
    votes = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.avg("toxic").alias("y")).where("y <> 0.5")
    votes = votes.select("doc_id", (F.col("y") > 0.5).alias("abusive"), F.xxhash64("doc_id").alias("_h"))
    bad = votes.where("abusive").orderBy("_h", "doc_id").limit(MOST_ABUSIVE)
    good = votes.where("NOT abusive").orderBy("_h", "doc_id").limit(MOST_OTHER)
    sample = F.broadcast(bad.unionByName(good).select("doc_id", "abusive"))  # 7,200 rows at most
    return documents.where(F.length("text") > 0).select("doc_id", "text").join(sample, "doc_id")


def fit(documents: DataFrame, labels: DataFrame) -> Examples:
    """The example index; feature frequencies are counted over all documents."""
    spark = documents.sparkSession
    rows = sorted((r[0], r[1], r[2]) for r in labelled(documents, labels).dropDuplicates(["doc_id"]).collect())
    seen: dict[tuple, list] = {}
    for doc, text, abusive in rows:
        for words in {tuple(words) for words in passages(text)}:
            counts = seen.setdefault(words, [0, 0, []])
            counts[0] += abusive
            counts[1] += 1
            counts[2].append(doc)
    texts = [list(words) for words in seen]
    vocabulary: dict[str, int] = {}
    for words in texts:
        for f in features(words):
            vocabulary.setdefault(f, len(vocabulary))
    shared = spark.sparkContext.broadcast(Values(vocabulary))

    size = len(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            found: list[int] = []
            for text in batch.column(0).to_pylist():
                found.extend({f for words in passages(text) for f in known.of(words)})
                total[-1] += 1
            if found:
                total[:-1] += np.bincount(np.array(found), minlength=size)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["f", "n"])

    counts = documents.where(F.length("text") > 0).select("text").mapInArrow(count, "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n"))
    df = np.zeros(len(vocabulary) + 1)
    for f, n in counts.collect():  # one row per feature of the bounded sample
        df[f] = n
    docs = max(1.0, df[-1])
    idf = np.log((1 + docs) / (1 + df[:-1])) + 0.1
    counted = np.array([x[:2] for x in seen.values()] or np.zeros((0, 2)))
    examples = Examples(texts, counted[:, 0], counted[:, 1], vocabulary, idf, float(np.log(1 + docs)) + 0.1, [tuple(x[2]) for x in seen.values()])
    return examples.edited(_around(spark, examples))


def _around(spark: SparkSession, examples: Examples) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The neighbours of each example labelled abusive, found by the executors; a bounded sample, as the examples are."""
    shared = spark.sparkContext.broadcast(examples)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.nearest(*own.vector(own.texts[k]), only_bad=False) for k in batch.column(0).to_pylist()]
            rows, scores = (pa.array([x[i].tolist() for x in found], kind) for i, kind in ((0, pa.list_(pa.int64())), (1, pa.list_(pa.float64()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, scores], names=["id", "near", "scores"])

    bad = int(np.flatnonzero(examples.labels).max(initial=-1)) + 1  # these come first
    out = spark.range(0, bad, 1, cores(spark)).mapInArrow(search, "id bigint, near array<bigint>, scores array<double>").collect() if bad else []
    return {r[0]: (np.array(r[1], np.int64), np.array(r[2])) for r in out}


def held_out_scores(documents: DataFrame, labels: DataFrame, shared) -> DataFrame:
    """``(doc_id, abusive, score)`` of the labelled sample, each document scored without its own passages."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_best_passage(shared.value, t, d)[0] for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.float64())], names=["doc_id", "abusive", "score"])

    return labelled(documents, labels).select("doc_id", "text", "abusive").mapInArrow(score, f"doc_id {kind}, abusive boolean, score double")


def abuse_scores(documents: DataFrame, labels: DataFrame, calibrate: bool = False) -> DataFrame:
    """``(doc_id, source, score, passage, evidence)`` for every document, with ``calibrate`` also ``probability``.

    The score is that of the worst passage, 0 for a null, empty or blank text; ``passage``
    (its words) and ``evidence`` (the words of the nearest abusive example) are null where
    the score is 0. ``probability`` is the share of abusive labels among labelled documents of
    such a score, which were scored without their own passages; null without any labels.
    Without any abusive label all scores are 0. Labels other than 0 and 1 and those of unknown
    documents are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))
    kind = documents.schema["doc_id"].dataType.simpleString()
    steps: tuple[np.ndarray, np.ndarray] = np.zeros(0), np.zeros(0)
    if calibrate:
        held = [(r[0], r[1]) for r in held_out_scores(documents, labels, shared).select("score", "abusive").collect()]  # MOST_ABUSIVE + MOST_OTHER rows
        steps = calibrated(np.array([x for x, _ in held]), np.array([y for _, y in held], float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = shared.value
        for batch in batches:
            best = [_best_passage(examples, t) for t in batch.column(2).to_pylist()]
            values = np.array([b[0] for b in best])
            place = np.minimum(np.searchsorted(steps[0], values), max(0, len(steps[0]) - 1))
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(values, pa.float64()),
                pa.array([" ".join(b[1]) if b[2] >= 0 else None for b in best], pa.string()),
                pa.array([" ".join(examples.texts[b[2]]) if b[2] >= 0 else None for b in best], pa.string()),
                pa.array(steps[1][place], pa.float64()) if len(steps[0]) else pa.nulls(batch.num_rows, pa.float64()),
            ]
            names = ["doc_id", "source", "score", "passage", "evidence", "probability"]
            yield pa.RecordBatch.from_arrays(columns if calibrate else columns[:5], names=names if calibrate else names[:5])

    schema = f"doc_id {kind}, source string, score double, passage string, evidence string" + (", probability double" if calibrate else "")
    return documents.select("doc_id", "source", "text").mapInArrow(score, schema)


def abuse_rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(source, documents, abusive, rate)``; a null source is one source."""
    bad = F.col("score") >= threshold
    return scores.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(bad).alias("abusive"), F.avg(bad.cast("double")).alias("rate"))
