"""Near-duplicate texts by an LSH forest over word shingles.

Every tree of the forest is one order of all texts by one min-hash. The order is
range-partitioned; texts that share the min-hash form a region. The depth of a region
adapts to its size: a small one is compared whole, and a larger one goes on with longer
prefixes in several sub-orders of its own, so many that a pair at the threshold is missed
by all of them no more often than ``MISS``. A region is never cut off. The sub-orders of one
that would outgrow a task are dealt out before the shuffle, the same ones that a task would
compare, by counts of all texts; so where a region is compared changes no pair.

Each tree carries a bit sketch of its own choice of min-hashes. A pair at the threshold
meets in most of its trees under sketches that differ, so each may judge tightly. What any
tree lets through is verified on the whole shingle sets. Equal texts are one class before
they meet anything else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.core.runtime import cores, cut
from strataline.llm.words import word_hashes

TREES = 12
#: Min-hashes in all; a tree's sketch keeps two bits of ``SKETCH`` of them.
POOL, SKETCH = 288, 96
#: Texts of a region that are compared without going deeper.
REGION = 256
#: Share of the pairs at the threshold that the sub-orders of one large region may miss; other trees see them again.
MISS = 0.03
#: Deviations that a tree's sketch may differ by.
MARGIN = 2.5
#: Entries of one range of an order; more texts make more ranges.
RANGE_ROWS = 65_536
#: The sub-orders of a region of more texts are dealt out before the shuffle.
HOT_ROWS = 250_000
#: Members up to which a class of equal texts is written as all its pairs; a larger one as pairs with its least id.
EXPAND = 200
#: Bits of the filter of texts that need a second look: eight a text, up to this power of two; beyond it a join does it.
MOST_SEEN_BITS = 30
_SLICES = 64

_ENTRY = np.dtype([("key", "<u4"), ("ref", "<i8"), ("s0", "<u8"), ("s1", "<u8"), ("s2", "<u8"), ("n", "<u2")])
_MANY = 0x8000  # of n: the text occurs more than once
_U = np.uint64
_SETS = "id string, ref bigint, ref2 bigint, shingles array<int>"


def _constants(count: int, seed: int, kind: type) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, np.iinfo(kind).max, count, dtype=kind) | kind(1)


_MULTIPLY = _constants(POOL, 11, np.uint32)
_XOR = _constants(POOL, 12, np.uint32)
# The first min-hashes order the trees; a sketch takes any but its own tree's.
_OF_TREE = [np.random.default_rng([13, t]).permutation(np.delete(np.arange(POOL), t))[:SKETCH] for t in range(TREES)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values in order; sorting is many times as fast here as the hash table of ``np.unique``."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Shingler:
    """Distinct shingle hashes of many texts at once."""

    def __init__(self, size: int, least_words: int):
        self.size, self.least = size, max(least_words, size)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows kept; their shingles, sorted, in one array; and the offset of each row's."""
        word, owner = word_hashes(texts)
        counts = np.bincount(owner, minlength=len(texts))
        rows = np.flatnonzero(counts >= self.least)
        if not len(rows):
            none = np.zeros(0, np.int64)
            return none, none.astype(np.uint32), none
        place = np.full(len(texts), -1)
        place[rows] = np.arange(len(rows))
        at = place[owner]
        word, at = word[at >= 0], at[at >= 0]
        n = len(word) - self.size + 1
        rolled = word[:n].copy()
        for k in range(1, self.size):
            rolled = rolled * _U(0x9E3779B97F4A7C15) + word[k : n + k]
        whole = at[:n] == at[self.size - 1 :]
        keyed = _distinct((at[:n][whole].astype(np.uint64) << _U(32)) | (_mix(rolled[whole]) >> _U(32)))
        sizes = np.bincount((keyed >> _U(32)).astype(np.int64), minlength=len(rows))
        return rows, keyed.astype(np.uint32), np.cumsum(sizes) - sizes


def _signatures(shingles: np.ndarray, offsets: np.ndarray, functions: int = POOL) -> np.ndarray:
    """Min-hashes, one row per function; texts are taken in runs that stay in the processor's cache."""
    out = np.empty((functions, len(offsets)), dtype=np.uint32)
    ends = np.append(offsets[1:], len(shingles))
    a = 0
    while a < len(offsets):
        b = max(a + 1, int(np.searchsorted(ends, offsets[a] + 30_000, side="right")))
        part = shingles[offsets[a] : ends[b - 1]]
        at = offsets[a:b] - offsets[a]
        for f in range(functions):
            out[f, a:b] = np.minimum.reduceat((part ^ _XOR[f]) * _MULTIPLY[f], at)
        a = b
    return out


def _spread(hashes: np.ndarray) -> np.ndarray:
    """Min-hashes as keys that fill their range evenly."""
    return hashes * np.uint32(0x85EBCA6B)


#: Depth of the sub-orders, by tree and key, of the regions that are dealt out.
Hot = dict[int, dict[int, int]]


def _depth(size: np.ndarray) -> np.ndarray:
    """Depth of the sub-orders of large regions: of unlike texts three in ten agree in a bit pair; each text is left with some tens of them."""
    return np.clip(np.ceil(np.log(size / 64) / np.log(3.3)), 3, 16).astype(np.int64)


def _longer_prefix(sketch: list[np.ndarray], depth: int, number: int) -> np.ndarray:
    """Further ``depth`` bit pairs of a sub-order."""
    prefix = np.zeros(len(sketch[0]), np.int64)
    for f in np.random.default_rng([7, depth, number]).choice(SKETCH, depth, replace=False):
        prefix = (prefix << 2) | ((sketch[f // 32] >> _U(2 * (f % 32))) & _U(3)).astype(np.int64)
    return prefix


def _agree(threshold: float) -> float:
    """Share of the bit pairs in which a pair at the threshold agrees."""
    return (1 + 3 * threshold) / 4


def _orders(threshold: float, depth: int, miss: float = MISS) -> int:
    """Sub-orders of prefixes that a pair at the threshold shares ``depth`` more min-hashes in, so that few pairs share none."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**depth))


def _entries(signatures: np.ndarray, refs: np.ndarray, sizes: np.ndarray, many: np.ndarray, hot: Hot, threshold: float) -> Iterator[tuple[int | tuple[int, int, int], np.ndarray]]:
    """The entries of each tree; texts of a hot region come once for each of its sub-orders, named by tree, key and number, with their prefixes as keys."""
    pairs = ((signatures * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint64)
    count = (np.minimum(sizes, _MANY - 1) | (many * _MANY)).astype(np.uint16)
    for tree in range(TREES):
        entry = np.empty(len(refs), dtype=_ENTRY)
        entry["key"], entry["ref"], entry["n"] = _spread(signatures[tree]), refs, count
        for k in range(3):
            word = np.zeros(len(refs), np.uint64)
            for bit, f in enumerate(_OF_TREE[tree][32 * k : 32 * k + 32]):
                word |= pairs[f] << _U(2 * bit)
            entry[f"s{k}"] = word
        if hot.get(tree):
            keys = np.array(sorted(hot[tree]), np.uint32)
            dealt = np.isin(entry["key"], keys)
            for key in np.intersect1d(entry["key"][dealt], keys).tolist():
                own, depth = entry[entry["key"] == np.uint32(key)], hot[tree][key]
                for number in range(_orders(_agree(threshold), depth)):
                    part = own.copy()
                    part["key"] = _longer_prefix([own[s] for s in ("s0", "s1", "s2")], depth, number)
                    yield (tree, key, number), part
            entry = entry[~dealt]
        if len(entry):
            yield tree, entry


def _dealt_parts(hot: Hot, ranges: int, threshold: float) -> dict[tuple[int, int], tuple[int, int, int]]:
    """First part, parts to a sub-order and depth of each hot region; its parts follow those of the trees."""
    out, at = {}, TREES * ranges
    for tree, keys in sorted(hot.items()):
        for key, depth in sorted(keys.items()):
            pieces = max(1, math.ceil(64 * 3.3**depth / RANGE_ROWS))
            out[tree, key] = at, pieces, depth
            at += pieces * _orders(_agree(threshold), depth)
    return out


def _grow(ranges: int, size: int, least_words: int, threshold: float, hot: Hot):
    """Map side: the entries of each tree, packed by range of the order, equal texts of a batch as one."""
    dealt = _dealt_parts(hot, ranges, threshold)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size, least_words)
        for batch in batches:
            rows, shingles, offsets = shingler(batch.column(1).to_pylist())
            if not len(rows):
                continue
            refs = batch.column(0).to_numpy()[rows]
            sizes = np.diff(np.append(offsets, len(shingles)))
            order = np.argsort(refs, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], refs[order][1:] != refs[order][:-1]]))
            copies = np.diff(np.append(first, len(refs)))
            own = order[first]
            parts, blobs = [], []
            for place, entry in _entries(_signatures(shingles, offsets)[:, own], refs[own], sizes[own], copies > 1, hot, threshold):
                entry = entry[np.argsort(entry["key"])]
                if isinstance(place, tuple):
                    start, pieces, depth = dealt[place[:2]]
                    start, bits = start + place[2] * pieces, 2 * depth
                else:
                    start, pieces, bits = place * ranges, ranges, 32
                at = (entry["key"].astype(np.int64) * pieces) >> bits
                bounds = np.searchsorted(at, np.arange(pieces + 1))
                for r in np.flatnonzero(np.diff(bounds)):
                    parts.append(start + int(r))
                    blobs.append(entry[bounds[r] : bounds[r + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return grow


def _first_hashes(size: int, least_words: int):
    """How many texts of a batch have each first min-hash."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size, least_words)
        for batch in batches:
            rows, shingles, offsets = shingler(batch.column(0).to_pylist())
            keys = _spread(_signatures(shingles, offsets, TREES)).astype(np.int64) if len(rows) else np.zeros((TREES, 0), np.int64)
            code, n = np.unique(keys + (np.arange(TREES)[:, None] << 32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((code >> 32).astype(np.int32)), pa.array(code & 0xFFFFFFFF), pa.array(n)], names=["tree", "key", "n"])

    return hashes


def _texts_of(keys: Hot, size: int, least_words: int):
    """The texts that lie in some regions."""
    codes = np.array([(tree << 32) + key for tree, own in keys.items() for key in own], np.int64)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size, least_words)
        for batch in batches:
            rows, shingles, offsets = shingler(batch.column(1).to_pylist())
            if not len(rows):
                continue
            code = _spread(_signatures(shingles, offsets, TREES)).astype(np.int64) + (np.arange(TREES)[:, None] << 32)
            tree, at = np.nonzero(np.isin(code, codes))
            own = batch.column(0).take(pa.array(rows[at]))
            yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(code[tree, at] & 0xFFFFFFFF), own], names=["tree", "key", "ref"])

    return texts


def hot_regions(source: DataFrame, total: int, size: int, least_words: int) -> Hot:
    """Depth of the sub-orders of the regions of more than ``HOT_ROWS`` texts, by tree and key; all texts are counted, and equal ones once."""
    if total <= HOT_ROWS:
        return {}  # no region can have more texts than there are
    counted = source.select("content").mapInArrow(_first_hashes(size, least_words), "tree int, key bigint, n bigint").groupBy("tree", "key").agg(F.sum("n").alias("n"))
    large: Hot = {}
    for tree, key, _ in counted.where(F.col("n") > HOT_ROWS).collect():  # at most TREES * total / HOT_ROWS
        large.setdefault(tree, {})[key] = 0
    if not large:
        return {}
    refs = source.select(F.xxhash64("content").alias("ref"), "content").mapInArrow(_texts_of(large, size, least_words), "tree int, key bigint, ref bigint").distinct()
    hot: Hot = {}
    for tree, key, count in refs.groupBy("tree", "key").count().where(F.col("count") > HOT_ROWS).collect():
        hot.setdefault(tree, {})[key] = int(_depth(np.array([count]))[0])
    return hot


class _Order:
    """Entries of one tree, compared under its sketches."""

    def __init__(self, entry: np.ndarray, threshold: float):
        self.sketch = [entry[s].copy() for s in ("s0", "s1", "s2")]
        self.number = (entry["n"] & (_MANY - 1)).astype(np.int64)
        # Counts of very long texts are clipped, so such a text is ruled out by no count.
        self.largest = np.minimum((self.number / threshold + 1e-3).astype(np.int64), _MANY - 1)
        self.agree = _agree(threshold)
        self.apart = int(SKETCH * (1 - self.agree) + MARGIN * math.sqrt(SKETCH * self.agree * (1 - self.agree)))

    def pairs(self, own: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of entries of one group that sizes and sketches leave possible. In a group texts go by size, and each meets the larger ones up to the size that the threshold allows."""
        key = group * _MANY + self.number[own]
        order = np.argsort(key)
        own, key, group = own[order], key[order], group[order]
        left = np.searchsorted(key, group * _MANY + self.largest[own], side="right") - 1 - np.arange(len(own))
        sketch = [s[own] for s in self.sketch]
        one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at, step = np.flatnonzero(left > 0), 1
        while len(at):
            to = at + step
            apart = np.zeros(len(at), np.uint8)
            for s in sketch:
                d = s[at] ^ s[to]
                apart += np.bitwise_count((d | (d >> _U(1))) & _U(0x5555555555555555))
            hit = np.flatnonzero(apart <= self.apart)
            one.append(own[at[hit]])
            two.append(own[to[hit]])
            step += 1
            at = at[left[at] >= step]
        return np.concatenate(one), np.concatenate(two)


def candidate_pairs(entry: np.ndarray, threshold: float, most: int = REGION) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts of one region that their sizes and sketches leave possible; a text with copies also pairs with itself."""
    entry = entry[np.lexsort((entry["ref"], entry["key"]))]
    same = np.concatenate([[False], (entry["ref"][1:] == entry["ref"][:-1]) & (entry["key"][1:] == entry["key"][:-1])])
    twins = _distinct(np.concatenate([entry["ref"][same], entry["ref"][entry["n"] >= _MANY]]))
    entry = entry[~same]
    heads = np.flatnonzero(np.concatenate([[True], entry["key"][1:] != entry["key"][:-1]]))
    counts = np.diff(np.append(heads, len(entry)))
    region, size = np.repeat(np.arange(len(heads)), counts), np.repeat(counts, counts)
    order = _Order(entry, threshold)
    small = np.flatnonzero((size > 1) & (size <= most))
    found = [order.pairs(small, region[small])]
    depth = np.zeros(len(size), np.int64)
    depth[size > most] = _depth(size[size > most])
    for levels in set(depth[depth > 0].tolist()):
        own = np.flatnonzero(depth == levels)
        group = np.cumsum(np.concatenate([[0], region[own][1:] != region[own][:-1]]))  # numbered afresh, so that prefixes fit in
        for number in range(_orders(order.agree, levels)):
            found.append(order.pairs(own, (group << (2 * levels)) | _longer_prefix([s[own] for s in order.sketch], levels, number)))
    one, two = (np.concatenate(x) for x in zip(*found))
    pair = _distinct(np.minimum(one, two) * len(entry) + np.maximum(one, two))
    a, b = entry["ref"][pair // max(1, len(entry))], entry["ref"][pair % max(1, len(entry))]
    apart = a != b  # a text of a hot region may meet itself under two keys
    a, b = a[apart], b[apart]
    return np.concatenate([np.minimum(a, b), twins]), np.concatenate([np.maximum(a, b), twins])


def _meet(threshold: float, ranges: int):
    """Reduce side: the ranges of a partition, one at a time."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs = None, []

        def pairs() -> pa.RecordBatch:
            entry = np.frombuffer(b"".join(blobs), dtype=_ENTRY)
            dealt = current >= TREES * ranges  # one sub-order of a region, which goes no deeper
            low, high = candidate_pairs(entry, threshold, len(entry) if dealt else REGION)
            if current >= ranges and not dealt:  # of whole regions, copies are reported by the first tree only
                low, high = low[low != high], high[low != high]
            return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != current:
                    if blobs:
                        yield pairs()
                    current, blobs = part, []
                blobs.append(blob.as_py())
        if blobs:
            yield pairs()

    return meet


def _slices(bits: int):
    width = (1 << bits) // _SLICES

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = batch.column(1).to_numpy()
            for s in _distinct(bit // width):
                own = bit[bit // width == s] - s * width
                np.bitwise_or.at(maps.setdefault(int(s), np.zeros(width // 8, np.uint8)), own >> 3, (128 >> (own & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int32()), pa.array([b.tobytes() for b in maps.values()], pa.binary())], names=["slice", "bits"])

    return slices


def _seen(refs: DataFrame, bits: int) -> np.ndarray:
    """A bit for the hash of each text in candidate pairs; texts outside it need no second look."""
    width = (1 << bits) // _SLICES
    bit = F.pmod(F.col("ref"), F.lit(1 << bits)).cast("bigint")
    placed = refs.select((bit / width).cast("int").alias("slice"), bit.alias("bit"))
    seen = np.zeros((_SLICES, width // 8), np.uint8)
    for row in placed.repartition(_SLICES // 8, "slice").mapInArrow(_slices(bits), "slice int, bits binary").toLocalIterator():  # 64 rows in all, of 2 MB at most
        seen[row[0]] |= np.frombuffer(row[1], np.uint8)
    return seen.ravel()


def _sets(shared, bits: int, size: int, least_words: int):
    """Shingle sets of the texts that the filter lets through; of all, without one."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value if shared else None
        shingler = Shingler(size, least_words)
        for batch in batches:
            if seen is not None:
                bit = batch.column(1).to_numpy() & ((1 << bits) - 1)
                batch = batch.filter(pa.array(((seen[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1).astype(bool)))
            rows, shingles, offsets = shingler(batch.column(3).to_pylist())
            part = batch.take(pa.array(rows, pa.int64()))
            at = pa.array(np.append(offsets, len(shingles)).astype(np.int32))
            lists = pa.ListArray.from_arrays(at, pa.array(shingles.view(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], names=["id", "ref", "ref2", "shingles"])

    return sets


def similar_classes(texts: DataFrame, threshold: float = 0.8, shingle: int = 5, least_words: int = 0, key: str = "id", text: str = "content") -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal texts, and the members of all classes that have links or copies.

    The first frame is ``(a, a2, b, b2, similarity)``, one row per linked pair of classes; the
    second ``(id, ref, ref2)``. Similarity is the Jaccard similarity of the sets of distinct
    runs of ``shingle`` words, by 32-bit hashes. Texts with fewer words than ``least_words``
    or ``shingle``, and null and empty ones, take no part.
    """
    spark = texts.sparkSession
    source = texts.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(
        F.col(key).cast("string").alias("id"), F.xxhash64(text).alias("ref"), F.xxhash64(F.lit("second"), text).alias("ref2"), F.col(text).alias("content")
    )
    total = texts.count()
    ranges = max(1, -(-total // RANGE_ROWS))
    hot = hot_regions(source, total, shingle, least_words)
    grown = source.select("ref", "content").mapInArrow(_grow(ranges, shingle, least_words, threshold, hot), "part int, blob binary")
    tasks = max(cores(spark), TREES * -(-ranges // 4))
    pairs = grown.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_meet(threshold, ranges), "a bigint, b bigint")
    pairs = cut(pairs.distinct())
    refs = pairs.select(F.explode(F.array("a", "b")).alias("ref")).distinct()
    bits = max(20, math.ceil(math.log2(8 * max(1, 2 * pairs.count()))))
    if bits <= MOST_SEEN_BITS:
        found = source.mapInArrow(_sets(spark.sparkContext.broadcast(_seen(refs, bits)), bits, shingle, least_words), _SETS)
    else:
        found = source.join(refs, "ref", "left_semi").select("id", "ref", "ref2", "content").mapInArrow(_sets(None, bits, shingle, least_words), _SETS)
    members = cut(found)
    classes = members.groupBy("ref", "ref2").agg(F.any_value("shingles").alias("s"))
    one = classes.select(F.col("ref").alias("a"), F.col("ref2").alias("a2"), F.col("s").alias("sa"))
    two = classes.select(F.col("ref").alias("b"), F.col("ref2").alias("b2"), F.col("s").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").where("a <> b OR a2 < b2")
    shared_count = F.size(F.array_intersect("sa", "sb"))
    linked = both.select("a", "a2", "b", "b2", shared_count.alias("k"), (F.size("sa") + F.size("sb")).alias("n"))
    linked = linked.select("a", "a2", "b", "b2", (F.col("k") / (F.col("n") - F.col("k"))).alias("similarity")).where(F.col("similarity") >= threshold)
    return linked, members.select("id", "ref", "ref2")


def similar_pairs(texts: DataFrame, threshold: float = 0.8, shingle: int = 5, least_words: int = 0, key: str = "id", text: str = "content") -> DataFrame:
    """``(id_a, id_b)`` with ``id_a < id_b`` of texts whose similarity reaches the threshold.

    Equal texts count. A class of more than ``EXPAND`` equal texts is written as the pairs of
    its least id with the others, and is linked to other texts through that id. A key on
    several rows stands for all its texts; it is never paired with itself.
    """
    linked, members = similar_classes(texts, threshold, shingle, least_words, key, text)
    sized = members.groupBy("ref", "ref2").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    named = members.join(sized, ["ref", "ref2"])
    speakers = named.where((F.col("n") <= EXPAND) | (F.col("id") == F.col("least"))).select("id", "ref", "ref2")
    one = speakers.select(F.col("id").alias("x"), F.col("ref").alias("a"), F.col("ref2").alias("a2"))
    two = speakers.select(F.col("id").alias("y"), F.col("ref").alias("b"), F.col("ref2").alias("b2"))
    across = linked.select("a", "a2", "b", "b2").join(one, ["a", "a2"]).join(two, ["b", "b2"]).select("x", "y")
    few = named.where((F.col("n") > 1) & (F.col("n") <= EXPAND))
    within = few.select(F.col("id").alias("x"), "ref", "ref2").join(few.select(F.col("id").alias("y"), "ref", "ref2"), ["ref", "ref2"]).where("x < y").select("x", "y")
    star = named.where((F.col("n") > EXPAND) & (F.col("id") != F.col("least"))).select(F.col("least").alias("x"), F.col("id").alias("y"))
    pairs = across.unionByName(within).unionByName(star).where("x <> y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """``(id, group_id)``: connected groups of a pair list, named by their least id.

    Each round links every id to the least id it or its neighbours know and then jumps from
    that id to its own least, so rounds grow with the logarithm of a group's diameter.
    """
    ends = pairs.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = cut(ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct())
    known = cut(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("g")))
    while True:
        around = edges.join(known.select(F.col("x").alias("y"), F.col("g").alias("h")), "y").groupBy("x").agg(F.min("h").alias("h"))
        step = known.join(around, "x").select("x", "g", F.least("g", "h").alias("h"))
        jump = known.select(F.col("x").alias("h"), F.col("g").alias("j"))
        new = cut(step.join(jump, "h", "left").select("x", F.col("g").alias("old"), F.least("h", "j").alias("g")))
        if new.where("g <> old").isEmpty():
            return new.select(F.col("x").alias("id"), F.col("g").alias("group_id"))
        known = new.select("x", "g")
