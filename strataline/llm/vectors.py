"""Most similar vectors for every vector, exactly, or by shifted space-filling curves.

By default every row is compared with its whole collection: the rows of a collection are
dealt into blocks of bounded size, and all pairs of blocks are compared by matrix products.
Products of 32 bits only pick candidates; the ranking is by cosines of 64 bits.

A caller who can do without some neighbours may ask for curves (``exact=False``). Each
projects the unit vectors by its own random orthonormal matrix, shifts and quantises the
coordinates and takes the Hilbert index of the cell. Spark range-partitions and sorts the
rows of every curve by (collection, length, curve, index); blocks of neighbouring keys are
compared, and the best of all curves are merged and ranked again. How many curves a
collection needs and how wide their windows must be is measured on a bounded number of
probe rows. Where a window would have to hold about the whole collection, its blocks are
compared as above.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.core.runtime import cores

K = 5
#: Curves that a collection may have, and the least rows of a window block; a row meets its own block and the two beside it.
CURVES, WINDOW = (4, 8, 12), 96
AXES, BITS = 8, 7
#: Share of the probes' neighbours that the windows must hold.
TARGET = 0.999
#: Probe rows in all, and of one collection.
PROBES, OWN_PROBES = 2_048, 48
#: Cost of a row's copy on one more curve, in compared rows.
COPY = 256
#: Collections up to this size are one window.
SMALL = 512
#: Bytes of the vectors of a block; two blocks are in memory at a time.
BLOCK_BYTES = 8 << 20
TILE = 8 << 20  # similarities held at a time
RANKED = 1 << 16  # candidates ranked at a time

KEYED = "grp string, dims int, block int, blocks int, uuid string, vec binary"
PLACED = "grp string, dims int, curve int, place bigint, uuid string, width int, vec binary"
NEAR = "uuid string, near string, cosine double"


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of cell coordinates, by the published transposed-axes method, for all rows at once."""
    x = cells.T.astype(np.int64).copy()
    axes = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(axes):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn = np.where((x[-1] & bit) != 0, turn ^ (bit - 1), turn)
        bit >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def curve_places(unit: np.ndarray, curve: int, axes: int = AXES, bits: int = BITS) -> np.ndarray:
    """Index of unit vectors on one curve; the same matrix and shift in every task."""
    dims = unit.shape[1]
    rng = np.random.default_rng([curve, dims])
    axes = min(axes, dims)
    basis, _ = np.linalg.qr(rng.standard_normal((dims, axes)))
    shift = rng.random(axes)
    # A coordinate of a random direction has a deviation of 1 / sqrt(dims); four of them each way span the grid.
    at = (unit @ basis) * np.sqrt(dims) / 4.0
    cells = ((at + 1.0) * 0.5 * ((1 << bits) - 2) + shift).astype(np.int64)
    return hilbert_index(np.clip(cells, 0, (1 << bits) - 1), bits)


def unit_vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row positions and unit vectors of the usable rows, by vector length.

    Null, empty, all-zero, NaN-holding and infinite vectors, and those with a null element, are left out.
    """
    lengths = column.value_lengths().to_pandas().to_numpy(dtype=float, na_value=0)
    out = {}
    for dims in {int(x) for x in lengths if x > 0}:
        rows = np.flatnonzero(lengths == dims)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        with np.errstate(invalid="ignore", over="ignore"):
            norm = np.sqrt((flat * flat).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        if good.any():
            out[dims] = rows[good], flat[good] / norm[good, None]
    return out


def _packed(column: pa.Array, rows: np.ndarray, dims: int) -> pa.Array:
    """The vectors of some rows as they are, in one binary value each."""
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    at = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(4 * dims)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(flat)])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dims, (rows, _) in unit_vectors(batch.column(4)).items():
            packed = _packed(batch.column(4), rows, dims)
            part = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.full(len(rows), dims, np.int32)), part.column(1), part.column(2), part.column(3), packed],
                names=["grp", "dims", "block", "blocks", "uuid", "vec"],
            )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The one or two blocks of each group: ids in order, and vectors. Equal rows count once."""
    last, sides = None, {}
    for batch in batches:
        keys = zip(*(batch.column(i).to_pylist() for i in range(4)))
        for key, side, u, v in zip(keys, batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist()):
            if key != last:
                if sides:
                    yield [_block(x) for x in sides.values()]
                last, sides = key, {}
            sides.setdefault(side, {})[u, v] = None
    if sides:
        yield [_block(x) for x in sides.values()]


def _block(rows: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors."""
    vec = np.frombuffer(b"".join(v for _, v in rows), np.float32).reshape(len(rows), -1).astype(np.float64)
    return np.array([u for u, _ in rows], dtype=object), vec / np.sqrt(np.einsum("ij,ij->i", vec, vec))[:, None]


def _most(ids: np.ndarray) -> int:
    """Most different vectors of one key."""
    return int(np.diff(np.append(np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])), len(ids))).max())


def _rank(sims: np.ndarray, least: np.ndarray, vec: np.ndarray, near: np.ndarray, top: int, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and exact cosines of the ``top`` best of each row; of equal ones the first columns."""
    rows, cols = np.nonzero(sims >= least[:, None])
    if len(rows) > RANKED and len(sims) > 1:
        half = len(sims) // 2
        yield from _rank(sims[:half], least[:half], vec[:half], near, top, floor)
        yield from ((r + half, c, x) for r, c, x in _rank(sims[half:], least[half:], vec[half:], near, top, floor))
        return
    exact = np.einsum("ij,ij->i", vec[rows], near[cols]).round(12)
    order = np.lexsort((cols, -exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    keep = (np.arange(len(rows)) - np.searchsorted(rows, rows) < top) & (exact >= floor)
    yield rows[keep], cols[keep], exact[keep]


def nearest(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], k: int, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of block ``one``, their ``k`` most similar ids of block ``two``, other than themselves, and the cosines."""
    (ids, vec), (names, near) = one, two
    top = k * _most(names) if len(names) else 0
    # Maxima of at least ``top`` runs of columns: the least of the ``top`` best of them is reached by ``top`` columns.
    starts = np.arange(0, len(names), max(1, len(names) // (16 * top)))
    step = max(1, TILE // len(names))
    short = np.ascontiguousarray(near.astype(np.float32).T)
    for at in range(0, len(ids), step):
        part = vec[at : at + step]
        sims = part.astype(np.float32) @ short
        left, right = np.searchsorted(names, ids[at : at + step]), np.searchsorted(names, ids[at : at + step], side="right")
        for i in np.flatnonzero(left < right):
            sims[i, left[i] : right[i]] = -9
        best = np.maximum.reduceat(sims, starts, axis=1)
        least = np.partition(best, -top, axis=1)[:, -top] if best.shape[1] >= top else np.full(len(part), -2, np.float32)
        # Products of 32 bits may be off by some 1e-6; the ranking is by exact ones.
        least = np.maximum(least, max(floor, -2)) - 1e-4
        least = np.maximum(least, np.float32(-2))
        for rows, cols, exact in _rank(sims, least, part, near, top, floor):
            yield ids[at + rows], names[cols], exact


def _best(k: int, floor: float):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _groups(batches):
            for one, two in [(blocks[0], blocks[0])] if len(blocks) == 1 else [blocks, blocks[::-1]]:
                for ids, near, cosine in nearest(one, two, k, floor):
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(near, pa.string()), pa.array(cosine)], names=["uuid", "near", "cosine"])

    return best


# --- windows of the curves ------------------------------------------------------------


def _places(curves: int):
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, (rows, unit) in unit_vectors(batch.column(4)).items():
                packed = _packed(batch.column(4), rows, dims)
                part = batch.take(pa.array(rows))
                wanted = part.column(1).to_numpy()
                for curve in range(curves):
                    own = np.flatnonzero(wanted > curve)
                    if not len(own):
                        continue
                    at, n = pa.array(own), len(own)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(at), pa.array(np.full(n, dims, np.int32)), pa.array(np.full(n, curve, np.int32)), pa.array(curve_places(unit[own], curve)), part.column(3).take(at), part.column(2).take(at), packed.take(at)],
                        names=["grp", "dims", "curve", "place", "uuid", "width", "vec"],
                    )

    return places


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple[str, bytes]]]]:
    """Blocks of neighbours of one curve of one collection, each as wide as the collection's windows. Equal rows count once."""
    rows: list[tuple[str, bytes]] = []
    last = None
    for batch in batches:
        keys = zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 5)))
        for key, row in zip(keys, zip(batch.column(4).to_pylist(), batch.column(6).to_pylist())):
            if key != last or len(rows) == key[3]:
                if rows:
                    yield last, rows
                rows, last = [], key
            if not rows or row != rows[-1]:
                rows.append(row)
    if rows:
        yield last, rows


def _in_windows(k: int, floor: float):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[tuple, list]] = []  # up to three blocks; the middle one is compared with all

        def compare(key: tuple, mid: list) -> Iterator[pa.RecordBatch]:
            around = sorted({row for other, rows in held if other == key for row in rows})
            if len(around) < 2:
                return
            parts = list(nearest(_block(sorted(mid)), _block(around), k, floor))
            ids, near, cosine = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(near, pa.string()), pa.array(cosine)], names=["uuid", "near", "cosine"])

        for block in _runs(batches):
            held.append(block)
            if len(held) >= 2:
                yield from compare(*held[-2])
            if len(held) == 3:
                held.pop(0)
        if held:
            yield from compare(*held[-1])

    return found


# --- how wide the windows are ---------------------------------------------------------

Group = tuple[str, int]


def _nearest_to(probes: dict[Group, tuple[list[str], np.ndarray]], k: int, floor: float):
    """The ``k`` best of each probe in a task, with their places on all curves."""
    curves = CURVES[-1]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list[tuple[float, str, tuple]]] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            ids = batch.column(1).to_pylist()
            for dims, (rows, unit) in unit_vectors(batch.column(2)).items():
                by_group: dict[str, list[int]] = {}
                for i, r in enumerate(rows.tolist()):
                    by_group.setdefault(names[r], []).append(i)
                for grp, own in by_group.items():
                    if (grp, dims) not in probes:
                        continue
                    asked, vec = probes[grp, dims]
                    sims = vec @ unit[own].T
                    top = np.argpartition(-sims, min(k, len(own) - 1), axis=1)[:, : k + 1]
                    for p, (u, cols) in enumerate(zip(asked, top)):
                        mine = best.setdefault((grp, dims, p), [])
                        mine += [(float(sims[p, c]), ids[rows[own[c]]], unit[own[c]].astype(np.float32).tobytes()) for c in cols if sims[p, c] >= floor and ids[rows[own[c]]] != u]
                        mine.sort(reverse=True)
                        del mine[k:]
        out = [(g, d, p, s, v) for (g, d, p), found in best.items() for s, _, v in found]
        cols = list(zip(*out)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.binary())], names=["grp", "dims", "probe", "cosine", "vec"]
        )

    return near


def _between(edges: dict[Group, list[np.ndarray]]):
    """Rows of each collection and curve that lie between successive edges."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            for dims, (rows, unit) in unit_vectors(batch.column(2)).items():
                for grp in set(names[rows]):
                    if (grp, dims) not in edges:
                        continue
                    own = unit[names[rows] == grp]
                    for curve, at in enumerate(edges[grp, dims]):
                        n = np.bincount(np.searchsorted(at, curve_places(own, curve)), minlength=len(at) + 1)
                        total[grp, dims, curve] = total.get((grp, dims, curve), 0) + n
        out = [(g, d, c, k, int(n)) for (g, d, c), counts in total.items() for k, n in enumerate(counts) if n]
        cols = list(zip(*out)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), *(pa.array(cols[i], pa.int32()) for i in (1, 2, 3)), pa.array(cols[4], pa.int64())], names=["grp", "dims", "curve", "place", "n"]
        )

    return count


def cheapest(apart: np.ndarray, rows: int, window: int = WINDOW) -> tuple[int, int]:
    """Curves and block rows for a collection, from the distances of probes and neighbours (pairs x curves) in rows; (0, 0) where one window must hold it whole."""
    best, choice = float(rows), (0, 0)
    for curves in CURVES:
        near = apart[:, :curves]
        width = window
        # Blocks are twice as wide as the probes need, as these are few.
        while (cost := curves * (6 * width + COPY)) < best:
            # A block and its two neighbours hold all within one width, and part of what lies within two.
            missed = np.clip((near - width) / width, 0, 1).prod(axis=1)
            if 1 - missed.mean() >= TARGET:
                best, choice = cost, (curves, 2 * width)
                break
            width *= 2
    return choice


def window_plan(rows: DataFrame, sizes: DataFrame, k: int, floor: float) -> DataFrame:
    """``(grp, size, rows, curves, width)`` for every collection of a search that need not be exact.

    Probes are the rows least by hash, at most ``PROBES``, of collections above ``SMALL``.
    Collections without probes of their own take the widest choice that a collection with
    probes needed, in proportion to their rows.
    """
    spark = rows.sparkSession
    large = sizes.where(F.col("rows") > SMALL)
    some = rows.join(large, ["grp", "size"]).withColumn("_h", F.xxhash64("uuid", F.lit("probe")))
    some = some.where(F.pmod("_h", F.greatest(F.lit(1), (F.col("rows") / OWN_PROBES).cast("bigint"))) == 0).orderBy("_h", "uuid").limit(PROBES)
    asked: dict[Group, list[tuple]] = {}
    counts: dict[Group, int] = {}
    for grp, size, uuid, vec, n in some.select("grp", "size", "uuid", "vec", "rows").collect():  # PROBES rows
        asked.setdefault((grp, size), []).append((uuid, vec))
        counts[grp, size] = n
    probes = {}
    for group, found in asked.items():
        column = pa.array([v for _, v in found], pa.list_(pa.float32()))
        for _, (at, unit) in unit_vectors(column).items():
            probes[group] = [found[i][0] for i in at], unit
    plan = sizes.withColumn("curves", F.lit(0)).withColumn("width", F.lit(0))
    if not probes:
        return plan
    own = rows.select("grp", "uuid", "vec")
    near = own.mapInArrow(_nearest_to(probes, k, floor), "grp string, dims int, probe int, cosine double, vec binary")
    best = near.groupBy("grp", "dims", "probe").agg(F.slice(F.sort_array(F.collect_list(F.struct("cosine", "vec")), asc=False), 1, k).alias("best"))
    pairs: dict[Group, list[tuple[int, bytes]]] = {}
    for grp, dims, probe, found in best.collect():  # k rows a probe
        pairs.setdefault((grp, dims), []).extend((probe, bytes(f["vec"])) for f in found)
    ends, edges = {}, {}
    for group, found in pairs.items():
        one = probes[group][1][[p for p, _ in found]]
        two = np.frombuffer(b"".join(v for _, v in found), np.float32).reshape(len(found), -1).astype(np.float64)
        ends[group] = [np.stack([curve_places(one, c), curve_places(two, c)]) for c in range(CURVES[-1])]
        edges[group] = [np.unique(x) for x in ends[group]]
    lying = own.mapInArrow(_between(edges), "grp string, dims int, curve int, place int, n bigint").groupBy("grp", "dims", "curve", "place").agg(F.sum("n").alias("n"))
    before = {g: [np.zeros(len(e) + 1) for e in at] for g, at in edges.items()}
    for grp, dims, curve, place, n in lying.collect():  # at most 2 k rows a probe and curve
        before[grp, dims][curve][place] = n
    chosen: dict[Group, tuple[int, int]] = {}
    for group, at in ends.items():
        rank = [np.cumsum(n) for n in before[group]]
        apart = np.stack([np.abs(np.diff(rank[c][np.searchsorted(edges[group][c], at[c])], axis=0))[0] for c in range(CURVES[-1])], axis=1)
        chosen[group] = cheapest(apart, counts[group])
    for group in probes.keys() - ends.keys():
        chosen[group] = cheapest(np.zeros((1, CURVES[-1])), counts[group])  # no neighbour above the floor
    table = spark.createDataFrame([(g, d, c, w) for (g, d), (c, w) in chosen.items()], "grp string, size int, _c int, _w int")
    out = sizes.join(table, ["grp", "size"], "left")
    if len(asked) < PROBES // OWN_PROBES:  # every large collection has been asked
        return out.select("grp", "size", "rows", F.coalesce("_c", F.lit(0)).alias("curves"), F.coalesce("_w", F.lit(0)).alias("width"))
    share = max((w / counts[g] for g, (_, w) in chosen.items() if w), default=1.0) if all(w for _, w in chosen.values()) else 1.0
    width = F.greatest(F.lit(WINDOW), F.ceil(F.col("rows") * share)).cast("int")
    other = (F.col("rows") > SMALL) & (CURVES[-1] * (3 * width + COPY) < F.col("rows"))
    curves = F.coalesce("_c", F.when(other, F.lit(CURVES[-1])).otherwise(F.lit(0)))
    return out.select("grp", "size", "rows", curves.alias("curves"), F.coalesce("_w", F.when(other, width).otherwise(F.lit(0))).alias("width"))


def similar_vectors(
    vectors: DataFrame,
    k: int = K,
    floor: float = -1.0,
    block_bytes: int = BLOCK_BYTES,
    key: str = "uuid",
    group: str = "collection_id",
    vector: str = "embedding",
    exact: bool = True,
) -> DataFrame:
    """``(uuid, near, cosine, rank)``: the ``k`` most similar rows of the same collection and vector length.

    Neighbours below the cosine ``floor`` are left out early, which changes no other rank.
    Null, empty, all-zero, infinite and NaN-holding vectors and rows without a key take no
    part; a null collection is one collection. Equal vectors are neighbours; equal
    similarities are ranked by key. A key on several rows counts once, by the most similar of
    them. Without ``exact`` the collections that have windows (see ``window_plan``) lose about
    1 - ``TARGET`` of the neighbours, and the cost of a collection no longer grows with the
    square of its rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(key).isNotNull() & (F.size(vector) > 0)).select(
        F.coalesce(F.col(group).cast("string"), F.lit("")).alias("grp"), F.col(key).cast("string").alias("uuid"), F.col(vector).cast("array<float>").alias("vec"), F.size(vector).alias("size")
    )
    sizes = rows.groupBy("grp", "size").agg(F.count("*").alias("rows"))
    if exact:
        return _ranked(_all_pairs(rows, sizes, k, floor, block_bytes), k)
    planned = rows.join(window_plan(rows, sizes, k, floor), ["grp", "size"])
    placed = planned.where("curves > 0").select("grp", "curves", "width", "uuid", "vec").mapInArrow(_places(CURVES[-1]), PLACED)
    order = ["grp", "dims", "curve", "place", "uuid"]
    windows = placed.repartitionByRange(cores(spark), *order).sortWithinPartitions(*order).mapInArrow(_in_windows(k, floor), NEAR)
    whole = planned.where("curves = 0").select("grp", "uuid", "vec", "size")
    return _ranked(windows.unionByName(_all_pairs(whole, sizes, k, floor, block_bytes)), k)


def _all_pairs(rows: DataFrame, sizes: DataFrame, k: int, floor: float, block_bytes: int) -> DataFrame:
    """The ``k`` best of every row in every block of its collection."""
    spark = rows.sparkSession
    blocks = F.ceil(F.col("rows") * F.col("size") * 4 / F.lit(block_bytes)).cast("int")
    # Collections of several blocks: no more than the blocks that the table fills.
    several = sizes.withColumn("_n", blocks).where("_n > 1").select("grp", "size", "_n")
    dealt = rows.join(F.broadcast(several), ["grp", "size"], "left").withColumn("blocks", F.coalesce("_n", F.lit(1)))
    dealt = dealt.select("grp", F.pmod(F.xxhash64("uuid"), F.col("blocks")).cast("int").alias("block"), "blocks", "uuid", "vec")
    met = dealt.mapInArrow(_keys, KEYED).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # A block meets itself in a group of its own.
    pair = ["grp", "dims", "low", "high"]
    met = met.select("grp", "dims", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "uuid", "vec")
    return met.repartition(cores(spark), *pair).sortWithinPartitions(*pair, "block", "uuid").mapInArrow(_best(k, floor), NEAR)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each row among all that were found for it."""
    once = found.groupBy("uuid", "near").agg(F.max("cosine").alias("cosine"))
    merged = once.groupBy("uuid").agg(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "near")).alias("all"))
    return merged.select("uuid", F.posexplode(F.slice(F.array_sort("all"), 1, k)).alias("rank", "x")).select(
        "uuid", F.col("x.near").alias("near"), (-F.col("x.far")).alias("cosine"), (F.col("rank") + 1).alias("rank")
    )


def similar_pairs(vectors: DataFrame, k: int = K, floor: float = 0.90, **options) -> DataFrame:
    """``(uuid_a, uuid_b)`` with ``uuid_a < uuid_b``: one is among the other's ``k`` most similar rows and their cosine reaches ``floor``."""
    near = similar_vectors(vectors, k, floor, **options)
    return near.select(F.least("uuid", "near").alias("uuid_a"), F.greatest("uuid", "near").alias("uuid_b")).distinct()
