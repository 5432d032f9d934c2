import numpy as np

from strataline.llm import vectors


def data(seed=1, n=1200, dims=64):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        if k % 4 == 0:
            base = rng.standard_normal(dims)
        v = base + 0.25 * rng.standard_normal(dims)
        out.append((f"c{k % 3}", f"u{k:05}", [float(x) for x in v * rng.uniform(0.5, 3)]))
    return out


def brute(rows, k=5):
    out = {}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        m = np.array([r[2] for r in own], np.float32).astype(np.float64)
        m /= np.linalg.norm(m, axis=1)[:, None]
        s = m @ m.T
        np.fill_diagonal(s, -2)
        for i, r in enumerate(own):
            for j in np.argsort(-s[i])[:k]:
                out[r[1], own[j][1]] = s[i, j]
    return out


SCHEMA = "collection_id string, uuid string, embedding array<float>"


def test_recall_against_brute_force(spark):
    rows = [(f"c{i % 3}", u, v) for i, (_, u, v) in enumerate(data())]
    rows = [("one" if int(u[1:]) < 900 else "two", u, v) for _, u, v in rows]
    want = brute(rows)
    found = {(r.uuid, r.near): r.cosine for r in vectors.similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found.keys() & want.keys()) >= 0.9 * len(want)
    assert all(abs(found[p] - want[p]) < 1e-5 for p in found.keys() & want.keys())
    close = {tuple(sorted(p)) for p, s in want.items() if s >= 0.9}
    pairs = {tuple(r) for r in vectors.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(pairs & close) >= 0.99 * len(close) > 100 and all(a < b for a, b in pairs)


def test_edges(spark):
    rows = [
        ("c", "a", [1.0, 0.0]), ("c", "b", [2.0, 0.0]), ("c", "b", [2.0, 0.0]), ("c", "z", [0.0, 0.0]), ("c", "n", [float("nan"), 1.0]), ("c", "i", [float("inf"), 1.0]),
        ("c", "x", None), ("c", "e", []), ("c", None, [1.0, 0.1]), ("c", "three", [1.0, 0.0, 0.0]), (None, "m1", [1.0, 1.0]), (None, "m2", [1.0, 1.0]), ("other", "o", [1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in vectors.similar_pairs(df).collect()} == {("a", "b"), ("m1", "m2")}
    assert vectors.similar_pairs(df.limit(0)).count() == 0


def test_many_equal_vectors_stay_bounded(spark):
    rows = [("c", f"u{k:04}", [1.0, 2.0, 3.0]) for k in range(700)]
    out = vectors.similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 700 * 5


def test_hilbert_is_a_path():
    cells = np.array([(x, y) for x in range(8) for y in range(8)])
    order = np.argsort(vectors.hilbert_index(cells, 3))
    assert sorted(vectors.hilbert_index(cells, 3).tolist()) == list(range(64))
    steps = np.abs(np.diff(cells[order], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_a_dense_collection_loses_no_neighbour(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    rows = [("c", f"u{k:05}", (centre + 0.5 * rng.standard_normal(64)).tolist()) for k in range(4000)]
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for options in ({}, {"block_bytes": 1 << 18}):  # one block, and four blocks that meet in pairs
        found = {(r.uuid, r.near) for r in vectors.similar_vectors(df, **options).collect()}
        assert len(found & set(want)) >= 0.9999 * len(want) and len(found) == len(want)


def test_equal_similarities_and_keys_on_several_rows(spark):
    rows = [("c", f"u{k:03}", [1.0, 2.0, 3.0]) for k in range(90)]
    rows += [("c", "twice", [3.0, -2.0, 0.5]), ("c", "twice", [-2.0, 3.0, 0.5]), ("c", "v", [3.0, -2.0, 0.4])]
    for options in ({}, {"block_bytes": 400}):
        found = {}
        for r in vectors.similar_vectors(spark.createDataFrame(rows, SCHEMA), **options).collect():
            found.setdefault(r.uuid, {})[r["rank"]] = r.near
        assert list(dict(sorted(found["u050"].items())).values()) == ["u000", "u001", "u002", "u003", "u004"]
        assert all(len(set(x.values())) == 5 and u not in x.values() for u, x in found.items())
        assert found["v"][1] == "twice" and found["twice"][1] == "v"


def test_curves_and_windows_are_as_many_and_wide_as_the_probes_need():
    near = np.full((100, 12), 10.0)
    assert vectors.cheapest(near, 10_000) == (4, 2 * vectors.WINDOW)
    far = np.full((100, 12), 4_000.0)
    assert vectors.cheapest(far, 10_000) == (0, 0)
    assert vectors.cheapest(far, 1_000_000)[0] > 0
    mixed = np.full((100, 12), 5_000.0)
    mixed[np.arange(100), np.arange(100) % 12] = 10.0  # every pair is near on one curve only
    assert vectors.cheapest(mixed, 20_000)[0] == 12


def test_recall_on_curves(spark):
    rng = np.random.default_rng(8)
    near = np.repeat(rng.standard_normal((1500, 64)), 4, axis=0) + 0.08 * rng.standard_normal((6000, 64))
    rows = [("c", f"u{k:05}", v.tolist()) for k, v in enumerate(near)]
    want = {p for p, s in brute(rows).items() if s >= 0.9}
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    plan = vectors.window_plan(df.selectExpr("collection_id AS grp", "uuid", "embedding AS vec", "size(embedding) AS size"), df.selectExpr("'c' AS grp", "64 AS size", "6000L AS rows").limit(1), 5, 0.9)
    assert plan.first()["curves"] > 0
    found = {(r.uuid, r.near) for r in vectors.similar_vectors(df, floor=0.9).collect()}
    assert len(want) > 3000 and len(found & want) >= 0.99 * len(want)
    dense = [("c", f"u{k:05}", v.tolist()) for k, v in enumerate(rng.standard_normal((8000, 8)) @ rng.standard_normal((8, 64)))]
    want = brute(dense)
    found = {(r.uuid, r.near) for r in vectors.similar_vectors(spark.createDataFrame(dense, SCHEMA).repartition(4)).collect()}
    assert len(found & want.keys()) >= 0.95 * len(want)


def test_no_neighbour_depends_on_a_sample(spark):
    rng = np.random.default_rng(8)
    near = np.repeat(rng.standard_normal((1500, 64)), 4, axis=0) + 0.08 * rng.standard_normal((6000, 64))
    clusters = [("c", f"u{k:05}", v.tolist()) for k, v in enumerate(near)]
    latent = [("d", f"v{k:05}", v.tolist()) for k, v in enumerate(rng.standard_normal((6000, 10)) @ rng.standard_normal((10, 64)))]
    df = spark.createDataFrame(clusters + latent, SCHEMA).repartition(4)
    for options in ({}, {"block_bytes": 1 << 19}):  # one block, and three blocks that meet in pairs
        found = {(r.uuid, r.near) for r in vectors.similar_vectors(df, **options).collect()}
        assert found == brute(clusters + latent).keys()
    some = {(r.uuid, r.near) for r in vectors.similar_vectors(df, exact=False).collect()}
    assert len(some) == len(found) and len(some & found) >= 0.95 * len(found)


def test_cosines_have_the_precision_of_the_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(64).astype(np.float32)
    rows = [("c", f"u{k}", (base + np.float32(1e-4) * rng.standard_normal(64).astype(np.float32)).tolist()) for k in range(60)]
    want = brute(rows)
    found = {(r.uuid, r.near): r.cosine for r in vectors.similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found.keys() == want.keys() and all(abs(found[p] - want[p]) < 1e-11 for p in want)


def test_an_unlucky_sample_costs_no_neighbour(spark, monkeypatch):
    monkeypatch.setattr(vectors, "cheapest", lambda *_: (4, 8))  # windows too narrow
    rng = np.random.default_rng(8)
    rows = [("c", f"u{k:05}", v.tolist()) for k, v in enumerate(rng.standard_normal((1200, 10)) @ rng.standard_normal((10, 64)))]
    found = {(r.uuid, r.near) for r in vectors.similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == brute(rows).keys()
