import random

import numpy as np
import pytest

from strataline.llm import neardup
from strataline.llm.words import words

WORDS = [f"w{k}" for k in range(3000)]


def brute(rows, threshold, size, least):
    sets = [(i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}) for i, t in rows if len(w := words(t)) >= max(least, size)]
    return {tuple(sorted((a, b))) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if a != b and len(x & y) / len(x | y) >= threshold}


def corpus(seed, n=250):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        if k % 3 == 0:
            base = [rnd.choice(WORDS) for _ in range(rnd.randint(20, 120))]
        text = list(base)
        for _ in range(rnd.choice([0, 1, 2, 4, 8])):
            at = rnd.randrange(len(text))
            text[at : at + rnd.choice([0, 1])] = [rnd.choice(WORDS)] * rnd.choice([0, 1])
        out.append((f"id{k:04}", " ".join(text)))
    return out


@pytest.mark.parametrize("threshold,size,least", [(0.6, 3, 20), (0.8, 5, 0)])
def test_pairs_against_brute_force(spark, threshold, size, least):
    data = corpus(7)
    want = brute(data, threshold, size, least)
    found = {tuple(r) for r in neardup.similar_pairs(spark.createDataFrame(data, "id string, content string"), threshold, size, least).collect()}
    assert found <= want
    assert len(found) >= 0.97 * len(want) and len(want) > 50


def test_a_hot_class_is_written_as_a_star_and_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "EXPAND", 5)
    text = " ".join(WORDS[:60])
    near = " ".join([*WORDS[:59], "other"])
    data = [(f"h{k:03}", text) for k in range(300)] + [("near1", near), ("near2", near)]
    found = {tuple(r) for r in neardup.similar_pairs(spark.createDataFrame(data, "id string, content string"), 0.6, 3, 20).collect()}
    assert {("h000", f"h{k:03}") for k in range(1, 300)} <= found
    assert {("h000", "near1"), ("h000", "near2"), ("near1", "near2")} <= found
    assert len(found) == 299 + 3


def test_groups(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "id_a string, id_b string")
    assert sorted(map(tuple, neardup.components(pairs).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")]
    chain = spark.createDataFrame([(f"{k:03}", f"{k + 1:03}") for k in range(100)], "id_a string, id_b string")
    assert {r.group_id for r in neardup.components(chain).collect()} == {"000"}
    assert neardup.components(pairs.limit(0)).count() == 0


def test_edges(spark):
    t = " ".join(WORDS[:30])
    data = [("a", t, 1), ("a", t, 1), ("b", t.upper(), 2), ("c", None, 3), ("d", "", 4), ("e", "few words", 5), (None, t, 6), ("f", t.replace(" ", ", "), 7)]
    df = spark.createDataFrame(data, "id string, content string, ref int")
    found = {tuple(r) for r in neardup.similar_pairs(df, 0.6, 3, 20).collect()}
    assert found == {("a", "b"), ("a", "f"), ("b", "f")}
    assert neardup.similar_pairs(df.limit(0), 0.6, 3, 20).count() == 0


def signatures(agree):
    """Min-hashes of two texts, agreeing where told."""
    rng = np.random.default_rng(4)
    one = rng.integers(0, 1 << 32, neardup.POOL, dtype=np.uint32)
    two = np.where(agree, one, rng.integers(0, 1 << 32, neardup.POOL, dtype=np.uint32))
    return np.stack([one, two], axis=1)


def met(sig, threshold, most=neardup.REGION):
    """Whether the two texts are candidates in any tree."""
    for _, entry in neardup._entries(sig, np.array([1, 2]), np.array([100, 100]), np.zeros(2, bool), {}, threshold):
        if len(neardup.candidate_pairs(entry, threshold, most)[0]):
            return True
    return False


def test_pairs_at_the_threshold_meet_in_some_tree_under_a_sketch_of_its_own():
    rng = np.random.default_rng(3)
    missed = sum(not met(signatures(rng.random(neardup.POOL) < 0.6), 0.6) for _ in range(1500))
    assert missed <= 1  # by chance fewer than one in 50,000
    unlike = sum(met(signatures(rng.random(neardup.POOL) < 0.3), 0.6) for _ in range(300))
    assert unlike <= 60


def test_pairs_at_the_threshold_meet_in_large_regions_too():
    rng = np.random.default_rng(5)
    missed = sum(not met(signatures(rng.random(neardup.POOL) < 0.6), 0.6, most=1) for _ in range(600))
    assert missed <= 2


def test_texts_of_a_hot_region_are_dealt_out_and_still_meet():
    rng = np.random.default_rng(6)
    missed = 0
    for _ in range(300):
        sig = signatures(rng.random(neardup.POOL) < 0.6)
        hot = {t: {int(neardup._spread(sig[t])[0]): 2} for t in range(neardup.TREES)}
        parts = [e for _, e in neardup._entries(sig, np.array([1, 2]), np.array([100, 100]), np.zeros(2, bool), hot, 0.6)]
        missed += not any(len(neardup.candidate_pairs(e, 0.6)[0]) for e in parts)
    assert missed <= 2


@pytest.mark.parametrize("copies,edits", [(3000, 8), (1000, 6)])
def test_candidates_of_many_texts_of_one_template(copies, edits):
    rnd = random.Random(21)
    base = [rnd.choice(WORDS) for _ in range(200)]
    texts = []
    for k in range(copies):
        text = list(base)
        for at in rnd.sample(range(200), edits):
            text[at] = f"own{k}x{at}"
        texts.append(" ".join(text))
    rows, shingles, offsets = neardup.Shingler(3, 20)(texts)
    sizes = np.diff(np.append(offsets, len(shingles)))
    found = set()
    for _, entry in neardup._entries(neardup._signatures(shingles, offsets), rows, sizes, np.zeros(copies, bool), {}, 0.6):
        found |= set((lambda a, b: a * copies + b)(*neardup.candidate_pairs(entry, 0.6)).tolist())
    sets = [set(shingles[o : o + n].tolist()) for o, n in zip(offsets, sizes)]
    want = [(a, b) for a, b in (sorted(rnd.sample(range(copies), 2)) for _ in range(20_000)) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])]
    assert len(want) > 1000
    assert sum(a * copies + b in found for a, b in want) >= 0.998 * len(want)


def test_a_group_of_a_thousand_edited_copies_keeps_its_links(spark):
    rnd = random.Random(9)
    base = [rnd.choice(WORDS) for _ in range(200)]
    data = []
    for k in range(1000):
        text = list(base)
        for at in rnd.sample(range(200), 8):
            text[at] = f"own{k}x{at}"
        data.append((f"id{k:04}", " ".join(text)))
    want = brute(data, 0.6, 3, 20)
    found = {tuple(r) for r in neardup.similar_pairs(spark.createDataFrame(data, "id string, content string"), 0.6, 3, 20).collect()}
    assert found <= want
    assert len(found) >= 0.995 * len(want) and len(want) > 100_000


def test_hot_regions_are_found_by_a_sample_and_keep_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_ROWS", 40)
    data = [(i, "the same boiler plate line that stands first " * 3 + t) for i, t in corpus(11)]
    df = spark.createDataFrame(data, "id string, content string")
    assert neardup.hot_regions(df, 250, 3, 20)
    want = brute(data, 0.6, 3, 20)
    found = {tuple(r) for r in neardup.similar_pairs(df, 0.6, 3, 20).collect()}
    assert found <= want and len(found) >= 0.99 * len(want) > 100


def test_where_a_region_is_compared_changes_no_pair(spark, monkeypatch):
    rnd = random.Random(31)
    base = [rnd.choice(WORDS) for _ in range(120)]
    texts = []
    for k in range(500):
        text = list(base)
        for at in rnd.sample(range(120), rnd.choice([4, 9, 13])):
            text[at] = f"own{k}x{at}"
        texts.append((f"id{k:04}", " ".join(text)))
    data = texts + [(f"copy{k}", t) for k, (_, t) in enumerate(texts[:40])]
    df = spark.createDataFrame(data, "id string, content string").repartition(3)
    source = df.selectExpr("id", "xxhash64(content) AS ref", "content")

    def candidates(hot):
        grown = source.select("ref", "content").mapInArrow(neardup._grow(2, 3, 20, 0.6, hot), "part int, blob binary")
        return {tuple(r) for r in grown.repartition(3, "part").sortWithinPartitions("part").mapInArrow(neardup._meet(0.6, 2), "a bigint, b bigint").distinct().collect()}

    monkeypatch.setattr(neardup, "REGION", 20)
    monkeypatch.setattr(neardup, "HOT_ROWS", 20)  # as many texts as in-task regions go deeper from
    hot = neardup.hot_regions(source, len(data), 3, 20)
    assert hot == neardup.hot_regions(source.repartition(7), len(data), 3, 20) and sum(map(len, hot.values())) > 20
    assert candidates(hot) == candidates({})
    monkeypatch.setattr(neardup, "HOT_ROWS", len(data) // 2)
    assert neardup.hot_regions(source.limit(len(data) // 2), len(data) // 2, 3, 20) == {}
