from hypothesis import given, settings
from hypothesis import strategies as st

from strataline.llm.splitting import _codes, effective_overlap, pieces_of, split_oversized, split_points, split_text


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab \n.,é́漢。👩‍👧"), min_size=1, max_size=400), st.integers(1, 60), st.integers(0, 70))
def test_pieces_cover_the_text_below_the_limit(text, size, overlap):
    if len(text) <= size:
        assert split_text(text, size, overlap) == [text]
        return
    cuts = split_points([_codes(text)], [size], [overlap])[0]
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(0 < b - a <= size for a, b in cuts)
    assert all(a[0] < b[0] <= a[1] < b[1] for a, b in zip(cuts, cuts[1:]))
    joined = text[: cuts[0][1]]
    for (_, end), (start, stop) in zip(cuts, cuts[1:]):
        joined += text[end:stop]
        assert end - start <= max(effective_overlap(size, overlap), 0) + size
    assert joined == text


def test_cuts_fall_on_sentences_and_overlap_is_met():
    text = " ".join(f"Sentence number {k} says a few words." for k in range(60))
    parts = split_text(text, 300, 80)
    assert all(len(p) <= 300 for p in parts)
    assert all(p.rstrip().endswith(".") for p in parts)
    for a, b in zip(parts, parts[1:]):
        shared = max(k for k in range(1, 300) if a.endswith(b[:k]))
        assert 40 <= shared <= 80


def test_a_batch_gives_what_single_texts_give():
    texts = ["word " * 300, "x" * 900, "a. b. c. " * 100]
    sizes, overlaps = [200, 100, 64], [50, 100, 0]
    assert split_points([_codes(t) for t in texts], sizes, overlaps) == [split_points([_codes(t)], [s], [o])[0] for t, s, o in zip(texts, sizes, overlaps)]


def test_operator_edges(spark):
    chunks = spark.createDataFrame(
        [("a", "d1", "x" * 10, 1), ("b", "d1", "x" * 11, 1), ("b", "d1", "x" * 11, 1), ("c", "d1", None, 1), ("d", "d1", "", 1), ("e", "none", "y" * 2049, 1), ("f", "none", "y" * 2048, 1), ("g", "dnull", "é" * 2049, 1)],
        "id string, collection_id string, content string, chunk_size int",
    )
    options = spark.createDataFrame([("d1", 10, 20, "extra"), ("d1", 5, 1, "extra"), ("dnull", None, None, "x")], "dataset string, chunk_size int, chunk_overlap int, content string")
    out = split_oversized(chunks, options)
    found = [r.id for r in out.collect()]
    assert sorted(found) == ["b", "b", "e", "g"]
    assert max(r.n_chars for r in pieces_of(out.where("id = 'b'")).collect()) <= 10
    assert split_oversized(chunks.limit(0), options).count() == 0
    assert sorted(r.id for r in split_oversized(chunks, options.limit(0)).collect()) == ["e", "g"]
