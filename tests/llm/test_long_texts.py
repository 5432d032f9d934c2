"""One very long text in each operator: it ends soon and is treated whole."""

import time

from strataline.llm import abuse, encoding, leakage, neardup, pii, scans, splitting


def test_long_texts():
    line = "Dear Ada Lindqvist, call +1-646-555-0101 or write to ada@x.example about 55 Old Mill Rd today. "
    text = line * 12_000
    began = time.time()
    finder = pii.Finder([("ada", True, False), ("lindqvist", False, True)])
    assert len(finder(text)) == 4 * 12_000
    ids = encoding.tokenizer().encode_batch([text, "x" * 300_000])
    assert len(ids[0]) > 200_000
    assert sum(b - a for a, b in splitting.split_points([splitting._codes(text)], [2000], [0])[0]) == len(text)
    model = scans.Model({"today": 100}, {})
    assert scans.corrections(model, text.replace("today", "t0day"))[0][2] == "today"
    assert scans.cut_words(model, "a" * 1_000_000 + "-\nb") and scans.edge_lines(text) == []
    index = leakage.BlockMaxIndex([(1, "one two three four five six seven eight nine ten")])
    assert leakage.search_texts(index, ["word " * 200_000 + "one two three four five six seven eight nine ten"])
    rows, shingles, offsets = neardup.Shingler(3, 20)([text, " ".join(map(str, range(200_000)))])
    assert len(rows) == 2 and len(shingles) > 199_000
    assert len(abuse.passages("word " * 500_000)) > 1
    assert time.time() - began < 60
