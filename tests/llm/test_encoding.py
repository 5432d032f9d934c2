import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataline.llm.encoding import DEFAULT_VOCABULARY, encode_corpus, token_starts, tokenizer, _codes

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


CASES = ["", " ", "  ", "\n \n a", "it's we'll 'sss ''s don't'", "x'll've're y", "<|endoftext|> a", "a　b\u0085c", "½²Ⅷ9", "x" * 700 + "'s", "​!?", "''re 's\t's", "é́ñ漢字 👩‍👧"]


@pytest.mark.parametrize("text", CASES)
def test_ids_of_hard_texts(public, text):
    assert tokenizer().encode_batch([text])[0].tolist() == public(text)


def test_ids_of_random_texts(public):
    rnd = random.Random(5)
    letters = "ab1 '\n\tsrelvtmd.!é 　'  漢½"
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 16)))
        assert tokenizer().encode_batch([text])[0].tolist() == public(text), repr(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_round_trip_and_offsets(text):
    text = text.encode("utf-8", "ignore").decode()
    bpe = tokenizer()
    slices = bpe.encode_with_offsets(text)
    assert "".join(text[a:b] for a, b, _ in slices) == text
    assert bpe.decode([i for _, _, ids in slices for i in ids]) == text
    assert len(token_starts(_codes(text))) == len(slices)


def test_operator_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x"), (3, " ", "x"), (None, "hi", "y")], "doc_id bigint, text string, ids string")
    out = {(r.doc_id, tuple(r.ids)) for r in encode_corpus(df).collect()}
    assert out == {(1, ()), (2, ()), (3, (220,)), (None, (5303,))}
    assert encode_corpus(df).count() == 5 and encode_corpus(df.limit(0)).count() == 0
