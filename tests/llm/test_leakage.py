import random

from strataline.llm import leakage
from strataline.llm.words import words


def brute(docs, items, run=10):
    spans = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - run + 1):
            spans.setdefault(tuple(w[k : k + run]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words(t)] for k in range(len(w) - run + 1) for i in spans.get(tuple(w[k : k + run]), ())}


def test_against_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"t{k}" for k in range(120)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(text(rnd.randint(4, 40)))) for k in range(60)]
    docs = []
    for d in range(400):
        w = text(rnd.randint(0, 80))
        if d % 3 == 0:
            own = words(rnd.choice(items)[1])
            a = rnd.randrange(len(own))
            w[len(w) // 2 : len(w) // 2] = own[a : a + rnd.randint(5, 30)]
        docs.append((d, ", ".join(w).upper() if d % 2 else " ".join(w)))
    out = leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    found = {(r.doc_id, r.item_id) for r in out.collect()}
    assert found == brute(docs, items) and len(found) > 30
    assert min(r.run_words for r in out.collect()) >= 10


def test_several_indexes_give_the_same(spark, monkeypatch):
    items = [(k, " ".join(f"i{k}x{j}" for j in range(12))) for k in range(30)]
    docs = [(k, "before " + t + " after") for k, t in items]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(leakage, "INDEX_CHARS", 300)
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(*frames).collect()} == {(k, k) for k in range(30)}


def test_edges(spark):
    nine = " ".join(f"w{k}" for k in range(9))
    ten = nine + " w9"
    docs = spark.createDataFrame([(1, ten, "x"), (1, ten, "x"), (2, None, "x"), (3, "", "x"), (4, nine, "x"), (None, ten, "x")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, ten, 1), (7, ten, 1), (8, nine, 1), (9, None, 1), (None, ten, 1)], "item_id bigint, text string, doc_id int")
    out = leakage.leaked_items(docs, items).select("doc_id", "item_id").distinct().collect()
    assert {tuple(r) for r in out} == {(1, 7), (None, 7)}
    assert leakage.leaked_items(docs.limit(0), items).count() == 0 and leakage.leaked_items(docs, items.limit(0)).count() == 0


def test_separate_runs_are_no_longer_run():
    item = [f"q{k}" for k in range(36)]
    text = " ".join([*item[0:10], "x", *item[11:21], "y", *item[22:32]])
    index = leakage.BlockMaxIndex([(1, " ".join(item))])
    assert [(i, r) for _, i, _, r, _, _ in leakage.search_texts(index, [text])] == [(0, 10)]
    assert leakage.search_texts(index, [" ".join(item[3:20])])[0][3] == 17
    assert abs(leakage.search_texts(index, [text])[0][4] - 30 / 36) < 1e-9


def test_question_and_answer_are_told_apart():
    text = "Which of the seven old bridges did the three clockmakers cross at noon? It was the second one from the northern gate of the town"
    index = leakage.BlockMaxIndex([(1, text)])
    question, answer = text.split("?")
    assert leakage.search_texts(index, [question])[0][5] == 0.0
    assert leakage.search_texts(index, [answer])[0][5] == 1.0


def test_runs_across_passages_and_in_long_texts():
    rnd = random.Random(2)
    items = [(k, " ".join(f"w{rnd.randrange(400)}" for _ in range(30))) for k in range(300)]
    texts = []
    for k in range(200):
        w = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(300))]
        own = words(items[k][1])
        at = rnd.randrange(len(w) + 1)
        w[at:at] = own[5:15]
        texts.append(" ".join(w))
    index = leakage.BlockMaxIndex(items)
    found = {(d, index.ids[i]) for d, i, *_ in leakage.search_texts(index, texts)}
    assert found == brute(list(enumerate(texts)), items)


def test_an_index_of_many_items_stays_small():
    import pickle

    rnd = random.Random(4)
    items = [(k, " ".join(f"w{int(rnd.paretovariate(0.6)) % 50_000}" for _ in range(40))) for k in range(5_000)]
    index = leakage.BlockMaxIndex(items)
    assert len(pickle.dumps(index)) < 10_000 * len(items)  # 1 GB for 100,000
