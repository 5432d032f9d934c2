from strataline.llm import abuse


def test_disguises_are_taken_off():
    plain = lambda t: " ".join(abuse.plain_words(t))
    assert plain("You 1d10t") == plain("you idiot") == plain("YOU i d i o t") == plain("you i​diot") == plain("you iiiidiot") == plain("you ídiot") == plain("уou idiot".replace("у", "y"))
    assert plain("at 0x2f and 12 rows") == "at and rows"


def corpus():
    calm = ["the store counts rows of part {k}", "a worker sorts the label set {k}", "the index joins two pages again {k}", "kill the zombie process first then its children {k}"]
    bad = ["shut up you {x} nobody wants you here", "you {x} crawl back into your hole", "all of you {x} should be driven out"]
    insults = ["idiot", "moron", "pig", "parasite", "scumbag"]
    docs, labels = [], []
    for k in range(240):
        text = ". ".join(calm[(k + j) % 4].format(k="abcdefgh"[k % 8]) for j in range(3)) + "."
        toxic = k % 6 == 0
        if toxic:
            text += " " + bad[k % 3].format(x=insults[k % 5]).capitalize() + "."
        docs.append((k, text, "chat" if k % 2 else None, 9))
        if k < 180:
            labels.append((k, int(toxic) if k % 17 else int(not toxic)))
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = corpus()
    frames = spark.createDataFrame(docs, "doc_id bigint, text string, source string, score int"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    scores = {r.doc_id: r for r in abuse.abuse_scores(*frames).collect()}
    held = range(180, 240)
    assert all((scores[k].score >= abuse.THRESHOLD) == (k % 6 == 0) for k in held)
    assert all(scores[k].evidence for k in held if k % 6 == 0)
    rates = {r.source: (r.documents, r.abusive) for r in abuse.abuse_rates(abuse.abuse_scores(*frames)).collect()}
    assert rates[None] == (120, 40) and rates["chat"] == (120, 0)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "s"), (3, "  ", "s"), (4, "some words here", "s"), (4, "some words here", "s")], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(1, 1), (4, None), (4, 7), (99, 1)], "doc_id bigint, toxic int")
    for own in (labels, labels.limit(0)):
        out = abuse.abuse_scores(docs, own).collect()
        assert len(out) == 5 and {r.score for r in out} == {0.0}
    assert abuse.abuse_scores(docs.limit(0), labels).count() == 0
