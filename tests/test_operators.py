import datetime as dt

import pytest
from pyspark.sql import functions as F

from strataline.operators import dedupe, lookup, postprocess, providers, ranking, rewrite, splitters, sql, transforms
from tests.conftest import rows


@pytest.fixture(scope="module")
def chunks(spark):
    data = [("a", "d1", "red fox runs", {"lang": "en"}, [1.0, 0.0]), ("b", "d1", "red red dog", {"lang": "fr"}, [0.8, 0.6]), ("c", "d2", "blue fox", {"lang": "en"}, [0.0, 1.0]), ("z", "d2", "zero", {}, [0.0, 0.0]), ("w", "d2", "wide", {}, [1.0, 0.0, 0.0])]
    return spark.createDataFrame(data, "id string, dataset string, content string, metadata map<string,string>, embedding array<float>")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([("q", "red fox", [1.0, 0.0])], "query_id string, query string, vector array<float>")


def order(df):
    return [r.id for r in df.orderBy(F.desc("score"), "id").collect()]


def test_dense(spark, chunks, asked):
    assert order(ranking.Dense(2).retrieve(asked, chunks)) == ["a", "b"]
    assert order(ranking.Dense(5, where={"lang": "fr"}).retrieve(asked, chunks)) == ["b"]
    assert order(ranking.Dense(5, keywords=["fox", "-runs"]).retrieve(asked, chunks)) == ["c"]
    assert order(ranking.Dense(5, datasets=["d2"]).retrieve(asked, chunks)) == ["c"]
    assert order(ranking.nearest_one(chunks, [1.0, 0.0], 2)) == ["a", "b"]
    assert ranking.Dense(2).retrieve(asked.limit(0), chunks).count() == 0


def test_query_batches_change_nothing(spark, chunks, monkeypatch):
    many = spark.createDataFrame([(f"q{k}", [1.0, k / 10]) for k in range(9)], "query_id string, vector array<float>")
    want = rows(ranking.Dense(3).retrieve(many, chunks))
    monkeypatch.setattr(ranking, "QUERY_BATCH", 2)
    assert rows(ranking.Dense(3).retrieve(many, chunks)) == want


def test_per_dataset_union_is_global(spark, chunks, asked):
    per = ranking.top_per_dataset(asked, chunks, 2)
    assert order(ranking.top_per(per.select("query_id", "id", "score"), ["query_id"], 2)) == order(ranking.Dense(2).retrieve(asked, chunks))


def test_bm25(spark, chunks, asked):
    scores = {r.id: r.score for r in ranking.bm25_scores(asked, chunks).collect()}
    assert set(scores) == {"a", "b", "c"} and scores["a"] > scores["b"]
    assert {(r.id, r.score > 0) for r in ranking.BM25(4).retrieve(asked, chunks).collect()} == {("a", True), ("b", True), ("c", True), ("w", False)}
    twice = spark.createDataFrame([("q", "fox fox")], "query_id string, query string")
    once = spark.createDataFrame([("q", "fox")], "query_id string, query string")
    a = {r.id: r.score for r in ranking.bm25_scores(twice, chunks).collect()}
    b = {r.id: r.score for r in ranking.bm25_scores(once, chunks).collect()}
    assert all(abs(a[k] - 2 * b[k]) < 1e-9 for k in b)


def test_merge(spark, chunks, asked):
    merge = ranking.Merge([("dense", 0.7, ranking.Dense(3)), ("bm25", 0.3, ranking.BM25(3))], 10)
    got = {r.id: (round(r.score, 6), r.retrievers) for r in merge.retrieve(asked, chunks).collect()}
    assert got["a"] == (1.0, "dense,bm25") and got["c"][1] == "dense,bm25"
    first = ranking.Merge(merge.retrievers, 10, compat=True).retrieve(asked, chunks)
    assert {r.id: round(r.score, 6) for r in first.collect()}["a"] == 0.3


def test_subqueries(spark, chunks, asked):
    parts = spark.createDataFrame([("q", 0, [1.0, 0.0]), ("q", 1, [0.0, 1.0]), ("q", 7, [1.0, 1.0])], "query_id string, subquery_no int, vector array<float>")
    got = {r.id: round(r.score, 4) for r in ranking.subquery_search(asked, parts, chunks, limit=2).collect()}
    assert got == {"a": 1.0, "b": 0.8, "c": 1.0}
    with pytest.raises(ValueError):
        ranking.subquery_search(asked, parts, chunks, limit=0)


def test_routing(spark, chunks, asked):
    routes = spark.createDataFrame([("q", "d2")], "query_id string, dataset string")
    assert order(ranking.routed_search(asked, routes, chunks)) == ["c"]


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame([("q", "a", "red fox", 0.9), ("q", "b", "red", 0.5), ("q", "c", "blue", 0.3), ("q", "d", "green", 0.1)], "query_id string, id string, content string, score double")


def test_postprocessors(spark, results, asked):
    assert order(postprocess.similarity(results, 0.4)) == ["a", "b"] and order(postprocess.similarity(results, 0.95, 3)) == ["a", "b", "c"] and order(postprocess.similarity(results, 0.4, 1)) == ["a", "b"]
    assert order(postprocess.reduce(results, 2)) == ["a", "b"] and postprocess.reduce(results, 0).count() == 4
    assert order(postprocess.content_substring(results, ["red"], ["fox"])) == ["b"]
    assert order(postprocess.keywords(results, ["red", "blue", "-fox"])) == ["b", "c"]
    swapped = results.withColumn("score", 1 - F.col("score"))
    assert order(postprocess.bm25_rerank(swapped, asked, 2, sparse_weight=0.9)) == ["a", "b"]
    assert postprocess.bm25_rerank(results, asked, 0).count() == 4 and postprocess.bm25_rerank(results, asked, 0, compat=True).count() == 0
    yes = providers.EchoLLM(lambda t: "yes" if "red" in t else "no")
    assert order(postprocess.content_filter(results, yes, "?")) == ["a", "b"] and order(postprocess.content_filter(results, yes, "?", include=False)) == ["c", "d"]
    assert order(postprocess.external_rerank(results, asked, providers.OverlapReranker(), 2)) == ["a", "b"]


def test_format_hits(spark):
    data = [("q", s, r, f"c{s}{r}", f"u{s}{r}", f"f{s}{r % 2}", 6000 if r % 2 else 100) for s in range(4) for r in range(1, 6)]
    df = spark.createDataFrame(data, "query_id string, subquery_no int, rank int, content string, url string, file string, file_size bigint")
    sources = spark.createDataFrame([("f01", "WHOLE")], "file string, text string")
    out = postprocess.format_hits(df, sources).orderBy("hit_no").collect()
    assert out[0].content == "WHOLE" and [r.url for r in out[:3]] == ["u01", "u02", "u04"] and len(out) >= 10
    assert postprocess.format_hits(df, sources, budget=6000).orderBy("hit_no").first().content == "c01"


def test_rewrites(spark):
    q = spark.createDataFrame([("1", "helo wrld"), ("2", "x")], "query_id string, query string")
    assert rows(rewrite.spellcheck(q, providers.EchoLLM(lambda t: "fixed"))) == [("1", "fixed"), ("2", "fixed")]
    out = rewrite.generic(q, providers.EchoLLM(lambda t: '["a", "b"]' if "helo" in t else "plain"), "split")
    assert rows(out) == [("1", 0, "a"), ("1", 1, "b"), ("2", 0, "plain")]


def test_retries():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise providers.Unavailable
        return "ok"

    assert providers.retried(call, sleep=waits.append, jitter=lambda: 0) == "ok" and waits == [0.2, 0.4, 0.8]
    with pytest.raises(providers.Unavailable):
        providers.retried(lambda: (_ for _ in ()).throw(providers.Unavailable()), tries=2, sleep=waits.append)


def test_embedding_is_the_same_everywhere(spark):
    df = spark.createDataFrame([("a b",), ("a b",), (None,), ("",)], "content string")
    out = [tuple(r.embedding) for r in providers.embedded(df, providers.HashingEmbedder(8)).collect()]
    assert out[0] == out[1] and out[2] == out[3] and abs(sum(x * x for x in out[0]) - 1) < 1e-6


def test_splitters(spark):
    df = spark.createDataFrame([("a", " ".join(map(str, range(10)))), ("b", "x"), ("c", ""), ("d", None)], "id string, content string")
    out = {(r.id, r.docIndex): r.content for r in splitters.split_tokens(df, 4, 1).collect()}
    assert out == {("a", 0): "0 1 2 3", ("a", 1): "3 4 5 6", ("a", 2): "6 7 8 9", ("b", 0): "x"}
    coded = {(r.id, r.docIndex): r.content for r in splitters.split_tokens(df, 4, 1, str.split, " ".join).collect()}
    assert coded == out
    with pytest.raises(ValueError):
        splitters.token_windows(F.col("content"), 3, 3)
    md = "# A\ntext\n\n## B\nmore\n```\n# no heading\n```\n# C\nend"
    assert splitters.markdown_sections(md, 1000) == ["# A\ntext", "# A\n## B\nmore\n```\n# no heading\n```", "# C\nend"]
    assert all(len(p) <= 20 for p in splitters.pack_lines("one\ntwo three\n" + "long sentence here. and more. " * 3, 20)) and splitters.pack_lines("a\nb", 2000) == ["a\nb"]
    assert splitters.merged_options({"a": 0, "b": 5}, {"a": 1, "b": 2}) == {"a": 1, "b": 5}


def test_markdown_filter(spark):
    df = spark.createDataFrame([("empty", ""), ("heads", "# a\n## b"), ("trail", "# a\n"), ("prose", "# a\ntext"), ("null", None)], "id string, content string")
    assert {r.id for r in transforms.filter_markdown(df).collect()} == {"trail", "prose"}


def test_metadata_steps(spark):
    df = spark.createDataFrame([("a", {"x": "1", "absPath": "p"}), ("b", None)], "id string, metadata map<string,string>")
    out = {r.id: r.metadata for r in transforms.manipulate_metadata(df, [("add", "foobar", 42), ("upsert", "x", "2"), ("remove", "absPath")]).collect()}
    assert out == {"a": {"x": "2", "foobar": "42"}, "b": {"foobar": "42", "x": "2"}}
    with pytest.raises(Exception, match="exists"):
        transforms.manipulate_metadata(df, [("add", "x", 1)]).collect()
    assert transforms.add_metadata(df, {"y": "z"}).where("id = 'b'").first().metadata == {"y": "z"}


def test_common_metadata(spark):
    df = spark.createDataFrame([("f", 0, "a", {"k": "1", "n": "0"}), ("f", 1, "b", {"k": "1", "n": "1"}), ("g", 0, "c", {"k": "2"})], "path string, doc_index int, content string, metadata map<string,string>")
    parents, children = transforms.factored(df, ["path"])
    assert {r.path: r.metadata for r in parents.collect()} == {"f": {"k": "1"}, "g": {"k": "2"}}
    assert {(r.path, r.doc_index): r.metadata for r in children.collect()} == {("f", 0): {"n": "0"}, ("f", 1): {"n": "1"}, ("g", 0): {}}


def test_renumber_and_directories(spark):
    df = spark.createDataFrame([("a", "f", {"docIndex": "5"}), ("b", "f", {"docIndex": "2.0"}), ("c", "f", {"docIndex": "x"})], "id string, file_id string, metadata map<string,string>")
    assert {r.id: (r.metadata["docIndex"], r.metadata["docsTotal"]) for r in transforms.renumber(df).collect()} == {"b": ("0", "3"), "a": ("1", "3"), "c": ("2", "3")}
    files = spark.createDataFrame([("/r/a/x.txt",), ("/r/y.txt",)], "path string")
    entries = spark.createDataFrame([("/r", {"t": "top", "k": "1"}), ("/r/a", {"t": "deep"})], "folder string, metadata map<string,string>")
    out = {r.path: r.metadata for r in transforms.directory_metadata(files, entries, {"k": "all"}).collect()}
    assert out == {"/r/a/x.txt": {"t": "deep", "k": "all"}, "/r/y.txt": {"t": "top", "k": "all"}}


def test_page_merge(spark):
    df = spark.createDataFrame([("f", 1, "a", 3), ("f", 2, "", 0), ("f", 3, "b", 4), ("f", 4, "c", 9), ("f", 5, "d", 1)], "file_id string, page int, content string, tokens int")
    assert [tuple(r)[1:] for r in transforms.merge_pages(df, 7).orderBy("chunk_no").collect()] == [(0, 1, 3, "a\nb", 7), (1, 4, 4, "c", 9), (2, 5, 5, "d", 1)]


T = lambda day: dt.datetime(2024, 1, day)


def test_dedupe(spark):
    schema = "ingest_id int, dataset string, absolute_path string, size bigint, modified_at timestamp"
    new = spark.createDataFrame([(1, "d", "/a", 1, T(2)), (2, "d", "/a", 1, T(3)), (3, "d", "/b", 1, T(1)), (4, "d", "/c", 1, T(5)), (5, "d", "/n", None, None)], schema)
    old = spark.createDataFrame([(0, "d", "/b", 1, T(1)), (0, "d", "/c", 1, T(9)), (0, "d", "/n", None, None)], schema)
    assert {r.ingest_id for r in dedupe.upsert(new, old).collect()} == {2}
    assert {r.ingest_id for r in dedupe.by_file_metadata(new, old).collect()} == {1, 2, 4}
    assert dedupe.none(new, old).count() == 5 and dedupe.strategy(None) is dedupe.upsert
    with pytest.raises(ValueError):
        dedupe.strategy("typo")
    state = old.unionByName(dedupe.upsert(new, old))
    assert dedupe.upsert(new, state).count() == 0
    texts = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "id string, content string")
    assert {r.id for r in dedupe.by_checksum(texts).collect()} == {"a", "c"}


def test_snapshots(spark):
    a = spark.createDataFrame([("k1", "1"), ("k2", "1"), ("k3", None)], "key string, sum string")
    b = spark.createDataFrame([("k1", "1"), ("k2", "2"), ("k4", "1"), ("k3", None)], "key string, sum string")
    diff = dedupe.snapshot_diff(a, b, ["key"], "sum")
    assert rows(diff) == [("k2", "update"), ("k4", "insert")]
    back = dedupe.snapshot_diff(b, a, ["key"], "sum")
    assert ("k4", "delete") in rows(back)
    assert rows(dedupe.merged_state(a, diff, b, ["key"])) == rows(b)


def test_prune_and_orphans(spark):
    files = spark.createDataFrame([("d", "1", "/x/a"), ("d", "2", "/x/b"), ("d", "3", "/y/c")], "dataset string, id string, absolute_path string")
    keep = spark.createDataFrame([("/x/a",)], "absolute_path string")
    assert [r.id for r in dedupe.prune(files, keep, "/x/").collect()] == ["2"]
    docs = spark.createDataFrame([("d", "1"), ("other", "2")], "dataset string, file_id string")
    assert sorted(r.id for r in dedupe.orphans(files, docs).collect()) == ["2", "3"]


def test_frame_query(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (5, "b", None), (9, "c", 7.0)], "`my col` int, name string, v double")
    pick = lambda e, **v: [r.name for r in lookup.sheet_query(df, e, ["name"], v).collect()]
    assert pick("1 < `my col` <= 9") == ["b", "c"] and pick("name in ['a', 'c'] and not v > 5") == ["a"] and pick("v != 2") == ["b", "c"] and pick("v == v") == ["a", "c"]
    assert pick("`my col` % 2 == 1 and v * 2 >= 14") == ["c"] and pick("name in @w", w=["b"]) == ["b"] and pick("(name == 'a') | (name == 'b')") == ["a", "b"]
    for bad in ("__import__('os')", "nothing > 1", "name.upper() == 'A'"):
        with pytest.raises((ValueError, KeyError)):
            lookup.frame_query(bad, df.columns)


def test_blank_rows(spark):
    df = spark.createDataFrame([(1, ""), (2, "a"), (3, "b"), (4, ""), (5, ""), (6, "c"), (7, "")], "n int, v string")
    assert rows(lookup.blank_row_tables(df, "n", F.col("v") == "").select("n", "table_no")) == [(2, 1), (3, 1), (6, 2)]


def test_lookups(spark):
    msgs = spark.createDataFrame([("m", "hi <@U1> and <@U9>!")], "id string, text string")
    users = spark.createDataFrame([("U1", "ada")], "user_id string, name string")
    assert lookup.mentions_named(msgs, users).first().text == "hi @ada and <@U9>!"
    replies = spark.createDataFrame([("m", "m", 0, "self")] + [(f"r{k}", "m", k, "x") for k in range(1, 6)], "id string, parent_id string, ts int, text string")
    assert [r.reply_id for r in lookup.with_replies(msgs, replies).orderBy("reply_no").collect()] == ["r1", "r2", "r3"]
    maps = [spark.createDataFrame([("k", [1]), ("l", [2])], "k string, v array<int>"), spark.createDataFrame([("k", [3])], "k string, v array<int>")]
    assert rows(lookup.merged_lists(maps, "k", "v")) == [("k", [1, 3]), ("l", [2])]
    sites = spark.createDataFrame([(["a", "b"],), (["a"],)], "s array<string>")
    assert sites.where(lookup.has_scopes(F.col("s"), ["a", "b"])).count() == 1
    tree = spark.createDataFrame([("1", None, "A"), ("2", "1", "B"), ("3", "2", "C"), ("4", "3", "D")], "id string, parent_id string, title string")
    assert rows(lookup.ancestor_paths(tree)) == [("1", "A", 0), ("2", "A/B", 1), ("3", "A/B/C", 2), ("4", "A/B/C/D", 3)]
    issues = spark.createDataFrame([(1, "Crash on start", "r"), (2, "crash later", "s"), (3, "other", "r")], "id int, title string, repo string")
    assert [r.id for r in lookup.issue_search(issues, "crash", repo="r").collect()] == [1]


def test_sql(spark):
    spark.createDataFrame([(1, "a")], "k int, v string").createOrReplaceTempView("sql_t")
    assert sql.query_json(spark, "SELECT k, v FROM sql_t") == {"columns": ["k", "v"], "rows": [{"k": 1, "v": "a"}]}
    for bad in ("", "  ", "DROP VIEW sql_t", "SELECT 1 AS a, 2 AS a"):
        with pytest.raises(ValueError):
            sql.query(spark, bad)
    sql.execute(spark, "CREATE OR REPLACE TEMP VIEW sql_u AS SELECT 2 AS n")
    assert {"sql_t", "sql_u"} <= {r.name for r in sql.list_tables(spark).collect()} and "CREATE TABLE sql_u (n int);" in sql.context(spark)


def test_connectors(spark):
    from strataline.operators import connectors as C

    users = spark.createDataFrame([("u1", "Ada", None, "person"), ("u2", None, "bot", "app"), ("u3", "x", "Adam", None)], "id string, name string, real_name string, account_type string")
    assert [r.id for r in C.named_like(users, "Ada", "name", "real_name").collect()] == ["u1", "u3"] and C.users(users).count() == 2 and C.users(users, True).count() == 3
    urls = spark.createDataFrame([("https://host/owner/repo/issues/3",), ("bad",)], "u string")
    assert [tuple(r) for r in urls.select(*C.repository(F.col("u"))).collect()] == [("owner", "repo"), (None, None)]
    assert spark.createDataFrame([("#a, b,,#c",)], "t string").select(C.tags(F.col("t"))).first()[0] == ["a", "b", "c"]
    types = spark.createDataFrame([("1", "bug"), ("2", "task")], "id string, name string")
    states = spark.createDataFrame([("1", "open"), ("1", "done"), ("1", "open")], "type_id string, status string")
    assert rows(C.types_with_statuses(types, states)) == [("1", "bug", ["done", "open"]), ("2", "task", [])]
    blocks = spark.createDataFrame([("p", 0, 0, "heading_1", "H", None, None), ("p", 1, 1, "to_do", "x", True, None), ("p", 2, 0, "image", "pic", None, "u")], "page_id string, position int, depth int, type string, text string, checked boolean, url string")
    assert C.rendered_blocks(blocks).first().text == "# H\n  - [x] x\n[pic](u)"
    parts = spark.createDataFrame([([("text/html", "x"), ("text/plain", "aGk_")],)], "p array<struct<mime_type:string,data:string>>")
    assert parts.select(C.first_text_part(F.col("p"))).first()[0] == "hi?"
    doc = spark.createDataFrame([(1, 0, "p", 1, "T", None), (1, 1, "row", 0, None, ["a", "b"]), (1, 2, "row", 0, None, ["1", "2"])], "doc_id int, position int, kind string, level int, text string, cells array<string>")
    assert C.document_markdown(doc).first().markdown == "# T\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    rec = spark.createDataFrame([("d", "daily", 2, None, dt.date(2024, 1, 1), dt.date(2024, 1, 6), None), ("w", "weekly", 2, ["monday", "friday"], dt.date(2024, 1, 1), None, 3)], "id string, type string, `interval` int, days_of_week array<string>, start date, end date, occurrences int")
    got = {k: [r.day.day for r in C.recurrence_dates(rec).where(F.col("id") == k).orderBy("day").collect()] for k in "dw"}
    assert got == {"d": [1, 3, 5], "w": [1, 5, 15]}
    mail = spark.createDataFrame([("1", "s", T(1), [("f", "i")]), ("2", "s", T(2), [("", "i")])], "id string, subject string, sent_at timestamp, parts array<struct<filename:string,attachment_id:string>>")
    assert C.mail_by(mail, subject="s").first().id == "2" and C.mail_by(mail, id="1").first().has_attachment
    labels = spark.createDataFrame([(1,), (2,)], "n int").select(C.reply_label(F.col("n")))
    assert [r[0] for r in labels.collect()] == ["1 reply", "2 replies"]
    assert C.priorities(spark.createDataFrame([("s", ["hi", "lo"]), ("t", ["x"])], "scheme string, priorities array<string>"), "s").count() == 2


def test_many_query_terms_are_joined(spark, chunks, asked, monkeypatch):
    want = rows(ranking.bm25_scores(asked, chunks))
    monkeypatch.setattr(ranking, "LISTED_TERMS", 1)
    assert rows(ranking.bm25_scores(asked, chunks)) == want


def test_numbering_is_by_key_and_without_gaps(spark):
    df = spark.range(5000).select(F.format_string("k%05d", (F.col("id") * 7919) % 5000).alias("k")).repartition(7)
    out = lookup.numbered(df, "k", "n").orderBy("n").collect()
    assert [r.n for r in out] == list(range(1, 5001)) and [r.k for r in out] == sorted(r.k for r in out)
    known = spark.createDataFrame([("k00003", 10)], "external_id string, id bigint")
    got = {r.external_id: r.id for r in lookup.numbered_ids(known, spark.createDataFrame([("b",), ("a",), ("k00003",)], "external_id string")).collect()}
    assert got == {"k00003": 10, "a": 11, "b": 12}


def test_recurrences_of_months_and_years(spark):
    import datetime as dt

    from strataline.operators import connectors


    day = dt.date.fromisoformat
    base = {"interval": 1, "days_of_week": None, "day_of_month": None, "index": None, "month": None, "first_day_of_week": None, "end": None, "occurrences": None, "start": day("2027-02-02")}
    given = [
        {"id": 1, "type": "absoluteMonthly", "day_of_month": 31, "occurrences": 3},
        {"id": 2, "type": "relativeMonthly", "index": "last", "days_of_week": ["Friday"], "interval": 2, "end": day("2027-07-01")},
        {"id": 3, "type": "absoluteYearly", "day_of_month": 1, "month": 2, "occurrences": 2},
        {"id": 4, "type": "relativeYearly", "index": "second", "days_of_week": ["monday", "tuesday"], "month": 3, "occurrences": 2},
        {"id": 5, "type": "weekly", "days_of_week": ["Wednesday", "Thursday"], "interval": 3, "occurrences": 3},
        {"id": 6, "type": "absoluteMonthly"},
        {"id": 7, "type": "hourly"},
        {"id": 8, "type": "daily", "interval": 4, "end": day("2027-02-12"), "occurrences": None},
    ]
    schema = "id int, type string, interval int, days_of_week array<string>, day_of_month int, index string, month int, first_day_of_week string, start date, end date, occurrences int"
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple({**base, **g}[n] for n in names) for g in given], schema)
    got = {}
    for r in connectors.recurrence_dates(df).orderBy("id", "day").collect():
        got.setdefault(r.id, []).append(r.day.isoformat())
    assert got == {
        1: ["2027-02-28", "2027-03-31", "2027-04-30"],
        2: ["2027-02-26", "2027-04-30", "2027-06-25"],
        3: ["2028-02-01", "2029-02-01"],
        4: ["2027-03-02", "2028-03-07"],
        5: ["2027-02-03", "2027-02-04", "2027-02-24"],
        8: ["2027-02-02", "2027-02-06", "2027-02-10"],
    }
    errors = {r.id: r.error for r in connectors.recurrence_error(df).collect() if r.error}
    assert errors == {6: "no day of the month", 7: "unknown type"}
