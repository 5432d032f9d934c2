import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataline.functions import html
from strataline.functions import scalars as S


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize(
    "link,base,want",
    [
        ("example.com", "example.com", True), ("www.example.com", "example.com", True), ("www1.example.com", "example.com", True), ("sub.example.com", "example.com", False),
        ("www.sub.example.com", "example.com", False), ("example.com", "www.example.com", True), ("example.com", "www1.example.com", True), ("example.com", "www1.cn.example.com", False),
        ("example.com", "example.net", False), ("blog.example.com", "www.example.com", False), ("www.example.com", "www.example.com", True), ("www.ukcry.org", "cry.org", False),
    ],
)
def test_same_site(spark, link, base, want):
    assert one(spark, S.same_site(F.col("a"), F.col("b")), a=link, b=base) is want


PAIRS = [("A", 1), ("B", 2), ("Z", 26), ("AA", 27), ("AB", 28), ("AZ", 52), ("BA", 53), ("ZZ", 702), ("AAA", 703), ("AAB", 704), ("ABA", 729), ("BAA", 1379), ("JAZZ", 177138), ("YEET", 442930)]


def test_column_letters(spark):
    df = spark.createDataFrame(PAIRS, "letters string, number bigint")
    for r in df.select("*", S.column_number(F.col("letters")).alias("n"), S.column_letters(F.col("number")).alias("l")).collect():
        assert (r.n, r.l) == (r.number, r.letters)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=1, max_size=30))
def test_letters_round_trip(spark, numbers):
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    assert df.where(S.column_number(S.column_letters(F.col("n"))) != F.col("n")).count() == 0


def test_serial_dates(spark):
    df = spark.createDataFrame([(1,), (59,), (60,), (61,), (45000,)], "n int")
    got = [r[0] for r in df.orderBy("n").select(S.serial_date(F.col("n"))).collect()]
    assert got == [dt.date(1899, 12, 31), dt.date(1900, 2, 27), dt.date(1900, 2, 28), dt.date(1900, 3, 1), dt.date(2023, 3, 15)]


@pytest.mark.parametrize("score,low,high,want", [(0.0, 0.0, 0.0, 0.0), (2.0, 2.0, 2.0, 1.0), (3.0, 1.0, 5.0, 0.5)])
def test_minmax(spark, score, low, high, want):
    assert one(spark, S.minmax(F.col("s"), F.col("a"), F.col("b")), s=score, a=low, b=high) == want


def test_links(spark):
    url = lambda u: one(spark, S.url_file(F.col("u")), u=u)
    assert url("https://h.example") == "h.example/index.html" and url("https://h.example/") == "h.example/index.html"
    assert url("https://h.example/a/b/") == "h.example/a/b.html" and url("https://h.example/a?x=1&y=2") == "h.example/a?x%3D1%26y%3D2.html"
    video = lambda u: one(spark, S.video_id(F.col("u")), u=u)
    assert video("https://www.youtube.com/watch?v=abc&t=3") == "abc" and video("https://youtu.be/xyz") == "xyz" and video("https://www.youtube.com/live/q1?x=2") == "q1" and video("https://example.org/a") is None
    ref = "A" * 33
    drive = lambda u: one(spark, S.drive_file_id(F.col("u")), u=u)
    assert drive(ref) == ref and drive(f"https://docs.google.com/document/d/{ref}/edit") == ref and drive("short") is None
    scope = lambda h, p: one(spark, S.in_scope(F.col("h"), F.col("p"), F.lit("x.org"), F.lit("/docs/")), h=h, p=p)
    assert scope("x.org", "/docs/a") and scope("", "a") and not scope("y.org", "/docs/a") and not scope("x.org", "/blog")


def test_strings(spark):
    assert one(spark, S.quoted_phrases(F.col("t")), t='say "one two" and " " or "x"') == ["one two", "x"]
    assert one(spark, S.drop_blank_lines(F.col("t")), t="a\n \n\nb") == "a\nb"
    assert one(spark, S.truncated(F.col("t"), 3), t="abcd") == "abc..." and one(spark, S.truncated(F.col("t"), 4), t="abcd") == "abcd"
    assert one(spark, S.media_type(F.col("t")), t="text/html; charset=x") == "text/html"
    assert one(spark, S.csv_field(F.col("t")), t='a,"b"') == '"a,""b"""'
    assert one(spark, S.usage_label(F.col("t")), t="text-embedding-3") == "text-embedding" and one(spark, S.usage_label(F.col("t")), t="other") == "llm"
    assert one(spark, S.from_base64url(F.col("t")), t="w6k_") == "é?"
    assert one(spark, S.epoch_seconds(F.col("t")), t="1700000000.25").microsecond == 250000


def test_redaction_walks_structs(spark):
    df = spark.createDataFrame([("u", "k", ("x", "p"), [("t1",)]), ("u", None, None, None)], "Username string, ApiKey string, Nested struct<name:string,Password:string>, List array<struct<token:string>>")
    out = S.redact_secrets(df).collect()
    assert out[0] == ("u", "REDACTED", ("x", "REDACTED"), [("REDACTED",)]) and out[1] == ("u", None, None, None)
    assert S.redact_secrets(df, ["username"]).first()[0] == "REDACTED"


def test_metadata_rules(spark):
    df = spark.createDataFrame([({"a": "1", "b": "-", "c": "null", "d": "nil", "e": "", "f": None, "g": "x"}, {"a": "2", "h": "3", "g": "nil"}), (None, {"a": "1"}), ({"a": "1"}, None)], "o map<string,string>, n map<string,string>")
    got = [r[0] for r in df.select(S.updated_metadata(F.col("o"), F.col("n"))).collect()]
    assert got == [{"a": "2", "h": "3"}, {"a": "1"}, {"a": "1"}]


PAGE = """<html><head><title>T</title></head><body><nav><a href="/n">N</a></nav><main id="main"><h1>Head <b>x</b></h1><p>One <i>two</i> <a href="b.html">link</a></p>
<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul><pre>x = 1</pre><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table><img src="i.png" alt="pic"></main><script>bad()</script></body></html>"""


def test_html():
    assert html.links(PAGE, "https://h.org/a/") == [("N", "https://h.org/n"), ("link", "https://h.org/a/b.html")]
    md = html.main_markdown(PAGE)
    assert md.startswith("# Head **x**\n\nOne *two* [link](b.html)") and "- b\n  - c" in md and "| k | v |\n| --- | --- |\n| 1 | 2 |" in md and "bad" not in md and "[N]" not in md
    assert html.images(PAGE, "https://h.org/a/") == [("pic", "https://h.org/a/i.png")] and html.selected(PAGE, "#main")[0].startswith("Head x")
    assert html.matching(PAGE, ["ONE"], "all") == ["One two link"] and html.matching(PAGE, ["zzz"]) == []
    assert html.to_text("<p>a</p>\n<style>x</style><p>b") == "a\nb"
    form = "<form><div><label>Your name</label><input value='Ann'></div><div><p>Other</p></div></form>"
    assert html.matching(form, ["name", "ann"], "siblings") == ["Your name"] and html.matching(form, ["name", "other"], "siblings") == []
    assert html.matching(form, ["your name"], "parent") == ["Your name"] and html.matching(form, ["name", "other"], "grandparent") == ["Your nameOther"]


def test_html_frames(spark):
    df = spark.createDataFrame([(1, PAGE, "https://h.org/"), (2, None, None), (3, "", "x")], "id int, html string, url string")
    assert {r.id: (r.markdown or "")[:6] for r in html.page_markdown(df, "id").collect()} == {1: "# Head", 2: "", 3: ""}
    assert html.page_links(df, "id").count() == 2 and html.page_texts(df.limit(0), "id").count() == 0


def test_sql_functions(spark):
    from strataline.functions.sql_functions import register_functions

    assert "vector_cosine" in register_functions(spark)
    row = spark.sql(
        """SELECT vector_cosine(array(3, 4), array(6, 8)) AS c, vector_cosine(array(1), array(1, 2)) AS n, vector_cosine(array(0), array(1)) AS z, vector_norm(array(3, 4)) AS l,
        score_minmax(3, 1, 5) AS m, serial_date(45000) AS d, column_number('JAZZ') AS k, quoted_phrases('a "b c" " "') AS q"""
    ).first()
    assert (row.c, row.n, row.z, row.l, row.m, row.d, row.k, row.q) == (1.0, None, None, 5.0, 0.5, dt.date(2023, 3, 15), 177138, ["b c"])


def test_properties_as_text(spark):
    data = [
        ("checkbox", "true", "true"), ("date", '{"start": "2024-01-01"}', "2024-01-01"), ("date", '{"start": "a", "end": "b"}', "a - b"), ("multi_select", '[{"name": "x"}, {"name": "y"}]', "x, y"),
        ("people", '[{"name": "one"}]', "one"), ("rich_text", '[{"plain_text": "a"}, {"plain_text": "b"}]', "ab"), ("select", '{"name": "s"}', "s"), ("unique_id", '{"prefix": "P", "number": 7}', "P-7"),
        ("formula", '{"number": 3}', "3"), ("relation", '[{"id": "1"}, {"id": "2"}]', "1, 2"), ("number", "5", "5"), ("url", None, None),
    ]
    df = spark.createDataFrame(data, "kind string, value string, want string")
    assert [tuple(r) for r in df.select("want", S.property_text(F.col("kind"), F.col("value")).alias("got")).collect() if r.want != r.got] == []


def test_ids_of_linked_files(spark):
    from strataline.functions import scalars

    known = "a1B2" * 8 + "-_"
    refs = [known, f"https://docs.google.com/document/d/{known}/edit", f"https://drive.google.com/file/d/{known}", f"https://drive.google.com/open?id={known}", f"https://drive.google.com/uc?x=1&id={known}",
            f"https://other.example/file/d/{known}", "https://drive.google.com/file/d/short", "short", "https://drive.google.com/", None]
    df = spark.createDataFrame([(r,) for r in refs], "ref string")
    assert [r[0] for r in df.select(scalars.drive_file_id(F.col("ref"))).collect()] == [known] * 5 + [None] * 5


def test_current_time_in_utc(spark):
    from strataline.functions import scalars

    text = spark.range(1).select(scalars.utc_now()).first()[0]
    said = dt.datetime.strptime(text, "%Y-%m-%dT%H:%M:%S.%fZ").replace(tzinfo=dt.timezone.utc)
    assert abs((dt.datetime.now(dt.timezone.utc) - said).total_seconds()) < 60


def test_secrets_of_every_name(spark):
    df = spark.sql("SELECT 'a' AS auth, named_struct('password', 'p', 'name', 'n') AS credentials, 'b' AS credentials2, 't' AS Token")
    row = S.redact_secrets(df).first()
    assert (row.auth, row.credentials.password, row.credentials.name, row.credentials2, row.Token) == ("REDACTED", "REDACTED", "n", "b", "REDACTED")
