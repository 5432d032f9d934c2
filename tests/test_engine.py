import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from strataline.core.catalog import Catalog
from strataline.core.client import Client, directory_dataset
from strataline.plans.flow import ConfigError, FlowConfig, selected_providers
from strataline.sources import loaders, sinks
from strataline.streaming import sync

VALID = """
flows:
  one:
    default: true
    ingestion:
      - filetypes: [".json"]
        documentloader: {name: structured}
        textsplitter: {name: text, options: {chunkSize: 100}}
        transformers: [{name: filter_markdown_docs_no_content}]
    retrieval: {}
  two:
    retrieval:
      retriever: {name: merge, options: {topK: 10, retrievers: [{name: basic, weight: 0.5}, {name: bm25, weight: 0.5}]}}
      postprocessors: [{name: bm25, options: {topN: 10, sparseWeight: 0.5}}]
datasets: {d: two}
"""


def test_flow_config():
    config = FlowConfig.parse(VALID)
    assert config.select().name == "one" and config.select(dataset="d").name == "two" and config.select("two").name == "two" and config.select(dataset="x").name == "one"
    assert config.flows["one"].ingestion_for(".json").splitter_options == {"chunkSize": 100, "chunkOverlap": 256} and config.flows["one"].ingestion_for(".pdf") is None
    for bad in ("just text", "flows: {a: {default: true}, b: {default: true}}", "flows: {a: {retrieval: {retriever: {name: nope}}}}", "flows: {a: {}}\ndatasets: {d: b}", "{"):
        with pytest.raises(ConfigError):
            FlowConfig.parse(bad)
    assert FlowConfig.parse(json.dumps({"flows": {"a": {"default": True}}})).select().name == "a"
    for name in ("default", "context", "hosted"):
        assert FlowConfig.blueprint(name).select().default
    assert selected_providers({"providers": [{"name": "a"}, {"name": "b"}]}, "b") == {"providers": [{"name": "b"}]}


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_file_parsers():
    docx = _zip(word__document_xml='<w:document xmlns:w="x"><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:t>three</w:t></w:p></w:document>', docProps__core_xml='<c xmlns:d="y"><d:title>T</d:title></c>')
    assert loaders.docx_pages(docx) == [("one\ttwo\nthree", {"title": "T"})]
    odt = _zip(content_xml='<o xmlns:t="x"><t:h>Head</t:h><t:p>a<t:span>b</t:span>c</t:p></o>')
    assert loaders.odt_pages(odt)[0][0] == "Head\nabc"
    assert loaders.rtf_pages(rb"{\rtf1{\fonttbl x;}Hello\par w\'e9 {\b bold}}")[0][0] == "Hello\nw\xe9 bold"
    assert loaders.csv_pages(b'a,b\n1,"x"\n2,y') == [("a: 1\nb: x", {"row": "0"}), ("a: 2\nb: y", {"row": "1"})]
    assert len(loaders.csv_pages(b'a,b\n1,x"y\n2,"z')) == 2
    assert [p[0] for p in loaders.notebook_pages(json.dumps({"cells": [{"cell_type": "markdown", "source": ["# t"]}, {"cell_type": "code", "source": "x=1"}]}).encode())] == ["# t", "```\nx=1\n```"]
    page = b"BT (Hello \\(x\\)) Tj T* (there) Tj ET"
    pdf = b"%PDF-1.4\n1 0 obj<< /Length 1 >>stream\n" + page + b"\nendstream endobj 2 0 obj<< /Filter /FlateDecode >>stream\n" + zlib.compress(page) + b"\nendstream"
    assert [(t, m["page"], m["totalPages"]) for t, m in loaders.pdf_pages(pdf)] == [("Hello (x)\nthere", "1", "2"), ("Hello (x)\nthere", "2", "2")]
    with pytest.raises(ValueError):
        loaders.pdf_pages(b"no")
    with pytest.raises(ValueError):
        loaders.loader("nope")
    assert loaders.text_pages(b"test") == [("test", {})]


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in {"a.md": "# x\nbody", "sub/b.txt": "plain", ".hidden": "h", "c.pdf": "broken", "d.log": "<html><p>z</p></html>"}.items():
        (tmp_path / name).write_text(text)
    df = loaders.files(spark, str(tmp_path))
    assert df.count() == 4
    docs = {r.path.rsplit("/", 1)[1]: r for r in loaders.load(df).collect()}
    assert docs["b.txt"].content == "plain" and docs["c.pdf"].content is None and "ValueError" in docs["c.pdf"].metadata["error"] and docs["d.log"].content == "z"
    kept = df.where(~loaders.ignored(F.col("path"), ["*.md", "sub/", "!sub/b.txt"]))
    assert {r.path.rsplit("/", 1)[1] for r in kept.collect()} == {"b.txt", "c.pdf", "d.log"}


def test_structured_round_trip(spark):
    text = json.dumps({"metadata": {"k": "p", "only": "x"}, "documents": [{"metadata": {"k": "c"}, "content": "one"}, {"content": "two"}]})
    df = spark.createDataFrame([("f", text)], "path string, json string")
    docs = loaders.structured(df)
    got = {r.doc_index: (r.content, r.metadata) for r in docs.collect()}
    assert got == {0: ("one", {"k": "c", "only": "x", "docIndex": "0"}), 1: ("two", {"k": "p", "only": "x", "docIndex": "1"})}
    again = {r.doc_index: (r.content, r.metadata) for r in loaders.structured(sinks.structured_json(docs)).collect()}
    assert again == got
    assert sinks.DOC_BREAK in sinks.markdown(docs).first().markdown


def test_sheets(spark):
    sheet = spark.createDataFrame([(1, "a"), (2, "=B1")], "row_no int, v string")
    value, formula = sinks.sheet_cells(F.col("v"))
    assert [tuple(r) for r in sheet.select(value, formula).collect()] == [("a", None), (None, "=B1")]
    assert sinks.update_cell(sheet, 2, "v", "z").where("row_no = 2").first().v == "z"
    assert sinks.append_rows(sheet, spark.createDataFrame([(3,)], "row_no int")).count() == 3
    assert loaders.header_peek(loaders.sheet_range(sheet, 2, 9, ["v"])).count() == 1


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    c.create_dataset("d", metadata={"a": "1", "b": "-"})
    assert c.dataset("d")["metadata"] == {"a": "1"}
    with pytest.raises(ValueError):
        c.create_dataset("d")
    c.create_dataset("d", error_on_exists=False)
    c.update_dataset("d", {"c": "2", "a": None})
    assert c.dataset("d")["metadata"] == {"c": "2"}
    c.update_dataset("d", {"z": "9"}, replace=True)
    assert c.dataset("d")["metadata"] == {"z": "9"}
    files = spark.createDataFrame([("f1", "d", "a.txt", "/x/a.txt", 3, None), ("f2", "d", "b.txt", "/x/b.txt", 4, None)], "id string, dataset string, name string, absolute_path string, size bigint, modified_at timestamp")
    chunks = spark.createDataFrame([("c1", "d", "f1", "t", {"docIndex": "0"}, [1.0]), ("c2", "d", "f1", "t", {"docIndex": "1"}, [1.0]), ("c3", "d", "f2", "t", {}, [1.0])], "id string, dataset string, file_id string, content string, metadata map<string,string>, embedding array<float>")
    c.add(files, chunks)
    assert c.size("d") == 3 and c.get_file("d", "./a.txt")["id"] == "f1" and c.get_file("d", "f2")["name"] == "b.txt" and c.find_files("d", size=4, name="").count() == 1
    c.export(str(tmp_path / "out"), "d")
    c.delete_documents(spark.createDataFrame([("d", "c3")], "dataset string, id string"))
    assert c.size("d") == 2 and c.find_files("d").count() == 1
    c.prune("d", "/x/", spark.createDataFrame([], "absolute_path string"))
    assert c.size("d") == 0 and c.find_files("d").count() == 0
    c.import_(str(tmp_path / "out"))
    assert c.size("d") == 3
    c.remove_chunks("d", id="c1")
    assert c.size("d") == 2
    c.delete_dataset("d")
    assert c.dataset("d") is None and c.size("d") == 0


def test_client(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "fox.txt").write_text("the red fox runs over the hill")
    (folder / "sea.md").write_text("# Sea\nblue whales sing")
    (folder / "only.md").write_text("# heading")
    client = Client(spark, str(tmp_path / "cat"))
    assert client.ingest("d", str(folder)) == {"ingested": 3, "skipped": 0}
    assert client.ingest("d", str(folder)) == {"ingested": 0, "skipped": 3}
    top = client.retrieve("red fox", ["d"]).orderBy("rank").first()
    assert "fox" in top.content and top.metadata["filename"] == "fox.txt" and top.rank == 1
    assert client.ask_directory(str(folder), "whales").orderBy("rank").first().content.endswith("blue whales sing")
    (folder / "fox.txt").unlink()
    assert client.ask_directory(str(folder), "fox").count() == 1 and client.catalog.size(directory_dataset(str(folder))) == 1


def test_sync_stream(spark, tmp_path):
    src = tmp_path / "src"
    schema = "key string, value string, at bigint, gone boolean"
    run = lambda: sync.sync(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "state"), str(tmp_path / "cp"), ["key"], "at", "gone").awaitTermination()
    spark.createDataFrame([("a", "1", 1, False), ("b", "1", 1, False), ("a", "2", 2, False)], schema).coalesce(1).write.mode("append").parquet(str(src))
    run()
    spark.createDataFrame([("a", "0", 1, False), ("b", None, 5, True), ("c", "1", 5, False)], schema).coalesce(1).write.mode("append").parquet(str(src))
    run()
    assert sorted((r.key, r.value) for r in sync.read_state(spark, str(tmp_path / "state"), schema, 1).collect()) == [("a", "2"), ("c", "1")]
    assert sorted((r.key, r.value) for r in sync.read_state(spark, str(tmp_path / "state"), schema, 0).collect()) == [("a", "2"), ("b", "1")]
    spark.createDataFrame([("b", "late", 3, False), ("d", "x", None, False), ("d", "y", 1, False), ("e", "z", None, False)], schema).coalesce(1).write.mode("append").parquet(str(src))
    run()  # an older change does not bring back what was deleted; a null time is the oldest, and its row stays whole
    assert sorted((r.key, r.value) for r in sync.read_state(spark, str(tmp_path / "state"), schema, 2).collect()) == [("a", "2"), ("c", "1"), ("d", "y"), ("e", "z")]


def test_windows_drop_late_rows(spark, tmp_path):
    src = tmp_path / "ev"
    schema = "ts timestamp, k string"
    events = lambda *t: spark.createDataFrame([(x, "k") for x in t], "ts string, k string").select(F.to_timestamp("ts").alias("ts"), "k").coalesce(1).write.mode("append").parquet(str(src))
    events("2024-01-01 00:01:00", "2024-01-01 00:04:00")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = sync.tumbling_counts(stream, "ts", "5 minutes", "1 minute", ["k"])
    go = lambda: out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    go()
    events("2024-01-01 00:30:00")
    go()
    events("2024-01-01 00:02:00", "2024-01-01 01:00:00")
    go()
    got = sorted((r.window_start.minute, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[0] == (0, 2) and all(n <= 2 for _, n in got)


def test_workbooks(spark):
    from strataline.sources import workbooks

    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="b"><v>1</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><f>1+1</f><v>2</v></c><c r="C2"/></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{ns}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", f'<Relationships><Relationship Id="t" Type="{rel}/table" Target="x"/></Relationships>')
    df = spark.createDataFrame([("w.xlsx", bytearray(out.getvalue()))], "path string, data binary")
    assert [tuple(r)[1:] for r in workbooks.sheets(df).collect()] == [(0, "One", 1), (1, "Two", 0)]
    assert [tuple(r)[2:] for r in workbooks.cells(df, "One").collect()] == [(1, "A", "name", None), (1, "B", "TRUE", None), (2, "A", "ab", None), (2, "B", "2", "=1+1")]
    assert {(r.row_no, r.A, r.B) for r in workbooks.grid(workbooks.cells(df), ["A", "B"]).collect()} == {(1, "name", "TRUE"), (2, "ab", "2")}


def test_interfaces(spark):
    class Upper:
        name = "upper"

        def convert(self, data, source, target):
            return data.upper()

    df = spark.createDataFrame([("a.doc", bytearray(b"x")), ("b.txt", bytearray(b"y"))], "path string, data binary")
    assert {(r.path, bytes(r.data)) for r in loaders.converted(df, Upper(), [".doc"]).collect()} == {("a.pdf", b"X"), ("b.txt", b"y")}
    assert loaders.remote_repository("https://host.example/o/r@v1", ["host.example"]) == ("https://host.example/o/r.git", "v1")
    assert loaders.remote_repository("https://host.example/o/r.git", ["host.example"]) == ("https://host.example/o/r.git", None)
    assert loaders.remote_repository("https://other.example/o/r", ["host.example"]) is None

    class Reads:
        def read(self, image):
            return image.decode()[::-1]

    images = spark.createDataFrame([("p", 1, bytearray(b"abc"))], "path string, page int, image binary")
    assert loaders.recognised(images, Reads()).first().content == "cba"
    pages = spark.createDataFrame([("", 0, False), ("x", 2, False), ("x", 0, True), ("x", 0, None)], "content string, images int, has_table boolean")
    ask = lambda **o: [r[0] for r in pages.select(loaders.needs_ocr(F.col("content"), F.col("images"), F.col("has_table"), **o)).collect()]
    assert ask() == [True, False, False, False] and ask(on_images=1, on_table=True) == [True, True, True, False]


def test_command_line(spark, tmp_path, capsys):
    from strataline.__main__ import main, parser

    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.txt").write_text("green apples and pears")
    root = ["--root", str(tmp_path / "data")]
    main([*root, "create-dataset", "d"])
    main([*root, "ingest", "d", str(folder)])
    main([*root, "retrieve", "apples", "d"])
    main([*root, "edit-dataset", "d", "--metadata", '{"k": "v"}'])
    main([*root, "get-dataset", "d"])
    main([*root, "load", str(folder)])
    main([*root, "export", str(tmp_path / "out")])
    main([*root, "query", "/root/testdata/sf0.001", "SELECT count(*) AS n FROM nation"])
    main([*root, "delete-dataset", "d"])
    main([*root, "list-datasets"])
    out = capsys.readouterr().out
    assert '{"ingested": 1, "skipped": 0}' in out and "green apples" in out and '"k": "v"' in out and '{"columns": ["n"], "rows": [{"n": 25}]}' in out and '"documents"' in out
    with pytest.raises(SystemExit):
        parser().parse_args(["nothing"])


def test_keywords_by_a_model(spark):
    from strataline.operators.providers import EchoLLM
    from strataline.operators.transforms import TRANSFORMS

    df = spark.createDataFrame([("a", {"k": "v"})], "content string, metadata map<string,string>")
    assert TRANSFORMS["keywords"](df, llm=EchoLLM(lambda t: "x, y")).first().metadata == {"k": "v", "keywords": "x,y"}


def test_stray_quotes_spoil_only_their_own_row():
    from strataline.sources.loaders import csv_rows

    text = 'name,n\n"Smith, J",1\n12" pipe,2\n"open,3\n"Roe, A",4\n'
    assert csv_rows(text) == [["name", "n"], ["Smith, J", "1"], ['12" pipe', "2"], ['"open', "3"], ["Roe, A", "4"]]
    assert csv_rows('a,b\n"two\nlines",1\n') == [["a", "b"], ["two\nlines", "1"]] and csv_rows("") == []


def test_two_writers_lose_nothing(spark, tmp_path):
    from strataline.core.catalog import Catalog

    one = Catalog(spark, str(tmp_path / "root"))
    two = Catalog(spark, str(tmp_path / "root"))
    write = one._write
    raced = []

    def late(name, version, manifest):
        if not raced:
            raced.append(version)
            two.create_dataset("second")  # takes the number that the first was about to take
        return write(name, version, manifest)

    one._write = late
    one.create_dataset("first")
    assert [r.id for r in one.datasets().collect()] == ["first", "second"]


def test_askdir_prunes_files_of_any_folder(spark, tmp_path):
    from strataline.core.client import Client

    folder = tmp_path / "docs"
    for sub in ("a", "b"):
        (folder / sub).mkdir(parents=True)
        (folder / sub / f"{sub}.txt").write_text(f"text of {sub}")
    client = Client(spark, str(tmp_path / "root"))
    assert client.ask_directory(str(folder), "text").count() == 2
    (folder / "b" / "b.txt").unlink()
    assert [r.content for r in client.ask_directory(str(folder), "text").collect()] == ["text of a"]


KEYS = """
flows:
  one:
    default: true
    ingestion:
      - filetypes: [".txt", ".md"]
        documentLoader: {name: textLoader}
        textSplitter: {name: simpleSplitter}
        transformers: [{name: transformer1}]
    retrieval: {}
  two:
    ingestion:
      - filetypes: [".json"]
        documentLoader: {name: structured}
        textSplitter: {name: text, options: {chunkSize: 40}}
    retrieval: {}
"""


def test_flow_keys_in_camel_case_and_names_looked_up_on_use():
    config = FlowConfig.parse(KEYS)
    rule = config.flows["two"].ingestion_for(".json")
    assert (rule.loader, rule.splitter, rule.splitter_options["chunkSize"]) == ("structured", "text", 40)
    with pytest.raises(ConfigError):
        config.flows["one"].ingestion_for(".txt")


def _client(spark, root, text, llm=None):
    from strataline.operators.providers import EchoLLM, HashingEmbedder
    from strataline.plans.flow import Models

    embedder = HashingEmbedder()
    return Client(spark, str(root), embedder, FlowConfig.parse(text, Models(llm=llm or EchoLLM(), embed=embedder.embed)))


def test_a_flow_changes_loader_splitter_and_types(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text(" ".join(f"w{k}" for k in range(30)))
    (folder / "b.json").write_text(json.dumps({"metadata": {"m": "1"}, "documents": [{"content": "one two"}, {"content": "three"}]}))
    (folder / "c.csv").write_text("n\n1\n")
    spec = """
flows:
  f:
    default: true
    ingestion:
      - {filetypes: [".txt"], textSplitter: {name: text, options: {chunkSize: 10, chunkOverlap: 5}}}
      - {filetypes: [".json"], documentLoader: {name: structured}}
"""
    client = _client(spark, tmp_path / "root", spec)
    client.ingest("d", str(folder))
    rows = client.catalog.read("chunks", ["d"]).collect()
    assert sorted(r.content for r in rows if "w0" not in r.content and "w" not in r.content[:1]) == ["one two", "three"]
    assert sum(r.content.startswith("w") for r in rows) == 5 and len(rows) == 7
    assert {r.metadata["m"] for r in rows if r.content == "three"} == {"1"}


def test_query_modifiers_subqueries_routing_and_postprocessors(spark, tmp_path):
    from strataline.operators.providers import EchoLLM

    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in (("a", "red apple pie"), ("b", "blue whale song"), ("c", "green tea leaf")):
        (folder / f"{name}.txt").write_text(text)

    def answer(prompt):
        if "Split" in prompt:
            return json.dumps(["red apple", "blue whale"])
        if "datasets" in prompt:
            return "d"
        return "no" if "tea" in prompt else "yes" if "yes or no" in prompt else prompt.rsplit("\n", 1)[-1].replace("appel", "apple")

    base = "flows: {f: {default: true, retrieval: {%s}}}"
    go = lambda spec, query, n: _client(spark, tmp_path / f"r{n}", base % spec, EchoLLM(answer))
    cases = [
        ("queryModifiers: [{name: spellcheck}], retriever: {name: basic, options: {topK: 1}}", "red appel", ["red apple pie"]),
        ("retriever: {name: subquery, options: {limit: 2, topK: 2}}", "apples and whales", ["blue whale song", "red apple pie"]),
        ("retriever: {name: routing, options: {topK: 1, availableDatasets: [d, e]}}", "blue whale", ["blue whale song"]),
        ("retriever: {name: basic}, postprocessors: [{name: content_filter, options: {question: 'q', include: true}}, {name: cohere_rerank, options: {topN: 1}}]", "green apple tea pie", ["red apple pie"]),
    ]
    for n, (spec, query, want) in enumerate(cases):
        client = go(spec, query, n)
        client.ingest("d", str(folder))
        assert sorted(r.content for r in client.retrieve(query, ["d"]).collect()) == want, spec


def test_stop_words_of_the_language_of_each_text(spark):
    from strataline.operators.ranking import cleaned_tokens

    df = spark.createDataFrame([("the cat is on the mat",), ("le chat est dans la maison",), ("xyz",)], "t string")
    assert [r[0] for r in df.select(cleaned_tokens(F.col("t"), ("auto",))).collect()] == [["cat", "mat"], ["chat", "maison"], ["xyz"]]


def test_more_loaders_by_name():
    slide = "<p:sld xmlns:p='p' xmlns:a='a'><a:p><a:r><a:t>Hello slide</a:t></a:r></a:p></p:sld>"
    data = _zip(**{"ppt/slides/slide1.xml": slide})
    assert loaders.loader("document")(data) == [("Hello slide", {"page": "1", "totalPages": "1"})] == loaders.loader("pptx")(data)
    assert loaders.loader("structured")(b'{"documents": [{"content": "x"}]}') == [("x", {"docIndex": "0"})]
    with pytest.raises(ValueError):
        loaders.loader("ocr_openai")(b"image")

    class Reader:
        def read(self, image):
            return "page one\fpage two"

    loaders.use_ocr(Reader())
    try:
        assert [t for t, _ in loaders.loader("ocr_openai")(b"image")] == ["page one", "page two"]
    finally:
        loaders.use_ocr(None)


def test_a_sheet_without_groups_is_numbered_in_buckets(spark):
    from strataline.operators import lookup

    lines = ["", "a", "b", "", "", "c", "", "d", "e", ""]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string").repartition(3)
    got = lookup.blank_row_tables(df, "n", F.col("line") == "", bucket=3).orderBy("n").collect()
    assert [(r.line, r.table_no) for r in got] == [("a", 1), ("b", 1), ("c", 2), ("d", 3), ("e", 3)]
