"""Document loaders by file type: ``(path, doc_index, content, metadata)`` rows.

Files are read by Spark's binary, text, CSV and JSON sources; formats without one are
parsed per file in Arrow batches, so a folder of any size spreads over the executors.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from fnmatch import translate
from typing import Protocol
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions.html import to_text
from strataline.functions.scalars import media_type
from strataline.operators.providers import OCR

DOCUMENTS = "path string, doc_index int, content string, metadata map<string,string>"
Page = tuple[str, dict[str, str]]

# Extensions that name their type without a look at the content.
FIRST_CLASS = (".pdf", ".html", ".md", ".txt", ".docx", ".doc", ".odt", ".rtf", ".pptx", ".ppt", ".pages", ".csv", ".ipynb", ".json", ".go", ".py", ".js", ".ts", ".c", ".cpp", ".java", ".sql", ".yaml", ".yml")


def file_type(path: Column, head: Column | None = None, mime: Column | None = None) -> Column:
    """Type of a file: its extension where that is known, else what its first bytes or its MIME type say, else plain text."""
    ext = F.lower(F.regexp_extract(path, "(\\.[^./\\\\]+)$", 1))
    out = F.when(ext.isin(*FIRST_CLASS), ext)
    if head is not None:
        hex_ = F.hex(F.substring(head, 1, 5))
        out = out.when(hex_.startswith("25504446"), ".pdf").when(hex_.startswith("504B0304"), ".zip").when(hex_.startswith("7B5C727466"), ".rtf")
        out = out.when(F.lower(F.decode(F.substring(head, 1, 200), "UTF-8")).rlike("^\\s*(<!doctype html|<html)"), ".html")
    if mime is not None:
        plain = media_type(mime)
        known = {"application/pdf": ".pdf", "text/html": ".html", "text/markdown": ".md", "text/csv": ".csv", "application/json": ".json", "text/plain": ".txt", "application/rtf": ".rtf"}
        for k, v in known.items():
            out = out.when(plain == k, v)
    return out.otherwise(".txt")


# --- parsers of one file --------------------------------------------------------------


def text_pages(data: bytes) -> list[Page]:
    return [(data.decode("utf-8", "replace"), {})]


def html_pages(data: bytes) -> list[Page]:
    return [(to_text(data.decode("utf-8", "replace")), {})]


def csv_rows(text: str) -> list[list[str]]:
    """Rows of a CSV text. Where strict reading fails at a row, that line is read leniently and strict reading goes on behind it."""
    lines = text.splitlines(keepends=True)
    rows: list[list[str]] = []
    at = 0
    while at < len(lines):
        reader = csv.reader(iter(lines[at:]), strict=True)
        used = 0
        try:
            for row in reader:
                rows.append(row)
                used = reader.line_num
            return rows
        except csv.Error:
            at += used
            rows.extend(csv.reader([lines[at]]) if lines[at].count('"') % 2 == 0 else csv.reader([lines[at]], quoting=csv.QUOTE_NONE))
            at += 1
    return rows


def csv_pages(data: bytes) -> list[Page]:
    """A document per row, ``column: value`` lines; a row with a stray quote, and no other, is read with its quotes as they stand."""
    rows = csv_rows(data.decode("utf-8-sig", "replace"))
    if not rows:
        return []
    return [("\n".join(f"{h}: {v}" for h, v in zip(rows[0], r)), {"row": str(n)}) for n, r in enumerate(rows[1:]) if r]


def notebook_pages(data: bytes) -> list[Page]:
    cells = json.loads(data).get("cells", [])
    out = []
    for cell in cells:
        source = cell.get("source", "")
        text = "".join(source) if isinstance(source, list) else source
        if text.strip():
            out.append((f"```\n{text}\n```" if cell.get("cell_type") == "code" else text, {"cell": cell.get("cell_type", "")}))
    return out


def _paragraphs(root: ElementTree.Element, tags: Sequence[str]) -> str:
    lines = []
    for node in root.iter():
        if node.tag.rsplit("}", 1)[-1] in tags:
            parts = []
            for x in node.iter():
                tag = x.tag.rsplit("}", 1)[-1]
                if tag == "tab":
                    parts.append("\t")
                elif tag in ("br", "line-break"):
                    parts.append("\n")
                if x.text and tag in ("t", "span", "p", "h", "a"):
                    parts.append(x.text)
                if x.tail and tag in ("span", "line-break", "tab", "a", "s"):
                    parts.append(x.tail)
            lines.append("".join(parts))
    return "\n".join(lines)


def _core_properties(archive: zipfile.ZipFile, name: str) -> dict[str, str]:
    try:
        root = ElementTree.fromstring(archive.read(name))
    except (KeyError, ElementTree.ParseError):
        return {}
    wanted = {"title", "creator", "subject", "description", "language"}
    return {t: n.text.strip() for n in root.iter() if (t := n.tag.rsplit("}", 1)[-1]) in wanted and n.text and n.text.strip()}


def docx_pages(data: bytes) -> list[Page]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        return [(_paragraphs(ElementTree.fromstring(archive.read("word/document.xml")), ("p",)), _core_properties(archive, "docProps/core.xml"))]


def odt_pages(data: bytes) -> list[Page]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        return [(_paragraphs(ElementTree.fromstring(archive.read("content.xml")), ("p", "h")), _core_properties(archive, "meta.xml"))]


_RTF = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.I | re.S)
_RTF_SKIP = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator"}


def rtf_pages(data: bytes) -> list[Page]:
    out: list[str] = []
    stack: list[bool] = []
    skip = False
    for word, number, hex_, symbol, brace, char in _RTF.findall(data.decode("latin-1")):
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif symbol == "*" or word.lower() in _RTF_SKIP:
            skip = True
        elif skip:
            continue
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
        elif hex_:
            out.append(bytes.fromhex(hex_).decode("cp1252", "replace"))
        elif symbol in ("\\", "{", "}"):
            out.append(symbol)
        elif char:
            out.append(char)
    return [("".join(out).strip(), {})]


_PDF_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_PDF_SHOWN = re.compile(rb"\((?:[^()\\]|\\.)*\)|\bT(?:\*|[dD]\b)|\bET\b|<([0-9A-Fa-f\s]+)>\s*Tj", re.S)
_PDF_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3})")
_PDF_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes) -> str:
    def one(m: re.Match) -> bytes:
        x = m.group(1)
        return _PDF_NAMED.get(x) or (bytes([int(x, 8) & 255]) if x[:1].isdigit() else x)

    return _PDF_ESCAPE.sub(one, raw[1:-1]).decode("latin-1")


def pdf_pages(data: bytes, start_page: int = 1, max_pages: int = 0) -> list[Page]:
    """A document per page from the text that content streams show in simple fonts; other encodings need a page provider."""
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    texts = []
    for head, body in _PDF_STREAM.findall(data):
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body or b"/Image" in head:
            continue
        parts = []
        for m in _PDF_SHOWN.finditer(body):
            x = m.group()
            if x.startswith(b"("):
                parts.append(_pdf_string(x))
            elif not x.startswith(b"<"):
                parts.append("\n")
        texts.append(re.sub(r"\n{2,}", "\n", "".join(parts)).strip())
    total = len(texts)
    kept = list(enumerate(texts, 1))[max(0, start_page - 1) :]
    kept = kept[:max_pages] if max_pages > 0 else kept
    return [(t, {"page": str(n), "totalPages": str(total), "docIndex": str(k)}) for k, (n, t) in enumerate(kept)]


def pptx_pages(data: bytes) -> list[Page]:
    """A document per slide."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = sorted((int(m.group(1)), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        texts = [_paragraphs(ElementTree.fromstring(archive.read(n)), ("p",)) for _, n in names]
    return [(t, {"page": str(k), "totalPages": str(len(texts))}) for k, t in enumerate(texts, 1)]


def document_pages(data: bytes) -> list[Page]:
    """An office document of any kind that can be told from its content."""
    if data.startswith(b"{\\rtf"):
        return rtf_pages(data)
    if data.startswith(b"PK"):
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            names = set(archive.namelist())
        if "word/document.xml" in names:
            return docx_pages(data)
        if "content.xml" in names:
            return odt_pages(data)
        if any(n.startswith("ppt/slides/") for n in names):
            return pptx_pages(data)
    raise ValueError("an old binary office document needs a converter" if data.startswith(b"\xd0\xcf\x11\xe0") else "no office document")


def structured_pages(data: bytes) -> list[Page]:
    """Documents of one structured JSON text, the parent's metadata under each child's."""
    given = json.loads(data)
    parent = given.get("metadata") or {}
    out = []
    for k, doc in enumerate(given.get("documents") or []):
        meta = {**parent, **(doc.get("metadata") or {})}
        meta.setdefault("docIndex", k)
        out.append((doc.get("content"), {str(a): b if isinstance(b, str) else json.dumps(b) for a, b in meta.items()}))
    return out


#: Reads the text of a page image or of a whole file; set by ``use_ocr``.
_OCR: list[OCR] = []


def use_ocr(ocr: OCR | None) -> None:
    """The provider that the OCR loaders ask."""
    _OCR[:] = [ocr] if ocr else []


def ocr_pages(data: bytes) -> list[Page]:
    """A file read by the OCR provider, one document per form feed."""
    if not _OCR:
        raise ValueError("OCR is not available: no provider is set")
    return [(t, {"page": str(k)}) for k, t in enumerate(_OCR[0].read(data).split("\f"), 1)]


def smart_pages(data: bytes) -> list[Page]:
    """A PDF's own text, and the OCR provider's where the file has an empty page or text for none."""
    pages = pdf_pages(data)
    if pages and all(t.strip() for t, _ in pages) or not _OCR:
        return pages
    return ocr_pages(data)


LOADERS: dict[str, Callable[[bytes], list[Page]]] = {
    "plaintext": text_pages, "markdown": text_pages, "html": html_pages, "pdf": pdf_pages, "gopdf": pdf_pages, "mupdf": pdf_pages,
    "csv": csv_pages, "notebook": notebook_pages, "docx": docx_pages, "odt": odt_pages, "rtf": rtf_pages, "pptx": pptx_pages,
    "document": document_pages, "structured": structured_pages, "smartpdf": smart_pages, "ocr_openai": ocr_pages,
}
DEFAULT_LOADER = {".pdf": "pdf", ".html": "html", ".md": "markdown", ".csv": "csv", ".ipynb": "notebook", ".docx": "docx", ".doc": "document", ".odt": "odt", ".rtf": "rtf", ".pptx": "pptx", ".ppt": "document", ".pages": "document"}


def loader(name: str) -> Callable[[bytes], list[Page]]:
    try:
        return LOADERS[name]
    except KeyError:
        raise ValueError(f"unknown document loader: {name}") from None


def loader_for(filetype: str) -> str:
    """Name of the default loader of a file type; text where there is none of its own."""
    return DEFAULT_LOADER.get(filetype, "plaintext")


# --- frames of files ------------------------------------------------------------------


def files(spark: SparkSession, path: str, recursive: bool = True, hidden: bool = False) -> DataFrame:
    """``(path, modified_at, size, data)`` of a folder; hidden files and those of hidden folders only on request."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    df = df.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"), F.col("content").alias("data"))
    return df if hidden else df.where(~F.col("path").rlike("/\\.[^/]"))


def folder_uri(spark: SparkSession, path: str) -> str:
    """A folder's path in the form of its files' paths, with a slash at its end."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(p).toString().rstrip("/") + "/"


# Always ignored.
BUILTIN_IGNORES = (".git/", ".DS_Store", "~$*")


def ignored(path: Column, patterns: Sequence[str], extensions: Sequence[str] = ()) -> Column:
    """Whether ignore patterns, in rising order of priority, match a path: the last that matches decides, ``!`` keeps."""
    out = F.lit(False)
    for raw in [*patterns, *[f"*{e}" for e in extensions], *BUILTIN_IGNORES]:
        pattern = raw.strip()
        if not pattern or pattern.startswith("#"):
            continue
        keep = pattern.startswith("!")
        pattern = pattern.lstrip("!")
        body = translate(pattern.strip("/")).replace("\\Z", "").replace("\\z", "").replace("(?s:", "(?:").replace(".*", "[^/]*")
        front = "(^|/)" if not pattern.startswith("/") else "^/?"
        end = "/" if pattern.endswith("/") else "(/|$)"
        out = F.when(path.rlike(front + body + end), F.lit(not keep)).otherwise(out)
    return out


def load(df: DataFrame, name: str | None = None) -> DataFrame:
    """Documents of files ``(path, data)``, by the named loader or that of each file's type. A file that cannot be read gives one row of null content with the error in metadata."""
    if name is not None:
        loader(name)
    ocr = list(_OCR)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_ocr(ocr[0] if ocr else None)
        for batch in batches:
            rows: list[tuple] = []
            for path, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    pages = loader(name or loader_for(kind))(data or b"")
                except Exception as e:  # noqa: BLE001 - one broken file must not end the job
                    rows.append((path, 0, None, [("error", f"{type(e).__name__}: {e}"[:500])]))
                    continue
                rows += [(path, k, text, list({**meta, "loader": name or loader_for(kind)}.items())) for k, (text, meta) in enumerate(pages)]
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.map_(pa.string(), pa.string()))],
                names=["path", "doc_index", "content", "metadata"],
            )

    return df.select("path", file_type(F.col("path"), F.col("data")).alias("kind"), "data").mapInArrow(parse, DOCUMENTS)


def needs_ocr(content: Column, images: Column, has_table: Column, on_empty: bool = True, on_images: int = 0, on_table: bool = False) -> Column:
    """Whether a page goes to optical recognition: it is empty, holds so many images, or a table, as far as each is asked for."""
    out = F.lit(False)
    if on_empty:
        out = out | (F.coalesce(F.trim(content), F.lit("")) == "")
    if on_images > 0:
        out = out | (F.coalesce(images, F.lit(0)) >= on_images)
    if on_table:
        out = out | F.coalesce(has_table, F.lit(False))
    return out


def recognised(pages: DataFrame, ocr: OCR, concurrency: int = 3) -> DataFrame:
    """``(path, page, content)`` of page images by an OCR provider, at most ``concurrency`` calls of one task at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with ThreadPoolExecutor(max(1, concurrency)) as calls:
                texts = list(calls.map(ocr.read, batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["path", "page", "content"])

    return pages.select("path", F.col("page").cast("int"), "image").mapInArrow(read, "path string, page int, content string")


def structured(df: DataFrame, json_column: str = "json") -> DataFrame:
    """Documents of structured JSON ``{metadata, documents: [{metadata, content}]}``: the parent's metadata under each child's, ``docIndex`` defaulting to the place."""
    schema = "metadata map<string,string>, documents array<struct<metadata:map<string,string>,content:string>>"
    parsed = df.select("path", F.from_json(json_column, schema).alias("_s"))
    docs = parsed.select("path", F.col("_s.metadata").alias("_parent"), F.posexplode("_s.documents").alias("doc_index", "_d"))
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    child = F.coalesce(F.col("_d.metadata"), empty)
    base = F.map_filter(F.coalesce("_parent", empty), lambda k, v: ~F.map_contains_key(child, k))
    merged = F.map_concat(base, child)
    index = F.when(F.map_contains_key(merged, "docIndex"), merged).otherwise(F.map_concat(merged, F.create_map(F.lit("docIndex"), F.col("doc_index").cast("string"))))
    return docs.select("path", "doc_index", F.col("_d.content").alias("content"), index.alias("metadata"))


def transcript(items: DataFrame, key: str = "video_id", order: str = "start", text: str = "text") -> DataFrame:
    """Transcript items of each video joined by spaces, in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ")
    return items.groupBy(key).agg(joined.alias(text))


def search_results(results: DataFrame, limit: int, barred: str = "youtube.com") -> DataFrame:
    """The first ``limit`` distinct result links in order, without video links."""
    seen = results.where(~F.col("url").contains(barred)).groupBy("url").agg(F.min("position").alias("position"))
    return seen.orderBy("position", "url").limit(limit)


def readable(files_: DataFrame, limit: int = 65_536) -> DataFrame:
    """Workspace files that may be read: within the size limit and valid UTF-8."""
    ok = (F.octet_length("data") <= limit) & F.expr("is_valid_utf8(cast(data as string))")
    return files_.where(ok).withColumn("content", F.col("data").cast("string"))


# --- sheets ---------------------------------------------------------------------------


def sheet(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A sheet exported as CSV, types inferred."""
    return spark.read.option("header", header).option("inferSchema", True).option("mode", "PERMISSIVE").csv(path)


def sheet_range(cells: DataFrame, first_row: int, last_row: int, columns: Sequence[str]) -> DataFrame:
    """Rows of a rectangle; ``row_no`` counts from 1."""
    return cells.where(F.col("row_no").between(first_row, last_row)).select("row_no", *columns)


def header_peek(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("row_no") <= 3)


# --- interfaces to what runs elsewhere ------------------------------------------------


class Converter(Protocol):
    """Turns a file of one format into another, such as an office document into a PDF."""

    name: str

    def convert(self, data: bytes, source: str, target: str) -> bytes: ...


def converted(df: DataFrame, converter: Converter, kinds: Sequence[str], target: str = ".pdf") -> DataFrame:
    """Files ``(path, data)`` with those of some types converted; the path keeps its name and takes the new ending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, datas = [], []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ending = next((k for k in kinds if path.lower().endswith(k)), None)
                paths.append(path if ending is None else path[: -len(ending)] + target)
                datas.append(data if ending is None else converter.convert(data, ending, target))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(datas, pa.binary())], names=["path", "data"])

    return df.select("path", "data").mapInArrow(run, "path string, data binary")


_GIT = re.compile(r"^(https?://[^/@]+/[^@]+?)(?:\.git)?(?:@([^@/]+))?$")


def remote_repository(url: str, hosts: Sequence[str]) -> tuple[str, str | None] | None:
    """(clone URL, wanted revision) of a link to a repository on one of the hosts; None for another link. A resolver fetches it."""
    m = _GIT.match(url)
    if not m or not any(h in url for h in hosts):
        return None
    return m.group(1) + ".git", m.group(2)
