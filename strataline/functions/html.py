"""HTML to text, Markdown, links and parts, by the standard parser, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: What a page is cleaned of: tags, classes and ids of scripts, styles and page furniture.
BOILERPLATE = ("script", "style", "noscript", "iframe", "svg", "template", "nav", "header", "footer", "aside", "form", ".nav", ".navbar", ".header", ".footer", ".sidebar", ".menu", ".breadcrumb", ".cookie", "#nav", "#header", "#footer", "#sidebar")
MAIN = ("main", "article", "#main", "#content", ".main", ".content", "body")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def matches(self, selector: str) -> bool:
        """Tag, ``.class`` or ``#id``."""
        if selector[:1] == ".":
            return selector[1:] in (self.attrs.get("class") or "").split()
        if selector[:1] == "#":
            return self.attrs.get("id") == selector[1:]
        return self.tag == selector

    def nodes(self) -> Iterator[Node]:
        stack: list[Node] = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style"):
                stack.extend(reversed(x.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def without(root: Node, selectors: tuple[str, ...]) -> Node:
    for node in list(root.nodes()):
        node.children = [c for c in node.children if isinstance(c, str) or not any(c.matches(s) for s in selectors)]
    return root


def first(root: Node, selectors: tuple[str, ...]) -> Node:
    for s in selectors:
        for node in root.nodes():
            if node.matches(s):
                return node
    return root


def to_text(html: str) -> str:
    text = without(parse(html), ("script", "style", "noscript")).text()
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


_BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li", "figure", "dl", "dt", "dd", "body", "html"}


def _inline(node: Node | str) -> str:
    if isinstance(node, str):
        return re.sub(r"\s+", " ", node)
    body = "".join(map(_inline, node.children))
    if node.tag in ("b", "strong") and body.strip():
        return f"**{body.strip()}**"
    if node.tag in ("i", "em") and body.strip():
        return f"*{body.strip()}*"
    if node.tag == "code":
        return f"`{node.text()}`"
    if node.tag == "a":
        return f"[{body.strip()}]({node.attrs['href']})" if node.attrs.get("href") and body.strip() else body
    if node.tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs['src']})" if node.attrs.get("src") else ""
    if node.tag == "br":
        return "\n"
    return "" if node.tag in ("script", "style", "head", "title") else body


def _blocks(node: Node, depth: int) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = "".join(run).strip()
        if text:
            out.append(text)
        run.clear()

    for child in node.children:
        if isinstance(child, str) or child.tag not in _BLOCK:
            if isinstance(child, Node) and child.tag == "hr":
                flush()
                out.append("---")
            else:
                run.append(_inline(child))
            continue
        flush()
        tag = child.tag
        if re.fullmatch(r"h[1-6]", tag):
            title = _inline_all(child)
            if title:
                out.append(f"{'#' * int(tag[1])} {title}")
        elif tag in ("ul", "ol"):
            items, n = [], 0
            for li in child.children:
                if isinstance(li, Node) and li.tag == "li":
                    n += 1
                    mark = f"{n}." if tag == "ol" else "-"
                    parts = _blocks(li, depth + 1)
                    items.append("  " * depth + f"{mark} " + (parts[0] if parts else ""))
                    items.extend(p if p.lstrip().startswith(("-", "1.")) else "  " * (depth + 1) + p for p in parts[1:])
            if items:
                out.append("\n".join(items))
        elif tag == "pre":
            out.append(f"```\n{child.text().strip(chr(10))}\n```")
        elif tag == "blockquote":
            out.append("\n".join(f"> {line}" for line in "\n\n".join(_blocks(child, depth)).split("\n")))
        elif tag == "table":
            rows = [[_inline_all(c).replace("|", "\\|") for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")] for tr in child.nodes() if tr.tag == "tr"]
            rows = [r for r in rows if r]
            if rows:
                width = max(map(len, rows))
                rows = [r + [""] * (width - len(r)) for r in rows]
                lines = [f"| {' | '.join(r)} |" for r in rows]
                out.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
        else:
            out.extend(_blocks(child, depth))
    flush()
    return out


def _inline_all(node: Node) -> str:
    return " ".join("".join(map(_inline, node.children)).split())


def to_markdown(html: str, drop: tuple[str, ...] = ("script", "style", "noscript")) -> str:
    return "\n\n".join(_blocks(without(parse(html), drop), 0))


def main_markdown(html: str) -> str:
    """Markdown of the first main part of a page, without boilerplate."""
    root = without(parse(html), BOILERPLATE)
    return "\n\n".join(_blocks(first(root, MAIN), 0))


def links(html: str, base: str) -> list[tuple[str, str]]:
    """(text, absolute URL) of the anchors of a page; fragments and scripts are none."""
    out = []
    for node in parse(html).nodes():
        href = node.attrs.get("href", "").strip() if node.tag == "a" else ""
        if href and not href.startswith(("#", "javascript:", "mailto:")):
            out.append((" ".join(node.text().split()), urljoin(base, href)))
    return out


def images(html: str, base: str) -> list[tuple[str, str]]:
    return [(n.attrs.get("alt", ""), urljoin(base, n.attrs["src"])) for n in parse(html).nodes() if n.tag == "img" and n.attrs.get("src")]


def selected(html: str, selector: str) -> list[str]:
    """Texts of the elements that a tag, class or id selector names."""
    return [" ".join(n.text().split()) for n in parse(html).nodes() if n.matches(selector)]


_REACH = {"siblings": 1, "two_siblings": 2}
_UP = {"parent": 1, "grandparent": 2}


def matching(html: str, keywords: list[str], mode: str = "all", whole_html: bool = False) -> list[str]:
    """Texts that keywords select: of elements whose own text holds all of them (``all``) or any (``any``), or
    of the neighbourhood of an element with text that holds them all: the element with its neighbours on
    one level (``siblings``, ``two_siblings``), or the one above it (``parent``, ``grandparent``), each once.

    Case is ignored. ``whole_html`` also looks at what is inside and at attributes; an element's ``value`` counts as its text.
    """
    words = [k.lower() for k in keywords]
    out: list[str] = []
    done: set[int] = set()
    for node in parse(html).nodes():
        own = "".join(c for c in node.children if isinstance(c, str)) + " " + node.attrs.get("value", "")
        if not whole_html and not own.strip():
            continue
        if mode in _UP:
            above = node
            for _ in range(_UP[mode]):
                above = above.parent if above is not None else None
            if above is None or id(above) in done:
                continue
            done.add(id(above))
            around = [above]
        elif mode in _REACH and node.parent:
            level = [c for c in node.parent.children if isinstance(c, Node)]
            k = next(i for i, c in enumerate(level) if c is node)
            around = level[max(0, k - _REACH[mode]) : k + _REACH[mode] + 1]
        else:
            around = [node]
        text = " ".join(" ".join(x.text().split()) for x in around).strip()
        looked = f"{text} {own}" if whole_html or mode in _UP or mode in _REACH else own
        if whole_html:
            looked += " " + " ".join(" ".join(y.attrs.values()) for x in around for y in (x, *x.nodes()))
        if text and (any if mode == "any" else all)(w in looked.lower() for w in words):
            out.append(text)
    return out


def _mapped(pages: DataFrame, key: str, html: str, function, name: str) -> DataFrame:
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([function(h) if h is not None else None for h in batch.column(1).to_pylist()], pa.string())], names=[key, name])

    return pages.select(key, F.col(html)).mapInArrow(run, f"`{key}` {kind}, `{name}` string")


def page_texts(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``(key, text)``; a null page stays null."""
    return _mapped(pages, key, html, to_text, "text")


def page_markdown(pages: DataFrame, key: str, html: str = "html", main_only: bool = True) -> DataFrame:
    """``(key, markdown)`` of each page, of its main part or whole; a null page stays null."""
    return _mapped(pages, key, html, main_markdown if main_only else to_markdown, "markdown")


def page_links(pages: DataFrame, key: str, html: str = "html", url: str = "url") -> DataFrame:
    """``(key, text, href)``, one row per link; null pages have none."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts, hrefs = [], [], []
            for k, (h, u) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for text, href in links(h, u or "") if h else ():
                    at.append(k)
                    texts.append(text)
                    hrefs.append(href)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(texts, pa.string()), pa.array(hrefs, pa.string())], names=[key, "text", "href"])

    return pages.select(key, F.col(html), F.col(url)).mapInArrow(run, f"`{key}` {kind}, text string, href string")
