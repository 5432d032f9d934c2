"""Text splitters of ingestion: token windows, Markdown sections, line packing."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_TOKENS, OVERLAP_TOKENS = 2048, 256


def merged_options(custom: dict | None, defaults: dict) -> dict:
    """Custom options over defaults; zero and empty values take the default."""
    return {**defaults, **{k: v for k, v in (custom or {}).items() if v}}


def token_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` space-separated tokens that start every ``size - overlap``; the last one ends with the text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    tokens = F.split(text, " ", -1)
    count = F.greatest(F.ceil((F.size(tokens) - overlap) / F.lit(step)).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(tokens, i * step + 1, F.lit(size)), " "))


def split_tokens(df: DataFrame, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, encode: Callable[[str], list] | None = None, decode: Callable[[list], str] | None = None) -> DataFrame:
    """One row per window: ``docIndex`` and ``content`` beside the other columns. Without a tokenizer, tokens are what spaces separate, in the JVM."""
    rest = [c for c in df.columns if c not in ("content", "docIndex")]
    if encode is None or decode is None:
        windows = token_windows(F.col("content"), size, overlap)
        return df.where(F.col("content") != "").select(*rest, F.posexplode(windows).alias("docIndex", "content"))
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            ids = texts.map(encode)
            yield ids.map(lambda t: [decode(t[i : i + size]) for i in range(0, max(1, len(t) - overlap), step)])

    return df.where(F.col("content") != "").select(*rest, F.posexplode(cut("content")).alias("docIndex", "content"))


def vocabulary_tokenizer(path: str, pattern: str) -> tuple[Callable[[str], list], Callable[[list], str]]:
    """Encoder and decoder of a byte-level vocabulary file (base64 token and rank a line) with its public pre-token pattern, such as that of cl100k_base."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
    encoding = tiktoken.Encoding(name=path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary, encoding.decode


_FENCE = re.compile(r"^\s*(```|~~~)")
_HEADING = re.compile(r"^(#{1,6})\s+(.*)$")


def markdown_sections(text: str, limit: int, with_headings: bool = True) -> list[str]:
    """Sections of a Markdown text under their heading path; a section above ``limit`` characters is cut at paragraphs, never inside a code block."""
    path: list[tuple[int, str]] = []
    sections: list[tuple[str, list[str]]] = []
    body: list[str] = []
    fenced = False

    def close() -> None:
        if any(line.strip() for line in body):
            sections.append(("\n".join(h for _, h in path), list(body)))
        body.clear()

    for line in text.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
        heading = None if fenced else _HEADING.match(line)
        if heading:
            close()
            level = len(heading.group(1))
            path[:] = [p for p in path if p[0] < level] + [(level, line.strip())]
        else:
            body.append(line)
    close()
    out: list[str] = []
    for head, lines in sections:
        blocks: list[str] = []
        fenced, held = False, []
        for line in lines:
            if _FENCE.match(line):
                fenced = not fenced
            if not line.strip() and not fenced:
                if held:
                    blocks.append("\n".join(held))
                held = []
            else:
                held.append(line)
        if held:
            blocks.append("\n".join(held))
        prefix = f"{head}\n" if with_headings and head else ""
        part = ""
        for block in blocks:
            if part and len(prefix) + len(part) + 2 + len(block) > limit:
                out.append(prefix + part)
                part = block
            else:
                part = f"{part}\n\n{block}" if part else block
        if part:
            out.append(prefix + part)
    return out


def pack_lines(text: str, limit: int = 2000) -> list[str]:
    """Lines packed greedily up to ``limit`` characters; a line above it is packed again by its sentences."""
    pieces: list[str] = []
    held: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal size
        joined = "".join(held).strip()
        if joined:
            pieces.append(joined)
        held.clear()
        size = 0

    def add(part: str) -> None:
        nonlocal size
        if size + len(part) > limit:
            flush()
        held.append(part)
        size += len(part)

    for line in text.split("\n"):
        if len(line) < limit:
            add(line + "\n")
            continue
        flush()
        for sentence in line.split("."):
            if sentence:
                add(sentence + ".")
        flush()
    flush()
    return pieces


def _split_by(df: DataFrame, function: Callable[[str], list[str]]) -> DataFrame:
    rest = [c for c in df.columns if c not in ("content", "docIndex")]

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(function)

    return df.where(F.col("content") != "").select(*rest, F.posexplode(cut("content")).alias("docIndex", "content"))


def split_markdown(df: DataFrame, limit: int = CHUNK_TOKENS * 4) -> DataFrame:
    return _split_by(df, lambda t: markdown_sections(t, limit))


def split_lines(df: DataFrame, limit: int = 2000) -> DataFrame:
    return _split_by(df, lambda t: pack_lines(t, limit))


SPLITTERS: dict[str, Callable[..., DataFrame]] = {"text": split_tokens, "markdown": split_markdown, "lines": split_lines}


def splitter_for(filetype: str) -> str:
    """Name of the default splitter of a file type."""
    return "markdown" if filetype in (".md", "text/markdown") else "text"
