"""Repair of text from scanned pages: cut words, misread characters, running titles, page numbers.

Misread words are corrected by a noisy channel: the candidates of a word are the corpus
words with the same strokes, a form that no character confusion changes; each has the
probability of the confusions that lead to it, and a Viterbi pass over every line picks the
sequence that maximises these times the word and word-pair likelihoods of the corpus.
Counts of words and pairs stay a table of any size: groups of pages ask it for the strokes
of their own words, and are decoded with what it answers. Running titles are found by
joining the edge lines of the pages of a file on a form that look-alike characters do not
change.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.core.runtime import cut

# What a character is misread as, observed form first, and the share of its occurrences.
CONFUSIONS = [
    ("1", "l", 0.01), ("1", "i", 0.01), ("|", "l", 0.01), ("|", "i", 0.003), ("0", "o", 0.01), ("5", "s", 0.01), ("@", "a", 0.01), ("†", "t", 0.01),
    ("8", "b", 0.003), ("6", "b", 0.003), ("9", "g", 0.003), ("c", "e", 0.01), ("b", "h", 0.01), ("h", "b", 0.003), ("e", "c", 0.003), ("ri", "n", 0.01),
    ("rn", "m", 0.01), ("m", "rn", 0.01), ("ii", "u", 0.01), ("cl", "d", 0.01), ("d", "cl", 0.005), ("vv", "w", 0.01), ("h", "li", 0.005), ("l", "i", 0.003), ("i", "l", 0.003),
    ("n", "u", 0.002), ("u", "n", 0.002), ("$", "s", 0.003), ("€", "e", 0.003), ("3", "e", 0.003), ("4", "a", 0.003), ("7", "t", 0.003), ("2", "z", 0.003),
    ("6", "é", 0.01), ("v", "y", 0.01), ("ii", "ü", 0.01), ("b", "ß", 0.01), ("6", "ó", 0.003), ("o", "ö", 0.002), ("a", "ä", 0.002), ("u", "ü", 0.002), ("f", "t", 0.002), ("t", "f", 0.002), ("q", "g", 0.003),
]
#: Pages that are decoded together.
GROUP_PAGES = 2_000
#: Bits of the filter of strokes that more than one word has; false ones only make pages ask for more.
OPEN_BITS = 26
LEAST_COUNT = 3
#: A correction must be so many times as frequent as the word it replaces.
LEAST_RATIO = 8.0

_BY_FORM: dict[str, list[tuple[str, str, float]]] = {}
for _seen, _true, _share in CONFUSIONS:
    _BY_FORM.setdefault(_seen[0], []).append((_seen, _true, math.log(_share)))

# What characters come to when all confusions are undone: letters as the strokes that they are drawn with.
_STROKES = str.maketrans(
    {c: "l" for c in "i1|r"} | {c: "ll" for c in "nuühb86ßéó"} | {"m": "lll", "d": "cl", "w": "vv", "y": "v", "q": "g", "9": "g", "2": "z", "7": "t", "†": "t", "f": "t"}
    | {c: "c" for c in "e€3"} | {c: "o" for c in "0ö"} | {c: "s" for c in "5$"} | {c: "a" for c in "@4ä"}
)


def strokes(word: str) -> str:
    """A form of a word that no confusion changes."""
    return word.translate(_STROKES)


def _key(word: str) -> int:
    return xxhash.xxh64_intdigest(strokes(word)) - (1 << 63)


def _pair_key(one: int, two: int) -> int:
    """Key of a pair of words from those of the words."""
    return ((one * 0x5851F42D4C957F2D + two) & 0xFFFFFFFFFFFFFFFF) - (1 << 63)

_LETTERS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
# A word of a page: letters and digits, and the marks that stand for letters where they touch one.
_TOKEN = re.compile(r"(?:[@†|$€](?=[^\W\d_]))?[^\W_]+(?:[@†|$€][^\W_]+)*(?:[@†|€](?![^\W_]))?")
# What makes a token part of a code such as ``ab3-417``.
_CODE = re.compile(r"-\d")
_OF_CODE = re.compile(r"\d-$")
_STRANGE = re.compile(r"[@†|$€]|\d")


class Model:
    """Word and word-pair counts of the corpus, as far as they are needed."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], total: int | None = None):
        self.words, self.pairs = words, pairs
        self.total = max(1, sum(words.values()) if total is None else total)
        self.alike: dict[str, list[str]] = {}
        for word, n in words.items():
            if n >= LEAST_COUNT:
                self.alike.setdefault(strokes(word), []).append(word)
        self.known: dict[str, tuple[tuple[str, float], ...]] = {}

    def after(self, word: str, before: str | None) -> float:
        """Log likelihood of a word after another; unseen words have half a count."""
        alone = max(self.words.get(word, 0), 0.5) / self.total
        if before is None or before not in self.words:
            return math.log(alone)
        joint = self.pairs.get((before, word), 0) / self.words[before]
        return math.log(0.7 * joint + 0.3 * alone)

    def candidates(self, word: str) -> tuple[tuple[str, float], ...]:
        """The word itself and the corpus words it may be a misreading of, with log probabilities."""
        if word not in self.known:
            self.known[word] = self._candidates(word)
        return self.known[word]

    def _candidates(self, word: str) -> tuple[tuple[str, float], ...]:
        own = self.words.get(word, 0)
        if own >= 200 and own * 2000 >= self.total or word.isdigit() or len(word) < 3:
            return ((word, 0.0),)
        least = max(LEAST_COUNT, LEAST_RATIO * own)
        found = {true: cost for true in self.alike.get(strokes(word), ()) if true != word and self.words[true] >= least and (cost := misreading(word, true)) is not None}
        if not found:
            return ((word, 0.0),)
        odd = bool(_STRANGE.search(word))
        stays = math.log(1e-4) if odd and any(c.isalpha() for c in word) else 0.0
        return ((word, stays), *sorted(found.items()))


def misreading(seen: str, true: str) -> float | None:
    """Log probability that a word is misread as another, by the best row of confusions; None where no row leads there."""
    best: dict[tuple[int, int], float] = {(0, 0): 0.0}
    for i in range(len(seen)):
        for j in range(len(true) + 1):
            cost = best.get((i, j))
            if cost is None:
                continue
            steps = [(1, 1, 0.0)] if j < len(true) and seen[i] == true[j] else []
            steps += [(len(a), len(b), share) for a, b, share in _BY_FORM.get(seen[i], ()) if seen.startswith(a, i) and true.startswith(b, j)]
            for di, dj, share in steps:
                at = i + di, j + dj
                if cost + share > best.get(at, -math.inf):
                    best[at] = cost + share
    return best.get((len(seen), len(true)))


def correct_line(model: Model, tokens: list[str]) -> list[str]:
    """The most likely words of a line, by Viterbi over the candidates of each token.

    A token with one candidate parts the line: the stretches of several candidates between
    such tokens are decoded on their own, with the neighbours as their ends.
    """
    choices = [model.candidates(t) for t in tokens]
    out = list(tokens)
    at = 0
    while at < len(tokens):
        if len(choices[at]) == 1:
            at += 1
            continue
        end = at
        while end < len(tokens) and len(choices[end]) > 1:
            end += 1
        start: str | None = tokens[at - 1] if at else None
        layers: list[dict[str, tuple[float, str | None]]] = [{start: (0.0, None)}]
        for options in [*choices[at:end], *([((tokens[end], 0.0),)] if end < len(tokens) else [])]:
            before = layers[-1]
            layers.append({w: max(((s + cost + model.after(w, p), p) for p, (s, _) in before.items()), key=lambda x: x[0]) for w, cost in options})
        word = max(layers[-1], key=lambda w: (layers[-1][w][0], w))
        path = []
        for layer in reversed(layers[1:]):
            path.append(word)
            word = layer[word][1]
        out[at:end] = path[::-1][: end - at]
        at = end
    return out


# --- page furniture -------------------------------------------------------------------

_CANON = [("m", "rn"), ("n", "ri"), ("u", "ii"), ("d", "cl"), ("w", "vv"), ("h", "li"), ("b", "li"), ("ß", "li"), ("8", "li"), ("6", "li"), ("|", "l"), ("1", "l"), ("i", "l"), ("!", "l"), ("0", "o"), ("5", "s"), ("$", "s"), ("@", "a"), ("†", "t"), ("e", "c"), ("€", "c"), ("y", "v"), ("9", "g")]


def look(line: str) -> str:
    """A form of a line that is the same for all its misreadings."""
    form = " ".join(line.lower().split())
    for a, b in _CANON:
        form = form.replace(a, b)
    return form


_ROMAN = r"(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_DIGITS = r"(?=[lIoOSs|@]?\d|\d)[\dlIoOSs|]{1,4}"
_PAGE_WORDS = {look(w) for w in ("page", "pag", "pag.", "p.", "p", "pg", "pg.", "seite", "s.", "página", "pagina", "pág.", "blatt", "folio", "hoja", "feuille", "pages")}
_NUMBERED = rf"(?:{_DIGITS}|{_ROMAN})"
_PLAIN_PAGE = re.compile(rf"(?:([^\W\d_@]?[\w@†|]{{0,7}}\.?)\s?)??({_NUMBERED})(?:\s?(?:/|of|von|de|sur|out of)\s?({_DIGITS}))?", re.I)
_FRAMED = re.compile(rf"(?:[-–—~·•*]\s?{_NUMBERED}\s?[-–—~·•*]|[\[(<{{]\s?{_NUMBERED}\s?[\])>}}])", re.I)
_GAP = re.compile(r"\t+|\s{2,}|\s*\|\s*")


def is_page_number(text: str) -> bool:
    """Whether a text is nothing but a page's number, in some notation."""
    text = text.strip()
    if not text or len(text) > 60:
        return False
    if _FRAMED.fullmatch(text):
        return True
    m = _PLAIN_PAGE.fullmatch(text)
    if not m:
        return False
    word = (m.group(1) or "").strip()
    if word and look(word) not in _PAGE_WORDS:
        return False
    return bool(word or m.group(3) or m.group(2).islower() or m.group(2).isdigit() or m.group(2).isupper())


def split_number(line: str) -> tuple[str, bool]:
    """The title of an edge line, and whether a page number stands alone or beside it."""
    text = line.strip()
    if is_page_number(text):
        return "", True
    for gap in _GAP.finditer(text):
        if is_page_number(text[: gap.start()]):
            return text[gap.end() :].strip(" |"), True
    for gap in reversed(list(_GAP.finditer(text))):
        if is_page_number(text[gap.end() :]):
            return text[: gap.start()].strip(" |"), True
    return text, False


_MARKED = ("|", "•", "#", "```", ">", "* ", "- ")
_ENDED = re.compile(r"[.!?:;…)»\"”]$")


def edge_lines(content: str) -> list[tuple[int, str, bool]]:
    """(line, title, numbered) of the page's outer lines that may be furniture; the title is empty for a bare number.

    At either end that is the outermost line and, if that one is furniture, the next. A title
    is short, is no part of a sentence that goes on in its neighbour, and leaves a body.
    """
    lines = [(k, l) for k, l in enumerate(content.split("\n")) if l.strip()]
    out: list[tuple[int, str, bool]] = []
    if len(lines) < 2:
        return out
    for top in (True, False):
        order = lines if top else lines[::-1]
        for depth in (0, 1):
            if depth + 1 >= len(order):
                break
            k, line = order[depth]
            title, numbered = split_number(line)
            inner = order[depth + 1][1].strip()
            if numbered and not title:
                if line.strip().isdigit() and inner.isdigit():
                    break  # a column of figures
                out.append((k, "", True))
                continue
            if len(title) > 120 or len(title) < 3 or title.startswith(_MARKED) or re.search(r"[.;,:]$", title) or not any(c.isalpha() for c in title):
                break
            neighbour, _ = split_number(inner)
            if top and neighbour and neighbour[0].islower():
                break
            if not top and neighbour and not _ENDED.search(neighbour) and not inner.startswith(_MARKED) and depth + 2 < len(order) and not is_page_number(inner):
                if len(neighbour) > 24 or neighbour[-1:].isalpha() is False:
                    break
            out.append((k, title, numbered))
    return out


# --- operators ------------------------------------------------------------------------

_META = "absPath string, page string, loader string"
#: Loaders that read a page's text layer and so give no scanned text.
TEXT_LOADERS = ("pdf", "mupdf", "gopdf")


#: Loaders that give recognised text, whatever the collection's configuration.
OCR_LOADERS = ("ocr_openai", "smartpdf")


def scanned_pages(chunks: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """``(id, file, page, content)`` of the rows that may come from scanned pages: they name a path and a page, and no text-layer loader.

    ``config`` has ``dataset, openai_ocr``. Where a row names no loader, its collection must have
    a row there; a null ``openai_ocr`` stands for recognition with default options. Without
    ``config`` every collection counts.
    """
    meta = F.from_json("metadata", _META)
    rows = chunks.where(F.length("content") > 0).select("id", F.col("collection_id").alias("_c"), "content", meta.alias("_m"))
    rows = rows.where(F.col("_m.absPath").isNotNull() & F.col("_m.page").try_cast("double").isNotNull() & ~F.coalesce(F.lower("_m.loader"), F.lit("")).isin(*TEXT_LOADERS))
    if config is not None:
        read = config.select(F.col("dataset").alias("_c"), F.coalesce("openai_ocr", F.lit("{}")).alias("_ocr")).dropDuplicates(["_c"])
        rows = rows.join(read, "_c", "left").where(F.col("_ocr").isNotNull() | F.coalesce(F.lower("_m.loader"), F.lit("")).isin(*OCR_LOADERS))
    return rows.select("id", F.xxhash64("_c", "_m.absPath").alias("file"), F.col("_m.page").try_cast("double").cast("int").alias("page"), "content")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words are numbered as they come, so that pairs are counted as numbers, by sorting."""
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    words = np.zeros(0, np.int64)
    pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def packed() -> pa.RecordBatch:
        names = pa.array(list(number), pa.string())
        own = np.flatnonzero(words)
        a = pa.concat_arrays([names.take(pa.array(own)), names.take(pa.array(pairs >> 32))])
        b = pa.concat_arrays([pa.nulls(len(own), pa.string()), names.take(pa.array(pairs & 0xFFFFFFFF))])
        return pa.RecordBatch.from_arrays([a, b, pa.array(np.concatenate([words[own], counts]))], names=["a", "b", "n"])

    for batch in batches:
        tokens: list[str] = []
        ends = []
        for text in batch.column(0).to_pylist():
            tokens += _LETTERS.findall(text.lower())
            ends.append(len(tokens))
        own = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
        n = np.bincount(own, minlength=len(number))
        n[: len(words)] += words
        words = n
        inside = np.ones(max(0, len(own) - 1), bool)
        last = np.array(ends) - 1
        inside[last[(last >= 0) & (last < len(inside))]] = False
        code = np.sort(((own[:-1] << 32) | own[1:])[inside])
        heads = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        both, times = np.concatenate([pairs, code[heads]]), np.concatenate([counts, np.diff(np.append(heads, len(code)))])
        order = np.argsort(both, kind="stable")
        both, times = both[order], times[order]
        heads = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else heads
        pairs, counts = both[heads], np.add.reduceat(times, heads) if len(heads) else times
        if len(pairs) > 400_000:
            yield packed()
            number.clear()
            words = pairs = counts = np.zeros(0, np.int64)
    yield packed()


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own: dict[str, int] = {}

    def of(word: str) -> int:
        if word not in own:
            own[word] = _key(word)
        return own[word]

    for batch in batches:
        if len(own) > 1_000_000:
            own.clear()
        key = [of(a) if b is None else _pair_key(of(a), of(b)) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.int64())], names=["a", "b", "n", "key"])


def corpus_counts(texts: DataFrame, text: str = "content") -> DataFrame:
    """``(a, b, n, key)``: how often each word (null ``b``) and each pair of words occurs in all texts, with the hash of their strokes. None is left out."""
    counts = texts.where(F.length(text) > 0).select(F.col(text)).mapInArrow(_count, "a string, b string, n bigint")
    return cut(counts.groupBy("a", "b").agg(F.sum("n").alias("n")).mapInArrow(_keyed, "a string, b string, n bigint, key bigint"))


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = (1 << OPEN_BITS) // 64
    maps: dict[int, np.ndarray] = {}
    for batch in batches:
        for bit in batch.column(1).to_pylist():
            own = maps.setdefault(bit // width, np.zeros(width // 8, np.uint8))
            own[(bit % width) >> 3] |= 1 << (bit & 7)
    yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int32()), pa.array([b.tobytes() for b in maps.values()], pa.binary())], names=["slice", "bits"])


def open_strokes(counts: DataFrame) -> np.ndarray:
    """A bit for strokes that several words have, one of them frequent enough to correct to, and another for those that any such word has. 8 MB whatever the corpus."""
    size = F.lit(1 << OPEN_BITS)
    groups = counts.where("b IS NULL").groupBy("key").agg(F.count("*").alias("k"), F.max("n").alias("most")).where(F.col("most") >= LEAST_COUNT)
    bit = groups.where("k > 1").select(F.pmod("key", size).alias("bit")).unionByName(groups.select(F.pmod(F.shiftright("key", OPEN_BITS), size).alias("bit")))
    placed = bit.select((F.col("bit") / ((1 << OPEN_BITS) // 64)).cast("int").alias("slice"), F.col("bit").cast("bigint").alias("bit"))
    seen = np.zeros((64, (1 << OPEN_BITS) // 512), np.uint8)
    for row in placed.repartition(8, "slice").mapInArrow(_bits, "slice int, bits binary").toLocalIterator():  # 64 rows, 8 MB in all
        seen[row[0]] |= np.frombuffer(row[1], np.uint8)
    return seen.ravel()


def _asks(open_: np.ndarray):
    """What each group of pages needs of the counts: the strokes of words that may be misread, of their neighbours, and of the pairs of these."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[int, bool]] = {}
        mask = (1 << OPEN_BITS) - 1

        def look_up(word: str) -> tuple[int, bool]:
            k = _key(word)
            bit = (k >> OPEN_BITS if _STRANGE.search(word) else k) & mask
            out = seen[word] = k, bool(open_[bit >> 3] >> (bit & 7) & 1)
            return out

        for batch in batches:
            wanted: set[tuple[int, int]] = set()
            keys: list[tuple[int, bool]] = []
            ends, owners = [], []
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(seen) > 1_000_000:
                    seen.clear()
                marked = marked_words(text)
                forms = [text, joined(text, [(at, end, tail) for at, end, tail, _ in marked])] if marked else [text]
                for form in forms:
                    for block in _BLOCK.findall(form.lower()):
                        keys += [seen[t] if t in seen else look_up(t) for t in _TOKEN.findall(block)]
                        ends.append(len(keys))
                        owners.append(part)
                for _, _, _, (head, tail) in marked:
                    wanted |= {(part, _key(f"{head}-{tail}")), (part, _key(head + tail))}
            key, live = np.array([k for k, _ in keys], np.int64), np.array([x for _, x in keys], bool)
            owner = np.repeat(np.array(owners, np.int64), np.diff(np.array([0, *ends])))
            # A word that may be misread, its neighbours in the block, and its pairs with them.
            beside = np.ones(max(0, len(key) - 1), bool)
            last = np.array(ends, np.int64) - 1
            beside[last[(last >= 0) & (last < len(beside))]] = False
            beside &= live[:-1] | live[1:]
            asks = live.copy()
            asks[:-1] |= beside
            asks[1:] |= beside
            one, two = key[:-1][beside].view(np.uint64), key[1:][beside].view(np.uint64)
            pair = ((one * np.uint64(0x5851F42D4C957F2D) + two) ^ np.uint64(1 << 63)).view(np.int64)
            more = np.array(list(wanted), np.int64).reshape(-1, 2)
            parts, hashes = np.concatenate([owner[asks], owner[:-1][beside], more[:, 0]]), np.concatenate([key[asks], pair, more[:, 1]])
            order = np.lexsort((hashes, parts))
            parts, hashes = parts[order], hashes[order]
            new = np.ones(len(parts), bool)
            new[1:] = (parts[1:] != parts[:-1]) | (hashes[1:] != hashes[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(parts[new].astype(np.int32)), pa.array(hashes[new])], names=["part", "key"])

    return ask


def decoded(pages: DataFrame, chunks: DataFrame, schema: str, decode) -> DataFrame:
    """Pages in groups, each given to ``decode(model, rows)`` with the counts that its words ask for.

    ``pages`` has ``id, content`` and maybe more; ``decode`` yields rows of the schema. The counts
    of all chunks are joined to the groups by the strokes asked for, so no model is sent around
    and none is cut; what a group needs is bounded by its pages.
    """
    spark = chunks.sparkSession
    counts = corpus_counts(chunks)
    total = counts.where("b IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = spark.sparkContext.broadcast(open_strokes(counts))
    groups = max(1, -(-pages.count() // GROUP_PAGES))
    pages = pages.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    asked = pages.select("part", "content").mapInArrow(lambda it: _asks(shared.value)(it), "part int, key bigint").distinct()
    # Pairs seen less often say nothing: a misread word would vouch for itself.
    given = asked.join(counts.where((F.col("b").isNull()) | (F.col("n") >= LEAST_COUNT)), "key").select("part", "a", "b", "n")
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(key: tuple, own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        alone = known["b"].isna()
        words = dict(zip(known["a"][alone], known["n"][alone].astype(int)))
        pairs = {(a, b): int(n) for a, b, n in zip(known["a"][~alone], known["b"][~alone], known["n"][~alone])}
        return pd.DataFrame(list(decode(Model(words, pairs, total), own)), columns=names)

    return pages.groupBy("part").cogroup(given.groupBy("part")).applyInPandas(run, schema)


def _titles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, lines, forms = [], [], []
        for k, text in enumerate(batch.column(3).to_pylist()):
            for line, title, _ in edge_lines(text):
                if title:
                    at.append(k)
                    lines.append(line)
                    forms.append(look(title))
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows), batch.column(2).take(rows), pa.array(lines, pa.int32()), pa.array(forms, pa.string())], names=["id", "file", "page", "line", "form"]
        )


def running_titles(pages: DataFrame) -> DataFrame:
    """``(id, line)`` of edge lines whose title also runs on another page of the file."""
    edges = pages.mapInArrow(_titles, "id string, file bigint, page int, line int, form string").withColumn("form", F.xxhash64("form"))
    runs = edges.groupBy("file", "form").agg(F.min("page").alias("low"), F.max("page").alias("high")).where("low < high")
    return edges.join(runs.select("file", "form"), ["file", "form"], "left_semi").select("id", "line")


_CUT = re.compile(r"([-‐¬\xad])[ \t]*\n[ \t]*([^\W\d_][\w@†|]*)")


def marked_words(text: str) -> list[tuple[int, int, str, tuple[str, str]]]:
    """(end of the first part, end of the second, second part, both in lower case) of the words that a mark cuts at a line end."""
    found = []
    for m in _CUT.finditer(text):
        at = start = m.start()
        while start and (text[start - 1].isalnum() or text[start - 1] in "@†|"):
            start -= 1
        head, tail = text[start:at], m.group(2)
        if tail[0].islower() and any(c.isalpha() for c in head):
            found.append((at, m.end(), tail, (head.lower(), tail.lower())))
    return found


def cut_words(model: Model, text: str) -> list[tuple[int, int, str]]:
    """(end of the first part, end of the second, second part) of the words cut at a line end and marked as cut; a compound broken at its own hyphen is none."""
    return [
        (at, end, tail)
        for at, end, tail, (a, b) in marked_words(text)
        if not (text[at] in "-‐" and model.words.get(f"{a}-{b}", 0) > model.words.get(a + b, 0))
    ]


def joined(text: str, cuts: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for end, after, tail in cuts:
        out += [text[at:end], tail]
        at = after
    return "".join([*out, text[at:]])


def _cased(model_word: str, seen: str) -> str:
    if seen.isupper() and len(seen) > 1 or (not any(c.islower() for c in seen) and sum(c.isalpha() for c in seen) > 1):
        return model_word.upper()
    return model_word[:1].upper() + model_word[1:] if seen[:1].isupper() else model_word


_BLOCK = re.compile(r"(?:[^\n]+\n?)+")


def corrections(model: Model, text: str) -> list[tuple[int, int, str]]:
    """(start, end, word) of the misread words of a text whose cut words are joined."""
    found = []
    for block in _BLOCK.finditer(text):
        piece, origin = block.group(), block.start()
        spans = list(_TOKEN.finditer(piece))
        tokens = [m.group().lower() for m in spans]
        for m, old, new in zip(spans, tokens, correct_line(model, tokens)):
            if old != new and not _CODE.match(piece, m.end()) and not _OF_CODE.search(piece, max(0, m.start() - 2), m.start()):
                found.append((origin + m.start(), origin + m.end(), _cased(new, m.group())))
    return found


def _noise(model: Model, pages: pd.DataFrame) -> Iterator[tuple[str, str]]:
    for id_, text in zip(pages["id"], pages["content"]):
        cuts = cut_words(model, text)
        if cuts:
            yield id_, "hyphenation"
        if any(numbered for _, _, numbered in edge_lines(text)):
            yield id_, "page_number"
        if corrections(model, joined(text, cuts)):
            yield id_, "misread"


def scan_noise(chunks: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """``(id, kind)`` of the noise on scanned pages: hyphenation, misread, header, page_number.

    Rows with null or empty content, broken metadata or no page have none; repeated rows
    give one case. ``config`` says which collections are read by recognition, see ``scanned_pages``.
    """
    pages = scanned_pages(chunks, config)
    kind = dict(chunks.dtypes)["id"]
    local = decoded(pages.select("id", "content"), chunks, f"id {kind}, kind string", _noise)
    headers = running_titles(pages).select("id", F.lit("header").alias("kind"))
    return local.unionByName(headers).distinct()


def repair_text(model: Model, text: str, furniture: set[int]) -> str:
    """Continuous paragraphs of a page: furniture dropped, cut words joined, misread words corrected, lines of a paragraph joined."""
    lines = text.split("\n")
    drop = furniture | {k for k, title, numbered in edge_lines(text) if numbered and not title}
    text = "\n".join(l for k, l in enumerate(lines) if k not in drop)
    text = joined(text, cut_words(model, text))
    out, at = [], 0
    for start, end, word in corrections(model, text):
        out += [text[at:start], word]
        at = end
    text = "".join([*out, text[at:]])
    paragraphs = []
    for block in re.split(r"\n[ \t]*\n", text):
        part: list[str] = []
        for line in block.split("\n"):
            if not line.strip():
                continue
            keep = line.lstrip().startswith(_MARKED) or re.match(r"\s*\d+\.\s", line)
            if part and not keep and not part[-1].lstrip().startswith(("|", "#", "```")):
                part[-1] += " " + line.strip()
            else:
                part.append(line.strip())
        if part:
            paragraphs.append("\n".join(part))
    return "\n\n".join(paragraphs)


def _repair(model: Model, pages: pd.DataFrame) -> Iterator[tuple[str, str]]:
    for id_, text, furniture in zip(pages["id"], pages["content"], pages["furniture"]):
        yield id_, repair_text(model, text, set() if furniture is None else set(furniture))


def repair_pages(chunks: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """``(id, text)``: the repaired text of every row that may come from a scanned page; a clean page only has its lines joined."""
    pages = scanned_pages(chunks, config)
    titles = running_titles(pages).groupBy("id").agg(F.collect_set("line").alias("furniture"))  # at most four lines a page
    kind = dict(chunks.dtypes)["id"]
    return decoded(pages.select("id", "content").join(titles, "id", "left"), chunks, f"id {kind}, text string", _repair)
