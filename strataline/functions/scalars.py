"""Scalar functions as Spark column expressions, all evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- scores and vectors ---------------------------------------------------------------


def minmax(score: Column, low: Column, high: Column) -> Column:
    """Score scaled to [0, 1] over a list's range; an all-zero list gives 0, a list of equal scores 1."""
    return F.when(high == 0, F.lit(0.0)).when(high == low, F.lit(1.0)).otherwise((score - low) / (high - low))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector or vectors of unequal length."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length)


def normalised(v: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


def blend(sparse: Column, dense: Column, weight: float) -> Column:
    return F.lit(weight) * sparse + F.lit(1.0 - weight) * dense


# --- strings --------------------------------------------------------------------------


def space_tokens(text: Column) -> Column:
    """Split at every single space; empty tokens are kept."""
    return F.split(text, " ", -1)


def without_stopwords(tokens: Column, stopwords: Iterable[str]) -> Column:
    words = sorted(set(stopwords))
    return F.filter(tokens, lambda t: ~F.lower(t).isin(words)) if words else tokens


def drop_blank_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: F.trim(line) != ""), "\n")


def truncated(text: Column, limit: int = 50_000) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def quoted_phrases(text: Column) -> Column:
    """Trimmed, non-empty phrases in double quotes."""
    found = F.regexp_extract_all(text, F.lit('"([^"]*)"'), 1)
    return F.filter(F.transform(found, lambda p: F.trim(p)), lambda p: p != "")


def media_type(mime: Column) -> Column:
    """A MIME type without its parameters."""
    return F.trim(F.split(mime, ";")[0])


def plural(count: Column, one: str, many: str) -> Column:
    return F.when(count == 1, one).otherwise(many)


def share_token(url: Column) -> Column:
    """Sharing token of a link: unpadded URL-safe base64 behind ``u!``."""
    return F.concat(F.lit("u!"), F.translate(F.rtrim(F.base64(F.encode(url, "UTF-8")), F.lit("=")), "/+", "_-"))


def from_base64url(text: Column) -> Column:
    return F.decode(F.unbase64(F.translate(text, "-_", "+/")), "UTF-8")


def usage_label(model: Column) -> Column:
    """What a model is for, by the prefix of its id."""
    rules = [(("text-embedding", "embedding"), "text-embedding"), (("dall-e", "gpt-image"), "image-generation"), (("tts", "whisper"), "audio")]
    label = None
    for prefixes, name in rules:
        for p in prefixes:
            label = F.when(model.startswith(p), name) if label is None else label.when(model.startswith(p), name)
    return label.otherwise("llm")


def csv_field(value: Column) -> Column:
    """A cell as a field of a CSV line."""
    text = value.cast("string")
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(text, F.lit("")))


# --- links ----------------------------------------------------------------------------


def _www(label: Column) -> Column:
    return (label == "www") | ((F.char_length(label) == 4) & label.startswith("www"))


def same_site(link_host: Column, base_host: Column) -> Column:
    """Equal hosts, or hosts that differ by a leading www label on a two-label domain."""
    base, link = F.split(base_host, "\\."), F.split(link_host, "\\.")
    added = (F.size(base) == 2) & (F.size(link) == 3) & _www(link[0]) & (F.concat_ws(".", F.slice(link, 2, 2)) == base_host)
    dropped = (F.size(base) == 3) & _www(base[0]) & (F.concat_ws(".", F.slice(base, 2, 2)) == link_host)
    return (link_host == base_host) | added | dropped


def resolved_path(base_path: Column, link_path: Column) -> Column:
    """Path of a link: absolute as it is, relative below the folder of the base."""
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    return F.when(link_path.startswith("/"), link_path).otherwise(F.concat(folder, link_path))


def in_scope(link_host: Column, link_path: Column, base_host: Column, base_path: Column) -> Column:
    """Whether a crawl follows a link: same site, and a path below the base path. A link without a host has the base's."""
    host_ok = (F.coalesce(link_host, F.lit("")) == "") | same_site(link_host, base_host)
    return host_ok & resolved_path(base_path, link_path).startswith(base_path)


def url_file(url: Column) -> Column:
    """File path under which a crawled page is kept: ``host/dir/name.html``, ``index.html`` for a root, the query escaped into the name."""
    host = F.regexp_extract(url, "^[a-zA-Z]+://([^/:?#]+)", 1)
    path = F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    full = F.concat(path, F.when(query != "", F.concat(F.lit("?"), F.url_encode(query))).otherwise(F.lit("")))
    trimmed = F.regexp_replace(full, "^/+|/+$", "")
    return F.when(trimmed == "", F.concat(host, F.lit("/index.html"))).otherwise(F.concat(host, F.lit("/"), F.regexp_replace(trimmed, "/{2,}", "/"), F.lit(".html")))


def video_id(url: Column) -> Column:
    """Id of a video from its watch, live or short link; null for another link."""
    host = F.replace(F.regexp_extract(url, "^[a-z]+://([^/]+)", 1), F.lit("www."), F.lit(""))
    path = F.regexp_extract(url, "^[a-z]+://[^/]+([^?#]*)", 1)
    watch = F.regexp_extract(url, "[?&]v=([^&#]+)", 1)
    live = F.regexp_extract(path, "^/live/(?:[^/]+/)*([^/]+)/?$", 1)
    short = F.regexp_extract(path, "^/(.+)$", 1)
    found = F.when((host == "youtube.com") & path.contains("/watch"), watch).when((host == "youtube.com") & path.contains("/live"), live).when(host == "youtu.be", short)
    return F.when(found != "", found)


def drive_file_id(ref: Column) -> Column:
    """File id from an id or a link that holds one (33 characters or more); null otherwise.

    A link is taken apart as a URL: its host must be a file or document host, and the id is
    the path segment after a ``d``, or the ``id`` parameter.
    """
    url = F.when(ref.rlike("^[a-z]+://"), ref)
    host = F.try_parse_url(url, F.lit("HOST"))
    steps = F.split(F.try_parse_url(url, F.lit("PATH")), "/")
    after_d = F.try_element_at(steps, (F.array_position(steps, "d") + 1).cast("int"))
    found = F.coalesce(F.when(F.array_contains(steps, "d"), after_d), F.try_parse_url(url, F.lit("QUERY"), F.lit("id")))
    given = F.when(url.isNull(), ref).when(host.isin("drive.google.com", "docs.google.com"), found)
    return F.when((F.char_length(given) >= 33) & (F.regexp_replace(given, "[-_0-9A-Za-z]", "") == ""), given)


def path_dataset(path: Column) -> Column:
    """Dataset id of an absolute folder path: its SHA-1."""
    return F.sha1(path)


def utc_now() -> Column:
    """The current time in UTC, ISO 8601; the same in all rows of a query."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# --- sheets and dates -----------------------------------------------------------------


def column_number(letters: Column) -> Column:
    """Number of a sheet column from its letters: A is 1, Z 26, AA 27."""
    chars = F.filter(F.split(F.upper(letters), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda n, c: n * 26 + F.ascii(c) - 64)


def column_letters(number: Column) -> Column:
    """Letters of a sheet column from its number, by repeated division in base 26 without a zero; any positive number."""
    start = F.struct(number.cast("bigint").alias("rest"), F.lit("").alias("out"))

    def step(state: Column, _: Column) -> Column:
        more = state["rest"] > 0
        letter = F.char(F.lit(65) + F.pmod(state["rest"] - 1, F.lit(26)))
        return F.struct(
            F.when(more, F.floor((state["rest"] - 1) / 26)).otherwise(F.lit(0)).cast("bigint").alias("rest"),
            F.when(more, F.concat(letter, state["out"])).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda s: s["out"])


def serial_date(serial: Column) -> Column:
    """Date of a sheet serial number, two days before the plain count from 1900-01-01, also for serials below 60."""
    return F.date_add(F.lit("1900-01-01").cast("date"), serial.cast("int") - 2)


def epoch_ms_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")


def epoch_seconds(ts: Column) -> Column:
    """Time of a message stamp such as ``1700000000.123``."""
    return F.timestamp_micros(F.round(ts.cast("decimal(20,6)") * 1_000_000).cast("bigint"))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# --- records --------------------------------------------------------------------------

SECRET_FIELDS = frozenset({"apikey", "api_key", "token", "password", "secret", "credentials", "auth", "clientsecret", "client_secret", "accesstoken", "access_token"})
REDACTED = "REDACTED"


def redact_secrets(df: DataFrame, fields: Iterable[str] = SECRET_FIELDS) -> DataFrame:
    """Every string field of a secret's name replaced, at any depth of structs and arrays of structs; names match without regard to case. Nulls stay null."""
    wanted = {f.lower() for f in fields}

    def walk(col: Column, kind: T.DataType, name: str) -> Column:
        if isinstance(kind, T.StructType):
            fields_ = [walk(col[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]
            return F.when(col.isNotNull(), F.struct(*fields_))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(col, lambda x: walk(x, kind.elementType, ""))
        if isinstance(kind, T.StringType) and name.lower() in wanted:
            return F.when(col.isNotNull(), F.lit(REDACTED))
        return col

    return df.select(*[walk(df[f"`{f.name}`"], f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def json_texts(value: Column, *names: str) -> Column:
    """Fields of a JSON object as texts, in one struct; all null where the text is no object."""
    return F.from_json(value, ", ".join(f"`{n}` string" for n in names))


# Metadata values that stand for no value; fixed by the data model.
EMPTY_VALUES = ("", "-", "null", "nil")


def clean_metadata(metadata: Column) -> Column:
    """A metadata map without entries whose value is null or stands for no value."""
    return F.map_filter(metadata, lambda k, v: v.isNotNull() & ~v.isin(*EMPTY_VALUES))


def updated_metadata(old: Column, new: Column) -> Column:
    """Key-wise overwrite, other keys kept, then cleaned; a null map is an empty one."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return clean_metadata(F.map_concat(kept, new))


def property_text(kind: Column, value: Column) -> Column:
    """A typed page property, given as JSON, as text."""
    get = lambda path: F.get_json_object(value, path)
    listed = lambda field, glue: F.array_join(F.transform(F.from_json(value, f"array<struct<{field}:string>>"), lambda x: x[field]), glue)
    names, plain = listed("name", ", "), listed("plain_text", "")
    start, end = get("$.start"), get("$.end")
    return (
        F.when(kind == "checkbox", get("$"))
        .when(kind == "date", F.when(end.isNotNull(), F.concat(start, F.lit(" - "), end)).otherwise(start))
        .when(kind.isin("multi_select", "people", "files"), names)
        .when(kind.isin("rich_text", "title"), plain)
        .when(kind.isin("select", "status"), get("$.name"))
        .when(kind == "unique_id", F.concat_ws("-", get("$.prefix"), get("$.number")))
        .when(kind == "formula", F.coalesce(get("$.string"), get("$.number"), get("$.boolean"), get("$.date.start")))
        .when(kind == "relation", listed("id", ", "))
        .otherwise(get("$"))
    )
