"""Reading side of service connectors: chats, issues, mail, calendars, notes, documents, tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.operators.lookup import page


def named_like(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Channels or users of which any name field contains the text; case counts."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).contains(text), F.lit(False))
    return df.where(hit)


def history(messages: DataFrame, channel: str, oldest: float | None = None, latest: float | None = None, limit: int = 100) -> DataFrame:
    """The newest messages of a channel within epoch bounds; ``ts`` is in seconds."""
    out = messages.where(F.col("channel") == channel)
    if oldest is not None:
        out = out.where(F.col("ts") >= oldest)
    if latest is not None:
        out = out.where(F.col("ts") <= latest)
    return out.orderBy(F.desc("ts"), "id").limit(limit)


def thread(messages: DataFrame, thread_id: str, limit: int = 100) -> DataFrame:
    return messages.where(F.col("thread_id") == thread_id).orderBy("ts", "id").limit(limit)


def reply_label(count: Column) -> Column:
    return F.concat(count.cast("string"), F.when(count == 1, " reply").otherwise(" replies"))


def issue_fields(issues: DataFrame) -> DataFrame:
    """Eight fields of each issue; no assignee is ``Unassigned``."""
    return issues.select("id", "key", "summary", "status", F.coalesce("assignee", F.lit("Unassigned")).alias("assignee"), "reporter", "created", "updated")


def comments(df: DataFrame, parent: str) -> DataFrame:
    return df.where(F.col("parent_id") == parent).select("id", F.coalesce("author", F.lit("Unknown")).alias("author"), "body", "created").orderBy("created", "id")


def users(df: DataFrame, include_apps: bool = False) -> DataFrame:
    return df if include_apps else df.where(~F.col("account_type").eqNullSafe(F.lit("app")))


def repository(url: Column) -> tuple[Column, Column]:
    """(owner, name) of an issue's or repository's URL, by position."""
    parts = F.split(url, "/")
    return F.try_element_at(parts, F.lit(4)), F.try_element_at(parts, F.lit(5))


def assigned_open(issues: DataFrame, user: str) -> DataFrame:
    return issues.where((F.col("assignee") == user) & (F.col("state") == "open"))


def awaiting_review(pulls: DataFrame, user: str) -> DataFrame:
    return pulls.where(F.array_contains("reviewers", user) & (F.col("state") == "open"))


def tags(text: Column) -> Column:
    """Tags of a comma-separated text, number signs stripped."""
    return F.filter(F.transform(F.split(text, ","), lambda t: F.ltrim(F.trim(t), F.lit("#"))), lambda t: t != "")


def posts(df: DataFrame, since: str | None = None, until: str | None = None, tagged: Sequence[str] = (), limit: int = 25) -> DataFrame:
    if since:
        df = df.where(F.col("created") >= F.lit(since).cast("timestamp"))
    if until:
        df = df.where(F.col("created") < F.lit(until).cast("timestamp"))
    for t in tagged:
        df = df.where(F.array_contains("tags", t.lstrip("#")))
    return df.orderBy(F.desc("created"), "id").limit(limit)


def types_with_statuses(types: DataFrame, statuses: DataFrame) -> DataFrame:
    """Issue types with the list of their statuses, an empty one where there are none."""
    lists = statuses.groupBy("type_id").agg(F.sort_array(F.collect_set("status")).alias("_s"))
    empty = F.array().cast("array<string>")
    return types.join(lists, types["id"] == lists["type_id"], "left").select(types["*"], F.coalesce("_s", empty).alias("statuses"))


def priorities(schemes: DataFrame, scheme: str | None = None) -> DataFrame:
    """Priorities of one scheme, or of all: one row each of ``scheme, priority``."""
    rows = schemes.select("scheme", F.explode("priorities").alias("priority"))
    return rows if scheme is None else rows.where(F.col("scheme") == scheme)


def mail_by(messages: DataFrame, id: str | None = None, subject: str | None = None) -> DataFrame:
    """A message by its id, or the first hit of an exact subject, with whether it has attachments (a part with a name and an id)."""
    out = messages.where(F.col("id") == id) if id else messages.where(F.col("subject") == subject)
    out = out.withColumn("has_attachment", F.coalesce(F.exists("parts", lambda p: (p["filename"] != "") & p["attachment_id"].isNotNull()), F.lit(False)))
    return out.orderBy(F.desc("sent_at"), "id").limit(1)


def first_text_part(parts: Column) -> Column:
    """Body of the first plain-text part of a flattened multipart message, base64url decoded."""
    body = F.element_at(F.filter(parts, lambda p: p["mime_type"] == "text/plain"), 1)["data"]
    return F.decode(F.unbase64(F.translate(body, "-_", "+/")), "UTF-8")


def event_detail(events: DataFrame, groups: DataFrame) -> DataFrame:
    """Events with their group's name (the id where there is none) and whether they recur."""
    named = events.join(groups.select(F.col("group_id"), F.col("name").alias("_n")), "group_id", "left")
    return named.withColumn("group_name", F.coalesce("_n", "group_id")).withColumn("recurring", F.col("series_id").isNotNull()).drop("_n")


def file_attachments(attachments: DataFrame) -> DataFrame:
    return attachments.where(F.col("type") == "file")


def search_titles(results: DataFrame) -> DataFrame:
    """Title of a search result: its title, else its name, else the top-level title."""
    return results.withColumn("shown", F.coalesce("title", "name", "top_title"))


def task_parameters(tasks: DataFrame) -> DataFrame:
    """Tasks with their parameters sorted by key."""
    return tasks.withColumn("params", F.sort_array(F.map_entries("params")))


def rendered_blocks(blocks: DataFrame, document: str = "page_id") -> DataFrame:
    """``(page_id, text)`` of a page's blocks ``(position, depth, type, text, checked, url)``, each rendered by its type and indented by its depth."""
    text = F.coalesce("text", F.lit(""))
    body = (
        F.when(F.col("type") == "heading_1", F.concat(F.lit("# "), text))
        .when(F.col("type") == "heading_2", F.concat(F.lit("## "), text))
        .when(F.col("type") == "heading_3", F.concat(F.lit("### "), text))
        .when(F.col("type").isin("bulleted_list_item", "toggle"), F.concat(F.lit("- "), text))
        .when(F.col("type") == "numbered_list_item", F.concat(F.lit("1. "), text))
        .when(F.col("type") == "to_do", F.concat(F.when(F.col("checked"), "- [x] ").otherwise("- [ ] "), text))
        .when(F.col("type").isin("quote", "callout"), F.concat(F.lit("> "), text))
        .when(F.col("type") == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(F.col("type") == "divider", F.lit("---"))
        .when(F.col("type") == "equation", F.concat(F.lit("$"), text, F.lit("$")))
        .when(F.col("type").isin("image", "file", "pdf", "video", "bookmark", "embed"), F.concat(F.lit("["), text, F.lit("]("), F.coalesce("url", F.lit("")), F.lit(")")))
        .otherwise(text)
    )
    line = F.concat(F.repeat(F.lit("  "), F.coalesce("depth", F.lit(0))), body)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("_l")))), lambda x: x["_l"]), "\n")
    return blocks.groupBy(document).agg(joined.alias("text"))


def document_markdown(elements: DataFrame) -> DataFrame:
    """``(doc_id, markdown)`` of paragraphs and table rows ``(position, kind, level, text, cells)``."""
    order = Window.partitionBy("doc_id").orderBy("position")
    starts = (F.col("kind") == "row") & ~F.lag("kind").over(order).eqNullSafe(F.lit("row"))
    row = F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))
    ruled = F.concat(row, F.lit("\n|"), F.repeat(F.lit(" --- |"), F.size("cells")))
    line = F.when(F.col("kind") == "row", F.when(F.col("_starts"), ruled).otherwise(row)).when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text")).otherwise(F.col("text"))
    lines = elements.withColumn("_starts", starts).select("doc_id", "position", line.alias("_l"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "_l"))), lambda x: x["_l"]), "\n").alias("markdown"))


RECURRENCES = ("daily", "weekly", "absoluteMonthly", "relativeMonthly", "absoluteYearly", "relativeYearly")
_PLACES = ("first", "second", "third", "fourth", "last")
_WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _recurrence_columns(df: DataFrame) -> DataFrame:
    """Recurrences with all their columns; those that a frame lacks are null."""
    kinds = {"days_of_week": "array<string>", "day_of_month": "int", "index": "string", "month": "int", "first_day_of_week": "string", "end": "date", "occurrences": "int"}
    for name, kind in kinds.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.withColumn("days_of_week", F.transform("days_of_week", F.lower)).withColumn("interval", F.greatest(F.coalesce("interval", F.lit(1)), F.lit(1)).cast("int"))


def counted(df: DataFrame, by: str | Sequence[str], distinct: str | None = None) -> DataFrame:
    """Results of each channel or source, and how many different values they have."""
    extra = [F.count_distinct(distinct).alias(f"{distinct}s")] if distinct else []
    return df.groupBy(*([by] if isinstance(by, str) else by)).agg(F.count("*").alias("n"), *extra)


def recurrence_error(df: DataFrame) -> DataFrame:
    """``(id, error)``: what a recurrence lacks, null where it is complete: a known type, its days, day or place in the month, its month, a start, and no more than one kind of end."""
    rows = _recurrence_columns(df)
    kind = F.col("type")
    none = F.coalesce(F.size("days_of_week"), F.lit(0)) < 1
    unknown = F.exists(F.coalesce("days_of_week", F.array().cast("array<string>")), lambda d: ~d.isin(*_WEEKDAYS))
    error = (
        F.when(~F.coalesce(kind.isin(*RECURRENCES), F.lit(False)), "unknown type")
        .when(F.col("start").isNull(), "no start")
        .when(F.col("end").isNotNull() & F.col("occurrences").isNotNull(), "an end and a number")
        .when(F.col("end") < F.col("start"), "end before start")
        .when(kind.isin("weekly", "relativeMonthly", "relativeYearly") & none, "no days of the week")
        .when(unknown, "unknown day of the week")
        .when(kind.startswith("absolute") & ~F.coalesce(F.col("day_of_month").between(1, 31), F.lit(False)), "no day of the month")
        .when(kind.startswith("relative") & ~F.coalesce(F.lower("index").isin(*_PLACES), F.lit(False)), "no place in the month")
        .when(kind.endswith("Yearly") & ~F.coalesce(F.col("month").between(1, 12), F.lit(False)), "no month")
    )
    return rows.select("id", error.alias("error"))


def recurrence_dates(df: DataFrame, most: int = 366) -> DataFrame:
    """``(id, day)`` of recurrences ``(id, type, interval, start)`` with, as the type asks, ``days_of_week, day_of_month, index, month, first_day_of_week``, and ``end`` or ``occurrences``; an extension.

    Without an end the first ``most`` days come. A day of the month that a month lacks is its
    last; of several days of the week, ``index`` picks one among all of them in the month.
    Weeks begin on Monday where nothing else is told. Incomplete recurrences give none.
    """
    rows = _recurrence_columns(df).join(recurrence_error(df).where("error IS NULL").select("id"), "id", "left_semi")
    kind, wanted = F.col("type"), F.coalesce("occurrences", F.lit(most))
    monthly, yearly, weekly = kind.endswith("Monthly"), kind.endswith("Yearly"), kind == "weekly"
    first_day = F.array_position(F.array(*map(F.lit, _WEEKDAYS)), F.coalesce(F.lower("first_day_of_week"), F.lit("monday")))
    week = F.date_sub("start", F.pmod(F.weekday("start") + 1 - first_day, F.lit(7)).cast("int"))
    year = F.add_months(F.trunc("start", "year"), F.coalesce("month", F.lit(1)) - 1)
    step = F.col("_k") * F.col("interval")
    begin = F.when(monthly, F.add_months(F.trunc("start", "month"), step)).when(yearly, F.add_months(year, 12 * step)).when(weekly, F.date_add(week, 7 * step)).otherwise(F.date_add("start", step))
    periods = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), wanted + 1))).withColumn("_begin", begin)
    periods = periods.where(F.coalesce(F.col("_begin") <= F.col("end"), F.lit(True)))
    named = lambda d: F.element_at(F.array(*map(F.lit, _WEEKDAYS)), F.weekday(d) + 1)
    of_week = F.filter(F.sequence("_begin", F.date_add("_begin", 6)), lambda d: F.array_contains("days_of_week", named(d)))
    of_month = F.filter(F.sequence("_begin", F.last_day("_begin")), lambda d: F.array_contains("days_of_week", named(d)))
    place = F.array_position(F.array(*map(F.lit, _PLACES)), F.lower("index")).cast("int")
    picked = F.array(F.try_element_at(of_month, F.when(place == 5, F.lit(-1)).otherwise(place)))
    fixed = F.array(F.least(F.date_add("_begin", F.col("day_of_month") - 1), F.last_day("_begin")))
    days = F.when(weekly, of_week).when(kind.startswith("relative"), picked).when(kind.startswith("absolute"), fixed).otherwise(F.array("_begin"))
    kept = periods.select("id", "start", "end", wanted.alias("_wanted"), F.explode(days).alias("day")).where((F.col("day") >= F.col("start")) & F.coalesce(F.col("day") <= F.col("end"), F.lit(True)))
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("day"))).where(F.col("_n") <= F.col("_wanted")).select("id", "day")


def listing(df: DataFrame, columns: Sequence[str], limit: int = 100, order: str = "name") -> DataFrame:
    """A listing's columns, at most ``limit`` rows in order."""
    return page(df, [order], 1, limit).select(*columns)
