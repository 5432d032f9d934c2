"""Searches, lookups, unions and paging over collections of items: mail, calendars, chats, issues, pages."""

from __future__ import annotations

import ast
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.core.runtime import cut


def in_range(ts: Column, start=None, end=None) -> Column:
    """Both bounds are optional and inclusive."""
    out = F.lit(True)
    if start is not None:
        out = out & (ts >= F.lit(start))
    if end is not None:
        out = out & (ts <= F.lit(end))
    return out


def contains_all(**wanted: str | None) -> Column:
    """Each named column contains its text; empty texts ask for nothing."""
    out = F.lit(True)
    for column, text in wanted.items():
        if text:
            out = out & F.col(column).contains(text)
    return out


def either_contains(a: Column, b: Column, text: str) -> Column:
    """Case-insensitive search in one field or the other."""
    t = text.lower()
    return F.lower(a).contains(t) | F.lower(b).contains(t)


def newest(df: DataFrame, time: str, limit: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(time), F.asc(tie)).limit(limit)


def page(df: DataFrame, order: Sequence[str], number: int, size: int) -> DataFrame:
    """A page, from 1, of an ordered collection."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def lookup(df: DataFrame, names: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """The name of an id, or the id itself where there is none. ``names`` is unique by key; Spark broadcasts it where it is small."""
    return df.join(names.select(F.col(key), F.col(name).alias("_name")), key, "left").withColumn(out, F.coalesce("_name", F.col(key).cast("string"))).drop("_name")


def with_replies(messages: DataFrame, replies: DataFrame, most: int = 3) -> DataFrame:
    """Messages with up to ``most`` of their first replies, the message itself excluded."""
    order = Window.partitionBy("parent_id").orderBy("ts", "id")
    kept = replies.where(F.col("id") != F.col("parent_id")).withColumn("reply_no", F.row_number().over(order)).where(F.col("reply_no") <= most)
    kept = kept.select(F.col("parent_id").alias("id"), F.col("id").alias("reply_id"), "reply_no", F.col("text").alias("reply"))
    return messages.join(kept, "id", "left")


def merged_lists(parts: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """Lists of several maps from a key to a list, concatenated in the order of the maps."""
    out = None
    for n, part in enumerate(parts):
        own = part.select(F.col(key), F.lit(n).alias("_part"), F.col(value).alias("_list"))
        out = own if out is None else out.unionByName(own)
    lists = F.transform(F.array_sort(F.collect_list(F.struct("_part", "_list"))), lambda x: x["_list"])
    return out.groupBy(key).agg(F.flatten(lists).alias(value))


def has_scopes(scopes: Column, required: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(s) for s in required]), scopes)) == 0


def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """Rows numbered from 1 in the order of a unique key, without bringing them to one task: places within range partitions plus the counts of those before."""
    ranged = cut(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_c"))  # a row a partition
    before = counts.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def numbered_ids(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """``(external_id, id)`` of the known and the new external ids, new ones numbered on from the largest."""
    fresh = incoming.select("external_id").distinct().join(known, "external_id", "left_anti")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    ordered = numbered(fresh, "external_id", "_n")
    return known.unionByName(ordered.crossJoin(F.broadcast(top)).select("external_id", (F.col("_top") + F.col("_n")).cast("bigint").alias("id")))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of several lists of one form (results of datasets, public and private channels, calendars), repeats kept."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def events_between(calendars: Sequence[DataFrame], start, end, most: int = 100) -> DataFrame:
    """Events of all calendars that overlap a range, at most ``most`` of each calendar, earliest first."""
    hit = union_all(calendars).where((F.col("start") <= F.lit(end)) & (F.col("end") >= F.lit(start)))
    order = Window.partitionBy("calendar").orderBy("start", "id")
    return hit.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def mentions_named(messages: DataFrame, users: DataFrame, text: str = "text") -> DataFrame:
    """``<@ID>`` mentions replaced by ``@name``; an unknown id stays. ``messages`` has a unique ``id``."""
    parts = F.split(F.col(text), "(?=<@[A-Z0-9]+>)|(?<=>)")
    pieces = messages.select("id", F.posexplode(parts).alias("_n", "_p")).withColumn("_u", F.regexp_extract("_p", "^<@([A-Z0-9]+)>$", 1))
    named = pieces.join(users.select(F.col("user_id").alias("_u"), F.col("name").alias("_name")), "_u", "left")
    said = named.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.coalesce(F.concat(F.lit("@"), "_name"), "_p").alias("_s")))), lambda x: x["_s"]), "").alias(text))
    return messages.drop(text).join(said, "id", "left")


def qualifiers(text: str, **scopes: str) -> list[tuple[str, str]]:
    """Search terms of an issue query: ``repo:``, ``user:`` and the like, then words."""
    return [(k, v) for k, v in scopes.items() if v] + [("text", w) for w in text.split()]


def issue_search(issues: DataFrame, text: str, page_no: int = 1, per_page: int = 30, **scopes: str) -> DataFrame:
    for kind, value in qualifiers(text, **scopes):
        issues = issues.where(F.lower("title").contains(value.lower()) if kind == "text" else F.col(kind) == value)
    return page(issues, ["id"], page_no, per_page)


def ancestor_paths(df: DataFrame) -> DataFrame:
    """``(id, path, depth)`` of a tree ``(id, parent_id, title)``: titles from the root, by doubling the reach of every row's ancestor link.

    Rounds go on until every row has reached its root, however deep the tree is; a row whose
    ancestors run in a circle is an error. An unknown parent counts as none.
    """
    at = cut(df.select("id", F.col("parent_id").alias("_up"), F.array("title").alias("_titles")))
    rounds, most = 0, math.log2(max(2, at.count())) + 2
    while not at.where("_up IS NOT NULL").isEmpty():
        if rounds > most:
            raise ValueError("the parents of some rows run in a circle")
        above = at.select(F.col("id").alias("_up"), F.col("_up").alias("_next"), F.col("_titles").alias("_more"))
        at = cut(at.join(above, "_up", "left").select("id", F.col("_next").alias("_up"), F.concat(F.coalesce("_more", F.expr("array()").cast("array<string>")), "_titles").alias("_titles")))
        rounds += 1
    return at.select("id", F.array_join("_titles", "/").alias("path"), (F.size("_titles") - 1).alias("depth"))


# --- spreadsheet queries --------------------------------------------------------------

_COMPARE = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}
_ARITHMETIC = {ast.Add: "__add__", ast.Sub: "__sub__", ast.Mult: "__mul__", ast.Div: "__truediv__", ast.Mod: "__mod__"}


def frame_query(expression: str, columns: Sequence[str], variables: dict | None = None) -> Column:
    """A dataframe-style condition as a column: comparisons (chained too), ``and``/``or``/``not`` or ``& | ~``, ``in``, arithmetic, back-quoted names, ``@variables``.

    Comparisons with a missing value are false, as in a dataframe. Anything else is an error.
    """
    quoted: dict[str, str] = {}
    text, rest = "", expression
    while "`" in rest:
        before, name, rest = rest.split("`", 2)
        alias = f"_quoted_{len(quoted)}"
        quoted[alias] = name
        text += before + alias
    text = (text + rest).replace("@", "_var_")
    known = set(columns)

    def value(node: ast.AST):
        if isinstance(node, ast.Constant):
            return F.lit(node.value)
        if isinstance(node, (ast.List, ast.Tuple)):
            return [ast.literal_eval(e) for e in node.elts]
        if isinstance(node, ast.Name):
            if node.id.startswith("_var_"):
                found = (variables or {})[node.id[5:]]
                return list(found) if isinstance(found, (list, tuple, set)) else F.lit(found)
            name = quoted.get(node.id, node.id)
            if name not in known:
                raise ValueError(f"unknown column: {name}")
            return F.col(f"`{name}`")
        if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
            return getattr(value(node.left), _ARITHMETIC[type(node.op)])(value(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -value(node.operand)
        return condition(node)

    def condition(node: ast.AST) -> Column:
        if isinstance(node, ast.BoolOp):
            parts = [condition(v) for v in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(node.op, ast.And) else out | p
            return out
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.BitAnd, ast.BitOr)):
            a, b = condition(node.left), condition(node.right)
            return a & b if isinstance(node.op, ast.BitAnd) else a | b
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.Not, ast.Invert)):
            return ~condition(node.operand)
        if isinstance(node, ast.Compare):
            out, left = None, node.left
            for op, right in zip(node.ops, node.comparators):
                if isinstance(op, (ast.In, ast.NotIn)):
                    part = value(left).isin(value(right))
                    part = F.coalesce(part, F.lit(False))
                    part = ~part if isinstance(op, ast.NotIn) else part
                elif type(op) in _COMPARE:
                    part = F.coalesce(getattr(value(left), _COMPARE[type(op)])(value(right)), F.lit(isinstance(op, ast.NotEq)))
                else:
                    raise ValueError("unsupported comparison")
                out = part if out is None else out & part
                left = right
            return out
        if isinstance(node, (ast.Name, ast.Constant)):
            return value(node)
        raise ValueError(f"unsupported expression: {ast.dump(node)[:60]}")

    return condition(ast.parse(text.strip(), mode="eval").body)


def sheet_query(df: DataFrame, expression: str, columns: Sequence[str] | None = None, variables: dict | None = None) -> DataFrame:
    out = df.where(frame_query(expression, df.columns, variables)) if expression else df
    return out.select(*[F.col(f"`{c}`") for c in columns]) if columns else out


def blank_row_tables(rows: DataFrame, number: str, blank: Column, group: Sequence[str] = (), bucket: int = 100_000) -> DataFrame:
    """Rows that are not blank, with the number from 1 of the table they belong to; any run of blank rows separates tables.

    Without a ``group`` the rows are one sheet of any length: its rows are numbered over
    range partitions, and buckets of them carry on the count of the tables before.
    """
    if group:
        order = Window.partitionBy(*group).orderBy(number)
        marked = rows.withColumn("_blank", blank).withColumn("_gaps", F.sum(F.when(F.col("_blank"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.where(~F.col("_blank")).withColumn("table_no", F.dense_rank().over(Window.partitionBy(*group).orderBy("_gaps"))).drop("_blank", "_gaps")
    placed = numbered(rows.withColumn("_blank", blank), number, "_n")
    before = placed.select((F.col("_n") + 1).alias("_n"), (~F.col("_blank")).alias("_goes_on"))
    marked = placed.where(~F.col("_blank")).join(before, "_n", "left").withColumn("_starts", F.when(F.coalesce("_goes_on", F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("_b", F.floor(F.col("_n") / bucket))
    sums = marked.groupBy("_b").agg(F.sum("_starts").alias("_s"))
    earlier = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_earlier"))  # a row a bucket
    inside = F.sum("_starts").over(Window.partitionBy("_b").orderBy("_n"))
    out = marked.join(earlier, "_b").withColumn("table_no", (F.col("_earlier") + inside).cast("int"))
    return out.drop("_blank", "_n", "_b", "_goes_on", "_starts", "_earlier")
