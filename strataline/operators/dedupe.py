"""Duplicates of files before ingestion, and snapshot comparison of sources."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("dataset", "absolute_path")


def by_file_metadata(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming files without an existing one of equal path, size and time in the dataset; nulls are equal to nulls."""
    keys = ["dataset", "absolute_path", "size", "modified_at"]
    there = existing.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = eq if same is None else same & eq
    return incoming.join(there, same, "left_anti")


def latest(df: DataFrame, keys: Sequence[str] = KEY, time: str = "modified_at", tie: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key. Rows are reduced map-side, so a hot key sends one row per task."""
    order = F.struct(F.col(time), *[F.col(t) for t in tie])
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(row, order).alias("_row")).select("_row.*")


def upsert(incoming: DataFrame, existing: DataFrame, keys: Sequence[str] = KEY, time: str = "modified_at", tie: Sequence[str] = ()) -> DataFrame:
    """Incoming files to ingest: the newest of each path, where no existing one is as new; an equal or older time is a duplicate, and no time is older than any."""
    new = latest(incoming, keys, time, tie)
    there = existing.groupBy(*keys).agg(F.max(time).alias("_there"), F.lit(True).alias("_known"))
    newer = (F.col(time) > F.col("_there")) | (F.col("_there").isNull() & F.col(time).isNotNull())
    return new.join(there, list(keys), "left").where(F.col("_known").isNull() | newer).select(*incoming.columns)


def by_checksum(df: DataFrame, content: str = "content", keep: str = "id") -> DataFrame:
    """The row of least id of each distinct content, with its SHA-256."""
    hashed = df.withColumn("checksum", F.sha2(F.col(content), 256))
    row = F.struct(*[F.col(c) for c in hashed.columns])
    return hashed.groupBy("checksum").agg(F.min_by(row, keep).alias("_row")).select("_row.*")


def none(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    return incoming


STRATEGIES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "file_metadata": by_file_metadata, "upsert": upsert, "none": none, "dummy": none, "ignore": none, "": upsert,
}


def strategy(name: str | None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A strategy by name; no name is upsert, an unknown one an error."""
    try:
        return STRATEGIES[name or ""]
    except KeyError:
        raise ValueError(f"unknown duplicate function: {name}") from None


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], compare: str) -> DataFrame:
    """``(keys, change)`` of what differs between two snapshots: insert, update or delete."""
    old = before.select(*keys, F.col(compare).alias("_old"), F.lit(True).alias("_in_old"))
    new = after.select(*keys, F.col(compare).alias("_new"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "insert").when(F.col("_in_new").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    return old.join(new, list(keys), "full_outer").select(*keys, change.alias("change")).where(F.col("change").isNotNull())


def content_changes(state: DataFrame, fetched: DataFrame, key: str = "url") -> DataFrame:
    """Fetched pages to write: unknown ones, and those whose tag (or time, where there is none) and checksum both differ from the state's."""
    known = state.select(key, F.coalesce("etag", "last_modified").alias("_tag"), F.col("checksum").alias("_sum"))
    hashed = fetched.withColumn("checksum", F.sha2("content", 256))
    tag = F.coalesce("etag", "last_modified")
    return hashed.join(known, key, "left").where((F.col("_tag").isNull() | ~F.col("_tag").eqNullSafe(tag)) & ~F.col("_sum").eqNullSafe(F.col("checksum"))).drop("_tag", "_sum")


def merged_state(state: DataFrame, changes: DataFrame, snapshot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state after a sync: deleted and changed keys dropped, the snapshot's rows of inserted and changed keys added."""
    gone = changes.where("change <> 'insert'").select(*keys)
    come = changes.where("change <> 'delete'").select(*keys)
    return state.join(gone, list(keys), "left_anti").unionByName(snapshot.join(come, list(keys), "left_semi"))


def prune(files: DataFrame, keep: DataFrame, prefix: str, path: str = "absolute_path") -> DataFrame:
    """Files below a prefix that are not in the keep list ``(path)``, a trailing slash meaning a folder."""
    return files.where(F.col(path).startswith(prefix)).join(keep.select(F.col(path).alias("_keep")).distinct(), F.col(path) == F.col("_keep"), "left_anti")


def outcome_counts(incoming: DataFrame, existing: DataFrame, path: str = "absolute_path") -> DataFrame:
    """``(outcome, n)``: how many attempts come to new paths (ingested) and to known ones (skipped)."""
    known = existing.select(F.col(path).alias("_known")).distinct()
    rows = incoming.join(known, F.col(path) == F.col("_known"), "left")
    return rows.groupBy(F.when(F.col("_known").isNull(), "ingested").otherwise("skipped").alias("outcome")).agg(F.count("*").alias("n"))


def documents_per_file(documents: DataFrame) -> DataFrame:
    """``(dataset, file_id, n)``; documents without a file count for none."""
    return documents.where(F.col("file_id").isNotNull()).groupBy("dataset", "file_id").agg(F.count("*").alias("n"))


def contents_of_datasets(datasets: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(dataset, files, chunks)``: different file names and chunks of every dataset, also of empty ones. Both are counted before they are joined."""
    named = files.groupBy("dataset").agg(F.count_distinct("name").alias("files"))
    held = chunks.groupBy("dataset").agg(F.count("*").alias("chunks"))
    return datasets.select("dataset").join(named, "dataset", "left").join(held, "dataset", "left").na.fill(0, ["files", "chunks"])


def orphans(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Files without documents, by dataset and file id."""
    return files.join(documents.select(F.col("dataset"), F.col("file_id").alias("id")).distinct(), ["dataset", "id"], "left_anti")


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
