"""Datasets, files, documents and chunks as Parquet segments under one root.

A table is a manifest of segments. Adding rows writes one segment and a new manifest;
removing or changing rows rewrites only the segments that hold the datasets concerned.
Each manifest is a file with a number of its own, written last and as a whole: a reader
never sees half a change, a failed job leaves the old state, and of two writers that come
to the same number one fails to write it, reads the other's and tries again. Chunks are
partitioned by dataset within a segment, so a search reads the folders of its datasets only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.core.schemas import ALL
from strataline.functions.scalars import clean_metadata, updated_metadata


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- storage ----------------------------------------------------------------------

    def _fs(self, path: str) -> tuple[JavaObject, JavaObject]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _version(self, name: str) -> int:
        """Number of the newest manifest; 0 without any."""
        fs, folder = self._fs(f"{self.root}/{name}")
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n[9:]) for n in names if n.startswith("MANIFEST-") and n[9:].isdigit()), default=0)

    def _manifest(self, name: str, version: int | None = None) -> list[dict]:
        """Segments of a table: their folders, and the datasets that each holds (null where any may be)."""
        version = self._version(name) if version is None else version
        if not version:
            return []
        fs, p = self._fs(f"{self.root}/{name}/MANIFEST-{version:012}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, name: str, version: int, manifest: list[dict]) -> bool:
        """The manifest under its number, by a rename that replaces nothing; False where another writer has taken the number."""
        fs, new = self._fs(f"{self.root}/{name}/_new-{uuid.uuid4().hex}")
        _, named = self._fs(f"{self.root}/{name}/MANIFEST-{version:012}")
        out = fs.create(new, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        kind = getattr(hadoop, "Options$Rename")
        how = sc._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            hadoop.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(named), how)
        except Py4JJavaError as e:
            fs.delete(new, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _commit(self, name: str, change: Callable[[list[dict]], list[dict] | None], tries: int = 20) -> None:
        """A changed manifest, of the newest one there is; the change is made again where another writer came first."""
        for _ in range(tries):
            version = self._version(name)
            new = change(self._manifest(name, version))
            if new is None or self._write(name, version + 1, new):
                return
        raise RuntimeError(f"{name}: other writers came first {tries} times")

    def _read(self, name: str, segments: list[dict]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], ALL[name])
        paths = [f"{self.root}/{name}/segment={s['path']}" for s in segments]
        return self.spark.read.schema(ALL[name]).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def _segment(self, name: str, df: DataFrame, datasets: Sequence[str] | None) -> dict:
        path = f"s-{uuid.uuid4().hex}"
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ALL[name].fields])
        writer = rows.write.partitionBy("dataset") if name == "chunks" else rows.write
        writer.parquet(f"{self.root}/{name}/segment={path}")
        return {"path": path, "datasets": list(datasets) if datasets is not None else None}

    def read(self, name: str, datasets: Sequence[str] | None = None) -> DataFrame:
        """A table, or its rows of some datasets, read from the segments that may hold them."""
        key = "id" if name == "datasets" else "dataset"
        out = self._read(name, [s for s in self._manifest(name) if datasets is None or s["datasets"] is None or set(s["datasets"]) & set(datasets)])
        return out if datasets is None else out.where(F.col(key).isin(list(datasets)))

    def append(self, name: str, df: DataFrame, datasets: Sequence[str] | None = None) -> None:
        """Rows added as a segment of their own; what is there is not read."""
        segment = self._segment(name, df.select(*ALL[name].fieldNames()), datasets)
        self._commit(name, lambda manifest: [*manifest, segment])

    def rewrite(self, name: str, change: Callable[[DataFrame], DataFrame], datasets: Sequence[str] | None = None) -> None:
        """Segments that hold the datasets, rewritten as one by a change of their rows."""

        def changed(manifest: list[dict]) -> list[dict] | None:
            touched = [s for s in manifest if datasets is None or s["datasets"] is None or set(s["datasets"]) & set(datasets)]
            if not touched:
                return None
            held = None if any(s["datasets"] is None for s in touched) else sorted({d for s in touched for d in s["datasets"]})
            return [*[s for s in manifest if s not in touched], self._segment(name, change(self._read(name, touched)), held)]

        self._commit(name, changed)

    # --- datasets ---------------------------------------------------------------------

    def create_dataset(self, id: str, config: str | None = None, metadata: Mapping[str, str] | None = None, error_on_exists: bool = True) -> None:
        if self.dataset(id) is not None:
            if error_on_exists:
                raise ValueError(f"dataset exists: {id}")
            return
        row = self.spark.createDataFrame([(id, config, dict(metadata or {}))], ALL["datasets"])
        self.append("datasets", row.withColumn("metadata", clean_metadata(F.col("metadata"))), [id])

    def datasets(self) -> DataFrame:
        return self.read("datasets").orderBy("id")

    def dataset(self, id: str) -> dict | None:
        row = self.read("datasets", [id]).first()
        return row.asDict(recursive=True) if row else None

    def delete_dataset(self, id: str) -> None:
        """The dataset with its files, documents and chunks."""
        for name in ("chunks", "documents", "files"):
            self.rewrite(name, lambda df: df.where(F.col("dataset") != id), [id])
        self.rewrite("datasets", lambda df: df.where(F.col("id") != id), [id])

    def update_dataset(self, id: str, metadata: Mapping[str, str | None], replace: bool = False) -> None:
        """Metadata overwritten by key, or swapped as a whole; values that stand for none are dropped."""
        pairs = [c for k, v in metadata.items() for c in (F.lit(k), F.lit(v).cast("string"))]
        new = F.create_map(*pairs) if pairs else F.from_json(F.lit("{}"), "map<string,string>")
        value = clean_metadata(new) if replace else updated_metadata(F.col("metadata"), new)
        self.rewrite("datasets", lambda df: df.withColumn("metadata", F.when(F.col("id") == id, value).otherwise(F.col("metadata"))), [id])

    # --- files ------------------------------------------------------------------------

    def find_files(self, dataset: str, **wanted) -> DataFrame:
        """Files by any of id, name, absolute_path, size, modified_at; empty values ask for nothing."""
        out = self.read("files", [dataset])
        for k, v in wanted.items():
            if v:
                out = out.where(F.col(k) == F.lit(v))
        return out

    def get_file(self, dataset: str, ref: str) -> dict | None:
        """A file by id, absolute path, or the end of its path."""
        files = self.read("files", [dataset])
        rank = F.when(F.col("id") == ref, 0).when(F.col("absolute_path") == ref, 1).when(F.col("absolute_path").endswith("/" + ref.lstrip("./")), 2)
        row = files.withColumn("_r", rank).where("_r IS NOT NULL").orderBy("_r", "id").drop("_r").first()
        return row.asDict() if row else None

    def add(self, files: DataFrame, chunks: DataFrame, datasets: Sequence[str] | None = None) -> None:
        """Files with their chunks: chunks first, then documents, then files, so that a listed file always has its chunks."""
        self.append("chunks", chunks, datasets)
        documents = chunks.select("id", "dataset", "file_id", F.col("metadata")["docIndex"].try_cast("double").cast("int").alias("doc_index"))
        self.append("documents", documents, datasets)
        self.append("files", files, datasets)

    def delete_files(self, files: DataFrame, datasets: Sequence[str] | None = None) -> None:
        """Files ``(dataset, id)`` with their documents and chunks."""
        gone = files.select("dataset", F.col("id").alias("file_id")).distinct()
        for name in ("chunks", "documents"):
            self.rewrite(name, lambda df: df.join(gone, ["dataset", "file_id"], "left_anti"), datasets)
        self.rewrite("files", lambda df: df.join(gone.select("dataset", F.col("file_id").alias("id")), ["dataset", "id"], "left_anti"), datasets)

    def delete_documents(self, documents: DataFrame, datasets: Sequence[str] | None = None) -> None:
        """Documents ``(dataset, id)`` with their chunks; a file left without documents goes too."""
        gone = documents.select("dataset", "id").distinct()
        there = self.read("documents", datasets)
        touched = there.join(gone, ["dataset", "id"], "left_semi").select("dataset", "file_id").distinct()
        left = there.join(gone, ["dataset", "id"], "left_anti")
        empty = touched.join(left.select("dataset", "file_id").distinct(), ["dataset", "file_id"], "left_anti").select("dataset", F.col("file_id").alias("id"))
        self.rewrite("files", lambda df: df.join(empty, ["dataset", "id"], "left_anti"), datasets)
        for name in ("chunks", "documents"):
            self.rewrite(name, lambda df: df.join(gone, ["dataset", "id"], "left_anti"), datasets)

    def remove_chunks(self, dataset: str, where=None, id: str | None = None) -> None:
        """Chunks by a condition or an id; the condition counts where both are given."""
        hit = F.col("dataset") == dataset
        hit = hit & (where if where is not None else F.col("id") == id)
        self.rewrite("chunks", lambda df: df.where(~F.coalesce(hit, F.lit(False))), [dataset])

    def prune(self, dataset: str, prefix: str, keep: DataFrame) -> None:
        """Files of a dataset below a prefix that are not in the keep list go, with their chunks."""
        from strataline.operators.dedupe import prune

        self.delete_files(prune(self.read("files", [dataset]), keep, prefix), [dataset])

    def size(self, dataset: str) -> int:
        return self.read("chunks", [dataset]).count()

    def compact(self, name: str) -> None:
        """All segments of a table as one."""
        self.rewrite(name, lambda df: df)

    # --- archives ---------------------------------------------------------------------

    def export(self, target: str, dataset: str | None = None) -> None:
        """All tables, or those rows of one dataset, as plain Parquet folders."""
        for name in ALL:
            df = self.read(name, None if dataset is None else [dataset])
            df.write.mode("errorifexists").parquet(f"{target}/{name}")

    def import_(self, source: str) -> None:
        """Rows of an exported archive, added where their ids are new."""
        for name, schema in ALL.items():
            keys = ["id"] if name == "datasets" else ["dataset", "id"]
            new = self.spark.read.schema(schema).parquet(f"{source}/{name}").join(self.read(name).select(*keys), keys, "left_anti")
            self.append(name, new)
