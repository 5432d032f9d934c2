"""The public API: datasets, ingestion, retrieval over a catalog."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.core.catalog import Catalog
from strataline.core.runtime import ship
from strataline.operators import dedupe
from strataline.operators.providers import Embedder, HashingEmbedder, embedded
from strataline.operators.splitters import SPLITTERS
from strataline.operators.transforms import TRANSFORMS, filter_markdown, ingest_metadata, renumber
from strataline.plans.flow import FlowConfig, Models
from strataline.sources import loaders


def directory_dataset(path: str) -> str:
    """Dataset id of a folder: SHA-1 of its absolute path."""
    return hashlib.sha1(os.path.abspath(path).encode()).hexdigest()


class Client:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, config: FlowConfig | None = None):
        self.spark, self.catalog = ship(spark), Catalog(spark, root)
        self.embedder = embedder or HashingEmbedder()
        self.config = config or FlowConfig.blueprint("default", Models(embed=self.embedder.embed))
        for flow in self.config.flows.values():
            flow.models.embed = flow.models.embed or self.embedder.embed

    def create_dataset(self, id: str, **options) -> None:
        self.catalog.create_dataset(id, **options)

    def delete_dataset(self, id: str) -> None:
        self.catalog.delete_dataset(id)

    def datasets(self) -> DataFrame:
        return self.catalog.datasets()

    def ingest(self, dataset: str, path: str, duplicates: str | None = None, metadata: Mapping[str, str] | None = None, ignore: Sequence[str] = (), flow: str | None = None) -> dict[str, int]:
        """Files of a folder loaded, split, transformed, embedded and stored; the counts of ingested and skipped files."""
        self.catalog.create_dataset(dataset, error_on_exists=False)
        found = loaders.files(self.spark, path).where(~loaders.ignored(F.col("path"), ignore))
        name = F.regexp_extract("path", "([^/]+)$", 1)
        incoming = found.select(F.lit(dataset).alias("dataset"), name.alias("name"), F.col("path").alias("absolute_path"), "size", "modified_at", "data")
        existing = self.catalog.read("files", [dataset])
        new = dedupe.strategy(duplicates)(incoming, existing).withColumn("id", F.sha2(F.concat_ws("|", "dataset", "absolute_path", F.col("modified_at").cast("string")), 256))
        taken = new.count()
        total = found.count()
        if not taken:
            return {"ingested": 0, "skipped": total}
        chosen = self.config.select(flow, dataset)
        kinds = [r[0] for r in new.select(loaders.file_type(F.col("absolute_path"), F.col("data")).alias("kind")).distinct().collect()]  # file types
        by_rule: dict[int | None, list[str]] = {}
        for kind in kinds:
            rule = chosen.ingestion_for(kind)
            if rule or not chosen.ingestion:  # a flow with rules takes only the types that they name
                by_rule.setdefault(chosen.ingestion.index(rule) if rule else None, []).append(kind)
        parts = None
        for at, own in by_rule.items():
            rule = chosen.ingestion[at] if at is not None else None
            held = new.where(loaders.file_type(F.col("absolute_path"), F.col("data")).isin(own))
            docs = loaders.load(held.select(F.col("absolute_path").alias("path"), "data"), rule.loader if rule else None).where(F.coalesce("content", F.lit("")) != "")
            docs = docs.join(held.select(F.col("absolute_path").alias("path"), F.col("id").alias("file_id"), "name", "size"), "path")
            extra = F.map_concat("metadata", F.create_map(*[F.lit(x) for kv in metadata.items() for x in kv])) if metadata else F.col("metadata")
            docs = docs.withColumn("metadata", ingest_metadata(extra, F.col("name"), F.col("path"), F.col("size")))
            docs = docs.withColumn("kind", loaders.file_type(F.col("path"))).withColumnRenamed("doc_index", "_doc")
            options = rule.splitter_options if rule else {"chunkSize": 2048, "chunkOverlap": 256}
            for splitter in [rule.splitter] if rule and rule.splitter else ["markdown", "text"]:
                mine = docs if rule and rule.splitter else docs.where((F.col("kind") == ".md") == F.lit(splitter == "markdown"))
                part = self._split(mine, splitter, options)
                for step, o in rule.transforms if rule else ():
                    part = TRANSFORMS[step](part, **({"llm": self.config.select(flow, dataset).models.llm} if step == "keywords" else {}), **o)
                parts = part if parts is None else parts.unionByName(part)
        if parts is None:
            return {"ingested": 0, "skipped": total}
        chunks = parts.withColumn("id", F.sha2(F.concat_ws("|", "file_id", F.col("_doc").cast("string"), F.col("docIndex").cast("string")), 256)).withColumn("dataset", F.lit(dataset))
        chunks = renumber(chunks, order=F.col("_doc") * 1_000_000 + F.col("docIndex"))
        chunks = embedded(chunks, self.embedder).select("id", "dataset", "file_id", "content", "metadata", "embedding")
        older = existing.join(new.select("absolute_path").distinct(), "absolute_path", "left_semi")
        self.catalog.add(new.select("id", "dataset", "name", "absolute_path", "size", "modified_at"), chunks, [dataset])
        if not older.isEmpty():  # read from the segments as they were before the files came in
            self.catalog.delete_files(older.select("dataset", "id"), [dataset])
        return {"ingested": taken, "skipped": total - taken}

    @staticmethod
    def _split(docs: DataFrame, splitter: str, options: Mapping) -> DataFrame:
        """Documents cut as a flow says; sizes of Markdown are in characters, four to a token."""
        size = int(options["chunkSize"])
        if splitter == "text":
            return SPLITTERS["text"](docs, size, min(int(options["chunkOverlap"]), size - 1))
        part = SPLITTERS[splitter](docs, 4 * size)
        return filter_markdown(part) if splitter == "markdown" else part

    def retrieve(self, query: str, datasets: Sequence[str], top_k: int = 10, flow: str | None = None) -> DataFrame:
        vector = self.embedder.embed([query])[0]
        asked = self.spark.createDataFrame([("q", query, [float(x) for x in vector])], "query_id string, query string, vector array<float>")
        chunks = self.catalog.read("chunks", datasets)
        return self.config.select(flow, datasets[0] if datasets else None).retrieve(asked, chunks, top_k)

    def ask_directory(self, path: str, query: str, **options) -> DataFrame:
        """A folder ingested as its own dataset, files that are gone pruned, and searched."""
        dataset = directory_dataset(path)
        self.ingest(dataset, path)
        keep = loaders.files(self.spark, path).select(F.col("path").alias("absolute_path"))
        self.catalog.prune(dataset, loaders.folder_uri(self.spark, path), keep)
        return self.retrieve(query, [dataset], **options)
