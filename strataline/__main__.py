"""Command line: datasets, ingestion, retrieval, SQL."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from strataline.core.client import Client
from strataline.operators import sql


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strataline")
    p.add_argument("--root", default="strataline-data")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("create-dataset", "delete-dataset", "get-dataset"):
        verbs.add_parser(verb).add_argument("id")
    verbs.add_parser("list-datasets")
    v = verbs.add_parser("edit-dataset")
    v.add_argument("id")
    v.add_argument("--metadata", default="{}")
    v.add_argument("--replace", action="store_true")
    v = verbs.add_parser("get-file")
    v.add_argument("dataset")
    v.add_argument("ref")
    v = verbs.add_parser("delete-file")
    v.add_argument("dataset")
    v.add_argument("ref")
    v = verbs.add_parser("ingest")
    v.add_argument("dataset")
    v.add_argument("path")
    v.add_argument("--duplicates")
    v = verbs.add_parser("retrieve")
    v.add_argument("query")
    v.add_argument("datasets", nargs="+")
    v.add_argument("--top-k", type=int, default=10)
    v = verbs.add_parser("askdir")
    v.add_argument("path")
    v.add_argument("query")
    for verb in ("export", "import"):
        verbs.add_parser(verb).add_argument("target")
    v = verbs.add_parser("load")
    v.add_argument("path")
    v.add_argument("--format", choices=("structured", "markdown"), default="structured")
    v = verbs.add_parser("query")
    v.add_argument("folder")
    v.add_argument("sql")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("strataline").getOrCreate()
    client = Client(spark, a.root)
    show = lambda x: print(json.dumps(x, default=str))
    if a.verb == "create-dataset":
        client.create_dataset(a.id)
    elif a.verb == "delete-dataset":
        client.delete_dataset(a.id)
    elif a.verb == "get-dataset":
        show(client.catalog.dataset(a.id))
    elif a.verb == "list-datasets":
        for r in client.datasets().toLocalIterator():
            show(r.asDict(recursive=True))
    elif a.verb == "edit-dataset":
        client.catalog.update_dataset(a.id, json.loads(a.metadata), a.replace)
    elif a.verb == "get-file":
        show(client.catalog.get_file(a.dataset, a.ref))
    elif a.verb == "delete-file":
        found = client.catalog.get_file(a.dataset, a.ref)
        if found:
            client.catalog.delete_files(spark.createDataFrame([(a.dataset, found["id"])], "dataset string, id string"), [a.dataset])
    elif a.verb == "ingest":
        show(client.ingest(a.dataset, a.path, a.duplicates))
    elif a.verb == "retrieve":
        for r in client.retrieve(a.query, a.datasets, a.top_k).orderBy("rank").toLocalIterator():
            show(r.asDict(recursive=True))
    elif a.verb == "askdir":
        for r in client.ask_directory(a.path, a.query).orderBy("rank").toLocalIterator():
            show(r.asDict(recursive=True))
    elif a.verb == "export":
        client.catalog.export(a.target)
    elif a.verb == "import":
        client.catalog.import_(a.target)
    elif a.verb == "load":
        from strataline.sources import loaders, sinks

        docs = loaders.load(loaders.files(spark, a.path))
        out = sinks.structured_json(docs) if a.format == "structured" else sinks.markdown(docs)
        for r in out.toLocalIterator():
            print(r[1])
    elif a.verb == "query":
        sql.register(spark, a.folder, sql.tables_in(a.folder))
        show(sql.query_json(spark, a.sql))


if __name__ == "__main__":
    main()
