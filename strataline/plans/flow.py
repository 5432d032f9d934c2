"""Flow configuration: what happens to files on ingestion and to queries on retrieval."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.operators import postprocess, rewrite
from strataline.operators.providers import LLM, EchoLLM, OverlapReranker, Reranker
from strataline.operators.ranking import BM25, Dense, Merge, Retriever, Routed, Subqueries, ranked, with_content
from strataline.operators.splitters import SPLITTERS, merged_options
from strataline.operators.transforms import TRANSFORMS
from strataline.sources.loaders import loader

# Blueprints shipped with the engine.
BLUEPRINTS: dict[str, dict] = {
    "default": {
        "flows": {
            "documents": {
                "default": True,
                "globals": {"ingestion": {"textsplitter": {"chunkSize": 800, "chunkOverlap": 400}}},
                "ingestion": [{"filetypes": ["*"]}],
                "retrieval": {"retriever": {"name": "basic", "options": {"topK": 20}}},
            }
        }
    },
    "context": {
        "flows": {
            "context": {
                "default": True,
                "retrieval": {
                    "retriever": {
                        "name": "merge",
                        "options": {
                            "topK": 20,
                            "retrievers": [
                                {"name": "basic", "weight": 0.7, "options": {"topK": 20}},
                                {"name": "bm25", "weight": 0.3, "options": {"topN": 10, "k1": 1.2, "b": 0.75}},
                            ],
                        },
                    },
                    "postprocessors": [{"name": "similarity", "options": {"threshold": 0.4}}, {"name": "reduce", "options": {"topK": 20}}],
                },
            }
        }
    },
    "hosted": {
        "flows": {
            "hosted": {
                "default": True,
                "globals": {"ingestion": {"textsplitter": {"chunkSize": 2048, "chunkOverlap": 256}}},
                "ingestion": [{"filetypes": [".json"], "documentloader": {"name": "structured"}}],
                "retrieval": {"retriever": {"name": "basic", "options": {"topK": 10}}},
            },
            "hostedload": {
                "globals": {"ingestion": {"textsplitter": {"chunkSize": 2048, "chunkOverlap": 256}}},
                "ingestion": [{"filetypes": [".pdf"], "documentloader": {"name": "smartpdf"}}],
            },
        }
    },
}


class ConfigError(ValueError):
    pass


@dataclass
class Models:
    """What a flow asks: a language model, a reranker, and the embedder of queries that a retriever makes itself."""

    llm: LLM = field(default_factory=EchoLLM)
    reranker: Reranker = field(default_factory=OverlapReranker)
    embed: Callable[[Sequence[str]], list[list[float]]] | None = None


def _of(spec: dict | None, key: str, default=None):
    """A value of a mapping whose keys count without regard to case."""
    return next((v for k, v in (spec or {}).items() if k.lower() == key.lower() and v is not None), default)


def _options(spec: dict) -> dict:
    return {k.lower(): v for k, v in (_of(spec, "options") or {}).items()}


def _retriever(spec: dict, models: Models) -> Retriever:
    name, o = _of(spec, "name", "basic"), _options(spec)
    if name in ("basic", "default"):
        return Dense(top_k=o.get("topk") or 10)
    if name == "bm25":
        return BM25(o.get("topn") or 10, o.get("k1") or 1.2, o.get("b") or 0.75, tuple(o.get("cleanstopwords") or ()))
    if name == "merge":
        return Merge([(_of(r, "name"), _of(r, "weight", 1.0), _retriever(r, models)) for r in o.get("retrievers") or []], o.get("topk") or 10)
    if name == "subquery":
        return Subqueries(models.llm, models.embed, o.get("limit") or 3, o.get("topk") or 3)
    if name == "routing":
        return Routed(models.llm, o.get("availabledatasets") or (), o.get("topk") or 10)
    raise ConfigError(f"unknown retriever: {name}")


def _postprocessor(spec: dict, models: Models) -> Callable[[DataFrame, DataFrame], DataFrame]:
    name, o = _of(spec, "name"), _options(spec)
    if name == "similarity":
        return lambda df, q: postprocess.similarity(df, o.get("threshold", 0.0), o.get("keepmin", 0))
    if name == "reduce":
        return lambda df, q: postprocess.reduce(df, o.get("topk", 0))
    if name == "content_substring_filter":
        return lambda df, q: postprocess.content_substring(df, o.get("contains") or (), o.get("notcontains") or ())
    if name == "content_filter":
        return lambda df, q: postprocess.content_filter(df, models.llm, o.get("question", ""), o.get("include", True))
    if name == "bm25":
        return lambda df, q: postprocess.bm25_rerank(df, q, o.get("topn", 0), o.get("sparseweight", 0.5), o.get("k1") or 1.2, o.get("b") or 0.75, tuple(o.get("cleanstopwords") or ()))
    if name in ("cohere_rerank", "rerank"):
        return lambda df, q: postprocess.external_rerank(df, q, models.reranker, o.get("topn", 0))
    if name in TRANSFORMS:
        given = _of(spec, "options") or {}
        return lambda df, q: TRANSFORMS[name](df, **({"llm": models.llm} if name == "keywords" else {}), **given)
    raise ConfigError(f"unknown postprocessor: {name}")


def _modifier(spec: dict, models: Models) -> Callable[[DataFrame], DataFrame]:
    """``queries`` to queries; those of one query are told apart by numbers from 0."""
    name, o = _of(spec, "name"), _options(spec)
    if name == "spellcheck":
        return lambda q: rewrite.spellcheck(q, models.llm)
    if name == "enhance":
        return lambda q: rewrite.enhance(q, models.llm)
    if name == "generic":
        return lambda q: rewrite.generic(q, models.llm, o.get("prompt", ""))
    raise ConfigError(f"unknown query modifier: {name}")


@dataclass
class Ingestion:
    """What happens to files of some types. Names are looked up where the rule is used, so a configuration may name what another build has."""

    filetypes: Sequence[str] = ("*",)
    loader: str | None = None
    splitter: str | None = None
    splitter_options: dict = field(default_factory=dict)
    transforms: list[tuple[str, dict]] = field(default_factory=list)
    converter: str | None = None

    def takes(self, filetype: str) -> bool:
        return "*" in self.filetypes or filetype in self.filetypes

    def check(self) -> Ingestion:
        if self.loader:
            try:
                loader(self.loader)
            except ValueError as e:
                raise ConfigError(str(e)) from None
        if self.splitter and self.splitter not in SPLITTERS:
            raise ConfigError(f"unknown text splitter: {self.splitter}")
        for name, _ in self.transforms:
            if name not in TRANSFORMS:
                raise ConfigError(f"unknown transformer: {name}")
        return self


@dataclass
class Flow:
    """New instances for each flow: options never leak from one to another."""

    name: str
    default: bool = False
    ingestion: list[Ingestion] = field(default_factory=list)
    retriever: Retriever | None = None
    postprocessors: list[Callable[[DataFrame, DataFrame], DataFrame]] = field(default_factory=list)
    modifiers: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    models: Models = field(default_factory=Models)

    def ingestion_for(self, filetype: str) -> Ingestion | None:
        """The first rule that takes a file type."""
        rule = next((i for i in self.ingestion if i.takes(filetype)), None)
        return rule.check() if rule else None

    def modified(self, queries: DataFrame) -> DataFrame:
        """Queries rewritten, and embedded anew; several of one get ids ``query_id#number``."""
        from strataline.operators.providers import embedded_with

        if not self.modifiers:
            return queries
        out = queries.select("query_id", "query")
        for step in self.modifiers:
            out = step(out)
            if "subquery_no" in out.columns:
                out = out.select(F.concat_ws("#", F.col("query_id").cast("string"), "subquery_no").alias("query_id"), "query")
        return embedded_with(out, self.models.embed, "query", "vector") if self.models.embed else out

    def retrieve(self, queries: DataFrame, chunks: DataFrame, top_k: int = 10) -> DataFrame:
        """Ranked rows with contents. ``top_k`` counts only where the flow names no retriever."""
        retriever = self.retriever or Dense(top_k=top_k)
        queries = self.modified(queries)
        out = with_content(retriever.retrieve(queries, chunks), chunks)
        for step in self.postprocessors:
            out = step(out, queries)
        return ranked(out)


def _ingestion(spec: dict, shared: dict) -> Ingestion:
    splitter, named, converter = (_of(spec, k) or {} for k in ("textSplitter", "documentLoader", "converter"))
    transforms = [(_of(t, "name"), _of(t, "options") or {}) for t in _of(spec, "transformers") or []]
    options = merged_options(_of(splitter, "options"), merged_options(_of(shared, "textsplitter"), {"chunkSize": 2048, "chunkOverlap": 256}))
    return Ingestion(tuple(_of(spec, "filetypes") or ("*",)), _of(named, "name"), _of(splitter, "name"), options, transforms, _of(converter, "name"))


@dataclass
class FlowConfig:
    flows: dict[str, Flow]
    datasets: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str, models: Models | None = None) -> FlowConfig:
        """From YAML or JSON, environment variables expanded; keys count without regard to case."""
        try:
            data = yaml.safe_load(os.path.expandvars(text))
        except yaml.YAMLError as e:
            raise ConfigError(str(e)) from e
        if not isinstance(data, dict):
            raise ConfigError("a flow configuration is a mapping")
        return cls.build(data, models)

    @classmethod
    def build(cls, data: dict[str, Any], models: Models | None = None) -> FlowConfig:
        models = models or Models()
        specs = _of(data, "flows")
        if not isinstance(specs, dict) or not specs:
            raise ConfigError("no flows")
        flows: dict[str, Flow] = {}
        for name, spec in json.loads(json.dumps(specs)).items():
            spec = spec or {}
            if not isinstance(spec, dict):
                raise ConfigError(f"flow {name} is no mapping")
            shared = _of(_of(spec, "globals"), "ingestion") or {}
            retrieval = _of(spec, "retrieval") or {}
            named = _of(retrieval, "retriever")
            flows[name] = Flow(
                name,
                bool(_of(spec, "default")),
                [_ingestion(i, shared) for i in _of(spec, "ingestion") or []],
                _retriever(named, models) if named else None,
                [_postprocessor(p, models) for p in _of(retrieval, "postprocessors") or []],
                [_modifier(m, models) for m in _of(retrieval, "queryModifiers") or []],
                models,
            )
        if sum(f.default for f in flows.values()) > 1:
            raise ConfigError("more than one default flow")
        datasets = _of(data, "datasets") or {}
        for dataset, flow in datasets.items():
            if flow not in flows:
                raise ConfigError(f"dataset {dataset} names an unknown flow: {flow}")
        return cls(flows, datasets)

    @classmethod
    def blueprint(cls, name: str, models: Models | None = None) -> FlowConfig:
        if name not in BLUEPRINTS:
            raise ConfigError(f"unknown blueprint: {name}")
        return cls.build(BLUEPRINTS[name], models)

    def select(self, name: str | None = None, dataset: str | None = None) -> Flow:
        """The named flow, else the dataset's, else the default one."""
        if name:
            if name not in self.flows:
                raise ConfigError(f"unknown flow: {name}")
            return self.flows[name]
        if dataset and dataset in self.datasets:
            return self.flows[self.datasets[dataset]]
        for flow in self.flows.values():
            if flow.default:
                return flow
        raise ConfigError("no default flow")


def selected_providers(config: dict, name: str) -> dict:
    """A provider configuration with only the provider in use."""
    return {**config, "providers": [p for p in config.get("providers", []) if p.get("name") == name]}
