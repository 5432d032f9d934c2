"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DataType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType
from pyspark.sql.types import DoubleType, MapType

_S, _L, _I, _T = StringType(), LongType(), IntegerType(), TimestampType()
_META = MapType(_S, _S)


def _schema(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


DATASETS = _schema(id=_S, embeddings_provider_config=_S, metadata=_META)
FILES = _schema(id=_S, dataset=_S, name=_S, absolute_path=_S, size=_L, modified_at=_T)
DOCUMENTS = _schema(id=_S, dataset=_S, file_id=_S, doc_index=_I)
CHUNKS = _schema(id=_S, dataset=_S, file_id=_S, content=_S, metadata=_META, embedding=ArrayType(FloatType()))
RANKED = _schema(query_id=_S, subquery_no=_I, id=_S, rank=_I, score=DoubleType())
STATE = _schema(key=_S, file_path=_S, updated_at=_S, checksum=_S, size_in_bytes=_L)
RUNS = _schema(id=_S, task_id=_S, start_time=_T, end_time=_T, input=_S, error=_S)
ALL = {"datasets": DATASETS, "files": FILES, "documents": DOCUMENTS, "chunks": CHUNKS}
