"""The registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

from . import queries as query_modules
from . import registry

for _module in sorted(m.name for m in pkgutil.iter_modules(query_modules.__path__)):
    importlib.import_module(f"{query_modules.__name__}.{_module}")


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked retrieval of chunks, grouped to documents, for the standard questions."""
    return registry.QUERIES["bm25_document_topk"](spark, sf_dir)
