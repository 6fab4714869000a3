"""What the entry registers: the corpus queries and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .oracles import oracle_sql as _oracle_sql
from .queries import queries as _queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _queries() | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = _oracle_sql()
    return found if corpus_pipeline.ORACLE_SQL is None else found | {"pipeline": corpus_pipeline.ORACLE_SQL}
