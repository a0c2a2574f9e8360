"""All queries over the knowledge tables, as Spark DataFrames and as DuckDB checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import context, documents, ranking, search, structures, text, weighted
from ..operators import answers, dictionaries, evidence, health, order, provenance, relational, revisions
from ..sources import documents as folders
from ..sources import chats, files, imports, packages, platforms, published
from ..streaming import changes
from ..views import run_sql, with_views
from .dialect import DUCK, SPARK, Dialect

TEXTS = {**relational.R, **evidence.R, **dictionaries.R, **order.R, **provenance.R, **revisions.R, **answers.R, **health.R, **text.R, **search.R, **weighted.R, **structures.R, **context.R, **packages.R, **documents.R, **folders.R, **imports.R, **files.R, **chats.R, **published.R, **platforms.R, **changes.R}


def _query(make) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, make(Dialect(SPARK)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: _query(make) for key, make in TEXTS.items()} | ranking.QUERIES | weighted.QUERIES | structures.QUERIES | packages.QUERIES | documents.QUERIES | folders.QUERIES | imports.QUERIES | files.QUERIES | chats.QUERIES | published.QUERIES | platforms.QUERIES | revisions.QUERIES | answers.QUERIES | health.QUERIES | order.QUERIES | evidence.QUERIES | changes.STREAMS


def checks() -> dict[str, str]:
    return {key: with_views(make(Dialect(DUCK))) for key, make in TEXTS.items()}
