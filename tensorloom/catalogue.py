"""Every registered query and, where SQL can express it, its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tensorloom.queries import crud, engine, search, tables, tensors

QUERIES: dict = {**tensors.QUERIES, **search.QUERIES, **tables.QUERIES, **engine.QUERIES, **crud.QUERIES}
ORACLES: dict = {**tensors.ORACLES, **search.ORACLES, **tables.ORACLES, **engine.ORACLES, **crud.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.flagship(spark, sf_dir)
