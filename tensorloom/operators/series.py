"""Time series: tensors with dates, a synthetic generator, forecasts by series."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.operators import linalg


def loaded(tensors: DataFrame, name: str, field: str = "name", metadata: str = "metadata", data: str = "data") -> DataFrame:
    """(ts, pos, value) of the first 1-D tensor whose metadata field is name; dates index it where their number fits, else 0..n-1."""
    row = tensors.where((F.get_json_object(metadata, f"$.{field}") == name) & (F.size("shape") == 1)).orderBy("seq").limit(1)
    dates = F.from_json(F.get_json_object(metadata, "$.dates"), "array<string>")
    fit = F.when(F.size(dates) == F.size(data), dates)
    return row.select(F.posexplode(data).alias("pos", "value"), fit.alias("d")).select(F.get("d", F.col("pos")).alias("ts"), "pos", "value")


def generated(spark: SparkSession, days: int = 500, start: float = 100.0, slope: float = 0.05, amplitude: float = 5.0, period: int = 30, noise: float = 1.0, volume: float = 1e6, spread: float = 0.2, seed: int = 42) -> DataFrame:
    """(day, close, volume): trend, season and noise with a floor of 1."""
    t = F.col("id").cast("double")
    price = start + slope * t + amplitude * F.sin(2 * np.pi * t / period) + noise * F.randn(seed)
    return spark.range(days).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.greatest(price, F.lit(1.0)).alias("close"), (volume * (1 + spread * (2 * F.rand(seed + 1) - 1))).cast("long").alias("volume"))


def forecast(series: DataFrame, key: str, order: str, value: str, p: int = 5, d: int = 1, n: int = 30) -> DataFrame:
    """(key, step, value): AR(p) on d-th differences of each series; a series is what one task holds at once."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        y = linalg.ar_forecast(group.sort_values(order)[value].to_numpy(float), p, d, n)
        return pd.DataFrame({key: group[key].iloc[0], "step": np.arange(1, n + 1, dtype=np.int32), "value": y})

    return series.select(key, order, value).groupBy(key).applyInPandas(run, f"{key} {series.schema[key].dataType.simpleString()}, step int, value double")


def store_predictions(store, forecasts: DataFrame, dataset: str, source: str, model: str, key: str, **parameters) -> None:
    """Writes each series' forecast (key, step, value) as one tensor, with its provenance as metadata."""
    step = F.struct("step", "value")
    rows = forecasts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: s["value"]).alias("data"))
    about = F.to_json(F.struct(F.lit(source).alias("source"), F.col(key).cast("string").alias("series"), F.lit(model).alias("model"), F.lit(json.dumps(parameters, sort_keys=True)).alias("parameters"), F.size("data").alias("steps")))
    if not store.exists(dataset):
        store.create(dataset)
    name = F.concat(F.lit(f"{source}:{model}:"), F.col(key).cast("string"))
    store.insert(dataset, rows.select(name.alias("tensor_id"), F.array(F.size("data").cast("bigint")).alias("shape"), "data", about.alias("metadata")))


def random_search(spark: SparkSession, trials: int, objective, space: dict[str, tuple[float, float]], seed: int = 0, maximize: bool = False) -> DataFrame:
    """(trial, parameters..., score), the best first: uniform draws, scored in parallel."""
    names = list(space)
    draws: list[Column] = [(low + (high - low) * F.rand(seed + i)).alias(name) for i, (name, (low, high)) in enumerate(space.items())]
    grid = spark.range(trials).select(F.col("id").alias("trial"), *draws)

    def run(batches):
        for b in batches:
            yield b.assign(score=[float(objective(**row)) for row in b[names].to_dict("records")])

    out = grid.mapInPandas(run, "trial long, " + ", ".join(f"{n} double" for n in names) + ", score double")
    return out.orderBy(F.desc("score") if maximize else F.asc("score"), "trial")
