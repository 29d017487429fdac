"""Text embeddings: a registry of encoders, stored rows with model, namespace and tenant, a cache, search by text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.operators import search

STORED = "id string, text string, embedding array<double>, provider string, model string, namespace string, tenant string"


class Encoders:
    """Encoders by provider and model: functions of a text column that give an array of doubles."""

    def __init__(self):
        self.models: dict[tuple[str, str], tuple[int, Callable[[Column], Column]]] = {}

    def register(self, provider: str, model: str, size: int, encode: Callable[[Column], Column]) -> None:
        self.models[provider, model] = (size, encode)

    def listed(self, spark: SparkSession) -> DataFrame:
        """(provider, model, dimension), in order of their names."""
        return spark.createDataFrame([(p, m, self.models[p, m][0]) for p, m in sorted(self.models)], "provider string, model string, dimension int")

    def encoded(self, text: Column, provider: str, model: str) -> Column:
        if (provider, model) not in self.models:
            raise ValueError(f"unknown model {provider}/{model}: one of {', '.join('/'.join(k) for k in sorted(self.models))}")
        return self.models[provider, model][1](text)


def standard() -> Encoders:
    """The encoders that need no library: hashed bags of tokens of several sizes."""
    out = Encoders()
    for size in (32, 64, 128):
        out.register("hashed", f"bag-{size}", size, lambda text, size=size: _hashed(text, size))
    return out


def _hashed(text: Column, size: int) -> Column:
    return search.hashed_embedding(text, size)


def embedded(texts: DataFrame, encoders: Encoders, provider: str = "hashed", model: str = "bag-64", namespace: str = "default", tenant: str = "default", text: str = "text", key: str = "id") -> DataFrame:
    """Rows as ``STORED`` has them."""
    return texts.select(
        F.col(key).cast("string").alias("id"), F.col(text).alias("text"), encoders.encoded(F.coalesce(F.col(text), F.lit("")), provider, model).alias("embedding"),
        F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(namespace).alias("namespace"), F.lit(tenant).alias("tenant"),
    )


def with_cache(texts: DataFrame, cache: DataFrame, encoders: Encoders, provider: str = "hashed", model: str = "bag-64", text: str = "text", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Embeddings of the texts, and the cache with those that were missing; cache: (cache_key, embedding).

    The cache's key is a digest of text, model and provider; a text that occurs twice is encoded once.
    """
    digest = F.sha2(F.concat_ws("\x1f", F.coalesce(F.col(text), F.lit("")), F.lit(model), F.lit(provider)), 256)
    keyed = texts.withColumn("cache_key", digest)
    missing = keyed.select("cache_key", F.coalesce(F.col(text), F.lit("")).alias("_text")).join(cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])
    new = missing.select("cache_key", encoders.encoded(F.col("_text"), provider, model).alias("embedding"))
    every = cache.select("cache_key", "embedding").unionByName(new)
    return keyed.join(every, "cache_key").drop("cache_key"), every


def statistics(stored: DataFrame) -> DataFrame:
    """(provider, model, namespace, tenant, embeddings, dimension) of stored embeddings."""
    return stored.groupBy("provider", "model", "namespace", "tenant").agg(F.count("*").alias("embeddings"), F.max(F.size("embedding")).alias("dimension"))


def text_search(spark: SparkSession, stored: DataFrame, query: str, encoders: Encoders, k: int = 10, provider: str = "hashed", model: str = "bag-64", namespace: str | None = None, tenant: str | None = None, least_score: float | None = None) -> DataFrame:
    """The k stored rows closest to a text by cosine, among those of the model and, if given, the namespace and tenant."""
    vector = spark.range(1).select(encoders.encoded(F.lit(query), provider, model).alias("v")).first().v
    where = (F.col("provider") == provider) & (F.col("model") == model)
    for column, wanted in (("namespace", namespace), ("tenant", tenant)):
        if wanted is not None:
            where &= F.col(column) == wanted
    return search.nearest(stored, list(vector), k, "cosine", where, least_score, tie="id", data="embedding")
