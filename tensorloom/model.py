"""Logical tables of the engine and the views that turn the driver's tables into tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One row per tensor. Metadata is a VARIANT where a table is made in memory and its JSON string in storage.
TENSORS = "dataset string, tensor_id string, seq long, shape array<bigint>, dtype string, data array<double>, metadata string, created_at timestamp, version long"
ELEMENTS = "tensor_id string, pos long, value double"
VECTORS = "vector_id string, embedding array<float>, namespace string, tenant_id string, content string, metadata map<string,string>"
CHANGES = "seq long, op string, dataset string, tensor_id string, record string"

#: Type names, their Spark type and whether numbers of the type can be computed with.
DTYPES = {
    "float16": ("float", True), "float32": ("float", True), "float64": ("double", True), "int8": ("tinyint", True), "int16": ("smallint", True), "int32": ("int", True),
    "int64": ("bigint", True), "uint8": ("smallint", True), "uint16": ("int", True), "uint32": ("bigint", True), "uint64": ("decimal(20,0)", True), "bool": ("boolean", True),
    "complex64": ("struct<re:float,im:float>", False), "complex128": ("struct<re:double,im:double>", False), "string": ("string", False), "other": ("binary", False),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, data: the embeddings as arrays of doubles."""
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("data"))


def elements(df: DataFrame, key: str, data: str = "data") -> DataFrame:
    """The element form: key, pos, value."""
    return df.select(key, F.posexplode(data).alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


def matrices(spark: SparkSession, sf_dir: str, columns: int = 8) -> DataFrame:
    """vec_id, i, j, value: the embeddings as matrices in element form."""
    e = elements(vectors(spark, sf_dir), "vec_id")
    return e.select("vec_id", F.floor(F.col("pos") / columns).cast("long").alias("i"), (F.col("pos") % columns).alias("j"), "value")


def dense(cells: DataFrame, key: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """The dense form of elements: key, data in order of position. The elements of one tensor meet in one row."""
    return cells.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda s: s[value]).alias("data"))


def nested(data, shape: list[int]):
    """A flat row-major array as nested arrays."""
    out = F.col(data) if isinstance(data, str) else data
    for d in reversed(shape[1:]):
        out = _grouped(out, d)
    return out


def _grouped(column, size: int):
    return F.transform(F.sequence(F.lit(0), (F.size(column) / size).cast("int") - 1), lambda i: F.slice(column, i * size + 1, F.lit(size)))
