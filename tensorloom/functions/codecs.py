"""Tensor codecs as column expressions: int8, SQ8, sparse pairs, half precision, chunks; and the choice among them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions import dense as D
from tensorloom.operators import linalg

#: Parquet codec and quantisation of each preset.
PRESETS = {"none": ("none", None), "fast": ("lz4", None), "balanced": ("gzip", "float16"), "maximum": ("gzip", "int8"), "fp16_only": ("none", "float16"), "int8_only": ("none", "int8")}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def int8(data) -> Column:
    """struct(values, scale, zero_point, constant): affine codes; the zero point isn't clamped, so ranges far from 0 don't saturate."""
    d = _c(data)
    low, high = F.array_min(d).cast("double"), F.array_max(d).cast("double")
    constant = high == low
    scale = F.when(constant, F.lit(1.0)).otherwise((high - low) / 255)
    zero = F.when(constant, F.lit(0)).otherwise((-128 - low / scale).cast("bigint"))

    def coded(s: Column) -> Column:
        values = F.transform(d, lambda x: F.when(s["constant"], F.lit(0)).otherwise(F.greatest(F.least(F.rint(x.cast("double") / s["scale"]) + s["zero"], F.lit(127.0)), F.lit(-128.0)).cast("int")))
        return F.struct(values.alias("values"), F.when(s["constant"], s["low"]).otherwise(s["scale"]).alias("scale"), s["zero"].alias("zero_point"), s["constant"].alias("constant"))

    return D.bound(F.struct(low.alias("low"), scale.alias("scale"), zero.alias("zero"), constant.alias("constant")), coded)


def from_int8(code) -> Column:
    c = _c(code)
    return F.transform(c["values"], lambda q: F.when(c["constant"], c["scale"]).otherwise((q - c["zero_point"]) * c["scale"]))


def sq8(data) -> Column:
    """struct(values 0..255, low, scale); the error is at most half the scale."""
    d = _c(data)
    low, high = F.array_min(d).cast("double"), F.array_max(d).cast("double")
    scale = F.when(high == low, F.lit(1.0)).otherwise((high - low) / 255)

    def coded(s: Column) -> Column:
        return F.struct(F.transform(d, lambda x: F.round((x.cast("double") - s["low"]) / s["scale"]).cast("int")).alias("values"), s["low"].alias("low"), s["scale"].alias("scale"))

    return D.bound(F.struct(low.alias("low"), scale.alias("scale")), coded)


def from_sq8(code) -> Column:
    c = _c(code)
    return F.transform(c["values"], lambda q: c["low"] + q * c["scale"])


def sparse(data) -> Column:
    """array of struct(idx, val) of the elements other than 0."""
    pairs = F.transform(_c(data), lambda x, i: F.struct(i.alias("idx"), x.cast("double").alias("val")))
    return F.filter(pairs, lambda p: p["val"] != 0)


def from_sparse(code, size) -> Column:
    keys = F.map_from_entries(_c(code))
    return F.transform(F.sequence(F.lit(0), (F.lit(size) if isinstance(size, int) else _c(size)) - 1), lambda i: F.coalesce(F.try_element_at(keys, i), F.lit(0.0)))


def float16(data) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: None if v is None else np.asarray(v, float).astype(np.float16).astype(float))

    return run(_c(data))


def low_rank(data, rows: int, columns: int, energy: float = 0.99) -> Column:
    """The truncated SVD that keeps the given share of energy, multiplied out again (the codec's reading)."""

    def kernel(a: np.ndarray) -> np.ndarray:
        u, s, v = np.linalg.svd(a, full_matrices=False)
        r = int(np.searchsorted(np.cumsum(s**2) / max((s**2).sum(), 1e-300), energy)) + 1
        return (u[:, :r] * s[:r]) @ v[:r]

    return linalg.array_udf(kernel, _c(data), shapes=[[rows, columns]])


def _low_energy(a: np.ndarray) -> float:
    s = np.linalg.svd(a, compute_uv=False) ** 2
    return float(s[: max(1, min(a.shape) // 4)].sum() / max(s.sum(), 1e-300))


def codec_choice(data, shape: list[int]) -> Column:
    """deflate for empty tensors, coo where over 0.8 is zero, lowrank for matrices with a concentrated spectrum, else sq8."""
    d = _c(data)
    out = F.when(F.size(d) == 0, "deflate").when(D.sparsity(d) > 0.8, "coo")
    if len(shape) == 2 and shape[0] * shape[1] <= 65536:
        out = out.when(linalg.scalar_udf(_low_energy, d, shapes=[shape]) > 0.99, "lowrank")
    return out.otherwise("sq8")


def deflated(data, level: int = 6) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else zlib.compress(np.asarray(v, "<f8").tobytes(), level))

    return run(_c(data))


def inflated(code) -> Column:
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.frombuffer(zlib.decompress(v), "<f8").astype(float))

    return run(_c(code))


def float32_bytes(data) -> Column:
    """The elements as little-endian floats of four bytes."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return run(_c(data))


def from_float32_bytes(raw) -> Column:
    """The elements again; bytes that are no whole number of floats are null."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None or len(v) % 4 else np.frombuffer(v, "<f4").astype(float))

    return run(_c(raw))


# chunks


def chunk_rows(shape: list[int], item_bytes: int, chunk_mb: float) -> int:
    """Rows of the first dimension that fit in a chunk, at least one."""
    row = item_bytes
    for d in shape[1:]:
        row *= d
    return max(1, int(chunk_mb * 1024 * 1024 // row))


def chunk_settings(mb: float) -> tuple[int, int]:
    """Chunk MB and codec level for a tensor of this size."""
    return (200, 9) if mb > 1000 else (100, 6) if mb > 500 else (150, 4) if mb > 100 else (100, 3)


def chunked(tensors: DataFrame, key: str, size: int, data: str = "data") -> DataFrame:
    """The block table: key, chunk_index, chunk_count, start, data, checksum."""
    n = F.size(data)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / size) - 1, F.lit(0)).cast("int")), lambda i: F.struct(i.alias("chunk_index"), (i * size).alias("start"), F.slice(F.col(data), i * size + 1, F.lit(size)).alias("data")))
    out = tensors.select(key, F.greatest(F.ceil(n / size), F.lit(1)).cast("int").alias("chunk_count"), F.explode(parts).alias("c")).select(key, "chunk_count", "c.*")
    return out.withColumn("checksum", F.xxhash64("data"))


def rebuilt(chunks: DataFrame, key: str) -> DataFrame:
    """The tensors again; a chunk that is missing or whose checksum is wrong is an error."""
    good = F.assert_true(F.xxhash64("data") == F.col("checksum"), F.lit("a chunk has another checksum"))
    out = chunks.where(good.isNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "data"))).alias("parts"), F.max("chunk_count").alias("n"))
    whole = F.assert_true(F.size("parts") == F.col("n"), F.lit("a chunk is missing"))
    return out.where(whole.isNull()).select(key, F.flatten(F.transform("parts", lambda p: p["data"])).alias("data"))


def chunk_map(chunks: DataFrame, function) -> DataFrame:
    """f over each chunk's elements, chunk by chunk in Arrow batches."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(data=b["data"].map(lambda v: np.asarray(function(np.asarray(v, float)), float)))

    mapped = chunks.mapInPandas(run, fields)
    return mapped.withColumn("checksum", F.xxhash64("data"))


# stored sizes

#: Bytes of an element by type name.
ITEM_BYTES = {"float16": 2, "float32": 4, "float64": 8, "int8": 1, "int16": 2, "int32": 4, "int64": 8, "uint8": 1, "uint16": 2, "uint32": 4, "uint64": 8, "bool": 1}


def preset(name: str) -> tuple[str, str | None]:
    """Parquet codec and quantisation of a preset."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name}: one of {', '.join(PRESETS)}")
    return PRESETS[name]


def compressed(tensors: DataFrame, name: str = "int8_only", data: str = "data", dtype: str = "dtype") -> DataFrame:
    """Quantises, then compresses: adds code (int8 codes, or null), packed (deflated bytes where the preset compresses),
    algorithm, original_bytes, compressed_bytes and ratio. ``decompressed`` turns it back."""
    codec, quantised = preset(name)
    item = F.coalesce(F.create_map(*[F.lit(x) for kv in ITEM_BYTES.items() for x in kv])[F.col(dtype)], F.lit(8))
    out = tensors.withColumn("original_bytes", (F.size(data) * item).cast("long"))
    out = out.withColumn("code", F.when(F.size(data) > 0, int8(data)) if quantised == "int8" else F.lit(None).cast("struct<values:array<int>,scale:double,zero_point:bigint,constant:boolean>"))
    values = float16(data) if quantised == "float16" else F.col(data)
    small = {"int8": 1, "float16": 2}.get(quantised)
    raw = F.size(data) * (F.lit(small) if small else item) + (24 if quantised == "int8" else 0)
    packed = deflated(F.coalesce(F.transform("code.values", lambda x: x.cast("double")), values)) if codec != "none" else F.lit(None).cast("binary")
    out = out.withColumn("packed", packed)
    algorithm = "+".join(x for x in (quantised, None if codec == "none" else "deflate") if x) or "none"
    bytes_ = F.octet_length("packed") if codec != "none" else raw
    out = out.withColumn("algorithm", F.lit(algorithm)).withColumn("compressed_bytes", bytes_.cast("long"))
    out = out.withColumn(data, F.when(F.col("code").isNull() & F.lit(codec == "none"), values))
    return out.withColumn("ratio", F.coalesce(F.try_divide("original_bytes", "compressed_bytes"), F.lit(1.0)))


def decompressed(rows: DataFrame, data: str = "data") -> DataFrame:
    """The tensors of ``compressed`` rows again; int8 codes come back within half a step."""
    values = F.coalesce(inflated("packed"), F.transform("code.values", lambda x: x.cast("double")))
    coded = F.transform(values, lambda q: F.when(F.col("code.constant"), F.col("code.scale")).otherwise((q - F.col("code.zero_point")) * F.col("code.scale")))
    return rows.withColumn(data, F.when(F.col("code").isNotNull(), coded).otherwise(F.coalesce(F.col(data), values))).drop("code", "packed", "algorithm", "original_bytes", "compressed_bytes", "ratio")


def compression_stats(rows: DataFrame) -> DataFrame:
    """(total, compressed, original_bytes, compressed_bytes, algorithms, ratio) of stored rows (dtype, data, _code); ratio 1 where there is nothing."""
    item = F.coalesce(F.create_map(*[F.lit(x) for kv in ITEM_BYTES.items() for x in kv])[F.col("dtype")], F.lit(8))
    coded = F.col("_code").isNotNull()
    n = F.when(coded, F.size("_code.values")).otherwise(F.size("data"))
    sized = rows.select(coded.alias("coded"), (n * item).alias("before"), F.when(coded, n + 24).otherwise(n * item).alias("after"), F.when(coded, F.lit("int8")).otherwise(F.lit("none")).alias("algorithm"))
    out = sized.agg(
        F.count("*").alias("total"), F.count_if("coded").alias("compressed"), F.coalesce(F.sum("before"), F.lit(0)).cast("long").alias("original_bytes"),
        F.coalesce(F.sum("after"), F.lit(0)).cast("long").alias("compressed_bytes"), F.array_join(F.array_sort(F.collect_set("algorithm")), ",").alias("algorithms"),
    )
    return out.withColumn("ratio", F.coalesce(F.try_divide("original_bytes", "compressed_bytes"), F.lit(1.0)))
