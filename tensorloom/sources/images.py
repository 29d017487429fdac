"""Image files as tensors: decoded by Spark's image source, resized, and normalised channel by channel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Mean and deviation of red, green and blue that pictures are commonly normalised by.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with pixel centres aligned, of an array of rows, columns and channels."""
    image = image.astype(float)
    for axis, size in ((0, height), (1, width)):
        n = image.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, n - 1)
        share = (at - low).reshape([-1 if k == axis else 1 for k in range(3)])
        image = np.take(image, low, axis) * (1 - share) + np.take(image, high, axis) * share
    return image


def tensor_of(height: int, width: int, channels: int, data: bytes, size: int = 128, normal: bool = True) -> np.ndarray:
    """Channels first, red before green before blue; grey pictures get three equal channels and transparency goes."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    rgb = np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]
    out = resized(rgb, size, size) / 255
    if normal:
        out = (out - np.array(MEAN)) / np.array(DEVIATION)
    return out.transpose(2, 0, 1)


def read_images(spark: SparkSession, path: str, size: int = 128, normal: bool = True) -> DataFrame:
    """(path, shape, data, metadata) of the pictures in a folder; files that are no pictures are left out."""
    found = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    @F.pandas_udf("array<double>")
    def run(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([tensor_of(h, w, c, bytes(d), size, normal).ravel() for h, w, c, d in zip(height, width, channels, data)], dtype="object")

    about = F.to_json(F.struct(F.col("origin").alias("source"), "height", "width", F.col("nChannels").alias("channels")))
    return found.select(F.col("origin").alias("path"), F.array(*[F.lit(d).cast("bigint") for d in (3, size, size)]).alias("shape"), run("height", "width", "nChannels", "data").alias("data"), about.alias("metadata"))


#: Preprocessors by file extension: functions of (spark, path) that give (path, shape, data).
def preprocessors() -> dict:
    from tensorloom.sources.store import read_csv

    return {"csv": read_csv, "png": read_images, "jpg": read_images, "jpeg": read_images, "gif": read_images, "bmp": read_images}


def ingest(spark: SparkSession, folder: str, rules: dict | None = None) -> DataFrame:
    """(path, shape, data) of all files of a folder whose extension has a rule; other files are left alone."""
    out = None
    chosen: dict = {}
    for extension, rule in (rules or preprocessors()).items():
        chosen.setdefault(rule, []).append(extension)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName().rpartition(".")[2].lower() for s in fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs_path) if s.isFile()]
    for rule, extensions in chosen.items():
        present = [e for e in extensions if e in names]
        if present:
            part = rule(spark, f"{folder}/*.{{{','.join(present)}}}").select("path", "shape", "data")
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "path string, shape array<bigint>, data array<double>")
