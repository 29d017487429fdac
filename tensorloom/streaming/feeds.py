"""Streams: ingest of a folder, a change feed and its replica, delta and compaction, windows and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom import model

#: Bounds of the latency histogram in milliseconds.
BOUNDS = (0.5, 1, 2.5, 5, 10, 25, 50, 100, 250, 500, 1000)


def watch_folder(spark: SparkSession, folder: str, schema: str, kind: str = "csv", **options):
    """A stream of a folder's files, each read once (the checkpoint of the query remembers them)."""
    return spark.readStream.format(kind).schema(schema).options(**options).load(folder)


def validated(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose columns are all there, and the others for quarantine."""
    test = F.lit(True)
    for c in columns:
        test &= F.col(c).isNotNull()
    return rows.where(test), rows.where(~test)


def changes_since(changes: DataFrame, since: int, limit: int) -> DataFrame:
    return changes.where(F.col("seq") > since).orderBy("seq").limit(limit)


def head(changes: DataFrame) -> DataFrame:
    return changes.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head"))


def latest(changes: DataFrame, key: str = "tensor_id") -> DataFrame:
    """The last change of each key; max_by is combined map-side."""
    rest = [c for c in changes.columns if c not in (key, "seq")]
    return changes.groupBy(key).agg(F.max_by(F.struct("seq", *rest), "seq").alias("c")).select(key, "c.*")


def applied(rows: DataFrame, changes: DataFrame, key: str = "tensor_id") -> DataFrame:
    """Rows after the changes (op put or delete): idempotent, whatever order the changes come in."""
    last = latest(changes, key)
    kept = rows.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("op = 'put'").select(rows.columns))


def replicate(changes, path: str, checkpoint: str, key: str = "tensor_id"):
    """A started query that merges a stream of changes into versions of a table under ``path``; replays change nothing."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        target = f"{path}/v{epoch}"
        last = latest(batch, key)
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        before = f"{path}/v{epoch - 1}"
        if epoch and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(before)):
            old = spark.read.parquet(before)
            newer = old.join(last.select(key, F.col("seq").alias("_seq")), key, "left").where("_seq IS NULL OR _seq <= seq").drop("_seq")
            last = newer.unionByName(last.join(newer.select(key), key, "left_anti").select(old.columns))
        last.write.mode("overwrite").parquet(target)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replica(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v{epoch}").where("op = 'put'")


def merged(base: DataFrame, delta: DataFrame, deleted: DataFrame, key: str = "vec_id") -> DataFrame:
    """Base and delta without tombstones, the delta's row of a key in both."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta).join(deleted.select(key), key, "left_anti")


def needs_compaction(delta_rows: int, capacity: int = 10_000, share: float = 0.8) -> bool:
    return delta_rows >= share * capacity


def compacted(base: DataFrame, delta: DataFrame, deleted: DataFrame, capacity: int = 10_000, share: float = 0.8, key: str = "vec_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, delta, deleted) after a merge, if the delta is full enough for one; else as they are."""
    if not needs_compaction(delta.count(), capacity, share):
        return base, delta, deleted
    return merged(base, delta, deleted, key), delta.limit(0), deleted.limit(0)


def latency_histogram(rows: DataFrame, column: str) -> DataFrame:
    """Cumulative counts per bound, with sum and count, in one pass."""
    x = F.col(column)
    sums = rows.agg(*[F.count_if(x <= b).alias(f"le_{i}") for i, b in enumerate(BOUNDS)], F.sum(x).alias("total"), F.count(x).alias("count"))
    bounds = F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.col(f"le_{i}").alias("n")) for i, b in enumerate(BOUNDS)])
    return sums.select(F.explode(bounds).alias("b"), "total", "count").select("b.bound", "b.n", "total", "count")


def profiler(log: DataFrame, last: int = 1024) -> DataFrame:
    """Counts and mean latency of the last queries of each field; log: (seq, field, latency_ms)."""
    return log.orderBy(F.desc("seq")).limit(last).groupBy("field").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean_ms"))


# extensions over events with event time


def tumbling(events, length: str = "1 hour", late: str = "10 minutes"):
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events, gap: str = "30 minutes", late: str = "1 hour"):
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def sampled(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(max(0, n))


def numbered_log(rows: DataFrame, order: list[str], key: str) -> DataFrame:
    """The n-th change of each key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


EMPTY_CHANGES = model.CHANGES
