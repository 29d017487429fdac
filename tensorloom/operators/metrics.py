"""Counts and gauges over the engine's tables: catalog, dashboard, tenants, tiers, chunks; folds over chunks; text forms."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.operators import prefix


def kind_counts(**kinds: DataFrame) -> DataFrame:
    """(kind, n) of each kind of metadata, 0 for empty ones."""
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, rows in kinds.items()]
    return reduce(lambda a, b: a.union(b), counts)


def dashboard(datasets: DataFrame, agents: DataFrame, now: Column, created: str = "created_at", seconds: int = 60) -> DataFrame:
    """One row: datasets and records of (dataset, created_at) rows, agents by status, and rows a second in the last seconds."""
    recent = (F.col(created) > now - F.make_dt_interval(secs=F.lit(seconds))) & (F.col(created) <= now)
    rows = datasets.agg(F.count_distinct("dataset").alias("datasets"), F.count("*").alias("records"), (F.count_if(recent) / seconds).alias("ingest_rate"))
    status = agents.agg(F.count("*").alias("agents"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "error").alias("failing"))
    return rows.join(status)  # two single rows


def best_trial(trials: DataFrame, kind: str = "classification", score: str = "score") -> DataFrame:
    """The best score of a search: the greatest for classification, the least for regression."""
    return trials.agg((F.max(score) if kind == "classification" else F.min(score)).alias("best"))


def tenant_usage(records: DataFrame, separator: str = ".") -> DataFrame:
    """(tenant, datasets, tensors) of records whose dataset is named tenant.dataset; names without a tenant count as default."""
    at = F.instr("dataset", F.lit(separator))
    tenant = F.when(at > 1, F.substring("dataset", F.lit(1), at - 1)).otherwise(F.lit("default"))
    return records.groupBy(tenant.alias("tenant")).agg(F.count_distinct("dataset").alias("datasets"), F.count("*").alias("tensors"))


def service_counts(records: DataFrame, deleted: DataFrame | None = None, key: str = "tensor_id") -> DataFrame:
    """(dataset, tensors): live tensors of each dataset."""
    live = records if deleted is None else records.join(deleted.select(key), key, "left_anti")
    return live.groupBy("dataset").agg(F.count("*").alias("tensors"))


def tier_stats(accesses: DataFrame, sizes: DataFrame, hot_bytes: int, key: str = "tensor_id", order: str = "seq") -> DataFrame:
    """(accesses, hits, hit_rate, hot_count, hot_bytes) of a log of reads against a hot tier of so many bytes.

    The hot tier holds the most recently read tensors whose sizes add up to the budget. A read is a hit if the
    bytes of the distinct tensors read since the tensor's last read, its own included, fit in the budget; that is
    bounded from above by the bytes of all reads between, which a window sums, so hits are counted conservatively.
    """
    sized = prefix.running(accesses.join(sizes, key), [order], F.col("bytes"), "_sum")
    last = F.lag("_sum").over(Window.partitionBy(key).orderBy(order))
    judged = sized.withColumn("hit", F.coalesce(F.col("_sum") - last <= hot_bytes, F.lit(False)))
    newest = judged.groupBy(key).agg(F.max(order).alias("_at"), F.max("bytes").alias("bytes"))
    kept = prefix.running(newest, [F.desc("_at")], F.col("bytes"), "_upto").where(F.col("_upto") <= hot_bytes)
    hot = kept.agg(F.count("*").alias("hot_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("hot_bytes"))
    return judged.agg(F.count("*").alias("accesses"), F.count_if("hit").alias("hits"), F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit_rate")).join(hot)


def chunk_stats(chunks: DataFrame, top: int = 10) -> DataFrame:
    """(tensors, chunks, bytes, mean_ratio) of chunk rows (tensor_id, bytes, ratio); the ratio of nothing is 1."""
    return chunks.agg(F.count_distinct("tensor_id").alias("tensors"), F.count("*").alias("chunks"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.avg("ratio"), F.lit(1.0)).alias("mean_ratio"))


def most_accessed(accesses: DataFrame, key: str, k: int = 10) -> DataFrame:
    return accesses.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def chunk_fold(chunks: DataFrame, key: str, start: float, step: Callable[[Column, Column], Column], order: str = "chunk_index", data: str = "data") -> DataFrame:
    """(key, value): a left fold over each tensor's elements, chunk by chunk in order; a tensor's chunks meet in one row."""
    part = F.struct(F.col(order).alias("o"), F.col(data).alias("d"))
    rows = chunks.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    inner = lambda acc, x: step(acc, x.cast("double"))
    return rows.select(key, F.aggregate(F.flatten(F.transform("parts", lambda p: p["d"])), F.lit(start).cast("double"), inner).alias("value"))


def chunk_reduce(chunks: DataFrame, key: str, within: Callable[[Column], Column], across: Callable[[str], Column], data: str = "data") -> DataFrame:
    """(key, value) of an associative reduction: a value for each chunk, combined map-side; no task sees a whole tensor."""
    return chunks.select(key, within(F.col(data)).alias("_v")).groupBy(key).agg(across("_v").alias("value"))


def histogram_lines(histogram: DataFrame, name: str) -> DataFrame:
    """(line): a latency histogram (bound, n, total, count) in the text exposition format, cumulative buckets first."""
    number = lambda c: F.regexp_replace(F.col(c).cast("decimal(20,3)").cast("string"), r"\.?0+$", "")
    buckets = histogram.select(F.col("bound").alias("_o"), F.concat(F.lit(f'{name}_bucket{{le="'), number("bound"), F.lit('"} '), F.col("n").cast("string")).alias("line"))
    one = histogram.agg(F.max("total").alias("total"), F.max("count").alias("count"))
    last = one.select(F.explode(F.array(
        F.struct(F.lit(1e300).alias("_o"), F.concat(F.lit(f'{name}_bucket{{le="+Inf"}} '), F.col("count").cast("string")).alias("line")),
        F.struct(F.lit(1e301).alias("_o"), F.concat(F.lit(f"{name}_sum "), F.format_string("%.3f", "total")).alias("line")),
        F.struct(F.lit(1e302).alias("_o"), F.concat(F.lit(f"{name}_count "), F.col("count").cast("string")).alias("line")),
    )).alias("l")).select("l.*")
    return buckets.union(last).select("line")


def memory(spark: SparkSession) -> DataFrame:
    """(what, bytes) of the driver's heap and of the executors' storage memory."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    rows = [("driver heap used", runtime.totalMemory() - runtime.freeMemory()), ("driver heap most", runtime.maxMemory()), ("executors", status.size())]
    return spark.createDataFrame([(k, int(v)) for k, v in rows], "what string, bytes long")
