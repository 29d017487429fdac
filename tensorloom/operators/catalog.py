"""The metadata catalog: descriptors, six kinds of metadata, search, group-by, analytics, import and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def path(column: str, dotted: str) -> Column:
    """The value at a dotted path of a JSON string, null where any part is missing."""
    return F.get_json_object(F.col(column), "$." + dotted)


def contains_any(text: str, strings: list[str] = (), lists: list[str] = (), maps: list[str] = ()) -> Column:
    """Case-insensitive substring in any of the columns: any element of a list, any value of a map."""
    q = F.lit(text.lower())
    out = F.lit(False)
    for c in strings:
        out |= F.coalesce(F.contains(F.lower(F.col(c)), q), F.lit(False))
    for values in [*[F.col(c) for c in lists], *[F.map_values(F.col(c)) for c in maps]]:
        out |= F.coalesce(F.exists(values, lambda x: F.coalesce(F.contains(F.lower(x.cast("string")), q), F.lit(False))), F.lit(False))
    return out


def has_tags(tags: str, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]), F.coalesce(F.col(tags), F.array().cast("array<string>")))) == 0


def filtered(descriptors: DataFrame, lineage: DataFrame | None = None, owner=None, data_type=None, tags=None, source_type=None, version=None, key: str = "tensor_id") -> DataFrame:
    out = descriptors
    for column, value in (("owner", owner), ("data_type", data_type)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if tags:
        out = out.where(has_tags("tags", tags))
    if lineage is not None and (source_type is not None or version is not None):
        wanted = lineage
        for column, value in (("source_type", source_type), ("version", version)):
            if value is not None:
                wanted = wanted.where(F.col(column) == value)
        out = out.join(wanted.select(key), key, "left_semi")
    return out


def grouped(rows: DataFrame, by, function: str, field=None) -> DataFrame:
    """(key, value): a null key is N/A, what isn't a number is ignored, sum and avg over nothing are 0, min and max null."""
    key = F.coalesce((F.col(by) if isinstance(by, str) else by).cast("string"), F.lit("N/A")).alias("key")
    if function != "count" and field is None:
        raise ValueError(f"{function} needs a field")
    x = None if field is None else (F.col(field) if isinstance(field, str) else field).cast("string").try_cast("double")
    zero = F.lit(0.0)
    value = {"count": lambda: F.count("*").cast("double"), "sum": lambda: F.coalesce(F.sum(x), zero), "avg": lambda: F.coalesce(F.avg(x), zero), "min": lambda: F.min(x), "max": lambda: F.max(x)}[function]()
    return rows.groupBy(key).agg(value.alias("value"))


def co_occurring(rows: DataFrame, tags: str, least: int = 2, limit: int = 10) -> DataFrame:
    """(tag, partner, n, rank): pairs of a row's distinct tags, both ways, the most frequent partners of each tag.

    Pairs are made within a row's tag set and counted map-side; a tag list is metadata of one tensor.
    """
    own = F.array_sort(F.array_distinct(tags))
    pairs = F.flatten(F.transform(own, lambda a: F.transform(F.filter(own, lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    counted = rows.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    both = counted.select(F.col("a").alias("tag"), F.col("b").alias("partner"), "n").union(counted.select("b", "a", "n"))
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("n"), "partner"))
    return both.withColumn("rank", rank.cast("int")).where(F.col("rank") <= limit)


def stale(descriptors: DataFrame, now: Column, days: int, limit: int, modified: str, accessed: str, key: str) -> DataFrame:
    """Last touched (the later of modified and accessed) more than ``days`` before now, the oldest first."""
    touched = F.greatest(F.col(modified), F.col(accessed))  # greatest skips nulls
    return descriptors.withColumn("touched", touched).where(touched < now - F.make_dt_interval(F.lit(days))).orderBy("touched", key).limit(limit)


def complex_tensors(rows: DataFrame, parents: str, steps: str, key: str, least_parents: int | None = None, least_steps: int | None = None, limit: int = 100) -> DataFrame:
    if least_parents is None and least_steps is None:
        raise ValueError("at least one bound is needed")
    tests = [F.coalesce(F.col(c) >= v, F.lit(False)) for c, v in ((parents, least_parents), (steps, least_steps)) if v is not None]
    test = tests[0] if len(tests) == 1 else tests[0] | tests[1]
    return rows.where(test).orderBy(key).limit(limit)


def derived_usage(usage: DataFrame, history: str = "access_history") -> DataFrame:
    """Frequency and last access from the history."""
    return usage.withColumn("usage_frequency", F.coalesce(F.size(history), F.lit(0))).withColumn("last_accessed_at", F.array_max(F.transform(history, lambda h: h["accessed_at"])))


def one_of_each(rows: DataFrame, key: str) -> DataFrame:
    """A row of each key: of several the one that comes last as JSON, so that the result doesn't depend on their order."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.to_json(F.struct(*[F.col(c) for c in rows.columns])))))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n")


def upserted(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row per key, the new ones in place of the stored: copy on write."""
    new = one_of_each(new, key)
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def attached(stored: DataFrame, new: DataFrame, tensors: DataFrame, key: str = "tensor_id", name: str | None = None) -> DataFrame:
    """Upserts a kind of metadata, one row for each tensor, or for each tensor and name; unknown tensors are an error."""
    keys = [key] if name is None else [key, name]
    known = new.join(tensors.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    right = known.where(F.assert_true(F.col("_known").isNotNull(), F.concat(F.lit("no tensor "), F.col(key).cast("string"))).isNull()).drop("_known")
    if name is None:
        return upserted(stored, right, key)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.to_json(F.struct(*[F.col(c) for c in new.columns])))))
    right = right.select(new.columns).withColumn("_n", last).where("_n = 1").drop("_n")
    return stored.join(right.select(keys), keys, "left_anti").unionByName(right)


def cascaded(tensors: DataFrame, gone: DataFrame, key: str = "tensor_id", **kinds: DataFrame) -> dict[str, DataFrame]:
    """The tensors and each kind of metadata without those that are gone."""
    return {name: rows.join(gone.select(key), key, "left_anti") for name, rows in ({"tensors": tensors} | kinds).items()}


def versions_of(edges: DataFrame, tensor) -> DataFrame:
    """(node) of a tensor and its direct versions."""
    direct = edges.where((F.col("parent") == tensor) & (F.col("relation") == "new_version_of")).select(F.col("child").alias("node"))
    return edges.sparkSession.range(1).select(F.lit(tensor).alias("node")).union(direct).distinct()


def exported(descriptors: DataFrame, key: str = "tensor_id", **kinds: DataFrame) -> DataFrame:
    """One row per descriptor with each kind of metadata as a list of structs."""
    out = descriptors
    for name, rows in kinds.items():
        rest = [c for c in rows.columns if c != key]
        out = out.join(rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name)), key, "left")
        empty = F.array().cast(out.schema[name].dataType)
        out = out.withColumn(name, F.coalesce(name, empty))
    return out


def imported(stored: DataFrame, new: DataFrame, key: str = "tensor_id", conflict: str = "skip") -> tuple[DataFrame, DataFrame]:
    """The merged rows, and how many were imported, skipped or overwritten."""
    if conflict not in ("skip", "overwrite"):
        raise ValueError(f"unknown strategy {conflict}")
    known = stored.select(key).distinct().withColumn("_known", F.lit(True))
    new = one_of_each(new, key)
    action = F.when(F.col("_known").isNull(), "imported").otherwise("skipped" if conflict == "skip" else "overwritten")
    marked = new.join(known, key, "left").withColumn("action", action).drop("_known")
    merged = upserted(stored, new, key) if conflict == "overwrite" else stored.unionByName(marked.where("action = 'imported'").drop("action"))
    return merged, marked.groupBy("action").agg(F.count("*").alias("n"))


def new_versions(descriptors: DataFrame, versions: DataFrame, key: str = "tensor_id", **overrides) -> tuple[DataFrame, DataFrame]:
    """Copies of parents under new ids (versions: key, new id, version), with overrides, and their edges to the parents."""
    copies = versions.join(descriptors, key).withColumns({k: F.lit(v) for k, v in overrides.items()})
    edges = copies.select(F.col("new_id").alias("child"), F.col(key).alias("parent"), F.lit("new_version_of").alias("relation"), "version")
    return copies.drop(key, "version").withColumnRenamed("new_id", key), edges
