"""Tenants: names, slugs, keys, quotas, and a token bucket over a stream of requests."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = {"viewer": 0, "editor": 1, "admin": 2}


class QuotaError(ValueError):
    pass


def scoped(tenant, dataset) -> Column:
    """The name of a tenant's dataset in the store."""
    t, d = (F.col(x) if isinstance(x, str) else x for x in (tenant, dataset))
    return F.concat_ws(".", t, d)


def valid_slug(text) -> Column:
    """1 to 63 lower-case letters, digits and hyphens, of which the first is a letter or digit; null isn't valid."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(t.rlike("^[a-z0-9][a-z0-9-]{0,62}\\z"), F.lit(False))


def hashed_key(key: str) -> str:
    return hashlib.sha256(key.encode()).hexdigest()


def resolved(requests: DataFrame, principals: DataFrame, key: str = "api_key") -> DataFrame:
    """Requests with the tenant and role of their key, of which only the digest is stored: (key_hash, tenant, role). Others go."""
    return requests.withColumn("key_hash", F.sha2(F.col(key), 256)).join(F.broadcast(principals), "key_hash").drop("key_hash", key)


def may(role, wanted: str) -> Column:
    """Whether a role includes the wanted one."""
    level = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    r = F.col(role) if isinstance(role, str) else role
    return F.coalesce(F.try_element_at(level, r) >= ROLES[wanted], F.lit(False))


def within_quota(usage: DataFrame, quotas: DataFrame, requested: DataFrame) -> DataFrame:
    """(tenant, datasets, tensors, allowed) of requested additions to usage; a quota of 0 or none has no limit."""
    both = requested.select("tenant", F.col("datasets").alias("_d"), F.col("tensors").alias("_t")).join(usage, "tenant", "left").join(quotas, "tenant", "left")
    datasets, tensors = (F.coalesce(F.col(c), F.lit(0)) + F.col(n) for c, n in (("datasets", "_d"), ("tensors", "_t")))
    fits = lambda most, n: (F.coalesce(F.col(most), F.lit(0)) == 0) | (n <= F.col(most))
    return both.select("tenant", datasets.alias("datasets"), tensors.alias("tensors"), (fits("most_datasets", datasets) & fits("most_tensors", tensors)).alias("allowed"))


def token_bucket(requests: DataFrame, capacity: float, per_second: float, key: str = "tenant", at: str = "ts", tie: str = "request_id") -> DataFrame:
    """Adds ``allowed`` to requests: a bucket for each key that holds ``capacity`` tokens and refills evenly; each request takes one.

    A key's requests are folded in order by one task, in batches that keep only the bucket's level.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields) + ", allowed boolean"

    def run(batches):
        level: float = capacity
        last = who = None
        for batch in batches:
            allowed = []
            for k, t in zip(batch[key], batch["_seconds"]):
                if k != who:
                    who, level, last = k, capacity, t
                level = min(capacity, level + (t - last) * per_second)
                last = t
                allowed.append(level >= 1)
                level -= allowed[-1]
            yield batch.drop(columns="_seconds").assign(allowed=pd.Series(allowed, dtype=bool, index=batch.index))

    timed = requests.withColumn("_seconds", F.unix_micros(F.col(at).cast("timestamp")) / 1e6)
    return timed.repartition(key).sortWithinPartitions(key, at, tie).mapInPandas(run, schema)
