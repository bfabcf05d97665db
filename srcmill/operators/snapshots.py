"""Comparing snapshots, reusing cached results, evicting cache entries."""

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from .running import running_total


def snapshot_diff(old, new, keys=("repository_id", "path"), version_changed=False):
    """added / updated / unchanged / deleted per path, by content hash.

    A changed rule or model version turns unchanged files into updated ones.
    """
    keys = list(keys)
    before = old.select(*keys, F.col("hash").alias("old_hash"), F.lit(True).alias("_was"))
    now = new.select(*keys, F.col("hash").alias("new_hash"), F.lit(True).alias("_is"))
    same = (F.col("old_hash") == F.col("new_hash")) & ~F.lit(version_changed)
    return before.join(now, keys, "full_outer").withColumn(
        "change",
        F.when(F.col("_was").isNull(), "added")
        .when(F.col("_is").isNull(), "deleted")
        .when(same, "unchanged")
        .otherwise("updated"),  # also where a stored row has no hash
    ).drop("_was", "_is")


def deleted_paths(old, new, keys=("repository_id", "path")):
    return old.select(*keys).join(new.select(*keys), list(keys), "left_anti")


def valid_vector(v):
    """A usable cached vector: not empty, every number finite."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def split_by_cache(requests, cache, key):
    """(distinct missing requests, usable cache rows).  Copies of a request are reduced before the anti join."""
    usable = cache.filter(valid_vector(F.col("embedding")))
    missing = requests.dropDuplicates([key]).join(usable.select(key), key, "left_anti")
    return missing, usable


def with_cached_vectors(requests, cache, key, compute):
    """Every request with its vector; `compute` only sees distinct texts that the cache lacks."""
    missing, usable = split_by_cache(requests, cache, key)
    fresh = compute(missing)
    vectors = usable.select(key, "embedding", F.lit(True).alias("reused")).unionByName(
        fresh.select(key, "embedding", F.lit(False).alias("reused"))
    )
    return requests.join(vectors, key)


def evict_cache(entries, now, ttl=V.CACHE_TTL_SECONDS, max_entries=V.CACHE_ENTRIES, max_bytes=V.CACHE_BYTES,
                max_entry=V.CACHE_ENTRY_BYTES, key="repository_id", width=4096):
    """Entries that survive: not expired, not oversized, and among the newest that fit both bounds.

    entries: (key, `mtime` integral and unique per key, `bytes`).  Oldest entries go first, so the running count
    and size from the newest entry downwards decide.
    """
    alive = entries.filter((F.col("mtime") + ttl >= now) & (F.col("bytes") <= max_entry)).withColumn(
        "_newest_first", F.lit(now).cast("long") - F.col("mtime")
    ).withColumn("_one", F.lit(1).cast("long"))
    counted = running_total(alive, key, "_newest_first", "_one", "kept_entries", width=width, limit=max_entries)
    sized = running_total(counted, key, "_newest_first", "bytes", "kept_bytes", width=width, limit=max_bytes)
    return sized.drop("_newest_first", "_one")


def stale_indexes(repositories, version):
    return repositories.filter(F.coalesce("index_version", F.lit("")) != version)


def without_repositories(table, changed):
    """Rows of repositories that did not change."""
    return table.join(changed.select("repository_id").distinct(), "repository_id", "left_anti")


def invalidate_runs(jobs, changed):
    """Completed scans of changed repositories become STALE and lose their coverage."""
    touched = changed.select("repository_id").distinct().withColumn("_touched", F.lit(True))
    stale = F.col("_touched") & (F.col("job_type") == "ANALYSIS") & (F.col("status") == "COMPLETED")
    stale = F.coalesce(stale, F.lit(False))
    out = jobs.join(touched, "repository_id", "left")
    if "coverage" in jobs.columns:
        out = out.withColumn("coverage", F.when(~stale, F.col("coverage")))
    return out.withColumn("status", F.when(stale, "STALE").otherwise(F.col("status"))).drop("_touched").select(*jobs.columns)
