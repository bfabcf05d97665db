"""A store of changes: a commit appends the rows of what it replaces, reading takes the newest commit of every key.

A store is a folder of segments, plain Parquet folders, and of manifests, one per version over all tables:

* A commit replaces keys, files for instance: all rows that a table holds under a replaced key are dead from then on,
  and the rows that the commit brings take their place, if any.  It writes a segment per table with those rows and a
  tombstone per replaced key, so it writes as much as has changed, however large the tables are.
* The manifest lists the live segments of all tables.  It is one file and is written last, so readers see all tables
  of a commit or none; what a failed attempt has left is in no manifest.  One writer at a time.
* Reading folds the segments of changes by key and takes the base rows of all other keys.  The base is not shuffled
  while the changed keys are few enough to be sent to all tasks; the manifest knows their number.
* `compact` merges the segments of changes, and folds them into the base once they are a large share of it, so that
  every row is rewritten a logarithmic number of times.  `vacuum` removes what no kept manifest names.

Rows without a key can't be replaced and are refused.  Empty commits are versions, too.
"""

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import read_folder

MANIFEST = "name string, segment string, is_base boolean, n_rows long"
EXTRA = "_key string, _gone boolean, _number long"
#: Changed keys up to this number go to all tasks (a key is a hash of 64 characters), more are joined by a shuffle.
SENT_KEYS = 500_000


def versions(spark, folder):
    """(version, number): the versions of a store and the last commit in each."""
    return _manifests(spark, folder).select("version", "number").distinct()


def _manifests(spark, folder):
    return read_folder(spark, f"{folder}/manifests", f"{MANIFEST}, number long, version long")


def manifest(spark, folder, version=None):
    """(version, number of the last commit, live segments) as of a version, by default the newest; 0, None, [] if none."""
    rows = _manifests(spark, folder)
    found = rows if version is None else rows.filter(F.col("version") <= version)
    newest = found.agg(F.max("version")).first()[0]
    if newest is None:
        return 0, None, []
    live = rows.filter(F.col("version") == newest).collect()  # a row per live segment
    return newest, live[0]["number"], [r for r in live if r["name"] is not None]


def _announce(spark, folder, version, number, segments):
    """Write the manifest; a version without segments has one row without a name."""
    rows = [(s["name"], s["segment"], s["is_base"], s["n_rows"], number) for s in segments] or [(None, None, None, None, number)]
    spark.createDataFrame(rows, f"{MANIFEST}, number long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifests/version={version}")


def _write(df, folder, name):
    segment = f"{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/segments/{segment}")
    return segment, df.sparkSession.read.schema(df.schema).parquet(f"{folder}/segments/{segment}").count()


def commit(spark, folder, number, replaced, tables, keys):
    """Replace all rows of the `replaced` keys (a table with the column `key`) by the rows of `tables`, in all tables.

    tables: {name: rows}; keys: {name: column of the key as text}.  Numbers rise; one that is not above the last is
    a repeated attempt of a finished commit and does nothing.  Returns the newest version.
    """
    version, last, live = manifest(spark, folder)
    if last is not None and number <= last:
        return version
    segments = list(live)
    gone = replaced.select(F.col("key").cast("string").alias("_key")).distinct()
    for name, rows in tables.items():
        key = F.coalesce(keys[name].cast("string"), F.raise_error(F.lit(f"{name}: a row without a key")).cast("string"))
        fresh = rows.withColumns({"_key": key, "_gone": F.lit(False), "_number": F.lit(number).cast("long")})
        tombs = gone.withColumns({"_gone": F.lit(True), "_number": F.lit(number).cast("long")})
        segment, n = _write(fresh.unionByName(tombs, allowMissingColumns=True), folder, name)
        if n:
            segments.append(dict(name=name, segment=segment, is_base=False, n_rows=n))
    _announce(spark, folder, version + 1, number, segments)
    return version + 1


def _rows(spark, folder, segments, schema):
    full = StructType(schema.fields + StructType.fromDDL(EXTRA).fields)
    if not segments:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(*[f"{folder}/segments/{s['segment']}" for s in segments])


def _newest(rows):
    """Of every key the rows of its newest commit, tombstones included."""
    latest = F.max("_number").over(W.partitionBy("_key"))
    return rows.withColumn("_latest", latest).filter("_number = _latest").drop("_latest")


def _live(spark, folder, segments, schema):
    changes, base = ([s for s in segments if s["is_base"] == kind] for kind in (False, True))
    if not changes:
        return _rows(spark, folder, base, schema)
    changed = _rows(spark, folder, changes, schema)
    current = _newest(changed).filter("not _gone")
    if not base:
        return current
    keys = changed.select("_key").distinct()
    if sum(s["n_rows"] for s in changes) <= SENT_KEYS:
        keys = F.broadcast(keys)
    return _rows(spark, folder, base, schema).join(keys, "_key", "left_anti").unionByName(current)


def read(spark, folder, name, schema, version=None):
    """The rows of a table as of a version, by default the newest.  A table that has never been written is empty."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    segments = [s for s in manifest(spark, folder, version)[2] if s["name"] == name]
    return _live(spark, folder, segments, schema).select(*[f"`{f}`" for f in schema.names])


def compact(spark, folder, schemas, max_segments=8, share=0.25):
    """Fold the changes of each table of `schemas` into its base where they are at least `share` of its rows.

    Smaller changes stay apart; more than `max_segments` segments of them become one, without dead rows.  Rows in force
    don't change.  Returns the newest version.
    """
    version, number, live = manifest(spark, folder)
    segments, folded = [], False
    for name in dict.fromkeys(s["name"] for s in live):
        own = [s for s in live if s["name"] == name]
        schema = schemas.get(name)
        changes = [s for s in own if not s["is_base"]]
        n_base, n_changes = (sum(s["n_rows"] for s in own if s["is_base"] == kind) for kind in (True, False))
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if schema is None or not changes:
            segments += own
        elif n_changes >= share * n_base:
            segment, n = _write(_live(spark, folder, own, schema), folder, name)
            segments += [dict(name=name, segment=segment, is_base=True, n_rows=n)] if n else []
            folded = True
        elif len(changes) > max_segments:
            segment, n = _write(_newest(_rows(spark, folder, changes, schema)), folder, name)
            segments += [s for s in own if s["is_base"]] + [dict(name=name, segment=segment, is_base=False, n_rows=n)]
            folded = True
        else:
            segments += own
    if not folded:
        return version
    _announce(spark, folder, version + 1, number, segments)
    return version + 1


def vacuum(spark, folder, keep=1):
    """Remove all but the newest `keep` versions and every segment that none of them names; readers of older ones fail.

    Returns the number of removed folders.  Not while a commit runs: its segments are in no manifest yet.
    """
    rows = _manifests(spark, folder)
    kept = [r["version"] for r in rows.select("version").distinct().orderBy(F.desc("version")).limit(keep).collect()]
    named = {r["segment"] for r in rows.filter(F.col("version").isin(kept)).select("segment").distinct().collect()}
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    removed = 0
    for part, stays in (("manifests", {f"version={v}" for v in kept}), ("segments", named)):
        top = path(f"{folder}/{part}")
        for entry in files.listStatus(top) if files.exists(top) else []:
            if entry.getPath().getName() not in stays:
                removed += files.delete(entry.getPath(), True)
    return removed
