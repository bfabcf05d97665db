"""Incremental refresh: only added and updated files are parsed again."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import inventory as N
from ..operators import snapshots as D
from ..session import cut_lineage
from ..sources import changes, store
from ..sources import tree as T
from .index import PIPELINE_VERSION, index_tree


def latest_files(tree, order=None):
    """One row per repository and path: the last by `order`, a column of the tree; ties go to the larger hash."""
    return _last(tree.withColumn("_hash", F.sha2("content", 256)), order).drop("_hash")


def _last(hashed, order):
    """The last row of each path.  Rows are shuffled once, by repository and path, and stay there for later joins by both."""
    newest_first = W.partitionBy("repository_id", "path").orderBy(*([F.desc(order)] if order else []), F.desc("_hash"))
    placed = hashed.filter("repository_id is not null and path is not null").withColumn("_later", F.lag(F.lit(True)).over(newest_first))
    return placed.filter("_later is null and _hash is not null").drop("_later")


def latest_hashes(tree, order=None):
    """(repository_id, path, hash, kept: worth indexing) of the latest files; contents are read, but not shuffled."""
    narrow = tree.select(
        "repository_id", "path", *([F.col(order).alias("_order")] if order else []), F.sha2("content", 256).alias("_hash"), T.worth_indexing().alias("kept")
    )
    return _last(narrow, "_order" if order else None).select("repository_id", "path", F.col("_hash").alias("hash"), "kept")


def refresh_index(tables, tree, version_changed=False, partial=False, order=None, **index_options):
    """New tables and the change counts.  With `partial`, paths that `tree` lacks are kept instead of deleted.

    A path that occurs in several rows counts once (see `latest_files`).  The result may be written to the store that
    `tables` are read from: `index.write_index` makes a new version of it.

    tables: the stored `files`, `symbols`, `code_chunks`, `vectors`, and optionally `analysis_issues` and
    `repository_jobs`, of the repositories that occur in `tree`.
    """
    diff = D.snapshot_diff(tables["files"], latest_hashes(tree, order).filter("kept"), version_changed=version_changed)
    if partial:
        diff = diff.filter("change <> 'deleted'")
    diff = cut_lineage(diff)
    changed = diff.filter("change <> 'unchanged'")
    again = diff.filter("change in ('added', 'updated')").select("repository_id", "path")
    fresh = index_tree(latest_files(tree, order).join(again, ["repository_id", "path"], "left_semi"), dependents="none", **index_options)
    # file ids derive from repository and path, so they name the rows to replace in every table
    replaced = changed.select(T.file_id().alias("file_id"), "repository_id")
    gone_chunks = tables["code_chunks"].join(replaced.select("file_id"), "file_id", "left_semi").select("id")
    out = dict(
        files=_swap(tables["files"], replaced.withColumnRenamed("file_id", "id"), "id", fresh["files"]),
        symbols=_swap(tables["symbols"], replaced, "file_id", fresh["symbols"]),
        code_chunks=_swap(tables["code_chunks"], replaced, "file_id", fresh["code_chunks"]),
        vectors=_swap(tables["vectors"], gone_chunks, "id", fresh["vectors"]),
    )
    if "analysis_issues" in tables:
        out["analysis_issues"] = D.without_repositories(tables["analysis_issues"], changed)
    if "repository_jobs" in tables:
        out["repository_jobs"] = D.invalidate_runs(tables["repository_jobs"], changed)
    out["totals"] = N.repository_totals(out["files"], out["code_chunks"]).join(
        N.language_maps(N.language_histogram(out["files"])), "repository_id", "left"
    ).withColumn("index_version", F.lit(PIPELINE_VERSION))
    out["changes"] = _change_counts(diff)
    return out


def file_keys():
    """The key under which a file's rows are replaced, per table: the id of the file."""
    file_id = F.col("file_id")
    return {"files": F.col("id"), "symbols": file_id, "code_chunks": file_id, "vectors": T.file_id(path="file_path")}


def changed_rows(files, tree, gone=None, version_changed=False, order=None, **index_options):
    """What arriving files change, for `commit_changes`: rows of changed files alone, and the counts per repository.

    files: (repository_id, path, hash) as stored; tree: files that arrive; gone: (repository_id, path) that vanish, in
    favour of which an arrival of the same path is ignored.  Paths that neither names stay as they are.
    """
    keys = ["repository_id", "path"]
    if gone is None:
        gone = tree.select(*keys).limit(0)
    gone = gone.select(*keys)
    latest = latest_hashes(tree, order)
    named = latest.select(*keys).unionByName(gone).distinct()
    before = files.select(*keys, "hash").join(named, keys, "left_semi")
    now = latest.filter("kept").join(gone, keys, "left_anti")
    diff = cut_lineage(D.snapshot_diff(before, now, version_changed=version_changed))
    again = diff.filter("change in ('added', 'updated')").select(*keys)
    return dict(
        replaced=diff.filter("change in ('updated', 'deleted')").select(T.file_id().alias("key")),
        tables=index_tree(latest_files(tree, order).join(again, keys, "left_semi"), dependents="none", **index_options),
        counts=_change_counts(diff),
    )


def commit_changes(spark, folder, number, changed):
    """Append changed rows to a store of changes (see `sources.changes`); numbers rise from commit to commit."""
    tables = {name: _typed(changed["tables"][name], like) for name, like in store.INDEX_TABLES.items()}
    return changes.commit(spark, folder, number, changed["replaced"], tables, file_keys())


def _typed(rows, like):
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(like)])


def _change_counts(diff):
    return diff.groupBy("repository_id").agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("unchanged", "updated", "added", "deleted")]
    )


def _swap(stored, replaced, key, fresh):
    """Stored rows without the replaced ones, and the fresh ones; ids compress well on disk, so they are never sent to all tasks."""
    return stored.join(replaced.select(key).hint("merge"), key, "left_anti").select(*fresh.columns).unionByName(fresh)
