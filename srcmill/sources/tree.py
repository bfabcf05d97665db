"""File snapshots: walk, filter, decode and hash, all on the executors."""

import os
import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import fixed_values as V
from ..functions import paths as P
from ..functions import text as X
from ..session import work_path

FILE_COLUMNS = ["repository_id", "path", "content", "size"]


#: Bytes of files that a task reads, and that it holds at a time.
TASK_BYTES, BATCH_BYTES = 64 << 20, 8 << 20


def open_place(place):
    """File system and path of a place; without a scheme it is local."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", place))


class SourceFiles(DataSource):
    """Spark data source `source_files`: the files below <root>/<repository_id>/, listed on the executors.

    A partition is a repository.  Pruned folders are one row each and never entered; links are left out; nothing is
    read.  Files that lie in the root itself have an empty repository_id.
    """

    @classmethod
    def name(cls):
        return "source_files"

    def schema(self):
        return "repository_id string, path string, size bigint, pruned boolean"

    def reader(self, schema):
        return SourceFilesReader(self.options["path"], set(V.PRUNED_FOLDERS))


class SourceFilesReader(DataSourceReader):
    def __init__(self, root, pruned):
        self.root, self.pruned = root.rstrip("/"), pruned

    def partitions(self):
        store, top = open_place(self.root)
        folders = [e.base_name for e in store.get_file_info(fs.FileSelector(top)) if e.type == fs.FileType.Directory]
        return [InputPartition("")] + [InputPartition(name) for name in sorted(folders)]

    def read(self, partition):
        store, top = open_place(self.root)
        local = isinstance(store, fs.LocalFileSystem)
        todo = [f"{top}/{partition.value}" if partition.value else top]
        start = len(todo[0]) + 1
        while todo:
            for entry in store.get_file_info(fs.FileSelector(todo.pop())):
                if local and os.path.islink(entry.path):
                    continue
                below = entry.path[start:]
                if entry.type == fs.FileType.File:
                    yield partition.value, below, entry.size, False
                elif not partition.value:
                    continue  # the folders of the root are partitions of their own
                elif entry.base_name in self.pruned:
                    yield partition.value, below + "/", None, True
                else:
                    todo.append(entry.path)


def list_source_tree(spark, root):
    """(repository_id, path, size, reason) of a tree, by names and sizes alone; a reason says why a file is left out."""
    spark.dataSource.register(SourceFiles)
    path = F.col("path")
    reason = (
        F.when(F.col("pruned"), "pruned folder").when(~P.should_process(path), "unsupported type")
        .when(F.col("size") > P.size_limit(path), "too large")
    )
    return spark.read.format("source_files").load(root).filter("repository_id <> ''").select("repository_id", "path", "size", reason.alias("reason"))


def with_content(files, root, task_bytes=TASK_BYTES):
    """Append the bytes of (repository_id, path, size); a file that can't be read has none.

    Files are dealt anew, a task for about `task_bytes`, so one large repository is many tasks.
    """
    spark = files.sparkSession
    total = files.agg(F.sum("size")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // task_bytes))
    narrow = files.select("repository_id", "path", "size")

    def read(batches):
        store, top = open_place(root.rstrip("/"))
        for batch in batches:
            at, size, contents = 0, 0, []
            for i, row in enumerate(batch.to_pylist()):
                try:
                    with store.open_input_stream(f"{top}/{row['repository_id']}/{row['path']}") as f:
                        contents.append(f.read())
                except OSError:
                    contents.append(None)
                size += len(contents[-1] or b"")
                if size > BATCH_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(at, len(contents))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], names=["repository_id", "path", "size", "content"])
                    at, size, contents = i + 1, 0, []

    return narrow.repartition(int(tasks)).mapInArrow(read, "repository_id string, path string, size bigint, content binary")


def source_tree(spark, root):
    """(files, excluded): the files worth indexing, with FILE_COLUMNS, and every other one with the reason.

    The listing is written, so the tree is walked once; only files that pass by name and size are opened.
    """
    folder = work_path(spark, "listing")
    list_source_tree(spark, root).write.parquet(folder)
    listed = spark.read.parquet(folder)
    read = with_content(listed.filter("reason is null"), root)
    unfit = excluded_files(read).select("repository_id", "path", "size", "reason")
    return read.select(*FILE_COLUMNS), listed.filter("reason is not null").unionByName(unfit)


def read_source_tree(spark, root):
    """Rows (repository_id, path, content, size) for the files of <root>/<repository_id>/<path> worth indexing."""
    return source_tree(spark, root)[0]


def write_source_tree(files, root):
    """Write (repository_id, path, content) as files below a shared folder; returns how many each repository has.

    A path that leaves the folder fails.  Tasks that run again write the same files again.
    """
    path = F.concat_ws("/", "repository_id", "path")
    climbs = path.startswith("/") | F.array_contains(F.split(path, "/"), "..")
    safe = F.when(climbs, F.raise_error(F.concat(F.lit("not below the folder: "), path)).cast("string")).otherwise(path)

    def write(batches):
        store, top = open_place(root.rstrip("/"))
        made = set()
        for batch in batches:
            for place, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                folder = f"{top}/{place}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{top}/{place}") as f:
                    f.write(content)
            yield batch.select([0])

    written = files.select("repository_id", safe.alias("place"), "content").mapInArrow(write, "repository_id string")
    return written.groupBy("repository_id").agg(F.count("*").alias("files"))


def worth_indexing():
    """Whether a file is indexed, by the columns `path`, `size` and `content`."""
    path = F.col("path")
    return ~P.in_pruned_folder(path) & P.should_process(path) & (F.col("size") <= P.size_limit(path)) & ~P.is_binary(F.col("content"))


def select_files(tree):
    """The files worth indexing, with their language; `tree` holds FILE_COLUMNS."""
    path = F.col("path")
    return (
        tree.filter(worth_indexing())
        .withColumn("language", P.language_of(path))
        .withColumn("extension", P.extension(path))
    )


def excluded_files(tree):
    """The files that `select_files` leaves out, each with the reason."""
    path = F.col("path")
    reason = (
        F.when(P.in_pruned_folder(path), "pruned folder")
        .when(~P.should_process(path), "unsupported type")
        .when(F.col("size") > P.size_limit(path), "too large")
        .when(F.col("content").isNull(), "unreadable")
        .when(P.is_binary(F.col("content")), "binary content")
    )
    return tree.select("repository_id", "path", "size", reason.alias("reason")).filter(F.col("reason").isNotNull())


def decode_files(files, errors="drop"):
    """Add the text, the hash of the raw bytes and the line count."""
    return files.withColumns(
        {"text": X.decode_utf8(F.col("content"), errors), "hash": F.sha2("content", 256)}
    ).withColumn("loc", X.count_lines(F.col("text")))


def file_id(repository_id="repository_id", path="path"):
    """Deterministic id, so that a recomputed partition yields the same rows."""
    return F.sha2(F.concat_ws("\x00", F.col(repository_id), F.col(path)), 256)


def tree_limits(tree, max_files=V.ARCHIVE_FILES, max_bytes=V.ARCHIVE_BYTES):
    """One verdict per repository: file and byte totals outside `.git`."""
    parts = F.split("path", "/")
    return (
        tree.filter(~F.array_contains(F.slice(parts, 1, F.size(parts) - 1), ".git"))
        .groupBy("repository_id")
        .agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
        .withColumn("accepted", (F.col("files") <= max_files) & (F.col("bytes") <= max_bytes))
    )


def resolve_source(paths, sources):
    """Match stored paths to source files: the exact path first, else the path without its first folder.

    Both sides hold (repository_id, path); `sources` also holds `text`.  `found` is false where the source is
    missing, which fails a scan.
    """
    exact = sources.select("repository_id", F.col("path").alias("_unix"), F.col("text").alias("_exact"))
    # only rows without an exact match carry a tail to look up
    short = sources.select("repository_id", F.col("path").alias("_tail"), F.col("text").alias("_short"))
    tail = F.when(F.col("_unix").contains("/") & F.col("_exact").isNull(), F.regexp_replace("_unix", "^[^/]*/", ""))
    return (
        paths.withColumn("_unix", F.replace("path", F.lit("\\"), F.lit("/")))
        .join(exact, ["repository_id", "_unix"], "left")
        .withColumn("_tail", tail)
        .join(short, ["repository_id", "_tail"], "left")
        .withColumn("text", F.coalesce("_exact", "_short"))
        .withColumn("found", F.col("text").isNotNull())
        .drop("_unix", "_tail", "_exact", "_short")
    )
