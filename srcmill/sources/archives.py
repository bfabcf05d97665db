"""ZIP uploads: list the members, judge the manifest, read the members of accepted archives by their place in the file."""

import stat
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..session import work_path
from .tree import BATCH_BYTES, TASK_BYTES, SourceFiles, open_place

MEMBERS = (
    "archive string, place string, member string, size bigint, is_dir boolean, is_link boolean, is_encrypted boolean, "
    "offset bigint, packed bigint, method int, crc bigint, problem string"
)
CONTENTS = "repository_id string, path string, size bigint, content binary, problem string"
#: What is wrong with an archive or a member.
UNREADABLE, DAMAGED, UNSUPPORTED, OVERSIZED = "unreadable archive", "damaged member", "unsupported compression", "larger than declared"


def list_archives(spark, root):
    """(archive, place, size) of the ZIP files below a folder; nothing is opened."""
    spark.dataSource.register(SourceFiles)
    listed = spark.read.format("source_files").load(root).filter("not pruned and endswith(path, '.zip')")
    place = F.concat(F.lit(root.rstrip("/") + "/"), F.when(F.col("repository_id") != "", F.concat("repository_id", F.lit("/"))).otherwise(""), "path")
    return listed.select(F.regexp_extract("path", r"([^/]*)\.zip$", 1).alias("archive"), place.alias("place"), "size")


def _arrays(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def archive_members(archives):
    """MEMBERS of every archive, from the directory at its end; an archive that can't be read is a row with a problem."""
    names = [c.split()[0] for c in MEMBERS.split(", ")]
    of_kind = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    kinds = [of_kind[c.split()[1]] for c in MEMBERS.split(", ")]

    def listing(batches):
        for batch in batches:
            for archive, place in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                try:
                    store, path = open_place(place)
                    with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                        rows = [
                            (archive, place, m.filename, m.file_size, m.is_dir(), stat.S_ISLNK(m.external_attr >> 16), bool(m.flag_bits & 1),
                             m.header_offset, m.compress_size, m.compress_type, m.CRC, None)
                            for m in z.infolist()
                        ]
                except (OSError, ValueError, EOFError, NotImplementedError, zipfile.BadZipFile, struct.error):
                    rows = [(archive, place, *[None] * 9, UNREADABLE)]
                for i in range(0, len(rows), 10_000):
                    yield _arrays(rows[i : i + 10_000], names, kinds)

    return archives.select("archive", "place").mapInArrow(listing, MEMBERS)


def judge_manifests(manifest, max_files=V.ARCHIVE_FILES, max_bytes=V.ARCHIVE_BYTES):
    """One verdict row per archive.  Copies of a path are counted after a per-path pre-aggregation."""
    # 'a//b', './a/b' and 'a/./b' name the same file
    unix = F.replace("member", F.lit("\\"), F.lit("/"))
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(unix, r"/(?:\.?/)+", "/"), r"^(?:\./)+", ""), r"/\.?$", "")
    unsafe = (
        path.startswith("/")
        | F.array_contains(F.split(path, "/"), "..")
        | path.contains(":")
        | F.col("is_link")
        | F.col("is_encrypted")
    )
    per_path = (
        manifest.withColumns({"_path": F.lower(path), "_unsafe": unsafe})
        .groupBy("archive", "_path")
        .agg(F.count("*").alias("_n"), F.sum("size").alias("_bytes"), F.max("_unsafe").alias("_unsafe"))
    )
    return (
        per_path.groupBy("archive")
        .agg(
            F.sum("_n").alias("members"),
            F.sum("_bytes").alias("bytes"),
            F.max("_unsafe").alias("unsafe"),
            (F.max("_n") > 1).alias("duplicated"),
        )
        .withColumn(
            "verdict",
            F.when(F.col("members") > max_files, "too many entries")
            .when(F.col("unsafe"), "unsafe entry")
            .when(F.col("duplicated"), "duplicate path")
            .when(F.col("bytes") > max_bytes, "too large")
            .otherwise("accepted"),
        )
    )


def judge_archives(members, max_files=V.ARCHIVE_FILES, max_bytes=V.ARCHIVE_BYTES):
    """One verdict per archive, those that can't be read included.  An archive without members has none."""
    known = judge_manifests(members.filter("problem is null"), max_files, max_bytes)
    return known.unionByName(members.filter("problem is not null").select("archive", F.col("problem").alias("verdict")), allowMissingColumns=True)


def _unpacked(f, row):
    """(content, problem) of a member whose place in the open file is known."""
    f.seek(row["offset"])
    header = f.read(30)
    if len(header) < 30 or header[:4] != b"PK\x03\x04":
        return None, DAMAGED
    # the lengths of name and extra field may differ from those in the directory
    f.seek(row["offset"] + 30 + sum(struct.unpack("<HH", header[26:])))
    packed = f.read(row["packed"])
    if row["method"] == zipfile.ZIP_DEFLATED:
        packed = zlib.decompressobj(-15).decompress(packed, row["size"] + 1)
    elif row["method"] != zipfile.ZIP_STORED:
        return None, UNSUPPORTED
    if len(packed) > row["size"]:
        return None, OVERSIZED
    return (packed, None) if len(packed) == row["size"] and zlib.crc32(packed) == row["crc"] else (None, DAMAGED)


def read_members(members, task_bytes=TASK_BYTES):
    """CONTENTS of members, shaped like a source tree: each is read by its own range of bytes.

    Members are dealt by archive and offset, a task for about `task_bytes`, so a large archive is many tasks and a task
    reads ranges that follow each other.  No member is unpacked beyond its declared size; one that is broken is a row
    with a problem.
    """
    spark = members.sparkSession
    files = members.filter("problem is null and not is_dir").select("archive", "place", "member", "size", "offset", "packed", "method", "crc")
    total = files.agg(F.sum(F.col("size") + F.col("packed"))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // task_bytes))
    names, kinds = ["repository_id", "path", "size", "content", "problem"], [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def read(batches):
        place, f, rows, size = None, None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    if row["place"] != place:
                        if f:
                            f.close()
                        place, f = row["place"], None
                        store, path = open_place(place)
                        f = store.open_input_file(path)
                    content, problem = _unpacked(f, row) if f else (None, UNREADABLE)
                except zlib.error:
                    content, problem = None, DAMAGED
                except OSError:
                    content, problem = None, UNREADABLE
                rows.append((row["archive"], row["member"].replace("\\", "/"), row["size"], content, problem))
                size += len(content or b"")
                if size > BATCH_BYTES:
                    yield _arrays(rows, names, kinds)
                    rows, size = [], 0
        if rows:
            yield _arrays(rows, names, kinds)
        if f:
            f.close()

    return files.repartitionByRange(int(tasks), "place", "offset").sortWithinPartitions("place", "offset").mapInArrow(read, CONTENTS)


def ingest_archives(spark, root, max_files=V.ARCHIVE_FILES, max_bytes=V.ARCHIVE_BYTES):
    """(verdicts, contents): a verdict per archive, and the members of the accepted ones with their bytes or a problem."""
    folder = work_path(spark, "members")
    archive_members(list_archives(spark, root)).write.parquet(folder)
    members = spark.read.schema(MEMBERS).parquet(folder)
    verdicts = judge_archives(members, max_files, max_bytes)
    return verdicts, read_members(members.join(verdicts.filter("verdict = 'accepted'").select("archive"), "archive", "left_semi"))
