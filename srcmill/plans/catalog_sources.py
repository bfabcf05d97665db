"""Registered queries that write the documents as files or archives and read those back."""

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..session import work_path
from ..sources import archives, tree
from .registry import query


def documents_as_files(documents):
    """Documents in folders that are walked or pruned, with fit and unfit names, sizes and bytes."""
    i = F.col("doc_id")
    folder, name, end = (F.coalesce(*[F.when(i % 6 == k, v) for k, v in enumerate(values)]) for values in (
        ["src/", "lib/a/", "node_modules/x/", "img/", "src/zero", "src/large"], ["doc"] * 6, [".go", ".go", ".go", ".png", ".go", ".go"],
    ))
    text = F.coalesce("text", F.lit("")).cast("binary")
    content = F.when(i % 6 == 4, F.concat(F.lit(b"\x00"), text)).when(i % 300 == 5, F.repeat(F.lit("x"), V.FILE_BYTES + 1).cast("binary")).otherwise(text)
    return documents.select(
        F.col("source").alias("repository_id"), F.concat(folder, name, i.cast("string"), end).alias("path"), content.alias("content")
    )


@query(
    "source_tree",
    f"""WITH f AS (SELECT source, doc_id % 6 AS k, doc_id % 300 = 5 AS large, coalesce(text, '') AS text, ['src/', 'lib/a/', 'node_modules/x/', 'img/', 'src/zero', 'src/large'][doc_id % 6 + 1]
      || 'doc' || doc_id || CASE doc_id % 6 WHEN 3 THEN '.png' ELSE '.go' END AS path FROM documents)
    SELECT source AS repository_id, path, CASE WHEN large THEN {V.FILE_BYTES + 1} ELSE octet_length(encode(text)) + (k = 4)::INT END::BIGINT AS size,
      CASE WHEN k = 3 THEN 'unsupported type' WHEN k = 4 THEN 'binary content' WHEN large THEN 'too large' END AS reason,
      CASE WHEN k IN (0, 1, 5) AND NOT large THEN sha256(text) END AS hash FROM f WHERE k <> 2
    UNION ALL SELECT DISTINCT source, 'node_modules/', NULL, 'pruned folder', NULL FROM f WHERE k = 2""",
)
def source_tree(t):
    """The documents written as a tree of files, walked and read back, with the reason for every file left out."""
    root = work_path(t.spark, "tree")
    tree.write_source_tree(documents_as_files(t("documents")), root).write.format("noop").mode("overwrite").save()
    files, excluded = tree.source_tree(t.spark, root)
    kept = tree.select_files(files).select("repository_id", "path", "size", F.lit(None).cast("string").alias("reason"), F.sha2("content", 256).alias("hash"))
    return kept.unionByName(excluded, allowMissingColumns=True)


PACKED, TORN, ARCHIVE_BYTES = 200, 4, 40_000


def write_archives(documents, root):
    """ZIP files of the documents of a source and a range of ids, every fourth range torn at its end."""
    part = F.floor(F.col("doc_id") / PACKED)
    rows = documents.select(
        F.concat("source", F.lit("-"), part.cast("string")).alias("archive"), (part % TORN == 1).alias("torn"),
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".go")).alias("member"), F.coalesce("text", F.lit("")).cast("binary").alias("content"),
    )

    def pack(rows):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for member, content in sorted(zip(rows.column("member").to_pylist(), rows.column("content").to_pylist())):
                z.writestr(member, content)
        name = rows.column("archive")[0].as_py()
        store, top = tree.open_place(root)
        store.create_dir(top, recursive=True)
        data = out.getvalue()
        with store.open_output_stream(f"{top}/{name}.zip") as f:
            f.write(data[:-10] if rows.column("torn")[0].as_py() else data)
        return pa.table({"archive": [name], "bytes": [len(data)]})

    return rows.groupBy("archive").applyInArrow(pack, "archive string, bytes long")


@query(
    "archive_contents",
    f"""WITH d AS (SELECT source || '-' || doc_id // {PACKED} AS archive, doc_id // {PACKED} % {TORN} = 1 AS torn, doc_id, coalesce(text, '') AS text FROM documents),
    a AS (SELECT archive, CASE WHEN any_value(torn) THEN '{archives.UNREADABLE}' WHEN sum(octet_length(encode(text))) > {ARCHIVE_BYTES} THEN 'too large' ELSE 'accepted' END AS verdict
      FROM d GROUP BY archive)
    SELECT archive, verdict, CASE WHEN verdict = 'accepted' THEN 'docs/' || doc_id || '.go' END AS path, CASE WHEN verdict = 'accepted' THEN octet_length(encode(text)) END::BIGINT AS size,
      CASE WHEN verdict = 'accepted' THEN sha256(text) END AS hash
    FROM a JOIN d USING (archive) WHERE verdict = 'accepted' OR doc_id IN (SELECT min(doc_id) FROM d GROUP BY archive)""",
)
def archive_contents(t):
    """The documents packed into archives, some of them torn and some too large, and what is read of those."""
    root = work_path(t.spark, "archives")
    write_archives(t("documents"), root).write.format("noop").mode("overwrite").save()
    verdicts, contents = archives.ingest_archives(t.spark, root, max_bytes=ARCHIVE_BYTES)
    members = contents.select(F.col("repository_id").alias("archive"), "path", "size", F.sha2("content", 256).alias("hash"))
    return verdicts.select("archive", "verdict").join(members, "archive", "left").select("archive", "verdict", "path", "size", "hash")
