"""Parquet tables partitioned by repository, the vector table, and the JSON export."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import fixed_values as V
from ..functions import text as X
from ..schemas import INDEX_TABLES  # noqa: F401

def write_table(df, folder, mode="overwrite", by=("repository_id",)):
    """Replace (or append to) the partitions that occur in `df`; other repositories stay untouched."""
    (
        df.hint("rebalance", *by)  # adaptive execution splits a repository that is too large for one task
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(folder)
    )


def read_table(spark, folder, schema=None):
    return spark.read.parquet(folder) if schema is None else read_folder(spark, folder, schema)


def read_folder(spark, folder, schema):
    """A table that may not exist yet; any other failure to read it is raised."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_version(tables, folder, version, touched):
    """Write the touched repositories as a new version, then announce it.

    Running a version again replaces its own files; readers keep the version before until it is announced.
    """
    for name, df in tables.items():
        df.hint("rebalance", "repository_id").write.mode("overwrite").partitionBy("repository_id").parquet(
            f"{folder}/{name}/version={version}"
        )
    touched.write.mode("overwrite").parquet(f"{folder}/heads/version={version}")


def read_current(spark, folder, name, schema):
    """Every repository in its newest announced version."""
    heads = read_folder(spark, f"{folder}/heads", "repository_id string, version long")
    newest = heads.groupBy("repository_id").agg(F.max("version").alias("version"))
    rows = read_folder(spark, f"{folder}/{name}", f"{schema}, version long")
    columns = [c for c in rows.columns if c != "version"]
    return rows.join(newest, ["repository_id", "version"]).select(*columns)


def vector_rows(chunks, embedding="embedding"):
    """Vector table rows: missing metadata is stored as an empty text."""
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("symbol_name", "symbol_type", "language")]
    return chunks.select(
        "id", "repository_id", "file_path", *blank, "start_line", "end_line",
        F.col("content").alias("document"), embedding,
    )


def delete_vectors(vectors, ids):
    return vectors.join(ids.select("id").distinct(), "id", "left_anti")


def count_vectors(vectors):
    return vectors.groupBy("repository_id").agg(F.count("*").alias("vectors"))


def parse_jsonish(text):
    """Decoded JSON, or the stored text where it does not parse."""
    sound = X.sound_json(text)
    return F.struct(
        F.when(sound, F.to_json(F.try_parse_json(text))).alias("json"),
        F.when(~sound & (text != ""), text).alias("raw"),
    )


def keep_coverage(coverage):
    """Only the published keys of a coverage document, given as JSON text."""
    decoded = F.from_json(coverage, "map<string,string>")
    return F.map_filter(decoded, lambda k, _: k.isin(V.COVERAGE_KEYS))


def export_sources(owned):
    """The tables of an export, from an account's tables as they are stored.

    Analysis jobs are its runs, with the published part of their coverage; summaries get their public name.  Chunks,
    vectors and other jobs are derived or internal and are left out.
    """
    out = {name: df for name, df in owned.items() if name in V.EXPORT_COLUMNS}
    if "repository_jobs" in owned:
        runs = owned["repository_jobs"].filter("job_type = 'ANALYSIS'")
        if "coverage" in runs.columns:
            text = F.col("coverage") if dict(runs.dtypes)["coverage"] == "string" else F.to_json("coverage")
            runs = runs.withColumn("coverage", keep_coverage(text))
        out["analysis_runs"] = runs
    if "repository_summaries" in owned:
        out["summaries"] = owned["repository_summaries"]
    # rows without an id of their own get one from their content
    keyed = {"symbols": ("file_id", "type", "name", "start_line"), "analysis_issues": ("file_id", "issue_type", "line", "message", "run_id")}
    for name, key in keyed.items():
        if name in out and "id" not in out[name].columns:
            parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key if c in out[name].columns]
            out[name] = out[name].withColumn("id", F.sha2(F.concat_ws("\x00", *parts), 256))
    return out


def export_tables(owned):
    """Column allow-lists and ISO timestamps applied to the tables of an account."""
    out = {}
    for name, df in export_sources(owned).items():
        wanted = [c for c in V.EXPORT_COLUMNS[name].split() if c in df.columns]
        kinds = dict(df.dtypes)
        out[name] = df.select(
            *[
                X.iso_timestamp(F.col(c)).alias(c) if kinds[c].startswith("timestamp") else F.col(c)
                for c in wanted
            ]
        )
    return out


def export_manifest(tables, max_rows=V.EXPORT_ROWS):
    """Rows per table, the total, and whether the export must be refused (it is never truncated)."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        counts = one if counts is None else counts.unionByName(one)
    everything = W.partitionBy(F.lit(1))  # one row per table
    refused = F.lit(False) if max_rows is None else F.col("total_rows") > max_rows
    return counts.withColumn("total_rows", F.sum("row_count").over(everything)).withColumn("refused", refused)


def write_export(tables, folder, max_rows=V.EXPORT_ROWS):
    """Write one JSON folder per table plus the manifest; refuse the whole export above the bound (None: no bound)."""
    manifest = export_manifest(tables, max_rows)
    total = manifest.agg(F.max("total_rows")).first()[0]
    if max_rows is not None and total > max_rows:
        raise ValueError(f"export holds {total} rows, more than {max_rows}; nothing was written")
    for name, df in tables.items():
        key = "repository_id" if name == "usage_history" else "id"
        df.sort(key).write.mode("overwrite").json(f"{folder}/{name}")
    manifest.select("table_name", "row_count").write.mode("overwrite").json(f"{folder}/manifest")
