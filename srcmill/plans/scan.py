"""Health scan: findings, exclusions and coverage of every repository of a snapshot."""

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as X
from ..operators import code_scan as S
from ..operators import documents as D
from ..operators import scores as R
from ..operators.running import latest_per_group
from ..session import cut_lineage
from ..sources import store

KEYS = ["repository_id", "file_id", "path"]


def scan_files(files, analyzers=()):
    """files: (repository_id, file_id, path, language, text).  Returns findings, exclusions and coverage.

    analyzers: further functions from the files to findings (KEYS, issue_type, severity, message, line, suggestion).
    """
    python = files.filter("language = 'python'").select(
        *KEYS, "text", F.lit(0).alias("offset"), F.lit("").alias("label"), F.lit(False).alias("is_cell")
    )
    documents = cut_lineage(
        D.read_documents(
            files.filter(F.col("language").isin("json", "notebook")), [*KEYS, "language"]
        ).drop("view", "sections")
    )
    cells = D.code_cells(documents.filter("language = 'notebook'"), KEYS)
    units = python.unionByName(
        cells.filter("supported").select(*KEYS, "text", "offset", "label", F.lit(True).alias("is_cell"))
    )
    checked = cut_lineage(
        S.with_python_findings(units, [*KEYS, "offset", "label", "is_cell"])
        .withColumn("loc", X.count_lines(F.col("text"))).drop("text")
    )
    scripts = cut_lineage(
        S.with_script_findings(files.filter(F.col("language").isin("javascript", "typescript")))
        .select(*KEYS, F.lit(0).alias("offset"), F.lit("").alias("label"), "findings",
                X.count_lines(F.col("text")).alias("loc"))
    )
    findings = S.explode_findings(
        checked.filter("parsed").select(*KEYS, "offset", "label", "findings").unionByName(
            scripts.select(*KEYS, "offset", "label", "findings")
        ),
        [*KEYS, "offset", "label"], "offset", "label",
    )
    for analyzer in analyzers:
        findings = findings.unionByName(analyzer(files).select(*findings.columns))
    exclusions = (
        checked.filter("not parsed").select("repository_id", "path", F.concat("label", F.lit(V.UNPARSED_PYTHON)).alias("reason"))
        .unionByName(
            cells.filter("not supported").select("repository_id", "path", F.concat("label", "reason").alias("reason"))
        )
        .unionByName(
            documents.filter("language = 'json' or not valid").select(
                "repository_id", "path",
                F.when(F.col("valid"), V.VALID_JSON).otherwise(F.array_join("warnings", "; ")).alias("reason"),
            )
        )
    )
    unit = lambda df, scanned, is_cell, json: df.select(
        "repository_id", "path", scanned.alias("scanned"), F.col("loc") if "loc" in df.columns else F.lit(0).alias("loc"),
        is_cell.alias("is_cell"), json.alias("json_valid"),
    )
    no = F.lit(False)
    others = files.filter(~F.col("language").isin("python", "javascript", "typescript", "json", "notebook"))
    per_unit = (
        unit(checked, F.col("parsed"), F.col("is_cell"), no)
        .unionByName(unit(scripts, F.lit(True), no, no))
        .unionByName(unit(cells.filter("not supported"), no, F.lit(True), no))
        .unionByName(unit(documents, no, no, (F.col("language") == "json") & F.col("valid")))
        .unionByName(unit(others, no, no, no))
    )
    return dict(findings=findings, exclusions=exclusions, coverage=R.scan_coverage(per_unit, exclusions))


def summarize_scan(scan):
    """Severity summary and health score per scanned repository."""
    return R.with_health_score(R.severity_summary(scan["findings"]), scan["coverage"])


def publish_scan(scan, folder, runs):
    """Store the findings of the scanned repositories, then publish their run rows.

    runs: (repository_id, id, ...).  Findings carry the id of their run and readers follow the run rows (see
    `current_findings`), so a failure before the last step leaves the earlier results in force, and a scan without
    any finding replaces an earlier one that had some.  Every run has a partition of its own: publishing it again
    replaces what an interrupted attempt has left.
    """
    tag = runs.select("repository_id", F.col("id").alias("run_id"))
    by = ("repository_id", "run_id")
    store.write_table(scan["findings"].join(tag, "repository_id"), f"{folder}/analysis_issues", by=by)
    store.write_table(scan["exclusions"].join(tag, "repository_id"), f"{folder}/scan_exclusions", by=by)
    store.write_table(runs.withColumn("run_id", F.col("id")), f"{folder}/repository_jobs", by=by)


def current_findings(issues, jobs):
    """Findings of the newest completed run per repository."""
    newest = latest_per_group(
        jobs.filter("status = 'COMPLETED'"), "repository_id", [F.col("created_at"), F.col("id")], ["id"], prefix="run_"
    )
    return issues.join(newest, ["repository_id", "run_id"])
