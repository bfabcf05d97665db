"""Severity roll-ups, the density-based health score, and the state of the scan runs."""

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import fingerprint, round_half_even
from .running import latest_per_group

HEALTH_RULES = V.SECURITY_RULES + V.STRUCTURE_RULES


def with_score_impact(issues):
    """Whether a finding counts for health, and why.  The rule table is a literal map, so no join is needed."""
    rule = F.col("issue_type")
    reasons = F.create_map(*[F.lit(x) for pair in V.RULE_REASONS.items() for x in pair])
    affects = rule.isin(HEALTH_RULES)
    return issues.withColumn("affects_health", affects).withColumn(
        "score_reason",
        F.coalesce(
            F.try_element_at(reasons, rule),
            F.when(affects & rule.startswith("HARDCODED_"), V.CREDENTIAL_REASON).when(affects, V.CRYPTO_REASON),
            F.lit(V.SUGGESTION_REASON),
        ),
    )


def listed_issues(issues, severity=None, issue_type=None):
    """Findings without the retired rules, optionally of one severity or type (any case)."""
    out = issues.filter(~F.col("issue_type").isin(V.RETIRED_RULES))
    if severity:
        out = out.filter(F.col("severity") == severity.upper())
    if issue_type:
        out = out.filter(F.col("issue_type") == issue_type.upper())
    return out


def finding_view(issues, view="all", severity=None):
    """The `all`, `suggestions` or `health` view of scored findings."""
    if view != "all":
        issues = issues.filter(F.col("affects_health") == F.lit(view == "health"))
    return issues.filter(F.col("severity") == severity) if severity else issues


def issues_with_path(issues, files):
    """Left join; a finding without a file belongs to the repository."""
    paths = files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
    return issues.join(paths, "file_id", "left").withColumn(
        "file_path", F.coalesce("file_path", F.lit("(repository)"))
    )


def in_issue_order(issues):
    """Severity as text, descending, then path."""
    return issues.orderBy(F.desc("severity"), "file_path")


def severity_summary(issues, keys="repository_id"):
    """Scored findings per severity (with zeros), suggestions and the security counts, in one aggregation."""
    rule, level = F.col("issue_type"), F.col("severity")
    scored = rule.isin(HEALTH_RULES)
    suggestion = ~rule.isin(HEALTH_RULES + V.RETIRED_RULES)
    return (
        issues.groupBy(keys)
        .agg(
            *[F.count_if(scored & (level == s)).alias(s.lower()) for s in V.SEVERITIES],
            F.count_if(suggestion).alias("suggestions"),
            F.count_if(rule.isin(V.SECURITY_RULES) & (level == "CRITICAL")).alias("security_critical"),
            F.count_if(rule.isin(V.SECURITY_RULES) & (level == "HIGH")).alias("security_high"),
        )
        .withColumn("scored", F.col("critical") + F.col("high") + F.col("medium") + F.col("low"))
        .withColumn("findings", F.col("scored") + F.col("suggestions"))
    )


def issues_by_type(issues, keys="repository_id"):
    return issues.filter(F.col("issue_type").isin(HEALTH_RULES)).groupBy(keys, "issue_type").agg(
        F.count("*").alias("n")
    )


def health_score(loc, critical, high, medium, low, security_critical, security_high):
    """Weighted findings per 1,000 lines; a density of 20 halves the score; security findings cap it."""
    w = V.SEVERITY_WEIGHTS
    weighted = critical * w["CRITICAL"] + high * w["HIGH"] + medium * w["MEDIUM"] + low * w["LOW"]
    density = weighted * F.lit(1000.0) / F.greatest(F.lit(1000.0), loc.cast("double"))
    score = round_half_even(F.lit(100.0) / (F.lit(1.0) + density / F.lit(20.0)))
    cap = F.when(security_critical > 0, 49.0).when(security_high > 0, 79.0).otherwise(100.0)
    return F.least(score, cap).cast("long")


def with_health_score(summary, coverage):
    """Join the coverage (scanned_files, scanned_loc) and score; NULL where nothing was scanned."""
    score = health_score(
        F.col("scanned_loc"),
        *[F.coalesce(c, F.lit(0)) for c in
          ("critical", "high", "medium", "low", "security_critical", "security_high")],
    )
    return coverage.join(summary, "repository_id", "left").withColumn(
        "health_score", F.when(F.col("scanned_files") > 0, score)
    )


def scan_coverage(scanned_units, exclusions):
    """Coverage counters per repository; the exclusions stay a table of (repository_id, path, reason)."""
    per_file = scanned_units.groupBy("repository_id", "path").agg(
        F.max("scanned").alias("scanned"),
        F.sum(F.when(F.col("scanned"), F.col("loc")).otherwise(0)).alias("loc"),
        F.count_if(F.col("is_cell") & F.col("scanned")).alias("cells_scanned"),
        F.count_if(F.col("is_cell") & ~F.col("scanned")).alias("cells_skipped"),
        F.max("json_valid").alias("json_valid"),
    )
    skipped = exclusions.groupBy("repository_id").agg(F.count("*").alias("exclusions"))
    return (
        per_file.groupBy("repository_id")
        .agg(
            F.count_if("scanned").alias("scanned_files"),
            F.sum("loc").alias("scanned_loc"),
            F.count_if(~F.col("scanned")).alias("unsupported_files"),
            F.sum("cells_scanned").alias("notebook_cells_scanned"),
            F.sum("cells_skipped").alias("notebook_cells_skipped"),
            F.count_if("json_valid").alias("json_files_validated"),
        )
        .join(skipped, "repository_id", "left")
        .fillna(0, ["exclusions"])
        .withColumn("score_version", F.lit(V.SCORE_VERSION))
    )


ACTIVE = ("PENDING", "RUNNING")


def run_state(jobs, score_version=V.SCORE_VERSION):
    """Current scan job (active first, else newest) and the newest completed one, as one aggregate per repository."""
    at = [F.col("created_at"), F.col("id")]
    current = latest_per_group(
        jobs, "repository_id", [F.col("status").isin(*ACTIVE), *at], ["id", "status"], prefix="job_"
    )
    done = latest_per_group(
        jobs.filter("status = 'COMPLETED'"), "repository_id", at, ["id", "created_at", "score_version"],
        prefix="completed_",
    )
    return current.join(done, "repository_id", "left").withColumn(
        "requires_rescan",
        F.coalesce(F.col("completed_id").isNotNull() & (F.col("completed_score_version") != score_version), F.lit(False)),
    )


def run_status(repositories, runs, summary):
    """Status per repository: the current job, LEGACY where only old findings exist, else NOT_RUN."""
    return (
        repositories.join(runs, "repository_id", "left")
        .join(summary.select("repository_id", "scored"), "repository_id", "left")
        .withColumn(
            "analysis_status",
            F.coalesce("job_status", F.when(F.coalesce("scored", F.lit(0)) > 0, "LEGACY"), F.lit("NOT_RUN")),
        )
    )


def scan_keys(files, rule_version=V.SCORE_VERSION):
    """Fingerprint per repository over its file ids, paths, languages and content hashes.

    File fingerprints are combined by an order-free sum of hash words, so a repository of any size is folded by
    partial aggregation and its file list is never gathered in one place.
    """
    one = F.sha2(F.concat_ws("\x00", "id", "path", "language", "hash"), 256)
    word = lambda i: F.conv(F.substring(F.col("_h"), i * 12 + 1, 12), 16, 10).cast("decimal(38,0)")
    return (
        files.withColumn("_h", one)
        .groupBy("repository_id")
        .agg(F.count("*").alias("_n"), *[F.sum(word(i)).alias(f"_w{i}") for i in range(5)])
        .withColumn(
            "scan_key",
            fingerprint(F.lit(rule_version), F.col("_n"), *[F.col(f"_w{i}") for i in range(5)]),
        )
        .select("repository_id", "scan_key")
    )


def reusable_scans(runs, keys):
    """Repositories whose newest run is complete and was made from the same files and rules."""
    return runs.join(keys.withColumnRenamed("scan_key", "_now"), "repository_id").withColumn(
        "reuse", (F.col("status") == "COMPLETED") & (F.col("scan_key") == F.col("_now"))
    ).drop("_now")
