"""Read views: gates, lists and their orders."""

from pyspark.sql import functions as F


def ready_repositories(repositories):
    return repositories.filter("status = 'READY'")


def ready_only(table, repositories, key="repository_id"):
    """Rows of repositories that may be searched, scanned or summarised."""
    return table.join(ready_repositories(repositories).select(F.col("id").alias(key)), key, "left_semi")


def files_by_importance(files):
    return files.orderBy(F.desc("importance_score"), "path")


def in_symbol_order(symbols):
    return symbols.orderBy("start_line", "name")


def recent_repositories(repositories, n=5):
    """The newest repositories with their first three languages."""
    top = repositories.orderBy(F.desc("created_at"), "id").limit(n)
    names = F.slice(F.map_keys("languages"), 1, 3)
    return top.withColumn("shown_languages", F.array_join(names, ", "))


def shown_sources(sources, n=6):
    """The sources listed under an answer."""
    return F.slice(sources, 1, n)
