"""File and repository statistics, import dependents, folder tree."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import paths as P
from ..functions import text as X
from ..functions.rows import each
from .running import running_total


def with_symbol_totals(files, symbols="symbols", complexity="complexity_score"):
    """Class and function counts and the mean positive complexity of a file with nested symbols."""
    s = F.col(symbols)
    kinds = lambda *names: F.size(F.filter(s, lambda x: x["type"].isin(*names))).cast("long")
    positive = F.filter(F.transform(s, lambda x: x["complexity"]), lambda c: c > 0)
    total = F.aggregate(positive, F.lit(0.0), lambda a, c: a + c)
    return files.withColumns(
        {
            "num_classes": kinds("class"),
            "num_functions": kinds("function", "method"),
            complexity: F.when(F.size(positive) > 0, F.round(total / F.size(positive), 2)).otherwise(0.0),
        }
    )


def language_histogram(files, keys="repository_id"):
    """Files per counted language."""
    keys = [keys] if isinstance(keys, str) else keys
    return (
        files.filter(~F.col("language").isin(V.UNCOUNTED_LANGUAGES))
        .groupBy(*keys, "language")
        .agg(F.count("*").alias("files"))
    )


def language_maps(histogram):
    """One map per repository; the number of languages is bounded by the extension table."""
    pairs = F.sort_array(F.collect_list(F.struct("language", "files")))
    return histogram.groupBy("repository_id").agg(F.map_from_entries(pairs).alias("languages"))


def merge_language_maps(repositories):
    """Language totals over repositories, from their stored maps."""
    return (
        repositories.select(F.explode("languages").alias("language", "n"))
        .groupBy("language")
        .agg(F.sum("n").alias("files"))
    )


def repository_totals(files, chunks=None):
    out = files.groupBy("repository_id").agg(
        F.count("*").alias("total_files"), F.count("*").alias("processed_files"),
        F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc"),
    )
    if chunks is None:
        return out
    made = chunks.groupBy("repository_id").agg(F.count("*").alias("total_chunks"))
    return out.join(made, "repository_id", "left").fillna(0, ["total_chunks"])


def repository_stats(files, issues=None):
    """Sums, mean complexity over all files, importance breakdown with zeros, scored findings."""
    level = F.coalesce("importance_level", F.lit("LOW"))
    out = files.groupBy("repository_id").agg(
        F.count("*").alias("total_files"),
        F.sum("loc").alias("total_loc"),
        F.sum("num_classes").alias("total_classes"),
        F.sum("num_functions").alias("total_functions"),
        F.round(F.avg("complexity_score"), 2).alias("avg_complexity"),
        *[F.count_if(level == v).alias(v.lower()) for v in ("HIGH", "MEDIUM", "LOW")],
    )
    if issues is None:
        return out
    scored = (
        issues.filter(F.col("issue_type").isin(V.SECURITY_RULES + V.STRUCTURE_RULES))
        .groupBy("repository_id")
        .agg(F.count("*").alias("issues_count"))
    )
    return out.join(scored, "repository_id", "left").fillna(0, ["issues_count"])


def explorer_counts(files):
    return files.groupBy("repository_id").agg(
        F.count_if(F.col("importance_level") == "HIGH").alias("high_files"),
        F.count_if(F.col("importance_level") == "MEDIUM").alias("medium_files"),
        F.sum("loc").alias("total_loc"),
    )


def dashboard_totals(repositories, issues=None):
    """Totals over the finished repositories; with their findings, also how many there are."""
    ready = repositories.filter("status = 'READY'")
    out = ready.agg(F.count("*").alias("repositories"), F.sum("total_files").alias("files"), F.sum("total_loc").alias("loc"))
    if issues is None:
        return out
    found = issues.groupBy("repository_id").agg(F.count("*").alias("_n")).join(ready.select("repository_id"), "repository_id", "left_semi")
    return out.join(found.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("issues")), how="cross")  # one row each


def repository_view(files):
    """What a repository's summary page lists of its files, most important first, with their counts."""
    place = F.row_number().over(W.partitionBy("repository_id").orderBy(F.desc("importance_score"), "path"))
    return files.select(
        "repository_id", "path", "language", "importance_level", "importance_score", "num_classes", "num_functions", "loc", "summary", place.alias("place")
    )


def _grams(text, n):
    last = F.length(text) - n + 1
    return F.when(
        last >= 1,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: text.substr(i, F.lit(n)))),
    ).otherwise(F.array().cast("array<string>"))


def substring_pairs(needles, needle, texts, text, on, grams=(1, 2, 3, 4)):
    """Rows of `needles` x `texts` where the needle occurs in the text and the `on` columns are equal.

    A substring condition alone would force a nested loop over both tables.  A text that contains the needle also
    contains each of the needle's grams (four characters, or the whole of a shorter needle), so both sides meet in
    an equi-join on one gram and only real candidates are compared.  The gram that the fewest texts contain is
    taken: with a shared one, such as a common folder name, every needle would meet every text.

    A text opens into far more rows than its size tells, so the opened texts are never sent to all tasks: grams that no
    needle has are dropped first, where the needles' side alone can be sent, and the rest meet in a sort-merge join.
    """
    longest = max(grams)
    pieces = F.array_distinct(F.concat(*[_grams(F.col(text), n) for n in grams]))
    wanted = needles.filter(F.length(needle) >= min(grams))
    own = F.when(F.length(needle) < longest, F.array(F.col(needle))).otherwise(_grams(F.col(needle), longest))
    asked = each(wanted.select(*on, needle).distinct(), own, "_gram", [*on, needle])
    opened = each(texts, pieces, "_gram", texts.columns).join(asked.select(*on, "_gram").distinct(), [*on, "_gram"], "left_semi")
    frequency = opened.groupBy(*on, "_gram").agg(F.count("*").alias("_texts"))
    rarest = (
        asked.join(frequency, [*on, "_gram"], "left")
        .groupBy(*on, needle)
        .agg(
            F.min_by("_gram", F.struct(F.coalesce("_texts", F.lit(0)), F.col("_gram"))).alias("_gram"),
            F.min(F.coalesce("_texts", F.lit(0))).alias("_texts"),
        )
        .filter("_texts > 0")
        .drop("_texts")
    )
    return (
        opened.hint("merge").join(wanted.join(rarest, [*on, needle]), [*on, "_gram"])
        .filter((F.length(needle) < longest) | F.col(text).contains(F.col(needle)))
        .drop("_gram")
    )


def import_dependents(imports, paths, mode="complete"):
    """How many imports name each path: the module with '.' as '/' is a substring of the path.

    imports: (repository_id, module[, seq]), paths: (repository_id, path[, seq]).  An empty module hits every path.
    Equal modules are counted before the join.  `as_scanned` counts only imports of files that stand at or before
    the path in scan order (`seq`, integral).
    """
    needles = imports.withColumn("needle", F.replace("module", F.lit("."), F.lit("/")))
    if mode == "as_scanned":
        return _dependents_as_scanned(needles, paths)
    counted = needles.groupBy("repository_id", "needle").agg(F.count("*").alias("n"))
    hits = substring_pairs(
        counted.filter("needle <> ''"), "needle", paths.select("repository_id", "path"), "path", ["repository_id"]
    )
    found = hits.groupBy("repository_id", "path").agg(F.sum("n").alias("hits"))
    everywhere = counted.filter("needle = ''").select("repository_id", F.col("n").alias("everywhere"))
    return (
        paths.join(found, ["repository_id", "path"], "left")
        .join(everywhere, "repository_id", "left")
        .withColumn("dependents", F.coalesce("hits", F.lit(0)) + F.coalesce("everywhere", F.lit(0)))
        .drop("hits", "everywhere")
    )


def _dependents_as_scanned(needles, paths):
    """Running import counts per module, read off at the scan position of each matching path."""
    counted = needles.groupBy("repository_id", "needle", "seq").agg(F.count("*").alias("n"))
    modules = counted.select("repository_id", "needle").distinct()
    pairs = substring_pairs(
        modules.filter("needle <> ''"), "needle", paths.select("repository_id", "path", "seq"), "path",
        ["repository_id"],
    ).unionByName(
        paths.select("repository_id", "path", "seq").join(modules.filter("needle = ''"), "repository_id")
    )
    # imports stand before paths at the same position, so a file sees its own imports
    ticks = counted.select(
        "repository_id", "needle", (F.col("seq") * 2).alias("tick"), "n", F.lit(None).cast("string").alias("path")
    ).unionByName(
        pairs.select(
            "repository_id", "needle", (F.col("seq") * 2 + 1).alias("tick"), F.lit(0).cast("long").alias("n"), "path"
        )
    )
    seen = (
        running_total(ticks, ["repository_id", "needle"], "tick", "n", "hits")
        .filter("path is not null")
        .groupBy("repository_id", "path")
        .agg(F.sum("hits").alias("dependents"))
    )
    return paths.join(seen, ["repository_id", "path"], "left").fillna(0, ["dependents"])


def with_importance(files):
    """Importance of parsed files; `symbol_count`, `dependents`, `complexity_score`, `import_count` are present."""
    score = P.importance_score(
        F.col("path"), F.col("symbol_count"), F.col("dependents"), F.col("complexity_score"), F.col("import_count")
    )
    return files.withColumn("importance_score", score).withColumn(
        "importance_level", P.importance_level(F.col("importance_score"))
    )


def path_tree(files):
    """Distinct folder and file nodes with their parent; show in order (parent, kind desc, name)."""
    nodes = X.bind(
        F.split("path", "/"),
        lambda parts: F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda n: F.struct(
                F.array_join(F.slice(parts, 1, n), "/").alias("node_path"),
                F.array_join(F.slice(parts, 1, n - 1), "/").alias("parent_path"),
                F.element_at(parts, n).alias("name"),
                F.when(n == F.size(parts), "file").otherwise("folder").alias("kind"),
            ),
        ),
    )
    return each(files, nodes, "n", ["repository_id"]).select("repository_id", "n.*").distinct()


def symbol_outline(symbols, kinds=("class", "struct", "interface", "enum", "record", "namespace", "type")):
    """Symbols with the group they are listed under: their class, or the functions of the file.

    A method whose class is missing from the file is listed as a function.
    """
    owners = (
        symbols.filter(F.col("type").isin(*kinds))
        .select("file_id", F.col("name").alias("parent_name"), F.lit(True).alias("_owned"))
        .distinct()
    )
    return symbols.join(owners, ["file_id", "parent_name"], "left").withColumn(
        "listed_under",
        F.when(F.col("type").isin(*kinds), F.col("name"))
        .when((F.col("type") == "method") & F.col("_owned"), F.col("parent_name"))
        .when(F.col("type").isin("function", "method"), F.lit("(functions)")),
    ).drop("_owned")


def symbols_with_path(symbols, files, kind=None):
    out = symbols.join(files.select(F.col("id").alias("file_id"), "repository_id", "path"), "file_id")
    return out.filter(F.col("type") == kind) if kind else out


def testable_symbols(symbols):
    return symbols.filter(F.col("type").isin("function", "method"))


def testable_files(files):
    return files.filter(F.col("language").isin(V.TESTED_LANGUAGES))


def api_files(files):
    """Files on an API-like path; where a repository has none, its HIGH files."""
    hit = P.is_api_path(F.col("path"))
    any_hit = files.groupBy("repository_id").agg(F.max(hit).alias("_any"))
    return (
        files.join(any_hit, "repository_id")
        .filter(hit | (~F.col("_any") & (F.col("importance_level") == "HIGH")))
        .drop("_any")
    )


def with_searchable(files, chunks):
    """Whether a file has at least one chunk."""
    present = chunks.select(F.col("file_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return files.join(present, "id", "left").withColumn(
        "searchable", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def parse_status(error, diagnostics):
    return F.when(error.isNotNull(), "failed").when(F.size(diagnostics) > 0, "partial").otherwise("complete")


def summary_status(files):
    return files.select(
        "repository_id", "path", "importance_score", "importance_level",
        (F.col("summary").isNotNull() & (F.col("summary") != "")).alias("has_summary"), "summary",
    )
