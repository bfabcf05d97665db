"""Column expressions over file paths: selection, language, importance."""

from pyspark.sql import functions as F

from . import fixed_values as V
from .text import any_word, words_array


def file_name(path):
    return F.element_at(F.split(path, "/"), -1)


def suffix(path):
    """Last suffix as written; none for names such as '.env' or 'name.'."""
    return F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1)


def extension(path):
    return F.lower(suffix(path))


def should_process(path):
    """Reject by path part, then accept config names, reject suffixes, accept source extensions."""
    lowered = F.lower(path)
    name = file_name(lowered)
    rejected_suffix = name.rlike("(" + any_word(V.REJECTED_SUFFIXES) + ")$")
    return (
        F.when(F.arrays_overlap(F.split(lowered, "/"), words_array(V.REJECTED_PARTS)), False)
        .when(name.isin(V.CONFIG_NAMES), True)
        .when(rejected_suffix, False)
        .otherwise(extension(path).isin(V.SOURCE_EXTENSIONS))
    )


def in_pruned_folder(path):
    """True below a folder that the walk never enters (the file name itself does not count)."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), words_array(V.PRUNED_FOLDERS))


def language_of(path):
    table = F.create_map(*[F.lit(x) for pair in V.EXTENSION_LANGUAGES.items() for x in pair])
    return F.when(suffix(path) == ".C", F.lit("cpp")).otherwise(
        F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))
    )


def is_binary(content):
    """A zero byte among the first 8192 bytes; unreadable content counts as binary."""
    probe = F.substring(content, 1, V.BINARY_PROBE_BYTES)
    return F.coalesce(F.contains(probe, F.lit(b"\x00")), F.lit(True))


def size_limit(path):
    return F.when(extension(path) == ".ipynb", V.NOTEBOOK_BYTES).otherwise(V.FILE_BYTES)


def stem(path):
    """Lower-case file name with every '.py', '.js' and '.ts' removed, wherever they stand."""
    name = file_name(F.lower(path))
    for part in (".py", ".js", ".ts"):
        name = F.replace(name, F.lit(part), F.lit(""))
    return name


def importance_score(path, symbols, dependents, complexity, imports):
    lowered = F.lower(path)
    score = (
        F.when(lowered.rlike(any_word(V.HIGH_WORDS)), 30).otherwise(0)
        + F.when(lowered.rlike(any_word(V.MEDIUM_WORDS)), 15).otherwise(0)
        + F.when(stem(path).isin(V.ENTRY_STEMS), 25).otherwise(0)
        + F.least(symbols * 2, F.lit(20))
        + F.least(dependents * 5, F.lit(20))
        + F.when(complexity > 5, 10).when(complexity > 2, 5).otherwise(0)
        + F.least(imports * 2, F.lit(10))
    )
    return F.least(score, F.lit(100)).cast("double")


def importance_level(score):
    return F.when(score >= 60, "HIGH").when(score >= 30, "MEDIUM").otherwise("LOW")


def is_api_path(path):
    return F.lower(path).rlike(any_word(V.API_WORDS))


def normalize_repository_url(url):
    """Canonical https URL of a github.com or gitlab.com repository root, NULL when it is not one."""
    trimmed = F.trim(url)
    host = F.lower(F.regexp_extract(trimmed, r"^(?i:https)://((?i:github\.com|gitlab\.com))(?::443)?/", 1))
    raw = F.regexp_replace(
        F.regexp_extract(trimmed, r"^(?i:https)://(?i:github\.com|gitlab\.com)(?::443)?/([^?#]*)\??#?$", 1), "/$", ""
    )
    # '+' is a literal in a path, so it must not be decoded to a blank
    decoded = F.transform(F.split(raw, "/"), lambda p: F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))))
    last = F.regexp_replace(F.element_at(decoded, -1), r"\.git$", "")
    parts = F.concat(F.slice(decoded, 1, F.size(decoded) - 1), F.array(last))
    allowed = F.forall(
        parts, lambda p: F.coalesce(p.rlike(r"\A[A-Za-z0-9_.-]+\z") & ~p.isin(".", ".."), F.lit(False))
    )
    github = (
        (F.size(parts) == 2) & parts[0].rlike(r"\A[A-Za-z0-9_]") & (F.length(F.element_at(parts, -1)) <= 100)
    )
    gitlab = F.forall(parts, lambda p: ~p.rlike(r"^-|\.git$|\.atom$")) & F.forall(
        F.slice(parts, 1, F.size(parts) - 1), lambda p: ~p.endswith(".")
    )
    path = F.array_join(parts, "/")
    sound = (
        (F.length(url) <= 4096)
        & ~url.rlike(r"[\x00-\x1f\x7f]")
        & (host != "")
        & (F.size(parts) >= 2)
        & allowed
        & F.when(host == "github.com", github).otherwise(gitlab)
    )
    return F.when(
        sound,
        F.concat(F.lit("https://"), host, F.lit("/"), F.when(host == "github.com", F.lower(path)).otherwise(path)),
    )
