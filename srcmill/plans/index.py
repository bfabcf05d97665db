"""Indexing: a file snapshot becomes files, symbols, chunks and vectors."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.rows import each
from ..operators import chunks as C
from ..operators import documents as D
from ..operators import inventory as N
from ..operators import js_outline as J
from ..operators import pyfacts
from ..operators import vectors as VE
from ..operators.arrow_map import append_columns
from ..session import work_path
from ..sources import store
from ..sources import tree as T

PIPELINE_VERSION = "srcmill-1"
IMPORTS = "array<struct<module:string,line:int>>"
OUTLINE = f"error string, parsed_symbols {J.SYMBOLS}, parsed_imports {IMPORTS}, cell_outlines array<struct<number:int,shift:int,symbols:{J.SYMBOLS},imports:{IMPORTS}>>"
SCRIPTS = ("javascript", "typescript")
# parsed elsewhere than in the registry, or cut by lines only
LINE_LANGUAGES = ("java", "go", "cpp")


def parse_python(text):
    found = pyfacts.outline(pyfacts.facts_or_error(text))
    return dict(error=found["error"], parsed_symbols=found["symbols"], parsed_imports=found["imports"])


def _moved(cells):
    """Symbols and imports of a notebook's outlined cells in the lines of its view, and the sum of the cells' mean complexity."""
    symbols = lambda c: F.transform(c["symbols"], lambda s: s.withField("start_line", s["start_line"] + c["shift"])
        .withField("end_line", s["end_line"] + c["shift"]).withField("signature", F.concat(F.lit("Cell "), c["number"].cast("string"), F.lit(" · "), s["signature"])))
    imports = lambda c: F.transform(c["imports"], lambda i: i.withField("line", i["line"] + c["shift"]))
    measured = lambda c: F.filter(F.transform(c["symbols"], lambda s: s["complexity"]), lambda x: x > 0)
    mean = lambda c: X.bind(measured(c), lambda m: F.when(F.size(m) > 0, F.bround(F.aggregate(m, F.lit(0.0), lambda n, x: n + x) / F.size(m), 2)).otherwise(0.0))
    return (
        F.flatten(F.transform(cells, symbols)), F.flatten(F.transform(cells, imports)),
        F.aggregate(F.transform(cells, mean), F.lit(0.0), lambda n, x: n + x),
    )


# language -> text -> dict with the OUTLINE fields; further languages can be registered by the caller
PARSERS = {"python": parse_python}
DOCUMENTS = ("json", "notebook")


def with_parsed(files, keep, parsers=None, limits=None):
    """Append the PARSED columns; rows of languages without a registered parser keep NULLs.

    JSON files and notebooks are read in Spark; Python only outlines sources, those of notebook cells included.
    """
    parsers = dict(PARSERS if parsers is None else parsers)
    columns = [*dict.fromkeys([*keep, "text", "language"])]
    read = D.read_documents(files, columns, limits=limits)

    def parse(text, language, cells):
        if language in parsers:
            return parsers[language](text)
        supported = [c for c in cells or () if c["supported"]]
        return {} if cells is None else {"cell_outlines": [dict(number=c["number"], shift=c["start_line"] - 1, **pyfacts.outline(pyfacts.facts_or_error(c["source"]))) for c in supported]}

    outlined = append_columns(read, [*columns, "valid", "warnings", "view", "sections"], ["text", "language", "cells"], OUTLINE, parse)
    of_section = lambda s: F.struct(
        s["name"].alias("name"), s["type"].alias("type"), s["start_line"].alias("start_line"), s["end_line"].alias("end_line"),
        F.lit(None).cast("string").alias("parent_name"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("docstring"), F.lit(0.0).alias("complexity"),
    )
    is_json = F.col("language") == "json"
    symbols, imports, complexity = _moved(F.col("cell_outlines"))
    return outlined.select(
        *keep, F.coalesce("error", F.when(~F.col("valid"), F.array_join("warnings", "; "))).alias("error"), "view", complexity.alias("cell_complexity"),
        F.when(is_json & F.col("valid").isNotNull(), F.transform("sections", of_section).cast(J.SYMBOLS)).otherwise(F.coalesce("parsed_symbols", symbols)).alias("parsed_symbols"),
        F.coalesce("parsed_imports", imports).alias("parsed_imports"), "sections",
    )


def python_outline(files, keep):
    return with_parsed(files.withColumn("language", F.lit("python")), keep).select(
        *keep, "error", F.col("parsed_symbols").alias("symbols"), F.col("parsed_imports").alias("imports")
    )


def parsed_files(tree, parsers=None):
    """One nested row per indexed file: text lines, symbols, imports, sections, counts."""
    files = T.decode_files(T.select_files(tree)).withColumn("id", T.file_id()).drop("content")
    keep = ["id", "repository_id", "path", "language", "extension", "size", "hash", "loc", "text"]
    staged = with_parsed(files.select(*keep), keep, parsers)
    staged = staged.withColumn("_script", F.when(F.col("language").isin(*SCRIPTS), F.col("text")))
    staged = J.with_js_outline(staged, "_script", "_imports", "_symbols")
    no_symbols = F.array().cast(J.SYMBOLS)
    no_imports = F.array().cast("array<struct<module:string,line:int>>")
    handled = F.col("language").isin(*(PARSERS if parsers is None else parsers), *DOCUMENTS, *SCRIPTS, *LINE_LANGUAGES) & F.col("error").isNull()
    staged = staged.select(
        *[c for c in keep if c not in ("loc", "text")],
        F.when(F.col("view").isNotNull(), X.count_lines(F.col("view"))).otherwise(F.col("loc")).alias("loc"),
        X.split_lines(F.coalesce("view", "text")).alias("lines"),
        "error", handled.alias("parsed"), "cell_complexity",
        F.coalesce("parsed_symbols", "_symbols", no_symbols).alias("symbols"),
        F.coalesce("parsed_imports", "_imports", no_imports).alias("imports"),
        F.coalesce("sections", F.array().cast("array<struct<name:string,type:string,start_line:int,end_line:int,language:string>>")).alias("sections"),
    )
    out = N.with_symbol_totals(staged)
    return out.withColumn("complexity_score", F.coalesce("cell_complexity", "complexity_score")).drop("cell_complexity")


def chunk_rows(parsed):
    """Chunks of the parsed files: documents by section, other files by symbols and gaps, the rest by lines."""
    body = F.when(F.size("sections") > 0, C.section_blocks(F.col("lines"), F.col("sections"))).otherwise(
        C.file_chunks(F.col("lines"), F.col("symbols"))
    )
    rows = C.explode_chunks(parsed.filter("parsed"), body, ["id", "repository_id", "path", "language"])
    return rows.select(
        F.sha2(F.concat_ws("\x00", "id", F.col("chunk_index").cast("string")), 256).alias("id"),
        F.col("id").alias("file_id"), "repository_id", "symbol_name", "symbol_type",
        F.coalesce("chunk_language", "language").alias("language"), F.col("path").alias("file_path"), "start_line",
        "end_line", "content", "chunk_index",
    )


def symbol_rows(parsed):
    return each(parsed.filter("parsed"), "symbols", "s", ["repository_id", "id"]).select(
        "repository_id", F.col("id").alias("file_id"), "s.*"
    )


def file_rows(parsed, dependents="complete"):
    """File rows with importance; text and lines are pruned before the dependents join."""
    slim = parsed.select(
        "id", "repository_id", "path", "language", "extension", "size", "loc", "hash", "parsed",
        *[F.when(F.col("parsed"), F.col(c)).otherwise(0).alias(c) for c in ("num_classes", "num_functions")],
        F.when(F.col("parsed"), F.col("imports")).otherwise(F.array().cast("array<struct<module:string,line:int>>")).alias("imports"),
        F.when(F.col("parsed"), F.col("complexity_score")).otherwise(0.0).alias("complexity_score"),
        F.size("symbols").alias("symbol_count"),
    ).withColumn("import_count", F.size("imports"))
    if dependents == "none":  # a refresh scores files without their dependents
        counted = slim.withColumn("dependents", F.lit(0).cast("long"))
    else:
        imports = slim.select("repository_id", F.explode("imports").alias("i")).select("repository_id", "i.module")
        hits = N.import_dependents(imports, slim.select("repository_id", "path"))
        counted = slim.hint("merge").join(hits, ["repository_id", "path"])  # files compress well: their size on disk says little
    scored = N.with_importance(counted)
    return scored.select(
        "id", "repository_id", "path", "language", "extension", "size", "loc", "hash", "num_classes", "num_functions",
        "imports", "complexity_score",
        F.when(F.col("parsed"), F.col("importance_score")).otherwise(0.0).alias("importance_score"),
        F.when(F.col("parsed"), F.col("importance_level")).otherwise("LOW").alias("importance_level"),
        F.lit(None).cast("string").alias("summary"),
    )


def vector_rows(chunks, dimensions=VE.DIMENSIONS, embedder=None):
    text = VE.embedding_text(F.col("file_path"), F.col("symbol_name"), F.col("symbol_type"), F.col("content"))
    return store.vector_rows(VE.embed(chunks.withColumn("_text", text), "_text", dimensions, embedder).drop("_text"))


def _written(df, label):
    folder = work_path(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def index_tree(tree, dependents="complete", dimensions=VE.DIMENSIONS, embedder=None, parsers=None):
    """Tables of a snapshot.  Every file is parsed and cut once: the nested rows and the chunks are written to the
    shared folder, and the tables below read only the columns they need from there."""
    parsed = _written(parsed_files(tree, parsers), "parsed")
    files, chunks = file_rows(parsed, dependents), _written(chunk_rows(parsed), "chunks")
    totals = N.repository_totals(files, chunks).join(
        N.language_maps(N.language_histogram(files)), "repository_id", "left"
    )
    return dict(
        files=files, symbols=symbol_rows(parsed), code_chunks=chunks,
        vectors=vector_rows(chunks, dimensions, embedder),
        totals=totals.withColumn("index_version", F.lit(PIPELINE_VERSION)),
    )


def write_index(tables, folder, version=1, repositories=None):
    """Write every table as a new version of its repositories; readers see it once all of it is written.

    Versions are folders of their own, so the rows may be read from an earlier version of the same store, and a
    repository that has no more rows in a table has none in its new version.  `repositories` (repository_id) are
    those that the version replaces, by default those of the totals.  Read with `store.read_current`.
    """
    touched = tables["totals"] if repositories is None else repositories
    written = {name: tables[name] for name in ("files", "symbols", "code_chunks", "vectors", "totals") if name in tables}
    store.write_version(written, folder, version, touched.select("repository_id").distinct())
