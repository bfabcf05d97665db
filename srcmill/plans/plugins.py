"""Parsers and analyzers of the caller's own as table functions that SQL can call.

A parser maps a text to the fields of `index.OUTLINE`; an analyzer sees the files of a repository one after the other,
in the order of their paths, and yields findings.  Both take a table argument and check its columns when a query is
analyzed:

    SELECT * FROM parse_ruby(TABLE(SELECT file_id, text FROM files))
    SELECT * FROM twins(TABLE(SELECT repository_id, path, text FROM files))

An analyzer's table is partitioned by repository and sorted by Spark; rows stream through, so what an analyzer keeps
from file to file is all that it holds.
"""

from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


def _needs(table, columns):
    if not table.isTable:
        raise ValueError("a table argument is needed: TABLE(...)")
    kinds = {f.name: f.dataType for f in table.dataType.fields}
    missing = [c for c in columns if c not in kinds]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return kinds


def register_parser(spark, name, parse):
    """A table function (file_id, text) -> (file_id, name, type, start_line, end_line, complexity, error).

    A file that can't be parsed is a row with an error.  `parse` is a function text -> dict(error, parsed_symbols, ...).
    """

    class Parser:
        @staticmethod
        def analyze(files: AnalyzeArgument) -> AnalyzeResult:
            kinds = _needs(files, ["file_id", "text"])
            return AnalyzeResult(StructType([
                StructField("file_id", kinds["file_id"]), StructField("name", StringType()), StructField("type", StringType()), StructField("start_line", IntegerType()),
                StructField("end_line", IntegerType()), StructField("complexity", DoubleType()), StructField("error", StringType()),
            ]))

        def eval(self, row):
            try:
                found = parse(row["text"] or "")
            except Exception as problem:  # of one file; the others go on
                found = dict(error=f"{type(problem).__name__}: {problem}", parsed_symbols=[])
            if found.get("error"):
                yield row["file_id"], None, None, None, None, None, found["error"]
                return
            for s in found["parsed_symbols"]:
                yield row["file_id"], s["name"], s["type"], s["start_line"], s["end_line"], s["complexity"], None

    spark.udtf.register(name, udtf(Parser))


def register_analyzer(spark, name, make):
    """A table function (repository_id, path, text) -> (repository_id, path, issue_type, severity, message, line).

    `make()` gives, once a repository, a function (path, text) -> findings (issue_type, severity, message, line).
    """

    class Analyzer:
        def __init__(self):
            self.look = make()

        @staticmethod
        def analyze(files: AnalyzeArgument) -> AnalyzeResult:
            kinds = _needs(files, ["repository_id", "path", "text"])
            return AnalyzeResult(
                StructType([
                    StructField("repository_id", kinds["repository_id"]), StructField("path", StringType()), StructField("issue_type", StringType()),
                    StructField("severity", StringType()), StructField("message", StringType()), StructField("line", IntegerType()),
                ]),
                partitionBy=[PartitioningColumn("repository_id")], orderBy=[OrderingColumn("path")],
            )

        def eval(self, row):
            for issue_type, severity, message, line in self.look(row["path"], row["text"] or ""):
                yield row["repository_id"], row["path"], issue_type, severity, message, line

    spark.udtf.register(name, udtf(Analyzer))
