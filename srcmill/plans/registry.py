"""The registered queries and the SQL each one is checked against."""

from ..session import spread

QUERIES = {}
SQL = {}


class Tables:
    """The given tables by name; `spread` deals a small one over all cores for heavy work per row."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def __call__(self, name):
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name):
        return spread(self(name))


def query(name, sql=None):
    def add(function):
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def stream_query(name, sql=None):
    """Like `query`, for functions that open file streams over the tables themselves."""

    def add(function):
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def sql_list(values):
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_in(values):
    return "(" + sql_list(values)[1:-1] + ")"


# lines of a document; a trailing line break does not open another line
SQL_LINES = (
    "CASE WHEN text = '' THEN []::VARCHAR[] WHEN right(text, 1) = chr(10) "
    "THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END"
)
