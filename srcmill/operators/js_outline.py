"""Imports and symbols of JavaScript/TypeScript files, as expressions on the text of one file."""

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as X

SYMBOLS = (
    "array<struct<name:string,type:string,start_line:int,end_line:int,parent_name:string,signature:string,"
    "docstring:string,complexity:double>>"
)


def js_imports(lines):
    """`import ... from` lines first, then `require` lines, each in line order."""

    def found(pattern):
        hits = F.transform(
            lines,
            lambda line, i: F.struct(
                F.regexp_extract(line, pattern, 1).alias("module"), (i + 1).cast("int").alias("line")
            ),
        )
        return F.filter(hits, lambda h: h["module"] != "")

    return F.concat(found(V.SCRIPT_IMPORT), found(V.SCRIPT_REQUIRE))


def _starts(text, pattern):
    """(line, match text) of every declaration: the text is cut in front of each match."""
    pieces = F.split(text, "(?mdU)(?=" + pattern[len("(?mdU)"):] + ")", -1)
    state = "struct<line:int,found:array<struct<piece:string,line:int>>>"
    return F.aggregate(
        pieces,
        F.struct(F.lit(1).alias("line"), F.array().alias("found")).cast(state),
        lambda acc, p: F.struct(
            (acc["line"] + X.occurrences(p, "\n")).alias("line"),
            F.when(
                p.rlike(r"\A" + pattern), F.array_append(acc["found"], F.struct(p.alias("piece"), acc["line"].alias("line")))
            ).otherwise(acc["found"]).alias("found"),
        ).cast(state),
        lambda acc: acc["found"],
    )


def block_end(net, start, last):
    """Last line of the block that starts on line `start`; `net` holds opened minus closed braces per line.

    Most blocks are short, so the next lines are tried before the rest of the file.
    """
    rest = F.greatest(last - start + 1, F.lit(0))
    tried = [
        F.when(F.lit(seen) < rest, _first_closed(F.slice(net, start, F.least(rest, F.lit(ahead))), start))
        for seen, ahead in ((0, 12), (12, 100), (100, 1_000_000_000))
    ]
    return F.coalesce(*tried, last)


def _first_closed(net, start):
    state = "struct<depth:int,i:int,end:int>"
    return F.aggregate(
        net,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("end")).cast(state),
        lambda s, n: F.struct(
            (s["depth"] + n).alias("depth"), (s["i"] + 1).alias("i"),
            F.coalesce(s["end"], F.when((s["depth"] + n <= 0) & (s["i"] > 0), start + s["i"])).alias("end"),
        ).cast(state),
        lambda s: s["end"],
    )


def js_complexity(code):
    return (F.lit(1) + X.pattern_hits(code, V.SCRIPT_BRANCHES)).cast("double")


def with_js_outline(files, text="text", imports="imports", symbols_name="symbols"):
    """Add imports and symbols (classes, then functions, then arrow functions); NULL where the text is NULL."""
    staged = files.withColumn("_lines", X.split_lines(F.col(text)))
    for name, pattern in (("_class", V.SCRIPT_CLASS), ("_function", V.SCRIPT_FUNCTION), ("_arrow", V.SCRIPT_ARROW)):
        staged = staged.withColumn(name, _starts(F.col(text), pattern))

    def symbols(found, pattern, kind, lines, net, last):
        def of(x):
            return X.bind(
                block_end(net, x["line"], last),
                lambda end: describe(x, F.regexp_extract(x["piece"], pattern, 1), end),
            )

        def describe(x, name, end):
            signature = {
                "_class": F.concat(F.lit("class "), name),
                "_function": F.concat(
                    F.lit("function "), name, F.lit("("), F.regexp_extract(x["piece"], V.SCRIPT_FUNCTION, 2), F.lit(")")
                ),
                "_arrow": F.concat(F.lit("const "), name, F.lit(" = () =>")),
            }[found]
            code = F.array_join(F.slice(lines, x["line"], F.greatest(end - x["line"] + 1, F.lit(0))), "\n")
            return F.struct(
                name.alias("name"), F.lit(kind).alias("type"), x["line"].alias("start_line"), end.alias("end_line"),
                F.lit(None).cast("string").alias("parent_name"), signature.alias("signature"),
                F.lit(None).cast("string").alias("docstring"),
                (js_complexity(code) if found == "_function" else F.lit(0.0)).alias("complexity"),
            )

        return F.transform(F.col(found), of)

    def every_symbol(lines):
        return X.bind(
            F.transform(lines, lambda t: (X.occurrences(t, "{") - X.occurrences(t, "}")).cast("int")),
            lambda net: F.concat(
                *[
                    symbols(found, pattern, kind, lines, net, F.size(lines))
                    for found, pattern, kind in (
                        ("_class", V.SCRIPT_CLASS, "class"), ("_function", V.SCRIPT_FUNCTION, "function"),
                        ("_arrow", V.SCRIPT_ARROW, "function"),
                    )
                ]
            ),
        )

    out = staged.withColumn(imports, js_imports(F.col("_lines"))).withColumn(
        symbols_name, X.bind(F.col("_lines"), every_symbol).cast(SYMBOLS)
    )
    return out.drop("_lines", "_class", "_function", "_arrow")
