"""Cutting files into line-true chunks.

A file row carries its text and its nested symbols or sections, so every chunker below is a narrow
transformation: lines are sliced inside the row and only finished chunks are exploded.
"""

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as X
from ..functions.rows import each

CHUNK = (
    "struct<content:string,start_line:int,end_line:int,symbol_name:string,symbol_type:string,parent_name:string,"
    "language:string>"
)
NO_CHUNKS = f"array<{CHUNK}>"


def _chunk(content, start, end, name=None, kind=None, parent=None, language=None):
    text = lambda v: F.lit(v).cast("string") if v is None or isinstance(v, str) else v
    return F.struct(
        content.alias("content"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"),
        text(name).alias("symbol_name"), text(kind).alias("symbol_type"), text(parent).alias("parent_name"),
        text(language).alias("language"),
    )


def _blocks(lines, first_line, size, **labels):
    """Fixed blocks of a line array whose first element stands on `first_line`; blank blocks are left out."""
    count = F.size(lines)
    made = F.transform(
        F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)), F.lit(size)),
        lambda i: _chunk(
            F.array_join(F.slice(lines, i + 1, size), "\n"), first_line + i,
            first_line + F.least(i + size, count) - 1, **labels,
        ),
    )
    return F.filter(made, lambda c: X.not_blank(c["content"]))


@X.bound
def line_blocks(lines, size=V.BLOCK_LINES):
    """Chunks of a file without symbols."""
    return _blocks(lines, F.lit(1), size, kind="file_chunk")


@X.bound
def symbol_blocks(lines, symbols, size=V.BLOCK_LINES):
    """One chunk per symbol in start order; long symbols are cut into blocks with their true line numbers."""
    ordered = F.array_sort(symbols, lambda a, b: a["start_line"] - b["start_line"])

    def of(s):
        labels = dict(name=s["name"], kind=s["type"], parent=s["parent_name"])

        def cut(own):
            content = F.array_join(own, "\n")
            whole = F.array(_chunk(content, s["start_line"], s["end_line"], **labels))
            return F.when(F.size(own) > size, _blocks(own, s["start_line"], size, **labels)).when(
                F.length(X.strip(content)) >= V.MIN_SYMBOL_CHARS, whole
            ).otherwise(F.array().cast(NO_CHUNKS))

        height = F.greatest(s["end_line"] - s["start_line"] + 1, F.lit(0))
        return X.bind(F.slice(lines, s["start_line"], height), cut)

    return F.flatten(F.transform(ordered, of))


@X.bound
def gap_blocks(lines, symbols, min_lines=V.MIN_GAP_LINES):
    """Runs of lines outside every symbol, from the ordered symbol ranges (no line is exploded)."""
    state = "struct<next:int,gaps:array<struct<a:int,b:int>>>"
    gap = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    last = F.size(lines)
    # symbols that start behind the last line cover nothing
    ordered = F.array_sort(
        F.filter(symbols, lambda s: (s["start_line"] <= last) & (s["end_line"] >= s["start_line"])),
        lambda a, b: a["start_line"] - b["start_line"],
    )
    add = lambda gaps, a, b: F.when(b - a + 1 >= min_lines, F.array_append(gaps, gap(a, b))).otherwise(gaps)
    gaps = F.aggregate(
        ordered,
        F.struct(F.lit(1).alias("next"), F.array().alias("gaps")).cast(state),
        lambda acc, s: F.struct(
            F.greatest(acc["next"], s["end_line"] + 1).alias("next"),
            add(acc["gaps"], acc["next"], s["start_line"] - 1).alias("gaps"),
        ).cast(state),
        lambda acc: add(acc["gaps"], acc["next"], last),
    )
    made = F.transform(
        gaps,
        lambda g: _chunk(F.array_join(F.slice(lines, g["a"], g["b"] - g["a"] + 1), "\n"), g["a"], g["b"],
                         kind="module_level"),
    )
    return F.filter(made, lambda c: F.length(X.strip(c["content"])) >= V.MIN_SYMBOL_CHARS)


@X.bound
def section_blocks(lines, sections, fragment=V.FRAGMENT_CHARS, limit=V.SECTION_CHARS):
    """Pack the lines of each section into chunks; long lines are cut into fragments first.

    Every fragment carries a line break behind it.  A full buffer keeps its last line break, the final one of a
    section is stripped.
    """
    state = f"struct<chunks:{NO_CHUNKS},buffer:string,start:int,end:int>"

    def of(s):
        labels = dict(name=s["name"], kind=s["type"], parent=None, language=s["language"])
        fragments = F.flatten(
            F.transform(
                F.slice(lines, s["start_line"], s["end_line"] - s["start_line"] + 1),
                lambda line, i: F.transform(
                    F.sequence(F.lit(1), F.greatest(F.length(line), F.lit(1)), F.lit(fragment)),
                    lambda o: F.struct(line.substr(o, F.lit(fragment)).alias("t"), (s["start_line"] + i).alias("n")),
                ),
            )
        )

        def step(acc, x):
            held = acc["buffer"]
            full = (held != "") & (F.length(held) + F.length(x["t"]) > limit)
            kept = F.when(full, "").otherwise(held)
            return F.struct(
                F.when(full, F.array_append(acc["chunks"], _chunk(held, acc["start"], acc["end"], **labels)))
                .otherwise(acc["chunks"]).alias("chunks"),
                F.concat(kept, x["t"], F.lit("\n")).alias("buffer"),
                F.when(kept == "", x["n"]).otherwise(acc["start"]).alias("start"),
                x["n"].alias("end"),
            ).cast(state)

        start = F.struct(
            F.array().alias("chunks"), F.lit("").alias("buffer"), s["start_line"].alias("start"),
            s["start_line"].alias("end"),
        ).cast(state)
        return F.aggregate(
            fragments, start, step,
            lambda acc: F.when(
                X.not_blank(acc["buffer"]),
                F.array_append(
                    acc["chunks"],
                    _chunk(F.regexp_replace(acc["buffer"], r"(?U)\s+\z", ""), acc["start"], acc["end"], **labels),
                ),
            ).otherwise(acc["chunks"]),
        )

    return F.flatten(F.transform(sections, of))


def file_chunks(lines, symbols, size=V.BLOCK_LINES):
    """Chunks of a parsed file: blocks without symbols, else symbol chunks followed by the gaps between them."""
    return F.when(F.size(symbols) == 0, line_blocks(lines, size)).otherwise(
        F.concat(symbol_blocks(lines, symbols, size), gap_blocks(lines, symbols))
    )


def explode_chunks(files, chunks, keep):
    """One row per chunk with its dense per-file index."""
    return each(files, chunks, "_c", keep, position="chunk_index").select(
        *keep, "chunk_index", "_c.content", "_c.start_line", "_c.end_line", "_c.symbol_name", "_c.symbol_type",
        "_c.parent_name", F.col("_c.language").alias("chunk_language"),
    )


def chunks_in_symbol(chunks, symbols):
    """Chunks that lie inside a symbol of the same file and name."""
    s = symbols.select(
        F.col("file_id").alias("_f"), F.col("name").alias("_n"), F.col("start_line").alias("_a"),
        F.col("end_line").alias("_b"),
    )
    return chunks.join(
        s,
        (F.col("file_id") == F.col("_f")) & (F.col("symbol_name") == F.col("_n"))
        & (F.col("start_line") >= F.col("_a")) & (F.col("end_line") <= F.col("_b")),
        "left_semi",
    )
