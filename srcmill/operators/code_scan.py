"""Rule findings over source files.  Rules are Spark expressions on nested per-file rows: no shuffle is needed."""

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import text as X
from ..functions.rows import each
from . import pyfacts

FINDING = "struct<issue_type:string,severity:string,message:string,line:int,suggestion:string>"


def finding(rule, texts, line, *fills):
    """A finding struct; `texts` is (severity, message, advice), and `fills` go into the gaps of the texts."""
    severity, message, advice = texts
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        as_column(rule).alias("issue_type"), as_column(severity).alias("severity"),
        _filled(message, fills).alias("message"), line.cast("int").alias("line"), _filled(advice, fills).alias("suggestion"),
    )


def _filled(text, fills):
    parts = text.split("{}")
    pieces = [F.lit(parts[0])]
    for part, fill in zip(parts[1:], fills):
        pieces += [fill, F.lit(part)]
    return F.concat(*pieces) if len(pieces) > 1 else pieces[0]


def known_finding(rule, line, *fills):
    return finding(rule, V.FINDINGS[rule], line, *fills)


def credential_rule(name, value):
    """Rule name for a credential-like literal, else NULL."""
    password = F.lower(name).contains("password") | F.lower(name).isin("passwd", "pwd")

    def judged(trimmed):
        suspicious = (
            (F.length(trimmed) >= 4)
            & ~F.lower(trimmed).isin(V.PLACEHOLDER_VALUES)
            & ~trimmed.rlike(V.TEMPLATE_VALUE)
        )
        return F.when(suspicious, F.when(password, "HARDCODED_PASSWORD").otherwise("HARDCODED_SECRET"))

    return F.when(name.rlike(r"(?iU)\A" + V.CREDENTIAL_NAME + r"\z"), X.bind(X.strip(value), judged))


def _limit_findings(item, limits, metrics):
    out = []
    for metric, low, high, rule, message, advice in limits:
        n = metrics[metric]
        severity = F.lit("MEDIUM") if high is None else F.when(n > high, "HIGH").otherwise("MEDIUM")
        found = finding(rule, (severity, message, advice), item["line"], item["name"], n.cast("string"))
        out.append(F.when(n > low, found))
    return out


def metric_findings(callables):
    """Length, parameter, complexity, nesting and class-size findings of an array of callables."""

    def of(c):
        length = c["end_line"] - c["line"]
        as_function = _limit_findings(
            c, V.FUNCTION_LIMITS,
            dict(length=length, params=c["params"], branches=c["branches_own"], nesting=c["nesting"]),
        )
        as_class = _limit_findings(c, V.CLASS_LIMITS, dict(length=length, methods=c["methods"]))
        return F.array_compact(
            F.when(c["kind"] == "class", F.array(*as_class)).otherwise(F.array(*as_function))
        )

    return F.flatten(F.transform(callables, of))


def _call_findings(c):
    callee, line = c["callee"], c["line"]
    sql = c["attribute"].isin(V.EXECUTE_METHODS) & F.exists(c["literals"], lambda t: t.rlike(V.SQL_START))
    shell = callee.isin(V.SHELL_CALLS) | (callee.isin(V.PROCESS_CALLS) & c["shell"])
    named = F.when(callee.isin(V.HASH_CALLS), F.element_at(F.split(callee, r"\."), -1)).when(
        callee == V.NAMED_HASH_CALL, F.lower(c["constant"])
    )
    weak = F.when(~c["waived"] & named.isin(V.WEAK_HASHES), F.concat(F.lit("WEAK_HASH_"), F.upper(named)))
    return F.array_compact(
        F.array(
            F.when(callee.isin(V.EVAL_CALLS), known_finding("UNSAFE_EVAL", line, callee)),
            F.when(callee.isin(V.PICKLE_CALLS), known_finding("UNSAFE_DESERIALIZATION", line)),
            F.when(sql, known_finding("SQL_INJECTION", line)),
            F.when(shell & (c["argument"] == "expression"), known_finding("COMMAND_INJECTION", line)),
            F.when(weak.isNotNull(), finding(weak, V.WEAK_HASH_CALLED, line)),
            F.when(~c["waived"] & callee.isin(V.DES_CALLS), known_finding("WEAK_CIPHER_DES", line)),
        )
    )


def python_security_findings(calls, assigns):
    """One finding per (line, rule); the first one is kept."""
    literals = F.array_compact(
        F.transform(
            assigns,
            lambda a: X.bind(
                credential_rule(a["name"], a["value"]),
                lambda rule: F.when(
                    rule.isNotNull(), finding(rule, V.CREDENTIAL, a["line"])
                ),
            ),
        )
    )
    every = F.concat(literals, F.flatten(F.transform(calls, _call_findings)))
    ranked = F.array_sort(
        F.transform(
            every, lambda f, i: F.struct(f["line"].alias("l"), f["issue_type"].alias("r"), i.alias("i"), f.alias("f"))
        )
    )
    first = lambda s, x, i: (i == 0) | ~F.get(s, i - 1)["l"].eqNullSafe(x["l"]) | ~F.get(s, i - 1)["r"].eqNullSafe(x["r"])
    return F.transform(
        X.bind(ranked, lambda s: F.filter(s, lambda x, i: first(s, x, i))), lambda x: x["f"]
    )


def python_smell_findings(bindings, used, callables):
    """Unused imports and functions without a body."""
    unused = F.filter(
        F.array_distinct(bindings), lambda b: ~F.array_contains(used, b["name"]) & (b["name"] != "__future__")
    )
    hollow = F.filter(
        callables, lambda c: (c["kind"] != "class") & c["hollow"] & (c["name"] != "__init__")
    )
    return F.concat(
        F.transform(unused, lambda b: known_finding("UNUSED_IMPORT", b["line"], b["name"])),
        F.transform(hollow, lambda c: known_finding("EMPTY_FUNCTION", c["line"], c["name"])),
    )


def generic_smell_findings(lines, language):
    """Debt comments in every language, print calls in Python."""
    tag_pattern = r"(?i)#\s*(" + "|".join(V.DEBT_TAGS) + ")"

    def of(line, i):
        return X.bind(F.upper(F.regexp_extract(line, tag_pattern, 1)), lambda tag: found(line, i, tag))

    def found(line, i, tag):
        debt = finding(
            F.concat(F.lit("TECHNICAL_DEBT_"), tag), V.FINDINGS["TECHNICAL_DEBT"], i + 1, tag, X.clip(X.strip(line), 60)
        )
        shown = known_finding("DEBUG_PRINT", i + 1, (i + 1).cast("string"))
        return F.array_compact(
            F.array(
                F.when(tag != "", debt), F.when((language == "python") & line.rlike(V.DEBUG_PRINT), shown)
            )
        )

    worth = F.filter(
        F.transform(lines, lambda line, i: F.struct(line.alias("t"), i.alias("i"))),
        lambda x: x["t"].contains("#") | x["t"].contains("print"),
    )
    return F.flatten(F.transform(worth, lambda x: of(x["t"], x["i"])))


def comment_spans(lines):
    """(first, last) zero-based line spans of block comments that open at the start of a line.

    Only lines with a comment mark are folded over, and the state holds spans, not lines.
    """
    marked = F.filter(
        F.transform(lines, lambda line, i: F.struct(line.alias("t"), i.alias("i"))),
        lambda x: x["t"].contains("*/") | x["t"].contains("/*"),
    )
    marks = F.transform(
        marked,
        lambda x: F.struct(
            x["i"].alias("i"), x["t"].rlike(r"(?U)^\s*/\*").alias("opens"), x["t"].contains("*/").alias("closes")
        ),
    )
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    state = "struct<open:int,spans:array<struct<a:int,b:int>>>"

    def step(acc, m):
        first = F.coalesce(acc["open"], m["i"])
        running = acc["open"].isNotNull()
        ends = m["closes"] & (running | m["opens"])
        return F.struct(
            F.when(ends, None).when(running, acc["open"]).when(m["opens"], m["i"]).cast("int").alias("open"),
            F.when(ends, F.array_append(acc["spans"], span(first, m["i"]))).otherwise(acc["spans"]).alias("spans"),
        ).cast(state)

    empty = F.struct(F.lit(None).cast("int").alias("open"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))
    return F.aggregate(
        marks, empty.cast(state), step,
        lambda acc: F.when(
            acc["open"].isNotNull(), F.array_append(acc["spans"], span(acc["open"], F.size(lines)))
        ).otherwise(acc["spans"]),
    )


def script_security_findings(lines, spans):
    """Credential literals and legacy hashes of JavaScript-like lines outside comments."""
    return X.bind(spans, lambda s: _script_security_findings(lines, s))


def _script_security_findings(lines, spans):
    worth = F.filter(
        F.transform(lines, lambda line, i: F.struct(line.alias("t"), i.alias("i"))),
        lambda x: (x["t"].contains("=") | x["t"].rlike("(?i)createHash"))
        & ~x["t"].rlike(r"(?U)^\s*(?:#|//)")
        & ~F.exists(spans, lambda s: x["i"].between(s["a"], s["b"])),
    )

    def of(x):
        name, value = (F.regexp_extract(x["t"], V.LITERAL_ASSIGNMENT, g) for g in (1, 3))
        # no name, no assignment
        rule = X.bind(name, lambda n: F.when(n != "", credential_rule(n, value)))
        algorithm = F.upper(F.regexp_extract(x["t"], V.WEAK_HASH_CALL, 1))
        return X.bind(F.struct(rule.alias("rule"), algorithm.alias("hash")), lambda b: found(x, b["rule"], b["hash"]))

    def found(x, rule, algorithm):
        return F.array_compact(
            F.array(
                F.when(rule.isNotNull(), finding(rule, V.CREDENTIAL, x["i"] + 1)),
                F.when(
                    algorithm != "",
                    finding(F.concat(F.lit("WEAK_HASH_"), algorithm), V.WEAK_HASH_REQUESTED, x["i"] + 1),
                ),
            )
        )

    return F.flatten(F.transform(worth, of))


def with_script_findings(files, text="text", language="language"):
    """Add `findings` to JavaScript/TypeScript files."""
    return files.withColumn(
        "findings",
        X.bind(
            X.split_lines(F.col(text)),
            lambda lines: F.concat(
                script_security_findings(lines, comment_spans(lines)), generic_smell_findings(lines, F.col(language))
            ),
        ),
    )


def with_python_findings(units, keep, text="text"):
    """Add `parsed` and `findings` to Python units (files or notebook cells)."""
    facts = pyfacts.with_python_facts(units, [*dict.fromkeys([*keep, text])], text)
    return facts.withColumn(
        "findings",
        F.concat(
            metric_findings(F.col("callables")),
            python_security_findings(F.col("calls"), F.col("assigns")),
            python_smell_findings(F.col("bindings"), F.col("used"), F.col("callables")),
            generic_smell_findings(X.split_lines(F.col(text)), F.lit("python")),
        ),
    ).select(*keep, text, "parsed", "findings")


def explode_findings(scanned, keep, offset=None, label=None):
    """One row per finding; lines and messages are moved into the file that a unit came from."""
    f = F.col("f")
    line = f["line"] if offset is None else f["line"] + F.col(offset)
    message = f["message"] if label is None else F.concat(F.col(label), f["message"])
    return each(scanned, "findings", "f", keep).select(
        *[c for c in keep if c not in (offset, label)],
        f["issue_type"].alias("issue_type"), f["severity"].alias("severity"), message.alias("message"),
        line.alias("line"), f["suggestion"].alias("suggestion"),
    )
