"""Column expressions over text.  All of them stay in the JVM."""

from functools import reduce, wraps

from pyspark.sql import functions as F

from . import fixed_values as V

LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def words_array(words):
    return F.array(*[F.lit(w) for w in words])


def any_word(words):
    """A regex that matches any of the words anywhere."""
    return "|".join(f"\\Q{w}\\E" for w in words)


def bind(value, body):
    """Evaluate `value` once and use it as often as `body` likes.

    Inside the functions that take lambdas Spark evaluates an expression again for every use and every element;
    a lambda variable is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound(function):
    """Bind the first argument of an expression-building function."""

    @wraps(function)
    def call(value, *args, **kwargs):
        return bind(value, lambda v: function(v, *args, **kwargs))

    return call


def split_lines(text):
    """Lines of a text; a trailing line break does not open another line."""
    return bind(
        F.split(text, LINE_BREAK, -1),
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p),
    )


def count_lines(text):
    open_end = (text != "") & ~F.right(text, F.lit(1)).rlike(LINE_BREAK)
    return F.regexp_count(text, F.lit(LINE_BREAK)) + F.when(open_end, 1).otherwise(0)


def not_blank(text):
    return text.rlike("(?U)\\S")


def strip(text):
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def words(text):
    """Distinct lower-case words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?U)\\b\\w+\\b"), F.lit(0)))


def search_words(text):
    """Words used for ranking: stop words removed, short ones kept."""
    return F.array_except(words(text), words_array(V.STOP_WORDS))


def keyword_words(text):
    """Words used to find candidates: only length matters here."""
    return F.filter(words(text), lambda w: F.length(w) >= V.MIN_KEYWORD_CHARS)


def count_contained(needles, text):
    """How many of the needles occur in the text."""
    return bind(F.lower(text), lambda t: F.size(F.filter(needles, lambda w: t.contains(w))))


def estimate_tokens(text):
    return F.coalesce(F.floor(F.length(text) / V.CHARS_PER_TOKEN), F.lit(0)).cast("long")


def clip(text, chars):
    return F.substring(text, 1, chars)


def occurrences(text, token):
    """Non-overlapping occurrences of a one-character token."""
    return F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))


def pattern_hits(text, patterns):
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in patterns])


def decode_utf8(content, errors="drop"):
    """Bytes to text: bad bytes are dropped (ingest) or shown as U+FFFD (scan)."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.replace(text, F.lit("\ufffd"), F.lit("")) if errors == "drop" else text


def json_pointer(part):
    return F.replace(F.replace(part, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def language_line(languages):
    """'python (3 files), go (1 files)' from a language map, largest first."""
    entries = F.array_sort(
        F.map_entries(languages),
        lambda a, b: F.when(a["value"] != b["value"], (b["value"] - a["value"]).cast("int")).otherwise(
            F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
        ),
    )
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit(" ("), e["value"].cast("string"), F.lit(" files)"))),
        ", ",
    )


def sound_json(text):
    """True for one complete JSON value.  The parser alone ignores what follows the first value, so the text must
    also hold inside an array and inside an object."""
    boxed = F.concat(F.lit("["), text, F.lit("]"))
    return F.coalesce(
        F.try_parse_json(text).isNotNull()
        & F.try_parse_json(boxed).isNotNull()
        & (F.json_array_length(boxed) == 1)
        & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull(),
        F.lit(False),
    )


def iso_timestamp(ts):
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def fingerprint(*parts):
    """Stable key over the JSON form of the parts."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def round_half_even(x):
    """Whole-number rounding, ties to even."""
    return F.bround(x.cast("double"), 0)
