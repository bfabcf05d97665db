"""URL filter: given rules first, then association rules between URL tokens and labels, mined by FP-growth.

DataFrame and Spark ML functions only.
"""

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from .tables import ascii_lower, stored

# The rules of the contract as (rule, verdict); a rule is a host and the start of a path.
GIVEN_RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)
BLOCKED = "label=block"
ALLOWED = "label=allow"


def host(url="url"):
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty for null or a url without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url="url"):
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host_column, path_column, rules=GIVEN_RULES):
    """Struct (rule, verdict) of the longest rule that fits host (or a domain above it) and path; null if none does.

    The rules are a short literal list; of two equal rules the first holds.
    """
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][0]), i))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for i in reversed(order):
        domain, slash, start = rules[i][0].partition("/")
        fits = ((host_column == domain) | host_column.endswith(f".{domain}")) & path_column.startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(rules[i][0]).alias("rule"), F.lit(rules[i][1]).alias("verdict"))).otherwise(found)
    return found


def tokens(url="url"):
    """Distinct tokens of a url: labels of the host, parts of the path with digits as #, names of the query.

    Sorted, so that urls with the same tokens have the same array.
    """
    parts = lambda kind, text, split: F.transform(
        F.filter(F.split(text, split), lambda t: t != ""), lambda t: F.concat(F.lit(kind), F.regexp_replace(ascii_lower(t), r"\d+", "#"))
    )
    query = F.coalesce(F.regexp_extract(F.col(url), r"\?([^#]*)", 1), F.lit(""))
    names = F.transform(F.split(query, "&"), lambda t: F.substring_index(t, "=", 1))
    return F.array_sort(F.array_distinct(F.concat(
        parts("host=", host(url), r"\."),
        parts("path=", path(url), r"[/._-]"),
        F.transform(F.filter(names, lambda t: t != ""), lambda t: F.concat(F.lit("query="), ascii_lower(t))),
    )))


def mine_rules(labelled, min_support=0.001, min_count=20, min_confidence=0.5, url="url", blocked="blocked"):
    """Rules(rule_id, tokens, confidence, support) from labelled urls: token sets that lead to the label `block`.

    Rows with a null url or label are no transactions.  A rule must hold for `min_support` of the labelled urls and
    `min_count` of them; it is pruned if a part of its tokens alone is a rule of at least its confidence.  The number of rules is bounded by `min_support`: it doesn't
    grow with the urls.  Without labelled rows there are no rules.
    """
    baskets = (
        labelled.filter(F.col(url).isNotNull() & F.col(blocked).isNotNull())
        .select(F.array_append(tokens(url), F.when(F.col(blocked), BLOCKED).otherwise(ALLOWED)).alias("items"))
    )
    min_support = max(min_support, min_count / max(1, baskets.count()))
    if min_support > 1:
        return baskets.limit(0).selectExpr("0L as rule_id", "items as tokens", "0D as confidence", "0D as support")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = (
        model.associationRules.filter(F.col("consequent") == F.array(F.lit(BLOCKED)))
        .filter(~F.array_contains("antecedent", ALLOWED) & (F.col("support") >= min_support))
        .select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    )
    found = stored(found.withColumn("rule_id", F.xxhash64(F.concat_ws(" ", "tokens"))), "url-rules")
    parts = found.select(F.col("rule_id").alias("part_id"), F.size("tokens").alias("part_size"), F.col("confidence").alias("part_confidence"), F.explode("tokens").alias("token"))
    # a rule's tokens that another rule has too; all of the other's: it is a part of this one
    covered = (
        found.select("rule_id", "confidence", F.size("tokens").alias("whole_size"), F.explode("tokens").alias("token"))
        .join(parts, "token")
        .filter((F.col("part_size") < F.col("whole_size")) & (F.col("part_confidence") >= F.col("confidence")))
        .groupBy("rule_id", "part_id", "part_size").count()
        .filter(F.col("count") == F.col("part_size"))
        .select("rule_id").distinct()
    )
    return found.join(covered, "rule_id", "left_anti").select("rule_id", "tokens", "confidence", "support")


def matched(sets, rules):
    """The best rule of every token set: sets(key, tokens) -> (key, rule_id, confidence); sets without a rule are left out.

    Inverted index: the rules' tokens are the index; a rule fits a set if all its tokens are met.  Highest confidence
    first, then support, then rule_id.
    """
    index = rules.select("rule_id", "confidence", "support", F.size("tokens").alias("wanted"), F.explode("tokens").alias("token"))
    return (
        sets.select("key", F.explode("tokens").alias("token")).join(index, "token")
        .groupBy("key", "rule_id", "wanted", "confidence", "support").agg(F.count("*").alias("met"))
        .filter(F.col("met") == F.col("wanted"))
        .groupBy("key").agg(F.max(F.struct("confidence", "support", "rule_id")).alias("best"))
        .select("key", "best.rule_id", "best.confidence")
    )


def judge(pages, mined, given=GIVEN_RULES, url="url"):
    """pages with host, path, rule, verdict, mined_rule, confidence (in place of columns of these names).

    The longest given rule decides; where none fits, a url that a mined rule matches is blocked, any other allowed.
    Null and empty urls have no tokens and are allowed unless a given rule fits.  Urls are matched once per distinct
    token set, so repeated hosts and pages cost one match.
    """
    made = ("host", "path", "rule", "verdict", "mined_rule", "confidence")
    row = F.struct(*(F.col(f"`{c}`") for c in pages.columns if c not in made)).alias("row")
    rows = pages.select(row, host(url).alias("host"), path(url).alias("path"), tokens(url).alias("tokens"))
    rows = rows.withColumn("key", F.to_json("tokens")).withColumn("given", given_rule(F.col("host"), F.col("path"), given))
    best = matched(rows.select("key", "tokens").distinct(), mined).select(F.col("key").alias("set"), "rule_id", "confidence")
    joined = rows.join(best, F.col("key") == F.col("set"), "left")
    return joined.select(
        "row.*", "host", "path", F.col("given.rule").alias("rule"),
        F.coalesce("given.verdict", F.when(F.col("rule_id").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("given").isNull(), F.col("rule_id")).alias("mined_rule"),
        F.when(F.col("given").isNull(), F.col("confidence")).alias("confidence"),
    )


def labelled_pages(pages, labels):
    """Urls with a label: that of the document whose number the path ends in; toxic or poor documents are to be blocked."""
    numbered = pages.select("url", F.expr("try_cast(regexp_extract(url, '://[^/?#]*/(?:[^?#]*/)?([0-9]{1,18})(?:[./?#]|$)', 1) as bigint)").alias("number"))
    bad = F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad")
    judged = labels.groupBy("doc_id").agg(bad)
    return numbered.join(judged, F.col("number") == F.col("doc_id")).select("url", (F.col("bad") == 1).alias("blocked"))
