"""Licence scan: parts of a text compared with licence templates by the Dice coefficient over word bigrams.

DataFrame functions only; nothing is shuffled.
"""

import json
import math
import re

from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .tables import WORD, ascii_lower

#: Templates travel as a literal of the plan; more than this are refused.
MAX_TEMPLATE_CHARS = 1 << 20
#: What lies between two words.
NO_WORD = WORD.replace("[^", "[")


def _bigrams(text):
    words = re.findall(WORD, text.translate({c: c + 32 for c in range(65, 91)}))
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def prepared(templates, threshold):
    """A row per template: its bigrams and the sizes that a text within the threshold can have.

    Dice 2c / (a + b) >= t with c <= min(a, b) bounds a by t / (2 - t) * b and (2 - t) / t * b.
    """
    assert sum(map(len, templates.values())) <= MAX_TEMPLATE_CHARS, "templates are bounded by MAX_TEMPLATE_CHARS"
    rows = []
    for name, text in templates.items():
        grams = _bigrams(text)
        least = math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9)
        most = math.floor((2 - threshold) / threshold * len(grams) + 1e-9)
        if grams:
            rows.append({"licence": name.split("/")[0], "least": least, "most": most, "grams": grams})
    return rows


def signal_words(rows):
    """Words of which every text within the threshold holds one, with the bigrams in which it does: {word: [bigram]}.

    A match shares at least `least` bigrams of the template, so of any len - least + 1 of them one is in the text.
    Those of long words are taken, as they are rare; of words already taken first, so that there are few.
    """
    chosen = {}
    for row in rows:
        wanted = len(row["grams"]) - row["least"] + 1
        longer = {g: max(g.split(), key=len) for g in row["grams"]}
        for gram in sorted(longer, key=lambda g: (-len(longer[g]) - (longer[g] in chosen), -len(g), g))[:wanted]:
            if gram not in chosen.setdefault(longer[gram], []):
                chosen[longer[gram]].append(gram)
    return chosen


def signalled(lowered, rows):
    """Column: whether a lower-cased text holds one of the signal bigrams; a plain look for a word spares the pattern."""
    found = F.lit(False)
    for word, grams in signal_words(rows).items():
        pairs = "|".join(NO_WORD.join(map(re.escape, g.split())) for g in grams)
        found = found | (lowered.contains(word) & lowered.rlike(pairs))
    return found


def matches(text="text", templates=TEMPLATES, threshold=0.8):
    """Column array<struct<part, licence, score>>: the parts of a text that are a licence, with their best template.

    Parts are the whole text, its paragraphs and its lines (equal parts once), numbered from 0 in that order.  Words
    are taken after A-Z are lower-cased; a part of fewer than two words matches nothing, nor does a null or empty
    text.  Equal scores go to the smaller licence name.
    """
    rows = prepared(templates, threshold)
    literal = F.from_json(F.lit(json.dumps(rows)), "array<struct<licence:string,least:int,most:int,grams:array<string>>>")
    lowered = ascii_lower(F.col(text))

    def bind(value, function):
        return F.element_at(F.transform(F.array(value), function), 1)

    def best(words, number):
        grams = F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
        score = lambda t, g: F.size(F.array_intersect(t["grams"], g)) * 2.0 / (F.size(t["grams"]) + F.size(g))
        # array_max over (score, name reversed by sign is not possible for text): highest score first, then smallest name
        fits = lambda g: F.filter(
            F.transform(
                F.filter(literal, lambda t: F.size(g).between(t["least"], t["most"])),
                lambda t: F.struct((-score(t, g)).alias("minus"), t["licence"].alias("licence")),
            ),
            lambda m: m["minus"] <= -threshold,
        )
        return bind(grams, lambda g: bind(F.array_min(fits(g)), lambda m: F.struct(number.alias("part"), m["licence"].alias("licence"), (-m["minus"]).alias("score"))))

    parts = F.array_distinct(F.concat(F.array(lowered), F.split(lowered, r"\n[ \t]*\n"), F.split(lowered, r"\n")))
    found = F.filter(
        F.transform(parts, lambda part, number: best(F.regexp_extract_all(part, F.lit(WORD), F.lit(0)), number)),
        lambda m: m["licence"].isNotNull(),
    )
    return F.when(signalled(lowered, rows), found).otherwise(F.array().cast("array<struct<part:int,licence:string,score:double>>"))


def scan(docs, templates=TEMPLATES, threshold=0.8, text="text", name="licences"):
    """The documents with the column `name` of `matches`; rows and other columns stay as they are."""
    return docs.withColumn(name, matches(text, templates, threshold))
