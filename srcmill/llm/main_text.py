"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block elements.  First pass: each block is decided by the containers it lies in, its link
density, length and stop-word density, or left open.  Second pass: open blocks take the label of the nearest decided
block around them.
"""

import html as references
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

# Element names of HTML by their role, and names that pages give to what surrounds an article.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math object canvas audio video select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AROUND_TAGS = frozenset("nav footer aside form dialog menu head fieldset search".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
AROUND_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar navigation menu submenu breadcrumb "
    "breadcrumbs sidebar aside rail footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay alert newsletter subscribe "
    "subscription signup login comment comments commentlist respond discussion disqus replies share sharing social related recommended recommendations "
    "widget widgets pagination pager toolbar copyright disclaimer search".split()
)
AROUND_STARTS = ("advert", "cookie", "sidebar", "newsletter", "comment", "sponsor", "promo", "footer", "navbar", "breadcrumb", "banner")
NOT_ITSELF = frozenset("has with no without show hide".split())
COMMENT_NAMES = frozenset("comment comments commentlist respond discussion disqus replies reply".split())
STOP_WORDS = frozenset(
    # English, French, German, Spanish function words
    "a an and are as at be by for from in is it of on or that the this to was were which with "
    "au aux ce de des du elle en est et il la le les leur ne par pas pour que qui se son sur un une "
    "als auch auf aus das dem den der die ein eine er es für ist mit nicht sie sind und von zu "
    "al como con del el ella entre las lo los más no para pero por su también y".split()
)

TOKEN = re.compile(
    r"<!--(?s:.*?)(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)"
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
WORDS = re.compile(r"[^\W\d_]+")
NAMES = re.compile(r"[a-z]+")

SHORT, LONG = 70, 200
LINKS, MANY_STOPS, FEW_STOPS = 0.4, 0.2, 0.08


class Block:
    __slots__ = ("around", "inside", "linked", "parts")

    def __init__(self, around, inside):
        self.around, self.inside, self.parts, self.linked = around, inside, [], 0


def _is_around(name, attributes, inside):
    """Whether an element holds what surrounds an article: by its name, role, class, id or being hidden."""
    if name in AROUND_TAGS or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    found = {k.lower(): references.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if found.get("role", "").lower() in AROUND_ROLES or "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    named = set()
    for given in re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{found.get('class', '')} {found.get('id', '')}").lower().split():
        words = NAMES.findall(given)
        named.update(() if NOT_ITSELF & set(words) else words)  # has-sidebar is no sidebar
    if name == "article":
        return bool(named & COMMENT_NAMES)
    return bool(named & AROUND_NAMES) or any(n.startswith(AROUND_STARTS) for n in named) or "header" in named and not inside


def blocks(page):
    """The blocks of a page, in order: text runs between block elements, with what they lie in."""
    out, stack = [], []  # stack: (element, around, inside an article)
    around = inside = False
    links, breaks, at = 0, 0, 0
    current = Block(False, False)

    def add(text):
        nonlocal breaks
        if text and (not text.isspace() or current.parts):
            if not text.isspace():
                breaks = 0
            current.parts.append(text)
            if links:
                current.linked += len("".join(references.unescape(text).split()))

    def close():
        nonlocal current, breaks
        if current.parts:
            out.append(current)
        current, breaks = Block(around, inside), 0

    while True:
        found = TOKEN.search(page, at)
        add(page[at : found.start()] if found else page[at:])
        if not found:
            break
        at = found.end()
        name = found["name"] or found["name2"]
        if not name:
            continue
        name, ending, rest = name.lower(), found["end"] or found["end2"], found["rest"] or found["rest2"] or ""
        if name in RAW and not ending:
            if not rest.endswith("/") or name not in ("svg", "math"):
                close_at = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = close_at.end() if close_at else len(page)
            continue
        if name == "br":
            breaks += 1
            add(" ")
            if breaks > 1:
                close()
            continue
        if name == "a":
            links = 0 if ending else 1
            continue
        if name not in BLOCKS and name not in ("span",):
            continue
        if name in VOID:
            close()
            continue
        if ending:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is None:
                if name in BLOCKS:
                    close()
                continue
            del stack[depth:]
        else:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                stack.pop()  # its end tag may be left out
            if stack and stack[-1][0] == "p" and name in BLOCKS:
                stack.pop()
            above = stack[-1] if stack else (None, False, False)
            within = above[2] or name in ("article", "main")
            stack.append((name, name != "main" and (above[1] or _is_around(name, rest, within)), within))
            links = 0 if name in BLOCKS else links
        now = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if name in BLOCKS or now != (around, inside):
            around, inside = now
            close()
            current = Block(around, inside)
    around, inside = False, False
    close()
    return out


def first_label(text, linked, inside):
    """good, bad or None (open) of a block that isn't in a surrounding container."""
    size = len("".join(text.split()))
    if size and linked / size > LINKS:
        return "bad"
    if len(text) < SHORT:
        return None
    words = WORDS.findall(text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= MANY_STOPS or stops >= FEW_STOPS and len(text) > LONG:
        return "good"
    if stops >= FEW_STOPS or inside:
        return None  # an article may hold tables, code or other languages
    return "bad"


def main_text(page):
    """The article of a page; empty for null, empty or article-less pages.

    Blocks in surrounding containers are bad and are no neighbours to others.  Open blocks take the label of the
    nearest decided block, by characters between, first among blocks of their own side of the article's border; at
    equal distance good wins.  Where nothing is decided, blocks in an article are good and others bad.
    """
    found = []
    for block in blocks(page or ""):
        text = " ".join(references.unescape("".join(block.parts)).split())
        if text and not block.around:
            found.append((text, first_label(text, block.linked, block.inside), block.inside))
    labels = [label for _, label, _ in found]
    nearest = {}
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last = {}
        place = 0
        for i in order:
            text, label, inside = found[i]
            if label:
                last[inside] = (label, place + len(text))
            elif inside in last:
                kind, end = last[inside]
                distance = place - end
                nearest[i] = min(nearest.get(i, (distance, kind != "good")), (distance, kind != "good"))
            place += len(text)
    if any(inside for _, _, inside in found):
        labels = [label if inside else "bad" for label, (_, _, inside) in zip(labels, found)]
    for i, (_, _, inside) in enumerate(found):
        if labels[i] is None:
            labels[i] = ("bad" if nearest[i][1] else "good") if i in nearest else ("good" if inside else "bad")
    return "\n\n".join(text for (text, _, _), label in zip(found, labels) if label == "good")


def extract(column="html"):
    """Column: the main text of a page."""

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], dtype=object)

    return extracted(F.col(column))
