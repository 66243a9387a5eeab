"""Main text of web pages by the maximum-scoring contiguous region.

A page is a sequence of tokens: words, and tags by name. Words score positive and tags negative; the contiguous region of the highest
sum is the content. Weights come from labelled pages, whose content region is known: a tag costs more the rarer it is inside content
regions, so that crossing what only stands around content costs more than a boilerplate block can bring. Elements that never
hold content (navigation, forms, scripts, and elements whose class or id says advert, comments and the like) score nothing, with
their words and tags, and are left out of the text even when the region runs across them.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is not text.
RAW = frozenset({"script", "style", "template", "noscript", "svg", "iframe", "object", "canvas", "textarea", "title"})
#: Elements that never hold content.
AROUND = frozenset({"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "head"}) | RAW
#: Words of a class, id or role that say the same.
AROUND_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies reply share "
    "sharing sidebar social sponsor sponsored subscribe widget complementary contentinfo search".split()
)
#: Elements that stay within a line of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of the same kind, as writers leave these open.
SELF_CLOSING = frozenset({"p", "li", "dt", "dd", "tr", "td", "th", "option"})
#: Most pages the weights are fitted on.
LABELLED_PAGES = 1000
LABELLED_CHARS = 50_000
#: Elements that hold a page or its article: a class word does not make these stand around it.
WHOLE = frozenset({"html", "body", "main"})
#: Class words that begin like this speak of the page, as `has-sidebar` does.
PAGE_WORDS = ("has-", "with-", "no-", "without-")
#: Elements that an article may stand in, as writers leave them open or wrap whole pages in them.
OPEN_AROUND = frozenset({"nav", "header", "form"})
#: Elements that running text is made of.
TEXT = INLINE | frozenset("blockquote br dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li ol p pre table tbody td th thead tr ul".split())
#: Elements that group text, of which pages have any number.
GROUPS = frozenset({"section", "article", "main", "div"})
UNSEEN, UNSEEN_TEXT = -1.0, -0.1

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # A quote only counts behind =, so that a stray one does not swallow text; nothing is tried twice.
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _is_around(name: str, rest: str, first: bool) -> bool:
    """Whether an element never holds content, by its name or by the words of its class, id or role.

    Of an element of running text a whole word has to say so, of others a part of one (`ad-slot`). `first`: no article has begun yet.
    """
    if name in AROUND:
        return True
    if name in WHOLE or (name == "article" and first):
        return False
    said = " ".join("".join(x) for x in NAMES.findall(rest)).lower().split()
    parts = said if name in TEXT - INLINE else [x for word in said if not word.startswith(PAGE_WORDS) for x in re.split(r"[^a-z]+", word)]
    return not AROUND_NAMES.isdisjoint(parts)


def tokens(page: str) -> list[tuple[str, str, bool, bool]]:
    """(kind, text, around, content) in page order: kind is a tag as `p`, `/p`, or `#` for a run of text.

    around: inside an element that never holds content. content: inside an element marked as the page's article. Tags whose
    name says nothing but whose class does are named by the mark, as `div!`. Unclosed elements end with their parent. The first article or main
    element is content even if what it stands in is marked by its class, or is a nav, header or form.
    """
    out = []
    first = True
    stack: list[tuple[str, bool, bool]] = []
    at, n = 0, len(page)

    def state():
        return (stack[-1][1], stack[-1][2]) if stack else (False, False)

    while at < n:
        cut = page.find("<", at)
        found = TOKEN.match(page, cut) if cut >= 0 else None
        if cut < 0 or not found:
            # Text up to the end, or a lone < in text.
            end = n if cut < 0 else cut + 1
            out.append(("#", page[at:end], *state()))
            at = end
            continue
        if cut > at:
            out.append(("#", page[at:cut], *state()))
        at = found.end()
        if not found["name"]:
            continue
        name = found["name"].lower()
        around, content = state()
        if found["close"]:
            if any(x[0] == name for x in stack):
                while (ended := stack.pop())[0] != name:
                    pass
                # The end tag of an element belongs to it.
                around = ended[1]
            out.append(("/" + name, "", around, state()[1]))
            continue
        if name in SELF_CLOSING and stack and stack[-1][0] == name:
            stack.pop()
            around, content = state()
        marked = _is_around(name, found["rest"], first)
        begins = name == "article" or name == "main" or "articlebody" in found["rest"].lower()
        if begins and first and not marked:
            first = False
            around = any(x[0] in AROUND - OPEN_AROUND for x in stack)
        inside = content or begins
        out.append((name + "!" * (marked and name not in AROUND), "", around or marked, inside))
        if name in VOID or found["rest"].endswith("/"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        stack.append((name, around or marked, inside))
    return out


def fit(pages: list[str]) -> dict[str, float]:
    """Weight of each tag from pages of which part is marked as the article.

    A tag weighs minus the log odds that it stands outside content, times one more than the mean number of words that stand there
    unmarked in a page, and is never above -0.1. Words weigh 1. What stands in elements that never hold content is not counted,
    nor are pages without a mark.
    """
    inside: dict[str, int] = {}
    outside: dict[str, int] = {}
    around_words, labelled = 0, 0
    for page in pages:
        row = tokens(page)
        if not any(content and kind == "#" and text.strip() for kind, text, _, content in row):
            continue
        labelled += 1
        for kind, text, around, content in row:
            if around:
                continue
            if kind == "#":
                around_words += 0 if content else len(text.split())
            else:
                side = inside if content and kind not in ("article", "main") else outside
                side[kind] = side.get(kind, 0) + 1
    scale = 1 + around_words / max(1, labelled)
    return {
        k: -max(0.1, scale * float(np.log((outside.get(k, 0) + 1) / (inside.get(k, 0) + 1)))) for k in sorted(inside.keys() | outside.keys())
    }


def main_text(page: str, weights: dict[str, float]) -> str:
    """The blocks of the best region, one a line, white space made one space; empty if the page has no content words.

    Tags without a weight weigh UNSEEN, or UNSEEN_TEXT if text is made of them or grouped by them. What stands in elements that never hold content
    weighs 0: it is left out in any case, and an article goes on behind it however long it is.
    """
    row = tokens(page)
    score = np.zeros(len(row))
    for i, (kind, text, around, _) in enumerate(row):
        if around:
            continue
        if kind == "#":
            score[i] = len(text.split())
        else:
            score[i] = weights.get(kind, UNSEEN_TEXT if kind.strip("/!") in TEXT | GROUPS else UNSEEN)
    best, start, end, low, low_at, total = 0.0, 0, 0, 0.0, 0, 0.0
    for i, value in enumerate(score):
        total += value
        if total - low > best:
            best, start, end = total - low, low_at, i + 1
        if total < low:
            low, low_at = total, i + 1
    blocks: list[list[str]] = [[]]
    for kind, text, around, _ in row[start:end]:
        if kind == "#":
            if not around:
                blocks[-1].append(text)
        elif kind.strip("/!") not in INLINE and blocks[-1]:
            blocks.append([])
    lines = (" ".join(html.unescape("".join(block)).split()) for block in blocks)
    return "\n".join(line for line in lines if line)


def weights_of(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> dict[str, float]:
    """Weights from a bounded sample of pages: the LABELLED_PAGES first by a hash of the id, of those up to LABELLED_CHARS long."""
    order = F.xxhash64(F.col(id_col), F.lit(9))
    short = pages.where(F.length(html_col) <= LABELLED_CHARS)
    # The hashes alone find the last one wanted, so that no more pages than wanted are sent.
    last = short.select(order.alias("o")).orderBy("o").limit(LABELLED_PAGES).agg(F.max("o")).first()[0]
    some = short.where(order <= F.lit(last).cast("bigint")).select(html_col).limit(LABELLED_PAGES)
    return fit(some.toPandas()[html_col].tolist())


def extract(pages: DataFrame, weights: dict[str, float], html_col: str = "html", out: str = "text") -> DataFrame:
    """All columns of `pages` and the main text; a column of its name is replaced. A null page has an empty text."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(page, weights) if page else "" for page in column], dtype=object)

    return pages.withColumn(out, run(F.col(html_col)))
