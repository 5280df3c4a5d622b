"""Main text of web pages by the maximum-scoring contiguous region.

A page becomes a line of tags and words. A word scores by the elements around it: each tag name and each class, id and
role word has a weight, the log odds of its words to be the article's, learned from labelled pages (pages whose own
<article> or <main> element shows where the text is: a bounded sample, LABELLED_PAGES, none of it longer than
LABELLED_CHARS). A tag scores negative, by the weight of a small grid that agrees best with those pages. One linear scan
finds the contiguous region of greatest sum. Names of menus, headers, footers, sidebars, notices, adverts, forms and
comments only give a feature its weight before any page is seen, and say which parts inside the region go: a part so
named stays in if an <article> or <main> opens in it, or if it holds most of the page's words.

Blocks end at block-level tags and at <br>. Character references are decoded, white space in a block becomes one space,
and blocks are joined by a newline. A null or empty page gives the empty text, and so does one without words; of equal
regions the first and longest counts; an empty table gives an empty table; repeated rows each give a row.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of

LABELLED_PAGES, LABELLED_CHARS = 400, 200_000
#: Elements whose words are not the article's, and elements whose content isn't text at all (fixed values of HTML).
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "label", "head", "address"}
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "object", "canvas"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: What such a part's class, id or role is, or ends with after a hyphen or underscore, or begins with before one of PLACES.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "aside", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist",
    "complementary", "contentinfo", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "header", "login", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted", "related", "replies", "respond", "search", "share",
    "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
PLACES = {"area", "bar", "block", "body", "bottom", "box", "buttons", "container", "content", "form", "inner", "item", "items", "left", "links", "list", "main", "outer", "panel", "right", "section", "slot", "top", "unit", "wrap", "wrapper"}
#: Words before a name that make it a property of what is around: has-sidebar is no sidebar.
MODIFIERS = {"has", "with", "no", "not", "is", "without", "hide", "show", "sticky", "fixed", "under", "below", "above", "after", "before", "col", "row"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: How many features of what is around a word speak, the innermost; names of boilerplate parts always do. It bounds the work on pages nested without end.
AROUND = 512
#: What the words between two tags of a named part cost at most, in tags: they are removed, and the article may go on behind them.
PART_TAGS = 4
#: Weights of a tag; the first is used where no page is labelled.
GRID = (-0.05, -0.2, -0.01, -0.5)
#: Weight of a boilerplate feature before any page is seen, for how many pages that counts, and the bounds of a weight.
PRIOR, PRIOR_PAGES, MOST = -2.0, 5, 3.0
#: An element closes an open one of its own name up to one of these.
CLOSES_ITSELF = {"p", "li", "tr", "td", "th", "dt", "dd", "option"}
HOLDS = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "nav", "aside", "body", "blockquote", "form", "select"}


def is_name(word: str) -> bool:
    """Whether a class, id or role word names boilerplate."""
    parts = re.split(r"[-_]+", word)
    while len(parts) > 1 and parts[-1] in PLACES:
        parts.pop()
    return parts[-1] in NAMES and not MODIFIERS & set(parts[:-1])


def prior(feature: str) -> float:
    kind, _, word = feature.partition(":")
    return PRIOR if (word in BOILERPLATE if kind == "tag" else is_name(word)) else 0.0


def features_of(name: str, attributes: str) -> tuple[str, ...]:
    words = {w for m in ATTRIBUTE.finditer(attributes) for w in m[1].strip("\"'").lower().split()} if attributes else ()
    return (f"tag:{name}", *(f"name:{w}" for w in sorted(words)))


def segments(page: str) -> list[tuple[str, int, str, bool, tuple[tuple, tuple]]]:
    """A page as (kind, words, text, labelled, (features, features beyond the article)): kind t is a tag, b a tag that ends a block, w words, x a named part's words."""
    out: list = []
    # Open elements, each with the features of all around it up to an <article> or <main>, the innermost last, and those beyond.
    stack: list[tuple[str, tuple[tuple, tuple]]] = []
    held: dict[str, int] = {}
    at, size, inside, lower = 0, len(page), 0, None
    part, part_at, parts, named_by = None, 0, {}, {}  # the named part we are in, its depth, the places in `out` of its words, its features

    def close(depth: int) -> None:
        nonlocal part, inside
        for name, _ in stack[depth:]:
            held[name] -= 1
            inside -= name in ("article", "main")
        del stack[depth:]
        if part is not None and depth <= part_at:
            part = None

    def above(name: str, stops: set) -> int:
        """The depth of the innermost open element of this name; -1 if there is none, or one of stops is nearer."""
        if held.get(name):
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == name:
                    return n
                if stack[n][0] in stops:
                    break
        return -1

    while at < size:
        found = TOKEN.search(page, at)
        text = page[at : found.start() if found else size]
        if text and (words := html_lib.unescape(text).split() or ([" "] if text.isspace() else [])):
            lead, trail = text[:1].isspace(), text[-1:].isspace()
            n = 0 if words == [" "] else len(words)
            shown = (" " if lead and n else "") + " ".join(words) + (" " if trail and n else "")
            if part is not None:
                parts[part].append(len(out))
            out.append(("w", n, shown, inside > 0 and part is None, stack[-1][1] if stack else ((), ())))
        if not found:
            break
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), bool(found[1] or found[4]), found[3] or found[6] or ""
        out.append(("t" if name in INLINE or name in RAW else "b", 0, name, inside > 0, ((), ())))
        if closing:
            if (n := above(name, set())) >= 0:
                close(n)
        elif name in RAW and not attributes.rstrip().endswith("/"):
            lower = lower or page.lower()
            end = lower.find(f"</{name}", at)
            at = size if end < 0 else end
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            if name in CLOSES_ITSELF and (n := above(name, HOLDS)) >= 0:
                close(n)
            own = features_of("article-header" if name == "header" and inside else name, attributes)
            around, outer = stack[-1][1] if stack else ((), ())
            if name in ("article", "main"):
                part, around, outer = None, (), (*outer, *around)[-AROUND:]  # what holds the article says nothing of it
            elif part is None and name not in ("html", "body"):
                named = name in BOILERPLATE and not (name == "header" and inside) or any(is_name(f[5:]) for f in own[1:])
                if named or attributes and HIDDEN.search(attributes):
                    part, part_at = len(parts), len(stack)
                    parts[part] = []
                    named_by[part] = own
            stack.append((name, (around if name in ("html", "body") or set(own) <= set(around) else tuple(dict.fromkeys((*around, *own)))[-AROUND:], outer)))
            held[name] = held.get(name, 0) + 1
            inside += name in ("article", "main")
    total = sum(n for _, n, _, _, _ in out)
    for n, places in parts.items():
        most = 2 * sum(out[p][1] for p in places) > total
        for p in places:  # the name of what holds most of the page says nothing of it
            kind, words, text, labelled, (around, outer) = out[p]
            out[p] = ("w" if most else "x", words, text, labelled, (tuple(f for f in around if not most or f not in named_by[n]), outer))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Half-open bounds of the contiguous run of greatest sum; empty if no score is positive; the longest of equals."""
    best, total, start, bounds = 0.0, 0.0, 0, (0, 0)
    for n, x in enumerate(scores):
        if total < 0:
            total, start = 0.0, n
        total += x
        if total > best or total == best > 0:
            best, bounds = total, (start, n + 1)
    return bounds


class Weights:
    """A tag's weight and those of features; a feature without one has its prior."""

    def __init__(self, tag: float = GRID[0], features: dict[str, float] | None = None):
        self.tag, self.features, self.known = tag, features or {}, {}

    def word(self, features: tuple[tuple, tuple]) -> float:
        """A word's score under these features: 1, more or less what they say, between -1 and 1."""
        around = features[0]
        got = self.known.get(around)
        if got is None:
            if len(self.known) > 50_000:
                self.known.clear()
            got = max(-1.0, min(1.0, 1 + sum(self.features[f] if f in self.features else prior(f) for f in around)))
            self.known[around] = got
        return got


def score(line: list, weights: Weights) -> list[float]:
    """Words of a named part score -1 each, but no more than PART_TAGS tags cost; 0 within an <article> or <main>, which goes on after it."""
    out = []
    for kind, n, _, _, around in line:
        if kind == "x":
            out.append(0.0 if {"tag:article", "tag:main"} & set(around[0]) else max(-float(n), PART_TAGS * weights.tag))
        else:
            out.append(weights.tag if kind in "tb" else n * weights.word(around))
    return out


def main_text(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    line = segments(page)
    first, last = best_region(score(line, weights))
    blocks, block = [], []
    for kind, _, text, _, _ in line[first:last]:
        if kind == "w":
            block.append(text)
        elif kind == "b":
            blocks.append(block)
            block = []
    blocks.append(block)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(b for b in joined if b)


def learn_weights(pages: list[str]) -> Weights:
    """Features' log odds by pages that show their article, and the tag weight of GRID whose regions agree best, word by word."""
    lines = [x for x in map(segments, pages) if any(k == "w" and inside for k, _, _, inside, _ in x)]
    if not lines:
        return Weights()
    counts: dict[str, list[float]] = {}  # by feature: words inside, words outside, pages
    for line in lines:
        own: dict[str, list[float]] = {}
        for kind, words, _, inside, around in line:
            if kind in "wx" and words:
                for f in {*around[0], *around[1]}:
                    own.setdefault(f, [0, 0])[not inside] += words
        for f, (a, b) in own.items():
            c = counts.setdefault(f, [0, 0, 0])
            c[0], c[1], c[2] = c[0] + a, c[1] + b, c[2] + 1
    whole = [sum(n for x in lines for k, n, _, i, _ in x if k in "wx" and i == side) or 1 for side in (True, False)]
    features = {}
    for f, (a, b, n) in counts.items():
        odds = np.log((a + 1) / (whole[0] + 2)) - np.log((b + 1) / (whole[1] + 2))
        features[f] = float(max(-MOST, min(MOST, (PRIOR_PAGES * prior(f) + n * odds) / (PRIOR_PAGES + n))))

    def agreement(weights: Weights) -> float:
        right = total = 0
        for line in lines:
            first, last = best_region(score(line, weights))
            for n, (kind, words, _, inside, _) in enumerate(line):
                if kind == "w":
                    total += words
                    right += words * ((first <= n < last) == inside)
        return right / max(1, total)

    return max((Weights(t, features) for t in GRID), key=lambda w: (agreement(w), -GRID.index(w.tag)))


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Weights | None = None
) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    import pyarrow as pa

    page = F.col(html_col).cast("string")
    if weights is None:
        sample = pages.where(F.length(page).between(1, LABELLED_CHARS) & page.rlike("(?i)<(article|main)[ >]")).select(page.alias("h"), F.xxhash64(page).alias("k"))
        chosen = sorted({r.k for r in sample.select("k").orderBy("k").limit(LABELLED_PAGES).collect()})
        rows = sample.where(F.col("k").isin(chosen)).groupBy("k").agg(F.min("h").alias("h")).orderBy("k").collect() if chosen else []  # LABELLED_PAGES at most
        weights = learn_weights([r.h for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces_of(b, 2)):
            texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), page.alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
