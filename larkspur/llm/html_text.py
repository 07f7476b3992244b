"""Main text of web pages as the maximum-scoring run of words and tags.

A page is read once as a stream of tags and texts. Words score by the block that holds them and by whether they lie in an
``article`` or ``main`` element, outside of the page's one, or on a page without; tags score by their name. The weights are log odds of
lying inside the main text, counted on labelled pages: pages of the table that mark their main text with one ``article`` or ``main``
element. Tags are held between ``TAG_LEAST`` and ``TAG_MOST``, so that they always cost something and a list inside the text does not
split it. One linear scan finds the run with the largest sum.

Inside the run, elements that are never main text are left out: menus, side bars, forms, adverts, notices, reader
comments, page heads and feet, scripts and styles. They are known by element, by role, by class and id (see below), and by classes
that the labelled pages have learned to lie outside the main text, always. As they are left out anyway, their words score
nothing and their tags ``NOISE_TAG``, so that an advert cannot split a text. A class or id marks noise only if each of its hyphenated parts
is a noise, a place or a container word, and one is a noise word: ``cookie-notice`` and ``site-header`` do, ``search-tips``,
``entry-header`` and ``has-sidebar`` do not; a head inside the main element is none. A mark loses where its element holds the page's only main element, or most words of a page
without one: forms and menus around whole pages, or never closed, are no noise; comments always are.

A block element starts a new block; character references are decoded, white space becomes one space, blocks without
text vanish and the rest is joined by line feeds. Attributes with a missing quote end at the next ``>``.

The labelled sample is bounded by ``sample`` pages, the ones with the smallest hashed ids; that bound is a parameter and
concerns the weights alone. Every page is read in full, very long ones too. Features are a fixed set of element names and at most
``MOST_CLASSES`` classes, so the model has a bounded size. Without any labelled page, words weigh 1 and tags ``TAG_MOST``.

Null and empty pages give an empty text. Repeated rows give repeated results, an empty table an empty one. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names with a part of their own.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header"
    " hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
# Elements that are never main text; those of LAYOUT are so unless they hold it.
LAYOUT = frozenset("aside dialog footer form head header menu nav".split())
NEVER = frozenset("button iframe input label noscript object option select svg template textarea title".split())
# Words of classes and ids.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
NOISE = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar nav navbar navigation menu breadcrumb breadcrumbs header footer masthead cookie cookies consent notice alert popup modal"
    " related share sharing social newsletter subscribe signup login search form toolbar pagination pager copyright".split()
)
PLACES = frozenset("site page global top bottom left right main primary secondary upper lower sticky fixed".split())
TEXTS = frozenset("post article entry user reader".split())
CONTAINERS = frozenset("area bar block body box buttons container content footer form icons inner item items links list message overlay panel posts articles section slot stories thread tools unit widget wrap wrapper text".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
TAG_LEAST, TAG_MOST, NOISE_TAG = -1.0, -0.1, -0.02
MOST_CLASSES = 500

_QUOTED = r"(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+"
_ODD = r"(?:[^<>\"']++|\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>]))*+"
_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>{_QUOTED}(?=>)|{_ODD}(?=>)|[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)


def noise_word(mark: str) -> str | None:
    """What a class or id says: 'comments', 'noise', 'head' or nothing."""
    parts = {p for p in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", mark).lower()) if p}
    noise = parts & NOISE
    if not noise or not parts <= NOISE | PLACES | TEXTS | CONTAINERS or noise <= {"header", "footer"} and parts & TEXTS:
        return None
    return "comments" if noise & COMMENTS else "head" if noise <= {"header", "masthead"} else "noise"


@dataclass
class Page:
    """Pieces in page order: kind ('tag', 'text' or 'cut'), name (of the tag, or of the block around a text), text, number of words."""

    kind: list[str] = field(default_factory=list)
    name: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    marks: list[tuple[int, int, str, tuple[str, ...]]] = field(default_factory=list)  # start, end, why (or ''), classes
    mains: list[tuple[int, int]] = field(default_factory=list)

    def add(self, kind: str, name: str, text: str = "") -> None:
        self.kind.append(kind)
        self.name.append(name)
        self.text.append(text)
        self.words.append(len(text.split()) if text else 0)


def read(page: str) -> Page:
    """The pieces of a page, in time linear in it: what is open is also kept by name, and blocks and main elements apart."""
    out = Page()
    stack: list[tuple[str, int, str, tuple[str, ...], bool]] = []  # name, start, why, classes, is it a main element
    places: dict[str, list[int]] = {}  # where each name is open on the stack
    blocks: list[int] = []  # where blocks are
    n_main = 0

    def close(at: int) -> None:
        nonlocal n_main
        for name, start, why, classes, main in stack[at:]:
            if why or classes:
                out.marks.append((start, len(out.kind), why, classes))
            if main:
                out.mains.append((start, len(out.kind)))
                n_main -= 1
        while len(stack) > at:
            places[stack.pop()[0]].pop()
        while blocks and blocks[-1] >= at:
            blocks.pop()

    for m in _PIECE.finditer(page):
        if (text := m["text"]) is not None:
            out.add("text", stack[blocks[-1]][0] if blocks else "html", text)
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            # An end tag also closes what is open inside; one without a start closes nothing.
            at = places[name][-1] if places.get(name) else None
            if name in BLOCKS:
                out.add("cut", "")
            out.add("tag", f"/{name}")
            if at is not None and (name in BLOCKS or not blocks or blocks[-1] <= at):
                close(at)
            continue
        if name in BLOCKS and places.get("p") and places["p"][-1] >= len(stack) - 8 and blocks[-1:] <= places["p"][-1:]:
            close(places["p"][-1])  # a paragraph ends where the next block starts
        if name == "li" and stack and stack[-1][0] == "li":
            close(len(stack) - 1)
        attrs, why, classes, main = m["attrs"] or "", "", (), name in MAIN
        if "=" in attrs:
            for key, *value in _MARKS.findall(attrs):
                value, key = "".join(value), key.lower()
                if key == "role":
                    main = main or value.lower() in MAIN
                    why = why or ("layout" if value.lower() in ROLES else "")
                    continue
                tokens = value.split()
                classes += tuple(tokens) if key == "class" else ()
                found = {noise_word(t) for t in tokens}
                found -= {"head"} if n_main else set()
                why = "comments" if "comments" in found else why or ("layout" if found & {"noise", "head"} else "")
        if main or name in ("html", "body"):
            why = why if why == "comments" and main else ""
        if name in NEVER or name in LAYOUT and not (name == "header" and n_main):
            why = "never" if name in NEVER else why or "layout"
        if name in BLOCKS:
            out.add("cut", "")
        start = len(out.kind)
        out.add("tag", name)
        if name not in VOID and not attrs.rstrip().endswith("/"):
            places.setdefault(name, []).append(len(stack))
            if name in BLOCKS:
                blocks.append(len(stack))
            stack.append((name, start, why, classes, main and why != "comments"))
            n_main += stack[-1][4]
        elif why:
            out.marks.append((start, start + 1, why, classes))
    close(0)
    return out


def judge(page: Page, bad_classes: frozenset[str] = frozenset()) -> tuple[list[bool], list[str]]:
    """For each piece, whether it is noise, and where it lies: 'a' in a main element, 'o' outside of the page's, 'n' on a page without."""
    n = len(page.kind)
    upto = 0
    furthest = {}  # where the comments that begin at or before a place reach
    for a, b, _, _ in sorted((m for m in page.marks if m[2] in ("comments", "never")), key=lambda m: m[0]):
        furthest[a] = upto = max(upto, b)
    begins = list(furthest)
    reach = lambda a: furthest[begins[i - 1]] if (i := bisect_right(begins, a)) else 0
    mains = [(a, b) for a, b in page.mains if reach(a) < b]
    first, last = min((a for a, _ in mains), default=0), max((b for _, b in mains), default=0)
    before = [0]
    for w in page.words:
        before.append(before[-1] + w)
    depth = [0] * (n + 1)
    for a, b, why, classes in page.marks:
        if not why and bad_classes.isdisjoint(classes):
            continue
        if why not in ("comments", "never"):
            if mains:
                if a <= first and last <= b:
                    continue
            elif 2 * (before[b] - before[a]) > before[-1]:
                continue
        depth[a] += 1
        depth[b] -= 1
    held = [0] * (n + 1)
    for a, b in mains:
        held[a] += 1
        held[b] -= 1
    noisy, place, d, h = [], [], 0, 0
    for i in range(n):
        d, h = d + depth[i], h + held[i]
        noisy.append(d > 0)
        place.append("n" if not mains else "a" if h else "o")
    return noisy, place


def _known(name: str) -> str:
    bare = name.lstrip("/")
    return name if bare in BLOCKS or bare in INLINE or bare in NEVER else "/other" if name.startswith("/") else "other"


def count_features(page: str) -> Counter:
    """(feature, inside) counts of a labelled page; nothing for a page that has not exactly one article or main element."""
    counts: Counter = Counter()
    if len(re.findall(r"<(?:article|main)\b", page, re.IGNORECASE)) != 1:
        return counts
    read_page = read(page)
    noisy, place = judge(read_page)
    for kind, name, n, bad, at in zip(read_page.kind, read_page.name, read_page.words, noisy, place, strict=True):
        if kind != "cut" and not bad and (kind == "tag" or n):
            counts[f"{kind}:{_known(name)}", at == "a"] += n if kind == "text" else 1
            if kind == "text":
                counts[f"place:{at}", at == "a"] += n
    before, inside = [0], [0]
    for n, at in zip(read_page.words, place, strict=True):
        before.append(before[-1] + n)
        inside.append(inside[-1] + (n if at == "a" else 0))
    for a, b, _, classes in read_page.marks:
        yes = inside[b] - inside[a]
        for c in set(classes):
            counts[f"class:{c}", True] += yes
            counts[f"class:{c}", False] += before[b] - before[a] - yes
    return counts


@dataclass(frozen=True)
class Weights:
    """Log odds of words by block and place, and of tags; classes that lie outside the main text."""

    odds: dict[str, float]
    outside: frozenset[str] = frozenset()


def learn(pages: DataFrame, sample: int = 2_000, id_col: str = "page_id", html_col: str = "html") -> Weights:
    """Log odds of each feature on the labelled sample."""
    picked = pages.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h")).orderBy("h", "id").limit(sample).select("id").distinct()
    plain = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    chosen = plain.join(F.broadcast(picked), F.col("page_id").eqNullSafe(F.col("id")), "left_semi").select("html")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            total: Counter = Counter()
            for page in frame["html"]:
                total += count_features(page)
            yield pd.DataFrame([(f, i, n) for (f, i), n in total.items()], columns=["feature", "inside", "n"])

    rows = chosen.mapInPandas(run, "feature string, inside boolean, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("no")
    )
    is_class = F.col("feature").startswith("class:")
    outside = rows.where(is_class & (F.col("yes") == 0) & (F.col("no") >= 100)).orderBy(F.desc("no"), "feature").limit(MOST_CLASSES).collect()
    odds = {r["feature"]: math.log((r["yes"] + 0.5) / (r["no"] + 0.5)) for r in rows.where(~is_class).collect()}  # features are a fixed set
    return Weights(odds, frozenset(r["feature"].removeprefix("class:") for r in outside))


def main_text(page: str, weights: Weights) -> str:
    """The main text of one page."""
    stream = read(page)
    noisy, place = judge(stream, weights.outside)
    best = run = 0.0
    best_span, start = (0, 0), 0
    for i, (kind, name, n) in enumerate(zip(stream.kind, stream.name, stream.words, strict=True)):
        if kind == "cut":
            continue
        if kind == "text":
            # What the page itself marks decides; on a page without a main element, the block does.
            weight = max(1.0, weights.odds.get("place:a", 1.0)) if place[i] == "a" else min(-1.0, weights.odds.get("place:o", -1.0)) if place[i] == "o" else weights.odds.get(f"text:{_known(name)}", 1.0)
            run += 0.0 if noisy[i] else n * weight
        else:
            run += NOISE_TAG if noisy[i] else max(TAG_LEAST, min(TAG_MOST, weights.odds.get(f"tag:{_known(name)}", TAG_MOST)))
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, best_span = run, (start, i + 1)
    blocks, block = [], []
    for i in range(*best_span):
        kind = stream.kind[i]
        if kind == "cut":
            blocks.append("".join(block))
            block = []
        elif kind == "tag" and stream.name[i] == "br":
            block.append(" ")
        elif kind == "text" and not noisy[i] and place[i] != "o":
            block.append(html.unescape(stream.text[i]))
    blocks.append("".join(block))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def extract(pages: DataFrame, sample: int = 2_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows of page_id, url, text and n_chars, one for each row of pages."""
    weights = learn(pages, sample, id_col, html_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["text"] = [main_text(p, weights) for p in frame.pop("html")]
            yield frame

    plain = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    out = plain.mapInPandas(run, "page_id string, url string, text string")
    return out.select(F.col("page_id").cast(pages.schema[id_col].dataType), "url", "text", F.length("text").cast("long").alias("n_chars"))
