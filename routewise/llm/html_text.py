"""HTML extraction: the maximum-scoring subsequence of a page's tokens.

A page is a sequence of words and tags.  Words score positive and tags
negative, with weights learned from labelled pages; one linear scan (Kadane's)
finds the contiguous region with the highest sum, and its words are the main
text.  Elements that are never article text by their element name, role or
hidden attribute (menus, page headers and footers, forms, scripts, styles) are
left out before the scan, so one inside the article does not split it.  Class
and id words that name a section (sidebar, notice, advert, comments) give the
words in it a cost, learned from the labelled pages too; a section that holds
most of the page's words is its body and has no cost, and one whose words cost
more than they score counts nothing and does not split its surroundings.

Labelled pages are pages that mark their own article with one ``<article>``
or ``<main>`` element (a bounded sample, ``SAMPLE_PAGES``): tokens in it are
content, the others are not.  A tag's cost is its smoothed log odds of standing
outside; tags that mostly stand inside cost next to nothing, so short last
paragraphs are kept.

Blocks: white space inside a block becomes one space, ends are trimmed, and
blocks are joined in page order with one line break.  Defined results: null,
empty and tag-only pages give an empty text; unclosed elements end with their
parent; a page cut in the middle of a tag loses only that tag; repeated rows
give equal results.
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

SAMPLE_PAGES = 2000
#: Cost of a block tag never seen on a labelled page (outside a marked article).
UNSEEN_COST = 1.0
LEAST_COST = 1e-3
#: Cost per word in a section whose class word was never seen on a labelled page, and the words that count for it.
UNSEEN_SECTION_COST = 2.0
PRIOR_WORDS = 10

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|object|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.I | re.S)
#: One attribute: names are never looked for inside values.
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")

# Element names of the HTML standard and common class words.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
                    "small span strike strong sub sup time tt u var wbr img input embed param source track".split())
_NEVER = frozenset("nav footer aside form head button dialog menu".split())
_ARTICLE = frozenset(("article", "main"))
_SECTION_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc "
    "sidebar aside footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments reply replies respond disqus discussion "
    "share sharing social related recommended recommendations trending search complementary contentinfo".split())
#: Elements that begin or hold the article.
_MARKS = frozenset(["h1", "main", "article"])
#: Words that also name parts of articles: they cost nothing until labelled pages show that they do.
_OPEN_WORDS = frozenset("discussion related recommended recommendations search notice notices alert social share sharing trending".split())
_SECTION_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: A class name with one of these tells what its element has or lacks (no-sidebar, post-with-comments), not what it is.
_ABOUT = frozenset("no not non without with has have".split())
_WORD = re.compile(r"[a-z]+")


def _attributes(attr: str) -> tuple[bool, list[str]]:
    """If an element's role or hidden attribute leaves it out, and its class and id words that name a section."""
    words: set[str] = set()
    for key, value in _ATTR.findall(attr):
        key = key.lower()
        if key == "hidden":
            return True, []
        if key not in ("class", "id", "role", "aria-hidden"):
            continue
        value = value.strip("\"'").lower()
        if (key == "aria-hidden" and value.strip() == "true") or (key == "role" and not _SECTION_ROLES.isdisjoint(value.split())):
            return True, []
        if key in ("class", "id"):
            for name in value.split():
                parts = _WORD.findall(name)
                if _ABOUT.isdisjoint(parts):
                    words.update(_SECTION_WORDS.intersection(parts))
    return False, sorted(words)


def tokens(page: str) -> list[tuple[str, str, bool]]:
    """``(kind, value, inside)``: kind ``text`` with raw text or ``tag`` with the
    tag's type (``p``, ``/p``); ``inside`` tells if it lies in an article or main
    element.  What never is article text is left out, as one ``cut`` token.  A
    section named by class or id words stands between ``open`` (with the words)
    and ``end``."""
    out: list[tuple[str, str, bool]] = []
    stack: list[str] = []  # open elements
    named: list[bool] = []  # those that are sections
    skip = -1  # depth of the element being cut
    inside = 0
    at = 0
    for m in _TOKEN.finditer(page):
        if skip < 0 and m.start() > at:
            out.append(("text", page[at:m.start()], inside > 0))
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if skip < 0 and m["raw"]:
                out.append(("cut", m["raw"].lower(), inside > 0))
            continue
        if m["close"]:
            if name not in stack:
                continue
            while True:
                top = stack.pop()
                inside -= top in _ARTICLE
                if named.pop():
                    out.append(("end", "", inside > 0))
                if top == name:
                    break
            if skip >= 0:
                if len(stack) <= skip:
                    skip = -1
                continue
            out.append(("tag", "/" + name, inside > 0))
            continue
        if name in _VOID:
            if skip < 0:
                out.append(("tag", name, inside > 0))
            continue
        alone = m["attr"].rstrip().endswith("/")
        words: list[str] = []
        if skip < 0:
            plain = name not in _ARTICLE and name not in ("body", "html")
            left_out, words = _attributes(m["attr"]) if plain and m["attr"] else (False, [])
            if name in _NEVER or (name == "header" and not inside) or left_out:
                skip, words = len(stack), []
                out.append(("cut", name, inside > 0))
            else:
                out.append(("tag", name, inside > 0 or name in _ARTICLE))
                if words and not alone:
                    out.append(("open", " ".join(words), inside > 0))
        if not alone:
            stack.append(name)
            named.append(bool(words))
            inside += name in _ARTICLE
        elif skip == len(stack):
            skip = -1
    if skip < 0 and at < len(page):
        rest = page[at:]
        out.append(("text", re.sub(r"<[/!?a-zA-Z][^>]*\Z", "", rest), inside > 0))
    out += [("end", "", False)] * sum(named)
    return out


def fit_weights(pages: DataFrame, html: str = "html") -> dict:
    """Cost of every tag type, and per word of every section word (``class x``), from
    labelled pages (see the module's first lines)."""
    marked = pages.select(F.col(html).alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]")).withColumn("h", F.xxhash64("html"))
    # only hashes are gathered: the sample is the distinct pages up to the SAMPLE_PAGES-th hash
    last = marked.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]
    src = marked.where(F.col("h") <= F.lit(last)).select("html")

    def count(batches):
        seen: dict[str, list[int]] = {}
        for b in batches:
            for page in b.column(0).to_pylist():
                sections: list[list[str]] = []
                for kind, value, inside in tokens(page):
                    if kind == "tag":
                        seen.setdefault(value, [0, 0])[inside] += 1
                    elif kind == "open":
                        sections.append(value.split())
                    elif kind == "end":
                        sections.pop()
                    elif kind == "text" and sections:
                        n = len(value.split())
                        for word in {w for words in sections for w in words}:
                            seen.setdefault("class " + word, [0, 0])[inside] += n
        yield pa.RecordBatch.from_pydict({"tag": list(seen), "out": [v[0] for v in seen.values()], "in": [v[1] for v in seen.values()]},
                                         schema=pa.schema([("tag", pa.string()), ("out", pa.int64()), ("in", pa.int64())]))

    rows = (src.mapInArrow(count, "tag string, out long, in long").groupBy("tag")
            .agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
            .where(F.col("in") + F.col("out") > 0).collect())
    prior = lambda word: PRIOR_WORDS * math.exp(_unseen(word))
    return {r["tag"]: max(0.0, math.log((r["out"] + prior(r["tag"][6:])) / (r["in"] + PRIOR_WORDS))) if r["tag"].startswith("class ")
            else max(LEAST_COST, math.log((r["out"] + 0.5) / (r["in"] + 0.5))) for r in rows}


def _unseen(word: str) -> float:
    return 0.0 if word in _OPEN_WORDS else UNSEEN_SECTION_COST


def _sections(seq: list, weights: dict) -> list:
    """The sequence without the sections whose words cost more than they score.

    A section of more than half of the words may be a wrapper of the whole page that such a word names
    by the way: it stays if it holds the page's first heading, article or main element, or if there is none."""
    first = next((i for i, (kind, value, _) in enumerate(seq) if kind == "tag" and value in _MARKS), None)
    words = [0]
    for kind, value, _ in seq:
        words.append(words[-1] + (len(value.split()) if kind == "text" else 0))
    ends, opened = {}, []
    for i, (kind, _, _) in enumerate(seq):
        if kind == "open":
            opened.append(i)
        elif kind == "end":
            ends[opened.pop()] = i
    out, i = [], 0
    while i < len(seq):
        kind, value, inside = seq[i]
        if kind == "open" and (2 * (words[ends[i]] - words[i]) <= words[-1] or first is not None and not i < first < ends[i]):
            if max(weights.get("class " + w, _unseen(w)) for w in value.split()) >= 1:
                i = ends[i]
                out.append(("cut", "", inside))
        elif kind not in ("open", "end"):
            out.append(seq[i])
        i += 1
    return out


def extract(page: str | None, weights: dict) -> str:
    """The main text of one page."""
    if not page:
        return ""
    seq = tokens(page)
    if any(kind == "open" for kind, _, _ in seq):
        seq = _sections(seq, weights)
    # one linear scan: best sum of any contiguous run (the earliest, longest of equals)
    best, best_lo, best_hi, run, lo = 0.0, 0, 0, 0.0, 0
    parts: list[str | None] = []
    for i, (kind, value, inside) in enumerate(seq):
        if kind == "text":
            value = _html.unescape(value)
            parts.append(value)
            run += len(value.split())
        else:
            parts.append(None)
            if kind == "tag":
                run -= weights.get(value, LEAST_COST if inside or value.lstrip("/") in _INLINE else UNSEEN_COST)
        if run <= 0:
            run, lo = 0.0, i + 1
        elif run > best:
            best, best_lo, best_hi = run, lo, i + 1
    blocks: list[str] = []
    now: list[str] = []
    for (kind, value, _), text in zip(seq[best_lo:best_hi], parts[best_lo:best_hi]):
        if kind == "text":
            now.append(text)
        elif kind == "tag" and value.lstrip("/") not in _INLINE:
            blocks.append(" ".join("".join(now).split()))
            now = []
    blocks.append(" ".join("".join(now).split()))
    return "\n".join(b for b in blocks if b)


def extract_pages(pages: DataFrame, weights: dict, keep: list, html: str = "html") -> DataFrame:
    """``keep`` columns of every row plus ``text`` and ``n_chars`` (code points)."""
    src = pages.select(*keep, F.col(html).alias("__html"))
    schema = src.drop("__html").schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for b in batches:
            texts = [extract(p, weights) for p in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                             names=[*b.schema.names[:-1], "text", "n_chars"])

    return src.mapInArrow(run, schema)
