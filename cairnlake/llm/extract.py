"""Main text of web pages: page structure, and a suffix array over all pages of a host.

A page is cut into blocks. Blocks in boilerplate elements (menus, headers, footers, sidebars, notices, adverts, forms,
comments; by element name, role, or a class or id that is a whole mark or a compound of marks) go; class and id say nothing
of html, body, main and article, and header marks nothing of an article's own header. If the page marks its article (article, main, role=main), the blocks in
it are the text, whole: what pages repeat of one another within their articles stays.

What no page marks, the host decides. The token streams of all its pages are concatenated, articles left out and boilerplate
elements included, equal streams counted once, and each suffix takes its place by (host, first ``DEPTH`` tokens), which is the
suffix array to that depth. Neighbours from distinct streams share a substring of DEPTH tokens at least. A place is
common if ``LEAST`` distinct streams and ``SHARE`` percent of the host's have it. Blocks of pages that mark no article go if
common places cover them whole, so what other pages of the host mark as a menu isn't taken for text where it isn't marked; a
sentence that pages quote from one another stays, and so does a page that is merely copied.
Places are aggregated with partial sums, so a host may hold any share of the pages.

The scan of a page is linear in its length, whatever its tags: open elements are counted by name, and text behind the
last ``>`` is not searched for tags.

Defined cases: null html gives the empty text; a url without a host (null, empty) is a host of its own, so nothing is held
against it; pages with fewer than DEPTH tokens have nothing long enough to be covered; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix

DEPTH = 8
LEAST = 3
SHARE = 50
# Element names by role, and words that mark boilerplate in class, id or role.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe template svg math object xmp noembed noframes select button".split())
SKIP = set("nav footer aside form head menu dialog search".split())
MARKS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion reactions related replies share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
HEADS = {"header", "masthead"}  # inside an article they hold its heading
LEAD = set("bottom global main primary secondary site top".split())
TAIL = set("area bar block box buttons icons item items link links list posts section slot unit".split())
WHOLE = {"html", "body", "main", "article"}
ROLES = set("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
OPEN_END = re.compile(r"<[!?]")
ENDS = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for x in RAW}


def names_boilerplate(name: str, marks: set[str]) -> bool:
    """A mark, or a compound of marks but for LEAD words before and TAIL words after them."""
    parts = [x for x in re.split(r"[_-]+", name) if x]
    while len(parts) > 1 and parts[0] in LEAD:
        parts = parts[1:]
    while len(parts) > 1 and parts[-1] in TAIL:
        parts = parts[:-1]
    return bool(parts) and marks.issuperset(parts)


def marked(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """(boilerplate, main) of an element by class, id and role; class and id mark no element that holds the page or the article."""
    bad = main = False
    named: list[str] = []
    for key, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if key.lower() == "role":
            bad |= value.strip() in ROLES
            main |= value.strip() == "main"
        else:
            named += value.split()
    if name not in WHOLE and not main:
        bad = bad or any(names_boilerplate(x, MARKS - HEADS if inside else MARKS) for x in named)
    return bad, main


class Page(NamedTuple):
    article: list[str]
    rest: list[str]  # all blocks outside of the article, in page order
    plain: list[bool]  # whether a block of rest is in no boilerplate element


def scan(page: str) -> Page:
    """The blocks of the marked article, and the others."""
    out = Page([], [], [])
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]  # name, boilerplate, in the article
    is_open: Counter = Counter()

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            _, bad, main = stack[-1]
            if text and main and not bad:
                out.article.append(text)
            elif text:
                out.rest.append(text)
                out.plain.append(not bad)
            held.clear()

    def close(name: str) -> None:
        while is_open[name]:
            last = stack.pop()[0]
            is_open[last] -= 1
            if last == name:
                break

    at, last_end = 0, page.rfind(">") + 1
    while m := TAG.search(page, at, last_end):
        if m.start() > at:
            text = page[at : m.start()]
            held.append(entities.unescape(text) if "&" in text else text)
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name == "br":
            held.append(" ")
        elif m[1] or m[4]:
            if name in BLOCKS:
                flush()
            close(name)
        elif name in RAW:
            end = ENDS[name].search(page, at)
            at = end.end() if end else len(page)
        else:
            if name in BLOCKS:
                flush()
                if name == "p" or any(x[0] == "p" for x in stack[-4:]):
                    close("p")
                if name == "li" and stack[-1][0] == "li":
                    close("li")
            if name not in VOID and not (m[3] or "").endswith("/"):
                _, bad, main = stack[-1]
                by_class, by_role = marked(name, m[3] or m[6], main) if m[3] or m[6] else (False, False)
                bad = bad or by_class or name in SKIP or (name == "header" and not main)
                stack.append((name, bad, main or by_role or name in ("article", "main")))
                is_open[name] += 1
    if at < len(page):
        held.append(entities.unescape(OPEN_END.split(page[at:], 1)[0]))
    flush()
    return out


def parsed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [scan(x or "") for x in pdf["html"]]
        hosts = [re.sub(r"^[a-z][a-z0-9+.-]*://|^//", "", (u or "").lower()).split("/")[0].split("?")[0].rpartition("@")[2] for u in pdf["url"]]
        text = ["\n".join(p.article) if p.article or not any(p.plain) else None for p in out]
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "host": hosts, "text": text, "rest": [p.rest for p in out], "plain": [p.plain for p in out]}).astype({"page_id": "Int64"})


def places(tokens: list[str]) -> np.ndarray:
    """Hash of the first DEPTH tokens of each suffix that has as many."""
    n = len(tokens) - DEPTH + 1
    if n < 1:
        return np.empty(0, np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), np.uint64, len(tokens))
    out = np.zeros(n, np.uint64)
    for i in range(DEPTH):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out.astype(np.int64)


def tokens_of(rest: list[str]) -> list[str]:
    return [t for block in rest for t in block.split()]


def suffixes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [(h, k, x) for h, k, rest in zip(pdf["host"], pdf["stream"], pdf["rest"]) for x in np.unique(places(tokens_of(rest)))]
        yield pd.DataFrame(found, columns=["host", "stream", "place"]).astype({"place": "int64"})


def without_common(rest: list[str], plain: list[bool], common: list[int] | None) -> str:
    """The blocks that are in no boilerplate element and that common places don't cover whole."""
    tokens = tokens_of(rest)
    covered = np.zeros(len(tokens), bool)
    if common is not None and len(common):
        for i in np.flatnonzero(np.isin(places(tokens), np.asarray(common, np.int64))):
            covered[i : i + DEPTH] = True
    out, at = [], 0
    for block, is_plain in zip(rest, plain):
        n = len(block.split())
        if is_plain and not covered[at : at + n].all():
            out.append(block)
        at += n
    return "\n".join(out)


def finished(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": [without_common(*x) for x in zip(pdf["rest"], pdf["plain"], pdf["common"])]}).astype({"page_id": "Int64"})


def common_places(rows: DataFrame) -> DataFrame:
    """(host, stream, common): for each distinct stream of a host its places that are common there."""
    texts = rows.where("host <> '' AND size(rest) > 0").select("host", "stream", "rest").dropDuplicates(["host", "stream"])
    places_of = texts.mapInPandas(suffixes, "host string, stream string, place long")
    many = texts.groupBy("host").agg(F.count("*").alias("n"))
    held = places_of.groupBy("host", "place").agg(F.count("*").alias("c")).where(F.col("c") >= LEAST)
    shared = held.join(many, "host").where(F.col("c") * 100 >= F.col("n") * SHARE).select("host", "place")
    return places_of.join(shared, ["host", "place"]).groupBy("host", "stream").agg(F.collect_set("place").alias("common"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    schema = "page_id long, url string, host string, text string, rest array<string>, plain array<boolean>"
    rows = cut(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(parsed, schema), "blocks")
    told = rows.where("text IS NOT NULL").select("page_id", "url", "text")
    streams = rows.withColumn("stream", F.sha2(F.array_join("rest", " "), 256))
    untold = streams.where("text IS NULL").join(common_places(streams), ["host", "stream"], "left")
    untold = untold.select("page_id", "url", "rest", "plain", "common").mapInPandas(finished, "page_id long, url string, text string")
    return told.union(untold).withColumn("n_chars", F.length("text").cast("long"))
