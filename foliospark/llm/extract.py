"""Main text of web pages: what a page's structure calls its article, and for the rest what its host doesn't repeat.

Each page's markup is read once, in one pass over its characters, into blocks.  Menus, headers, footers, sidebars,
notices, adverts, forms and reader comments go by their tags, roles and plain labels.  Where a page names its article
(or main part), its blocks are text.  What structure leaves open goes by the host: blocks of a page without an article,
and blocks inside an article whose label only sounds like one of the above (`related-work`, `market-share`).

Those blocks' tokens are a page's stream.  In the suffix array of a host's concatenated streams, suffixes that share
RUN tokens are neighbours; tokens covered by such a string of two or more distinct pages are boilerplate and go, and the
unique runs stay.  The neighbours are found by equal fingerprints of RUN tokens, salted, so no host's pages and no
string that all pages have meet in one task.

Null, empty and textless html give an empty text; a null url is a host of its own.  Repeated rows are one page with
the same text.  An empty table gives no rows; extra columns are ignored.  Unclosed tags, quotes and comments of any
length are read in linear time.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Tokens in a string that counts as boilerplate when two pages of a host have it.
RUN = 8
SALTS = 32
NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>"']*))?|[\s/=>"']+""")
TOKENS = re.compile(r"[a-z0-9]+")

RAW = {name: re.compile(rf"</{name}(?![A-Za-z0-9:-])", re.I) for name in "script style textarea template noscript iframe svg math object canvas xmp noembed noframes".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CHROME = frozenset("head title nav header footer aside form menu dialog button select fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
ALIKE = frozenset("li tr td th dt dd option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: A class or id that is one of these names its element's part; a longer one that has such a word may do so.
LABELS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar header footer cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription comment comments reply replies disqus "
    "share sharing social related widget toolbar login signup search pagination".split()
)
#: Labels that also name the part as the first or last word of a longer class or id.
FIRM = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo nav navbar breadcrumb breadcrumbs sidebar cookie cookies consent gdpr newsletter comment comments disqus".split())
PLAIN, OPEN, OUT = 0, 1, 2


def standing(name: str, attributes: str) -> int:
    """OUT for an element that is no main text, OPEN if its label only sounds like one, else PLAIN."""
    if name in CHROME:
        return OUT
    if not attributes or name in ("html", "body"):
        return PLAIN
    found = PLAIN
    for m in ATTRIBUTE.finditer(attributes):
        if m[1] is None:
            continue
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or (key == "role" and value in ROLES):
            return OUT
        if key in ("class", "id") and name != "main" and name not in HEADINGS:
            for word in value.split():
                parts = TOKENS.findall(word)
                if word in LABELS or (parts and (parts[0] in FIRM or parts[-1] in FIRM)):
                    return OUT
                if not LABELS.isdisjoint(parts):
                    found = OPEN
    return found


def _tag_end(page: str, at: int) -> int:
    """Where the tag that is open at this place ends: the first > outside quotes, or -1."""
    while m := STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        close = page.find(m[0], m.end())
        at = close + 1 if close >= 0 else m.end()
    return -1


def _markup(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind is 'text' (rest), 'open' (name, attributes) or 'close' (name)."""
    at, size, quotes = 0, len(page), True
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        closing = page.startswith("/", lt + 1)
        m = NAME.match(page, lt + 1 + closing)
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else size
            continue
        if not m and page[lt + 1 : lt + 2] not in ("!", "?", "/"):
            yield "text", "", "<"
            at = lt + 1
            continue
        end = _tag_end(page, m.end()) if m and not closing and quotes else page.find(">", lt)
        if end < 0 and m and not closing and quotes:  # quotes never close: from here on they are characters like others
            quotes, end = False, page.find(">", lt)
        if end < 0:  # nor does any tag
            yield "text", "", page[lt:]
            return
        at = end + 1
        if not m:
            continue
        name, rest = m[0].lower(), page[m.end() : end]
        if closing:
            yield "close", name, ""
        elif name in RAW:
            if not rest.rstrip().endswith("/"):
                close = RAW[name].search(page, at)
                end = page.find(">", close.end()) if close else -1
                at = end + 1 if end >= 0 else size
        else:
            yield "open", name, rest


def blocks_of(page: str) -> tuple[list[str], list[int], bool]:
    """The page's text blocks in order, the numbers of those that structure leaves open, and whether the page names an article.

    Blocks beside the article are left out; without an article all are open, but for what lies in menus and the like.
    """
    inside: list[tuple[str, int, bool]] = []  # open elements: name, standing, whether it is a main part
    names: Counter[str] = Counter()
    held = [0, 0, 0]  # open elements by standing
    main = 0
    blocks: list[tuple[str, bool, bool]] = []  # text, in the article, left open
    text: list[str] = []
    found = False

    def flush():
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined and not held[OUT]:
                blocks.append((joined, main > 0, held[OPEN] > 0))

    def push(name: str, kind: int, is_main: bool):
        nonlocal main
        inside.append((name, kind, is_main))
        names[name] += 1
        held[kind] += 1
        main += is_main

    def close(to: int):
        nonlocal main
        while len(inside) > to:
            name, kind, is_main = inside.pop()
            names[name] -= 1
            held[kind] -= 1
            main -= is_main

    for event, name, rest in _markup(page):
        if event == "text":
            if not held[OUT]:
                text.append(rest)
        elif event == "close":
            if not names[name]:
                if name not in INLINE:
                    flush()
                continue
            k = len(inside) - 1
            while inside[k][0] != name:
                k -= 1
            if name not in INLINE or inside[k][1] != PLAIN:
                flush()
            close(k)
        elif name == "br":
            text.append(" ")
        elif name in INLINE:
            kind = standing(name, rest) if rest else PLAIN
            if kind != PLAIN:
                flush()
                push(name, kind, False)
        else:
            flush()
            if name in VOID:
                continue
            k = len(inside) - 1
            while k >= 0 and inside[k][0] in INLINE:
                k -= 1
            if k >= 0 and (inside[k][0] == "p" or inside[k][0] == name and name in ALIKE):  # a block ends an open paragraph; list items and cells end their like
                close(k)
            kind = standing(name, rest)
            is_main = name in MAIN or "main" in re.findall(r"""\brole\s*=\s*["']?([a-z]+)""", rest)
            found |= is_main and not held[OUT] and kind != OUT
            push(name, kind, is_main)
    flush()
    kept = [(joined, is_open) for joined, in_main, is_open in blocks if in_main or not found]
    return [joined for joined, _ in kept], [k for k, (_, is_open) in enumerate(kept) if is_open or not found], found


def _parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, key, blocks, unsure): the blocks of each page, and the numbers of those that its host decides on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                read = [blocks_of(page or "") for page in rows.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:3], pa.array([b for b, _, _ in read], pa.list_(pa.string())), pa.array([u for _, u, _ in read], pa.list_(pa.int32()))],
                    names=["page_id", "url", "key", "blocks", "unsure"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.xxhash64("url", "html").alias("key"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, key long, blocks array<string>, unsure array<int>")


def _windows(pages: DataFrame, run_tokens: int) -> DataFrame:
    """(host, window, key, at): the fingerprint of each string of run_tokens tokens of a page's stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, key, blocks, unsure in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                tokens = [t for k in unsure for t in blocks[k].split()]
                if len(tokens) >= run_tokens:
                    prints = [xxhash.xxh64_intdigest("\x00".join(tokens[i : i + run_tokens])) for i in range(len(tokens) - run_tokens + 1)]
                    n = len(prints)
                    yield pa.RecordBatch.from_arrays([pa.array([host] * n), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array([key] * n), pa.array(np.arange(n, dtype=np.int32))], names=["host", "window", "key", "at"])

    return pages.select("host", "key", "blocks", "unsure").mapInArrow(run, "host string, window long, key long, at int")


def unique_runs(unclear: DataFrame, run_tokens: int = RUN) -> DataFrame:
    """(key, text) of pages (url, key, blocks, unsure): their text without what two distinct pages of a host share in unsure blocks."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), F.concat(F.lit("\x00"), F.col("key").cast("string"))))
    pages = unclear.select("key", "blocks", "unsure", host.alias("host")).dropDuplicates(["key"])
    windows = materialize(_windows(pages, run_tokens).withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")), "windows")
    parts = windows.groupBy("host", "window", "salt").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    shared = parts.groupBy("host", "window").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b")
    shared = materialize(shared.select("host", "window", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "shared")
    hits = windows.join(shared, ["host", "window", "salt"]).groupBy("key").agg(F.collect_list("at").alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blocks, unsure, found in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                sizes = {k: len(blocks[k].split()) for k in unsure}
                covered = np.zeros(sum(sizes.values()), bool)
                for at in found or []:
                    covered[at : at + run_tokens] = True
                left, at = [], 0
                for k, block in enumerate(blocks):
                    if k in sizes:
                        hit = covered[at : at + sizes[k]]
                        at += sizes[k]
                        block = " ".join(t for t, c in zip(block.split(), hit, strict=True) if not c) if hit.any() else block
                    left += [block] if block else []
                out.append("\n\n".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "text"])

    return pages.join(hits, "key", "left").select("key", "blocks", "unsure", "hits").mapInArrow(run, "key long, text string")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of pages (page_id, url, html)."""
    parsed = materialize(_parsed(pages), "blocks")
    unclear = parsed.where(F.size("unsure") > 0)
    clear = parsed.where(F.size("unsure") <= 0).select("page_id", "url", F.array_join("blocks", "\n\n").alias("text"))
    if unclear.isEmpty():
        return clear
    runs = materialize(unique_runs(unclear), "runs")
    return clear.unionByName(unclear.join(runs, "key").select("page_id", "url", "text"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
