"""Page layout: boxes, columns, captions, grids, watermarks, chart regions.

Boxes are columns x1, y1, x2, y2.  What compares boxes of one page joins by page, in the JVM; what walks a page in
order (grids, content streams) is a pandas function of a page.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def area(b: str = "") -> Column:
    return (F.col(f"{b}x2") - F.col(f"{b}x1")) * (F.col(f"{b}y2") - F.col(f"{b}y1"))


def overlap(a: str, b: str) -> Column:
    """The area that boxes with these column prefixes share."""
    side = lambda lo, hi: F.greatest(F.least(F.col(a + hi), F.col(b + hi)) - F.greatest(F.col(a + lo), F.col(b + lo)), F.lit(0))
    return side("x1", "x2") * side("y1", "y2")


def iou(a: str, b: str) -> Column:
    shared = overlap(a, b)
    return shared / F.nullif(area(a) + area(b) - shared, F.lit(0))


def overlapping(left: DataFrame, right: DataFrame, page: str, least: float = 0.5) -> DataFrame:
    """Pairs of a page's boxes whose intersection over union exceeds `least` (J-14); inputs have prefixes a_ and b_."""
    return left.join(right, page).withColumn("iou", iou("a_", "b_")).where(F.col("iou") > least)


def nearest_caption(media: DataFrame, captions: DataFrame, page: str, most: float = 150.0) -> DataFrame:
    """media with the caption of the page whose middle is nearest in height, nearer than `most` (J-13)."""
    gap = F.abs((F.col("m_y1") + F.col("m_y2")) / 2 - (F.col("c_y1") + F.col("c_y2")) / 2)
    met = media.join(captions, page).withColumn("gap", gap).where(F.col("gap") < most)
    best = met.groupBy(page, "media").agg(F.min_by("caption", F.struct("gap", "caption")).alias("caption"))
    return media.select(page, "media").join(best, [page, "media"], "left")


def columns_by_halves(blocks: DataFrame, page: str) -> DataFrame:
    """(page, columns): two if both halves of the middles' range hold at least two blocks and much alike numbers (F-60)."""
    centers = blocks.withColumn("c", (F.col("x1") + F.col("x2")) / 2)
    middle = centers.groupBy(page).agg(((F.min("c") + F.max("c")) / 2).alias("mid"), F.count("*").alias("n"))
    sides = centers.join(middle, page).groupBy(page, "n").agg(F.count(F.when(F.col("c") < F.col("mid"), 1)).alias("l"), F.count(F.when(F.col("c") >= F.col("mid"), 1)).alias("r"))
    two = (F.col("n") >= 3) & (F.col("l") >= 2) & (F.col("r") >= 2) & (F.abs(F.col("l") - F.col("r")) <= 0.5 * F.greatest("l", "r"))
    return sides.select(page, F.when(two, 2).otherwise(1).alias("columns"))


def columns_by_gaps(starts: DataFrame, page: str, x: str, width: float) -> DataFrame:
    """(page, columns): one more for each gap over 15 % of the width, three at most (F-60)."""
    gap = F.col(x) - F.lag(x).over(Window.partitionBy(page).orderBy(x))
    found = starts.withColumn("gap", gap).groupBy(page).agg(F.count("*").alias("n"), F.count(F.when(F.col("gap") > 0.15 * width, 1)).alias("k"))
    return found.select(page, F.when(F.col("n") < 3, 1).otherwise(F.least(F.col("k") + 1, F.lit(3))).cast("int").alias("columns"))


def reading_order(blocks: DataFrame, page: str, columns: Column, width: float, id: str) -> DataFrame:
    """blocks with ord: by column, then height (T-10)."""
    column = F.least(F.floor((F.col("x1") + F.col("x2")) / 2 / (width / columns)), columns - 1)
    return blocks.withColumn("ord", F.row_number().over(Window.partitionBy(page).orderBy(column, "y1", "x1", id)))


def element_type(text: Column) -> Column:
    """title, section-header, caption, footnote, list-item, table, formula or text (F-61)."""
    n = F.length(text)
    titled = text.rlike(r"^[\d.\s]+") | ((n < 30) & ~text.rlike("[，。；：]"))
    marks = F.regexp_count(text, F.lit(r"[=+\-×÷ΣΠ∂∫√≠≤≥∞αβγ^_{}]"))
    return (
        F.when((n < 50) & titled & (n < 20) & ~text.rlike("[：:]$"), "title").when((n < 50) & titled, "section-header")
        .when(text.rlike(r"(?i)^(图\s*\d+|Fig\.?\s*\d+|Figure\s*\d+|表\s*\d+|Table\s*\d+)"), "caption")
        .when((n < 200) & text.rlike(r"^[*※①\[(]") & text.rlike("注|note|参考|ref"), "footnote")
        .when(text.rlike(r"^\s*[•\-*\d+.①-⓿]\s"), "list-item")
        .when(text.rlike(r"^[^\n]*[|\t][^\n]*\n[^\n]*[|\t]"), "table")
        .when(marks / F.greatest(n, F.lit(1)) > 0.1, "formula").otherwise("text")
    )


def page_type(elements: DataFrame, page: str) -> DataFrame:
    """(page, page_type) of elements (page, kind, text): cover, toc, table_page, form, image_page, appendix, blank or text_body (F-61)."""
    low = F.lower("text")
    some = lambda pattern: F.max(low.rlike(pattern))
    count = lambda cond: F.count(F.when(cond, 1))
    c = elements.groupBy(page).agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), some("cover|目录").alias("cover"), some("contents|目录|章节").alias("toc"), count(F.col("text").rlike(r"^[\d.\s]+")).alias("numbered"),
        count(F.col("kind") == "table").alias("tables"), count(F.col("kind") == "picture").alias("pictures"), count(low.rlike("name|address|tel|phone|email|姓名|地址|电话")).alias("fields"), some("appendix|附录|参考文献").alias("appendix"),
    )
    kind = (
        F.when(F.col("cover") & (F.col("n") < 5), "cover").when(F.col("toc") & (F.col("numbered") >= 3), "toc")
        .when((F.col("tables") >= 2) | ((F.col("tables") >= 1) & (F.col("n") < 5)), "table_page").when(F.col("fields") >= 3, "form")
        .when((F.col("pictures") >= 1) & (F.col("n") < 4), "image_page").when(F.col("appendix"), "appendix").when(F.col("chars") < 50, "blank").otherwise("text_body")
    )
    return c.select(page, kind.alias("page_type"))


def largest_regions(regions: DataFrame, page: str, id: str, most: int = 4) -> DataFrame:
    """The largest regions of a page (T-09)."""
    return regions.withColumn("area", area()).withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy(F.col("area").desc(), id))).where(F.col("rank") <= most)


def chart_regions(captions: DataFrame, texts: DataFrame, page: str, height: float = 300.0, most_cover: float = 0.35) -> DataFrame:
    """Bands above captions that text covers by less than 35 %: where a chart may be (F-70)."""
    bands = captions.select(page, "caption", F.col("c_x1").alias("a_x1"), F.greatest(F.col("c_y1") - height, F.lit(0.0)).alias("a_y1"), F.col("c_x2").alias("a_x2"), F.col("c_y1").alias("a_y2"))
    covered = bands.join(texts, page, "left").groupBy(page, "caption", *[f"a_{c}" for c in ("x1", "y1", "x2", "y2")]).agg(F.sum(F.coalesce(overlap("a_", "t_"), F.lit(0.0))).alias("text_area"))
    return covered.withColumn("cover", F.col("text_area") / F.nullif(area("a_"), F.lit(0.0))).where(F.col("cover") < most_cover)


# watermarks


def watermark_score(angle: Column, gray: Column, segments: Column, distinct: Column) -> Column:
    """How much a block of text looks like a watermark, from 0 to 1 (F-57)."""
    slanted = ~((F.abs(angle) < 15) | (F.abs(angle - 180) < 15) | (F.abs(angle - 90) < 15) | (F.abs(angle + 90) < 15))
    rest = F.abs(angle) % 90
    turned = F.when(slanted, 0.4 + F.when(rest.between(15, 75), 0.2).otherwise(0.0) + F.when(rest.between(30, 60), 0.1).otherwise(0.0)).otherwise(0.0)
    repeated = (segments > 1) & (distinct < segments) & (segments / F.greatest(distinct, F.lit(1)) > 2)
    return F.least(turned + F.when(gray > 0.3, 0.15).otherwise(0.0) + F.when(repeated, 0.15).otherwise(0.0), F.lit(1.0))


def watermarks(blocks: DataFrame) -> DataFrame:
    """(doc, signature, n, score): blocks (doc, page, angle, x, y, gray, segments, distinct, size) that recur over a document's pages (A-16).

    A signature is the angle to 15 degrees, the place to 50 units and the gray to .1.  It is a watermark if it recurs on
    70 % of the pages, twice at least, with a mean score over .5, places within 100 units and angles within 10 degrees,
    or on 90 % of the pages anyway.
    """
    scored = blocks.where(F.col("size").between(10, 5000)).withColumn("score", watermark_score(F.col("angle"), F.col("gray"), F.col("segments"), F.col("distinct"))).where(F.col("score") >= 0.3)
    near = lambda c, step: (F.round(F.col(c) / step) * step).cast("string")
    signature = F.concat_ws("_", near("angle", 15), near("x", 50), near("y", 50), F.round("gray", 1).cast("string"))
    range_ = lambda c, most: F.greatest(1 - (F.max(c) - F.min(c)) / most, F.lit(0.0))
    pages = blocks.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    groups = scored.groupBy("doc", signature.alias("signature")).agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.least(range_("x", 200), range_("y", 200)).alias("place"), range_("angle", 33).alias("turn"))
    found = groups.join(pages, "doc").where(F.col("n") >= F.greatest(F.lit(2), F.floor(0.7 * F.col("pages"))))
    return found.where(((F.col("score") > 0.5) & (F.col("place") > 0.5) & (F.col("turn") > 0.7)) | (F.col("n") >= 0.9 * F.col("pages"))).select("doc", "signature", "n", F.round("score", 6).alias("score"))


_NUMBER = r"(-?\d*\.?\d+)"
_MATRIX = re.compile(rf"{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}\s+Tm".encode())
_FONT = re.compile(rf"/(\w+)\s+{_NUMBER}\s+Tf".encode())
_GRAY = re.compile(rf"{_NUMBER}\s+g\b".encode())
_RGB = re.compile(rf"{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}\s+rg\b".encode())
_TEXT = re.compile(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|')")
_ARRAY = re.compile(rb"\[((?:\\.|[^\]])*)\]\s*TJ")
_PART = re.compile(rb"\(((?:\\.|[^\\()])*)\)")


def text_blocks(stream: bytes) -> list[dict]:
    """The BT..ET blocks of a page's content stream: matrix, font, color and the strings shown (F-58)."""
    out = []
    for m in re.finditer(rb"\bBT\b(.*?)\bET\b", stream, re.S):
        body = m[1]
        texts = [t for t in _TEXT.findall(body)] + [b"".join(_PART.findall(a)) for a in _ARRAY.findall(body)]
        matrix, font, gray, rgb = _MATRIX.search(body), _FONT.search(body), _GRAY.search(body), _RGB.search(body)
        a, b, _, _, x, y = (float(v) for v in matrix.groups()) if matrix else (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        level = float(gray[1]) if gray else sum(float(v) for v in rgb.groups()) / 3 if rgb else 0.0
        out.append({"size": len(m[0]), "angle": math.degrees(math.atan2(b, a)), "x": x, "y": y, "font": font[1].decode() if font else "", "gray": level, "texts": [t.decode("latin-1") for t in texts]})
    return out


def stream_blocks(streams: DataFrame) -> DataFrame:
    """text_blocks of (doc, page, stream), a row a block."""
    schema = "doc long, page int, size int, angle double, x double, y double, font string, gray double, segments int, distinct int, text string"

    def run(parts):
        for part in parts:
            rows = [(d, p, b["size"], b["angle"], b["x"], b["y"], b["font"], b["gray"], len(b["texts"]), len(set(b["texts"])), " ".join(b["texts"])) for d, p, s in zip(part["doc"], part["page"], part["stream"], strict=True) for b in text_blocks(bytes(s))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return streams.select("doc", "page", "stream").mapInPandas(run, schema)


# grids


def lines_of(values: list[float], near: float = 3.0) -> list[float]:
    """Positions merged where they are no more than `near` apart (F-64)."""
    out: list[list[float]] = []
    for v in sorted(values):
        if out and v - out[-1][-1] <= near:
            out[-1].append(v)
        else:
            out.append([v])
    return [sum(g) / len(g) for g in out]


def grid(chars: pd.DataFrame, xs: list[float], ys: list[float]) -> list[list[str]]:
    """Characters (x, y, c) dealt to the cells between lines, row by row (J-16)."""
    xs, ys = lines_of(xs), lines_of(ys)
    cells = [["" for _ in xs[1:]] for _ in ys[1:]]
    for r in chars.sort_values(["y", "x"]).itertuples():
        column = next((k for k in range(len(xs) - 1) if xs[k] <= r.x < xs[k + 1]), None)
        row = next((k for k in range(len(ys) - 1) if ys[k] <= r.y < ys[k + 1]), None)
        if column is not None and row is not None:
            cells[row][column] += r.c
    return cells


def blank_share(histogram: list[int]) -> float:
    """The share of pixels that aren't the commonest; a page under .005 is blank (F-62)."""
    total = sum(histogram)
    return 1 - max(histogram) / total if total else 0.0
