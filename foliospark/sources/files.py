"""Files of many formats as pages: binaryFile splits files among executors, each is read by its suffix.

Markdown, text, HTML and the zipped XML formats (docx, xlsx, pptx) are read with the standard library.  PDF, images and
older office formats need libraries that aren't required: they are used where installed, else the file's error column
says what is missing, and other files go on.
"""

from __future__ import annotations

import hashlib
import html
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import structural

PAGES = "path string, file_hash string, doc_id string, page_num int, section_title string, raw_text string, error string"
#: The suffixes that are read.
SUFFIXES = ("pdf", "xlsx", "xls", "pptx", "ppt", "docx", "doc", "jpg", "jpeg", "png", "bmp", "tiff", "md", "markdown", "txt", "html", "htm")
_SKIP = re.compile(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->")
_BLOCK = re.compile(r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|table|section|article|br)\b[^>]*>")


def markdown_table(rows: list[list[str]]) -> str:
    """Rows as a Markdown table; the first is the header."""
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join([*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


def is_pseudo_table(rows: list[list[str]]) -> bool:
    """Small grids that are mostly empty are no tables (S-02)."""
    cells = [c for r in rows for c in r]
    return len(rows) <= 3 and max(map(len, rows), default=0) <= 3 and (not cells or sum(not c.strip() for c in cells) >= 0.5 * len(cells))


def _name(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _texts(element) -> str:
    return "".join(e.text or "" for e in element.iter() if _name(e) == "t")


def read_markdown(data: bytes) -> list[tuple[str, str]]:
    """A page for each part that begins at a line with # (S-08)."""
    parts = [p for p in re.split(r"(?m)(?=^#)", data.decode("utf-8", "replace")) if p.strip()]
    return [(p.lstrip("#").split("\n", 1)[0].strip() if p.startswith("#") else "", p) for p in parts]


def read_text(data: bytes) -> list[tuple[str, str]]:
    return [("", c) for c in structural(data.decode("utf-8", "replace"), 2000)]


def read_html(data: bytes) -> list[tuple[str, str]]:
    text = _BLOCK.sub("\n", _SKIP.sub(" ", data.decode("utf-8", "replace")))
    text = html.unescape(re.sub(r"<[^>]*>", "", text))
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return [("", c) for c in structural("\n".join(x for x in lines if x), 2000)]


def read_docx(data: bytes) -> list[tuple[str, str]]:
    """Paragraphs, heading styles as #, tables as Markdown (S-11)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))[0]
    lines = []
    for item in body:
        if _name(item) == "p":
            style = next((v for e in item.iter() if _name(e) == "pStyle" for k, v in e.attrib.items() if k.endswith("val")), "")
            level = re.search(r"(?i)heading\s*(\d)", style)
            text = _texts(item)
            if text.strip():
                lines.append(("#" * int(level[1]) + " " if level else "") + text)
        elif _name(item) == "tbl":
            rows = [[_texts(c) for c in r if _name(c) == "tc"] for r in item if _name(r) == "tr"]
            if not is_pseudo_table(rows):
                lines.append(markdown_table(rows))
    return read_markdown("\n".join(lines).encode()) or [("", "")]


def read_xlsx(data: bytes) -> list[tuple[str, str]]:
    """A page for each sheet: header, rule, rows, cells parted by bars (S-05)."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [_texts(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        names = [e.attrib.get("name", "") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _name(e) == "sheet"]
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for k, sheet in enumerate(sheets):
            rows = []
            for row in (e for e in ElementTree.fromstring(z.read(sheet)).iter() if _name(e) == "row"):
                cells = []
                for cell in row:
                    value = next((e.text or "" for e in cell if _name(e) == "v"), _texts(cell))
                    cells.append(shared[int(value)] if cell.attrib.get("t") == "s" and value else value)
                rows.append(cells)
            lines = [" | ".join(r) for r in rows]
            out.append((names[k] if k < len(names) else "", "\n".join([*lines[:1], *(["-" * 20] if lines else []), *lines[1:]])))
    return out


def read_pptx(data: bytes) -> list[tuple[str, str]]:
    """A page for each slide: texts of shapes, and chart series of up to 30 points (S-06)."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for slide in slides:
            tree = ElementTree.fromstring(z.read(slide))
            texts = [t for t in (_texts(p) for p in tree.iter() if _name(p) == "p") if t.strip()]
            links = slide.replace("slides/", "slides/_rels/") + ".rels"
            for rel in ElementTree.fromstring(z.read(links)) if links in z.namelist() else []:
                target = "ppt/" + rel.attrib.get("Target", "").replace("../", "")
                if "/charts/chart" in target and target in z.namelist():
                    for series in (e for e in ElementTree.fromstring(z.read(target)).iter() if _name(e) == "ser"):
                        values = [v.text or "" for v in series.iter() if _name(v) == "v"][:30]
                        texts.append("[Chart] " + ", ".join(values))
            out.append((texts[0] if texts else "", "\n".join(texts)))
    return out


def read_pdf(data: bytes) -> list[tuple[str, str]]:
    import pypdf

    return [("", page.extract_text() or "") for page in pypdf.PdfReader(io.BytesIO(data)).pages]


READERS = {"md": read_markdown, "markdown": read_markdown, "txt": read_text, "html": read_html, "htm": read_html, "docx": read_docx, "xlsx": read_xlsx, "pptx": read_pptx, "pdf": read_pdf}


def parse(path: str, data: bytes) -> tuple[list[tuple[str, str]], str | None]:
    """(section title, text) of a file's pages, and an error for what can't be read (S-01)."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in SUFFIXES:
        return [], f"unsupported format: {suffix}"
    if suffix not in READERS:
        return [], f"no reader installed for: {suffix}"
    try:
        return READERS[suffix](data), None
    except ImportError as e:
        return [], f"missing library: {e.name}"
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError) as e:
        return [], f"damaged file: {type(e).__name__}"


def document_id(name: str, size: int, pages: list[tuple[str, str]]) -> str:
    return hashlib.md5((f"{name}:{size}:{len(pages)}" + "".join(t[:500] for _, t in pages[:3])).encode()).hexdigest()


def parse_files(files: DataFrame) -> DataFrame:
    """PAGES of files (path, content); a file that can't be read has a row of its own with the error (S-01)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, data in zip(part["path"], part["content"], strict=True):
                data = bytes(data)
                pages, error = parse(name, data)
                id = document_id(name.rsplit("/", 1)[-1], len(data), pages)
                own = hashlib.md5(data).hexdigest()
                rows += [(name, own, id, k + 1, title, text or "", None) for k, (title, text) in enumerate(pages)]
                if error:
                    rows.append((name, own, id, 0, "", "", error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")])

    return files.select("path", "content").mapInPandas(run, PAGES)


def read_files(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """PAGES of the files below a path; files whose hash is in known (file_hash) are passed over (ST-03)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    if known is not None:
        files = files.withColumn("h", F.md5("content")).join(known.select(F.col("file_hash").alias("h")), "h", "left_anti")
    return parse_files(files)


def outline_titles(outline: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, page, title): the first content title of each page of outlines (doc, ord, level, title, page) (S-12)."""
    from ..functions.text import clean_title, is_content_title

    return outline.where(is_content_title(F.col("title"))).groupBy(doc, "page").agg(F.min_by(clean_title(F.col("title")), "ord").alias("title"))
