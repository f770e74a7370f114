"""Cutting texts into chunks: fixed windows as expressions, structure-aware cuts by pandas functions."""

from __future__ import annotations

import re
import itertools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import bounded_batches, slices
from ..config import DEFAULT

HEADING = re.compile(r"^#{1,6}\s+.+|^(\d+(?:\.\d+)*)\s+.+")
RULE = re.compile(r"^\|?[\s:|-]+\|?$")


def windows(text: Column, size: int, overlap: int) -> Column:
    """struct(idx, chunk) of windows of a size, each beginning `overlap` before the last one's end (K-01)."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap is less than size")
    n = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("idx"), F.substring(text, i * step + 1, F.lit(size)).alias("chunk")))


def fixed_chunks(docs: DataFrame, key: str, text: str, size: int = 2000, overlap: int = 100) -> DataFrame:
    """(key, idx, chunk) of every text, without a shuffle."""
    return docs.select(key, F.inline(windows(F.col(text), size, overlap)))


def heading_parts(text: Column) -> Column:
    """Parts of a text that each begin at a line with # (S-08, K-03)."""
    return F.filter(F.split(text, r"(?m)(?=^#)"), lambda p: F.trim(p) != "")


def is_heading(line: str) -> bool:
    m = HEADING.match(line)
    return bool(m) and (m[1] is None or len(m[1]) <= 5)


def is_table_row(line: str) -> bool:
    line = line.strip()
    if len(line) > 2 and line[0] == "|" and line[-1] == "|":
        return True
    return len(re.split(r"\s{2,}", line)) >= 3 and any(c.isdigit() for c in line)


def split_table(rows: list[str], most: int) -> list[str]:
    """A table too large for a chunk as tables that each repeat its header."""
    head = next((k + 1 for k, row in enumerate(rows[:3]) if k and RULE.match(row.strip()) and "-" in row), min(2, len(rows)))
    header, out, part = rows[:head], [], []
    room = most - sum(len(x) + 1 for x in header)
    for row in rows[head:]:
        if part and sum(len(x) + 1 for x in part) + len(row) > room:
            out.append("\n".join(header + part))
            part = []
        part.append(row)
    if part or not out:
        out.append("\n".join(header + part))
    return out


def _segments(text: str) -> Iterator[tuple[str, list[str]]]:
    """A text as tables (runs of table rows), headings and other lines, each with its kind."""
    for in_table, run in itertools.groupby(text.split("\n"), key=is_table_row):
        if in_table:
            yield "table", list(run)
        else:
            yield from (("heading" if is_heading(line) else "line", [line]) for line in run)


def _pieces(kind: str, lines: list[str], most: int) -> list[str] | None:
    """A segment that is too large for a chunk, cut; None for any other."""
    if kind == "table":
        return split_table(lines, most) if sum(len(x) + 1 for x in lines) > 1.5 * most else None
    (line,) = lines
    return [line[k : k + most] for k in range(0, len(line), most)] if len(line) > most else None


def structural(text: str, most: int = 2000) -> list[str]:
    """Chunks that begin at headings, keep tables of up to 1.5 x most whole, and cut longer lines and tables (K-02)."""
    groups: list[list[str]] = [[]]
    room = most
    for kind, lines in _segments(text):
        pieces, size = _pieces(kind, lines, most), sum(len(x) + 1 for x in lines)
        if pieces is not None:
            groups += [[piece] for piece in pieces] + [[]]
            room = most
            continue
        if kind == "heading" or size > room:
            groups.append([])
            room = most
        groups[-1] += lines
        room -= size
    return [chunk for chunk in ("\n".join(g).strip() for g in groups) if chunk] or [text]


def windows_of(text: str, most: int, overlap: int) -> list[str]:
    return [text[k : k + most] for k in range(0, max(len(text) - overlap, 1), most - overlap)]


def structural_chunks(docs: DataFrame, key: str, text: str, most: int = 2000) -> DataFrame:
    """(key, idx, chunk) by structure, or by windows that overlap by a tenth where a long text has no structure (K-01, K-02, S-09).

    A task holds the texts and chunks of a slice, whatever a batch or the table has.
    """
    bounded_batches(docs.sparkSession)

    def cut(t: str) -> list[str]:
        made = structural(t, most)
        return made if len(made) > 1 or len(t) <= most else windows_of(t, most, most // 10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            out = [(n, i, c) for n, t in enumerate(part.column(1).to_pylist()) for i, c in enumerate(cut(t or ""))]
            rows, idx, made = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(idx, pa.int32()), pa.array(made, pa.string())], names=["key", "idx", "chunk"])

    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(key, F.col(text).alias(text)).mapInArrow(run, f"key {kind}, idx int, chunk string")
    return made.withColumnRenamed("key", key)


def section_chunks(pages: pd.DataFrame, most: int = DEFAULT.chunk_chars, overlap: int = DEFAULT.chunk_overlap, least: int = DEFAULT.chunk_min) -> list[tuple[int, str, str]]:
    """(page_num, section_path, chunk) of one document's pages in order (K-04, K-05, K-06).

    Pages of a section are joined up to `most` characters, longer ones cut, small neighbours joined again; a chunk
    belongs to its first page.  A section's pages are handled together until they exceed twice `most`.
    """
    out: list[tuple[int, str, str]] = []

    def window(text: str) -> list[str]:
        return windows_of(text, most, overlap)

    def section(path: str, group: list[tuple[int, str]]):
        parts: list[tuple[int, str]] = []
        held, first = "", None
        for page, text in group:
            if len(text) > most:
                if held:
                    parts.append((first, held))
                    held, first = "", None
                cut = structural(text, most)
                parts += [(page, c) for c in (cut if len(cut) > 1 else window(text)) if len(c) >= least]
            elif held and len(held) + 1 + len(text) > most:
                parts.append((first, held))
                held, first = text, page
            else:
                held, first = (held + "\n" + text if held else text), page if first is None else first
        if held:
            parts.append((first, held))
        joined: list[tuple[int, str]] = []
        for page, text in [(p, c) for p, t in parts for c in (window(t) if len(t) > 1.2 * most else [t])]:
            if joined and len(joined[-1][1]) + 1 + len(text) <= most:
                joined[-1] = (joined[-1][0], joined[-1][1] + "\n" + text)
            else:
                joined.append((page, text))
        out.extend((page, path, text) for page, text in joined)

    group: list[tuple[int, str]] = []
    path, size = None, 0
    for page, own, text in zip(pages["page_num"], pages["section_path"].fillna(""), pages["raw_text"].fillna(""), strict=True):
        if len(text.strip()) < 10:
            continue
        if group and (own != path or size > 2 * most):
            section(path, group)
            group, size = [], 0
        path = own
        group.append((int(page), text))
        size += len(text)
    if group:
        section(path, group)
    return out


def document_chunks(pages: DataFrame, per_doc: int | None = None) -> DataFrame:
    """(doc_id, chunk_idx, page_num, section_path, chunk) of pages (doc_id, page_num, section_path, raw_text), document by document.

    All chunks, or with per_doc (chunks_per_doc is what an index of a small machine took) a document's first ones.
    """

    def one(key, group: pd.DataFrame) -> pd.DataFrame:
        made = section_chunks(group.sort_values("page_num"))[:per_doc]
        return pd.DataFrame([(key[0], i, p, s, c) for i, (p, s, c) in enumerate(made)], columns=["doc_id", "chunk_idx", "page_num", "section_path", "chunk"])

    return pages.select("doc_id", "page_num", "section_path", "raw_text").groupBy("doc_id").applyInPandas(one, "doc_id long, chunk_idx int, page_num int, section_path string, chunk string")


def text_structure(pages: DataFrame) -> DataFrame:
    """pages with level, section_path and section_title of the first heading in their first 30 lines, or of the page before (K-07, K-08)."""
    from pyspark.sql import Window

    from ..functions.text import heading

    lines = F.slice(F.split("raw_text", "\n", -1), 1, 30)
    found = F.filter(F.transform(lines, lambda x: heading(F.trim(x))), lambda h: h.isNotNull())
    over = Window.partitionBy("doc_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.try_element_at("_found", F.lit(1)), ignorenulls=True).over(over)
    carried = pages.withColumn("_found", found).withColumn("_last", last)
    return carried.select(*pages.columns, F.col("_last.level").alias("section_level"), F.col("_last.path").alias("section_path"), F.col("_last.title").alias("section_title"))
