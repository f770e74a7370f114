"""File sources on files made from the catalogue, and outlines."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from ..sources import files, schema

KINDS = ("md", "txt", "html", "docx", "xlsx", "pptx", "bin", "docx")


def _zipped(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def content(kind: int, name: str, size: int) -> bytes:
    """A small file of each kind with the same content; the last one is damaged."""
    if kind == 3:
        return _zipped({"word/document.xml": f'<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{name}</w:t></w:r></w:p><w:p><w:r><w:t>size {size}</w:t></w:r></w:p></w:body></w:document>'})
    if kind == 4:
        return _zipped({"xl/workbook.xml": f'<workbook><sheets><sheet name="{name}"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst><si><t>size</t></si><si><t>{name}</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c><v>{size}</v></c><c><v>1</v></c></row></sheetData></worksheet>'})
    if kind == 5:
        return _zipped({"ppt/slides/slide1.xml": f"<sld><p><r><t>{name}</t></r></p><p><r><t>size {size}</t></r></p></sld>", "ppt/slides/slide2.xml": "<sld><p><r><t>end</t></r></p></sld>"})
    texts = {0: f"# {name}\nsize {size}\n# end\nz", 1: f"{name}\nsize {size}", 2: f"<html><script>no()</script><p>{name}</p><p>size&nbsp;{size} &amp; more</p></html>"}
    return texts.get(kind, "broken").encode()


def made_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(f"/f/{k}.{KINDS[k % 8]}", content(k % 8, n, s)) for k, n, s in zip(part["p_partkey"], part["p_name"], part["p_size"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "content"])

    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").mapInPandas(run, "path string, content binary")


@query(r"""
with p as (select p_partkey, p_partkey % 8 as k, p_name as n, p_size as s from part), f as (select *, '/f/' || p_partkey || '.' || ['md', 'txt', 'html', 'docx', 'xlsx', 'pptx', 'bin', 'docx'][k + 1] as path from p)
select path, unnest(case when k in (0, 5) then [1, 2] when k in (6, 7) then [0] else [1] end)::int as page_num,
  unnest(case k when 0 then [n, 'end'] when 3 then [n] when 4 then [n] when 5 then [n, 'end'] else [''] end) as title,
  unnest(case k when 0 then ['# ' || n || E'\nsize ' || s, E'# end\nz'] when 1 then [n || E'\nsize ' || s] when 2 then [n || E'\nsize ' || s || ' & more'] when 3 then ['# ' || n || E'\nsize ' || s] when 4 then ['size | ' || n || E'\n--------------------\n' || s || ' | 1'] when 5 then [n || E'\nsize ' || s, 'end'] else [''] end) as text,
  case k when 6 then 'unsupported format: bin' when 7 then 'damaged file: BadZipFile' end as error from f
""")
def file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-01, S-05, S-06, S-08, S-09, S-10, S-11: pages of Markdown, text, HTML, document, sheet and slide files, and errors of others."""
    pages = files.parse_files(made_files(spark, sf_dir))
    return pages.select("path", "page_num", F.col("section_title").alias("title"), F.regexp_replace("raw_text", r"\s+$", "").alias("text"), "error")


@query("""
with o as (select o_custkey as doc_id, o_orderkey as ord, o_orderkey % 20 as page, case o_orderkey % 4 when 0 then 'Contents' when 1 then ' 12 ' when 2 then '_hidden' else 'Part x' || o_orderkey end as title from orders)
select doc_id, page, min_by(title, ord) as title from o where starts_with(title, 'Part') group by doc_id, page
""")
def outline_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-12: the first content title of each page of an outline."""
    k = F.col("o_orderkey")
    title = F.when(k % 4 == 0, "Contents").when(k % 4 == 1, " 12 ").when(k % 4 == 2, "_hidden").otherwise(F.concat(F.lit("Part x"), k.cast("string")))
    outline = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("ord"), F.lit(1).alias("level"), (k % 20).alias("page"), title.alias("title"))
    return files.outline_titles(outline)


@query("""
select n_nationkey::varchar as tenant_id, n_name as name, null::varchar as status, n_regionkey::int as quota from nation union all select 'default', 'Default', 'active', 0
""")
def schema_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-10: an older table brought up to date, and the rows that a new system begins with."""
    older = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tenant_id"), F.col("n_name").alias("NAME"), F.col("n_regionkey").alias("quota"), F.lit("x").alias("unknown"))
    return schema.conform(older, "tenants").unionByName(schema.begin(spark)["tenants"])


@query("""
with u as (select o_orderkey, o_custkey % 20 as t, (o_orderkey * 7919) % 1000 - 20 as size, o_orderkey || '.pdf' as file from orders), s as (select *, case when size <= 0 then 'empty' when size > 900 then 'too large' end as bad from u),
r as (select *, 1000 * (t % 3) + sum(case when bad is null then size else 0 end) over (partition by t order by o_orderkey rows unbounded preceding) as taken from s)
select o_orderkey as upload_id, t as tenant_id, file, size, coalesce(bad, case when taken > 9000 then 'over quota' else 'stored' end) as verdict from r
""")
def upload_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-23: uploads by size and quota, and the names they are stored under."""
    k, tenant = F.col("o_orderkey"), F.col("o_custkey") % 20
    name = F.concat(F.lit("/tmp/0123abcd-0123-0123-0123-0123456789ab_"), k.cast("string"), F.lit(".pdf"))
    uploads = table(spark, sf_dir, "orders").select(k.alias("upload_id"), tenant.alias("tenant_id"), name.alias("name"), (k * 7919 % 1000 - 20).alias("size"))
    used = uploads.select("tenant_id").distinct().withColumn("bytes", 1000 * (F.col("tenant_id") % 3))
    return schema.judge_uploads(uploads, used, 900, 9000)
