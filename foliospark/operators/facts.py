"""Facts (entity, attribute, value) read from pages, looked up for questions and rendered."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..batches import bounded_batches, slices
from ..config import DEFAULT
from ..functions.text import NUMBER_WORDS, fact_keywords, model_tokens
from .retrieval import top, with_vocabulary

#: Attributes too general to stand for a fact.
GENERAL = frozenset({
    "note", "notes", "copyright", "rev", "revision", "date", "version", "page", "figure", "fig", "table", "chapter", "section",
    "http", "https", "www", "tel", "fax", "email", "mail", "address", "zip",
})
#: Words at a line's end after which its sentence goes on.
DANGLING = frozenset({"and", "or", "with", "the", "a", "an", "of", "to", "for", "in", "on", "per", "via", "by", "at", "as", "from", "than", "into", "between"})
#: The patterns of facts in a line.
_COUNT = "|".join(NUMBER_WORDS)
KEY_VALUE = re.compile(r"\b([A-Za-z][A-Za-z0-9 _/()&.\-]{1,35}?)\s*:\s*((?:\d[\w.]*|[A-Z][\w\-]{2,})[\w.\s×x/@%+\-–,()]{0,45}?)(?=$|[;\n]|\s{2,})")
SUPPORTS = re.compile(rf"\bSupports?\s+(?:up to\s+)?({_COUNT}|\d+)\s+(\w[\w\s/\-]{{0,28}}?)\s+(interfaces?|channels?|ports?|lanes|bits|cores?|displays?|cameras?|screens?|controllers?)\b", re.I)
RESOLUTION = re.compile(r"\b(H\.26[45]|HEVC|VP\d|AV\d|MPEG-?\d|JPEG)[\w\s/(),.\-]{0,30}?(?:up to|max(?:imum)?)\s+(\d{3,5}\s*[x×]\s*\d{3,5}(?:\s*@\s*\d+\s*fps)?|[48]K(?:\s*@\s*\d+\s*fps)?)", re.I)
PROTOCOL = re.compile(r"\bSupports?\s+(?:up to\s+)?([A-Za-z][A-Za-z\-]*\s?\d+(?:\.\d+)?)(\([^)]{1,20}\))?[\w\s()/%.]*?\b(protocol|standard|interface|revision|version)\b", re.I)
#: What page analysis has added to a page, to its end.
GENERATED = re.compile(r"(?:---\s*#{0,3}\s*Page Visual Analysis \(VLM\)|===\s*Page Chart Content Analysis\s*===).*", re.S | re.I)
#: What every RESOLUTION begins with.
CODECS = re.compile(r"h\.26|hevc|vp\d|av\d|mpeg|jpeg")
FACT = "doc_id string, entity string, attribute string, value string, page_num int, source_text string"


@dataclass(frozen=True)
class Vocabulary:
    """What a pack knows of facts: headers that announce a value, units of measured attributes, words for frequency."""

    headers: tuple[str, ...] = ()
    units: dict[str, tuple[str, ...]] = field(default_factory=dict)
    frequency: tuple[str, ...] = ()

    def __bool__(self) -> bool:
        return bool(self.headers or self.units or self.frequency)


def _clean(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip(" \t\r\n:;,.")


def sentence(lines: list[str], at: int, most: int = 300) -> str:
    """A line and those after it as long as it breaks off: at a comma or a word that can't end a sentence (W-12)."""
    whole = lines[at].strip()
    for line in lines[at + 1 :]:
        last = whole.rsplit(" ", 1)[-1].lower()
        if len(whole) >= most or not (whole.endswith(",") or last in DANGLING) or len(line.strip()) < 2:
            break
        whole += " " + line.strip()
    return whole[:most]


class Reader:
    """Facts of a page by seven patterns; each fact's value occurs in its source."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        some = lambda words: "|".join(re.escape(w) for w in words)
        self.measured = [(attribute, re.compile(rf"\b(\d+(?:\.\d+)?)\s*({some(units)})\b", re.I)) for attribute, units in vocabulary.units.items() if units]
        self.units = [u.lower() for units in vocabulary.units.values() for u in units]
        self.headers = {h.lower() for h in vocabulary.headers}
        self.clock = re.compile(rf"\b((?:Max\s+)?[A-Za-z][A-Za-z0-9 \-/]{{0,24}}?)\s+(?:{some(vocabulary.frequency)})\s*(?:rate)?\s*[:|]?\s*[^0-9\n]{{0,12}}?\s*(\d+(?:\.\d+)?)\s*([A-Za-z]{{0,3}}Hz)\b", re.I) if vocabulary.frequency else None

    def facts(self, text: str) -> list[tuple[str, str, str]]:
        """(attribute, value, source) of a page, once each."""
        if not self.vocabulary or not text:
            return []
        found: dict[tuple[str, str], tuple[str, str, str]] = {}

        def add(attribute: str, value: str, source: str, shown: str | None = None):
            attribute, value = _clean(attribute), _clean(value)
            if not attribute or not value or len(value) > 60 or len(attribute) > 45 or attribute.lower() in GENERAL:
                return
            if (shown or value).lower() in source.lower():
                found.setdefault((attribute.lower(), value.lower()), (attribute, value, source))

        lines = GENERATED.sub("", text).split("\n")
        for k, raw in enumerate(lines):
            line = raw.strip()
            if len(line) < 2:
                continue
            source = sentence(lines, k)
            before = lines[k - 1].strip() if k else ""
            named = len(before) < 20 and before.lower() in self.headers
            announced = before.endswith(":") and 3 <= len(before) <= 31 and any(c.isalpha() for c in before)
            if (named or announced) and len(line) < 60 and not line.endswith(":"):
                add(before, line, f"{before} {line}")
            if len(line) < 6:
                continue
            # a pattern is tried only where a word stands that it can't do without
            low = source.lower()
            for m in RESOLUTION.finditer(source) if CODECS.search(low) else ():
                add(f"{m[1]} max resolution", m[2], source)
            supports = "support" in low
            for m in SUPPORTS.finditer(source) if supports else ():
                add(f"{m[2]} {m[3]} count", str(NUMBER_WORDS.get(m[1].lower(), m[1])), source, m[1])
            for attribute, pattern in self.measured if any(u in low for u in self.units) else ():
                for m in pattern.finditer(source):
                    add(attribute, f"{m[1]} {m[2]}", source, m[0])
            if self.clock and "hz" in low:
                for m in self.clock.finditer(source):
                    add(f"{m[1]} frequency", f"{m[2]} {m[3]}", source, m[2])
            for m in PROTOCOL.finditer(source) if supports else ():
                lead = re.sub(r"\s+", "", m[1])
                family = re.match(r"[A-Za-z\-]+", lead)[0]
                others = dict.fromkeys(re.sub(r"\s+", "", v) for v in re.findall(rf"\b{re.escape(family)}\s?\d+(?:\.\d+)?", source, re.I))
                value = ", ".join([lead + (m[2] or ""), *[v for v in others if v.lower() != lead.lower()]])
                add(f"{family} {m[3]}", value, source, m[1])
            for m in KEY_VALUE.finditer(line) if ":" in line else ():
                add(m[1], m[2], source)
        return list(found.values())


def extract(pages: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """FACT of pages (doc_id, page_num, entity, raw_text) (X-01, X-02, X-04).  A task holds the texts and facts of a slice, whatever a batch or the table has."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(vocabulary)
        for part in slices(batches, 3):
            found = [(n, *fact) for n, text in enumerate(part.column(3).to_pylist()) for fact in reader.facts(text or "")]
            if found:
                rows, attribute, value, source = zip(*found, strict=True)
                doc, page, entity = (part.column(k).take(pa.array(rows)) for k in range(3))
                made = [doc, entity, pa.array(attribute, pa.string()), pa.array(value, pa.string()), page, pa.array(source, pa.string())]
                yield pa.RecordBatch.from_arrays(made, names=[c.split()[0] for c in FACT.split(", ")])

    keys = [F.col(c).cast(kind) for c, kind in (("doc_id", "string"), ("page_num", "int"), ("entity", "string"))]
    return pages.select(*keys, "raw_text").mapInArrow(run, FACT)


def infer_entity(title: Column, filename: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that fits title or file name, else the title's first 40 characters (X-03)."""
    from ..functions.text import clean_title

    found = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns for c in (title, filename)]
    return F.coalesce(*found, F.substring(clean_title(title), 1, 40))


def spread(facts: DataFrame, words: DataFrame) -> DataFrame:
    """(term, spread): how many distinct attributes a keyword touches, in attribute, value or source (A-08)."""
    text = F.lower(F.concat_ws(" ", "attribute", "value", "source_text"))
    marked = with_vocabulary(facts.select("attribute", text.alias("_t")), words.select(F.lower("term").alias("term")))
    hits = marked.select("attribute", F.explode(F.filter("_terms", lambda w: F.contains(F.col("_t"), w))).alias("term"))
    return hits.groupBy("term").agg(F.countDistinct("attribute").alias("spread"))


def lookup(facts: DataFrame, questions: DataFrame, limit: int = DEFAULT.facts_max) -> DataFrame:
    """(query_id, fact columns, hits, rank): facts with two keywords of a question at least (R-21, R-22).

    Keywords that touch more than three attributes and are no entity are dropped; a question that names entities gets
    their facts alone; the most hits come first, then page and id.
    """
    words = questions.select("query_id", F.explode(fact_keywords(F.col("query"))).alias("word")).withColumn("term", F.lower("word"))
    entities = facts.select(F.lower(F.trim("entity")).alias("term")).distinct()
    named = words.join(entities, "term", "left_semi").select("query_id", "term")
    wide = spread(facts, words).where(F.col("spread") > DEFAULT.facts_max_attributes).select("term").join(named.select("term"), "term", "left_anti")
    asked = words.select("query_id", "term").distinct().join(F.broadcast(wide), "term", "left_anti")
    text = F.lower(F.concat_ws(" ", "entity", "attribute", "value", "source_text"))
    marked = with_vocabulary(facts.withColumn("_t", text), asked.select("term"))
    hits = marked.select("fact_id", F.explode(F.filter("_terms", lambda w: F.contains(F.col("_t"), w))).alias("term"))
    counted = hits.join(F.broadcast(asked), "term").groupBy("query_id", "fact_id").agg(F.count("*").alias("hits")).where(F.col("hits") >= DEFAULT.facts_min_hits)
    models = questions.select("query_id", F.explode(model_tokens(F.col("query"))).alias("m")).select("query_id", F.lower("m").alias("term"))
    only = models.join(entities, "term", "left_semi")
    restricted = only.groupBy("query_id").agg(F.collect_set("term").alias("_only"))
    joined = counted.join(facts, "fact_id").join(F.broadcast(restricted), "query_id", "left")
    joined = joined.where(F.col("_only").isNull() | F.array_contains("_only", F.lower(F.trim("entity")))).drop("_only")
    return top(joined, ["query_id"], [F.col("hits").desc(), F.col("page_num"), F.col("fact_id")], limit)


def render(found: DataFrame) -> DataFrame:
    """(query_id, block): facts of a question as lines by entity, quoted sources first seen once (R-23)."""
    c = DEFAULT
    line = F.concat(F.lit("- "), "attribute", F.lit(": "), "value", F.lit(" (p."), F.col("page_num").cast("string"), F.lit(")"))
    lines = found.groupBy("query_id", "entity").agg(F.min("rank").alias("first"), F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))).alias("l"))
    block = F.concat(F.lit("["), "entity", F.lit("]\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n"))
    whole = lines.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("first", block.alias("b")))).alias("blocks"))
    sources = found.withColumn("key", F.concat_ws("|", F.substring("source_text", 1, 80), F.col("page_num").cast("string")))
    once = sources.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("rank"))).where("r = 1")
    once = top(once.drop("rank").withColumn("o", F.col("fact_id")), ["query_id"], [F.col("hits").desc(), F.col("o")], c.evidence_max)
    quoted = once.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("> "), F.substring("source_text", 1, 300)).alias("t")))).alias("q"))
    return whole.join(quoted, "query_id", "left").select("query_id", F.concat(F.array_join(F.transform("blocks", lambda x: x["b"]), "\n"), F.lit("\n"), F.array_join(F.transform("q", lambda x: x["t"]), "\n")).alias("block"))
