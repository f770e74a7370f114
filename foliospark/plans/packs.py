"""Packs: vocabularies and rules by field, composed, found by id, category or text, and spread to executors as tables.

A pack is a folder with manifest.yaml (id, name, version, category_mapping) and any of prompts.yaml, rules.yaml,
skill.yaml, glossary.yaml and taxonomy.yaml; folders whose name begins with _ are passed over.  Behaviour beyond data
is a set of callables (hooks).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("prompts", "rules", "skill", "glossary", "taxonomy")
RULE_SCHEMA = "rule string, query_keywords array<string>, keywords array<string>, amount double, unless array<string>"


@dataclass(frozen=True)
class Hooks:
    """What a pack may do in code: at ingestion by page or document, at retrieval by question (PL-01, PL-02)."""

    classify: Callable[[str], dict] | None = None
    extract_entities: Callable[[str], dict[str, list[str]]] | None = None
    detect_subtype: Callable[[str, str], str] | None = None
    process_page: Callable[[str], tuple[str, dict, str]] | None = None
    on_complete: Callable[[str], None] | None = None
    rewrite: Callable[[str], str] | None = None
    supplement: Callable[[str, DataFrame], DataFrame] | None = None
    post_process: Callable[[str], str] | None = None


@dataclass(frozen=True)
class Pack:
    id: str
    name: str = ""
    version: str = "1"
    categories: tuple[str, ...] = ()
    data: dict = field(default_factory=dict)
    hooks: Hooks = Hooks()

    def rules(self, key: str, default=None):
        return self.data.get("rules", {}).get(key, default)


def _yaml(path: Path) -> dict:
    """A YAML file where a parser is installed, else JSON of the same name."""
    twin = path.with_suffix(".json")
    if twin.exists():
        return json.loads(twin.read_text()) or {}
    import yaml

    return yaml.safe_load(path.read_text()) or {}


def load(folder: Path) -> Pack:
    read = lambda part: _yaml(folder / f"{part}.yaml") if (folder / f"{part}.yaml").exists() or (folder / f"{part}.json").exists() else {}
    manifest = read("manifest")
    return Pack(manifest["id"], manifest.get("name", ""), str(manifest.get("version", "1")), tuple(manifest.get("category_mapping", ())), {part: read(part) for part in PARTS})


def scan(root: str | Path) -> dict[str, Pack]:
    """All packs below a folder, by id (S-14)."""
    folders = [p for p in sorted(Path(root).iterdir()) if p.is_dir() and not p.name.startswith("_") and any((p / f"manifest.{x}").exists() for x in ("yaml", "json"))]
    return {pack.id: pack for pack in map(load, folders)}


def merged(base, over):
    """Two values as one: dictionaries by key, lists joined without repetition, anything else from over (U-04)."""
    if isinstance(base, dict) and isinstance(over, dict):
        return {k: merged(base[k], over[k]) if k in base and k in over else over.get(k, base.get(k)) for k in [*base, *(k for k in over if k not in base)]}
    if isinstance(base, list) and isinstance(over, list):
        return base + [x for x in over if x not in base]
    return base if over is None else over


def compose(base: Pack, over: Pack) -> Pack:
    """A pack over a base: its own identity, both their data, its hooks before the base's (PL-04)."""
    hooks = Hooks(**{k: getattr(over.hooks, k) or getattr(base.hooks, k) for k in Hooks.__dataclass_fields__})
    return Pack(over.id, over.name, over.version, over.categories, merged(base.data, over.data), hooks)


class Registry:
    """Packs by id, category and text (PL-05)."""

    def __init__(self, packs: dict[str, Pack], generic: str = "generic"):
        self.packs, self.generic = packs, generic

    def by_id(self, id: str) -> Pack | None:
        return self.packs.get(id)

    def score(self, pack: Pack, category: str) -> float:
        low = category.lower()
        return max((1.0 if c.lower() == low else 0.8 if low in c.lower() or c.lower() in low else 0.0 for c in pack.categories if c and low), default=0.0)

    def by_category(self, category: str, fallback: bool = True) -> Pack | None:
        best = max(self.packs.values(), key=lambda p: (self.score(p, category), p.id), default=None)
        if best and self.score(best, category) > 0:
            return best
        return self.packs.get(self.generic) if fallback else None

    def by_text(self, text: str) -> Pack | None:
        """The pack most of whose detection words a text has."""
        low = text.lower()
        hits = {p.id: sum(w.lower() in low for w in p.rules("detect", [])) for p in self.packs.values()}
        best = max(hits, key=lambda i: (hits[i], i), default=None)
        return self.packs[best] if best and hits[best] else self.packs.get(self.generic)

    def assign(self, spark: SparkSession, documents: DataFrame, category: str) -> DataFrame:
        """documents with pack: the best category match, else the generic pack; packs are a small table that travels."""
        rows = [(p.id, c.lower()) for p in self.packs.values() for c in p.categories]
        known = spark.createDataFrame(rows or [("", "")], "pack string, mapped string")
        kinds = documents.select(F.lower(F.coalesce(category, F.lit(""))).alias("kind")).distinct()
        score = F.when(F.col("kind") == F.col("mapped"), 1.0).when((F.col("kind") != "") & (F.contains("kind", F.col("mapped")) | F.contains("mapped", F.col("kind"))), 0.8)
        best = kinds.join(F.broadcast(known)).withColumn("s", score).where("s is not null").groupBy("kind").agg(F.max_by("pack", F.struct("s", "pack")).alias("pack"))
        joined = documents.withColumn("kind", F.lower(F.coalesce(category, F.lit("")))).join(best, "kind", "left")  # a row for each distinct category: Spark broadcasts it if it turns out small
        return joined.withColumn("pack", F.coalesce("pack", F.lit(self.generic))).drop("kind")

    def boost_rules(self, spark: SparkSession, pack: Pack) -> DataFrame:
        """A pack's boosts and penalties as the table that retrieval.boost takes."""
        rows = []
        for name, rule in pack.rules("boost_rules", {}).items():
            for kind, amount in (("boost_sections", "boost"), ("penalize_sections", "penalty")):
                rows += [(name, rule.get("query_keywords", []), item.get("keywords", []), float(item.get(amount, 0)), item.get("unless_query_contains", [])) for item in rule.get(kind, [])]
        return spark.createDataFrame(rows, RULE_SCHEMA)


    def process(self, pages: DataFrame) -> DataFrame:
        """(doc_id, page_num, subtype, data, searchable, entities): what each page's pack (pages: doc_id, page_num, pack, filename, text) makes of it (PL-01).

        A pack without hooks leaves nulls; data and entities are JSON.
        """
        known = self.packs

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                out = []
                for doc, page, pack, filename, text in zip(part["doc_id"], part["page_num"], part["pack"], part["filename"], part["text"], strict=True):
                    hooks = known[pack].hooks if pack in known else Hooks()
                    kind = hooks.detect_subtype(filename or "", text or "") if hooks.detect_subtype else None
                    own, data, searchable = hooks.process_page(text or "") if hooks.process_page else (None, None, None)
                    entities = hooks.extract_entities(text or "") if hooks.extract_entities else None
                    out.append((doc, page, own or kind, None if data is None else json.dumps(data, sort_keys=True), searchable, None if entities is None else json.dumps(entities, sort_keys=True)))
                yield pd.DataFrame(out, columns=["doc_id", "page_num", "subtype", "data", "searchable", "entities"])

        kind = pages.schema["doc_id"].dataType.simpleString()
        rows = pages.select("doc_id", F.col("page_num").cast("int").alias("page_num"), "pack", "filename", "text")
        return rows.mapInPandas(run, f"doc_id {kind}, page_num int, subtype string, data string, searchable string, entities string")


#: A generic pack and a sample one with neutral vocabulary.
GENERIC = Pack("generic", "Any field", "1", (), {"rules": {"units": ["mm", "kg", "%", "V", "A", "Hz"], "low_value": ["contents", "copyright", "revision history"], "detect": []}})
SAMPLE = Pack("sample_parts", "Parts catalogue", "1", ("ECONOMY", "STANDARD"), {
    "rules": {"units": ["TOPS"], "detect": ["widget", "gear"], "vocabulary": {"power": ["voltage", "current"]}, "boost_rules": {"size": {"query_keywords": ["size"], "boost_sections": [{"keywords": ["small"], "boost": 1.5}], "penalize_sections": [{"keywords": ["promo"], "penalty": -1.0, "unless_query_contains": ["promo"]}]}}},
    "glossary": {"ring": "closed part"},
})
