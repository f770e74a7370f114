"""Queries that SQL can't express, each against a plain version of the same rows."""

from __future__ import annotations

import re

import duckdb
import pytest

from foliospark import catalog
from foliospark.config import DEFAULT
from foliospark.operators import agentic, facts, retrieval
from foliospark.queries import facts as fact_queries

DATA = "/root/testdata/sf0.001"


def sql(text):
    return duckdb.sql(text.replace("{", f"'{DATA}/").replace("}", ".parquet'")).fetchall()


def rows(spark, name):
    return catalog.queries()[name](spark, DATA).collect()


def plain_chunks(text, most):
    """Chunks by structure, line by line."""
    done, held = [], []

    def end():
        if "\n".join(held).strip():
            done.append("\n".join(held).strip())
        held.clear()

    lines = text.split("\n")
    while lines:
        line = lines.pop(0)
        table = [line] if retrieval_table(line) else []
        while table and lines and retrieval_table(lines[0]):
            table.append(lines.pop(0))
        piece = table or [line]
        size = sum(len(x) + 1 for x in piece)
        assert not table or size <= 1.5 * most, "no large tables in these texts"
        if (not table and re.match(r"^#{1,6}\s", line.strip())) or sum(len(x) + 1 for x in held) + size > most:
            end()
        if not table and len(line) > most:
            done.extend(c for c in (line[k : k + most].strip() for k in range(0, len(line), most)) if c)
        else:
            held.extend(piece)
    end()
    if len(done) <= 1 and len(text) > most:
        return [text[k : k + most] for k in range(0, len(text) - most // 10, most - most // 10)]
    return done or [text]


def retrieval_table(line):
    return line.strip().startswith("|") and line.strip().endswith("|") and len(line.strip()) > 1


def test_chunk_structural(spark):
    from foliospark.operators.chunking import is_heading, is_table_row

    docs = sql("select doc_id, coalesce(text, '') from {documents}")
    lines = {line for _, t in docs for line in t.split("\n")}
    plain = [d for d in docs if not any(is_table_row(x) != retrieval_table(x) or (is_heading(x) and not re.match(r"^#{1,6}\s", x.strip())) for x in d[1].split("\n"))]
    assert lines and len(plain) > 0.7 * len(docs)
    found: dict = {}
    for r in sorted(rows(spark, "chunk_structural"), key=lambda r: (r["doc_id"], r["idx"])):
        found.setdefault(r["doc_id"], []).append(r["chunk"])
    assert set(found) == {i for i, _ in docs}
    for i, text in plain:
        assert found[i] == plain_chunks(text, 1600)
    for i, text in docs:
        assert all(len(c) <= 1.5 * 1600 + 130 for c in found[i])
        if "|" not in text and len(found[i]) > 1:
            assert len(re.sub(r"\s", "", "".join(found[i]))) >= len(re.sub(r"\s", "", text))


def test_chunk_sections(spark):
    pages = sql("select conv_id, turn, role, coalesce(text, '') from {conversations} order by 1, 2")
    found: dict = {}
    for r in sorted(rows(spark, "chunk_sections"), key=lambda r: (r["doc_id"], r["chunk_idx"])):
        found.setdefault(r["doc_id"], []).append(r)
    for doc in {p[0] for p in pages}:
        own = [p for p in pages if p[0] == doc and len(p[3].strip()) >= 10]
        runs: list = []
        for _, turn, role, text in own:
            if not runs or runs[-1][1] != role:
                runs.append([turn, role, ""])
            runs[-1][2] += text
        chunks = found.get(doc, [])
        assert [c["chunk_idx"] for c in chunks] == list(range(len(chunks)))
        assert all(len(c["chunk"]) <= 1.5 * DEFAULT.chunk_chars + 130 for c in chunks)
        # a section's text is all there, in order; a run of one role is one section
        assert [k for k, _ in groupless([c["section_path"] for c in chunks])] == [r[1] for r in runs]
        for (_, held), (turn, _, text) in zip(groupless([c["section_path"] for c in chunks]), runs, strict=True):
            whole = "".join(chunks[k]["chunk"] for k in held)
            assert len(re.sub(r"\s", "", whole)) >= len(re.sub(r"\s", "", text)) and chunks[held[0]]["page_num"] == turn


def groupless(values):
    out: list = []
    for k, v in enumerate(values):
        if out and out[-1][0] == v:
            out[-1][1].append(k)
        else:
            out.append((v, [k]))
    return out


def test_structure_from_text(spark):
    def heading(line):
        line = line.strip()
        if m := re.match(r"^(#{1,6})\s+(.+)", line):
            return len(m[1]), m[2].strip(), m[2].strip()
        if m := re.match(r"^(\d+(?:\.\d+)*)[\s、．.]{1,3}(.+)", line):
            return m[1].count(".") + 1, m[1], m[2].strip()
        if m := re.match(r"^(Chapter|Section|Part)\s+(\d+|[A-Z])\s+(.+)", line, re.I):
            return None
        return None

    pages = sql("select conv_id, turn, role, text from {conversations} order by 1, 2")
    found = {(r["doc_id"], r["page_num"]): (r["section_level"], r["section_path"], r["section_title"]) for r in rows(spark, "structure_from_text")}
    last: dict = {}
    checked = 0
    for doc, turn, role, text in pages:
        page = (f"{turn // 4 + 1}. {role}\n" if turn % 4 == 0 else "") + text
        if re.search(r"(?im)^\s*(第|chapter|section|part)\b", page):
            last.pop(doc, None)
            continue
        own = next((h for h in map(heading, page.split("\n")[:30]) if h), None)
        if own:
            last[doc] = own
        if doc in last:
            assert found[(doc, turn)] == last[doc]
            checked += 1
    assert checked > 0.8 * len(pages)


def test_merge_contexts(spark):
    texts = dict(sql("select doc_id, text from {documents}"))
    sources = dict(sql("select doc_id, source from {documents}"))
    hits: dict = {}
    for r in rows(spark, "bm25_document_topk"):
        hits.setdefault(r["query_id"], []).append(r)
    merged = {r["query_id"]: r for r in rows(spark, "merge_contexts")}
    assert set(merged) == set(hits)
    for q, own in hits.items():
        context = merged[q]["context"]
        assert merged[q]["chars"] == len(context) <= DEFAULT.merge_max
        best: dict = {}
        for r in own:
            s = sources[r["doc_id"]]
            best[s] = max(best.get(s, 0), r["score"])
        heads = re.findall(r"\n===== Document: (\S+) =====\n", context)
        scores = [best[h] for h in heads]
        assert scores == sorted(scores, reverse=True) and heads and set(heads) <= set(best)
        share = max(DEFAULT.merge_max // len(best), DEFAULT.merge_min_per_doc) if len(best) > 1 else DEFAULT.merge_max
        parts = re.split(r"\n\n===== Document: \S+ =====\n", context)[1:]
        assert all(len(p) <= share + 3 for p in parts)
        shown = [(int(k), int(page)) for k, page in re.findall(r"\n--- part (\d+) \(Page (\d+)\) ---\n", context)]
        assert len(shown) == merged[q]["pages"] and set(shown) <= {(r["rank"], r["doc_id"]) for r in own}
        first = next(r for r in own if r["rank"] == 1)
        if len(texts[first["doc_id"]]) < 3000:
            assert texts[first["doc_id"]] in context


def test_fact_extraction(spark):
    """Every pattern tried on every line, without the words that open the way to it."""
    docs = sql("select doc_id, source, text from {documents}")
    found: dict = {}
    for r in rows(spark, "fact_extraction"):
        found.setdefault(r["doc_id"], set()).add((r["attribute"], r["value"]))
    v = fact_queries.VOCABULARY
    for i, _, text in docs:
        page = f"{text}\nball size: 0.{i % 90}mm\nSupport ten UART interfaces.\nNPU: up to {i % 7} TOPS.\nMax CPU frequency NA 2 GHz"
        own = found[str(i)]
        assert ("ball size", f"0.{i % 90}mm") in own and ("UART interfaces count", "10") in own
        reader = facts.Reader(v)
        reader.units = [""]
        sources = {s for _, _, s in reader.facts(page)}
        for pattern, made in ((facts.RESOLUTION, lambda m: (f"{m[1]} max resolution", m[2])), (facts.SUPPORTS, lambda m: (f"{m[2]} {m[3]} count", None))):
            for source in {facts.sentence(page.split("\n"), k) for k in range(len(page.split("\n")))} - sources:
                for m in pattern.finditer(source):
                    attribute, _ = made(m)
                    assert len(attribute) > 45 or attribute.lower() in facts.GENERAL or any(a.lower() == re.sub(r"\s+", " ", attribute).lower() for a, _ in own)
        assert {(a, x) for a, x, _ in reader.facts(page)} == own


def test_fact_rendering(spark):
    asked = spark.createDataFrame(list(fact_queries.QUESTIONS), "query_id int, query string")
    found: dict = {}
    for r in sorted(facts.lookup(fact_queries.facts(spark, DATA), asked).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r)
    blocks = {r["query_id"]: r["block"] for r in rows(spark, "fact_rendering")}
    assert set(blocks) == set(found) and found
    for q, own in found.items():
        lines = [x for e in dict.fromkeys(r["entity"] for r in own) for x in (f"[{e}]", *(f"- {r['attribute']}: {r['value']} (p.{r['page_num']})" for r in own if r["entity"] == e))]
        told = blocks[q].split("\n")
        assert told[: len(lines)] == lines
        quoted = [x[2:] for x in told[len(lines) :]]
        assert len(quoted) == len(set(quoted)) <= DEFAULT.evidence_max and set(quoted) <= {r["source_text"][:300] for r in own}


def test_engine_ask(spark):
    found = {r["query_id"]: r for r in rows(spark, "engine_ask")}
    assert set(found) == {1, 2, 3}
    assert found[3]["pages"] == 0 and found[3]["answer"] == "No relevant information was found."
    texts = " ".join(" ".join(t.split()) for (t,) in sql("select text from {documents} where text is not null"))
    for k, words in ((1, ("license", "gnu", "general", "public")), (2, ("worthless", "pathetic", "scum"))):
        answer = found[k]["answer"]
        assert found[k]["pages"] > 0 and any(w in answer.lower() for w in words)
        assert any(s.strip() in texts for s in re.split(r"(?<=[.!?])\s+", answer) if s.strip())
        assert found[k]["confidence"] in ("low", "medium", "high")


def test_queue_is_a_queue(spark):
    requests = [(1, 0, 5, 0), (1, 1, 1, 1), (1, 20, 2, 2), (1, 20, 3, 3), (2, 3, 4, 4), (1, 21, 1, 5)]
    found = {r["id"]: (r["start"], r["wait"]) for r in agentic.queue(spark.createDataFrame(requests, "key int, at int, service int, id int"), ["key"], "at", "service", "id").collect()}
    free: dict = {}
    for key, at, service, i in sorted(requests, key=lambda x: (x[0], x[1], x[3])):
        start = max(at, free.get(key, 0))
        free[key] = start + service
        assert found[i] == (start, start - at)


@pytest.mark.parametrize("k", [1, 3, 500])
def test_vector_search(spark, k):
    import numpy as np

    rng = np.random.default_rng(3)
    x = [(i, [float(v) for v in rng.integers(-2, 3, 5)]) for i in range(200)] + [(300, None), (301, []), (302, [1.0]), (303, [0.0] * 5), (304, [float("nan")] * 5)]
    vectors = spark.createDataFrame(x, "vec_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(0, x[0][1]), (7, x[7][1]), (303, [0.0] * 5)], "query_id long, embedding array<double>")
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in retrieval.vector_search(vectors, asked, k).collect())
    expected = []
    for q in (0, 7):
        a = np.array(x[q][1])
        scored = [(-round(float(a @ np.array(v) / np.linalg.norm(a) / np.linalg.norm(v)), 6), i) for i, v in x[:200] if np.linalg.norm(v) > 0]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    assert [f[:3] for f in found] == [e[:3] for e in sorted(expected)]
    assert [f[3] for f in found] == pytest.approx([e[3] for e in sorted(expected)], abs=2e-6)
