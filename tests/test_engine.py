"""Operators outside the training-data subpackage: behaviour on small inputs, plans, and SQL agreement."""

from __future__ import annotations

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from foliospark import catalog
from foliospark.engine import Engine
from foliospark.functions import admin, text
from foliospark.operators import chunking, facts, layout, relational, retrieval
from foliospark.plans import model, packs, planner
from foliospark.sources import files
from foliospark.sources.store import Store
from foliospark.streaming import admission, states

DATA = "/root/testdata/sf0.001"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


# text


@pytest.mark.parametrize(
    ("query", "expected"),
    [("RK3588 的详细规格是什么", ["的详细规格是什么", "RK3588"]), ("version 2024 compare", ["version", "compare"]), ("12345", []), ("", [])],
)
def test_query_keywords(spark, query, expected):
    assert one(spark, text.query_keywords(F.col("q")), q=query) == expected


def test_chunk_and_page_tokens(spark):
    assert one(spark, text.chunk_tokens(F.col("q")), q="电源管理X1") == ["电源", "源管", "管理", "X1"]
    assert one(spark, text.page_tokens(F.col("q")), q="营业收入和") == ["营业", "收入", "入和"]


def test_page_invariants_and_summary(spark):
    assert one(spark, text.page_summary(F.col("t")), t="short") == "short"
    assert one(spark, text.page_summary(F.col("t")), t="句。" * 150) == "句。句。句"
    assert one(spark, text.strip_generated(F.col("t")), t="kept\n--- ### Page Visual Analysis (VLM)\nSummary: x") == "kept\n"
    assert one(spark, text.strip_generated(F.col("t")), t=None) == ""


def test_titles(spark):
    assert one(spark, text.clean_title(F.col("t")), t="Overview ....  12 ") == "Overview"
    assert one(spark, text.filename_title(F.col("t")), t="0123abcd-0123-0123-0123-0123456789ab_data_sheet-v2.pdf") == "data sheet v2"
    assert one(spark, text.is_uuid_like(F.col("t")), t="0123456789abcdef0123456789abcdef")


@pytest.mark.parametrize(("score", "cap"), [(6.0, 16000), (2.5, 10000), (0.6, 6000), (0.2, 3000), (0.0, 3000)])
def test_content_cap(spark, score, cap):
    assert one(spark, text.content_cap(F.col("s")), s=score) == cap


@pytest.mark.parametrize(("n", "expected"), [(3, 45), (40, 500), (0, 20)])
def test_max_results(spark, n, expected):
    assert one(spark, text.max_results(F.col("n")), n=n) == expected


@pytest.mark.parametrize(("vram", "context"), [(16311, 131072), (32768, 262144), (8192, 32768), (6144, None)])
def test_hardware(spark, vram, context):
    assert one(spark, admin.recommended_context(F.col("v")), v=vram) == context


def test_smart_truncate():
    page = "Voltage is 5 V here. " + "Filler words without sense. " * 40
    short = retrieval.smart_truncate(page, "voltage", 60)
    assert len(short) <= 100 and "..." in short
    assert retrieval.smart_truncate("tiny", "x", 60) == "tiny"


def test_excerpt_prefers_tables():
    page = "AB123 in prose.\n" + "x" * 3000 + "\n| AB123 | 5 V |\n" + "y" * 3000
    cut, table = retrieval.excerpt(page, ["AB123"], 200, 4)
    assert table and "| AB123 | 5 V |" in cut and "prose" not in cut
    assert retrieval.excerpt(page, ["zz"]) == ("", False)


# chunks


def test_structural_chunks_keep_content_and_bound():
    doc = "# A\n" + "line of text\n" * 300 + "## B\n" + "z" * 5000 + "\n| h | i |\n|---|---|\n" + "| 1 | 2 |\n" * 500
    chunks = chunking.structural(doc, 1000)
    assert all(len(c) <= 1500 for c in chunks)
    assert sum(c.count("z") for c in chunks) == 5000
    assert sum(c.count("line of text") for c in chunks) == 300
    assert sum(c.count("| 1 | 2 |") for c in chunks) == 500
    assert all("| h | i |" in c for c in chunks if "| 1 | 2 |" in c)
    assert chunking.structural("") == [""]


def test_windows_cover(spark):
    df = spark.createDataFrame([(1, "abcdefghij" * 50), (2, ""), (3, "short")], "id int, t string")
    got = {}
    for r in chunking.fixed_chunks(df, "id", "t", 100, 20).collect():
        got.setdefault(r["id"], []).append((r["idx"], r["chunk"]))
    whole = "".join(c if not i else c[20:] for i, c in sorted(got[1]))
    assert whole == "abcdefghij" * 50 and got[2] == [(0, "")] and got[3] == [(0, "short")]


# facts

VOCABULARY = facts.Vocabulary(headers=("Package",), units={"compute power": ("TOPS",)}, frequency=("frequency", "clock"))


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("The chip Supports ten UART interfaces.", {("UART interfaces count", "10")}),
        ("ball size: 0.35mm\nball pitch: 0.65mm", {("ball size", "0.35mm"), ("ball pitch", "0.65mm")}),
        ("NPU with up to 1 TOPS.", {("compute power", "1 TOPS")}),
        ("2.2 Top Marking\nOutput 1 Top frame mode", set()),
        ("Max frequency for CPU Frequency NA NA TBD GHz", set()),
    ],
)
def test_facts(page, expected):
    assert {(a, v) for a, v, _ in facts.Reader(VOCABULARY).facts(page)} == expected


def test_facts_need_vocabulary_and_sources():
    assert facts.Reader(facts.Vocabulary()).facts("ball size: 0.35mm") == []
    found = facts.Reader(VOCABULARY).facts("Support PCIe3.1 protocol and compatible with\nthe PCIe2.1 and\nPCIe1.1 protocol")
    assert found[0][1] == "PCIe3.1, PCIe2.1, PCIe1.1" and "\n" not in found[0][2] and len(found[0][2]) <= 300


def test_selectivity(spark):
    rows = [(k, "E1", f"attr {k}", "v", f"Support thing{k}", k) for k in range(6)] + [(9, "E1", "pcie", "PCIe3", "Support pcie lanes", 1)]
    table = spark.createDataFrame(rows, "fact_id int, entity string, attribute string, value string, source_text string, page_num int")
    words = spark.createDataFrame([("support",), ("pcie",), ("bluetooth",)], "term string")
    assert {r["term"]: r["spread"] for r in facts.spread(table, words).collect()} == {"support": 7, "pcie": 1}
    asked = spark.createDataFrame([(1, "support of bluetooth"), (2, "pcie of E1")], "query_id int, query string")
    assert {(r["query_id"], r["fact_id"]) for r in facts.lookup(table, asked).collect()} == {(2, 9)}


# relational


def test_as_of_and_fill(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 1, "c")], "k int, t int, x string")
    right = spark.createDataFrame([(1, 5, 50), (1, 7, 70), (2, 2, 20)], "k int, t int, v int")
    assert sorted(map(tuple, relational.as_of(left, right, ["k"], "t", ["v"]).collect())) == [(1, 5, "a", 50), (1, 9, "b", 70), (2, 1, "c", None)]


def test_range_join_crosses_cells(spark):
    points = spark.createDataFrame([(1, p) for p in range(60)], "k int, p int")
    ranges = spark.createDataFrame([(1, 10, 40, "a"), (1, 15, 15, "b"), (2, 0, 99, "c")], "k int, s int, e int, n string")
    got = relational.range_join(points, "p", ranges, "s", "e", ["k"], 8).groupBy("n").count().collect()
    assert {r["n"]: r["count"] for r in got} == {"a": 31, "b": 1}


def test_islands_and_ends(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate("aabba")], "d int, o int, v string")
    assert sorted(map(tuple, relational.islands(df, ["d"], "o", "v").collect())) == [(1, "a", 0, 1, 2), (1, "a", 4, 4, 1), (1, "b", 2, 3, 2)]


# plans, packs, models


def test_packs_compose_and_find(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "p" / "manifest.json").write_text('{"id": "p", "category_mapping": ["Chips"]}')
    (tmp_path / "p" / "rules.json").write_text('{"units": ["V", "TOPS"], "detect": ["npu"]}')
    found = packs.scan(tmp_path)
    assert list(found) == ["p"]
    whole = packs.compose(packs.GENERIC, found["p"])
    assert whole.rules("units")[-1] == "TOPS" and whole.rules("units").count("V") == 1
    registry = packs.Registry({"generic": packs.GENERIC, "p": whole})
    assert registry.by_category("chips").id == "p" and registry.by_category("food").id == "generic" and registry.by_category("food", False) is None
    assert registry.by_text("An NPU inside").id == "p"


def test_model_fallbacks():
    class Broken:
        calls = 0

        def generate(self, prompt):
            Broken.calls += 1
            if len(prompt) > 10:
                raise ValueError("too long")
            return '<think>{"no": 1}</think> here: ```json\n{"a": [1, 2]}\n```'

    assert model.read_json(model.guarded(Broken(), "x" * 30)) == {"a": [1, 2]} and Broken.calls == 3
    assert model.read_json("nothing") is None
    assert model.classify("t", "XY1234_sheet.pdf", model.Stub())[2] == "XY1234"
    assert model.derive_title("my_file-v1.pdf", "s", None, model.Stub()) == "my file v1"
    assert model.derive_title("f.pdf", "s", " Given ", model.Stub()) == "Given"
    assert model.query_type("q", ["a", "A"], model.Stub()) == "traditional" and model.query_type("q", ["a", "b"], model.Stub()) == "deep_research"


def test_validation(spark):
    rows = planner.validated(spark.createDataFrame([(1, "x" * 2001), (2, " "), (3, "ok")], "query_id int, query string")).collect()
    assert [r["error"] for r in sorted(rows)] == ["too long", "empty", None]


def test_engine(spark):
    docs = spark.createDataFrame([(1, "A", "The voltage of the AB123 board is 5 V at most."), (2, "B", "Nothing of interest."), (3, "C", "The voltage of the AB123 board is 5 V at most."), (4, "D", None)], "doc_id long, title string, text string")
    asked = spark.createDataFrame([(1, "voltage AB123")], "query_id int, query string")
    engine = Engine(VOCABULARY).ingest(docs)
    assert [r["chunk_id"] for r in engine.search(asked).collect()] == ["1-0"]
    answer = engine.ask(asked).first()
    assert "5 V" in answer["answer"] and answer["pages"] == 1


# sources


def _zip(**members) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), data)
    return out.getvalue()


def test_file_formats(spark, tmp_path):
    w = 'xmlns:w="w"'
    docx = _zip(word__document_xml=f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>')
    xlsx = _zip(xl__workbook_xml='<workbook><sheets><sheet name="S1"/></sheets></workbook>', xl__sharedStrings_xml="<sst><si><t>name</t></si></sst>", xl__worksheets__sheet1_xml='<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>')
    pptx = _zip(ppt__slides__slide1_xml="<sld><p><r><t>Slide</t></r></p></sld>")
    for name, data in {"a.md": b"# One\nx\n# Two\ny", "b.txt": b"plain", "c.html": b"<p>a</p><script>no</script><p>b &amp; c</p>", "d.docx": docx, "e.xlsx": xlsx, "f.pptx": pptx, "g.bin": b"?", "h.docx": b"broken", "i.pdf": b"%PDF"}.items():
        (tmp_path / name).write_bytes(data)
    rows = {(r["path"].rsplit("/", 1)[-1], r["page_num"]): r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.md", 2]["section_title"] == "Two" and rows["b.txt", 1]["raw_text"] == "plain" and rows["c.html", 1]["raw_text"] == "a\nb & c"
    assert rows["d.docx", 1]["raw_text"].startswith("# Head") and rows["e.xlsx", 1]["raw_text"].startswith("name | 7") and rows["f.pptx", 1]["raw_text"] == "Slide"
    assert "unsupported" in rows["g.bin", 0]["error"] and "damaged" in rows["h.docx", 0]["error"] and rows["i.pdf", 0]["error"]
    again = files.read_files(spark, str(tmp_path), spark.createDataFrame([(rows["b.txt", 1]["file_hash"],)], "file_hash string"))
    assert again.where(F.col("path").endswith("b.txt")).count() == 0


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "t1", 1, None), ("a", "t1", 2, "x"), ("b", "t2", 1, "y")], "doc_id string, tenant_id string, page_num int, raw_text string")
    store.append("pages", rows)
    assert sorted(r["raw_text"] for r in store.read("pages").collect()) == ["", "x", "y"]
    store.upsert("pages", spark.createDataFrame([("a", "t1", 2, "new")], "doc_id string, tenant_id string, page_num int, raw_text string"))
    assert sorted(r["raw_text"] for r in store.read("pages", "t1").collect()) == ["", "new"]
    store.delete_documents(spark.createDataFrame([("a",)], "doc_id string"))
    assert [r["doc_id"] for r in store.read("pages").collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(tenant_id" in store.read("pages", "t2")._jdf.queryExecution().toString()


# states and streams


def test_admission_window(spark):
    times = [("a", k, k) for k in range(6)] + [("b", 0, 10), ("a", 61, 11)]
    df = spark.createDataFrame(times, "key string, s int, id long").select("key", F.timestamp_seconds("s").alias("ts"), "id")
    got = {r["id"]: r["admitted"] for r in admission.batch(df, 5).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False, 10: True, 11: True}


def test_stream_agrees_with_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = admission.stream(stream, 2, 3600.0).writeStream.format("memory").queryName("admitted").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    expected = {(r["id"], r["admitted"]) for r in admission.batch(events, 2, 3600.0).collect()}
    assert {(r["id"], r["admitted"]) for r in spark.table("admitted").collect()} == expected


def test_stream_windows(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = states.tumbling(stream, "ts", "1 hour", ["event_type"], "10 minutes").writeStream.format("memory").queryName("hours").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    batch = states.tumbling(events, "ts", "1 hour", ["event_type"])
    assert {tuple(r)[:3] for r in spark.table("hours").collect()} == {tuple(r)[:3] for r in batch.collect()}


# layout


def test_content_stream():
    blocks = layout.text_blocks(b"q BT /F1 12 Tf 0.7071 0.7071 -0.7071 0.7071 100 200 Tm 0.5 g (DRAFT) Tj (DRAFT) Tj ET Q BT [(a) -2 (b)] TJ ET")
    assert round(blocks[0]["angle"]) == 45 and blocks[0]["texts"] == ["DRAFT", "DRAFT"] and blocks[0]["gray"] == 0.5 and blocks[1]["texts"] == ["ab"]


def test_grid():
    import pandas as pd

    chars = pd.DataFrame([(1, 1, "a"), (2, 1, "b"), (11, 1, "c"), (1, 11, "d"), (99, 1, "z")], columns=["x", "y", "c"])
    assert layout.grid(chars, [0, 10, 10.5, 20], [0, 10, 20]) == [["ab", "c"], ["d", ""]]
    assert layout.blank_share([1000, 2]) < 0.005 and layout.blank_share([]) == 0.0


# the registered queries

ORACLE = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def cell(v):
    if isinstance(v, float):
        return round(v, 5) if v == v else None
    return float(v) if hasattr(v, "quantize") else v


@pytest.mark.parametrize("name", ORACLE)
def test_agrees_with_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    found = sorted((tuple(map(cell, r)) for r in got.select(columns).collect()), key=str)
    cursor = duck.execute(catalog.oracle_sql()[name])
    order = [d[0] for d in cursor.description]
    expected = sorted((tuple(cell(r[order.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert all(x == pytest.approx(y, abs=2e-5) if isinstance(x, (int, float)) and isinstance(y, (int, float)) else x == y for x, y in zip(a, b, strict=True)), (a, b)


def test_queries_without_sql_have_tests_of_their_own():
    from pathlib import Path

    told = (Path(__file__).parent / "test_queries.py").read_text()
    assert all(name in told for name in set(catalog.queries()) - set(ORACLE))


# answers and properties


def test_fences_and_samples():
    drawn = "intro\n+---+\n| a |\n+---+\nend"
    assert retrieval.fence_diagrams(drawn) == "intro\n```\n+---+\n| a |\n+---+\n```\nend"
    table_ = "| a | b |\n|---|---|\n| 1 | 2 |"
    assert retrieval.fence_diagrams(table_) == table_
    context = "x" * 3000 + " the voltage is 5 V " + "y" * 3000
    assert "voltage" in retrieval.sample_context(context, "voltage?", 1000) and len(retrieval.sample_context(context, "zzz", 1000)) <= 1000


def test_structural_properties():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.text(alphabet="ab1#| .", max_size=60), max_size=30), st.integers(40, 200))
    def holds(lines, most):
        whole = "\n".join(lines)
        chunks = chunking.structural(whole, most)
        assert chunks
        if len(chunks) > 1:
            assert all(len(c) <= 1.5 * most + 130 for c in chunks)
        for letter in "b":
            assert sum(c.count(letter) for c in chunks) >= whole.count(letter)

    holds()


def test_optional_subpackage_is_optional():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
