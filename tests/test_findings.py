"""What reviews have found: small cases that failed before."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from foliospark import batches
from foliospark.engine import Engine
from foliospark.functions import text
from foliospark.operators import chunking, facts
from foliospark.operators import relational as joins
from foliospark.operators import retrieval
from foliospark.plans import model
from foliospark.queries import agentic, relational


class Dated(model.Stub):
    def __init__(self, year):
        super().__init__()
        self.year = year

    def generate(self, prompt: str) -> str:
        return f'{{"subject": "Nobody", "year": "{self.year}"}}'


def test_a_year_has_four_digits():
    assert model.derive_title("AB77777_data-sheet.pdf", "new plate", None, Dated("77777")) == "AB77777 data sheet"
    assert model.derive_title("report 2023.pdf", "", None, Dated("2023")) == "2023"


def test_lines_are_trimmed_of_spaces_not_of_their_index(spark, tmp_path):
    rows = spark.createDataFrame([(1, "  Order 4711 of 2020  \n1 of 1"), (2, "x" * 90 + "\n 1. Aims 1 ")], "id int, t string").orderBy("id")
    assert [r[0] for r in rows.select(text.page_title(F.col("t"))).collect()] == ["Order 4711 of 2020", "1. Aims 1"]
    assert [r[0] for r in rows.select(text.drop_noise_lines(F.col("t"))).collect()] == ["Order 4711 of 2020\n1 of 1", "x" * 90 + "\n1. Aims 1"]
    often = "a line that is repeated 0"
    spark.createDataFrame([(1, "\n".join([often, f" {often}", f"{often} ", "end"]))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert relational.repeated_lines_removed(spark, str(tmp_path)).first()["dropped"] == 3


def test_an_upsert_wins_over_the_row_of_its_id(spark, tmp_path):
    rows = [(0, 1, "view", 3.0, 9), (100000, 1, "view", 5.0, 9), (3, 2, "view", 3.0, 9), (100003, 2, "view", 7.0, 9), (100006, 3, "view", 8.0, 9), (6, 3, "view", 4.5, 9)]
    for k, order in enumerate((rows, rows[::-1])):
        spark.createDataFrame(order, "event_id long, user_id long, event_type string, value double, x int").coalesce(1).write.parquet(f"{tmp_path}/{k}/events.parquet")
        got = relational.upsert_latest(spark, f"{tmp_path}/{k}").orderBy("user_id").collect()
        assert [(r["event_id"], r["value"]) for r in got] == [(100000, 6.0), (100003, 6.0), (100006, 9.0)]


def test_section_ends_read_sorted_outlines_through(spark):
    rows = [(d, o, lv, 10 * o) for d in range(40) for o, lv in enumerate([1, 2, 3, 3, 2, 1, 2][: d % 8])]
    rows += [(50, 1, 2, 10), (50, 1, 2, 11), (50, 2, None, 20), (50, 3, 2, None), (50, 4, 1, 40), (None, 1, 1, 5), (None, 2, 1, 6)]
    df = spark.createDataFrame(rows, "doc int, ord long, level int, page long").repartition(3)
    ended = joins.section_ends(df, ["doc"], "ord", "level", "page", F.lit(999).cast("long"))
    plan = ended._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    later = lambda d, o, lv: [p for e, n, m, p in rows if e == d and n > o and m is not None and p is not None and lv is not None and m <= lv]
    assert sorted(map(str, ended.collect())) == sorted(map(str, spark.createDataFrame([(*r, min(later(*r[:3]), default=999)) for r in rows], "doc int, ord long, level int, page long, end_page long").collect()))


def test_model_structure_has_no_group_for_each_document(spark, tmp_path):
    spark.createDataFrame([(d, t, "user", f"Part A {t}") for d in range(3) for t in range(1, 6)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    made = agentic.model_structure(spark, str(tmp_path))
    plan = made._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "BroadcastHashJoin" not in plan
    assert [tuple(r)[1:] for r in made.where("doc_id = 1").orderBy("page_num").collect()] == [(1, "Part A", 1, 1), (2, "deep", 2, 2), (3, "deep", 2, 2), (4, "Part B", 1, 1), (5, "Part B", 1, 1)]


def test_vectors_of_another_dimension_first_and_tiles(spark):
    rows = [(0, [1.0]), *((i, [float(i), 1.0, 2.0]) for i in range(1, 30))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, [5.0, 1.0, 2.0]), (2, [-1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    found = retrieval.vector_search(vectors, asked, 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in found] == [(1, 5), (1, 6), (2, 1), (2, 2)]
    for n in (1, 4096, 10000, 10 * retrieval.TILE):
        tiles = list(retrieval._tiles(8192, n))
        assert [i for t in tiles for i in range(8192)[t]] == list(range(8192))
        assert all((t.stop - t.start) * n <= max(retrieval.TILE, n) for t in tiles)


def test_groups_of_vectors_after_one_of_another_dimension(spark):
    rows = [("a", [1.0]), ("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("a", [1.0, 1.0]), (None, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "label string, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0])], "query_id long, embedding array<double>")
    found = retrieval.vector_groups(vectors, asked, "label", -1.0).orderBy("query_id", "label").collect()
    assert [tuple(r) for r in found] == [(1, "a", 1.0), (1, "b", 0.0), (2, "a", 0.707107), (2, "b", 1.0)]


def test_texts_reach_python_in_slices(spark):
    many, limit = ["x" * 300_000] * 9 + [None, "y" * (3 * batches.SLICE_BYTES), "", "z"], batches.SLICE_BYTES
    got = list(batches.slices(iter([pa.RecordBatch.from_arrays([pa.array(range(len(many))), pa.array(many)], names=["id", "t"])]), 1))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(len(many)))
    assert all(sum(len(t or "") for t in b.column(1).to_pylist()[1:]) <= limit for b in got)
    texts = [(1, "# A\n" + "a" * 300), (2, None), (None, "short"), (4, ""), (5, "w" * 250)]
    chunks = chunking.structural_chunks(spark.createDataFrame(texts, "id int, t string").coalesce(1), "id", "t", 100)
    assert "MapInArrow" in chunks._jdf.queryExecution().toString()
    expected = [(k, i, c) for k, t in texts for i, c in enumerate(chunking.structural(t or "", 100))]
    assert [tuple(r) for r in chunks.collect()] == expected
    assert int(spark.conf.get(batches.ROWS)) <= batches.BATCH_ROWS


def test_facts_are_read_in_slices(spark):
    pages = spark.createDataFrame([(1, 2, "E", "ball size: 0.35mm"), (None, 3, None, "ball size: 0.40mm"), (3, 1, "E", None), (4, 1, "E", "nothing")], "doc_id long, page_num int, entity string, raw_text string")
    found = facts.extract(pages.coalesce(1), facts.Vocabulary(headers=("Package",)))
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    assert [tuple(r) for r in found.collect()] == [("1", "E", "ball size", "0.35mm", 2, "ball size: 0.35mm"), (None, None, "ball size", "0.40mm", 3, "ball size: 0.40mm")]


def test_ask_cuts_only_documents_that_were_hit(spark):
    docs = spark.createDataFrame([(f"d-{i}", f"t{i}", f"# Head {i}\n" + f"word{i} license text. " * 200) for i in range(6)] + [("copy", "t0", "# Head 0\n" + "word0 license text. " * 200), ("none", "x", None)], "doc_id string, title string, text string")
    engine = Engine().ingest(docs)
    hits = engine.search(spark.createDataFrame([(1, "word3 license"), (2, "zzzz"), (3, "license")], "query_id int, query string"))
    wide = hits.join(engine.chunks.select("chunk_id", "doc_id", F.col("idx").alias("page_num"), "chunk"), "chunk_id").join(engine.documents.select("doc_id", "title"), "doc_id")
    shown = engine.shown(hits)
    assert shown.count() == hits.count() > 0
    assert sorted(map(tuple, shown.collect())) == sorted(map(tuple, wide.select(*shown.columns).collect()))
    passes = engine.ask(spark.createDataFrame([(1, "word3 license")], "query_id int, query string"))._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert passes == 4  # three that score the chunks, one over the documents that were hit
