"""The pipeline on a small corpus: each stage against a brute-force version on its own input."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from foliospark.llm import quality
from foliospark.llm.common import materialize, table

from .conftest import DOCS, invented
from .test_operators import brute_cut, brute_kept, brute_mix, brute_phrases


@pytest.fixture(scope="module")
def folder(spark, corpus, items, tmp_path_factory):
    rng = random.Random(9)
    path = str(tmp_path_factory.mktemp("sf"))
    junk = [(1000 + k, " ".join(w.upper() + "!!" for w in invented(rng, 60).split()), "en", "src1", 0) for k in range(40)]
    rows = [r for r in corpus if r[0] is not None] + junk
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(r[0], int(r[0] < 1000), 0) for r in rows if r[1]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = table(spark, folder, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = [tuple(r) for r in docs.select(columns).collect()]
        docs = materialize(stage(spark, docs, folder), "t")
        assert docs.columns == columns or name == "mixing"
    final = docs.collect()
    first, dedup, cut, clean, mixed = (seen[n] for n, _ in corpus_pipeline.STAGES)

    voters = quality.train(table(spark, folder, "documents"), table(spark, folder, "labels"))
    good = [r for r in quality.score(table(spark, folder, "documents"), voters).collect() if r["score"] >= 0.7]
    assert sorted(r["doc_id"] for r in good) == sorted(r[0] for r in dedup)
    assert not any(r[0] >= 1000 for r in dedup)

    assert sorted(r[0] for r in cut) == [i for _, i in brute_kept(dedup)]

    expected = {r[0]: x[0] - x[1] for r, x in zip(cut, brute_cut([r[1] for r in cut], corpus_pipeline.REPEAT_BYTES), strict=True)}
    assert {r[0]: len((r[1] or "").encode()) for r in clean} == expected

    items = [tuple(r) for r in table(spark, folder, "benchmark").collect()]
    hits = {r[0]: x[1] for r, x in zip(clean, brute_phrases([r[1] for r in clean], items), strict=True)}
    assert sorted(r[0] for r in mixed) == sorted(i for i, n in hits.items() if not n)

    by, total, target = brute_mix(mixed)
    for s in by:
        own = [r for r in final if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - target[s]) <= max(x[2] for x in by[s])
    assert {r["doc_id"] for r in final} <= {r[0] for r in mixed}


def test_run_agrees_with_stages(spark, folder):
    once, again = corpus_pipeline.run(spark, folder), corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))
