from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def invented(rng: random.Random, n: int) -> str:
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "es", "ti"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Documents with nulls, empty and long texts, copies, near copies, shared passages and benchmark passages."""
    rng = random.Random(5)
    passage, item = invented(rng, 120), invented(rng, 14)
    texts: list[str | None] = [None, "", "   \n\t", "One", "two words", "ÉÉ çà été " * 40]
    texts += [invented(rng, rng.randint(5, 300)) for _ in range(40)]
    texts += [texts[10]] * 3 + [texts[11] + " tail"]
    words = texts[12].split()
    for k in range(4):
        changed = list(words)
        changed[(k * 7 + 3) % len(words)] = "changed"
        texts.append(" ".join(changed))
    texts += [invented(rng, 30) + " " + passage + " " + invented(rng, 20) for _ in range(3)]
    texts += ["abc " * 300, invented(rng, 20) + ". " + item + "; " + invented(rng, 9), item.upper(), invented(rng, 6000)]
    rows = [(k, t, "en", None if k % 11 == 5 else f"src{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    return rows + [rows[20], rows[20], (None, "null id text", "en", "src1", 12)]


@pytest.fixture(scope="session")
def items() -> list[tuple]:
    rng = random.Random(5)
    invented(rng, 120)
    item = invented(rng, 14)
    return [(1, item), (2, "two words"), (3, None), (4, ""), (5, "never there at all and so on and on and on and on"), (10, item), (1, item)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)
