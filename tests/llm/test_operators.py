"""Each operator against a brute-force version, over nulls, empty and long texts, ties, repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import mixing_model as M
from foliospark.llm import decontaminate, extract, lm_score, mixing, quality, repeats, simhash, token_counts, topk, url_filter
from foliospark.llm.common import Fingerprints, batches_of, flat, materialize, word_spans


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def fold(text):
    return (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def black(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", fold(text))


# common


def test_word_spans_and_fingerprints():
    texts = ["Hello  world", None, "", "a", "héllo HELLO hello", "x " * 50]
    data, offs = flat(pa.array(texts))
    start, end = word_spans(data, offs, "black")
    whole = data.tobytes()
    found = [whole[a:b] for a, b in zip(start, end, strict=True)]
    assert found == [w for t in texts for w in (t or "").encode().split()]
    prints = dict.fromkeys(zip([w.lower() for w in found], Fingerprints(data, fold=True).of(start, end).tolist(), strict=True))
    assert len({w for w, _ in prints}) == len({h for _, h in prints}) == len(prints)


def test_fingerprints_of_alternating_parity():
    parity = np.array([bin(k).count("1") & 1 for k in range(4096)])
    for n in (512, 1024, 4096):
        one, other = (np.where(parity[:n] == side, ord("f"), ord("z")).astype(np.uint8) for side in (0, 1))
        a, b = (Fingerprints(x).of(np.array([0]), np.array([n]))[0] for x in (one, other))
        assert a != b
    data = np.frombuffer(b"xx" + bytes(range(200)) + b"yyy" + bytes(range(200)), np.uint8)
    prints = Fingerprints(data, seed=2)
    assert prints.of(np.array([2, 2]), np.array([202, 201])).tolist() == prints.of(np.array([205, 205]), np.array([405, 404])).tolist()


# 1


def test_tokens_of_long_white_space():
    encoding = token_counts._encoder(open(token_counts.VOCABULARY, "rb").read())
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["   ", " ", "\n", "\t", "\u3000", "\x85", "a", "bc", "'s", "1", "!!", "\x1c", "é"]) for _ in range(rng.randint(0, 30)))
        assert token_counts.tokens_of(encoding, text, 2) == encoding.encode_ordinary(text)
    assert len(token_counts.tokens_of(encoding, " " * 1_000_000)) == 1_000_000


def test_token_counts(spark, docs, corpus):
    encode = token_counts._encoder(open(token_counts.VOCABULARY, "rb").read()).encode_ordinary
    expected = sorted([(i, len(encode(t or ""))) for i, t, *_ in corpus], key=str)
    assert rows(token_counts.token_counts(docs)) == expected
    assert rows(token_counts.token_counts(docs.limit(0))) == []


@pytest.mark.parametrize("block", [1, 7, 64])
def test_separator_scan_across_blocks(spark, docs, corpus, block):
    encode = token_counts._encoder(open(token_counts.VOCABULARY, "rb").read()).encode_ordinary
    some = docs.where("length(text) < 200 or text is null")
    files = materialize(token_counts.write_tokens(some, block_tokens=block), "t")
    counted = token_counts.scan(files.where("not manifest")).collect()
    assert sorted(r["n_tokens"] for r in counted) == sorted(len(encode(t or "")) for _, t, *_ in corpus if t is None or len(t) < 200)


def test_scan_unterminated_tail_and_raw_files(spark, tmp_path):
    ids = np.array([5, 6, token_counts.END, token_counts.END, 9, 9, 9], np.uint16)
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    blocks = token_counts.read_token_files(spark, str(tmp_path), block_tokens=2)
    assert sorted((r["ordinal"], r["n_tokens"]) for r in token_counts.scan(blocks).collect()) == [(0, 2), (1, 0), (2, 3)]


# 2


def brute_cut(texts, window=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + window] for b in data for s in range(len(b) - window + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if seen[b[s : s + window]] > 1:
                gone[s : s + window] = b"\x01" * window
        spans = sum(gone[k] and (not k or not gone[k - 1]) for k in range(len(b)))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return out


def digest(df):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return df.select("doc_id", "n_bytes", removed, F.size("spans").cast("long"), "kept_sha256")


@pytest.mark.parametrize("held", [3, 1 << 18])
def test_repeats(docs, corpus, monkeypatch, held):
    monkeypatch.setattr(repeats, "HELD_ROWS", held)
    expected = sorted([(i, *x) for (i, *_), x in zip(corpus, brute_cut([t for _, t, *_ in corpus]), strict=True)], key=str)
    found = repeats.cut_repeats(docs.withColumns({"spans": F.lit(1), "uid": F.lit(2), "row": F.lit(3)}))
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "uid", "row", "text", "n_bytes", "spans", "kept_sha256"]
    assert rows(digest(found)) == expected
    for text, r in [(t, r) for i, t, *_ in corpus for r in found.where("size(spans) > 0").collect() if r["doc_id"] == i]:
        left, at = b"", 0
        for s in r["spans"]:
            left, at = left + text.encode()[at : s["start"]], s["end"]
        assert r["text"] == (left + text.encode()[at:]).decode("utf-8", "ignore")


@pytest.mark.parametrize("window", [209, 256, 400, 700])
def test_repeats_partial_overlaps(spark, window):
    rng = np.random.default_rng(3)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    base = word(1500)
    texts = [base, word(50) + base[200:900] + word(80), word(90) + base[500:1499], base[:399], base[:400] + word(5), base[100:501] + base[1000:1400], "a" * 900, "ab" * 500, word(399), word(401)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(digest(repeats.cut_repeats(df, window))) == sorted([(i, *x) for i, x in enumerate(brute_cut(texts, window))], key=str)
    assert rows(digest(repeats.cut_repeats(df.limit(0), window))) == []


# 3


def brute_phrases(texts, items, n=10):
    word = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    windows = {}
    for i, t in items:
        w = word(t)
        m = min(n, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for t in texts:
        w, hit, found = word(t), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                got = windows.get(tuple(w[k : k + m]))
                if got:
                    hit |= set(range(k, k + m))
                    found |= got
        out.append((len(w), len(hit), tuple(sorted(found))))
    return out


def test_contamination(spark, docs, corpus, items):
    expected = sorted([(i, *x) for (i, *_), x in zip(corpus, brute_phrases([t for _, t, *_ in corpus], items), strict=True)], key=str)
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["item_ids"]))) for r in found.collect()], key=str)
    assert got == expected
    assert any(x[2] for x in got)
    spans = {r["doc_id"]: sum(s["end"] - s["start"] for s in r["spans"]) for r in found.collect()}
    assert all(spans[i] == n for i, _, n, _ in got)


def test_contamination_in_blocks(spark, docs, corpus, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1)
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {i: t for i, t, *_ in corpus if i is not None}
    expected = sorted([(i, *x) for i, x in zip(texts, brute_phrases(texts.values(), items), strict=True)], key=str)
    found = decontaminate.contamination(some, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["item_ids"]))) for r in found.collect()], key=str) == expected


def test_contamination_in_blocks_of_rows_sharing_an_id(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1)
    some = [(1, "alpha beta x"), (1, "gamma delta x"), (1, "clean of all"), (1, "clean of all"), (None, "x alpha beta"), (None, "none of these")]
    items = [(7, "alpha beta"), (8, "gamma delta"), (9, "beta x")]
    expected = sorted([(i, *x) for (i, _), x in zip(some, brute_phrases([t for _, t in some], items), strict=True)], key=str)
    found = decontaminate.contamination(spark.createDataFrame(some, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["item_ids"]))) for r in found.collect()], key=str) == expected


@pytest.mark.parametrize("size", [1, 1 << 20])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_contamination_by_items_without_an_id(spark, monkeypatch, size, kind):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
    seven = 7 if kind == "long" else "q-7"
    docs = spark.createDataFrame([(1, "x alpha beta"), (2, "alpha beta gamma delta eps"), (3, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "alpha beta"), (None, "gamma delta"), (seven, "delta eps")], f"item_id {kind}, text string")
    found = decontaminate.contamination(docs, items).collect()
    assert sorted((r["doc_id"], r["n_hit"], tuple(sorted(r["item_ids"], key=str))) for r in found) == [(1, 2, (None,)), (2, 5, tuple(sorted((None, seven), key=str))), (3, 0, ())]
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).collect()] == [3]


def test_contamination_of_nothing(spark, docs, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {(r["n_hit"], len(r["item_ids"])) for r in decontaminate.contamination(docs, none).collect()} == {(0, 0)}
    assert rows(decontaminate.contamination(docs.limit(0), spark.createDataFrame(items, "item_id long, text string"))) == []


def test_proximity(spark):
    df = spark.createDataFrame([(1, "alpha x beta y y y alpha"), (2, "beta alpha"), (3, None)], "doc_id long, text string")
    index = decontaminate.build_index(df)
    assert rows(decontaminate.find_near(index, [("Alpha", "beta")], 3)) == [(1, 0, 0, 2), (2, 0, 1, 0)]


# 4


def brute_fingerprint(text, width=3):
    w = black(text)
    shingles = [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def groups(ids, linked):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(ids))]


def test_simhash(docs, corpus, monkeypatch):
    fps = [brute_fingerprint(t) for _, t, *_ in corpus]
    found = groups(corpus, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    least = {g: min((i for (i, *_), h in zip(corpus, found, strict=True) if h == g and i is not None), default=None) for g in set(found)}
    expected = sorted([(i, f"{f:016x}", least[g]) for (i, *_), f, g in zip(corpus, fps, found, strict=True)], key=str)
    got = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert rows(got) == expected
    assert rows(simhash.near_duplicates(docs.limit(0))) == []


@pytest.mark.parametrize("dense", [0, 5, 1000])
def test_links_of_a_dense_cluster(spark, monkeypatch, dense):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 62))
    values = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 40, (150, 3))} | {int(x) for x in rng.integers(0, 1 << 62, 50)})
    cell = np.zeros(len(values), np.int64)
    monkeypatch.setattr(simhash, "DENSE", dense)
    fp = np.array(values, np.uint64)
    assert simhash._search(cell, fp, 2).tolist() == groups(values, lambda a, b: (values[a] ^ values[b]).bit_count() <= 2)
    with batches_of(spark, 7):
        edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    found = groups(values, lambda a, b: (values[a] ^ values[b]).bit_count() <= 2)
    assert len({roots.get(v, v) for v in values}) == len(set(found))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert len({roots[k] for k in range(201)}) == 1 and roots[500] == roots[501] != roots[0]


def test_long_text_by_pieces(monkeypatch):
    text = " ".join(f"w{k * 7919 % 1000}" for k in range(3000))
    whole = simhash.bit_counts(text.encode(), 3)
    monkeypatch.setattr(simhash, "PIECE", 37)
    piecewise = simhash.bit_counts(text.encode(), 3)
    assert whole[1] == piecewise[1] and (whole[0] == piecewise[0]).all()


def shingle_set(text, width=5):
    w = black(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute_kept(corpus):
    sets = [shingle_set(t) for _, t, *_ in corpus]
    same = lambda a, b: (corpus[a][1] or "") == (corpus[b][1] or "") or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and len(sets[a] & sets[b]) > 0)
    found = groups(corpus, same)
    return sorted({min(((i is None, i or 0) for (i, *_), h in zip(corpus, found, strict=True) if h == g)) for g in set(found)})


@pytest.mark.parametrize("held", [2, 1 << 19])
def test_representatives(docs, corpus, monkeypatch, held):
    monkeypatch.setattr(simhash, "HELD_TEXTS", held)
    named = docs.withColumns({"uid": F.lit(1), "_key": F.lit(2), "key": F.col("doc_id")})
    kept = simhash.representatives(named)
    assert kept.columns == named.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == brute_kept(corpus)
    assert rows(simhash.representatives(docs.limit(0))) == []


def test_representatives_in_a_template_family(spark, monkeypatch):
    """Thousands of texts share most of their words and aren't alike; planted pairs among them are."""
    monkeypatch.setattr(simhash, "LIST_BLOCK", 256, raising=False)
    rng, n = random.Random(17), 6000
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    template = [word() for _ in range(174)]
    texts = [template + [word() for _ in range(28)] for _ in range(n)]
    chosen = rng.sample(range(n), 96)
    pairs = list(zip(chosen[::2], chosen[1::2], strict=True))
    for a, b in pairs:
        texts[b] = texts[a][:-20] + [word() for _ in range(20)]
    sets = [shingle_set(" ".join(t)) for t in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert all(alike(a, b) for a, b in pairs) and not any(alike(k, k + 1) for k in range(n - 1) if (k, k + 1) not in pairs and (k + 1, k) not in pairs)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.representatives(docs).collect()) == sorted(set(range(n)) - {max(x) for x in pairs})

def test_similar_texts_that_share_no_band(spark):
    """Their SimHashes are equal and their similarity is 0.8, but no band of least hashes proposes the pair."""
    words = "ecidpop mgdpamn aoihdka aaamgna hophlhh ojandfj dkngjjp mbphmnf llcodfm lpapbjm ffhaghm lloiame"
    texts = [f"{words} gfmogao", f"{words} dhahaic", f"{words[:40]} other words that are not in the two texts above"]
    a, b = (shingle_set(t) for t in texts[:2])
    assert len(a & b) == 0.8 * len(a | b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["uid"]: r for r in simhash.sketches(docs.select(F.col("doc_id").alias("uid"), "text"), 5).collect()}
    assert found[0]["fp"] == found[1]["fp"] and not set(found[0]["bands"]) & set(found[1]["bands"])
    assert sorted(r["doc_id"] for r in simhash.representatives(docs).collect()) == [0, 2]


@pytest.mark.parametrize("dense,whole,held", [(1000, 1000, 1 << 19), (192, 16, 1 << 19), (20, 5, 1 << 19), (20, 5, 30)])
def test_close_fingerprints(spark, monkeypatch, dense, whole, held):
    """All pairs within two bits are proposed, or both texts are left to the prefix filter; bands are for the others."""
    for name, value in (("DENSE", dense), ("WHOLE", whole), ("HELD_TEXTS", held)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 1 << 62))
    values = [base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 30, (60, 2))] + [int(x) for x in rng.integers(0, 1 << 62, 40)]
    values += [values[70] ^ 5, values[70], values[71] ^ 7 << 20]
    sketched = spark.createDataFrame([(k, v, [1]) for k, v in enumerate(values)] + [(500, values[72], [])], "uid long, fp long, bands array<long>")
    near = {(i, j) for j in range(len(values)) for i in range(j) if (values[i] ^ values[j]).bit_count() <= 2}
    with batches_of(spark, 7):
        found = {(r["a"], r["b"]) for r in simhash.close(sketched).collect()}
        far = {(r["a"], r["b"]) for r in simhash.candidates(sketched).collect()}
    left = {a for a, b in found if a == b}
    assert {(i, j) for i, j in near if not {i, j} <= left} <= found
    assert all(a <= b for a, b in found) and 500 not in {x for p in found for x in p}
    assert not {p for p in far if p[0] < p[1]} & near
    if whole == 1000:
        assert found == near and far == {(i, j) for j in range(len(values)) for i in range(j)} - near


# 5


def brute_rule(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = m[1].translate(str.maketrans(url_filter.UPPER, url_filter.LOWER)) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_url_filter(spark):
    urls = ["http://www.Example.com/en/x?q", "https://example.com/en", "http://a.example.com/en/1#t", "http://example.net/fr/2", "ftp://net/es/", "no scheme", None, "", "http://", "http://com/", "http://xcom/", "http://.com/a", "HTTP://A.COM", "a://b://c.com/", "http://com./", "http://example.com/en/ü"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string")
    expected = sorted([(i, *brute_rule(u, url_filter.RULES)) for i, u in [*enumerate(urls), (0, urls[0])]], key=str)
    assert rows(url_filter.judge(pages, url_filter.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")) == expected
    assert {r["verdict"] for r in url_filter.judge(pages, url_filter.rule_table(spark, ())).collect()} == {"allow"}
    assert rows(url_filter.judge(pages.limit(0), url_filter.rule_table(spark))) == []


# 6


def test_lm_score(docs, corpus):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {k: [*black(t), b"\x00end"] for k, (_, t, *_) in enumerate(corpus)}
    counts = Counter(w for k, (i, *_) in enumerate(corpus) if not held(i) for w in tokens[k])
    n, v = sum(counts.values()), len(counts)
    expected = sorted([(i, held(i), len(tokens[k]), sum(counts[w] > 0 for w in tokens[k]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[k]), 6)) for k, (i, *_) in enumerate(corpus)], key=str)
    for frequent in (1 << 18, 20):
        found = lm_score.scores(docs, frequent=frequent).collect()
        got = sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found], key=str)
        assert [x[:5] for x in got] == [x[:5] for x in expected]
        assert np.allclose([x[5] for x in got], [x[5] for x in expected], atol=1e-5)
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)
    by_text = {}
    for r, (_, t, *_) in zip(sorted(found, key=lambda r: str(r["doc_id"])), sorted(corpus, key=lambda c: str(c[0])), strict=True):
        assert by_text.setdefault(t or "", r["score"]) == pytest.approx(r["score"])
    assert lm_score.scores(docs.limit(0)).collect() == []
    assert [M.table_bits(n, 22) for n in (0, 1 << 17, 1 << 19, 1 << 30)] == [18, 20, 22, 22]


def small_model(texts):
    """A model of texts, its counters by plain counting."""
    key, n = np.unique(M.grams(*flat(pa.array(texts)))[0], return_counts=True)
    counts = np.zeros((2, 1 << 18))
    for gram, times in zip(key.tolist(), n.tolist(), strict=True):
        for order in M.ORDERS:
            h = M.contexts(np.array([gram & (1 << 8 * (order + 1)) - 1], np.uint64), order)
            for j in range(8):
                at = M.slots(h, np.array([(1 << j) | ((gram & 255) >> (8 - j))]), 18)[0]
                counts[(gram >> (7 - j)) & 1, at] += times
    return M.Model(M.packed_counts(*counts)), key, n


TEXTS = ["the then there they " * 30, "banana bandana", "", None, "One two three. " * 4 + "the end", "ÉÉ çà " * 20]


def test_model_is_a_distribution():
    model, key, n = small_model(TEXTS)
    model.learn(key, n)
    model.refine(model.outcomes(key, n))
    costs, _ = model.costs(np.uint64(0x746865 << 8) | np.arange(256, dtype=np.uint64))
    assert np.exp(-costs.astype(float)).sum() == pytest.approx(1.0, abs=1e-5)
    held = M.Cache(model, bits=3)  # places are fought over
    for some in (key[:40], key[20:], key):
        assert all(np.array_equal(a, b) for a, b in zip(held.costs(some), model.costs(some), strict=True))


def test_counters_of_the_model(spark):
    model, key, n = small_model(TEXTS)
    grams = spark.createDataFrame(list(zip(key.view(np.int64).tolist(), n.tolist(), strict=True)), "gram long, n long").repartition(3)
    assert np.array_equal(lm_score.counters(grams, 18), model.table)


def test_scores_along_texts_by_a_plain_loop():
    model, key, n = small_model(TEXTS)
    model.learn(key, n)
    texts = [*TEXTS, "the theme of bananas " * 25, "x", "banana " * 40 + "the end"]
    gram, cut = M.grams(*flat(pa.array(texts)))
    costs, depth = model.costs(gram)
    expected = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        weights, firmness, moves = {}, {}, {}
        cost, seen, run = 0.0, {}, 0
        for at in range(a, b):
            if (at - a) % M.SEGMENT == 0:
                for k, (push, firm) in moves.items():
                    firmness[k] = firmness.get(k, M.FIRM[k[1]]) + firm
                    weights[k] = weights.get(k, (1.0, M.BIAS[k[0] % len(M.BIAS)])[k[1]]) + push / firmness[k]
                moves = {}
            byte, context = int(gram[at]) & 255, int(gram[at]) >> 8
            past = seen.get(context)
            if past is None:
                cost += float(costs[at])
            else:
                chance = min(max(math.exp(-float(model.costs(np.array([context << 8 | past], np.uint64))[0][0])), 1e-7), 1 - 1e-7)
                gate = int(depth[at]) * len(M.BIAS) + sum(run >= r for r in M.RUNS)
                x = (math.log(chance / (1 - chance)), 1.0)
                p = 1 / (1 + math.exp(-sum(weights.get((gate, k), (1.0, M.BIAS[gate % len(M.BIAS)])[k]) * x[k] for k in (0, 1))))
                cost -= math.log(p) if past == byte else math.log(1 - p) - float(costs[at]) - math.log(1 - chance)
                for k in (0, 1):
                    push, firm = moves.get((gate, k), (0.0, 0.0))
                    moves[gate, k] = (push + ((past == byte) - p) * x[k], firm + p * (1 - p) * x[k] ** 2)
            run = run + 1 if past == byte else 0
            seen[context] = byte
        expected.append(cost / math.log(10))
    assert M.text_costs(model.costs, gram, cut) == pytest.approx(expected, rel=1e-5)
    parts = [M.text_costs(model.costs, gram[a:b], np.array([0, b - a])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    assert np.concatenate(parts) == pytest.approx(expected, rel=1e-5)  # whatever texts go beside


def test_scores_are_the_models(spark, docs, corpus):
    """`score` of the query is that of one model of all training texts; it knows text that it has learnt from, and bits_per_byte follows."""
    found = lm_score.scores(docs).collect()
    static = [r["bits_per_byte"] for r in found if r["held_out"]]
    assert all(r["bits_per_byte"] == pytest.approx(-r["score"] * math.log2(10) / max(len((t or "").encode()), 1)) for r, t in ((r, dict((i, t) for i, t, *_ in corpus)[r["doc_id"]]) for r in found))
    assert static and np.mean([r["bits_per_byte"] for r in found if r["n_tokens"] > 50]) < 4
    assert {(r["doc_id"], round(r["score"], 3)) for r in lm_score.scores(docs.coalesce(1)).collect()} == {(r["doc_id"], round(r["score"], 3)) for r in lm_score.scores(docs.coalesce(1)).collect()}


# 7

PAGE = """<html><head><title>t</title></head><body><nav>menu</nav><article class="post"><header>by</header><h1>T &amp; t</h1><p>One <b>two</b>
 three<p>Four<br>five<aside>s</aside><div class="ad-box">buy</div><section id="comments"><p>nice</p></section><form>f</form><ul><li>a<li>b</ul>
<script>var t="</p>";</script><!-- no --> tail &lt;</article><footer>f</footer></body>"""


def test_article_blocks():
    assert extract.blocks_of(PAGE) == (["T & t", "One two three", "Four five", "a", "b", "tail <"], [], True)
    assert extract.blocks_of("") == ([], [], False)
    assert extract.blocks_of("<p>a<p>b<div>c") == (["a", "b", "c"], [0, 1, 2], False)
    assert extract.blocks_of("<article>x<script>never closed") == (["x"], [], True)
    labelled = '<article><h1 class="post-header">T</h1><p class="market-share">One</p><section id="related-work">R</section><div class=comments>c</div><div class="comment-list">d</div></article><p>beside</p>'
    assert extract.blocks_of(labelled) == (["T", "One", "R"], [1, 2], True)


@pytest.mark.parametrize("broken", ['<a "', "<a x", '<a ">"', "<div>", "<!--", "<script", "</div", "<", "<p class='", '<i class="class=', "&amp", "<span class=ad><p>", "<article><header>"])
def test_broken_markup_is_read_in_linear_time(broken):
    sizes = []
    for n in (1 << 17, 1 << 20):
        began = time.process_time()
        extract.blocks_of(broken * (n // len(broken)))
        sizes.append(time.process_time() - began)
    assert sizes[1] < 6


def test_text_after_broken_markup():
    assert extract.blocks_of('<article><p>one <a title="x>two</a> three</p></article>') == (["one two three"], [], True)
    assert extract.blocks_of("<article><p>a < b and c > d &lt;i&gt;</p><!-- open") == (["a < b and c > d <i>"], [], True)
    assert extract.blocks_of("<article>x<p title='a>b'>y</p>z <b") == (["x", "y", "z <b"], [], True)


def test_extraction_with_host_repeats(spark):
    menu = "home about contact imprint terms help jobs press"
    body = [f"<div>{menu}</div><p>n{k} has words and more of them {k}</p>" for k in range(3)]
    pages = [(k, f"http://a.com/{k}", b) for k, b in enumerate(body)] + [(9, "http://b.com/", body[0]), (10, None, None), (11, "http://a.com/x", PAGE), (11, "http://a.com/x", PAGE)]
    found = {(r["page_id"], r["text"]) for r in extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {(k, f"n{k} has words and more of them {k}") for k in range(3)} <= found
    assert (9, f"{menu}\n\nn0 has words and more of them 0") in found and (10, "") in found
    assert extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string").limit(0)).collect() == []


def suffix_array_text(pages, run=extract.RUN):
    """The texts of pages (key, blocks, unsure) of one host, from a sorted array of all suffixes of their streams."""
    streams = {key: [t for k in unsure for t in blocks[k].split()] for key, blocks, unsure in pages}
    suffixes = sorted((stream[at:], key, at) for key, stream in streams.items() for at in range(len(stream)))
    covered = {key: [False] * len(stream) for key, stream in streams.items()}
    groups = {}
    for suffix, key, at in suffixes:
        if len(suffix) >= run:
            groups.setdefault(tuple(suffix[:run]), []).append((key, at))
    for members in groups.values():
        if len({key for key, _ in members}) > 1:
            for key, at in members:
                covered[key][at : at + run] = [True] * run
    out = {}
    for key, blocks, unsure in pages:
        rest, left = iter(covered[key]), []
        for k, block in enumerate(blocks):
            if k in unsure:
                block = " ".join([t for t in block.split() if not next(rest)])
            left += [block] if block else []
        out[key] = "\n\n".join(left)
    return out


def test_extraction_by_brute_force(spark):
    """Hosts with menus, labelled parts and lines that pages share, with and without an article, copies and single pages."""
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice("ab cd ef gh ij kl".split()) + str(rng.randint(0, 30)) for _ in range(n))
    shared = [words(12) for _ in range(4)]
    pages = []
    for k in range(60):
        parts = [f"<p>{rng.choice(shared) if rng.random() < 0.5 else words(rng.randint(1, 30))}</p>" for _ in range(4)]
        parts.append(f'<div class="site-header">{rng.choice(shared)}</div>')
        body = "".join(parts)
        pages.append((k, f"https://h{k % 4}.org/{k}", f"<nav>{words(9)}</nav>" + (f"<article>{body}</article>{words(3)}" if k % 3 else body)))
    pages += [pages[3], pages[4], (100, "https://alone.org/", pages[0][2]), (101, None, pages[0][2]), (102, None, None)]
    found = {(r["page_id"], r["text"]) for r in extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    hosts = {}
    for k, url, page in dict.fromkeys(pages):
        blocks, unsure, _ = extract.blocks_of(page or "")
        hosts.setdefault((url or f"none{k}").split("/")[2 if url else 0], []).append((k, blocks, unsure))
    expected = {x for own in hosts.values() for x in suffix_array_text(own).items()}
    assert found == expected
    assert any(t != "\n\n".join(extract.blocks_of(p or "")[0]) for (_, t), (_, _, p) in zip(sorted(found), sorted(dict.fromkeys(pages), key=lambda x: x[0]), strict=True))


# 8


def brute_mix(corpus):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = {}
    for i, t, _, s, *_ in corpus:
        by.setdefault(s, []).append((i, t, size(t)))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    total = {s: sum(x[2] for x in by[s]) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * total[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(2.0 * total[s] for s in over)
        free -= over
    return by, total, target


def test_mixing(docs, corpus):
    by, total, target = brute_mix(corpus)
    found = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(found) == len(corpus)
    for s in by:
        own = [r for r in found if r["source"] == s]
        assert {r["source_size"] for r in own} == {total[s]} and own[0]["target"] == pytest.approx(target[s])
        taken, largest = sum(r["taken"] for r in own), max(r["size"] for r in own)
        assert abs(taken - target[s]) <= largest
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
    assert rows(mixing.mix(docs).select("doc_id", "taken")) == rows(mixing.mix(docs.repartition(7)).select("doc_id", "taken"))
    assert mixing.mix(docs.limit(0)).collect() == []


def test_mixing_of_equal_rows_and_clashing_names(spark):
    rows_ = [(7, "a b c d", "x", 1)] * 50 + [(None, "a b c d", "x", 1)] * 50 + [(k, "e f g h", "y", 2) for k in range(100)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, source string, size int").withColumns({"_key": F.lit(1), "_h": F.lit(2), "taken": F.lit("?")}).repartition(5)
    found = mixing.mix(docs)
    assert found.columns == ["doc_id", "text", "source", "_key", "_h", "size", "source_size", "target", "taken"]
    for s, target in (("x", 800.0), ("y", 400.0)):
        own = [r for r in found.collect() if r["source"] == s]
        assert {(r["size"], r["source_size"], r["target"]) for r in own} == {(4, 400, target)} and len(own) == 100
        assert sum(r["taken"] for r in own) == target
    weighted = mixing.mix(docs, weights=(1, 3), share=1.0)
    assert rows(weighted.groupBy("source").agg(F.sum("taken"))) == [("x", 200), ("y", 600)]
    assert rows(weighted) == rows(mixing.mix(docs.repartition(2), weights=(1, 3), share=1.0))


def test_mixing_of_many_sources(spark, docs, monkeypatch):
    expected = rows(mixing.mix(docs))
    monkeypatch.setattr(mixing, "TRAVELS", 1)
    monkeypatch.setattr(mixing, "HOT", 0.27)
    assert rows(mixing.mix(docs)) == expected


# 9


def test_quality(spark):
    rng = np.random.default_rng(0)
    good = lambda: " ".join("".join(rng.choice(list("aeioulnrst"), rng.integers(2, 8))) for _ in range(60)).capitalize() + "."
    bad = lambda: " ".join("".join(rng.choice(list("AEIOULNRST"), rng.integers(2, 8))) + "!!" for _ in range(60))
    texts = [(k, good() if k % 2 else bad()) for k in range(400)] + [(900, None), (901, ""), (902, good() * 300)]
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in texts], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(400)] + [(None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    voters = quality.train(docs, labels, sample=60)
    assert len(voters.labels) <= 120
    found = {r["doc_id"]: r["score"] for r in quality.score(docs, voters).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(found[k] >= 0.7) == (k % 2 == 1) for k in held]) > 0.98
    assert all(0 <= s <= 1 for s in found.values()) and found[900] == found[901] and found[902] >= 0.7
    other = quality.score(docs.withColumn("doc_id", F.col("doc_id") + 5), voters).collect()
    assert {r["doc_id"] - 5: r["score"] for r in other} == found
    none = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs.limit(3), none).collect()} == {0.5}
    assert quality.score(docs.limit(0), voters).collect() == []


def test_votes_are_exact():
    texts = [f"word{k} and some {'more ' * (k % 5)}text!" for k in range(80)]
    voters = quality.fit(quality.features(pa.array(texts)), [k % 2 for k in range(80)], k=7)
    terms = quality.features(pa.array(texts[:10]))
    near = voters.latent(terms) @ voters.vectors.T
    for row, got in zip(near, voters.score(terms), strict=True):
        top = np.argsort(-row)[:7]
        w = np.maximum(row[top], 0).astype(float) ** voters.power + 1e-12
        assert got == pytest.approx((w * voters.labels[top]).sum() / w.sum(), abs=1e-6)


def slow_terms(text):
    """Term shares by plain loops."""
    kind, out, data = quality.classes(), np.zeros(quality.TERMS), (text or "").encode()
    n = quality.CLASSES**3
    for a, b, c in zip(data, data[1:], data[2:]):
        out[(kind[a] * quality.CLASSES + kind[b]) * quality.CLASSES + kind[c]] += 1 / max(len(data) - 2, 1)
    words = black(text)
    for w in words:
        value = Fingerprints(np.frombuffer(w, np.uint8)).of(np.array([0]), np.array([len(w)]))[0]
        out[n + int(value) % quality.WORDS] += 1 / len(words)
    if words:
        out[-quality.MARKS] = sum(a == b for a, b in zip(words, words[1:])) / len(words)
        out[-quality.MARKS + 1] = 1 - out[-quality.MARKS]
    return np.sqrt(out)


def test_quality_scores_by_brute_force(spark, docs, corpus):
    """The whole score, from plain term counts, a full singular value decomposition and a full sort of similarities."""
    ids = [i for i, *_ in corpus if i is not None]
    labels = [(i, i % 3 % 2, 0) for i in dict.fromkeys(ids)]
    found = {(r["doc_id"], r["text"]): r["score"] for r in quality.score(docs, quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
    text_of = {i: t for i, t, *_ in corpus}
    used = [(text_of[i], q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2 and text_of[i] is not None]
    terms = np.array([slow_terms(t) for t, _ in used])
    some = terms.any(axis=1)
    terms, y = terms[some], np.array([q for _, q in used], float)[some]
    weights = quality.families() * (np.log((1 + len(y)) / (1 + (terms > 0).sum(axis=0))) + 1)
    _, sizes, axes = np.linalg.svd(terms * weights, full_matrices=False)
    axes = axes[:48][sizes[:48] ** 2 > 1e-9 * sizes[0] ** 2].T
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    voters = unit((terms * weights) @ axes)
    off = 0
    for i, t, *_ in corpus:
        own = slow_terms(t)
        near = voters @ unit((own * weights) @ axes)
        top = np.argsort(-near, kind="stable")[:15]
        w = np.maximum(near[top], 0) ** 8.0 + 1e-12
        score = (w * y[top]).sum() / w.sum() if own.any() else y.mean()
        off += abs(score - found[(i, t)]) > 1e-3
    assert off <= 1  # voters as near as the fifteenth may be told apart otherwise


# 10


def brute_top(vectors, k=20, every=20):
    clean = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(clean):
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(clean) if b != a and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [40, 16384])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "LEAF", 8)
    for name, value in (("FIRST", 1), ("GROWTH", 2), ("PIECE", 3), ("ROOT_BYTES", 300)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(2)
    vectors = [(k, [float(x) for x in rng.integers(-3, 4, 6) / 8]) for k in range(150)]
    vectors += [(40, vectors[40][1]), (41, vectors[41][1]), (200, None), (220, [None] * 6), (240, [math.nan] * 6), (260, [math.inf] + [0.0] * 5), (None, [0.0] * 6), (280, []), (300, [1.0, 2.0]), (320, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, label int")
    assert rows(topk.top_k(df)) == brute_top(vectors)
    assert rows(topk.top_k(df.where("vec_id < 5"))) == brute_top([x for x in vectors if x[0] is not None and x[0] < 5])
    assert rows(topk.top_k(df.limit(0))) == []


def test_products_are_exact():
    a = np.array([[1000.0, -7.0]])
    assert topk.products(a, a).tolist() == [[1000049]]
    wide = np.array([[2.0**25, 3.0]])
    assert topk.products(wide, wide).tolist() == [[2**50 + 9]]


def test_registry_names():
    from foliospark.llm import registry

    names = list(registry.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)


def test_batches_are_bounded_in_bytes(spark, docs):
    """Whatever the length of rows, an Arrow batch holds about 4 MB; a session's own value stays."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["size", "n"])

    materialize(docs, "docs")
    long_rows = spark.range(0, 1500, 1, 1).select(F.repeat(F.lit("x"), 16000).alias("text"))
    got = long_rows.mapInArrow(sizes, "size long, n long").collect()
    assert sum(r["n"] for r in got) == 1500
    assert max(r["size"] for r in got) < 5 << 20
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(1 << 20))
    try:
        materialize(docs, "docs")
        assert spark.conf.get(key) == str(1 << 20)
    finally:
        spark.conf.set(key, before)


def test_hashing_windows_needs_little_memory(spark):
    """The arrays that a worker makes of 2 MB of text, one batch, to find its rows."""
    rng = random.Random(9)
    texts = [(k, " ".join(str(rng.random()) for _ in range(100))) for k in range(1000)]

    def peak(batches):
        import tracemalloc

        for batch in batches:
            tracemalloc.start()
            n = sum(x.num_rows for x in made(iter([batch])))
            yield pa.RecordBatch.from_arrays([pa.array([tracemalloc.get_traced_memory()[1]]), pa.array([n])], names=["size", "n"])
            tracemalloc.stop()

    class Texts:
        def mapInArrow(self, run, schema):
            return run

    made = repeats.first_rows(Texts(), 256)
    rows = spark.createDataFrame(texts, "uid long, text string").coalesce(1)
    got = rows.mapInArrow(peak, "size long, n long").collect()
    assert sum(r["n"] for r in got) > 1000
    assert max(r["size"] for r in got) < 90 << 20
