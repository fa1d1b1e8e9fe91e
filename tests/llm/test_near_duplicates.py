import random
from collections import Counter

import numpy as np
import pyarrow as pa
import plain_neardup
import pytest
from plain_neardup import brute_force, plain_words
from pyspark.sql import functions as F

from plumbline.llm import neardup, queries

def bag(text):
    w = plain_words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def plain_jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


@pytest.mark.parametrize("folder, slack", [("sf0.001", 0), ("sf0.01", 0.01)])
def test_op2_equals_all_pairs(spark, folder, slack):
    """Exactly where the sketch has room; elsewhere but for pairs that are that near to the threshold."""
    path = f"/root/testdata/{folder}"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = queries.op2_minhash_near_dedup(spark, path).collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert len(rows) == len(got) == len(docs)
    sure, most = plain_neardup.links(docs, 0.8 + slack), plain_neardup.brute_force(docs, 0.8 - slack)
    assert len(sure) > 10 and [(a, b) for a, b, _ in sure if got[a] != got[b]] == []
    assert all(most[d] == most[c] for d, c in got.items())
    weight = plain_neardup.weights(docs.values())
    for r in rows:
        if r["near_id"] is not None:
            assert got[r["near_id"]] == r["class_id"] and r["near_id"] != r["doc_id"]
            assert r["similarity"] == pytest.approx(plain_neardup.similarity(docs[r["doc_id"]], docs[r["near_id"]], weight), abs=0.02)
        else:
            assert r["class_id"] == r["doc_id"] and r["similarity"] is None and all(c != r["doc_id"] or d == c for d, c in got.items())


def edited(rnd, w, share):
    return [f"new{rnd.randrange(10**9)}" if rnd.random() < share else x for x in w]


def test_families_with_a_common_passage(spark):
    """An original and many edited copies, all of which share a passage with many other texts."""
    rnd = random.Random(11)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage, original = fresh(40), fresh(200)
    docs = {0: original}
    docs |= {i: edited(rnd, original, 0.008) for i in range(1, 60)}
    docs |= {i: passage + fresh(25) for i in range(100, 220)}
    docs |= {i: docs[100] for i in range(300, 330)}
    docs[400], docs[401] = passage + docs[150][40:], docs[150][:-1] + ["changed"]
    texts = {i: " ".join(w) for i, w in docs.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == brute_force(texts)
    assert all(got[i] == 100 for i in range(300, 330)) and got[401] == 150 == got[400]
    assert sum(got[i] == 0 for i in range(60)) > 50


def test_pairs_inside_a_template_family(spark):
    """Pages on one template that are near only in pairs: each pair is found, however large the bucket."""
    rnd = random.Random(5)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    template, docs = fresh(174), {}
    for i in range(0, 300, 2):
        shared = fresh(5)
        docs[i], docs[i + 1] = (template + shared + fresh(12) for _ in range(2))
    texts = {i: " ".join(w) for i, w in docs.items()}
    weight = plain_neardup.weights(texts.values())
    assert 0.75 < plain_neardup.similarity(texts[0], texts[2], weight) < 0.79 and 0.8 < plain_neardup.similarity(texts[0], texts[1], weight) < 0.84
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    want = brute_force(texts)
    assert sum(want[i] != i for i in texts) > 100 and all(want[i] in (i, i // 2 * 2) for i in texts)
    assert [i for i in texts if got[i] != want[i]] == []


def test_pairs_in_one_large_bucket(spark):
    """Texts that share most words with all others, and with one partner nearly all: no pair is lost."""
    rnd = random.Random(3)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    passage, texts = fresh(100), {}
    for i in range(0, 2400, 2):
        own = passage + fresh(14)
        texts[i], texts[i + 1] = " ".join(own), " ".join([*own[:-3], f"x{i}", *own[-2:]])
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == {i: i // 2 * 2 for i in texts}


def test_pairs_that_agree_on_one_band_only(spark):
    rnd = random.Random(8)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts = []
    for _ in range(2000):
        w = fresh(60)
        texts += [" ".join(w), " ".join(w[:54] + fresh(6))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    levels = neardup.frequency_levels(df)
    e = neardup.Elements(pa.array(texts), levels)
    keys, own = neardup.band_keys(neardup.signatures(e)), [(e.element[e.off[i] : e.off[i + 1]], e.level[e.off[i] : e.off[i + 1]]) for i in range(len(texts))]
    bands = {i: int((keys[i] == keys[i + 1]).sum()) for i in range(0, len(texts), 2) if neardup.similarity(own[i], own[i + 1]) >= 0.8}
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert 1 in bands.values() and [i for i, n in bands.items() if n and got[i + 1] != i] == []


def test_sizes_rule_out_no_near_pair(spark):
    rows = [(10, -8.0, 8, -8.0), (10, -8.0, 7, -8.0), (100, -2.0, 79, -16.0), (100, 0.0, 80, 0.0)]
    df = spark.createDataFrame(rows, "n long, c double, m long, d double")
    may = neardup._may_be_near((df["n"], df["c"]), (df["m"], df["d"]), 0.8)
    assert [r[0] for r in df.select(may).collect()] == [True, False, True, True]


def test_blocks_compare_as_single_pairs_do(monkeypatch):
    monkeypatch.setattr(neardup, "COLUMNS", 7)
    levels = np.random.default_rng(0).integers(0, neardup.LEVELS, 1 << neardup.SKETCH_BITS).astype(np.uint8)
    rnd = random.Random(4)
    base = [rnd.choice("abcd") for _ in range(60)]
    e = neardup.Elements(pa.array([" ".join(edited(rnd, base, 0.05)) for _ in range(9)] + ["a", "other words here"]), levels)
    own = [(e.element[e.off[i] : e.off[i + 1]], e.level[e.off[i] : e.off[i + 1]]) for i in range(11)]
    weighted = neardup.Block(own[:6]).similarities(e.rows(3, 11))
    for i in range(6):
        for j in range(3, 11):
            assert weighted[i, j - 3] == neardup.similarity(own[i], own[j])


def test_weighted_similarity_is_what_it_says():
    levels = np.random.default_rng(0).integers(0, neardup.LEVELS, 1 << neardup.SKETCH_BITS).astype(np.uint8)
    rnd = random.Random(2)
    for _ in range(40):
        a = [rnd.choice("abc") for _ in range(rnd.randrange(1, 60))]
        b = edited(rnd, a, 0.1) + ["x"] * rnd.randrange(3)
        ea, eb = (neardup.Elements(pa.array([" ".join(w)]), levels) for w in (a, b))
        weighted = neardup.similarity((ea.element, ea.level), (eb.element, eb.level))
        even = neardup.similarity((ea.element, 0 * ea.level), (eb.element, 0 * eb.level))
        assert even == pytest.approx(plain_jaccard(bag(" ".join(a)), bag(" ".join(b))))
        wa, wb = (dict(zip(e.element.tolist(), (1 + neardup.IDF_SPAN * e.level / (neardup.LEVELS - 1)).tolist(), strict=True)) for e in (ea, eb))
        assert weighted == pytest.approx(sum(wa[k] for k in wa if k in wb) / sum((wa | wb).values()))


def test_samples_agree_as_often_as_texts_are_similar():
    rng, rnd = np.random.default_rng(1), random.Random(1)
    levels = rng.integers(0, neardup.LEVELS, 1 << neardup.SKETCH_BITS).astype(np.uint8)
    agreed, expected = [], []
    for share in (0.01, 0.05, 0.1):
        for _ in range(40):
            a = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
            b = edited(rnd, a, share)
            e = neardup.Elements(pa.array([" ".join(a), " ".join(b)]), levels)
            s = neardup.signatures(e)
            agreed.append((s[0] == s[1]).mean())
            parts = [(e.element[e.off[i] : e.off[i + 1]], e.level[e.off[i] : e.off[i + 1]]) for i in (0, 1)]
            expected.append(neardup.similarity(*parts))
    assert abs(np.mean(agreed) - np.mean(expected)) < 0.02
    assert np.corrcoef(agreed, expected)[0, 1] > 0.9


def test_frequencies_count_documents(spark):
    common, n = "one two three four five", 64
    docs = spark.createDataFrame([(i, f"{common} a{i} b{i} c{i} d{i} e{i}") for i in range(n)], "doc_id bigint, text string")
    levels = neardup.frequency_levels(docs)
    slot = neardup.Elements(pa.array([common]), levels)
    assert slot.level.tolist() == [0]
    assert neardup.Elements(pa.array(["a1 b1 c1 d1 e1"]), levels).level.tolist() == [neardup.LEVELS - 1]


def test_components_of_chains_and_stars(spark):
    name = lambda i: i.to_bytes(16, "big")
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(201, 200), (200, 201), (300, 300)]
    rows = [(bytearray(name(a)), bytearray(name(b))) for a, b in edges]
    got = {int.from_bytes(r["node"], "big"): int.from_bytes(r["root"], "big") for r in neardup.components(spark.createDataFrame(rows, "a binary, b binary")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200, 300: 300}


def test_odd_rows_and_the_filter(spark, odd_docs, empty_docs):
    assert neardup.near_duplicates(empty_docs).count() == 0 and neardup.one_of_each(empty_docs).count() == 0
    rows = neardup.near_duplicates(odd_docs.withColumnRenamed("n_chars", "class_id")).collect()
    assert len(rows) == odd_docs.count()
    assert all((r["class_id"] is None) == (r["doc_id"] is None) for r in rows)
    docs = spark.createDataFrame(
        [(5, "A b c d e f"), (3, "a, b c d e f!"), (3, "a, b c d e f!"), (9, None), (8, None), (7, "..."), (None, "a b c d e f"), (2, "other words"), (2, "of one id")], "doc_id bigint, text string"
    ).selectExpr("*", "'x' AS node", "1 AS root")
    got = neardup.near_duplicates(docs, "doc_id", "text").collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == Counter([(5, 3), (3, 3), (3, 3), (9, 9), (8, 8), (7, 7), (None, None), (2, 2), (2, 2)])
    near = {r["doc_id"]: (r["near_id"], r["similarity"]) for r in got if r["class_id"] == 3}
    assert near == {5: (3, 1.0), 3: (5, 1.0)}
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(3, "a, b c d e f!"), (9, None), (8, None), (7, "..."), (None, "a b c d e f"), (2, "other words"), (2, "of one id")])


def test_the_filter_takes_rows_by_id_and_text(spark):
    rows = [(0, "a b c d e f g h", "x"), (1, "p q r s t u", "x"), (1, "a b c d e f g h", "x"), (5, "k l m n o p q", "en"), (5, "k l m n o p q", "de"), (5, "k l m n o p q", "de"),
            (5, "no such words at all", "de"), (5, None, "a"), (5, None, "a"), (6, "K l, m n o p q", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("m", F.expr("map(lang, 1)"))
    kept = [(r["doc_id"], r["text"], r["lang"]) for r in neardup.one_of_each(docs).collect()]
    assert Counter(kept) == Counter(set(rows) - {rows[2], rows[-1]})


def test_frequencies_survive_a_crowded_sketch(spark, monkeypatch):
    """Far more shingles than slots: what is in every text still weighs least, what is in one most."""
    monkeypatch.setattr(neardup, "LEAST_SKETCH_BITS", 12)
    monkeypatch.setattr(neardup, "SLOT_BYTES", 1 << 20)
    rnd = random.Random(6)
    docs = spark.createDataFrame([(i, "one two three four five " + " ".join(f"w{rnd.randrange(10**9)}" for _ in range(400))) for i in range(800)], "doc_id bigint, text string")
    levels = neardup.frequency_levels(docs)
    assert levels.shape == (neardup.SKETCH_ROWS, 1 << 12)
    assert neardup.Elements(pa.array(["one two three four five"]), levels).level[0] <= 1
    assert np.mean(neardup.Elements(pa.array([docs.head()["text"]]), levels).level[1:]) > neardup.LEVELS * 0.7


def test_a_long_text_and_its_copy(spark):
    rnd = random.Random(9)
    w = [f"w{rnd.randrange(10**5)}" for _ in range(400_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:390_000] + ["other"])), (3, "short text of six words here"), (4, "same " * 500_000)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
