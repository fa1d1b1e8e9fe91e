import math
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from plumbline.llm import langid, quality_rules, quality_score, queries, sampling

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    where = {}
    for k in range(len(w) - 7):
        where.setdefault(tuple(w[k : k + 8]), []).append(k)
    hit = {i for at in where.values() if len(at) > 1 for k in at for i in range(k, k + 8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit), failed


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_statistics_equal_brute_force(spark, odd_docs):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_statistics(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    odd = [r["text"] or "" for r in odd_docs.collect()] + ["a b c d e f g h " * 3, "x\nx\nx", " \n \n"]
    stats, _ = quality_rules.statistics(pa.array(odd))
    got = list(zip(*(stats[s].tolist() for s in quality_rules.STATS), quality_rules.base_failed(stats).tolist(), strict=True))
    assert got == [plain_statistics(t) for t in odd]


def test_rules_keep_good_and_drop_bad(spark):
    rows = queries.op6_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    tested = [r for r in rows if fold(r["doc_id"])]
    able = [r for r in tested if not r["base_failed"]]
    assert np.mean([r["kept"] for r in able if r["quality"] == 1]) > 0.97
    assert np.mean([not r["kept"] for r in tested if r["quality"] == 0]) > 0.85


def test_trees_learn_and_stay_monotonic():
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (3000, 3))
    y = ((x[:, 0] < 0.4) ^ (rng.uniform(size=3000) < 0.1)).astype(float)
    trees = quality_rules.fit_trees(x, y, np.ones(3000), [-1, 1, 0], trees=30)
    assert ((trees.score(x) >= 0.5) == (x[:, 0] < 0.4)).mean() > 0.97
    line = np.linspace(0, 1, 200)
    for _ in range(50):
        at = np.tile(rng.uniform(0, 1, 3), (200, 1))
        for f, sign in ((0, -1), (1, 1)):
            along = at.copy()
            along[:, f] = line
            assert (sign * np.diff(trees.margin(along)) >= -1e-12).all()

    def walk(row):  # node by node
        total = trees.bias
        for node in trees.root:
            while trees.low[node] != node:
                node = trees.low[node] if row[trees.feature[node]] <= trees.limit[node] else trees.high[node]
            total += trees.value[node]
        return total

    assert np.allclose(trees.margin(x[:50]), [walk(r) for r in x[:50]])


def test_compression_classifier_on_held_out(spark):
    rows = queries.op7_quality_classifier(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == fold(r["doc_id"]) for r in rows)
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    tested = [(label[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in label]
    assert np.mean([a == b for a, b in tested]) > 0.93


def test_language_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op9_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]) > 0.98


def test_models_ignore_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    poisoned = docs.withColumn("lang", F.when(sampling.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    a, b = langid.fit(docs, rows=100), langid.fit(poisoned, rows=100)
    assert a.languages == b.languages and (a.weights == b.weights).all() and (a.idf == b.idf).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(sampling.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_score.fit(docs, labels), quality_score.fit(docs, flipped)
    assert (a.value == b.value).all() and a.good == b.good and a.bad == b.bad


def test_scores_by_compression_equal_a_plain_restatement(spark, odd_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality_score.fit(docs, labels)

    def size(text, raw):
        held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if model.trained else zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=9, dict_data=held, write_content_size=False, write_dict_id=False).compress(text))

    def plain(text):
        raw = (text or "").encode()
        x = (size(raw, model.bad) - size(raw, model.good)) / math.sqrt(len(raw) + 1)
        knots = list(zip(model.difference.tolist(), model.value.tolist(), strict=True))
        if x <= knots[0][0]:
            return knots[0][1]
        for (a, u), (b, v) in zip(knots, knots[1:]):  # noqa: B905
            if x <= b:
                return u + (v - u) * (x - a) / (b - a)
        return knots[-1][1]

    both = docs.select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    want = Counter((d, t, round(plain(t), 9)) for d, t in ((r["doc_id"], r["text"]) for r in both.collect()))
    texts = both.withColumn("doc_id", F.struct("doc_id", "text"))  # the id is carried as it is
    got = quality_score.predict(texts, model).collect()
    assert Counter((r["doc_id"]["doc_id"], r["doc_id"]["text"], round(r["score"], 9)) for r in got) == want
    assert (np.diff(model.difference) > 0).all() and (np.diff(model.value) > 0).all()


def test_isotonic_equals_the_best_monotone_fit():
    """The value at a place is max over starts of min over ends of means."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 30, 200).astype(float)
    y, w = (rng.uniform(size=200) < x / 30).astype(float), rng.uniform(0.5, 2, 200)
    at, value = quality_score.isotonic(x, y, w)
    mean = lambda a, b: (w * y)[(x >= a) & (x <= b)].sum() / w[(x >= a) & (x <= b)].sum()
    places = np.unique(x)
    best = [max(min(mean(a, b) for b in places[places >= p]) for a in places[places <= p]) for p in places]
    assert sorted(set(np.round(best, 9))) == np.round(value, 9).tolist() and (np.diff(at) > 0).all()


def plain_language(model, text):
    """The likeliest language and its probability, n-gram by n-gram."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 1.0
    small, tf = text.lower(), Counter()
    for i in range(len(small)):
        g = 0
        for n in (1, 2, 3):
            if i + n <= len(small):
                g = (g * 0x01000193 + ord(small[i + n - 1]) + n) % 2**32
                tf[((g ^ (g >> 15)) * 0x9E3779B1 % 2**32) >> (32 - model.bits)] += 1
    value = {f: (1 + math.log(n)) * model.idf[f] for f, n in tf.items()}
    norm = math.sqrt(sum(v * v for v in value.values()))
    z = [sum(v / norm * float(model.weights[f, k]) for f, v in value.items()) / model.temperature for k in range(len(model.languages))]
    e = [math.exp(v - max(z)) for v in z]
    return model.languages[e.index(max(e))], max(e) / sum(e)


def test_languages_equal_a_plain_restatement(spark, odd_docs, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    texts = [r["text"] for r in docs.limit(60).collect() + odd_docs.collect()]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()
    for r in got:
        lang, score = plain_language(model, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-6)
    whole = [x.tolist() for x in langid._counts([t or "" for t in texts], 15)]
    for piece in (7, 500):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert [x.tolist() for x in langid._counts([t or "" for t in texts], 15)] == whole


def test_a_very_long_text_needs_little_memory(spark):
    """Counted in another process, whose peak is its own."""
    code = "import resource; from plumbline.llm import langid; t = 'some Words ' * 3_600_000; a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; n = langid._counts([t], 15)[2].sum(); print(n, len(t), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) >> 10)"
    n, size, mb = map(int, subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True).stdout.split())
    assert n == 3 * size - 3 and mb < 300


def test_ftrl_equals_a_plain_restatement():
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.uniform(0.1, 1, 4), int(rng.integers(3))) for _ in range(30)]
    z, n = ([[0.0] * 3 for _ in range(12)] for _ in range(2))

    def weight(f, k):
        if abs(z[f][k]) <= langid.L1:
            return 0.0
        return (math.copysign(langid.L1, z[f][k]) - z[f][k]) / ((langid.BETA + math.sqrt(n[f][k])) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(1)
    for _ in range(langid.EPOCHS):
        for i in order.permutation(len(rows)):
            at, value, y = rows[i]
            w = {(f, k): weight(f, k) for f in at for k in range(3)}
            s = [sum(v * w[f, k] for f, v in zip(at, value, strict=True)) for k in range(3)]
            e = [math.exp(x - max(s)) for x in s]
            for f, v in zip(at, value, strict=True):
                for k in range(3):
                    g = v * (e[k] / sum(e) - (k == y))
                    z[f][k] += g - (math.sqrt(n[f][k] + g * g) - math.sqrt(n[f][k])) / langid.ALPHA * w[f, k]
                    n[f][k] += g * g
    want = [[weight(f, k) for k in range(3)] for f in range(12)]
    got = langid.fit_ftrl(rows, 13, 3)
    assert np.allclose(got[:12], want, atol=1e-9) and (got[12] == 0).all()


def test_ngram_counts_equal_brute_force():
    texts = ["", "a", "Ab", "héllo wörld", "ab ab", "\U0001f600x"]
    got = {}
    for of, feature, n in zip(*langid._counts(texts, 20), strict=True):
        got.setdefault(int(of), []).append(int(n))
    for i, t in enumerate(texts):
        grams = [t.lower()[k : k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1)]
        want = {g: grams.count(g) for g in grams}
        assert sorted(got.get(i, [])) == sorted(want.values())


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(4000, 3)) * 2
    y = np.array([rng.choice(3, p=p) for p in langid.softmax(z)])
    assert abs(langid.fit_temperature(z * 5, y) - 5) < 0.5


def test_sample_is_bounded_and_order_free(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('ab ', 10) || id AS text", "IF(id % 10 = 0, 'x', 'y') AS lang")
    hot = docs.union(spark.range(1000).selectExpr("5L AS doc_id", "'same' AS text", "'y' AS lang"))
    counts, sample = sampling.labelled_sample(hot, hot, "lang", 50, 1 << 20, label_id="doc_id")
    assert all(len(v) <= 50 and len(set(v)) == len(v) for v in sample.values()) and set(sample) == {"x", "y"}
    assert sample == sampling.labelled_sample(hot.repartition(7), hot.repartition(5), "lang", 50, 1 << 20, label_id="doc_id")[1]
    assert sum(len(t) for t in sampling.labelled_sample(hot, hot, "lang", 50, 1000)[1]["y"]) <= 500


def test_sample_loses_no_label(spark):
    """A long text drawn early, many labels, repeated label rows and labels without a document."""
    docs = spark.range(600).selectExpr("id AS doc_id", "IF(id % 2 = 0, repeat('long ', 5000), 'short ' || id) AS text", "IF(id < 300, 'aa', 'bb') AS lang")
    counts, sample = sampling.labelled_sample(docs, docs, "lang", 50, 20_000)
    plain = {i for i in range(600) if not fold(i)}
    assert counts == {"aa": sum(i < 300 for i in plain), "bb": sum(i >= 300 for i in plain)}
    assert all(len(sample[k]) > 10 and all(t.startswith("short") for t in sample[k]) for k in ("aa", "bb"))
    only = sampling.labelled_sample(docs.where("doc_id % 2 = 0"), docs, "lang", 50, 20_000)[1]
    assert {k: len(v) for k, v in only.items()} == {"aa": 1, "bb": 1}
    many = spark.range(9000).selectExpr("id AS doc_id", "'text ' || id AS text", "concat('l', id % 300) AS lang")
    counts, sample = sampling.labelled_sample(many, many, "lang", 1200, 1 << 20)
    assert len(counts) == len(sample) == 300 and min(map(len, sample.values())) > 5
    with pytest.raises(ValueError, match="most_labels"):
        sampling.labelled_sample(many, many, "lang", 1200, 1 << 20, most_labels=299)
    labels = docs.select("doc_id", "lang").union(spark.range(1000).selectExpr("5L", "'aa'")).union(spark.range(1000, 1500).selectExpr("id", "'bb'"))
    again = sampling.labelled_sample(docs, labels, "lang", 50, 20_000)
    assert again[0] == {"aa": sum(i < 300 for i in plain), "bb": sum(i >= 300 for i in plain)} and again[1] == sampling.labelled_sample(docs, docs, "lang", 50, 20_000)[1]


@pytest.mark.parametrize("learned", [False, True])
def test_models_bear_odd_rows(spark, odd_docs, empty_docs, learned):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    no_labels = labels.limit(0)
    src, lab = (docs, labels) if learned else (empty_docs, no_labels)
    lang, trees, comp = langid.fit(src), quality_rules.fit(src, lab), quality_score.fit(src, lab)
    for data in (odd_docs.withColumnRenamed("n_chars", "score"), empty_docs):
        n = data.count()
        rows = langid.predict(data, lang, whole_rows=True).collect()
        assert len(rows) == n and sorted(map(repr, (r["row"] for r in rows))) == sorted(map(repr, data.collect()))
        assert all(r["lang_pred"] == "und" for r in rows) or learned
        assert len(quality_rules.judge(data, trees).collect()) == n
        got = quality_score.predict(data, comp).collect()
        assert len(got) == n and all(0 <= r["score"] <= 1 for r in got)
    by_text = langid.predict(odd_docs.selectExpr("coalesce(text, 'NULL TEXT') AS doc_id", "text"), lang).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in by_text}["NULL TEXT"] == "und"
