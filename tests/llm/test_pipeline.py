from pathlib import Path

import pytest
from plain_neardup import brute_force
from test_packing_and_id_files import check_pieces
from test_spans import plain_hits, plain_pii

import corpus_pipeline
from plumbline.llm import packing
from plumbline.llm.shared import shared_folder

SF = "/root/testdata/sf0.001"


def texts(df):
    rows = df.collect()
    out = {r["doc_id"]: r["text"] for r in rows}
    assert len(out) == len(rows)
    return out


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "123 456 !!!", "en", "s", 11), (10**6 + 1, None, "en", "s", None)], docs.schema)
    docs = docs.union(junk)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "MinHash near-dedup", "benchmark decontamination", "PII", "best-fit packing"]

    def step(name, before):
        out = stages[name](spark, before, SF).cache()
        if name != "best-fit packing":
            assert out.dtypes == before.dtypes
        return out

    known = step("language ID", docs)
    assert set(texts(docs)) - set(texts(known)) == {10**6, 10**6 + 1}

    unique = step("MinHash near-dedup", known)
    before = texts(known)
    least = brute_force(before)
    assert texts(unique) == {d: t for d, t in before.items() if least[d] == d}

    clean = step("benchmark decontamination", unique)
    before = texts(unique)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {h[0] for h in plain_hits(list(before.items()), items) if h[-1]}
    assert bad and texts(clean) == {d: t for d, t in before.items() if d not in bad}

    private = step("PII", clean)
    before, after = texts(clean), texts(private)
    assert set(before) == set(after)
    found = {d for d, t in before.items() if plain_pii(t)}
    assert found and all(not plain_pii(after[d]) for d in found)
    assert all(before[d] == after[d] for d in before if d not in found)
    assert all(r["n_chars"] == len(r["text"]) for r in private.collect() if r["doc_id"] in found)

    check_pieces(step("best-fit packing", private).collect(), after)


def test_run_is_all_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows[0].asDict())


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_stages_bear_odd_rows(spark, odd_docs, empty_docs, kind):
    docs = (odd_docs if kind == "odd" else empty_docs).selectExpr("*", "'x' AS spans", "1 AS row", "2 AS class_id", "3 AS score")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "best-fit packing":
            assert out.columns == docs.columns
        n = out.count()
        assert n == 0 if kind == "empty" else n > 0 or name == "language ID"  # nothing there to learn a language from


def test_the_output_holds_the_sequences(spark):
    rows = packing.sequences(corpus_pipeline.run(spark, SF)).collect()
    assert rows and all(len(r["ids"]) == 4 * r["n_ids"] <= 4 * packing.CAPACITY for r in rows)
    left = [p.name for p in Path(shared_folder(spark).removeprefix("file:")).iterdir() if p.name.startswith(("scratch", "stage-language"))]
    assert left == []
