import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from plumbline.llm import idfiles, packing, queries
from plumbline.llm.shared import text_slices
from plumbline.llm.tokens import Encoder, default_vocabulary, encoder

BYTE, WORD = default_vocabulary("byte_bpe_50k.json"), default_vocabulary("word_bpe_49k.json")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_the_librarys(path):
    rnd = random.Random(5)
    odd = ["".join(rnd.choice(" \n\t\r\x1c\x85\xa0  'stABC12.,!<|é́İſñß×÷…’") for _ in range(rnd.randrange(30))) for _ in range(4000)]
    odd += ["".join(rnd.choice(" ab.,é\n1'") for _ in range(rnd.randrange(12))) for _ in range(4000)] + ["a<|endoftext|> b", "", " ", "word " * 5000]
    enc = Encoder(path, units=5000)
    for k in range(0, len(odd), 700):
        part = odd[k : k + 700]
        ids, at = enc.encode(pa.array(part))
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(part, add_special_tokens=False)]
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(part))] == want


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_all_without_gaps(seed):
    rnd = random.Random(seed)
    counts = Counter(min(1024, int(rnd.expovariate(1 / rnd.choice([30, 300, 900]))) + 1) for _ in range(3000))
    places, made = packing.plan_places(counts)
    got, bins = Counter(), defaultdict(list)
    for length, first, n, offset in places:
        got[length] += n
        for s in range(first, first + n):
            bins[s].append((offset, length))
    assert got == counts and sorted(bins) == list(range(made))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024 and sum(3 * n > 1024 for _, n in parts) <= 2
    tokens = sum(n * c for n, c in counts.items())
    large = sum(c for n, c in counts.items() if 2 * n > 1024)
    assert made <= max(-(-tokens // 1024), large) * 1.03 + 2


def test_plan_edges():
    assert packing.plan_places({}) == ([], 0)
    assert packing.plan_places({1024: 3})[1] == 3
    assert packing.plan_places({512: 5})[1] == 3
    assert packing.plan_places({1: 1025})[1] == 2
    with pytest.raises(ValueError):
        packing.plan_places({1025: 1})


def check_pieces(rows, texts):
    tok = Tokenizer.from_file(BYTE)
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, text in texts.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 1024)))
        at = 0
        for k, r in enumerate(own):
            assert r["start"] == at and (r["length"] == 1024 if k else r["length"] == (len(ids) - 1) % 1024 + 1)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    return len(bins)


def test_op5_on_the_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op5_best_fit_packing(spark, sf).collect()
    made = check_pieces(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert made <= sum(r["length"] for r in rows) / 1024 * 1.01 + 2


def test_packing_odd_and_empty(spark, odd_docs, empty_docs):
    assert packing.pack(empty_docs, BYTE).count() == 0
    extra = odd_docs.selectExpr("monotonically_increasing_id() AS doc_id", "text", "'x' AS sequence_id", "1 AS offset", "2 AS task")
    rows = packing.pack(extra, BYTE, with_ids=True)
    check_pieces(rows.collect(), {r["doc_id"]: r["text"] for r in extra.collect()})
    packed = packing.sequences(rows).collect()
    assert sum(r["n_ids"] for r in packed) == sum(r["length"] for r in rows.collect())
    assert all(len(r["ids"]) == 4 * r["n_ids"] for r in packed)
    assert packing.pack(odd_docs, BYTE).filter("piece = 0").count() == odd_docs.count()


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 100, 70_000])
def test_planes_round_trip(tmp_path, kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, np.uint32)
    planes = idfiles.to_planes(ids, kind, 4 if kind == "byte" else 32)
    assert (idfiles.from_planes(planes, kind, n) == ids).all()
    out = idfiles.Writer(f"file://{tmp_path}/x.plb", kind, block=1000)
    parts = np.array_split(ids, 5)
    for k, p in enumerate(parts):
        out.add(k if k else None, p)
    out.close()
    back = list(idfiles.Reader(str(tmp_path / "x.plb")).documents())
    assert [d for d, _ in back] == [None, 1, 2, 3, 4]
    assert all((a == b).all() and len(a) == len(b) for (_, a), b in zip(back, parts, strict=True))


def test_op10_on_the_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    tok, start, want = Tokenizer.from_file(WORD), 0, []
    for r in docs:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op10_token_id_files(spark, sf).collect()) == want


def test_id_files_odd_and_empty(spark, odd_docs, empty_docs):
    assert idfiles.round_trip(empty_docs, WORD).count() == 0
    rows = idfiles.round_trip(odd_docs, WORD, kind="bit", with_ids=True).orderBy("start").collect()
    assert len(rows) == odd_docs.count()
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows]
    assert keys == sorted(keys)
    end = 0
    for r in rows:
        assert r["start"] == end and len(r["ids"]) == 4 * r["n_tokens"]
        end += r["n_tokens"]


def test_one_row_a_third_of_all_goes_to_many_files(spark, tmp_path):
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('text ', id) AS text").union(spark.range(0, 100, 1, 8).selectExpr("77L AS doc_id", "'text 77' AS text"))
    files = idfiles.write_ids(docs, f"file://{tmp_path}/ids", WORD, files=8)
    rows = files.collect()
    assert sum(r["n_docs"] for r in rows) == 300 and max(r["n_docs"] for r in rows) < 80
    back = idfiles.read_ids(files).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == sorted([*range(200), *[77] * 100])
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(back, back[1:]))  # noqa: B905
    assert len({r["ids_crc32"] for r in back if r["doc_id"] == 77}) == 1


def test_id_columns_with_awkward_names(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (None, None)], "task bigint, text string")
    for name in ("task", "rank", "first", "nth", "text_", "_id"):
        rows = packing.pack(docs.withColumnRenamed("task", name), BYTE, id_col=name).collect()
        assert sorted(str(r[name]) for r in rows) == ["1", "2", "None"]
    with pytest.raises(ValueError, match="hide"):
        packing.pack(docs.withColumnRenamed("task", "length"), BYTE, id_col="length")
    with pytest.raises(ValueError, match="integer"):
        idfiles.write_ids(docs.selectExpr("CAST(task AS string) AS doc_id", "text"), "/tmp/none", WORD)


def test_a_worker_holds_one_encoder_and_none_for_other_operators():
    batch = pa.RecordBatch.from_arrays([pa.array(["a b"])], names=["text"])
    first = encoder(BYTE)
    list(text_slices(batch, 0, keep=BYTE))
    assert encoder(BYTE) is first
    list(text_slices(batch, 0))
    assert encoder(BYTE) is not first
    other = encoder(WORD)
    assert encoder(BYTE) is not first and encoder(WORD) is not other
