"""Column expressions against plain Python."""

import difflib
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import normalize, score, udfs
from plumbline.plans import queries
from plumbline.sources import tables


def plain_normalize(code):
    code = re.sub(r"#[^\n]*", "", code)
    for quote in "\"'":
        code = re.sub(rf"{quote}(?:[^{quote}\\]|\\.)*{quote}", "STR_LITERAL", code)
    code = re.sub(r"\b\d+\b", "NUM_LITERAL", re.sub(r"\b\d+\.\d+\b", "NUM_LITERAL", code))
    code = re.sub(r"\bdef\s+[A-Za-z_]\w*\s*\(", "def FUNC_NAME(", code)
    names = []
    if m := re.search(r"\bdef\s+FUNC_NAME\s*\(([^)]*)\)", code):
        for part in m[1].split(","):
            if (n := re.match(r"[A-Za-z_]\w*", part.strip().lstrip("*"))) and n[0] not in ("self", "cls"):
                names.append(n[0])
    names += re.findall(r"^\s+([A-Za-z_]\w*)\s*(?::[^=\n]*)?\s*=(?!=)", code, re.M)
    for i, n in enumerate(dict.fromkeys(names), 1):
        code = re.sub(rf"\b{n}\b", f"v{i}", code)
    code = re.sub(r"[ \t]+", " ", code.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n\s*\n+", "\n", code).strip()


CODES = [
    "def add(a, b):\n    total = a + b  # sum\n    return total",
    "def m(self, xs: list, *args, k=1, **kw) -> int:\n\tname = 'it''s'\n\n\n\ty: float = 1.5e3 + 0x1f\n\tif name == y: y += 2\n\treturn f\"{name}\\\"\"",
    'def d():\n    """Doc "quoted" # no"""\n    s = "a\\\\" + \'b\'\n    return s',
    "def outer(v2, v1):\n    def inner(q=(1, 2), z=3):\n        v1 = v2\n        return v1\n    x = inner(kw=2)\n    return x",
    "async def é(ñame, b):\r\n    ünder = ñame\r\n    return ünder + b1",
    "x = 1\n  y = 2", "", "   \n\t\n", "def f(a=g(1), b=2):\n    else_ = 1\n    a = b\n    b == c\n    return a",
    "'unclosed\ndef f(x): return x", "def f(x):\n    y = x\n" * 3, "def f(" + "a" * 50 + "):\n    s = '" + "x" * 20000 + "'\n    return s",
]


def test_normalization_equals_plain_python(spark):
    rnd = random.Random(4)
    parts = ["def f(", "a", "b2", ", ", ")", ":\n", "    ", " = ", "==", "'", '"', "\\", "#", "1", "2.5", "é", "\n", "\t", "v1", "self", "**", "x: int = ", "\r\n"]
    codes = CODES + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(codes)), "id int, code string")
    n = normalize.normalize(F.col("code"))
    got = {r["id"]: (r["n"], r["h"]) for r in df.select("id", n.alias("n"), normalize.code_hash(n).alias("h")).collect()}
    for i, code in enumerate(codes):
        want = plain_normalize(code)
        assert got[i] == (want, hashlib.sha256(want.encode()).hexdigest()), code


def test_full_normalization_takes_the_text_as_it_is(spark, tmp_path):
    texts = ["el año", "el a o", "слово", "другое", "same\nwords", "same  \twords", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["code_hash"] for r in queries.full_normalization(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        names = ", ".join(dict.fromkeys(w for w in re.split("[^A-Za-z]+", text or "") if w))
        assert got[i] == hashlib.sha256(plain_normalize(f"def f({names}):\n    " + (text or "").replace("\n", "\n    ")).encode()).hexdigest()
    assert got[0] != got[1] and got[2] != got[3]


def test_statements_read_all_words_of_a_line(spark):
    n = 1_000_005
    docs = spark.createDataFrame([(1, "w " + "x " * n + "last"), (2, "a b\n\nc"), (3, None)], "doc_id bigint, text string")
    got = {(r["func"], r["index"]): (r["writes"], sorted(r["reads"])) for r in tables.line_statements(docs).collect()}
    assert got == {(1, 0): (["w"], ["last", "x"]), (2, 0): (["a"], ["b"]), (2, 1): ([], []), (2, 2): (["c"], []), (3, 0): ([], [])}


def test_renaming_keeps_the_normal_form(spark):
    pair = ["def add(a, b):\n    t = a * b\n    return t", "def mul(left, right):\n    # other names\n    out = left * right\n\n    return out"]
    rows = spark.createDataFrame([(c,) for c in pair], "code string").select(normalize.normalize(F.col("code")).alias("n")).collect()
    assert rows[0] == rows[1]
    with pytest.raises(ValueError, match="Unsupported language: cobol"):
        normalize.normalize(F.col("code"), "cobol")
    assert spark.sql("SELECT CAST(NULL AS string) AS code").select(normalize.normalize(F.col("code"))).head()[0] is None


def value(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize("a, b, ok", [(10, 7, True), (10, 6, False), (7, 10, True), (0, 5, True), (5, 0, True), (1, 1, True)])
def test_loc_ratio(spark, a, b, ok):
    assert value(spark, score.loc_ratio_holds(F.lit(a), F.lit(b))) is ok


def test_loc_band_is_coarser(spark):
    got = [value(spark, score.loc_in_bounds(F.lit(10), F.lit(c))) for c in (6, 7, 15, 16)]
    assert got == [False, True, True, False]
    assert value(spark, score.loc_in_bounds(F.lit(0), F.lit(99))) is True


def sides(*values):
    kinds = ["array<string>", "array<string>", "string", "string", "array<string>", "array<string>"]
    return [F.lit(v).cast(k) if v is not None else F.lit(None).cast(k) for v, k in zip(values, kinds, strict=True)]


def test_structural_score_and_explanations(spark):
    same = sides(["a"], ["b"], None, None, [], [])
    assert value(spark, score.structural_score(*same)) == 1.0
    assert value(spark, score.differences(*same)) == []
    other = sides(["a"], ["b", "c"], "int", None, ["x", "y"], ["y", "it's"])
    assert value(spark, score.structural_score(*other)) == pytest.approx((0.5 + 0.3 + 1 / 3) / 3)
    said = value(spark, score.differences(*other))
    assert said[:3] == ["parameter count differs (1 vs 2)", "return type differs ('int' vs None)", "query calls not in candidate: ['x']"] and len(said) == 4
    assert value(spark, score.hints(score.differences(*other))) == list(score.HINTS.values())
    assert value(spark, score.differences(*sides([], [], "'a'", 'b"', [], []))) == ["return type differs (\"'a'\" vs 'b\"')"]
    empty = sides([], [], "a", "a", None, None)
    assert value(spark, score.structural_score(*empty)) == 1.0


def test_method_and_chunk_scores(spark):
    f = F.lit
    assert value(spark, score.method_score(f(True), f(0.0), f(0.0), f(2.8 / 3))) == pytest.approx(0.8 + 0.2 * 2.8 / 3)
    assert value(spark, score.method_score(f(False), f(0.9), f(0.8), f(1.0))) == pytest.approx(0.45 + 0.24 + 0.2)
    assert value(spark, score.round4(f(0.86235))) == 0.8624 or value(spark, score.round4(f(0.86235))) == round(0.86235, 4)
    ids = lambda n: F.array(*map(F.lit, range(n))) if n else F.array().cast("array<int>")
    one = lambda q, c, *t: value(spark, score.chunk_structural(F.lit(q), ids(c), F.lit(0), F.lit(4), t or None))
    assert one(5, 10) == 0.5 and one(0, 3) == 1.0 and one(None, 3) == 1.0 and one(10, 0) == 0.5
    assert one(4, 4, ids(1), ids(3), ids(0), ids(0)) == pytest.approx((1 + 1 / 3 + 1) / 3)
    assert value(spark, score.chunk_score(f(0.8), f(1.0))) == pytest.approx(0.86)
    assert value(spark, score.chunk_score(f(2.0), f(1.0))) == 1.0 and value(spark, score.chunk_score(f(-2.0), f(0.0))) == 0.0
    assert [value(spark, score.chunk_hint(f(x)))[:5] for x in (0.99, 0.98, 0.85, 0.7, 0.1)] == ["Exact", "Very ", "Very ", "Relat", "Loose"]


def test_sequence_ratio_and_encoder(spark):
    a, b = ["x"] * 3 + list("abc"), list("abcd")
    long_a, long_b = ["p", "q"] * 150, ["q", "p", "r"] * 100
    rows = [(a, b, "", ""), ([], b, "abcd", "bcde"), (None, None, None, "x"), (long_a, long_b, "", ""), (long_b, long_a, "", "")]
    df = spark.createDataFrame(rows, "p array<string>, q array<string>, s string, t string")
    got = [r[0] for r in df.select(udfs.sequence_ratio("p", "q", "s", "t")).collect()]
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    assert got == [ratio(a, b), ratio("abcd", "bcde"), ratio("", "x"), ratio(long_a, long_b), ratio(long_b, long_a)]
    v = [np.array(r[0]) for r in spark.createDataFrame([("a b c",), ("a b c",), ("x y z",), ("",), (None,)], "t string").select(udfs.encoder()("t")).collect()]
    assert all(x.shape == (384,) and abs(np.linalg.norm(x) - 1) < 1e-6 for x in v)
    assert v[0] @ v[1] == pytest.approx(1) and v[0] @ v[2] < 0.95


def test_an_encoder_gets_equal_texts_once(spark, tmp_path):
    def encode(texts):
        with open(tmp_path / "calls", "a") as f:
            f.write(f"{len(texts)}\n")
        return [[float(len(t)), float(ord(t[0])) if t else 0.0] for t in texts]

    rows = [(i, None if i % 7 == 6 else "abc"[i % 3] * (i % 5)) for i in range(300)]
    got = spark.createDataFrame(rows, "id int, t string").coalesce(1).select("id", udfs.encoder(encode, 4)("t").alias("v")).collect()
    assert {r["id"]: r["v"] for r in got} == {i: [float(len(t or "")), float(ord(t[0])) if t else 0.0] for i, t in rows}
    calls = [int(n) for n in (tmp_path / "calls").read_text().split()]
    assert max(calls) <= 4 and sum(calls) == len({t or "" for _, t in rows})


def test_names_that_meet_new_names_are_followed(spark):
    codes = ["def f(z):\n" + "".join(f"    v{i} = v{j}\n" for i, j in zip(order, order[1:], strict=False)) for n in (1, 2, 9, 40) for order in (range(n), range(n, -1, -1), random.Random(n).sample(range(2 * n), n))]
    rows = spark.createDataFrame(list(enumerate(codes)), "id int, code string").select("id", normalize.normalize(F.col("code")).alias("n")).collect()
    assert {r["id"]: r["n"] for r in rows} == {i: plain_normalize(code) for i, code in enumerate(codes)}


def test_steps_that_find_nothing_leave_the_text(spark):
    codes = ["", "x", "a  b\t c\td", "\r", "a\r\nb\rc", "1.5 1 .5 1. x1.5", "# only", "it's 'one' \"two\"", None]
    df = spark.createDataFrame(list(enumerate(codes)), "id int, c string")
    steps = {"strip_comments": [(r"#[^\n]*", "")], "replace_numbers": [(r"\b\d+\.\d+\b", "NUM_LITERAL"), (r"\b\d+\b", "NUM_LITERAL")], "collapse_space": [(r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n\s*\n+", "\n"), (r"^\s+|\s+$", "")]}
    for step, changes in steps.items():
        want = list(codes)
        for pattern, new in changes:
            want = [re.sub(pattern, new, c) if c is not None else None for c in want]
        got = {r["id"]: r["n"] for r in df.select("id", getattr(normalize, step)(F.col("c")).alias("n")).collect()}
        assert [got[i] for i in range(len(codes))] == want, step
