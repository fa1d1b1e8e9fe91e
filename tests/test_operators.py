import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import syntax
from plumbline.operators import graph, similar, vector
from plumbline.operators.store import Index
from plumbline.plans import code_queries
from plumbline.sources import repository


def plain_chunks(n, edges, most):
    if not n or most >= n:
        return [list(range(n))] if n else []
    providers = {i: {a for a, b in edges if b == i} for i in range(n)}
    done, now, out = set(), [], []
    for i in range(n):
        if now and (not providers[i] or providers[i] & done or len(now) >= most):
            out.append(now)
            done.update(now)
            now = []
        now.append(i)
    return [*out, now]


def statements(spark, functions):
    rows = [(f, i, None, "expression_statement", w, r) for f, body in functions.items() for i, (w, r) in enumerate(body)]
    return spark.createDataFrame(rows, "func long, index int, parent int, kind string, writes array<string>, reads array<string>")


def test_edges_chunks_and_links_equal_plain_python(spark):
    rnd = random.Random(7)
    pick = lambda: [rnd.choice("abcdefgh") for _ in range(rnd.randrange(3))]
    functions = {f: [(pick(), pick()) for _ in range(rnd.randrange(1, 30))] for f in range(60)}
    s = statements(spark, functions)
    want = {f: {(a, b) for a in range(len(body)) for b in range(a + 1, len(body)) if set(body[a][0]) & set(body[b][1])} for f, body in functions.items()}
    edges = graph.data_edges(s).cache()
    got = {f: set() for f in functions}
    for r in edges.collect():
        got[r["func"]].add((r["src"], r["dst"]))
    assert got == want
    for most in (1, 4, 1000):
        chunks = graph.greedy_chunks(s, most).cache()
        notes = graph.annotate(chunks, graph.chunk_links(chunks, edges)).collect()
        by = {}
        for r in notes:
            by.setdefault(r["func"], {})[r["chunk_index"]] = r
        for f, body in functions.items():
            plain = plain_chunks(len(body), want[f], most)
            assert [by[f][k]["statement_indices"] for k in range(len(by[f]))] == plain
            of = {i: k for k, c in enumerate(plain) for i in c}
            for k in range(len(plain)):
                assert by[f][k]["depends_on_chunks"] == sorted({of[a] for a, b in want[f] if of[b] == k and of[a] != k})
                assert by[f][k]["depended_on_by_chunks"] == sorted({of[b] for a, b in want[f] if of[a] == k and of[b] != k})
    with pytest.raises(ValueError):
        graph.greedy_chunks(s, 0)
    assert graph.greedy_chunks(s.limit(0)).count() == 0


def test_chunks_with_contents_equal_chunks_of_edges(spark):
    rnd = random.Random(11)
    pick = lambda: [rnd.choice("abcdefgh") for _ in range(rnd.randrange(3))]
    functions = {f: [(pick(), pick()) for _ in range(rnd.randrange(1, 30))] for f in range(40)}
    s = statements(spark, functions).withColumns({"start_line": F.col("index") + 2, "end_line": F.col("index") + 3})
    for most in (3, 20):
        plain = graph.greedy_chunks(s, most)
        chunks = graph.chunked_statements(s, most).cache()
        assert sorted(chunks.select(*plain.columns).collect()) == sorted(plain.collect())
        assert sorted(graph.links_of_chunks(chunks).collect()) == sorted(graph.chunk_links(plain, graph.data_edges(s)).collect())
        assert all((r["start_line"], r["end_line"]) == (r["statement_start"] + 2, r["statement_end"] + 3) for r in chunks.collect())


def test_chunks_of_listed_statements_equal_chunks_of_a_table(spark):
    rnd = random.Random(12)
    line = lambda: f"    {rnd.choice('abcdefgh')} = {rnd.choice('abcdefgh')} + g({rnd.choice('abcdefgh')},\n  1)\n"
    codes = ["def f(a):\n" + "".join(line() for _ in range(rnd.randrange(1, 70))) for _ in range(30)] + [code_queries.FORMS, "x = 1", "def f(:", "", None]
    df = spark.createDataFrame(list(enumerate(codes)), "func bigint, body_code string")
    table = repository.statements(df, "func").cache()
    for most in (1, 4, 20):
        chunks = graph.chunked_statements(table, most).cache()
        want = graph.annotate(chunks, graph.links_of_chunks(chunks)).drop("writes", "reads")
        listed = repository.listed_statements(df).withColumn("lines", F.split("body_code", "\n")).drop("body_code")
        made = graph.annotated_chunks(listed, most)
        assert sorted(made.select(*want.columns).collect()) == sorted(want.collect())
        assert all(r["lines"] == codes[r["func"]].split("\n")[r["start_line"] - 1 : r["end_line"]] for r in made.collect())
        assert "Exchange" not in plan(made)
    large = repository.listed_statements(df, over=30).select("func").collect()
    assert {r["func"] for r in large} == {i for i, code in enumerate(codes) if syntax.count_statements(code or "") > 30}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_statements_and_chunks_are_never_broadcast(spark):
    functions = {f: [(["a"], ["b"]), (["b"], ["a"])] for f in range(9)}
    s = statements(spark, functions).withColumns({"start_line": F.lit(2), "end_line": F.lit(3)})
    chunks = graph.chunked_statements(s, 1)
    for df in (graph.first_providers(s), chunks, graph.annotate(chunks, graph.links_of_chunks(chunks))):
        assert "Broadcast" not in plan(df)


def test_control_edges_of_a_nested_function(spark):
    rows = [(1, 0, None, "for_statement"), (1, 1, 0, "if_statement"), (1, 2, 1, "expression_statement"), (1, 3, 0, "expression_statement"), (1, 4, None, "return_statement")]
    s = spark.createDataFrame(rows, "func long, index int, parent int, kind string")
    assert {(r["src"], r["dst"]) for r in graph.control_edges(s).collect()} == {(0, 1), (0, 3), (1, 2), (1, 3), (0, 4)}


@pytest.mark.parametrize(
    "deps, ok", [([], True), ([[]], True), ([[0]], False), ([[1], [0]], False), ([[1], [2], []], True), ([[1], [2], [0]], False), ([[5], [-1]], True), ([[], [0], [0, 1]], True)]
)
def test_acyclic(spark, deps, ok):
    df = spark.createDataFrame([(deps,)], "deps array<array<int>>")
    assert df.select(graph.is_acyclic(F.col("deps"))).head()[0] is ok


def test_top_k_equals_numpy(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (300, 8)).astype(float)  # many ties
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 8), (999, None)], "id long, embedding array<double>").repartition(5)
    for block in (4096, 37):
        monkeypatch.setattr(vector, "BLOCK_ROWS", block)
        got = {}
        for r in vector.top_k(base.where("id % 2 = 0"), base, 4).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = r["base_id"]
        for q in range(0, 300, 2):
            order = sorted(range(300), key=lambda i: (-(x[q] @ x[i]), i))[:4]
            assert [got[q][k] for k in (1, 2, 3, 4)] == order
    assert vector.top_k(base.limit(0), base, 3).count() == 0 and vector.top_k(base, base.limit(0), 3).count() == 0
    few = base.where("id in (1, 2)")
    assert vector.top_k(few, few, 9).count() == 4


def test_filters_after_and_before_the_ranking(spark):
    base = spark.createDataFrame([(i, [float(10 - i)]) for i in range(6)], "id long, embedding array<double>")
    query, allowed = base.where("id = 0"), base.where("id in (1, 4, 5)")
    assert [r["base_id"] for r in vector.post_filter(vector.top_k(query, base, 3), allowed).collect()] == [1]
    assert sorted(r["base_id"] for r in vector.pre_filter(query, base, allowed, 3).collect()) == [1, 4, 5]


def method(i, file, name, params, lines, code, deps=(), returns=None, vec=(1.0, 0.0)):
    return (i, file, "python", name, list(params), returns, code, code, code, 1, lines, list(deps), code.split(), list(vec))


SCHEMA = (
    "id long, file_path string, language string, name string, parameters array<string>, return_type string, body_code string, normalized_code string, code_hash string, "
    "start_line int, end_line int, dependencies array<string>, ast_fingerprint array<string>, embedding array<float>"
)


def test_pairs_are_scored_and_told_once(spark):
    rows = [method(1, "a.py", "f", "ab", 5, "one two three"), method(2, "b.py", "g", "cd", 5, "one two three"), method(3, "a.py", "h", "abcd", 5, "one two three"),
            method(4, "a.py", "k", "ab", 9, "one two three"), method(5, "a.py", "s", "ab", 2, "one two three"), method(6, "c.py", "w", "ab", 5, "one two four")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = similar.similar_pairs(df).collect()
    assert [(r["query_id"], r["base_id"]) for r in found] == [(1, 2), (1, 6), (2, 6)]
    assert found[0]["exact_match"] and found[0]["final"] == 1.0 and found[0]["differences"] == []
    assert found[1]["final"] == pytest.approx(0.5 + 0.3 * 2 / 3 + 0.2, abs=1e-4)
    assert [(r["query_id"], r["base_id"]) for r in similar.similar_pairs(df, threshold=0.95).collect()] == [(1, 2)]
    assert similar.similar_pairs(df, min_lines=6).count() == 0 and similar.similar_pairs(df.limit(0)).count() == 0
    clones = spark.createDataFrame([method(i, "x.py", f"f{i}", "a", 5, "same code") for i in range(6)], SCHEMA)
    assert 0 < similar.similar_pairs(clones, top_k=1).count() <= 6
    assert sorted(r["id"] for r in similar.candidates_for(df, "python", 2, 5).collect()) == [1, 2, 6]
    gone = df.where("id <> 2")
    assert [(r["query_id"], r["base_id"]) for r in similar.similar_pairs(gone, df).collect()] == [(1, 6)]


def test_equal_methods_are_searched_for_once(spark, monkeypatch):
    rnd = random.Random(5)
    code = ["one two three", "one two four", "five six"]
    vecs = [(1.0, 0.0), (0.96, 0.28), (0.0, 1.0)]
    rows = []
    for i in range(1, 90):
        k = rnd.randrange(3)
        rows.append(method(i, f"{i % 4}.py", f"f{i}", rnd.choice(["ab", "cd", "abc"]), rnd.choice([3, 5, 6]), code[k], rnd.choice([(), ("g",)]), rnd.choice([None, "int"]), vecs[k]))
    df = spark.createDataFrame(rows, SCHEMA)
    live = df.where("id % 7 <> 0")
    asked, search = [], vector.top_k
    monkeypatch.setattr(vector, "top_k", lambda queries, *a, **b: asked.append(queries.count()) or search(queries, *a, **b))
    shown = ["query_id", "base_id", "final", "exact_match", "embedding_similarity", "ast_similarity", "differences", "refactoring_hints", "q_name", "c_name", "place"]
    for k in (2, 5):
        able = live.where("end_line >= 4")
        pairs = similar.pairs_of(search(able.select("id", "embedding"), df.select("id", "embedding"), 3 * k).where("query_id <> base_id"), able, able)
        want = similar.distinct_pairs(similar.best(similar.scored(pairs), k).where("final >= 0.85")).orderBy(F.desc("final"), "query_id", "place")
        want = want.select(*shown).collect()
        for few in (4096, 2):
            monkeypatch.setattr(vector, "BLOCK_ROWS", few)
            assert similar.similar_pairs(live, df, top_k=k).select(*shown).collect() == want and want
    assert max(asked) <= 3 * 2 * 2 * 2 * 2 < able.count()


def test_candidate_counts_equal_all_pairs(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["p", "q", None]), rnd.randrange(0, 12), ["x"] * rnd.randrange(4)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, language string, loc int, parameters array<string>")
    passes = lambda a, b: a[1] == b[1] is not None and abs(len(a[3]) - len(b[3])) <= 1 and (0 in (a[2], b[2]) or min(a[2], b[2]) / max(a[2], b[2]) >= 0.7)
    got = {r["id"]: r["n"] for r in similar.candidate_counts(df, similar.passes).collect()}
    assert got == {a[0]: sum(passes(a, b) for b in rows if b[0] != a[0]) for a in rows}


def test_index_appends_deletes_and_compacts(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "ix"))
    assert ix.methods().count() == 0 and ix.stats().head().asDict() == {"total_methods": 0, "total_files": 0, "vectors": 0}
    rows = spark.createDataFrame([method(0, f"{'ab'[i % 2]}.py", f"f{i}", "x", 5, "c") for i in range(10)], SCHEMA).drop("id")
    assert ix.add_methods(rows) == 10 and ix.add_methods(rows.limit(0)) == 0
    assert sorted(r["id"] for r in ix.methods().collect()) == list(range(1, 11))
    assert [r["file_path"] for r in ix.methods().orderBy("id").collect()] == ["a.py"] * 5 + ["b.py"] * 5
    chunk = spark.createDataFrame([(f, 0, 0, 2, [0, 1, 2], "n", "a.py", [], [], t, [1.0, 0.0]) for f, t in ((1, "t"), (1, ""), (7, "t"))],
        "function_id long, chunk_index int, statement_start int, statement_end int, statement_indices array<int>, function_name string, file_path string, depends_on_chunks array<int>, depended_on_by_chunks array<int>, normalized_code string, embedding array<float>")
    assert ix.add_chunks(chunk) == 3
    assert Counter(len(r["code_hash"]) for r in ix.chunks().collect()) == {64: 2, 0: 1}
    assert ix.delete_method(3) and not ix.delete_method(3) and not ix.delete_method(99)
    assert ix.by_function(1).count() == 2 and ix.delete_chunk(1) and not ix.delete_chunk(1)
    assert ix.delete_files(spark.createDataFrame([("a.py",)], "file_path string")) == 4
    assert ix.methods().count() == 5 and ix.chunks().count() == 1 and ix.vectors().count() == 10
    assert ix.vector(3).count() == 1 and ix.method(3).count() == 0
    again = Index(spark, str(tmp_path / "ix"))
    assert again.add_methods(rows.limit(1)) == 1 and again.methods().agg(F.max("id")).head()[0] == 11
    again.compact()
    assert again.vectors().count() == 6 == again.methods().count() and again.method(11).count() == 1
    assert again.add_methods(rows.limit(1)) == 1 and again.methods().agg(F.max("id")).head()[0] == 12


def test_older_segments_get_defaults(spark, tmp_path):
    old = spark.createDataFrame([(1, 2, 0, "f")], "id long, function_id long, chunk_index int, function_name string")
    old.write.parquet(str(tmp_path / "ix/chunks/segment-0"))
    row = Index(spark, str(tmp_path / "ix")).chunk(1).head()
    assert row["depends_on_chunks"] == [] and row["normalized_code"] is None and row["function_id"] == 2


ONE_CHUNK = (
    "function_id long, chunk_index int, statement_start int, statement_end int, statement_indices array<int>, function_name string, file_path string, "
    "depends_on_chunks array<int>, depended_on_by_chunks array<int>, normalized_code string, embedding array<float>"
)


def test_ids_are_never_used_again(spark, tmp_path):
    """A chunk of a deleted method does not become that of a new one, compacted or not."""
    ix = Index(spark, str(tmp_path / "ix"))
    one = lambda name: spark.createDataFrame([method(0, f"{name}.py", name, "x", 5, "c")], SCHEMA).drop("id")
    for name in "abc":
        ix.add_methods(one(name))
    ix.add_chunks(spark.createDataFrame([(3, 0, 0, 2, [0, 1, 2], "c", "c.py", [], [], "t", [1.0, 0.0])], ONE_CHUNK))
    assert ix.delete_method(3)
    ix.compact()
    ix.add_methods(one("new"))
    assert {r["id"]: r["name"] for r in ix.methods().collect()} == {1: "a", 2: "b", 4: "new"} and ix.by_function(4).count() == 0
    assert ix.delete_method(4) and ix.delete_method(2) and ix.delete_method(1)
    ix.compact()
    ix.vacuum()
    assert ix.methods().count() == 0 == ix.vectors().count()
    again = Index(spark, str(tmp_path / "ix"))
    assert again.add_methods(one("last")) == 1 and again.methods().head()["id"] == 5
    assert again.add_chunks(spark.createDataFrame([(5, 0, 0, 2, [0], "c", "c.py", [], [], "t", [1.0, 0.0])], ONE_CHUNK)) == 1 and again.by_function(5).head()["id"] == 2


def test_readers_and_writers_beside_a_compaction(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "ix"))
    rows = spark.createDataFrame([method(0, "a.py", f"f{i}", "x", 5, "c") for i in range(6)], SCHEMA).drop("id")
    ix.add_methods(rows)
    ix.delete_method(2)
    before = ix.methods()  # planned before, run after
    other, late = Index(spark, str(tmp_path / "ix")), ix._state()
    ix.compact()
    assert sorted(r["id"] for r in before.collect()) == [1, 3, 4, 5, 6] == sorted(r["id"] for r in other.methods().collect())
    with pytest.raises(RuntimeError, match="another writer"):  # what was derived from an older state
        ix._add("methods", rows.withColumn("id", F.lit(1)), *late)
    assert other.methods().count() == 5 and other.add_methods(rows.limit(1)) == 1 and ix.methods().count() == 6
    ix.vacuum()
    assert sorted(r["id"] for r in other.methods().collect()) == [1, 3, 4, 5, 6, 7]


@pytest.mark.parametrize("block", [4096, 1])
def test_top_k_defines_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vector, "BLOCK_ROWS", block)
    rows = [(i, [float(i), 1.0]) for i in range(9)] + [(20, [None, 1.0]), (21, [float("nan"), 1.0]), (22, [float("inf"), 1.0]), (23, None), (None, [9.0, 9.0])]
    base = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = {(r["query_id"], r["base_id"]) for r in vector.top_k(base, base, 2).collect()}
    assert got == {(q, b) for q in range(1, 9) for b in (8, 7)} | {(0, 0), (0, 1)}
    assert vector.top_k(base, base, 0).count() == 0 and vector.top_k(base, base.limit(0), 3).count() == 0
    mixed = base.union(spark.createDataFrame([(30, [1.0, 2.0, 3.0])], base.schema))
    with pytest.raises(Exception, match="vectors of unlike length"):
        vector.top_k(mixed, mixed, 2).collect()


def test_many_queries_are_one_plan(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK_ROWS", 10)
    rng = np.random.default_rng(8)
    base = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(2000)], "id long, embedding array<double>").repartition(3)
    found = vector.top_k(base, base, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 2 and "BroadcastExchange" not in plan and "Cartesian" not in plan
    x = {r["id"]: np.array(r["embedding"]) for r in base.collect()}
    got = {(r["query_id"], r["rank"]): r["base_id"] for r in found.collect()}
    m = np.array([x[i] for i in range(2000)])
    order = np.argsort(-(m @ m.T), axis=1)[:, :3]
    assert got == {(i, k + 1): order[i, k] for i in range(2000) for k in range(3)}
