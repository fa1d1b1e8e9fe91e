import json

import pytest
from pyspark.sql import functions as F

from plumbline.plans import config, report
from plumbline.plans.operations import Engine, as_json
from plumbline.sources import repository
from plumbline.streaming.watch import watch

ADD = "def add(a, b):\n    total = a + b\n    print(total)\n    return total\n"
PLUS = "def plus(x, y):\n    s = x + y\n    print(s)\n    return s\n"


def large(name, n=40, call="step"):
    return f"def {name}(z):\n" + "".join(f"    v{i} = {call}{i}(v{i - 1})\n" if i % 7 else f"    v{i} = {call}{i}(z)\n" for i in range(n)) + "    return v3\n"


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    (root / "sub" / "node_modules").mkdir(parents=True)
    (root / "a.py").write_text(ADD + "\n\n" + "def stub(): ...\n")
    (root / "sub" / "_b.py").write_text(PLUS + "\n\n" + large("big"))
    (root / "sub" / "bad.py").write_text("def broken(:\n")
    (root / "sub" / "node_modules" / "c.py").write_text(ADD)
    (root / "notes.txt").write_text(ADD)
    return root


@pytest.fixture
def engine(spark):
    return Engine(spark)


def test_index_then_report(spark, engine, repo, tmp_path):
    ix = str(tmp_path / "ix")
    assert engine.analyze_project(ix).count() == 0
    assert engine.index_repository(str(repo), ix).head()[:2] == (3, 3)
    assert engine.index_repository(str(repo), ix).head()[:2] == (1, 0)  # a file without methods is read again
    row = engine.analyze_project(ix).head()
    assert {row["method_a"], row["method_b"]} == {"add", "plus"} and row["exact_match"] and row["score"] == 1.0 and row["differences"] == []
    assert engine.index_repository(str(repo), ix, force=True).head()[:2] == (3, 3)
    stats = engine.index(ix).stats().head()
    assert (stats["total_methods"], stats["total_files"], stats["vectors"]) == (3, 2, 6)
    with pytest.raises(NotADirectoryError):
        engine.index_repository(str(repo / "a.py"), ix)


def test_snippets(engine, repo, tmp_path):
    ix = str(tmp_path / "ix")
    engine.index_repository(str(repo), ix)
    rows = engine.analyze_new_code(ADD.replace("total", "t") + "\ndef far(a, b, c, d, e):\n    return a\n", folder=ix).collect()
    assert [r["method"] for r in rows if r["new_method"] == "add"] == ["add", "plus"]
    assert [r["place"] for r in rows if r["new_method"] == "far"] == [None]
    assert engine.analyze_new_code("x = 1", folder=ix).count() == 0
    assert json.loads(as_json(lambda: engine.analyze_new_code("x", "cobol", folder=ix))) == {"error": "Unsupported language: cobol"}


def test_chunks_from_end_to_end(engine, repo, tmp_path):
    ix = str(tmp_path / "ix")
    (repo / "d.py").write_text(large("big") + "\n" + large("other", call="run") + "\n" + large("small", 28))
    engine.index_repository(str(repo), ix)
    assert [r["statement_count"] for r in engine.find_large_functions(ix).collect()] == [42, 42, 42]
    assert engine.find_large_functions(ix, 42).count() == 0
    with pytest.raises(LookupError, match="No chunks indexed"):
        engine.analyze_chunks(code="x = 1", folder=ix)
    done = engine.chunk_repository(str(repo), ix).head()
    assert done["functions_chunked"] == 3 and done["chunks_created"] == engine.index(ix).chunks().count() and done["skipped_files"] == []
    assert engine.chunk_repository(str(repo), ix).head()["functions_chunked"] == 0
    again = engine.chunk_repository(str(repo), ix, force=True).head()
    assert again["chunks_created"] == done["chunks_created"] == engine.index(ix).chunks().count()
    assert engine.chunk_repository(str(repo), ix, most=0, force=True).head()["skipped_files"] == sorted([str(repo / "d.py"), str(repo / "sub" / "_b.py")])
    maps = engine.get_chunk_map(file_path=str(repo / "d.py"), folder=ix).collect()
    assert [m["function_name"] for m in maps] == ["big", "other"] and all(m["dag_valid"] for m in maps)
    for m in maps:
        ranges = [c["statement_range"] for c in m["chunks"]]
        assert [i for a, b in ranges for i in range(a, b + 1)] == list(range(41)) and all(c["normalized_code"].startswith("def FUNC_NAME():") for c in m["chunks"])
        assert all(d < c["chunk_index"] for c in m["chunks"] for d in c["dependencies"])
    ids = engine.index(ix)
    old = ids.by_file(str(repo / "d.py"), "chunks").withColumn("normalized_code", F.lit(None).cast("string")).drop("id", "code_hash", "dependency_links", "created_at").collect()
    kept = [m["chunks"] for m in maps]
    ids.delete_chunks_of(ids.by_file(str(repo / "d.py")))
    ids.add_chunks(engine.spark.createDataFrame(old, ids.chunks().drop("id", "code_hash", "dependency_links", "created_at").schema))
    maps = engine.get_chunk_map(file_path=str(repo / "d.py"), folder=ix).collect()
    assert [[c["normalized_code"] for c in m["chunks"]] for m in maps] == [[c["normalized_code"] for c in k] for k in kept]
    first = maps[0]["chunks"][0]["chunk_id"]
    assert engine.analyze_chunks(chunk_id=first, top_k=2, folder=ix).count() < 2  # vectors of replaced chunks still take places
    engine.index(ix).compact()
    near = engine.analyze_chunks(chunk_id=first, top_k=2, folder=ix).collect()
    assert len(near) == 2 and near[0]["similarity_score"] == 1.0 and near[0]["refactoring_hint"].startswith("Exact") and first not in [r["chunk_id"] for r in near]
    assert engine.analyze_chunks(code="v1 = step1(v0)\nv2 = step2(v1)", folder=ix).count() == 3
    small = engine.index(ix).methods().where("name = 'add'").head()["id"]
    row = engine.get_chunk_map(function_id=small, folder=ix).head()
    assert row["chunks"] == [] and row["dag_valid"] and row["hint"]
    assert engine.get_chunk_map(file_path="none.py", folder=ix).count() == 0
    for call, error in [(lambda: engine.get_chunk_map(folder=ix), "Provide either function_id or file_path"), (lambda: engine.get_chunk_map(1, "x", ix), "Provide either function_id or file_path, not both"),
                        (lambda: engine.get_chunk_map(99, folder=ix), "Function 99 not found in index"), (lambda: engine.analyze_chunks("x", 1, folder=ix), "Provide either code_snippet or chunk_id, not both"),
                        (lambda: engine.analyze_chunks(chunk_id=999, folder=ix), "Chunk id 999 not found"), (lambda: engine.chunk_repository(str(repo / "a.py"), ix), f"Not a directory: {repo / 'a.py'}")]:
        assert json.loads(as_json(call)) == {"error": error}


def test_a_chunk_is_compared_without_moving_all_chunks(spark, engine, repo, tmp_path):
    ix = str(tmp_path / "ix")
    (repo / "d.py").write_text(large("other", call="run"))
    engine.index_repository(str(repo), ix)
    engine.chunk_repository(str(repo), ix)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = engine.analyze_chunks(chunk_id=1, folder=ix)
        assert near.count() and "SortMergeJoin" not in near._jdf.queryExecution().executedPlan().toString()  # the few that were found are sent to the chunks
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_excluded_folders(spark, tmp_path):
    for name in (*repository.EXCLUDED, "kept"):
        (tmp_path / "r" / name).mkdir(parents=True)
        (tmp_path / "r" / name / "m.py").write_text(ADD)
    assert [r["file_path"] for r in repository.paths(spark, str(tmp_path / "r")).collect()] == [str(tmp_path / "r" / "kept" / "m.py")]
    assert repository.paths(spark, str(tmp_path / "r" / "build")).count() == 0


def test_stream_and_command_line(engine, repo, tmp_path, capsys):
    ix = str(tmp_path / "ix")
    for _ in range(2):
        watch(engine, str(repo), ix, str(tmp_path / "cp")).awaitTermination(120)
    assert [r["name"] for r in engine.index(ix).methods().collect()] == ["add"]  # hidden names are for batch runs
    (repo / "a.py").unlink()
    (repo / "e.py").write_text(PLUS)
    watch(engine, str(repo), ix, str(tmp_path / "cp")).awaitTermination(120)
    assert {r["name"] for r in engine.index(ix).methods().collect()} == {"add", "plus"}
    assert report.main([str(repo), "--index-dir", str(tmp_path / "ix2"), "--threshold", "0.9"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["index"]["methods_indexed"] == 3 and said["analysis"]["total_methods"] == 3
    assert report.main([str(repo / "none")]) == 1


def test_settings_entry(tmp_path, capsys):
    path = tmp_path / "s.json"
    assert config.main([str(path), "servers", "plumbline", '{"command": "x"}']) == 0
    path.write_text(json.dumps({"é": 1, "servers": {"other": {"a": 1}}}))
    config.upsert(path, "servers", "plumbline", {"command": "y"})
    assert json.loads(path.read_text()) == {"é": 1, "servers": {"other": {"a": 1}, "plumbline": {"command": "y"}}}
    for bad in ("{", "[]", '{"servers": 3}'):
        path.write_text(bad)
        assert config.main([str(path), "servers", "plumbline", "{}"]) == 1 and path.read_text() == bad
    assert capsys.readouterr().err.count("error:") == 3 and [p.name for p in tmp_path.iterdir()] == ["s.json"]
