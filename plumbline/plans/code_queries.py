"""Queries that run the engine itself: documents stand for source files, and SQL says which rows must
come out.

What a file holds depends on its document's id alone, so that SQL can tell which functions are equal:
the code itself is parsed, normalized, encoded, indexed, searched and scored as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.store import Index
from plumbline.plans.operations import LARGE, Engine
from plumbline.plans.queries import query
from plumbline.session import shared_path
from plumbline.sources import repository, tables

# A function with all forms of statements, and what must be said of each: index,
# parent, kind, first and last line, names written, names read.
FORMS = """def f(a, b: int = 2, *args, k=1, **kw) -> int:
    import os.path as p, sys
    from json import dumps as d, loads
    x = a.first
    y: int = g(b, key=k)
    x += y
    m, (n, *o) = x, y
    a.attr = x
    a[0] = y
    (z := x)
    if x > y:
        q = (r := x)
    elif y:
        q = k
    else:
        pass
    for i, j in a:
        print(i)
        continue
    else:
        j = 1
    while x:
        x -= 1
        break
    with open(a) as fh, b:
        fh.read()
    try:
        assert x, y
    except ValueError as e:
        raise e
    finally:
        del x
    match a:
        case [h, *t]:
            return h
    def inner(v):
        return v
    @deco(x)
    class C:
        pass
    global top
    return sum(args)
"""
EXPECTED = [
    (0, None, "import_statement", 2, 2, "p sys", ""),
    (1, None, "import_from_statement", 3, 3, "d loads", ""),
    (2, None, "expression_statement", 4, 4, "x", "a first"),
    (3, None, "expression_statement", 5, 5, "y", "b g k key"),
    (4, None, "expression_statement", 6, 6, "x", "x y"),
    (5, None, "expression_statement", 7, 7, "m n o", "x y"),
    (6, None, "expression_statement", 8, 8, "", "x"),
    (7, None, "expression_statement", 9, 9, "", "y"),
    (8, None, "expression_statement", 10, 10, "z", "x"),
    (9, None, "if_statement", 11, 16, "", "x y"),
    (10, 9, "expression_statement", 12, 12, "q", "r x"),
    (11, 9, "expression_statement", 14, 14, "q", "k"),
    (12, 9, "pass_statement", 16, 16, "", ""),
    (13, None, "for_statement", 17, 21, "i j", "a"),
    (14, 13, "expression_statement", 18, 18, "", "i print"),
    (15, 13, "continue_statement", 19, 19, "", ""),
    (16, 13, "expression_statement", 21, 21, "j", ""),
    (17, None, "while_statement", 22, 24, "", "x"),
    (18, 17, "expression_statement", 23, 23, "x", "x"),
    (19, 17, "break_statement", 24, 24, "", ""),
    (20, None, "with_statement", 25, 26, "fh", "a b open"),
    (21, 20, "expression_statement", 26, 26, "", "fh read"),
    (22, None, "try_statement", 27, 32, "", ""),
    (23, 22, "assert_statement", 28, 28, "", "x y"),
    (24, 22, "raise_statement", 30, 30, "", "e"),
    (25, 22, "delete_statement", 32, 32, "", "x"),
    (26, None, "match_statement", 33, 35, "", "a h t"),
    (27, 26, "return_statement", 35, 35, "", "h"),
    (28, None, "function_definition", 36, 37, "inner", ""),
    (29, None, "decorated_definition", 38, 40, "C", "deco x"),
    (30, None, "global_statement", 41, 41, "", ""),
    (31, None, "return_statement", 42, 42, "", "args sum"),
]
#: Lines of functions of different sizes: none has 0.7 of the next one's.
SIZES = (4, 6, 9, 14, 21, 31)
#: Their lines, in turn; the names marked with @ differ from file to file.
LINES = (
    "t@ = a@ + b@", "u@: int = len(t@)", "t@ += 1  # more", "if t@ > u@: t@ = b@", "for i in a@: print(i, 'x')", "while t@: t@ -= 1.5", "with open(a@) as fh: fh.read()",
    "assert t@, \"no t\"", "x, y = a@, b@", "(w := u@)", "del x",
)


def _code(name: str, size: int) -> str:
    body = [LINES[i % len(LINES)] for i in range(size - 2)]
    return "\n".join([f"def {name}(a@, b@):", *(f"    {line}" for line in body), "    return t@", ""])


def _files(spark: SparkSession, sf: str, code: Column) -> DataFrame:
    return tables.table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("file_path"), code.alias("code"))


def _indexed(spark: SparkSession, files: DataFrame) -> tuple[Engine, Index]:
    """An index of the functions of a table of files (file_path, code)."""
    engine = Engine(spark)
    index = engine.index(shared_path(spark, "index"))
    index.add_methods(engine._prepared(repository.functions_in_texts(files, "file_path", "code")))
    return engine, index


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    """A file a document, with a function of one of the sizes."""
    of_size = F.element_at(F.array(*(F.lit(_code("f@", n)) for n in SIZES)), (F.col("doc_id") % len(SIZES) + 1).cast("int"))
    return _files(spark, sf, F.replace(of_size, F.lit("@"), F.col("doc_id").cast("string")))


_SIZED = f"""sized AS (SELECT doc_id, doc_id::VARCHAR AS file, doc_id % {len(SIZES)} AS g, row_number() OVER (ORDER BY doc_id::VARCHAR) AS id FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id) AS k FROM sized)"""


@query(f"""WITH {_SIZED},
near AS (SELECT q.id AS q, c.id AS c, row_number() OVER (PARTITION BY q.id ORDER BY c.id) AS place FROM placed q JOIN placed c ON c.g = q.g AND c.k <= 15 AND c.id <> q.id),
kept AS (SELECT *, row_number() OVER (PARTITION BY least(q, c), greatest(q, c) ORDER BY q) AS n FROM near WHERE place <= 5)
SELECT a.file AS file_a, 'f' || a.doc_id AS method_a, 1 AS line_a, b.file AS file_b, 'f' || b.doc_id AS method_b, 1 AS line_b, 1.0::DOUBLE AS score, true AS exact_match,
  1.0::DOUBLE AS embedding_similarity, 1.0::DOUBLE AS ast_similarity, '' AS differences
FROM kept JOIN placed a ON a.id = q JOIN placed b ON b.id = c WHERE n = 1""")
def engine_project_report(spark: SparkSession, sf: str) -> DataFrame:
    """Index all files, then find all similar pairs at the engine's own threshold: functions that differ
    in names, comments, strings and numbers' places only are equal, those of other sizes never pass."""
    engine, index = _indexed(spark, _sized(spark, sf))
    found = engine.analyze_project(index.folder)
    return found.select("file_a", "method_a", "line_a", "file_b", "method_b", "line_b", "score", "exact_match", "embedding_similarity", "ast_similarity", F.array_join("differences", "; ").alias("differences"))


@query(f"""WITH {_SIZED} SELECT 'mine' AS new_method, k AS place, file, 'f' || doc_id AS method, 1 AS line, 1.0::DOUBLE AS score, true AS exact_match FROM placed WHERE g = 2 AND k <= 3
UNION ALL SELECT 'other', NULL, NULL, NULL, NULL, NULL, NULL""")
def engine_snippet(spark: SparkSession, sf: str) -> DataFrame:
    """The indexed functions most similar to those of a snippet, one of which has none."""
    engine, index = _indexed(spark, _sized(spark, sf))
    snippet = _code("mine", SIZES[2]).replace("@", "_own") + "\n\ndef other(a, b, c, d, e, *f):\n    return a\n"
    found = engine.analyze_new_code(snippet, folder=index.folder)
    return found.select("new_method", F.col("place").cast("bigint").alias("place"), "file", "method", "line", "score", "exact_match")


@query("""WITH gone AS (SELECT doc_id::VARCHAR AS file, row_number() OVER (ORDER BY doc_id::VARCHAR) AS k FROM documents WHERE doc_id % 3 = 0),
old AS (SELECT doc_id, doc_id::VARCHAR AS file, row_number() OVER (ORDER BY doc_id::VARCHAR) AS id FROM documents)
SELECT id, file, 'f' AS name, 1 AS start_line FROM old WHERE doc_id % 3 <> 0
UNION ALL SELECT (SELECT count(*) FROM documents) + k, file, 'again', 2 FROM gone""")
def engine_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Files are indexed, a third of them deleted, the index compacted, and these files indexed anew:
    their methods have new ids, greater than all before."""
    engine, index = _indexed(spark, _files(spark, sf, F.lit("def f(x):\n    return x\n")))
    third = _files(spark, sf, F.lit("# new\ndef again(x):\n    return 1\n")).where("doc_id % 3 = 0")
    index.delete_files(third)
    index.compact()
    index.add_methods(engine._prepared(repository.functions_in_texts(third, "file_path", "code")))
    return index.methods().select("id", F.col("file_path").alias("file"), "name", "start_line")


def _large(spark: SparkSession, sf: str) -> DataFrame:
    """A file a document, with a function of 32 to 40 statements, each of which reads the one before."""
    lines = F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 9 + 31).cast("int")), lambda i: F.concat(F.lit("    v"), i.cast("string"), F.lit(" = step(v"), (i - 1).cast("string"), F.lit(")\n")))
    return _files(spark, sf, F.concat(F.lit("def big"), F.col("doc_id").cast("string"), F.lit("(z):\n    v0 = step(z)\n"), F.array_join(lines, "")))


def _chunked(spark: SparkSession, sf: str) -> tuple[Engine, Index]:
    engine, index = _indexed(spark, _large(spark, sf))
    index.add_chunks(engine.chunks_of(index.methods(), over=LARGE))
    return engine, index


_CHUNKED = """f AS (SELECT doc_id, doc_id::VARCHAR AS file, 'big' || doc_id AS name, 32 + doc_id % 9 AS n, row_number() OVER (ORDER BY doc_id::VARCHAR) AS id FROM documents)"""


@query(f"WITH {_CHUNKED} SELECT id, name, file, 1 AS start_line, 1 + n AS end_line, 1 + n AS statement_count FROM f WHERE 1 + n > 35")
def engine_large_functions(spark: SparkSession, sf: str) -> DataFrame:
    engine, index = _indexed(spark, _large(spark, sf))
    return engine.find_large_functions(index.folder, 35).withColumn("statement_count", F.col("statement_count").cast("bigint")).withColumn("end_line", F.col("end_line").cast("bigint"))


@query(f"""WITH {_CHUNKED} SELECT 2 * id - 1 + c AS chunk_id, id AS function_id, name, file, c AS chunk_index, 20 * c AS statement_start, CASE c WHEN 0 THEN 19 ELSE n - 1 END AS statement_end,
  CASE c WHEN 0 THEN '' ELSE '0' END AS depends_on, CASE c WHEN 0 THEN '1' ELSE '' END AS depended_on_by FROM f, (SELECT unnest([0, 1]) AS c)""")
def engine_chunk_index(spark: SparkSession, sf: str) -> DataFrame:
    """Large functions are cut into chunks of at most 20 statements, which are indexed with their links."""
    chunks = _chunked(spark, sf)[1].chunks()
    return chunks.select(
        F.col("id").alias("chunk_id"), "function_id", F.col("function_name").alias("name"), F.col("file_path").alias("file"), F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("statement_start").cast("bigint").alias("statement_start"), F.col("statement_end").cast("bigint").alias("statement_end"),
        F.array_join("depends_on_chunks", ",").alias("depends_on"), F.array_join("depended_on_by_chunks", ",").alias("depended_on_by"),
    )


@query(f"WITH {_CHUNKED} SELECT 2 * id - 1 AS chunk_id, name AS function_name, file, 1.0::DOUBLE AS similarity_score, '0-19' AS statement_range, 'Exact duplicate chunk. Consider extracting to a shared helper function.' AS refactoring_hint FROM f WHERE id BETWEEN 2 AND 4")
def engine_similar_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks most similar to the first one: the first chunks of the next functions, which equal it."""
    engine, index = _chunked(spark, sf)
    return engine.analyze_chunks(chunk_id=1, folder=index.folder).withColumn("statement_range", F.array_join("statement_range", "-"))


def _cell(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


_FORM_ROWS = ", ".join(f"({', '.join(map(_cell, row))})" for row in EXPECTED)


@query(f"""SELECT doc_id, index, parent, kind, first + doc_id % 3 AS start_line, last + doc_id % 3 AS end_line, writes, reads
FROM documents, (VALUES {_FORM_ROWS}) AS v(index, parent, kind, first, last, writes, reads)""")
def parse_statement_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The statements of a function with all forms, below as many comment lines as the file has."""
    code = F.concat(F.repeat(F.lit("# above\n"), (F.col("doc_id") % 3).cast("int")), F.lit(FORMS))
    found = repository.statements(_files(spark, sf, code), "doc_id", "code")
    lines = [F.col(c).cast("bigint").alias(c) for c in ("start_line", "end_line")]
    return found.select("doc_id", "index", "parent", "kind", *lines, F.array_join("writes", " ").alias("writes"), F.array_join("reads", " ").alias("reads"))
