"""One query for each operator, over whole tables, and the same in DuckDB's SQL where SQL can say it.

Where an operator works on code, documents stand for functions (:mod:`plumbline.sources.tables`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import normalize, score
from plumbline.functions.udfs import encoder, sequence_ratio
from plumbline.operators import graph, similar, vector
from plumbline.sources import repository, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NEIGHBOURS = 15
CHUNK = 5


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _units(spark: SparkSession, sf: str) -> DataFrame:
    return tables.units(tables.table(spark, sf, "documents"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).where("id % 100 = 0")


# --- scans, sinks and counts


@query(f"WITH {tables.UNITS_SQL} SELECT id, language, file_path, loc, array_to_string(parameters, ' ') AS parameters, return_type, array_to_string(dependencies, ' ') AS dependencies FROM units")
def scan_units(spark: SparkSession, sf: str) -> DataFrame:
    return _units(spark, sf).select("id", "language", "file_path", "loc", F.array_join("parameters", " ").alias("parameters"), "return_type", F.array_join("dependencies", " ").alias("dependencies"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def incremental_skip(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents").select("doc_id", "source").join(tables.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0')")
def delete_by_file_cascade(spark: SparkSession, sf: str) -> DataFrame:
    gone = tables.table(spark, sf, "documents").where("source = 'src0'").select("doc_id")
    return tables.table(spark, sf, "labels").join(gone, "doc_id", "left_anti").select("doc_id", "quality", "toxic")


@query("""SELECT doc_id, source, sha256(text) AS hash FROM documents WHERE source <> 'src1'
UNION ALL SELECT doc_id, source, sha256(text || '!') FROM documents WHERE source = 'src1'""")
def upsert_file(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.table(spark, sf, "documents").select("doc_id", "source", "text")
    new = docs.where("source = 'src1'").withColumn("text", F.concat("text", F.lit("!")))
    kept = docs.join(F.broadcast(new.select("source").distinct()), "source", "left_anti")  # one file's name
    return kept.unionByName(new).select("doc_id", "source", F.sha2("text", 256).alias("hash"))


@query("""SELECT (SELECT count(*) FROM documents) AS total_methods, (SELECT count(DISTINCT source) FROM documents) AS total_files,
  (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM labels) AS total_chunks""")
def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    one = tables.table(spark, sf, "documents").agg(F.count("*").alias("total_methods"), F.countDistinct("source").alias("total_files"))
    rows = one.crossJoin(tables.table(spark, sf, "embeddings").agg(F.count("*").alias("vectors")))  # one row each
    return rows.crossJoin(tables.table(spark, sf, "labels").agg(F.count("*").alias("total_chunks")))


@query("SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs, count(*) AS n FROM documents GROUP BY source")
def sorted_distinct_sets(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.count("*").alias("n"))


@query("""SELECT to_json({'id': doc_id, 'file': source, 'language': lang}) AS json FROM documents""")
def json_facade(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.table(spark, sf, "documents")
    return docs.select(F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("source").alias("file"), F.col("lang").alias("language"))).alias("json"))


# --- normalization

# What the engine's dialect has as word characters and white space, in the words of the other one.
_W = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}"
_S = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STRINGS = r"""regexp_replace(regexp_replace(regexp_replace({}, '#[^\n]*', '', 'g'), '"(?:[^"\\]|\\[^\n])*"', 'STR_LITERAL', 'g'), '''(?:[^''\\]|\\[^\n])*''', 'STR_LITERAL', 'g')"""


def _normal_sql(text: str) -> str:
    numbers = _STRINGS.replace("{}", text, 1)
    marked = f"regexp_replace({numbers}, '([{_W}]+)', chr(1) || '\\1' || chr(2), 'g')"
    digits = r"\x01\p{Nd}+\x02"
    placed = f"regexp_replace(regexp_replace({marked}, '{digits}\\.{digits}', 'NUM_LITERAL', 'g'), '{digits}', 'NUM_LITERAL', 'g')"
    out = f"replace(replace({placed}, chr(1), ''), chr(2), '')"
    for pattern, to in ((r"\r\n?", "chr(10)"), (r"[ \t]+", "' '"), (rf"\n[{_S}]*\n+", "chr(10)"), (rf"^[{_S}]+|[{_S}]+$", "''")):
        out = f"regexp_replace({out}, '{pattern}', {to}, 'g')"
    return out


_NORMAL = f"normal AS (SELECT doc_id, {_normal_sql("coalesce(text, '')")} AS t FROM documents)"


def _code_of(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("code"))


def _plain_normal(code: Column) -> Column:
    return normalize.collapse_space(normalize.replace_numbers(normalize.replace_strings(normalize.strip_comments(code))))


@query(f"WITH {_NORMAL} SELECT doc_id, length(t) AS n, sha256(t) AS hash FROM normal")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    form = _code_of(spark, sf).select("doc_id", _plain_normal(F.col("code")).alias("t"))
    return form.select("doc_id", F.length("t").cast("bigint").alias("n"), F.sha2("t", 256).alias("hash"))


@query(f"WITH {_NORMAL} SELECT min(doc_id) AS first_id, count(*) AS copies, hash FROM (SELECT doc_id, sha256(t) AS hash FROM normal) GROUP BY hash HAVING count(*) > 1")
def exact_duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_text(spark, sf).groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


_NAMES = r"list_sort(list_distinct(list_filter(string_split(code, ' '), lambda w: regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]*') AND NOT regexp_full_match(w, 'v[0-9]+'))))"


@query(f"""WITH n AS (SELECT doc_id, code, {_NAMES} AS names FROM (SELECT doc_id, coalesce(text, '') AS code FROM documents))
SELECT doc_id, sha256(array_to_string(list_transform(regexp_extract_all(code, '[{_W}]+|[^{_W}]+'), lambda w: CASE WHEN list_contains(names, w) THEN 'v' || list_position(names, w) ELSE w END), '')) AS hash FROM n""")
def rename_fold(spark: SparkSession, sf: str) -> DataFrame:
    names = F.filter(F.split("code", " "), lambda w: w.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z") & ~w.rlike(r"^v[0-9]+\z"))
    return _code_of(spark, sf).select("doc_id", F.sha2(normalize.rename_all(F.col("code"), F.array_sort(F.array_distinct(names))), 256).alias("hash"))


@query()
def full_normalization(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as the body of a function whose parameters are its words."""
    names = F.array_distinct(F.filter(F.split("code", r"[^A-Za-z]+"), lambda w: w != ""))
    code = F.concat(F.lit("def f("), F.array_join(names, ", "), F.lit("):\n    "), F.replace("code", F.lit("\n"), F.lit("\n    ")))
    return _code_of(spark, sf).select("doc_id", normalize.code_hash(normalize.normalize(code)).alias("code_hash"))


# --- filters and candidate counts


@query(f"""WITH {tables.UNITS_SQL}, s AS (SELECT id, language, loc, len(parameters) AS p FROM units)
SELECT q.id, (SELECT count(*) FROM s c WHERE c.language = q.language AND c.id <> q.id AND abs(c.p - q.p) <= 1
  AND c.loc BETWEEN CAST(floor(q.loc * 0.7::DOUBLE) AS BIGINT) AND CAST(floor(q.loc / 0.7::DOUBLE) AS BIGINT) + 1) AS n FROM s q""")
def prefilter_counts(spark: SparkSession, sf: str) -> DataFrame:
    return similar.candidate_counts(_units(spark, sf), similar.criteria)


@query(f"""WITH {tables.UNITS_SQL}, s AS (SELECT id, language, loc, len(parameters) AS p FROM units)
SELECT q.id, (SELECT count(*) FROM s c WHERE c.language = q.language AND c.id <> q.id AND abs(c.p - q.p) <= 1
  AND (c.loc = 0 OR q.loc = 0 OR least(c.loc, q.loc)::DOUBLE / greatest(c.loc, q.loc) >= 0.7::DOUBLE)) AS n FROM s q""")
def passes_counts(spark: SparkSession, sf: str) -> DataFrame:
    return similar.candidate_counts(_units(spark, sf), similar.passes)


@query(f"WITH {tables.UNITS_SQL} SELECT id, file_path, loc FROM units WHERE loc >= 4")
def min_lines_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _units(spark, sf).where("loc >= 4").select("id", "file_path", "loc")


@query(f"WITH {tables.UNITS_SQL} SELECT id, file_path, loc FROM units WHERE NOT regexp_full_match(body, '\\s*(pass|\\.\\.\\.|\\S*)\\s*')")
def stub_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _units(spark, sf).where(~F.col("body").rlike(r"^\s*(pass|\.\.\.|\S*)\s*\z")).select("id", "file_path", "loc")


@query(f"WITH {tables.UNITS_SQL} SELECT id, loc, row_number() OVER (ORDER BY loc DESC, id) AS place FROM units WHERE loc > 30")
def large_units(spark: SparkSession, sf: str) -> DataFrame:
    large = _units(spark, sf).where("loc > 30").select("id", "loc")
    counts = large.groupBy("loc").agg(F.count("*").alias("n"))
    above = counts.select("loc", (F.sum("n").over(Window.orderBy(F.desc("loc"))) - F.col("n")).alias("above"))  # a row a length
    within = F.row_number().over(Window.partitionBy("loc").orderBy("id"))
    return large.join(above, "loc").select("id", "loc", (F.col("above") + within).alias("place"))


@query("SELECT doc_id, source FROM documents WHERE source = 'src1' OR starts_with(source, 'src1/')")
def path_containment(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents").where((F.col("source") == "src1") | F.col("source").startswith("src1/")).select("doc_id", "source")


# --- vectors

_TOP = """top AS (SELECT q.vec_id AS query_id, b.vec_id AS base_id, list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS raw
  FROM embeddings q, embeddings b WHERE q.vec_id % 100 = 0 {}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, base_id) AS rank FROM top)"""
_SHOW = "SELECT query_id, base_id, rank, round(raw, 4) AS score FROM ranked WHERE rank <= 3"


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", "base_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 4).alias("score"))


@query(f"WITH {_TOP.format('')} {_SHOW}")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(vector.top_k(_asked(spark, sf), _vectors(spark, sf), 3))


@query(f"WITH {_TOP.format('')} {_SHOW} AND base_id IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)")
def vector_topk_postfilter(spark: SparkSession, sf: str) -> DataFrame:
    allowed = tables.table(spark, sf, "embeddings").where("label % 2 = 0").select(F.col("vec_id").alias("id"))
    return _shown(vector.post_filter(vector.top_k(_asked(spark, sf), _vectors(spark, sf), 3), allowed))


@query(f"WITH {_TOP.format('AND b.label % 2 = 0')} {_SHOW}")
def vector_topk_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    allowed = tables.table(spark, sf, "embeddings").where("label % 2 = 0").select(F.col("vec_id").alias("id"))
    return _shown(vector.pre_filter(_asked(spark, sf), _vectors(spark, sf), allowed, 3))


@query(f"WITH {_TOP.format('')} {_SHOW} AND base_id % 7 <> 0 AND base_id <> query_id")
def tombstone_topk(spark: SparkSession, sf: str) -> DataFrame:
    alive = _vectors(spark, sf).where("id % 7 <> 0")
    return _shown(vector.post_filter(vector.top_k(_asked(spark, sf), _vectors(spark, sf), 3), alive).where("query_id <> base_id"))


# --- scores over the nearest neighbours of every vector


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of units that are near in the vector index: q_, c_ and their inner product."""
    vectors = _vectors(spark, sf)
    found = vector.top_k(vectors, vectors, NEIGHBOURS).where("query_id <> base_id")
    plain = _units(spark, sf).withColumn("tokens", F.array_distinct(F.filter(F.split(F.lower("body"), "[^a-z]+"), lambda w: w != ""))).withColumn("code_hash", F.sha2("body", 256)).drop("body")
    near = plain.join(vectors.select("id"), "id", "left_semi")
    return similar.pairs_of(found, near, near).withColumn("score", F.round("score", 6))


_TOKENS = "list_distinct(list_filter(string_split_regex(lower(body), '[^a-z]+'), lambda w: w <> ''))"
_PAIRS = f"""{tables.UNITS_SQL},
u AS (SELECT units.*, {_TOKENS} AS tokens, sha256(body) AS code_hash FROM units WHERE id IN (SELECT vec_id FROM embeddings)),
allv AS (SELECT q.vec_id AS query_id, b.vec_id AS base_id, list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS raw FROM embeddings q, embeddings b),
near AS (SELECT query_id, base_id, round(raw, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, base_id) AS rank FROM allv)
  WHERE rank <= {NEIGHBOURS} AND query_id <> base_id),
pairs AS (SELECT n.*, q.parameters AS qp, c.parameters AS cp, q.return_type AS qr, c.return_type AS cr, q.dependencies AS qd, c.dependencies AS cd,
    q.loc AS ql, c.loc AS cl, q.language AS qlang, c.language AS clang, q.code_hash = c.code_hash AS exact,
    coalesce(len(list_intersect(q.tokens, c.tokens))::DOUBLE / nullif(len(list_distinct(list_concat(q.tokens, c.tokens))), 0), 0) AS ast
  FROM near n JOIN u q ON n.query_id = q.id JOIN u c ON n.base_id = c.id)"""
_STRUCT = """(CASE WHEN len(qp) = len(cp) THEN 1.0 ELSE 0.5 END::DOUBLE + CASE WHEN qr IS NOT DISTINCT FROM cr THEN 1.0 ELSE 0.3 END::DOUBLE
  + CASE WHEN len(qd) + len(cd) > 0 THEN len(list_intersect(qd, cd))::DOUBLE / len(list_distinct(list_concat(qd, cd))) ELSE 0 END)
  / CASE WHEN len(qd) + len(cd) > 0 THEN 3 ELSE 2 END"""
_PASS = "qlang = clang AND abs(len(qp) - len(cp)) <= 1 AND (ql = 0 OR cl = 0 OR least(ql, cl)::DOUBLE / greatest(ql, cl) >= 0.7::DOUBLE)"
_FINAL = "0.5::DOUBLE * CASE WHEN exact THEN 1.0::DOUBLE ELSE score END + 0.3::DOUBLE * CASE WHEN exact THEN 1.0::DOUBLE ELSE ast END + 0.2::DOUBLE * structural"
_SCORED = f"{_PAIRS}, st AS (SELECT *, {_STRUCT} AS structural FROM pairs), scored AS (SELECT *, {_FINAL} AS final FROM st WHERE {_PASS})"


def _structural():
    return score.structural_score(*(F.col(p + x) for x in ("parameters", "return_type", "dependencies") for p in ("q_", "c_")))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _candidates(spark, sf).where(score.same_language(F.col("q_language"), F.col("c_language")) & score.parameters_near(F.size("q_parameters"), F.size("c_parameters")) & score.loc_ratio_holds(F.col("q_loc"), F.col("c_loc")))
    exact = F.col("q_code_hash") == F.col("c_code_hash")
    ast = F.coalesce(score.jaccard(F.col("q_tokens"), F.col("c_tokens")), F.lit(0.0))
    return pairs.withColumns({"exact": exact, "final": score.method_score(exact, F.col("score"), ast, _structural())})


@query(f"WITH {_PAIRS} SELECT query_id, base_id, round({_STRUCT}, 4) AS structural FROM pairs")
def structural_score(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf).select("query_id", "base_id", F.round(_structural(), 4).alias("structural"))


@query(f"WITH {_SCORED} SELECT query_id, base_id, round(final, 4) AS final FROM scored")
def method_score(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("query_id", "base_id", F.round("final", 4).alias("final"))


@query(f"WITH {_SCORED} SELECT query_id, base_id, exact, round(final, 4) AS final FROM scored WHERE final >= 0.4::DOUBLE OR exact")
def score_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).where("final >= 0.4D OR exact").select("query_id", "base_id", "exact", F.round("final", 4).alias("final"))


@query(f"""WITH {_SCORED}, kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 4) DESC, rank) AS place FROM scored WHERE final >= 0.3::DOUBLE OR exact),
pair AS (SELECT *, row_number() OVER (PARTITION BY least(query_id, base_id), greatest(query_id, base_id) ORDER BY query_id, place) AS k FROM kept WHERE place <= 5 AND round(final, 4) >= 0.3::DOUBLE)
SELECT query_id AS method_a, base_id AS method_b, round(final, 4) AS score, exact FROM pair WHERE k = 1""")
def all_pairs_report(spark: SparkSession, sf: str) -> DataFrame:
    found = _scored(spark, sf).where("final >= 0.3D OR exact").withColumn("final", F.round("final", 4))
    kept = similar.distinct_pairs(similar.best(found, 5).where("final >= 0.3D"))
    return kept.select(F.col("query_id").alias("method_a"), F.col("base_id").alias("method_b"), F.col("final").alias("score"), "exact")


_LIST = "'[' || array_to_string(list_transform(list_sort({}), lambda n: '''' || n || ''''), ', ') || ']'"
_REPR = "CASE WHEN {0} IS NULL THEN 'None' ELSE '''' || {0} || '''' END"
_ONLY = "list_filter({0}, lambda x: NOT list_contains({1}, x))"
_DIFFS = f"""list_filter([CASE WHEN len(qp) <> len(cp) THEN 'parameter count differs (' || len(qp) || ' vs ' || len(cp) || ')' END,
  CASE WHEN qr IS DISTINCT FROM cr THEN 'return type differs (' || {_REPR.format('qr')} || ' vs ' || {_REPR.format('cr')} || ')' END,
  CASE WHEN len({_ONLY.format('qd', 'cd')}) > 0 THEN 'query calls not in candidate: ' || {_LIST.format(_ONLY.format('qd', 'cd'))} END,
  CASE WHEN len({_ONLY.format('cd', 'qd')}) > 0 THEN 'candidate calls not in query: ' || {_LIST.format(_ONLY.format('cd', 'qd'))} END], lambda x: x IS NOT NULL)"""


def _differences():
    return score.differences(*(F.col(p + x) for x in ("parameters", "return_type", "dependencies") for p in ("q_", "c_")))


@query(f"WITH {_PAIRS} SELECT query_id, base_id, array_to_string({_DIFFS}, '; ') AS differences FROM pairs")
def differences(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf).select("query_id", "base_id", F.array_join(_differences(), "; ").alias("differences"))


@query(f"""WITH {_PAIRS}, d AS (SELECT query_id, base_id, array_to_string({_DIFFS}, '; ') AS t FROM pairs)
SELECT query_id, base_id, array_to_string(list_filter([{', '.join(f"CASE WHEN contains(t, '{k}') THEN '{h}' END" for k, h in score.HINTS.items())}], lambda x: x IS NOT NULL), '; ') AS hints FROM d""")
def refactoring_hints(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf).select("query_id", "base_id", F.array_join(score.hints(_differences()), "; ").alias("hints"))


# --- statement graphs

_EDGES = f"""{tables.STATEMENTS_SQL},
w AS (SELECT func, index AS src, unnest(writes) AS name FROM statements), r AS (SELECT func, index AS dst, unnest(reads) AS name FROM statements),
edges AS (SELECT DISTINCT func, src, dst FROM w JOIN r USING (func, name) WHERE src < dst)"""
_CHUNKS = f"""{_EDGES},
prov AS (SELECT s.func, s.index, min(e.src) AS provider, count(*) OVER (PARTITION BY s.func) AS n FROM statements s LEFT JOIN edges e ON e.func = s.func AND e.dst = s.index GROUP BY s.func, s.index),
fold AS (SELECT func, index, n, 0::BIGINT AS start FROM prov WHERE index = 0
  UNION ALL SELECT p.func, p.index, p.n, CASE WHEN p.n > {CHUNK} AND (p.provider IS NULL OR p.provider < f.start OR p.index - f.start >= {CHUNK}) THEN p.index ELSE f.start END
  FROM fold f JOIN prov p ON p.func = f.func AND p.index = f.index + 1),
chunks AS (SELECT func, row_number() OVER (PARTITION BY func ORDER BY start) - 1 AS chunk_index, start AS statement_start, max(index) AS statement_end FROM fold GROUP BY func, start)"""
_LINKS = f"""{_CHUNKS},
links AS (SELECT DISTINCT e.func, a.chunk_index AS src, b.chunk_index AS dst FROM edges e
  JOIN chunks a ON a.func = e.func AND e.src BETWEEN a.statement_start AND a.statement_end
  JOIN chunks b ON b.func = e.func AND e.dst BETWEEN b.statement_start AND b.statement_end WHERE a.chunk_index <> b.chunk_index),
noted AS (SELECT c.*, coalesce((SELECT list_sort(list(src)) FROM links l WHERE l.func = c.func AND l.dst = c.chunk_index), []) AS needs,
  coalesce((SELECT list_sort(list(dst)) FROM links l WHERE l.func = c.func AND l.src = c.chunk_index), []) AS feeds FROM chunks c)"""


def _statements(spark: SparkSession, sf: str) -> DataFrame:
    return tables.line_statements(tables.table(spark, sf, "documents"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    statements = _statements(spark, sf)
    chunks = graph.greedy_chunks(statements, CHUNK)
    return graph.annotate(chunks, graph.chunk_links(chunks, graph.data_edges(statements)))


@query(f"WITH {_EDGES} SELECT func, src, dst FROM edges")
def data_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.data_edges(_statements(spark, sf))


@query(f"""WITH {tables.TURNS_SQL} SELECT h.func, h.index AS src, k.index AS dst FROM turns h JOIN turns k ON k.func = h.func AND k.parent = h.index WHERE h.kind = 'if_statement'
UNION SELECT func, index, nxt FROM (SELECT func, index, kind, lead(index) OVER (PARTITION BY func, parent ORDER BY index) AS nxt FROM turns) WHERE kind = 'if_statement' AND nxt IS NOT NULL""")
def control_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.control_edges(tables.turn_statements(tables.table(spark, sf, "conversations")))


@query(f"WITH RECURSIVE {_CHUNKS} SELECT func, chunk_index, statement_start, statement_end FROM chunks")
def greedy_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return graph.greedy_chunks(_statements(spark, sf), CHUNK)


@query(f"WITH RECURSIVE {_LINKS} SELECT func, src, dst FROM links")
def cross_chunk_deps(spark: SparkSession, sf: str) -> DataFrame:
    statements = _statements(spark, sf)
    return graph.chunk_links(graph.greedy_chunks(statements, CHUNK), graph.data_edges(statements))


@query(f"WITH RECURSIVE {_LINKS} SELECT func, chunk_index, statement_start, statement_end, array_to_string(needs, ',') AS depends_on, array_to_string(feeds, ',') AS depended_on_by FROM noted")
def chunk_annotate(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("func", "chunk_index", "statement_start", "statement_end", F.array_join("depends_on_chunks", ",").alias("depends_on"), F.array_join("depended_on_by_chunks", ",").alias("depended_on_by"))


@query(f"""WITH RECURSIVE {_LINKS} SELECT func, count(*) AS n_chunks, string_agg(chunk_index || ':' || statement_start || '-' || statement_end || '<' || array_to_string(needs, ' '), ';' ORDER BY chunk_index) AS chunks,
  bool_and(len(list_filter(needs, lambda d: d >= chunk_index)) = 0) AS dag_valid FROM noted GROUP BY func""")
def chunk_map(spark: SparkSession, sf: str) -> DataFrame:
    mapped = graph.chunk_map(_chunks(spark, sf).withColumns({"id": F.col("chunk_index"), "normalized_code": F.lit("")}))
    shown = F.transform("chunks", lambda c: F.concat(c["chunk_index"].cast("string"), F.lit(":"), F.array_join(c["statement_range"], "-"), F.lit("<"), F.array_join(c["dependencies"], " ")))
    return mapped.select("func", F.size("chunks").cast("bigint").alias("n_chunks"), F.array_join(shown, ";").alias("chunks"), "dag_valid")


# a graph with cycles: turn i of a conversation of n points to turn (3 i + id) mod n
_RING = "SELECT conv_id AS func, turn AS v, (3 * turn + conv_id) % n AS d, n FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations))"


@query(f"""WITH RECURSIVE e AS (SELECT func, v, d, n FROM ({_RING}) WHERE v > 0),
reach AS (SELECT func, v, d FROM e UNION SELECT r.func, r.v, e.d FROM reach r JOIN e ON e.func = r.func AND e.v = r.d)
SELECT g.func, NOT coalesce(bool_or(r.v = r.d), false) AS dag_valid FROM (SELECT DISTINCT conv_id AS func FROM conversations) g LEFT JOIN reach r ON r.func = g.func GROUP BY g.func""")
def dag_check(spark: SparkSession, sf: str) -> DataFrame:
    sizes = tables.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("func")).agg(F.count("*").cast("int").alias("n"))
    deps = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda v: F.when(v > 0, F.array(((3 * v + F.col("func")) % F.col("n")).cast("int"))).otherwise(F.array().cast("array<int>")))
    return sizes.select("func", graph.is_acyclic(deps).alias("dag_valid"))


# --- chunk scores: all chunks of documents that have a vector, the document's vector for each chunk


def _chunk_scores(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    near = _chunks(spark, sf).join(vectors.select(F.col("id").alias("func")), "func", "left_semi").withColumnRenamed("func", "id")
    pairs = similar.pairs_of(vector.top_k(_asked(spark, sf), vectors, 4).where("query_id <> base_id"), near, near)
    links = tuple(F.col(p + x) for x in ("depends_on_chunks", "depended_on_by_chunks") for p in ("q_", "c_"))
    structural = score.chunk_structural(F.size("q_statement_indices"), F.col("c_statement_indices"), F.col("c_statement_start"), F.col("c_statement_end"), links)
    named = pairs.withColumns({"query_chunk": F.col("q_chunk_index").cast("bigint"), "base_chunk": F.col("c_chunk_index").cast("bigint")})
    return named.withColumn("structural", structural).withColumn("combined", score.chunk_score(F.round("score", 6), F.col("structural")))


_CHUNK_KEYS = ("query_id", "query_chunk", "base_id", "base_chunk")


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN greatest({a}, {b}) = 0 THEN 1.0::DOUBLE ELSE least({a}, {b})::DOUBLE / greatest({a}, {b}) END"


_CHUNK_SCORES = f"""{_LINKS}, sized AS (SELECT *, statement_end - statement_start + 1 AS m FROM noted WHERE func IN (SELECT vec_id FROM embeddings)),
{_TOP.format('')},
cs AS (SELECT query_id, q.chunk_index AS query_chunk, base_id, c.chunk_index AS base_chunk, rank, raw, ({_ratio('q.m', 'c.m')} + {_ratio('len(q.needs)', 'len(c.needs)')} + {_ratio('len(q.feeds)', 'len(c.feeds)')}) / 3 AS structural
  FROM ranked JOIN sized q ON q.func = query_id JOIN sized c ON c.func = base_id WHERE rank <= 4 AND query_id <> base_id),
cs2 AS (SELECT *, greatest(0, least(1, 0.7::DOUBLE * round(raw, 6) + 0.3::DOUBLE * structural)) AS combined FROM cs)"""


@query(f"WITH RECURSIVE {_CHUNK_SCORES} SELECT {', '.join(_CHUNK_KEYS)}, round(structural, 4) AS structural FROM cs2")
def chunk_structural(spark: SparkSession, sf: str) -> DataFrame:
    return _chunk_scores(spark, sf).select(*_CHUNK_KEYS, F.round("structural", 4).alias("structural"))


@query(f"""WITH RECURSIVE {_CHUNK_SCORES} SELECT {', '.join(_CHUNK_KEYS)}, round(combined, 4) AS score, place FROM
(SELECT *, row_number() OVER (PARTITION BY query_id, query_chunk ORDER BY round(combined, 4) DESC, rank, base_chunk) AS place FROM cs2) WHERE place <= 3""")
def chunk_rerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id", "query_chunk").orderBy(F.desc(F.round("combined", 4)), "rank", "base_chunk"))
    ranked = _chunk_scores(spark, sf).withColumn("place", place).where("place <= 3")
    return ranked.select(*_CHUNK_KEYS, F.round("combined", 4).alias("score"), F.col("place").cast("bigint").alias("place"))


@query(f"""WITH RECURSIVE {_CHUNK_SCORES} SELECT {', '.join(_CHUNK_KEYS)}, CASE {' '.join(f"WHEN combined >= {least}::DOUBLE THEN '{h}'" for least, h in score.CHUNK_HINTS[:-1])} ELSE '{score.CHUNK_HINTS[-1][1]}' END AS hint FROM cs2""")
def chunk_hint(spark: SparkSession, sf: str) -> DataFrame:
    return _chunk_scores(spark, sf).select(*_CHUNK_KEYS, score.chunk_hint(F.col("combined")).alias("hint"))


# --- what SQL cannot say: rows only


@query()
def sequence_ratios(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _candidates(spark, sf)
    return pairs.select("query_id", "base_id", F.round(sequence_ratio("q_tokens", "c_tokens", F.lit(""), F.lit("")), 4).alias("ratio"))


@query()
def hash_encode(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents").select("doc_id", encoder()("text").alias("embedding"))


def _code(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as the source of a function of as many statements as it has lines."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line, i: F.concat(F.lit("    v"), (i % 7).cast("string"), F.lit(" = len(v"), (F.length(line) % 7).cast("string"), F.lit(")")))
    return tables.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("def f(v0, v1=2, *rest) -> int:\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("code"))


@query("SELECT doc_id::VARCHAR AS file_path, 'f' AS name, 'v0 v1 rest' AS parameters, 'int' AS return_type, 1 AS start_line, 1 + len(string_split(coalesce(text, ''), chr(10))) AS end_line, 'len' AS dependencies, false AS is_stub FROM documents")
def parse_functions(spark: SparkSession, sf: str) -> DataFrame:
    found = repository.functions_in_texts(_code(spark, sf), "doc_id", "code")
    return found.select("file_path", "name", F.array_join("parameters", " ").alias("parameters"), "return_type", "start_line", "end_line", F.array_join("dependencies", " ").alias("dependencies"), "is_stub")


@query("""SELECT doc_id, i - 1 AS index, 'expression_statement' AS kind, 'v' || ((i - 1) % 7) AS writes,
  CASE WHEN 'len' < 'v' || (length(lines[i]) % 7) THEN 'len v' || (length(lines[i]) % 7) END AS reads
FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))""")
def parse_statements(spark: SparkSession, sf: str) -> DataFrame:
    found = repository.statements(_code(spark, sf), "doc_id", "code")
    return found.select("doc_id", "index", "kind", F.array_join("writes", " ").alias("writes"), F.array_join("reads", " ").alias("reads"))


@query("SELECT doc_id, 1 + len(string_split(coalesce(text, ''), chr(10))) AS statement_count FROM documents")
def count_statements(spark: SparkSession, sf: str) -> DataFrame:
    return _code(spark, sf).select("doc_id", repository.statement_count("code").cast("bigint").alias("statement_count"))
