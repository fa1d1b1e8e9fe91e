"""The seven operations on an index, each a Spark plan that returns a DataFrame.

:class:`Engine` holds the encoder and the weights.  :func:`as_json` turns a result into the JSON
text that tool callers expect.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import normalize, score, syntax
from plumbline.functions.udfs import encode_texts, encoder
from plumbline.operators import graph, similar, vector
from plumbline.operators.store import Index
from plumbline.session import shared_path
from plumbline.sources import repository

#: Functions with more statements than this are chunked.
LARGE = 30
# What callers are told.
NO_FOLDER = "Not a directory: {}"
NO_CHUNKS = "No chunks indexed. Run chunk_repository first."
NO_CHUNK = "Chunk id {} not found"
NO_FUNCTION = "Function {} not found in index"
ONE_OF = "Provide either {} or {}"
NOT_BOTH = ", not both"
NOT_CHUNKED = "Run chunk_repository to generate chunks"
DEFAULT_INDEX = str(Path.home() / ".plumbline" / "index")


def _lines() -> Column:
    return F.split("body_code", r"\r\n|\r|\n")


def _chunk_text(first: str, last: str) -> Column:
    """The normal form of some of a function's lines, wrapped in a function."""
    return normalize.normalize(normalize.as_function(F.slice("lines", F.col(first), F.col(last) - F.col(first) + 1)))


class Engine:
    """An encoder (a function from a list of texts to unit vectors) and weights."""

    def __init__(self, spark: SparkSession, encode=encode_texts, weights: score.Weights = score.Weights()):
        self.spark, self.weights = spark, weights
        self.encode = encoder(encode)

    def index(self, folder: str | None = None) -> Index:
        return Index(self.spark, folder or DEFAULT_INDEX)

    def _prepared(self, functions: DataFrame) -> DataFrame:
        """Functions with their normalized code, its hash and its vector."""
        normal = functions.withColumn("normalized_code", normalize.normalize(F.col("body_code")))
        return normal.withColumns({"code_hash": normalize.code_hash(F.col("normalized_code")), "embedding": self.encode("normalized_code")})

    # --- write

    def index_repository(self, root: str, folder: str | None = None, force: bool = False) -> DataFrame:
        """Indexes the functions of all supported files under ``root``; stubs are not kept.

        Files of which the index already has a method are skipped, or, with ``force``, replaced.
        One row: files_processed (read in this run), methods_indexed, index_dir.
        """
        index = self.index(folder)
        files = repository.paths(self.spark, root)
        if not force:
            files = files.join(index.methods().select("file_path").distinct(), "file_path", "left_anti")
        files = files.persist()
        functions, read, parsed = repository.functions_in_files(files)
        kept = self._prepared(functions.where(~F.col("is_stub")))
        processed = read.count()
        if force:
            index.delete_files(read)
        n = index.add_methods(kept.drop("is_stub"))
        for df in (parsed, files):
            df.unpersist()
        return self.spark.createDataFrame([(processed, n, index.folder)], "files_processed bigint, methods_indexed bigint, index_dir string")

    def chunk_repository(self, root: str, folder: str | None = None, most: int = graph.MOST_STATEMENTS, force: bool = False) -> DataFrame:
        """Chunks the indexed functions under ``root`` that have more than 30 statements.

        Functions that have chunks are skipped, or, with ``force``, chunked anew.  One row:
        files_scanned, functions_chunked, chunks_created, skipped_files (sorted).
        """
        if not Path(root).is_dir():
            raise NotADirectoryError(NO_FOLDER.format(root))
        base = str(Path(root))
        index = self.index(folder)
        own = index.methods().where((F.col("file_path") == base) | F.col("file_path").startswith(base.rstrip("/") + "/"))
        scanned = own.agg(F.countDistinct("file_path")).head()[0]
        if not force:
            own = own.join(index.chunks().select(F.col("function_id").alias("id")).distinct(), "id", "left_anti")
        failed: list[str] = []
        if most < 1:  # no chunk could hold a statement
            failed = sorted(r[0] for r in own.where(repository.statement_count("body_code") > LARGE).select("file_path").distinct().collect())
            chunks = 0
            functions = 0
        else:
            made = self.chunks_of(own, most, LARGE).persist()
            functions = made.select("function_id").distinct().count()
            if force:
                index.delete_chunks_of(made.select(F.col("function_id").alias("id")))
            chunks = index.add_chunks(made)
            made.unpersist()
        return self.spark.createDataFrame([(scanned, functions, chunks, failed)], "files_scanned bigint, functions_chunked bigint, chunks_created bigint, skipped_files array<string>")

    def chunks_of(self, methods: DataFrame, most: int = graph.MOST_STATEMENTS, over: int = -1) -> DataFrame:
        """The annotated chunks of those of a table's methods that have more statements than ``over``,
        with their normalized code and vector."""
        owners = methods.select(F.col("id").alias("function_id"), F.col("name").alias("function_name"), "file_path", "body_code")
        listed = repository.listed_statements(owners, over=over).withColumn("lines", _lines()).drop("body_code")
        chunks = graph.annotated_chunks(listed, most)
        out = chunks.withColumn("normalized_code", normalize.normalize(normalize.as_function(F.col("lines")))).drop("start_line", "end_line", "lines")
        return out.withColumn("embedding", self.encode("normalized_code"))

    def _chunk_texts(self, chunks: DataFrame, methods: DataFrame, statements: DataFrame) -> DataFrame:
        """(function_id, chunk_index, normalized_code): the lines from a chunk's first to its last
        statement, wrapped in a function and normalized."""
        lines = statements.select(F.col("func").alias("function_id"), "index", "start_line", "end_line")
        covered = chunks.select("function_id", "chunk_index", F.explode("statement_indices").alias("index")).join(lines, ["function_id", "index"])
        spans = covered.groupBy("function_id", "chunk_index").agg(F.min("start_line").alias("first"), F.max("end_line").alias("last"))
        source = methods.select(F.col("id").alias("function_id"), _lines().alias("lines"))
        return spans.join(source, "function_id").select("function_id", "chunk_index", _chunk_text("first", "last").alias("normalized_code"))

    # --- read

    def analyze_new_code(self, code: str, language: str = "python", top_k: int = 3, folder: str | None = None) -> DataFrame:
        """For each function of a snippet the most similar indexed methods, best first: new_method,
        parameters, place, file, method, line, score, exact_match, embedding_similarity,
        ast_similarity, differences, refactoring_hints.  A function without candidates has one row
        with a null place."""
        index = self.index(folder)
        parsed = repository.functions_in_snippet(self.spark, code, language)
        q = self._prepared(parsed.withColumn("id", F.monotonically_increasing_id())).persist()
        methods = index.methods()
        found = vector.top_k(q.select("id", "embedding"), index.vectors(), similar.OVER_FETCH * top_k)
        pairs = similar.pairs_of(found, q.select(*similar.COLUMNS), methods.select(*similar.COLUMNS))
        kept = similar.best(similar.scored(pairs, self.weights), top_k)
        result = kept.select(
            F.col("query_id").alias("id"), "place", F.col("c_file_path").alias("file"), F.col("c_name").alias("method"), F.col("c_start_line").alias("line"), F.col("final").alias("score"),
            "exact_match", "embedding_similarity", "ast_similarity", "differences", "refactoring_hints",
        )
        return q.select("id", F.col("name").alias("new_method"), "parameters").join(result, "id", "left").orderBy("id", "place").drop("id")

    def analyze_project(self, folder: str | None = None, threshold: float = 0.85, top_k: int = 5, min_lines: int = 4) -> DataFrame:
        """All similar pairs of indexed methods, best first: file_a, method_a, line_a, file_b,
        method_b, line_b, score, exact_match, embedding_similarity, ast_similarity, differences,
        refactoring_hints."""
        index = self.index(folder)
        found = similar.similar_pairs(index.methods(), index.vectors(), threshold, top_k, min_lines, self.weights)
        return found.select(
            F.col("q_file_path").alias("file_a"), F.col("q_name").alias("method_a"), F.col("q_start_line").alias("line_a"),
            F.col("c_file_path").alias("file_b"), F.col("c_name").alias("method_b"), F.col("c_start_line").alias("line_b"),
            F.col("final").alias("score"), "exact_match", "embedding_similarity", "ast_similarity", "differences", "refactoring_hints",
        )

    def find_large_functions(self, folder: str | None = None, min_statements: int = LARGE) -> DataFrame:
        """Methods with more statements than ``min_statements``, largest first: id, name, file,
        start_line, end_line, statement_count."""
        counted = self.index(folder).methods().withColumn("statement_count", repository.statement_count("body_code"))
        large = counted.where(F.col("statement_count") > min_statements).orderBy(F.desc("statement_count"), "id")
        return large.select("id", "name", F.col("file_path").alias("file"), "start_line", "end_line", "statement_count")

    def analyze_chunks(self, code: str | None = None, chunk_id: int | None = None, top_k: int = 3, folder: str | None = None) -> DataFrame:
        """The stored chunks most similar to a snippet or to a stored chunk (not itself), best
        first: chunk_id, function_name, file, similarity_score, statement_range, refactoring_hint."""
        if (code is None) == (chunk_id is None):
            raise ValueError(ONE_OF.format("code_snippet", "chunk_id") + NOT_BOTH * (code is not None))
        index = self.index(folder)
        if index.chunks().isEmpty():
            raise LookupError(NO_CHUNKS)
        if chunk_id is not None:
            own = index.chunk(chunk_id).persist()
            if own.isEmpty():
                raise LookupError(NO_CHUNK.format(chunk_id))
            query = own.select("id", "embedding", F.size("statement_indices").alias("q_count"), F.col("depends_on_chunks").alias("q_needs"), F.col("depended_on_by_chunks").alias("q_feeds"))
        else:
            text = self.spark.range(1).select(normalize.normalize(normalize.as_function(F.split(F.lit(code), "\r\n|\r|\n")))).head()[0]
            one = self.spark.createDataFrame([(-1, text, syntax.count_statements(code))], "id bigint, t string, q_count int")
            query = one.withColumn("embedding", self.encode("t")).drop("t")
        found = vector.top_k(query, index.vectors("chunks"), top_k + (chunk_id is not None)).where("query_id <> base_id")
        chunks = index.chunks().withColumnRenamed("id", "base_id")
        near = chunks.drop("embedding").join(F.broadcast(found), "base_id")  # a few rows; what chunks take in memory is not known from their files
        both = near.join(F.broadcast(query.drop("embedding").withColumnRenamed("id", "query_id")), "query_id")
        links = (F.col("q_needs"), F.col("depends_on_chunks"), F.col("q_feeds"), F.col("depended_on_by_chunks")) if chunk_id is not None else None
        structural = score.chunk_structural(F.col("q_count"), F.col("statement_indices"), F.col("statement_start"), F.col("statement_end"), links)
        combined = both.withColumn("raw", score.chunk_score(F.col("score"), structural))
        shown = combined.select(
            F.col("base_id").alias("chunk_id"), "function_name", F.col("file_path").alias("file"), score.round4(F.col("raw")).alias("similarity_score"),
            F.array("statement_start", "statement_end").alias("statement_range"), score.chunk_hint(F.col("raw")).alias("refactoring_hint"), "rank",
        )
        return shown.orderBy(F.desc("similarity_score"), "rank").limit(top_k).drop("rank")

    def get_chunk_map(self, function_id: int | None = None, file_path: str | None = None, folder: str | None = None) -> DataFrame:
        """The chunks of a function, or of all chunked functions of a file by name: function_id,
        function_name, file, dag_valid, chunks (array of structs in order), hint (only for a function
        without chunks)."""
        if (function_id is None) == (file_path is None):
            raise ValueError(ONE_OF.format("function_id", "file_path") + NOT_BOTH * (function_id is not None))
        index = self.index(folder)
        if function_id is not None:
            methods = index.method(function_id)
            if methods.isEmpty():
                raise LookupError(NO_FUNCTION.format(function_id))
            chunks = index.by_function(function_id)
        else:
            chunks = index.by_file(file_path, "chunks")
            methods = index.methods().join(chunks.select(F.col("function_id").alias("id")).distinct(), "id", "left_semi")
        stored = F.coalesce("normalized_code", F.lit("")) != ""
        bare = chunks.where(~stored)  # of older segments: their text is made anew, or stays empty
        owners = methods.join(bare.select(F.col("function_id").alias("id")).distinct(), "id", "left_semi")
        statements = repository.statements(owners.select(F.col("id").alias("func"), "body_code"), "func")
        made = bare.drop("normalized_code").join(self._chunk_texts(bare, owners, statements), ["function_id", "chunk_index"], "left")
        whole = chunks.where(stored).unionByName(made.withColumn("normalized_code", F.coalesce("normalized_code", F.lit(""))))
        grouped = graph.chunk_map(whole, "function_id")
        rows = methods.select(F.col("id").alias("function_id"), F.col("name").alias("function_name"), F.col("file_path").alias("file"))
        out = rows.join(grouped, "function_id", "left")
        none = F.array().cast(grouped.schema["chunks"].dataType)
        return out.select(
            "function_id", "function_name", "file", F.coalesce("dag_valid", F.lit(True)).alias("dag_valid"), F.coalesce("chunks", none).alias("chunks"),
            F.when(F.col("chunks").isNull(), NOT_CHUNKED).alias("hint"),
        ).orderBy("function_name", "function_id")


def as_json(result, **wrap) -> str:
    """A result's rows (or the rows of what a call without arguments returns) as JSON text; an
    error that a caller can mend becomes {"error": ...}."""
    try:
        df = result() if callable(result) else result
        rows = [json.loads(r) for r in df.toJSON().collect()]
    except (NotADirectoryError, ValueError, LookupError) as e:
        return json.dumps({"error": str(e).strip("'\"")})
    return json.dumps(wrap | {"results": rows}, indent=2)
