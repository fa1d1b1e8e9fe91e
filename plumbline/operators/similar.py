"""From candidates to scored, explained and deduplicated pairs of functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import score
from plumbline.functions.udfs import sequence_ratio
from plumbline.operators import vector
from plumbline.session import shared_path

#: Neighbours fetched for each result that is asked for.
OVER_FETCH = 3
COLUMNS = ["id", "language", "file_path", "name", "parameters", "return_type", "normalized_code", "code_hash", "start_line", "end_line", "dependencies", "ast_fingerprint"]


#: What a score and its explanation depend on, besides lines and the number of parameters.
AS_SCORED = ["language", "return_type", "normalized_code", "code_hash", "dependencies", "ast_fingerprint"]
#: Where a method is, and what is said of a pair.
PLACE = ["file_path", "name", "start_line"]
TOLD = [*(f"c_{c}" for c in PLACE), "exact_match", "embedding_similarity", "ast_similarity", "differences", "refactoring_hints"]


def criteria(q: dict[str, Column], c: dict[str, Column]) -> Column:
    """The coarse filter of the index: language, line band, parameter count."""
    return score.same_language(q["language"], c["language"]) & score.loc_in_bounds(q["loc"], c["loc"]) & score.parameters_near(q["n_params"], c["n_params"])


def passes(q: dict[str, Column], c: dict[str, Column]) -> Column:
    """The exact filter: language, parameter count, line ratio."""
    return score.same_language(q["language"], c["language"]) & score.parameters_near(q["n_params"], c["n_params"]) & score.loc_ratio_holds(q["loc"], c["loc"])


def candidates_for(methods: DataFrame, language: str, n_params: int, loc: int) -> DataFrame:
    """Ids of the methods that the coarse filter lets through for one query."""
    q = {"language": F.lit(language), "loc": F.lit(loc), "n_params": F.lit(n_params)}
    c = {"language": F.col("language"), "loc": score.loc(F.col("start_line"), F.col("end_line")), "n_params": F.size("parameters")}
    return methods.where(criteria(q, c)).select("id")


def candidate_counts(units: DataFrame, rule=criteria) -> DataFrame:
    """(id, n): how many other units pass a filter for each unit.  Units with the same language,
    lines and parameter count are counted together, so no pair of units is ever made; what is
    joined are the different combinations."""
    keys = ["language", "loc", "n_params"]
    shaped = units.select("id", "language", F.col("loc").cast("int").alias("loc"), F.size("parameters").alias("n_params"))
    shapes = shaped.groupBy(*keys).agg(F.count("*").alias("n"))
    q, c = shapes.alias("q"), shapes.alias("c")
    side = lambda s: {k: F.col(f"{s}.{k}") for k in keys}
    own = [F.col(f"q.{k}").alias(k) for k in (*keys, "n")]  # with n, both sides are the same plan and it runs once
    totals = q.join(c, rule(side("q"), side("c"))).groupBy(*own).agg(F.sum("c.n").alias("total")).drop("n")
    return shaped.join(totals, keys, "left").select("id", F.greatest(F.coalesce("total", F.lit(0)) - 1, F.lit(0)).alias("n"))


def side(df: DataFrame, prefix: str) -> DataFrame:
    """A side of a pair: its columns under a prefix."""
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def pairs_of(found: DataFrame, queries: DataFrame, base: DataFrame) -> DataFrame:
    """Candidates (query_id, base_id, score, rank) with both sides' columns, q_ and c_."""
    with_q = found.join(side(queries, "q_"), F.col("query_id") == F.col("q_id"))
    return with_q.join(side(base, "c_"), F.col("base_id") == F.col("c_id"))


def _sides() -> tuple[dict[str, Column], dict[str, Column]]:
    def of(p: str) -> dict[str, Column]:
        return {"language": F.col(p + "language"), "loc": score.loc(F.col(p + "start_line"), F.col(p + "end_line")), "n_params": F.size(p + "parameters")}

    return of("q_"), of("c_")


def scored(pairs: DataFrame, weights: score.Weights = score.Weights()) -> DataFrame:
    """Pairs that pass both filters and reach the threshold or have equal code, with their scores.

    The sequence comparison is the only Python here: it runs for pairs alone that are not equal and
    could still reach the threshold with the best result that their sequences' lengths allow.
    """
    q, c = _sides()
    args = [F.col(p + x) for x in ("parameters", "return_type", "dependencies") for p in ("q_", "c_")]
    able = pairs.where(criteria(q, c) & passes(q, c)).withColumns({
        "exact_match": F.col("q_code_hash") == F.col("c_code_hash"),
        "structural": score.structural_score(*args),
    })
    sequences = [F.col(p + x) for x in ("ast_fingerprint", "normalized_code") for p in ("q_", "c_")]
    equal = able.where("exact_match").withColumn("ast", F.lit(1.0))
    rest = able.where(~F.col("exact_match") & score.could_reach(F.col("score"), F.col("structural"), score.longest_ratio(*sequences), weights))
    rest = rest.withColumn("ast", sequence_ratio(*sequences))
    both = equal.unionByName(rest)
    final = score.method_score(F.col("exact_match"), F.col("score"), F.col("ast"), F.col("structural"), weights)
    found = both.withColumn("final", final).where((F.col("final") >= weights.threshold) | F.col("exact_match"))
    said = score.differences(*args)
    return found.withColumns({
        "embedding_similarity": score.round4(F.when(F.col("exact_match"), 1.0).otherwise(F.col("score"))),
        "ast_similarity": score.round4(F.col("ast")),
        "final": score.round4(F.col("final")),
        "differences": said,
        "refactoring_hints": score.hints(said),
    })


def best(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query; equal ones keep the order of the vector search."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "rank"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def distinct_pairs(found: DataFrame) -> DataFrame:
    """One row for each unordered pair: that of the query with the lower id that found it."""
    first = F.row_number().over(Window.partitionBy(F.least("query_id", "base_id"), F.greatest("query_id", "base_id")).orderBy("query_id", "place"))
    return found.withColumn("_n", first).where("_n = 1").drop("_n")


def similar_pairs(methods: DataFrame, vectors: DataFrame | None = None, threshold: float = 0.85, top_k: int = 5, min_lines: int = 4, weights: score.Weights = score.Weights()) -> DataFrame:
    """All similar pairs of a table of methods, highest scores first.

    ``vectors`` is what is searched (the methods' own vectors if not given; with deleted ones, these
    take places as in the index).  Methods of fewer than ``min_lines`` lines neither ask nor answer.

    Methods that are equal in all that a score depends on find the same candidates with the same
    scores: one of them is searched for and scored, and its list then holds for each, without itself.
    """
    eligible = methods.where(F.col("id").isNotNull() & (score.loc(F.col("start_line"), F.col("end_line")) >= min_lines))
    sized = [F.size("parameters").alias("n_params"), score.loc(F.col("start_line"), F.col("end_line")).alias("loc")]
    same = F.sha2(F.to_json(F.struct("embedding", *AS_SCORED, *sized)), 256).alias("same")
    path = shared_path(methods.sparkSession, "asked")  # which of equal methods it is must not change
    first = eligible.select("embedding", *COLUMNS, same).dropDuplicates(["same"])
    first.write.parquet(path)
    asked = methods.sparkSession.read.schema(first.schema).parquet(path)
    few = asked.count() <= vector.BLOCK_ROWS
    k = OVER_FETCH * top_k
    found = vector.top_k(asked.select("id", "embedding"), vector.within_reach((vectors or methods).select("id", "embedding"), k), k)
    # Sizes that the optimizer expects of compressed files say nothing: what is broadcast is said here.
    base = side(eligible.select(*COLUMNS), "c_")
    near = base.join(F.broadcast(found) if few else found.hint("merge"), F.col("c_id") == F.col("base_id"))
    pairs = near.join(side(asked.select("same", *COLUMNS), "q_").hint("merge"), F.col("query_id") == F.col("q_id"))
    told = scored(pairs, weights).select("q_same", F.struct((-F.col("final")).alias("below"), "rank", "base_id", "final", *TOLD).alias("x"))
    lists = told.groupBy("q_same").agg(F.slice(F.sort_array(F.collect_list("x")), 1, top_k + 1).alias("xs"))
    members = eligible.select(F.col("id").alias("query_id"), same, *(F.col(c).alias(f"q_{c}") for c in PLACE))
    listed = members.join(F.broadcast(lists) if few else lists.hint("merge"), F.col("same") == F.col("q_same"))
    others = F.slice(F.filter("xs", lambda x: x["base_id"] != F.col("query_id")), 1, top_k)
    each = listed.select("query_id", *(f"q_{c}" for c in PLACE), F.posexplode(others).alias("place", "x"))
    kept = each.select("query_id", *(f"q_{c}" for c in PLACE), (F.col("place") + 1).alias("place"), "x.*").drop("below").where(F.col("final") >= threshold)
    return distinct_pairs(kept).orderBy(F.desc("final"), "query_id", "place")
