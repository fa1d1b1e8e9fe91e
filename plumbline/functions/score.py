"""Similarity scores, their filters and their explanations as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LOC_RATIO = 0.7


@dataclass(frozen=True)
class Weights:
    """Weights of a method score's parts, and the score from which a pair counts."""

    embedding: float = 0.5
    ast: float = 0.3
    structural: float = 0.2
    threshold: float = 0.85


CHUNK_EMBEDDING, CHUNK_STRUCTURAL = 0.7, 0.3

# Hints for differences, in this order, and for chunk scores.
HINTS = {
    "parameter count": "consider unifying parameter signatures",
    "return type": "align return types or extract shared interface",
    "calls not in": "extract shared dependency logic into utility",
}
CHUNK_HINTS = [
    (0.99, "Exact duplicate chunk. Consider extracting to a shared helper function."),
    (0.85, "Very similar chunk. Consider consolidating this logic."),
    (0.70, "Related chunk. Review for potential refactoring opportunities."),
    (None, "Loosely similar chunk. Low refactoring priority."),
]


def round4(x: Column) -> Column:
    """Four decimals of the double's exact value, ties to even."""
    return F.bround(x.cast("double"), 4)


def loc(start: Column, end: Column) -> Column:
    return end - start + 1


# --- filters


def same_language(q: Column, c: Column) -> Column:
    return q == c


def parameters_near(q: Column, c: Column) -> Column:
    """Counts that differ by one at most."""
    return F.abs(q - c) <= 1


def loc_bounds(query_loc: Column) -> tuple[Column, Column]:
    """The coarse band of the index filter, in whole lines."""
    return F.floor(query_loc * LOC_RATIO), F.floor(query_loc / LOC_RATIO) + 1


def loc_in_bounds(query_loc: Column, candidate_loc: Column) -> Column:
    low, high = loc_bounds(query_loc)
    return (query_loc <= 0) | candidate_loc.between(low, high)


def loc_ratio_holds(a: Column, b: Column) -> Column:
    """The exact band: the shorter has 0.7 of the longer's lines; either without lines passes."""
    return (a == 0) | (b == 0) | (F.least(a, b) / F.greatest(a, b) >= LOC_RATIO)


# --- method scores


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; null if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def structural_score(q_params: Column, c_params: Column, q_return: Column, c_return: Column, q_deps: Column, c_deps: Column) -> Column:
    """The mean of parameter count, return type and, if there are any, dependencies."""
    q_deps, c_deps = (F.coalesce(d, F.array().cast("array<string>")) for d in (q_deps, c_deps))
    params = F.when(F.size(q_params) == F.size(c_params), 1.0).otherwise(0.5)
    returns = F.when(q_return.eqNullSafe(c_return), 1.0).otherwise(0.3)
    overlap = jaccard(q_deps, c_deps)
    return F.when(overlap.isNull(), (params + returns) / 2).otherwise((params + returns + overlap) / 3)


def method_score(exact: Column, embedding: Column, ast: Column, structural: Column, w: Weights = Weights()) -> Column:
    """The weighted sum; equal code has embedding and syntax scores of 1."""
    one = F.lit(1.0)
    return w.embedding * F.when(exact, one).otherwise(embedding) + w.ast * F.when(exact, one).otherwise(ast) + w.structural * structural


def longest_ratio(q_prints: Column, c_prints: Column, q_text: Column, c_text: Column) -> Column:
    """What the sequence ratio can be at most: that of the shorter sequence inside the longer one."""
    q, c = (F.greatest(F.coalesce(F.size(p), F.lit(0)), F.lit(0)) for p in (q_prints, c_prints))
    s, t = (F.length(F.coalesce(x, F.lit(""))) for x in (q_text, c_text))
    bound = lambda a, b: F.coalesce(2 * F.least(a, b) / F.nullif(a + b, F.lit(0)), F.lit(1.0))
    return F.when((q > 0) & (c > 0), bound(q, c)).otherwise(bound(s, t))


def could_reach(embedding: Column, structural: Column, ast: Column, w: Weights = Weights()) -> Column:
    """Whether a pair can reach the threshold with a syntax score of at most ``ast``: if not, the
    costly sequence comparison is not needed."""
    return w.embedding * embedding + w.ast * ast + w.structural * structural >= w.threshold - 1e-9


def _quoted(text: Column) -> Column:
    """As Python shows a string or a missing value."""
    escaped = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    double = escaped.contains("'") & ~escaped.contains('"')
    shown = F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.when(text.isNull(), "None").otherwise(shown)


def _list(names: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(names), lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "), F.lit("]"))


def differences(q_params: Column, c_params: Column, q_return: Column, c_return: Column, q_deps: Column, c_deps: Column) -> Column:
    """What differs, as sentences in a fixed order."""
    only_q, only_c = F.array_except(q_deps, c_deps), F.array_except(c_deps, q_deps)
    said = [
        F.when(F.size(q_params) != F.size(c_params), F.format_string("parameter count differs (%d vs %d)", F.size(q_params), F.size(c_params))),
        F.when(~q_return.eqNullSafe(c_return), F.concat(F.lit("return type differs ("), _quoted(q_return), F.lit(" vs "), _quoted(c_return), F.lit(")"))),
        F.when(F.size(only_q) > 0, F.concat(F.lit("query calls not in candidate: "), _list(only_q))),
        F.when(F.size(only_c) > 0, F.concat(F.lit("candidate calls not in query: "), _list(only_c))),
    ]
    return F.array_compact(F.array(*said))


def hints(found: Column) -> Column:
    """One hint for each kind of difference, in the order of the differences."""
    of_each = F.transform(found, lambda d: F.array_compact(F.array(*(F.when(d.contains(k), F.lit(h)) for k, h in HINTS.items()))))
    return F.array_distinct(F.flatten(of_each))


# --- chunk scores


def _ratio(a: Column, b: Column) -> Column:
    return F.when(F.greatest(a, b) == 0, 1.0).otherwise(F.least(a, b) / F.greatest(a, b))


def chunk_structural(q_count: Column, c_indices: Column, c_start: Column, c_end: Column, topology: tuple[Column, Column, Column, Column] | None = None) -> Column:
    """The mean of the statement count ratio and, if the query's links are known (query's and
    candidate's depends-on, query's and candidate's depended-on-by), of their count ratios."""
    c = F.when(F.size(c_indices) > 0, F.size(c_indices)).otherwise(F.greatest(F.lit(1), F.coalesce(c_end, F.lit(1)) - F.coalesce(c_start, F.lit(0)) + 1))
    q = F.coalesce(F.nullif(q_count, F.lit(0)), c)
    counts = F.least(q, c) / F.greatest(q, c)
    if topology is None:
        return counts
    sizes = [F.greatest(F.size(F.coalesce(x, F.array().cast("array<int>"))), F.lit(0)) for x in topology]
    return (counts + _ratio(sizes[0], sizes[1]) + _ratio(sizes[2], sizes[3])) / 3


def chunk_score(embedding: Column, structural: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), CHUNK_EMBEDDING * embedding + CHUNK_STRUCTURAL * structural))


def chunk_hint(score: Column) -> Column:
    out = F.lit(CHUNK_HINTS[-1][1])
    for least, hint in reversed(CHUNK_HINTS[:-1]):
        out = F.when(score >= least, hint).otherwise(out)
    return out
