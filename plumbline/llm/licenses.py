"""License scans by canonical digest: DataFrame functions only.

A text's canonical form has small letters, no punctuation, equivalent spellings made one, neither
copyright lines nor empty ones, and single spaces.  Its SHA-256 is looked up among those of known
licences.  Each line's canonical form is looked up among known notices in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.license_texts import DIGESTS, NOTICES, SPELLINGS, TEXTS

#: Known licences up to which their digests are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 10_000

# Fixed patterns, read alike by Java and RE2.
_BREAK = r"\r\n?"
_SIGNS = r"[^\p{L}\p{N}\n]+"
#: With or without "portions" and a sign; a year first, or the holder first and a year last.
_COPYRIGHT_LINE = r"^((portions |parts )?(copyright )+(c |by |[0-9]{4}|year|yyyy|.* [0-9]{4}$)|c ([0-9]{4}|year|yyyy)|spdx filecopyrighttext |all rights reserved$)"


def canonical_lines(text: Column) -> Column:
    """The lines in small letters, without punctuation and with one spelling."""
    plain = F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), _BREAK, "\n"), F.lit("\u00a9"), F.lit(" copyright c "))
    out = F.regexp_replace(F.lower(plain), _SIGNS, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.transform(F.split(out, "\n"), lambda line: F.trim(line))


def canonical_text(lines: Column) -> Column:
    """The whole text from its canonical lines, copyright lines and empty ones left out."""
    return F.array_join(F.filter(lines, lambda line: (line != "") & ~line.rlike(_COPYRIGHT_LINE)), " ")


def known_licenses(spark: SparkSession, texts: list[tuple[str, str, str]] = TEXTS) -> DataFrame:
    """(digest, license_id) of the built-in licence texts, with and without their titles, and of the
    long ones that are known by digest only."""
    rows = F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("text")) for k, title, body in texts for t in (body, f"{title}\n\n{body}")))
    short = digests(spark.range(1).select(F.explode(rows).alias("r")).select("r.license_id", "r.text"))
    long = F.array(*(F.struct(F.lit(d).alias("digest"), F.lit(k).alias("license_id")) for k, d in DIGESTS))
    return short.unionByName(spark.range(1).select(F.explode(long).alias("r")).select("r.*"))


def digests(known: DataFrame) -> DataFrame:
    """(digest, license_id) of a table of (license_id, text); of equal texts the least id stays, and
    texts without words are none."""
    form = canonical_text(canonical_lines(F.col("text")))
    return known.select(form.alias("_form"), "license_id").where("_form != ''").groupBy(F.sha2("_form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """For each document: the id column, digest (of its whole canonical text), license_id (of the
    known licence that it is, or null), notices (sorted distinct identifiers of the notice lines in
    it, joined by commas) and n_notices (how many lines are notices).

    ``known`` is a table (license_id, text) to use instead of the built-in texts.  Null and empty
    texts have the digest of the empty text, no licence and no notices; repeated rows have a row
    each.
    """
    if id_col in ("digest", "license_id", "notices", "n_notices"):
        raise ValueError(f"an id column called {id_col} would hide a column of the result")
    spark = docs.sparkSession
    table = digests(known) if known is not None else known_licenses(spark)
    of_line = F.trim(F.element_at(canonical_lines(F.col("line")), 1))
    rows = F.array(*(F.struct(F.lit(k).alias("id"), F.lit(t).alias("line")) for k, t in notices))
    forms = [(r["id"], r["form"], r["digest"]) for r in spark.range(1).select(F.explode(rows).alias("r")).select("r.*").select("id", of_line.alias("form"), F.sha2(of_line, 256).alias("digest")).collect()]
    sizes = F.array(*map(F.lit, sorted({len(form) for _, form, _ in forms})))
    by_digest = F.array(*(F.struct(F.lit(d).alias("digest"), F.lit(k).alias("id")) for k, _, d in sorted(forms)))
    near = F.filter("_lines", lambda line: F.array_contains(sizes, F.length(line)))
    found = F.filter(F.transform(near, lambda line: F.sha2(line, 256)), lambda d: F.array_contains(by_digest["digest"], d))
    lined = docs.select(id_col, canonical_lines(F.col(text_col)).alias("_lines"))
    own = lined.select(id_col, F.sha2(canonical_text(F.col("_lines")), 256).alias("digest"), found.alias("_found"))
    ids = F.array_sort(F.array_distinct(F.transform(F.filter(by_digest, lambda n: F.array_contains("_found", n["digest"])), lambda n: n["id"])))
    if known is None or known.count() <= MOST_BROADCAST:
        table = F.broadcast(table)
    return own.join(table, "digest", "left").select(
        id_col, "digest", "license_id", F.when(F.size("_found") > 0, F.array_join(ids, ",")).otherwise("").alias("notices"), F.size("_found").cast("bigint").alias("n_notices")
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_lines(text: str) -> str:
    plain = f"replace(regexp_replace(coalesce({text}, ''), {_quoted(_BREAK)}, chr(10), 'g'), chr(169), ' copyright c ')"
    out = f"regexp_replace(lower({plain}), {_quoted(_SIGNS)}, ' ', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return f"list_transform(string_split({out}, chr(10)), lambda l: trim(l))"


def _sql_text(lines: str) -> str:
    return f"array_to_string(list_filter({lines}, lambda l: l <> '' AND NOT regexp_matches(l, {_quoted(_COPYRIGHT_LINE)})), ' ')"


def oracle_sql() -> str:
    """The scan over ``documents`` in DuckDB's SQL."""
    texts = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, title, body in TEXTS for t in (body, f"{title}\n\n{body}"))
    long = ", ".join(f"({_quoted(d)}, {_quoted(k)})" for k, d in DIGESTS)
    notices = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in NOTICES)
    return f"""
WITH known AS (
  SELECT sha256({_sql_text(_sql_lines("body"))}) AS digest, min(id) AS license_id FROM (VALUES {texts}) AS v(id, body) GROUP BY 1
  UNION ALL SELECT * FROM (VALUES {long})
), notice AS (
  SELECT DISTINCT id, {_sql_lines("line")}[1] AS form FROM (VALUES {notices}) AS v(id, line)
), docs AS (
  SELECT row_number() OVER () AS k, doc_id, {_sql_lines("text")} AS lines FROM documents
), hits AS (
  SELECT k, string_agg(DISTINCT id, ',' ORDER BY id) AS notices, count(*) AS n_notices
  FROM (SELECT k, unnest(lines) AS form FROM docs) JOIN notice USING (form) GROUP BY k
), own AS (
  SELECT k, doc_id, sha256({_sql_text("lines")}) AS digest FROM docs
)
SELECT doc_id, digest, license_id, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
FROM own LEFT JOIN known USING (digest) LEFT JOIN hits USING (k)
"""
