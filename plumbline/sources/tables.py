"""Text units from ordinary tables, so that every operator also runs where there is no code.

A document is a unit: its lines are its statements (the first word written, the others read), words
of its first line are its parameters and its long words are what it depends on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def units(documents: DataFrame) -> DataFrame:
    """(id, language, file_path, body, loc, parameters, return_type, dependencies) of documents.
    Null texts are empty."""
    body = F.coalesce(F.col("text"), F.lit(""))
    n = F.coalesce(F.col("n_chars"), F.lit(0))
    lines = F.split(body, "\n")
    long_words = F.filter(F.split(F.lower(body), "[^a-z]+"), lambda w: F.length(w) >= 8)
    return documents.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.col("source").alias("file_path"), body.alias("body"),
        F.size(lines).alias("loc"), F.slice(F.split(lines[0], " "), F.lit(1), (n % 4).cast("int")).alias("parameters"),
        F.when(n % 3 == 0, F.lit(None).cast("string")).when(n % 3 == 1, "int").otherwise("str").alias("return_type"),
        F.array_sort(F.array_distinct(long_words)).alias("dependencies"),
    )


UNITS_SQL = """units AS (
  SELECT doc_id AS id, lang AS language, source AS file_path, coalesce(text, '') AS body,
    len(string_split(coalesce(text, ''), chr(10))) AS loc,
    list_slice(string_split(string_split(coalesce(text, ''), chr(10))[1], ' '), 1, coalesce(n_chars, 0) % 4) AS parameters,
    CASE coalesce(n_chars, 0) % 3 WHEN 0 THEN NULL WHEN 1 THEN 'int' ELSE 'str' END AS return_type,
    list_sort(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda w: length(w) >= 8))) AS dependencies
  FROM documents)"""


def line_statements(documents: DataFrame) -> DataFrame:
    """(func, index, writes, reads): a row a line of each document."""
    lines = documents.select(F.col("doc_id").alias("func"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("index", "line"))
    words = F.filter(F.split("line", " "), lambda w: w != "")
    return lines.select("func", "index", words.alias("w")).select(
        "func", "index", F.slice("w", 1, 1).alias("writes"), F.array_distinct(F.slice("w", F.lit(2), F.size("w"))).alias("reads")
    )


STATEMENTS_SQL = """statements AS (
  SELECT func, index, list_slice(w, 1, 1) AS writes, list_distinct(w[2:]) AS reads
  FROM (SELECT func, i - 1 AS index, list_filter(string_split(lines[i], ' '), lambda x: x <> '') AS w
        FROM (SELECT doc_id AS func, lines, unnest(range(1, len(lines) + 1)) AS i
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))))"""


def turn_statements(conversations: DataFrame) -> DataFrame:
    """(func, index, parent, kind): turns as statements; a user's turn is a compound header, the
    parent of the other turns up to the next one."""
    from pyspark.sql import Window

    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    head = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(before)
    user = F.col("role") == "user"
    return conversations.select(
        F.col("conv_id").alias("func"), F.col("turn").alias("index"), F.when(~user, head).alias("parent"), F.when(user, "if_statement").otherwise("expression_statement").alias("kind")
    )


TURNS_SQL = """turns AS (
  SELECT conv_id AS func, turn AS index, CASE WHEN role <> 'user' THEN max(CASE WHEN role = 'user' THEN turn END)
      OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent,
    CASE WHEN role = 'user' THEN 'if_statement' ELSE 'expression_statement' END AS kind
  FROM conversations)"""
