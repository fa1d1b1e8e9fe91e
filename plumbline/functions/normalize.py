"""Normalization of source code as Column expressions.

Steps, in this order: comments go, string literals and numbers become placeholders, the function
name, its parameters and its locals get positional names, white space is made one.  The quirks that
results depend on are kept: ``#`` starts a comment inside strings too, a triple-quoted string is
three placeholders, a default value with ``)`` ends the parameter list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders.
STRING, NUMBER, FUNCTION = "STR_LITERAL", "NUM_LITERAL", "FUNC_NAME"


# The patterns below decide what the normal form is.


def _where_found(what: str, code: Column, change: Callable[[Column], Column]) -> Column:
    """A change of texts that hold what it needs; looking for that is cheaper than a pattern."""
    return _let(code, lambda code: F.when(F.contains(code, F.lit(what)), change(code)).otherwise(code))


def strip_comments(code: Column) -> Column:
    return _where_found("#", code, lambda code: F.regexp_replace(code, r"#[^\n]*", ""))


def replace_strings(code: Column) -> Column:
    code = _where_found('"', code, lambda code: F.regexp_replace(code, r'"(?:[^"\\]|\\[^\n])*+"', STRING))
    return _where_found("'", code, lambda code: F.regexp_replace(code, r"'(?:[^'\\]|\\[^\n])*+'", STRING))


def replace_numbers(code: Column) -> Column:
    code = _where_found(".", code, lambda code: F.regexp_replace(code, r"(?U)\b\d+\.\d+\b", NUMBER))
    return F.regexp_replace(code, r"(?U)\b\d+\b", NUMBER)


def rename_function(code: Column) -> Column:
    return F.regexp_replace(code, r"(?U)\bdef\s+[A-Za-z_]\w*\s*\(", f"def {FUNCTION}(")


def parameter_names(code: Column) -> Column:
    """Names in the first signature, ``self`` and ``cls`` left out."""
    signature = F.regexp_extract(code, rf"(?U)\bdef\s+{FUNCTION}\s*\(([^)]*)\)", 1)
    names = F.transform(F.split(signature, ","), lambda part: F.regexp_extract(part, r"(?U)^\s*\**([A-Za-z_]\w*)", 1))
    return F.filter(names, lambda n: ~n.isin("", "self", "cls"))


def local_names(code: Column) -> Column:
    """Targets of indented plain or annotated assignments."""
    return F.regexp_extract_all(code, F.lit(r"(?Um)^\s+([A-Za-z_]\w*)\s*(?::[^=\n]*)?\s*=(?!=)"), 1)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _final(numbered: Column) -> Column:
    """A map from each name to what it is called in the end: that of the name which its new one meets
    further on, if there is such a name, and so on.  Steps are doubled, so the work grows little
    more than the names."""
    new = lambda nth: F.concat(F.lit("v"), nth.cast("string"))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(numbered))).cast("int"))

    def last(names: Column) -> Column:
        met = F.transform(numbered, lambda x: F.greatest(x["nth"], F.array_position(names, new(x["nth"])).cast("int")))
        chased = F.aggregate(rounds, met, lambda to, _: F.transform(to, lambda nth: F.element_at(to, nth)))
        return F.when(F.exists(names, lambda n: n.rlike("^v[0-9]+$")), chased).otherwise(numbered["nth"])

    return _let(numbered["name"], lambda names: F.map_from_arrays(names, F.transform(last(names), new)))


def rename_all(code: Column, names: Column) -> Column:
    """Renames the i-th distinct name to ``v{i}``, one name after the other: a name that equals an
    earlier new one is renamed again.

    What a name is in the end is worked out on the names; the text is cut into words and what lies
    between, and each word is looked up once.
    """
    def looked_up(numbered: Column) -> Column:
        return _let(_final(numbered), lambda to: F.array_join(F.transform(F.regexp_extract_all(code, F.lit(r"(?U)\w+|\W+"), F.lit(0)), lambda w: F.coalesce(F.try_element_at(to, w), w)), ""))

    numbered = F.transform(F.array_distinct(names), lambda n, i: F.struct(n.alias("name"), (i + 1).alias("nth")))
    return _let(numbered, lambda numbered: F.when(F.size(numbered) == 0, code).otherwise(looked_up(numbered)))


def rename_identifiers(code: Column) -> Column:
    return _let(rename_function(code), lambda code: rename_all(code, F.concat(parameter_names(code), local_names(code))))


def collapse_space(code: Column) -> Column:
    code = _where_found("\r", code, lambda code: F.regexp_replace(code, r"\r\n?", "\n"))
    code = F.regexp_replace(code, r"[ \t]{2,}|\t", " ")
    code = F.regexp_replace(code, r"(?U)\n\s*\n+", "\n")
    return F.regexp_replace(code, r"(?U)^\s+|\s+$", "")


def normalize(code: Column, language: str = "python") -> Column:
    """The whole chain.  A null stays null."""
    if language not in NORMALIZERS:
        raise ValueError(f"Unsupported language: {language}")
    return NORMALIZERS[language](code)


def _python(code: Column) -> Column:
    return collapse_space(rename_identifiers(replace_numbers(replace_strings(strip_comments(code)))))


NORMALIZERS = {"python": _python}


def code_hash(normalized: Column) -> Column:
    return F.sha2(normalized, 256)


def as_function(lines: Column) -> Column:
    """Source lines wrapped in a function, so that the chain names their locals."""
    return F.concat(F.lit("def _chunk_func():\n"), F.array_join(F.transform(lines, lambda line: F.concat(F.lit("    "), line)), "\n"))
