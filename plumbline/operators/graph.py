"""Statement graphs: data and control edges, greedy chunks, their links, and cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.syntax import COMPOUND

MOST_STATEMENTS = 20
#: What chunks are made of.
OF_STATEMENT = ["index", "start_line", "end_line", "writes", "reads"]


def data_edges(statements: DataFrame, func: str = "func") -> DataFrame:
    """(func, src, dst): statement dst reads a name that the earlier statement src writes."""
    w = statements.select(func, F.col("index").alias("src"), F.explode("writes").alias("name"))
    r = statements.select(func, F.col("index").alias("dst"), F.explode("reads").alias("name"))
    return w.join(r, [func, "name"]).where("src < dst").select(func, "src", "dst").distinct()


def first_providers(statements: DataFrame, func: str = "func") -> DataFrame:
    """(func, index, provider): for each statement the least statement that writes what it reads,
    or null; what chunking needs of the data edges, without making them.  No join: whatever sizes the
    optimizer expects, no table of statements is broadcast."""
    first = F.min(F.when(F.col("writes"), F.col("index"))).over(Window.partitionBy(func, "name"))
    named = _named(statements, func, "index").withColumn("first", first)
    return named.groupBy(func, "index").agg(F.min(F.when(~F.col("writes") & (F.col("first") < F.col("index")), F.col("first"))).alias("provider"))


def _named(rows: DataFrame, func: str, place: str) -> DataFrame:
    """(func, place, name, writes): a row for each name that a place writes, and that it reads; one
    more without a name, so that no place is lost."""
    entry = lambda writes: lambda n: F.struct(n.alias("name"), F.lit(writes).alias("writes"))
    none = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(False).alias("writes")))
    some = lambda names: F.coalesce(names, F.array().cast("array<string>"))
    names = F.concat(none, F.transform(some("writes"), entry(True)), F.transform(some("reads"), entry(False)))
    return rows.select(func, place, F.explode(names).alias("_x")).select(func, place, "_x.name", "_x.writes")


def control_edges(statements: DataFrame, func: str = "func") -> DataFrame:
    """(func, src, dst): from compound statements to their direct children, and to the next
    statement on their own level."""
    heads = statements.where(F.col("kind").isin(*COMPOUND)).select(func, F.col("index").alias("src"))
    kids = statements.where("parent IS NOT NULL").select(func, F.col("parent").alias("src"), F.col("index").alias("dst"))
    down = heads.join(kids, [func, "src"]).select(func, "src", "dst")
    after = F.lead("index").over(Window.partitionBy(func, "parent").orderBy("index"))
    along = statements.select(func, F.col("index").alias("src"), "kind", after.alias("dst")).where(F.col("kind").isin(*COMPOUND) & F.col("dst").isNotNull())
    return down.union(along.select(func, "src", "dst")).distinct()


def chunk_starts(providers: Column, most: Column) -> Column:
    """Where chunks begin, from an array of (index, provider) in order of index.

    A chunk ends before a statement that has no provider, whose first provider lies before the
    chunk, or that would make it longer than ``most``; a function of ``most`` statements or fewer is
    one chunk.  Chunks are runs, so the state of the fold is the list of starts.
    """
    n = F.size(providers)

    def step(starts: Column, s: Column) -> Column:
        last = F.element_at(starts, -1)
        new = s["provider"].isNull() | (s["provider"] < last) | (s["index"] - last >= most)
        return F.when(new & (s["index"] > 0), F.concat(starts, F.array(s["index"].cast("int")))).otherwise(starts)

    folded = F.aggregate(providers, F.array(F.lit(0)), step)
    return F.when(n == 0, F.array().cast("array<int>")).when(most >= n, F.array(F.lit(0))).otherwise(folded)


def greedy_chunks(statements: DataFrame, most: int = MOST_STATEMENTS, func: str = "func") -> DataFrame:
    """(func, chunk_index, statement_start, statement_end): a partition of each function's
    statements into runs.  A function's statements meet in one task, never those of several."""
    if most < 1:
        raise ValueError("a chunk needs at least one statement")
    rows = F.array_sort(F.collect_list(F.struct(F.col("index").cast("int").alias("index"), F.col("provider").cast("int").alias("provider"))))
    each = first_providers(statements, func).groupBy(func).agg(rows.alias("s"))
    starts = each.select(func, F.size("s").alias("n"), chunk_starts(F.col("s"), F.lit(most)).alias("starts"))
    return starts.select(func, "n", "starts", F.posexplode("starts").alias("chunk_index", "statement_start")).select(
        func, "chunk_index", "statement_start", (F.coalesce(F.get("starts", F.col("chunk_index") + 1), F.col("n")) - 1).alias("statement_end")
    )


def chunk_links(chunks: DataFrame, edges: DataFrame, func: str = "func") -> DataFrame:
    """(func, src, dst): chunk dst reads what chunk src writes, for different chunks."""
    of = chunks.select(func, "chunk_index", F.explode(F.sequence("statement_start", "statement_end")).alias("s"))
    src = of.select(func, F.col("s").alias("src"), F.col("chunk_index").alias("src_chunk"))
    dst = of.select(func, F.col("s").alias("dst"), F.col("chunk_index").alias("dst_chunk"))
    links = edges.join(src, [func, "src"]).join(dst, [func, "dst"]).where("src_chunk <> dst_chunk")
    return links.select(func, F.col("src_chunk").alias("src"), F.col("dst_chunk").alias("dst")).distinct()


def chunked_statements(statements: DataFrame, most: int = MOST_STATEMENTS, func: str = "func") -> DataFrame:
    """The chunks of :func:`greedy_chunks` and what each holds: start_line and end_line (of its first
    and last line), and the names that it writes and reads.

    A function's statements meet in one task, and no table of statements is broadcast.
    """
    if most < 1:
        raise ValueError("a chunk needs at least one statement")
    own = statements.select(func, *OF_STATEMENT)
    provided = first_providers(own.repartition(func), func).groupBy(func).agg(F.array_sort(F.collect_list(F.struct(F.col("index").cast("int").alias("index"), F.col("provider").cast("int").alias("provider")))).alias("p"))
    whole = own.groupBy(func).agg(F.sort_array(F.collect_list(F.struct(*OF_STATEMENT))).alias("s"))
    starts = provided.hint("merge").join(whole, func).select(func, "s", chunk_starts(F.col("p"), F.lit(most)).alias("starts"))
    each = starts.select(func, F.posexplode(_runs(F.col("s"), F.col("starts"))).alias("chunk_index", "_c"))
    return each.select(func, "chunk_index", "_c.*")


def _runs(s: Column, starts: Column) -> Column:
    """The chunks of one function, an array in order, from its statements and where chunks begin:
    statement_start, statement_end, start_line, end_line, writes, reads."""

    def run(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get(starts, i + 1), F.size(s)) - 1
        own = F.slice(s, start + 1, end - start + 1)
        names = lambda c: F.array_distinct(F.flatten(own[c])).alias(c)
        return F.struct(start.alias("statement_start"), end.alias("statement_end"), F.array_min(own["start_line"]).alias("start_line"), F.array_max(own["end_line"]).alias("end_line"), names("writes"), names("reads"))

    return F.transform(starts, run)


def annotated_chunks(listed: DataFrame, most: int = MOST_STATEMENTS) -> DataFrame:
    """What :func:`annotate` gives for :func:`chunked_statements` and :func:`links_of_chunks`, from a row
    a function with its statements ``s``, their providers and its text's ``lines``, of which each chunk
    has its own.  The other columns stay.  Every row is for itself: nothing is shuffled, and a row of a
    chunk holds nothing of the others."""
    if most < 1:
        raise ValueError("a chunk needs at least one statement")
    own = [c for c in listed.columns if c not in ("s", "lines")]
    starts = listed.select("*", chunk_starts(F.transform("s", lambda x: F.struct(x["index"].alias("index"), x["provider"].alias("provider"))), F.lit(most)).alias("_starts"))
    runs = starts.select(*own, "lines", _runs(F.col("s"), F.col("_starts")).alias("_runs"))

    def linked(r: Column, i: Column) -> Column:
        of = lambda j, c: F.get("_runs", j)[c]
        places = F.sequence(F.lit(0), F.size("_runs") - 1)
        needs = F.filter(places, lambda j: (j < i) & F.arrays_overlap(of(j, "writes"), r["reads"]))
        feeds = F.filter(places, lambda j: (j > i) & F.arrays_overlap(r["writes"], of(j, "reads")))
        kept = [r[c].alias(c) for c in ("statement_start", "statement_end", "start_line", "end_line")]
        lines = F.slice("lines", r["start_line"], r["end_line"] - r["start_line"] + 1)
        return F.struct(*kept, F.sequence(r["statement_start"], r["statement_end"]).alias("statement_indices"), needs.alias("depends_on_chunks"), feeds.alias("depended_on_by_chunks"), lines.alias("lines"))

    each = runs.select(*own, F.posexplode(F.transform("_runs", linked)).alias("chunk_index", "_c"))
    return each.select(*own, "chunk_index", "_c.*")


def links_of_chunks(chunks: DataFrame, func: str = "func") -> DataFrame:
    """The links of :func:`chunk_links` from what chunks write and read: chunks are runs, so a later
    one reads after an earlier one writes, and no edge between statements is made."""
    by = F.collect_set(F.when(F.col("writes"), F.col("chunk_index"))).over(Window.partitionBy(func, "name"))
    named = _named(chunks, func, "chunk_index").withColumn("by", by).where(~F.col("writes"))
    links = named.select(func, F.explode(F.filter("by", lambda b: b < F.col("chunk_index"))).alias("src"), F.col("chunk_index").alias("dst"))
    return links.distinct()


def annotate(chunks: DataFrame, links: DataFrame, func: str = "func") -> DataFrame:
    """Chunks with statement_indices, depends_on_chunks and depended_on_by_chunks, all sorted."""
    needs = links.groupBy(func, F.col("dst").alias("chunk_index")).agg(F.array_sort(F.collect_set("src")).alias("depends_on_chunks"))
    feeds = links.groupBy(func, F.col("src").alias("chunk_index")).agg(F.array_sort(F.collect_set("dst")).alias("depended_on_by_chunks"))
    none = F.array().cast("array<int>")
    out = chunks.join(needs.hint("merge"), [func, "chunk_index"], "left").join(feeds.hint("merge"), [func, "chunk_index"], "left")
    return out.withColumns({
        "statement_indices": F.sequence("statement_start", "statement_end"),
        "depends_on_chunks": F.coalesce(F.col("depends_on_chunks").cast("array<int>"), none),
        "depended_on_by_chunks": F.coalesce(F.col("depended_on_by_chunks").cast("array<int>"), none),
    })


def is_acyclic(deps: Column) -> Column:
    """Whether the graph whose node i points to ``deps[i]`` has no cycle; targets out of range are
    ignored.  In each of n rounds the nodes all of whose targets are gone go."""
    n = F.size(deps)
    nodes = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def round_(left: Column, _: Column) -> Column:
        return F.filter(left, lambda v: F.arrays_overlap(F.get(deps, v), left))

    return F.size(F.aggregate(nodes, nodes, round_)) == 0


def chunk_map(chunks: DataFrame, func: str = "func") -> DataFrame:
    """A row a function: its chunks as an array of structs in order, and whether they are acyclic."""
    entry = F.struct("chunk_index", F.col("id").alias("chunk_id"), F.array("statement_start", "statement_end").alias("statement_range"), F.col("depends_on_chunks").alias("dependencies"), "normalized_code")
    grouped = chunks.groupBy(func).agg(F.array_sort(F.collect_list(entry)).alias("chunks"))
    return grouped.withColumn("dag_valid", is_acyclic(F.col("chunks.dependencies")))
