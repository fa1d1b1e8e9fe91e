"""Bounded samples of labelled texts for fitting, and the fold that is never learned from."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import discard, written

FOLDS = 4
HELD_OUT = 2
#: Labels that a model can be fitted for; more are refused, never left out.
MOST_LABELS = 1024


def held_out(id_col: str) -> Column:
    """Whether a row belongs to the held-out fold: crc32 of its id as text, modulo 4, is 2.  A null
    id is in no fold: it is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _fitting(sizes: list[tuple[int, int]], most: int) -> list[int]:
    """Of (place, size), in order of place, the places of those that fit into ``most`` together, each
    that does not being passed over; the smallest alone, if none fits."""
    kept, left = [], most
    for k, size in sizes:
        if size <= left:
            kept.append(k)
            left -= size
    return kept or [min(sizes, key=lambda x: (x[1], x[0]))[0]]


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, rows: int, most_bytes: int,
    id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", most_labels: int = MOST_LABELS,
) -> tuple[dict, dict[object, list[str]]]:
    """How many learnable documents each label has, and whole texts of a sample of them.

    Learnable is an id outside the held-out fold that has a label and a text; an id that repeats with
    a label counts once, with its least text.  The sample has at most ``rows`` texts a label (less
    if there are more than 40 labels, but 20 at least) and ``most_bytes`` bytes of text in all,
    equally shared by the labels; which ones depends on a hash of the id only, not on the order of
    the input.  A text that does not fit into what is left of its label's share is passed over; only
    a label none of whose drawn texts fits is learned from the shortest of them, over its share.
    Raises ValueError if there are more than ``most_labels`` labels.
    """
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    told = labels.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull() & ~held_out(label_id)).select(F.col(label_id).alias("_id"), F.col(label_col).alias("_label"))
    own = told.distinct().join(texts.select("_id").distinct(), "_id", "left_semi")
    counts = {r["_label"]: r["n"] for r in own.groupBy("_label").agg(F.count("*").alias("n")).orderBy("_label").limit(most_labels + 1).collect()}
    if not counts:
        return {}, {}
    if len(counts) > most_labels:
        raise ValueError(f"{label_col} has more than {most_labels} values; set most_labels")
    rows = max(20, min(rows, 40 * rows // len(counts)))
    draw = (F.xxhash64("_id").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)).alias("_draw")
    share = F.broadcast(docs.sparkSession.createDataFrame([(label, 1.5 * rows / n) for label, n in counts.items()], own.select("_label", F.lit(0.0).alias("_share")).schema))
    near = own.select("_id", "_label", draw).join(share, "_label").where("_draw < _share")
    first = near.withColumn("_k", F.row_number().over(Window.partitionBy("_label").orderBy("_draw", "_id"))).where(F.col("_k") <= rows)
    held = texts.join(F.broadcast(first), "_id").groupBy("_label", "_k").agg(F.min("_text").alias("_text"))  # the broadcast has labels x rows at most
    held = written(held, "sample")  # labels x rows at most
    sizes: dict[object, list[tuple[int, int]]] = defaultdict(list)
    for r in held.select("_label", "_k", F.octet_length("_text").alias("n")).orderBy("_label", "_k").collect():
        sizes[r["_label"]].append((r["_k"], r["n"]))
    kept = [(label, k) for label, each in sizes.items() for k in _fitting(each, most_bytes // len(counts))]
    chosen = F.broadcast(docs.sparkSession.createDataFrame(kept, held.select("_label", "_k").schema))
    sample: dict[object, list[str]] = defaultdict(list)
    for r in held.join(chosen, ["_label", "_k"]).orderBy("_label", "_k").toLocalIterator():
        sample[r["_label"]].append(r["_text"])
    discard(held)
    return counts, dict(sample)
