"""MinHash near-duplicate detection with weights: improved consistent weighted sampling.

A document is the bag of its shingles of five words (all its words, if fewer), each with a TF-IDF
weight: a shingle that occurs n times is n elements, and an element weighs between 1 (in every
document) and ``1 + IDF_SPAN`` (in one).  Document frequencies come from a count-min sketch over all
documents: ``SKETCH_ROWS`` rows, each less what its median slot holds, of which the least counts.
A row is as wide as the text asks for, up to ``2**SKETCH_BITS`` slots, so what is broadcast stays
below 13 MB; two documents always see the same weight of a shingle, however crowded the slots are.

1. Signatures: ``BANDS x ROWS`` samples a document.  The gamma and uniform variates of a sample are
   read from tables of 2**16 draws, at a hash of the element and the sample's number; weights have
   ``LEVELS`` steps, so a sample costs one look-up an element.
2. Candidates: documents that agree on a whole band.  Exact copies are taken together before, so a
   bucket holds different texts only.  In a bucket of at most ``SMALL`` all pairs are candidates; in
   a larger one each is first paired with its most central members, whose shingles are the most
   frequent (an original is more central than its edited copies), and with all that agree on a second
   large bucket too, by the same rule.  Pairs whose sizes alone rule out the similarity are left out.
3. Verification: candidates' whole texts meet at the more central one, whose group is dealt over
   many tasks if it is large, and the weighted Jaccard similarity is computed in full.  Pairs of
   which it is ``SIMILARITY`` or more are links.
4. Classes: connected components of links, by least labels with pointer jumping.
5. Large buckets: the members of a bucket that are not in its largest class by now are compared with
   all members, in blocks, so that every pair of it is in one class or has been compared in full.

Candidates first go to the more central end only twice a document; the others are verified after
that if their ends are in different classes still.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.decontaminate import words
from plumbline.llm.shared import bounded_batches, discard, scratch, text_slices, written
from plumbline.llm.textbuf import U, grams, mix

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
SMALL = 16
SKETCH_ROWS, LEAST_SKETCH_BITS, SKETCH_BITS = 3, 18, 22
#: Bytes of text for each slot of a row.
SLOT_BYTES = 1 << 10
LEVELS = 17
IDF_SPAN = 0.5
SALT_ROWS = 50
#: Texts, and elements of texts, that a block of a large bucket holds on average.
BLOCK_ROWS, BLOCK_ELEMENTS = 512, 1 << 20
#: Texts to be verified up to which their ids are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1 << 20
#: Elements that two blocks are compared by at a time; sums of so many weights are exact in float32.
COLUMNS = 4096


def slots(shingle: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The slot of each shingle in a row of the sketch: other bits of its hash in each row."""
    return ((shingle << U(21 * row)) >> U(64 - bits)).astype(np.int64)


class Elements:
    """The weighted elements of some texts, sorted by text and then by hash.  ``levels`` is the table
    of :func:`frequency_levels`; without it there are no levels."""

    def __init__(self, texts: pa.Array, levels: np.ndarray | None):
        self.words, self.word_off = words(texts)
        h, off = self.words, self.word_off
        n = np.diff(off)
        g = grams(h, SHINGLE)
        of_word = np.repeat(np.arange(len(n)), n)
        inside = np.flatnonzero(np.arange(len(g)) + SHINGLE <= off[1:][of_word[: len(g)]])
        short = np.flatnonzero((n > 0) & (n < SHINGLE))
        whole = np.array([mix(np.bitwise_xor.reduce(mix(h[off[i] : off[i + 1]] + np.arange(1, n[i] + 1, dtype=U)), keepdims=True))[0] for i in short], U)
        of = np.concatenate([of_word[inside], short])
        shingle = np.concatenate([g[inside], whole])
        order = np.lexsort((shingle, of))
        of, shingle = of[order], shingle[order]
        new = np.ones(len(of), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1])
        start = np.flatnonzero(new)
        nth = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
        element = np.where(nth == 0, shingle, mix(shingle + nth.astype(U) * U(0x9E3779B97F4A7C15)))
        self.distinct = shingle[new]
        if not new.all():
            order = np.lexsort((element, of))
            element, shingle = element[order], shingle[order]
        self.of, self.element = of, element
        self.off = np.searchsorted(of, np.arange(len(n) + 1))
        if levels is not None:
            table = np.atleast_2d(levels)
            bits = table.shape[1].bit_length() - 1
            self.level = np.maximum.reduce([row[slots(shingle, r, bits)] for r, row in enumerate(table)])

    def rows(self, start: int, end: int) -> Elements:
        """Those of the texts from ``start`` to before ``end``."""
        out = object.__new__(Elements)
        lo, hi = self.off[start], self.off[end]
        out.element, out.level, out.of, out.off = self.element[lo:hi], self.level[lo:hi], self.of[lo:hi] - start, self.off[start : end + 1] - lo
        return out


def contents(h: np.ndarray, off: np.ndarray) -> list[bytes | None]:
    """128 bits of each text's words in their order; None for a text without words."""
    at = np.arange(len(h), dtype=U)
    first = np.repeat(off[:-1], np.diff(off)).astype(U)
    sums = [np.concatenate([[U(0)], np.cumsum(mix(h + (at - first + U(1)) * U(k)))]) for k in (0xA24BAED4963EE407, 0x9FB21C651E98DF25)]
    a, b = (mix(s[off[1:]] - s[off[:-1]]) for s in sums)
    raw = np.stack([a, b], 1).tobytes()
    return [raw[16 * i : 16 * i + 16] if n else None for i, n in enumerate(np.diff(off).tolist())]


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sample values and steps by level and draw, and each sample's multiplier (a fixed seed)."""
    rng = np.random.Generator(np.random.PCG64(20))
    n = 1 << 16
    r, c, beta = rng.gamma(2, 1, n), rng.gamma(2, 1, n), rng.uniform(0, 1, n)
    log_w = np.log(1 + IDF_SPAN * np.arange(LEVELS) / (LEVELS - 1))[:, None]
    t = np.floor(log_w / r + beta)
    value = np.log(c) - r * (t - beta + 1)
    odd = rng.integers(1, 1 << 31, BANDS * ROWS, np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    return value.astype(np.float32).ravel(), t.astype(np.int16).ravel(), odd


def signatures(e: Elements) -> np.ndarray:
    """The sampled (element, step) of each text with elements and each sample, as one hash."""
    value, step, odd = _draws()
    full = np.flatnonzero(np.diff(e.off))
    starts = e.off[:-1][full]
    size = np.diff(np.append(starts, len(e.element)))
    base = e.level.astype(np.int64) << 16
    low = (e.element >> U(32)).astype(np.uint32) ^ e.element.astype(np.uint32)
    out = np.empty((len(full), len(odd)), U)
    for k, m in enumerate(odd):
        at = base + ((low * m) >> np.uint32(16))
        v = value[at]
        least = np.flatnonzero(v == np.repeat(np.minimum.reduceat(v, starts), size)) if len(starts) else starts
        least = least[np.searchsorted(least, starts)]  # the smallest element, if several draw the same
        out[:, k] = mix(e.element[least] + step[at[least]].astype(U) * U(0xD6E8FEB86659FD93))
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A hash of each band's samples and number."""
    parts = samples.reshape(len(samples), BANDS, ROWS)
    key = np.zeros((len(samples), BANDS), U) + mix(np.arange(1, BANDS + 1, dtype=U))
    for r in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def sketch_bits(text_bytes: int) -> int:
    """How wide a row of the sketch is for so much text."""
    return min(SKETCH_BITS, max(LEAST_SKETCH_BITS, (text_bytes // SLOT_BYTES).bit_length()))


def frequency_levels(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The weight level of each slot of the sketch's rows, from how many documents fall in it."""
    bounded_batches(docs.sparkSession)
    bits = sketch_bits(docs.agg(F.sum(F.octet_length(text_col))).head()[0] or 0)
    width = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = np.zeros((SKETCH_ROWS, width), np.int64), 0
        for batch in batches:
            for part in text_slices(batch, 0):
                e = Elements(part.column(0), None)
                for r in range(SKETCH_ROWS):
                    np.add.at(seen[r], slots(e.distinct, r, bits), 1)
                texts += int((np.diff(e.off) > 0).sum())
        blocks = seen.reshape(-1, 1 << 12)
        used = np.flatnonzero(blocks.any(1))
        raw = [blocks[b].astype(next(k for k in ("<u2", "<i4", "<i8") if blocks[b].max() <= np.iinfo(k).max)).tobytes() for b in used]
        yield pa.RecordBatch.from_arrays([pa.array([*used, -1], pa.int32()), pa.array([*raw, np.array([texts], "<i8").tobytes()], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, "<i8" if b < 0 else {13: "<u2", 14: "<i4", 15: "<i8"}[len(raw).bit_length() - 1]).astype(np.int64)
                total[b] = total[b] + part if b in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "counts"])

    parts = docs.select(text_col).mapInArrow(count, "block int, counts binary")
    summed = parts.repartition(F.col("block")).mapInArrow(add, "block int, counts binary")
    seen, n = np.zeros(SKETCH_ROWS << bits, np.int64), 0
    for r in summed.toLocalIterator():  # the sketch: 100 MB at most, whatever the input
        part = np.frombuffer(bytes(r["counts"]), "<i8")
        if r["block"] < 0:
            n += int(part[0])
        else:
            seen[r["block"] << 12 : (r["block"] + 1) << 12] += part
    seen = seen.reshape(SKETCH_ROWS, width)
    noise = np.median(seen, axis=1, keepdims=True)  # what a slot holds of rare shingles that are not the one asked for
    df = np.clip(seen - noise, 1, max(n, 1))
    rarity = np.log((1 + n) / (1 + df)) / np.log((1 + max(n, 1)) / 2) if n > 1 else np.ones(df.shape)
    return np.clip(np.round(rarity * (LEVELS - 1)), 0, LEVELS - 1).astype(np.uint8)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two sorted element arrays with levels."""
    (x, lx), (y, ly) = a, b
    if len(x) < len(y):
        (x, lx), (y, ly) = (y, ly), (x, lx)
    if not len(y):
        return 0.0
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = x[at] == y
    step = IDF_SPAN / (LEVELS - 1)
    common, total = both.sum() + step * int(ly[both].sum(dtype=np.int64)), len(x) + len(y) + step * (int(lx.sum(dtype=np.int64)) + int(ly.sum(dtype=np.int64)))
    return float(common / (total - common))


class Block:
    """Some texts' elements by number, to be compared with those of other texts all at once."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]]):
        self.texts = len(texts)
        n = [len(x) for x, _ in texts]
        self.total = np.array(n) + IDF_SPAN / (LEVELS - 1) * np.array([lv.sum(dtype=np.int64) for _, lv in texts])
        element, level = (np.concatenate(x) for x in zip(*texts, strict=True))
        self.vocabulary, first, number = np.unique(element, return_index=True, return_inverse=True)
        self.weight = (1 + IDF_SPAN / (LEVELS - 1) * level[first]).astype(np.float32)
        order = np.argsort(number, kind="stable")
        self.row, self.off = np.repeat(np.arange(self.texts), n)[order], np.searchsorted(number[order], np.arange(len(self.vocabulary) + 1))

    def similarities(self, e: Elements) -> np.ndarray:
        """As :func:`similarity` of each text here (rows) and each of ``e`` (columns)."""
        size = np.diff(e.off)
        total = size + IDF_SPAN / (LEVELS - 1) * np.diff(np.concatenate([[0], np.cumsum(e.level, dtype=np.int64)])[e.off])
        at = np.searchsorted(self.vocabulary, e.element)
        at[at == len(self.vocabulary)] = 0
        hit = np.flatnonzero(self.vocabulary[at] == e.element)
        used, column = np.unique(at[hit], return_inverse=True)
        order = np.argsort(column, kind="stable")
        column, of = column[order], e.of[hit][order]
        weighted = np.zeros((self.texts, len(size)))
        for start in range(0, len(used), COLUMNS):
            part = used[start : start + COLUMNS]
            count = self.off[part + 1] - self.off[part]
            own = np.zeros((self.texts, len(part)), np.float32)
            flat = np.repeat(self.off[part] - np.cumsum(count) + count, count) + np.arange(count.sum())
            own[self.row[flat], np.repeat(np.arange(len(part)), count)] = np.repeat(self.weight[part], count)
            other = np.zeros((len(part), len(size)), np.float32)
            lo, hi = np.searchsorted(column, [start, start + len(part)])
            other[column[lo:hi] - start, of[lo:hi]] = 1
            weighted += own @ other
        with np.errstate(invalid="ignore"):
            return weighted / (self.total[:, None] + total - weighted)


def _sketches(docs: DataFrame, id_col: str, text_col: str, levels) -> DataFrame:
    """Of each document with an id and words: its id, mark (a hash of its text), node (its content),
    size, central and bands."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                e = Elements(part.column(1), levels.value)
                full = np.flatnonzero(np.diff(e.off))
                if not len(full):
                    continue
                node = contents(e.words, e.word_off)
                central = -np.add.reduceat(e.level.astype(np.float64), e.off[:-1][full]) / np.diff(e.off)[full]
                keys = band_keys(signatures(e)).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
                own, mark = (part.column(c).take(pa.array(full)) for c in (0, 2))
                yield pa.RecordBatch.from_arrays([own, mark, pa.array([node[i] for i in full], pa.binary()), pa.array(np.diff(e.off)[full], pa.int64()), pa.array(central), bands], names=["id", "mark", "node", "size", "central", "bands"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    return rows.mapInArrow(sketch, f"id {kind}, mark bigint, node binary, size bigint, central double, bands array<bigint>")


def _may_be_near(a: tuple[Column, Column], b: tuple[Column, Column], threshold: float) -> Column:
    """Whether two texts' (size, central) allow for the similarity: none is above the ratio of the two
    weights."""
    x, y = (size * (1 - IDF_SPAN / (LEVELS - 1) * central) for size, central in (a, b))
    return F.least(x, y) >= (threshold - 1e-9) * F.greatest(x, y)


def _bucket_edges(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """From (key, node, central, size): candidate edges (a more central than b), and the rows of
    buckets too large for all pairs."""
    me = F.struct("central", "node", "size")
    half = F.pmod(F.xxhash64("node"), F.lit(2))
    buckets = rows.groupBy("key").agg(
        F.count("*").alias("n"), F.max(me).alias("t0"), F.max(F.when(half == 0, me)).alias("t1"), F.max(F.when(half == 1, me)).alias("t2")
    ).where("n > 1")
    buckets = written(buckets, "buckets")  # a join with a plain table can be split where one bucket is huge
    joined = rows.join(buckets, "key")
    large = joined.where(F.col("n") > SMALL)
    star = large.select(F.explode(F.array_distinct(F.array_compact(F.array("t0", "t1", "t2")))).alias("a"), me.alias("b")).where("b < a")
    lists = joined.where(F.col("n") <= SMALL).repartition("key").groupBy("key").agg(F.array_sort(F.collect_list(me)).alias("m"))  # SMALL at most
    tails = F.flatten(F.transform("m", lambda b, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda a: F.struct(a.alias("a"), b.alias("b")))))
    pairs = star.unionByName(lists.select(F.explode(tails).alias("p")).select("p.*"))
    near = _may_be_near((F.col("a.size"), F.col("a.central")), (F.col("b.size"), F.col("b.central")), threshold)
    return pairs.where(near).select(F.col("a.node").alias("a"), F.col("a.central").alias("a_central"), F.col("b.node").alias("b")), large.select("key", "node", "central", "size")


def candidates(nodes: DataFrame, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Distinct edges (a, b, a_central) between nodes that agree on a band, and the rows (key, node,
    central, size) of the buckets of which these are not all pairs."""
    rows = nodes.select("node", "central", "size", F.explode("bands").alias("key"))
    edges, large = _bucket_edges(rows, threshold)
    large = written(large, "large-buckets")
    keys = large.groupBy("node", "central", "size").agg(F.array_sort(F.collect_set("key")).alias("k"))  # BANDS at most
    twice = F.transform(F.slice("k", 2, BANDS), lambda y, i: F.xxhash64(F.get("k", i), y))
    more, _ = _bucket_edges(keys.where(F.size("k") > 1).select("node", "central", "size", F.explode(twice).alias("key")), threshold)
    return edges.unionByName(more).groupBy("a", "b").agg(F.first("a_central").alias("a_central")), large


def verify(edges: DataFrame, texts: DataFrame, levels, threshold: float = SIMILARITY) -> DataFrame:
    """The edges (a, b) of which the whole texts (node, text) are similar enough, and how similar."""
    texts = texts.select(F.col("node").alias("own"), "text")
    salts = (F.col("n") / SALT_ROWS).cast("int")
    per = written(edges.groupBy("a").agg(F.count("*").alias("n")), "heads")  # plain, so that a huge group's join can be split
    head = texts.join(per, texts["own"] == per["a"]).select("a", F.explode(F.sequence(F.lit(0), salts)).alias("salt"), F.lit(0).alias("role"), F.lit(None).cast("binary").alias("b"), "text")
    body = edges.join(per, "a").select("a", "b", F.pmod(F.xxhash64("b"), salts + 1).cast("int").alias("salt"))
    body = texts.join(body, texts["own"] == body["b"]).select("a", "salt", F.lit(1).alias("role"), "b", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, at = None, None
        for batch in batches:
            for part in text_slices(batch, 4):
                e = Elements(part.column(4), levels.value)
                a, salt, role, b = (part.column(c).to_pylist() for c in range(4))
                found: list[tuple] = []
                for i in range(part.num_rows):
                    own = (e.element[e.off[i] : e.off[i + 1]], e.level[e.off[i] : e.off[i + 1]])
                    if role[i] == 0:
                        head, at = tuple(x.copy() for x in own), (a[i], salt[i])
                    elif at == (a[i], salt[i]):
                        near = similarity(head, own)
                        if near >= threshold:
                            found.append((a[i], b[i], near))
                if found:
                    cols = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2])], names=["a", "b", "similarity"])

    return head.unionByName(body).repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(compare, "a binary, b binary, similarity double")


def verify_apart(large: DataFrame, texts: DataFrame, roots: DataFrame, levels, threshold: float = SIMILARITY) -> DataFrame:
    """Links (a, b, similarity) between texts of different classes (node, root) that share a large bucket
    (key, node, size): one at least for each two classes that have any.  Of each bucket, those outside
    its largest class meet all its members; what grows with the square of a bucket are sums of matrices,
    and rows only with a block's share of it."""
    member = large.select("key", "node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    member = written(member, "members")
    of_root = member.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    blocks = lambda rows, size: F.ceil(F.greatest(rows / BLOCK_ROWS, size / BLOCK_ELEMENTS)).cast("int")
    most = F.max(F.struct("n", "root", "size"))
    per = of_root.groupBy("key").agg(most.alias("most"), F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("classes > 1")
    per = written(per.select("key", F.col("most.root").alias("main"), blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("heads"), blocks(F.col("n"), F.col("size")).alias("bodies")), "mixed-buckets")  # plain, so that a huge bucket's join can be split
    rows = member.join(per, "key")
    own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    head = rows.where("root != main").select("key", own("heads", 1).alias("head"), each("bodies").alias("body"), F.lit(0).alias("role"), "root", "node")
    body = rows.select("key", each("heads").alias("head"), own("bodies", 2).alias("body"), F.lit(1).alias("role"), "root", "node")
    placed = head.unionByName(body).join(texts, "node").select("key", "head", "body", "role", "root", "node", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads, head_root, head_node, block, joined = None, [], [], [], None, {}

        def top(x: bytes) -> bytes:
            while (up := joined.get(x, x)) != x:
                joined[x] = joined.get(up, up)
                x = up
            return x

        for batch in batches:
            for part in text_slices(batch, 6):
                e = Elements(part.column(6), levels.value)
                unit = list(zip(*(part.column(c).to_pylist() for c in range(3)), strict=True))
                role, root, node = (part.column(c).to_pylist() for c in (3, 4, 5))
                found: list[tuple[bytes, bytes, float]] = []
                i = 0
                while i < len(unit):
                    if unit[i] != at:
                        at, heads, head_root, head_node, block, joined = unit[i], [], [], [], None, {}
                    end = i + 1
                    while end < min(len(unit), i + BLOCK_ROWS) and unit[end] == at and role[end] == role[i]:
                        end += 1
                    if role[i] == 0:
                        heads += [(e.element[e.off[k] : e.off[k + 1]].copy(), e.level[e.off[k] : e.off[k + 1]].copy()) for k in range(i, end)]
                        head_root += root[i:end]
                        head_node += node[i:end]
                    elif heads:
                        block = block or Block(heads)
                        near = block.similarities(e.rows(i, end))
                        code = {r: k for k, r in enumerate(dict.fromkeys(head_root + root[i:end]))}
                        x, y = np.array([code[r] for r in head_root]), np.array([code[r] for r in root[i:end]])
                        h, b = np.nonzero((near >= threshold) & (x[:, None] != y))
                        pair = x[h] * len(code) + y[b]
                        order = np.lexsort((-near[h, b], pair))
                        for k in order[np.append(True, np.diff(pair[order]) != 0)[: len(order)]].tolist():
                            p, q = top(head_root[h[k]]), top(root[i + b[k]])
                            if p != q:  # a pair that others join already adds nothing
                                joined[p] = q
                                found.append((head_node[h[k]], node[i + b[k]], float(near[h[k], b[k]])))
                    i = end
                if found:
                    a, b, near = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(near)], names=["a", "b", "similarity"])

    return placed.repartition("key", "head", "body").sortWithinPartitions("key", "head", "body", "role", "node").mapInArrow(compare, "a binary, b binary, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link: root is the least node of its component.  Each round
    spreads least labels over links and then jumps to the label's label; the number of rounds grows
    with the logarithm of a component's width."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step = written(step.join(up, "root", "left").select("node", "old", F.least(F.col("root"), F.coalesce("far", "root")).alias("root")), "labels")
        discard(labels)
        labels = step.select("node", "root")
        if step.where("old != root").isEmpty():
            discard(both)
            return labels


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The sketches of all documents with an id and words, and of each of their nodes: node, id (the
    least with it), root (of its class), class_id, near_id and similarity (of a copy or its closest link, or null)."""
    with scratch(docs.sparkSession):
        return _class_tables(docs, id_col, text_col, threshold)


def _class_tables(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, text_col))
    sketches = written(_sketches(docs, id_col, text_col, levels), "sketches", keep=True)
    nodes = written(sketches.groupBy("node").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("size").alias("size"), F.first("central").alias("central"), F.first("bands").alias("bands")), "nodes")
    edges, large = candidates(nodes, threshold)
    edges = written(edges, "candidates")

    wanted = written(edges.select(F.explode(F.array("a", "b")).alias("node")).union(large.select("node")).distinct().join(nodes.select("node", "id"), "node"), "wanted")
    texts = written(_texts_of(docs, wanted, id_col, text_col), "candidate-texts")
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("a_central"), "a"))
    ranked = written(edges.withColumn("k", best), "ranked")
    links = [written(verify(ranked.where("k <= 2"), texts, levels, threshold), "links")]
    roots = components(links[0])
    rest = ranked.where("k > 2").select("a", "b")
    for end in ("a", "b"):
        rest = rest.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    rest = written(rest.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"), "rest")

    def add(more: DataFrame, roots: DataFrame) -> DataFrame:
        links.append(written(more, "links"))
        if links[-1].isEmpty():
            return roots
        discard(roots)
        return components(_all(links))

    if not rest.isEmpty():
        roots = add(verify(rest, texts, levels, threshold), roots)
    if not large.isEmpty():
        roots = add(verify_apart(large, texts, roots, levels, threshold), roots)

    named = nodes.select("node", "id", "last").join(roots, "node", "left").select("node", "id", "last", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("class_id"))
    both = _all(links).select("a", "b", "similarity").union(_all(links).select("b", "a", "similarity"))
    closest = both.join(nodes.select(F.col("node").alias("b"), "id"), "b").groupBy(F.col("a").alias("node")).agg(F.min(F.struct((-F.col("similarity")).alias("far"), "id")).alias("near"))
    out = named.join(least, "root").join(closest, "node", "left")
    copies = F.col("last") != F.col("id")
    near_id, near = F.when(copies, F.col("last")).otherwise(F.col("near.id")), F.when(copies, 1.0).otherwise(-F.col("near.far"))
    return sketches, written(out.select("node", "id", "root", "class_id", near_id.alias("near_id"), near.alias("similarity")), "classes", keep=True)


def _all(links: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row a document: the id column; class_id, the least id among the documents that links of
    ``threshold`` or more join, directly or through others; near_id and similarity, the closest
    document that it was compared with and found near, and how near (1 for a copy); null if there
    is none.  Pairs that are in one class by other links need not have been compared.

    Texts with the same words in the same order (small letters, without punctuation) are copies: of
    them, all but the least id have that as near_id, and that has the greatest.  A document without words (null, empty, signs
    only) is a class by itself.  Rows with a null id have a null class.  Repeated rows have a row
    each; rows that share an id but not a text are judged each by its text.
    """
    sketches, classes = _classes(docs, id_col, text_col, threshold)
    copy = F.col("own") != F.col("id")
    rows = sketches.select(F.col("id").alias("own"), "node").join(classes, "node")
    with_words = rows.select(
        F.col("own").alias(id_col), "class_id", F.when(copy, F.col("id")).otherwise(F.col("near_id")).alias("near_id"),
        F.when(copy, 1.0).otherwise(F.col("similarity")).alias("similarity"),
    )
    alone = _without_words(docs, id_col, text_col)
    return with_words.unionByName(alone.withColumns({"near_id": F.lit(None).cast(alone.schema[id_col].dataType), "similarity": F.lit(None).cast("double")}))


def _texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) for the wanted nodes, each from the document that stands for it.  Only texts with
    a wanted id are hashed and moved."""
    kind = docs.schema[id_col].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                node = contents(*words(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node, pa.binary()), part.column(1).cast(pa.string())], names=["id", "node", "text"])

    ids = wanted.select(F.col("id").alias("_wanted")).distinct()
    if wanted.count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = rows.join(ids, rows["id"] == ids["_wanted"], "left_semi").mapInArrow(name, f"id {kind}, node binary, text string")
    return named.join(wanted, ["id", "node"]).groupBy("node").agg(F.min("text").alias("text"))


def _wordless(text_col: str) -> Column:
    return F.col(text_col).isNull() | ~F.col(text_col).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def _without_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNull() | _wordless(text_col)).select(F.col(id_col), F.col(id_col).alias("class_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One document of each class of :func:`near_duplicates`, with all its columns: the one with the
    least id, and, if several texts of the class have it, one of these texts.

    Rows are told apart by id and text: an id that also has a text of another class stays or goes with
    each text by itself.  Equal rows are one row; rows that share id and text but differ elsewhere all
    stay or go together.  Rows with a null id and documents without words stay.
    """
    sketches, classes = _classes(docs, id_col, text_col, threshold)
    rows = sketches.select(F.col("id").alias("own"), "mark", "node").join(classes.select("node", "root", "class_id"), "node").where("own = class_id")
    text = rows.groupBy("root", "class_id").agg(F.min(F.struct("node", "mark")).alias("of"))
    kept = text.select(F.col("class_id").alias("_id"), F.col("of.mark").alias("_mark"))
    able = docs.where(F.col(id_col).isNotNull() & ~_wordless(text_col))
    stay = able.join(kept, (able[id_col] == kept["_id"]) & (F.xxhash64(able[text_col]) == kept["_mark"]), "left_semi")
    alone = docs.where(F.col(id_col).isNotNull() & _wordless(text_col))
    comparable = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return stay.unionByName(alone).dropDuplicates(comparable).unionByName(docs.where(F.col(id_col).isNull()))
