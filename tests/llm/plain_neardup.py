"""Near duplicates by comparing all texts, in plain Python and with exact document frequencies.

Shares nothing with the operator but its rules: shingles of five words, an element for each
occurrence, weights between 1 and 1.5 by inverse document frequency in 17 steps.

    python tests/llm/plain_neardup.py /root/testdata/sf0.1     # the operator's recall of links there
"""

import math
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def elements(text):
    """The set of (shingle, how often before)."""
    w = plain_words(text)
    shingles = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}
    return {(s, k) for s, n in shingles.items() for k in range(n)}


def weights(texts):
    """The weight of each shingle, by how many of the texts (all rows, copies too) it is in."""
    own = [{s for s, _ in elements(t)} for t in texts]
    n = sum(map(bool, own))
    df = Counter(s for x in own for s in x)
    rarity = {s: math.log((1 + n) / (1 + c)) / math.log((1 + n) / 2) if n > 1 else 1 for s, c in df.items()}
    return {s: 1 + 0.5 * min(16, max(0, round(16 * r))) / 16 for s, r in rarity.items()}


def similarity(a, b, weight):
    a, b = elements(a), elements(b)
    both = sum(weight[s] for s, _ in a & b)
    return both / (sum(weight[s] for s, _ in a | b) or 1)


def links(texts, least):
    """(a, b, similarity) of all pairs of ids whose similarity is ``least`` or more; of texts with the
    same words only the first is paired with others, and the rest with it."""
    weight = weights(texts.values())
    first, out = {}, []
    for d, t in texts.items():
        if w := tuple(plain_words(t)):
            if first.setdefault(w, d) != d:
                out.append((first[w], d, 1.0))
    ids = list(first.values())
    own = [sorted(elements(texts[d])) for d in ids]
    posting = defaultdict(list)
    for i, x in enumerate(own):
        for e in x:
            posting[e].append(i)
    posting = {e: np.array(v) for e, v in posting.items() if len(v) > 1}
    total = np.array([sum(weight[s] for s, _ in x) for x in own])
    for i, x in enumerate(own):
        shared = [e for e in x if e in posting]
        if shared:
            at = np.concatenate([posting[e] for e in shared])
            by = np.repeat([weight[e[0]] for e in shared], [len(posting[e]) for e in shared])
            common = np.bincount(at, by, len(ids))
            near = common / (total + total[i] - common)
            out += [(ids[j], ids[i], float(near[j])) for j in np.flatnonzero(near >= least).tolist() if j < i]
    return out


def classes(ids, pairs):
    """The least id of each id's class."""
    least = {d: d for d in ids}

    def top(d):
        while least[d] != d:
            least[d] = least[least[d]]
            d = least[d]
        return d

    for a, b, *_ in pairs:
        a, b = sorted((top(a), top(b)))
        least[b] = a
    return {d: top(d) for d in ids}


def brute_force(texts, least=0.8):
    return classes(texts, links(texts, least))


def main(folder):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    from pyspark.sql import SparkSession

    from plumbline.llm import queries

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: r["class_id"] for r in queries.op2_minhash_near_dedup(spark, folder).collect()}
    found = links(texts, 0.7)
    for low, high in ((0.7, 0.75), (0.75, 0.8), (0.8, 0.85), (0.85, 0.95), (0.95, 1.01)):
        band = [(a, b) for a, b, s in found if low <= s < high]
        print(f"similarity {low} to {high}: {len(band)} pairs, {sum(got[a] == got[b] for a, b in band)} in one class")
    want = classes(texts, [x for x in found if x[2] >= 0.8])
    print(f"documents whose class differs from brute force: {sum(got[d] != want[d] for d in texts)} of {len(texts)}")


if __name__ == "__main__":
    main(sys.argv[1])
