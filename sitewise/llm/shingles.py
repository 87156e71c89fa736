"""Word shingles of a text as hashes, and the classes that links make."""

import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sitewise.llm.common import written

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: About 16 MB of words.
_KEPT_WORDS = 1 << 16


class _Words(dict):
    def __missing__(self, word):
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        self[word] = value
        return value


WORDS = _Words()


def shingle_set(text, size=5):
    """Sorted 64-bit hashes of the different ``size``-word shingles of a text, in
    lower case. A text of fewer words is one shingle; one of none has none."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    if len(WORDS) > _KEPT_WORDS:
        WORDS.clear()
    values = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(values) - size + 1)
    mixed = np.full(n, len(values) if len(values) < size else size, np.uint64)
    for k in range(min(size, len(values))):
        mixed = (mixed ^ values[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return mixed[np.r_[True, mixed[1:] != mixed[:-1]]]


def connected(edges):
    """(node, label) of every node of ``edges(a, b)``: the smallest node it reaches.

    Large-star and small-star steps until the edges stand still. Each step is a
    grouped minimum and a join, written to the shared folder; a node with very
    many edges is joined, never gathered.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = written(edges.distinct(), "edges")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(linked.unionAll(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(
                roots.select("node", F.col("node").alias("label"))
            )
        before = state
