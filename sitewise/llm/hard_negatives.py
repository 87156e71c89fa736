"""Hard negatives by Fagin's threshold algorithm over sorted component lists."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from sitewise.llm.common import ship, written

_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole(vectors, width, scale):
    """floor(scale * x) of every component, as a matrix ``width`` wide; shorter
    vectors end in zeros. Numbers that a double can't hold exactly, products and
    sums included, are Python's own."""
    out = np.zeros((len(vectors), width), np.float64)
    for row, vector in zip(out, vectors):
        row[: len(vector)] = vector
    out = np.floor(out * scale)
    if len(out) and float(np.abs(out).max(initial=0)) ** 2 * max(width, 1) >= 2.0**52:
        out = np.array([[int(x) for x in row] for row in out.tolist()], object).reshape(out.shape)
    return out


class SortedLists:
    """Candidates, by id, and for each component their order by falling value."""

    def __init__(self, ids, vectors, order=None):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(-vectors, axis=0, kind="stable").T if order is None else order
        self.dims = np.arange(vectors.shape[1])

    def search(self, anchor, done):
        """(scores, seen): threshold algorithm for one anchor.

        Sorted access reads each list from its high end where the anchor's component
        is positive, else from its low end, a stretch at a time; each row met is
        scored whole by random access. No row that isn't met scores above the
        threshold, the product of the anchor and the values read last; ``done(scores,
        seen, threshold)`` tells whether that suffices.
        """
        n = len(self.ids)
        scores, seen = np.zeros(n, self.vectors.dtype if self.vectors.dtype == object else anchor.dtype), np.zeros(n, bool)
        up = anchor > 0
        up = np.asarray(up, bool)
        depth, reach = 0, max(8, n // 64)
        while depth < n and n:
            stop = min(n, reach)
            met = np.zeros(n, bool)
            met[self.order[up, depth:stop].ravel()] = True
            met[self.order[~up, n - stop : n - depth].ravel()] = True
            if not len(self.dims):
                met[:] = True
            new = np.flatnonzero(met & ~seen)
            scores[new] = self.vectors[new] @ anchor
            seen[new] = True
            depth, reach = stop, 2 * stop
            last = np.where(up, self.order[:, stop - 1], self.order[:, n - stop])
            if done(scores, seen, (self.vectors[last, self.dims] * anchor).sum()):
                break
        return scores, seen


def nearest(lists, anchor, own_id, k):
    """Indexes of the ``k`` best rows but the anchor's own; ties by smaller id."""
    others = lists.ids != own_id

    def done(scores, seen, threshold):
        return np.count_nonzero(seen & others & (scores > threshold)) >= k

    scores, seen = lists.search(anchor, done)
    return scores, _best(scores, np.flatnonzero(seen & others), k)


def _best(scores, held, k):
    return held[np.argsort(-scores[held], kind="stable")[:k]]


def in_windows(lists, anchor, positives, low, high, k):
    """Per positive score the indexes of the ``k`` best rows whose hundredfold score
    lies between ``low`` and ``high`` times it; ties by smaller id.

    The search ends once the threshold is strictly below the k-th score found for
    each window, or below the whole window.
    """

    def inside(scores, seen, positive):
        return seen & (100 * scores >= low * positive) & (100 * scores <= high * positive)

    def done(scores, seen, threshold):
        return all(
            100 * threshold < low * p
            or low * p > high * p
            or np.count_nonzero(inside(scores, seen, p) & (scores > threshold)) >= k
            for p in positives
        )

    scores, seen = lists.search(anchor, done)
    return scores, [_best(scores, np.flatnonzero(inside(scores, seen, p)), k) for p in positives]


def _listed(scale):
    """Sorted lists of each shard: ids, vectors and orders."""

    def listed(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                held = sorted(row["rows"], key=lambda r: r["vec_id"])
                width = max(len(r["embedding"]) for r in held)
                vectors = whole([r["embedding"] for r in held], width, scale)
                order = SortedLists(None, vectors).order
                given = np.zeros((len(held), width), np.float64)
                for g, r in zip(given, held):
                    g[: len(r["embedding"])] = r["embedding"]
                rows.append((row["label"], row["part"], [r["vec_id"] for r in held], width, given.tobytes(), order.astype("<i4").tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary()]
            names = ["label", "part", "ids", "width", "vectors", "orders"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return listed


_LISTS = "label long, part long, ids array<bigint>, width int, vectors binary, orders binary"


def _pairs(batch, scale):
    """(lists, anchors) of every row of a batch of block and shard; an anchor is
    (id, vector, its (positive, score) list)."""
    for i in range(batch.num_rows):
        width = batch["width"][i].as_py()
        ids = np.array(batch["ids"][i].as_py(), np.int64)
        given = np.frombuffer(batch["vectors"][i].as_py(), np.float64).reshape(len(ids), width)
        order = np.frombuffer(batch["orders"][i].as_py(), "<i4").reshape(width, len(ids))
        rows = batch["anchors"][i].as_py()
        # components beyond the shorter side add nothing
        vectors = whole([r["embedding"][:width] for r in rows], width, scale)
        candidates = whole(given, width, scale)
        if object in (vectors.dtype, candidates.dtype) or _product(vectors, candidates) >= 2.0**52:
            vectors, candidates = (np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape) for m in (vectors, candidates))
        lists = SortedLists(ids, candidates, order)
        yield lists, [(r["vec_id"], v, r.get("positives") or []) for r, v in zip(rows, vectors)]


def _product(a, b):
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)


def _long(value):
    """A whole number as a long; beyond 64 bits the nearest one."""
    return int(min(max(int(value), _LEAST), _MOST))


def _positives(scale, k):
    def positives(batches):
        for batch in batches:
            out = []
            for lists, anchors in _pairs(batch, scale):
                for own, vector, _ in anchors:
                    scores, best = nearest(lists, vector, own, k)
                    out += [(own, int(lists.ids[i]), _long(scores[i])) for i in best]
            yield _batch(out, ["anchor_id", "positive_id", "positive_score"])

    return positives


def _negatives(scale, low, high, k):
    def negatives(batches):
        for batch in batches:
            out = []
            for lists, anchors in _pairs(batch, scale):
                for own, vector, positives in anchors:
                    levels = [p["positive_score"] for p in positives]
                    scores, found = in_windows(lists, vector, levels, low, high, k)
                    for p, best in zip(positives, found):
                        out += [(own, p["positive_id"], p["positive_score"], int(lists.ids[i]), _long(scores[i])) for i in best]
            yield _batch(out, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return negatives


def _batch(rows, names):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)


def _blocks(anchors, sizes, block):
    """Anchors in blocks of about ``block`` of one label each."""
    dealt = anchors.join(sizes, "label").withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), F.greatest(F.lit(1), F.ceil(F.col("n_anchors") / block)))
    )
    columns = [c for c in ("vec_id", "embedding", "positives") if c in dealt.columns]
    return dealt.groupBy("label", "block", "parts").agg(F.collect_list(F.struct(*columns)).alias("anchors"))


def hard_negatives(
    vectors, anchors, scale=256, positives=5, negatives=3, low=50, high=95, shard_rows=8192, block=1024, blocks_each=16
):
    """Hard negatives: anchor_id, positive_id, rank, negative_id and both scores.

    vectors: (vec_id, label, embedding). ``anchors``: a condition on ``vec_id``. A
    component x counts as ``floor(scale * x)`` and a score is the whole inner product
    with the anchor; higher is better, ties go by smaller id. The positives of an
    anchor are its best ``positives`` other rows of its label; for each, the best
    ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent of
    the positive's are returned, ranked from 1.

    The candidates of a label are dealt to shards of about ``shard_rows`` with a
    sorted list per component each. Anchors travel in blocks, first to the shards of
    their own label, then with their positives' windows to those of the others; each
    meeting is one run of the threshold algorithm per anchor, and its few best rows
    are merged by rank. A label of any size is many shards, and a shard that many
    blocks visit is copied for every ``blocks_each`` of them.

    Rows with a null id, label or vector or a component that is null or not finite
    take no part. An empty vector scores 0; missing components of a shorter one
    count as 0. Rows that repeat an id count once, as the one of least label and
    vector. Scores are exact; beyond 64 bits they are returned as the nearest
    long. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fit, F.lit(False)))
    one = given.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("x")).select("vec_id", "x.label", "x.embedding")
    rows = written(one.withColumn("is_anchor", anchors), "vectors")
    sizes = rows.groupBy("label").agg(
        F.ceil(F.count("*") / shard_rows).cast("long").alias("parts"), F.count_if("is_anchor").alias("n_anchors")
    )
    sizes = written(sizes, "sizes")
    total = sizes.agg(F.sum("parts"), F.sum(F.ceil(F.col("n_anchors") / block))).first()
    shards, blocks = int(total[0] or 0), int(total[1] or 0)
    dealt = rows.join(sizes, "label").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    held = dealt.groupBy("label", "part").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("rows"))
    lists = written(held.mapInArrow(_listed(scale), _LISTS), "lists")

    chosen = rows.where("is_anchor").drop("is_anchor")
    salts = max(1, -(-blocks // blocks_each))
    copies = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64("label", "block"), F.lit(salts)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - F.lit(1).cast("long")))
    near = _blocks(chosen, sizes, block).withColumn("salt", salt).withColumn("part", every(F.col("parts")))
    found = near.join(copies, ["label", "part", "salt"]).select("anchors", "ids", "width", "vectors", "orders")
    found = found.mapInArrow(_positives(scale, positives), "anchor_id long, positive_id long, positive_score long")
    by_score = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = found.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= positives)
    best = best.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    best = written(best, "positives")

    # a block meets every bucket of shards; those of its own label are left out
    searching = chosen.join(best, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    own = _blocks(searching, sizes, block).withColumn("salt", salt).withColumn("bucket", every(F.lit(max(shards, 1)).cast("long")))
    others = copies.withColumnRenamed("label", "other").withColumn("bucket", F.pmod(F.xxhash64("other", "part"), F.lit(max(shards, 1)).cast("long")))
    met = own.join(others, ["bucket", "salt"]).where("label <> other").select("anchors", "ids", "width", "vectors", "orders")
    kinds = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    hard = met.mapInArrow(_negatives(scale, low, high, negatives), kinds)
    by_score = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (
        hard.withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
