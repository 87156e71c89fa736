"""N-gram Jaccard join: MinHash banding, then exact verification."""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from sitewise.llm.common import release, ship, tidy, written
from sitewise.llm.shingles import WORDS, connected, shingle_set


def prefix_length(threshold, trees, recall, longest=12):
    """How far the matched prefixes are shortened: the longest prefix at which a
    pair of similarity ``threshold`` meets in one of the tries often enough."""
    length = longest
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def least_agreement(threshold, values, loss=1e-6):
    """How many of ``values`` MinHash values a pair at the threshold shares but for a
    chance of ``loss``."""
    below, least = 0.0, 0
    while least < values:
        below += math.comb(values, least) * threshold**least * (1 - threshold) ** (values - least)
        if below > loss:
            break
        least += 1
    return least


def prefixes(shingles, trees, length):
    """Per trie a hash of the first ``length`` MinHash values, and a byte of each of
    the values."""
    draw = np.random.default_rng(20240101)
    factors = draw.integers(1, 1 << 62, trees * length, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = draw.integers(0, 1 << 62, trees * length, np.uint64)
    least = np.full(trees * length, np.iinfo(np.uint64).max)
    for a in range(0, len(shingles), 2048):
        mixed = shingles[a : a + 2048, None] * factors + shifts
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    signature = ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()
    least = least.reshape(trees, length)
    out = np.zeros(trees, np.uint64)
    for k in range(length):
        out = (out ^ least[:, k]) * np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(31)
    return out.view(np.int64), signature


def _signed(trees, length, size):
    @tidy(WORDS)
    def signed(batches):
        for batch in batches:
            nodes, keys, signatures, sizes = [], [], [], []
            for text in batch["text"]:
                own = shingle_set(text.as_py() or "", size)
                found, signature = prefixes(own, trees, length) if len(own) else (np.empty(0, np.int64), None)
                nodes.append(xxhash.xxh3_128_hexdigest(own.tobytes()) if len(own) else None)
                keys.append(found.tolist())
                signatures.append(signature)
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(nodes, pa.string()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(signatures, pa.binary()),
                    pa.array(sizes, pa.int64()),
                ],
                ["doc_id", "node", "keys", "signature", "size"],
            )

    return signed


def _signatures(column):
    """A column of signatures as a matrix, one row each."""
    return np.array([np.frombuffer(x.as_py(), np.uint8) for x in column])


def _judged(least):
    """Whether each member of a group agrees with its hub often enough."""

    @tidy()
    def judged(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            near = (_signatures(batch["signature"]) == _signatures(batch["hub_signature"])).sum(axis=1) >= least
            names = ["tree", "prefix", "node", "signature", "hub"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(near)], [*names, "near"])

    return judged


def _agreeing(least):
    """Links between the far members (side 1) and all members (side 2) of each part
    of a group that agree often enough."""

    def agreeing(table):
        table = table.sort_by([(c, "ascending") for c in ("tree", "prefix", "part", "side")])
        marks = list(zip(*[table[c].to_pylist() for c in ("tree", "prefix", "part")]))
        cuts = [i for i in range(len(marks)) if not i or marks[i] != marks[i - 1]]
        values, names, side = _signatures(table["signature"]), table["node"].to_pylist(), np.asarray(table["side"])
        a, b = [], []
        for start, end in zip(cuts, [*cuts[1:], len(marks)]):
            middle = start + int((side[start:end] == 1).sum())
            left, right = values[start:middle], values[middle:end]
            if not len(left) or not len(right):
                continue
            count = np.zeros((len(left), len(right)), np.uint16)
            for k in range(values.shape[1]):
                count += left[:, k, None] == right[None, :, k]
            reach, other = _local_labels(count >= least, False)
            for i, label in enumerate([*reach, *other]):
                if i != label:
                    a.append(names[start + i])
                    b.append(names[start + label])
        release()
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    return agreeing


def bundled(rows, key, split, rows_each):
    """``rows`` with a ``bundle``: one of its own for each ``key`` where ``split``
    holds, while the other keys share bundles of about ``rows_each`` rows."""
    small = rows.where(~split).count()
    shared = F.pmod(F.xxhash64(*key), F.lit(max(8, -(-small // rows_each))))
    return rows.withColumn("bundle", F.struct(split.alias("own"), F.when(split, F.xxhash64(*key)).otherwise(shared).alias("id")))


def candidate_links(nodes, trees, length, threshold, block):
    """(a, b): links that join every two nodes that share a prefix and whose
    signatures are not well below the threshold.

    The members of a group that are near its hub, the smallest node, are joined to
    it. The others are compared with all members, ``block`` by ``block``, so that
    passages that texts share don't chain them.
    """
    least = least_agreement(threshold, trees * length)
    keyed = nodes.select("node", "signature", F.posexplode("keys").alias("tree", "prefix"))
    groups = keyed.groupBy("tree", "prefix").agg(F.min(F.struct("node", "signature")).alias("h"), F.count("*").alias("n"))
    groups = groups.where("n > 1").select("tree", "prefix", F.col("h.node").alias("hub"), F.col("h.signature").alias("hub_signature"))
    judged = written(
        keyed.join(groups, ["tree", "prefix"])
        .select("tree", "prefix", "node", "signature", "hub", "hub_signature")
        .mapInArrow(_judged(least), "tree int, prefix long, node string, signature binary, hub string, near boolean"),
        "judged",
    )
    far = judged.groupBy("tree", "prefix").agg(
        F.ceil(F.count("*") / block).cast("int").alias("blocks"),
        F.ceil(F.sum(F.when(F.col("near"), 0).otherwise(1)) / block).cast("int").alias("far_blocks"),
    )
    both = judged.join(far.where("far_blocks > 0"), ["tree", "prefix"])
    mark = F.xxhash64("node")
    left = both.where("not near").select(
        "*", F.lit(1).alias("side"), F.pmod(mark, F.col("far_blocks")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long"))).alias("j")
    )
    right = both.select(
        "*", F.lit(2).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("far_blocks") - F.lit(1).cast("long"))).alias("i"), F.pmod(mark, F.col("blocks")).alias("j")
    )
    parts = left.unionAll(right).withColumn("part", F.col("i") * F.col("blocks") + F.col("j"))
    parts = parts.select("tree", "prefix", "part", "side", "node", "signature", ((F.col("blocks") > 1) | (F.col("far_blocks") > 1)).alias("split"))
    found = (
        bundled(parts, ["tree", "prefix", "part"], F.col("split"), 2 * block)
        .groupBy("bundle")
        .applyInArrow(_agreeing(least), "a string, b string")
    )
    near = judged.where("near").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return near.unionAll(found).where("a <> b").distinct()


def _sets(size):
    """Shingles of the rows that hold their node's text; an id may be repeated."""

    @tidy(WORDS)
    def sets(batches):
        for batch in batches:
            found = [shingle_set(text.as_py() or "", size).tobytes() for text in batch["text"]]
            right = [xxhash.xxh3_128_hexdigest(x) == n for x, n in zip(found, batch["node"].to_pylist())]
            names = ["component", "node", "copies", "blocks"]
            rows = pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(found, pa.binary())], [*names, "shingles"])
            yield rows.filter(pa.array(right, pa.bool_()))

    return sets


def overlaps(left, right, columns=2048):
    """Sizes of the intersections of two lists of sorted hash sets, as a matrix."""
    values = np.concatenate(left + right)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.r_[True, values[1:] != values[:-1]]
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    column, owner = column[often[column]], owner[often[column]]
    column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1 if len(column) else column
    out = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        x, y = np.searchsorted(column, [a, a + columns])
        block = np.zeros((len(left) + len(right), columns), np.float32)
        block[owner[x:y], column[x:y] - a] = 1
        out += block[: len(left)] @ block[len(left) :].T
    return out


def _local_labels(linked, same):
    """Smallest index that each row and column of a link matrix reaches; columns
    count after the rows, or are the rows."""
    rows, columns = linked.shape
    row = np.arange(rows)
    column = row if same else np.arange(rows, rows + columns)
    most = rows + columns
    while True:
        best = np.minimum(row, np.where(linked, column, most).min(axis=1, initial=most))
        other = best if same else np.minimum(column, np.where(linked, best[:, None], most).min(axis=0, initial=most))
        if (best == row).all() and (other == column).all():
            return best, other
        row, column = best, other


_SIGNED = "doc_id long, node string, keys array<bigint>, signature binary, size long"
#: Most shingles of a block, about: long texts make smaller blocks.
_BLOCK_SHINGLES = 500_000
_FOUND = "node string, links long, joined string"


def _verify(threshold):
    """Links between the members of each (component, left block, right block)."""

    def rows(members):
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in members["shingles"]]
        copies = np.asarray(members["copies"], np.int64)
        names = members["node"].to_pylist()
        side = np.asarray(members["side"])
        left = np.flatnonzero(side <= 1)
        right = left if (side == 0).all() else np.flatnonzero(side == 2)
        if not len(left) or not len(right):
            return [], [], []
        sizes = np.array([len(s) for s in sets], np.float64)
        inside = overlaps([sets[i] for i in left], [sets[i] for i in right]).astype(np.float64)
        both = sizes[left][:, None] + sizes[right][None, :] - inside
        linked = inside >= threshold * both - 1e-9
        same = right is left
        if same:
            np.fill_diagonal(linked, False)
        reach, other = _local_labels(linked, same)
        name = [names[i] for i in left] + [names[i] for i in right]
        out_n, out_l, out_j = [], [], []
        for index, counts, labels in (
            (left, linked @ copies[right], reach),
            (right, linked.T @ copies[left], other),
        )[: 1 if same else 2]:
            for i, count, label in zip(index, counts, labels):
                if count:
                    out_n.append(names[i])
                    out_l.append(int(count))
                    out_j.append(name[label])
        return out_n, out_l, out_j

    def verify(table):
        table = table.sort_by([("component", "ascending"), ("pair", "ascending")])
        marks = list(zip(table["component"].to_pylist(), table["pair"].to_pylist()))
        cuts = [i for i in range(len(marks)) if not i or marks[i] != marks[i - 1]]
        out = ([], [], [])
        for a, b in zip(cuts, [*cuts[1:], len(marks)]):
            for held, new in zip(out, rows(table.slice(a, b - a))):
                held += new
        release()
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.string()))], ["node", "links", "joined"])

    return verify


def jaccard_join(docs, threshold=0.8, size=5, trees=16, recall=0.9995, block=1000, bundle_members=2000):
    """doc_id, class_id and n_links of every row.

    Rows link when the Jaccard similarity of their ``size``-word shingle sets is at
    least ``threshold``. ``class_id`` is the smallest id that links reach, a chain
    of them included, and ``n_links`` counts the other rows that a row links to.

    Texts with equal sets are one node. A node's MinHash values form ``trees`` bands
    of fixed length, the longest at which pairs at the threshold meet with
    probability ``recall``, and nodes that share a band are
    joined where their signatures are not well below the threshold. Members of each
    candidate component are verified exactly, ``block`` by ``block`` and each pair of
    blocks by itself, so neither pairs nor groups are ever gathered whole and a group
    of any size is split over tasks. Long texts make smaller blocks.

    A null or empty text has no shingles, links to nothing and is its own class;
    so is a row without id, with a null class. Repeated rows link to one another.
    An empty table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    length = prefix_length(threshold, trees, recall)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = written(
        texts.mapInArrow(_signed(trees, length, size), _SIGNED), "signed"
    )
    known = signed.where("node is not null and doc_id is not null")
    nodes = known.groupBy("node").agg(
        F.min("doc_id").alias("first_id"),
        F.count("*").alias("copies"),
        *[F.first(c).alias(c) for c in ("keys", "signature", "size")],
    )
    nodes = written(nodes, "nodes")
    candidates = connected(candidate_links(nodes, trees, length, threshold, block)).withColumnRenamed("label", "component")
    candidates = candidates.join(nodes.select("node", "first_id", "copies", "size"), "node")
    sized = candidates.groupBy("component").agg(
        F.ceil(F.greatest(F.count("*") / block, F.sum("size") / _BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    members = written(candidates.join(sized, "component"), "members")
    chosen = members.withColumnRenamed("first_id", "doc_id")
    mine = texts.join(chosen, "doc_id")
    sets = mine.select("component", "node", "copies", "blocks", "text").mapInArrow(
        _sets(size), "component string, node string, copies long, blocks int, shingles binary"
    ).dropDuplicates(["node"])
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = F.least("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") == left, 1).otherwise(2)
    placed = placed.select(
        "component", "node", "copies", "shingles",
        (left.cast("long") * F.col("blocks") + F.greatest("own", "other")).alias("pair"),
        side.cast("int").alias("side"),
        (F.col("blocks") > 1).alias("split"),
    )
    # a pair of blocks of a large component is a group by itself
    small = members.where("blocks = 1").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bundles = max(8, small[0] // bundle_members, small[1] // (2 * _BLOCK_SHINGLES))
    shared = F.pmod(F.xxhash64("component", "pair"), F.lit(bundles))
    bundle = F.struct("split", F.when(F.col("split"), F.xxhash64("component", "pair")).otherwise(shared).alias("id"))
    found = written(
        placed.withColumn("bundle", bundle)
        .drop("split")
        .groupBy("bundle")
        .applyInArrow(_verify(threshold), _FOUND),
        "links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected(found.select(F.col("node").alias("a"), F.col("joined").alias("b")))
    least = classes.join(nodes.select("node", "first_id"), "node")
    least = least.join(least.groupBy("label").agg(F.min("first_id").alias("class_id")), "label")
    judged = (
        nodes.select("node", "first_id", "copies")
        .join(least.select("node", "class_id"), "node", "left")
        .join(links, "node", "left")
        .select(
            "node",
            F.coalesce("class_id", "first_id").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    out = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    return out.join(judged, "node", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
