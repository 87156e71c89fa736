"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming
blocks, exact weighted-shingle similarity. Native expressions only."""

from pyspark.sql import functions as F

from sitewise.llm.common import let, words_of, written

#: 64 fingerprint bits in blocks of 8. Two fingerprints at most 23 bits apart have a
#: block at most 2 bits apart, so looking up every block value within 2 bits of an
#: item's finds them all.
_BLOCKS, _WIDTH, _FLIPS = 8, 8, 2
RADIUS = _BLOCKS * (_FLIPS + 1) - 1


def shingle_hashes(text, size):
    """Hashes of the ``size``-word shingles of a text in lower case, in order."""

    def grams(w):
        found = F.transform(
            F.sequence(F.lit(0), F.size(w) - size),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]),
        )
        return F.when(F.size(w) >= size, found).otherwise(F.array().cast("array<bigint>"))

    return let(words_of(F.lower(text)), grams)


def _majorities(hashes, width):
    """The bits that more than half of the hashes have, counted in ``width`` sums of
    64 / ``width`` lanes."""
    lanes = range(64 // width)
    ones, full = F.lit(sum(1 << width * lane for lane in lanes)), F.lit((1 << width) - 1)
    zero = F.struct(*[F.lit(0).cast("bigint").alias(f"s{k}") for k in range(width)])

    def add(a, h):
        parts = [F.shiftrightunsigned(h, k).bitwiseAND(ones) for k in range(width)]
        return F.struct(*[(a[f"s{k}"] + parts[k]).alias(f"s{k}") for k in range(width)])

    def bits(a, n):
        out = F.lit(0).cast("bigint")
        for k in range(width):
            for lane in lanes:
                count = F.shiftrightunsigned(a[f"s{k}"], width * lane).bitwiseAND(full)
                bit = F.shiftleft((2 * count > n).cast("bigint"), k + width * lane)
                out = out.bitwiseOR(bit)
        return out

    return let(F.aggregate(hashes, zero, add), lambda a: bits(a, F.size(hashes)))


def simhash(hashes):
    """64-bit SimHash of an array of hashes, each weighted by its occurrences.

    The 64 bit counts are kept in 16 sums of four 16-bit lanes, which takes 16
    additions per hash. A sum is signed, so the top lane counts to 32,767: longer
    arrays take 32 sums of two lanes.
    """
    return F.when(F.size(hashes) < 1 << 15, _majorities(hashes, 16)).otherwise(_majorities(hashes, 32))


def _block(fingerprint, i):
    return F.shiftrightunsigned(fingerprint, _WIDTH * i).bitwiseAND(F.lit((1 << _WIDTH) - 1)).cast("int")


def near_blocks(fingerprint):
    """Array of (block, value): every value within the flips of each block."""
    masks = [m for m in range(1 << _WIDTH) if m.bit_count() <= _FLIPS]
    return F.flatten(F.array(*[_flipped(fingerprint, i, masks) for i in range(_BLOCKS)]))


def _flipped(fingerprint, i, masks):
    own = _block(fingerprint, i)
    return F.transform(
        F.array(*[F.lit(m) for m in masks]),
        lambda m: F.struct(F.lit(i).alias("block"), own.bitwiseXOR(m).alias("value")),
    )


def weighted_overlap(a, b):
    """Size of the intersection of two arrays as multisets."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    count = lambda x, g: F.size(F.filter(x, lambda y: y == g))
    counted = F.aggregate(
        F.array_intersect(a, b), F.lit(0), lambda n, g: n + F.least(count(a, g), count(b, g))
    )
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)


def _small(df, rows):
    """``df`` marked for broadcast if it was counted and is small."""
    return F.broadcast(df) if df.count() <= rows else df


def find_leaks(docs, items, threshold=0.8, size=5, broadcast_rows=200_000):
    """(doc_id, item_id, similarity, start_word) of the documents that hold an item.

    docs: (doc_id, text, ...), items: (item_id, text, ...). A window of a document
    has as many words as the item, or all of a shorter document's. The similarity
    is the Jaccard of the multisets of ``size``-word shingles in lower case; the
    best window of a document that reaches ``threshold``, the first of equals, is
    returned per item.

    A window that similar holds one of any ``1 - threshold`` of an item's shingles
    and one more, so only windows around those are made. Their SimHash is looked
    up in blocks of the items' fingerprints, which finds every one within
    ``RADIUS`` bits, far beyond what the threshold allows, and pairs are verified
    exactly. Items travel to the tasks only while they number at most
    ``broadcast_rows`` rows, else both sides are shuffled.

    Texts and items may be of any length; a long text is one row, of which only the
    windows around shared shingles are made.
    Null texts are empty; items of fewer than ``size`` words, and null ids, are
    never found; rows equal in id and text count once; repeated items are found
    alike; empty tables give an empty result; other columns are ignored.
    """
    items = items.where("item_id is not null").select("item_id", shingle_hashes(F.col("text"), size).alias("item"))
    items = items.where(F.size("item") > 0).distinct()
    items = written(items.select("item_id", "item", F.size("item").alias("n_item"), simhash(F.col("item")).alias("item_print")), "items")
    anchors = items.select(
        "item_id", "n_item",
        F.explode(
            F.slice(F.array_sort("item"), 1, (F.size("item") - F.ceil(threshold * F.size("item") - 1e-9) + 1).cast("int"))
        ).alias("gram"),
    ).distinct()
    texts = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    # grams of every text meet the items' anchors
    placed = texts.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(shingle_hashes(F.col("text"), size)).alias("place", "gram")
    )
    near = placed.join(_small(written(anchors, "anchors"), broadcast_rows), "gram")
    starts = near.groupBy("doc_id", "text_hash", "n_item").agg(F.collect_set("place").alias("places"))
    starts = written(starts, "starts").withColumnRenamed("doc_id", "_doc")
    again = texts.withColumn("_hash", F.xxhash64("text")).join(
        starts, (F.col("doc_id") == F.col("_doc")) & (F.col("_hash") == F.col("text_hash"))
    ).dropDuplicates(["doc_id", "text_hash", "n_item"])
    # windows of n_item shingles that hold one of the places
    held = again.select("doc_id", "text_hash", "n_item", "places", shingle_hashes(F.col("text"), size).alias("grams"))
    last = F.greatest(F.size("grams") - F.col("n_item"), F.lit(0))
    around = F.flatten(
        F.transform(
            "places",
            lambda p: F.sequence(
                F.least(F.greatest(p - F.col("n_item") + 1, F.lit(0)), last), F.least(p, last)
            ),
        )
    )
    windows = held.select(
        "doc_id", "text_hash", "n_item",
        F.explode(
            let(F.col("grams"), lambda g: F.transform(
                F.array_distinct(around),
                lambda s: F.struct(s.alias("start_word"), F.slice(g, s + 1, F.col("n_item")).alias("window")),
            ))
        ).alias("w"),
    ).select("doc_id", "text_hash", "n_item", "w.*")
    printed = windows.withColumn("print", simhash(F.col("window")))
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), _block(F.col("print"), i).alias("value")) for i in range(_BLOCKS)])
    index = written(items.select("*", F.explode(near_blocks(F.col("item_print"))).alias("b")).select(
        F.col("item_id"), "item", "n_item", "item_print", "b.block", "b.value"
    ), "index")
    pairs = (
        printed.select("*", F.explode(blocks).alias("b"))
        .select("*", "b.block", "b.value").drop("b")
        .join(_small(index, broadcast_rows), ["n_item", "block", "value"])
    )
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    # of the blocks that meet, the first stands for the pair
    earlier = F.lit(False)
    for i in range(_BLOCKS):
        close = F.bit_count(_block(F.col("print"), i).bitwiseXOR(_block(F.col("item_print"), i))) <= _FLIPS
        earlier = earlier | ((F.lit(i) < F.col("block")) & close)
    both = weighted_overlap(F.col("window"), F.col("item"))
    similar = both / (F.size("window") + F.size("item") - both)
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("back")))
    return (
        pairs.where((distance <= RADIUS) & ~earlier)
        .withColumn("similarity", similar)
        .where(F.col("similarity") >= threshold)
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(best.alias("best"))
        .groupBy("doc_id", "item_id")
        .agg(F.max("best").alias("best"))
        .select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).cast("bigint").alias("start_word"))
    )
