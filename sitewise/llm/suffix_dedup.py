"""Suffix-array removal of byte strings that an earlier document holds."""

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from sitewise.llm.common import ship, written

#: Stands for a null id: later than every other document.
_LAST = np.iinfo(np.int64).max
_ANCHOR = 24


def words_at(data, order="<"):
    """The 8 bytes from each position as one number; ``data`` must be padded."""
    return np.ndarray((len(data) - 8,), f"{order}u8", data, strides=(1,))


def anchors(data, length):
    """Per position the smallest hash of a 24-byte string inside the ``length``
    bytes from there. Equal strings have equal anchors, and neighbours mostly the
    same one, so runs of positions travel together. The smallest of many hashes is
    mostly a small number; multiplied by an odd one, which keeps different anchors
    apart, its leading bits are even, and so are the groups that they deal."""
    low = words_at(data)
    mixed = low[:-16] * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed += low[8:-8]
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(30)
    mixed += low[16:]
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    span, reach = length - _ANCHOR + 1, 1
    while 2 * reach <= span:
        mixed = np.minimum(mixed[:-reach], mixed[reach:])
        reach *= 2
    least = np.minimum(mixed[: len(mixed) - (span - reach)], mixed[span - reach :])
    least *= np.uint64(0x9E3779B97F4A7C15)
    return least


def suffix_order(data, n):
    """Suffix array of the first ``n`` positions.

    Larsson-Sadakane: ranks by the first 8 bytes, then only the groups that still
    tie are sorted again by the rank of the position as many bytes further on,
    which doubles the sorted length, until none ties. (Kasai's bound holds for the
    whole order only.)
    """
    first = words_at(data, ">")[:n]
    order = np.argsort(first)
    keys = first[order]
    rank = np.empty(n, np.int64)
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[heads, n])
    # a group's rank is the place of its first member
    rank[order] = np.repeat(heads, sizes)
    tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
    sorted_to = 8
    while len(tied):
        members = order[tied]
        ahead = members + sorted_to
        far = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        group = rank[members]
        by = np.lexsort((far, group)) if n > 1 << 31 else np.argsort(group * (n + 1) + far + 1)
        members, far, group = members[by], far[by], group[by]
        order[tied] = members
        new = np.r_[True, (group[1:] != group[:-1]) | (far[1:] != far[:-1])]
        heads = np.flatnonzero(new)
        sizes = np.diff(np.r_[heads, len(members)])
        rank[members] = np.repeat(tied[heads], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        sorted_to *= 2
    return order


def common_prefixes(data, order, cap, lanes_of=256):
    """Kasai: the bytes that each suffix shares with the one before it, to ``cap``.

    Walking the text, the value drops by one at most from a position to the next.
    Stretches of ``lanes_of`` positions walk side by side.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(n, np.int64)
    at = np.arange(0, n, lanes_of)
    stop = np.minimum(at + lanes_of, n)
    shared = np.zeros(len(at), np.int64)
    while len(at):
        other = before[at]
        more = (other >= 0) & (shared < cap)
        here, there = at + shared, other + shared
        more &= (here < n) & (there < n)
        more[more] = raw[here[more]] == raw[there[more]]
        shared += more
        done = ~more
        out[at[done]] = np.where(other[done] >= 0, shared[done], 0)
        at += done
        shared = np.where(done, np.maximum(shared - 1, 0), shared)
        going = at < stop
        if not going.all():
            at, stop, shared = at[going], stop[going], shared[going]
    return out[order]


def classes(data, n, starts_ok, length):
    """(positions, class of each): suffixes of ``length`` bytes that are equal.

    Only positions where ``starts_ok`` holds, in suffix order; classes rise.
    """
    order = suffix_order(data, n)
    apart = common_prefixes(data, order, length) < length
    label = np.cumsum(apart)
    mine = starts_ok[order]
    return order[mine], label[mine]


def repeated(hashes, docs):
    """Mask of the hashes that two different documents hold."""
    order = np.argsort(hashes)
    h, d = hashes[order], docs[order]
    heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    if not len(h):
        return np.zeros(0, bool)
    several = np.minimum.reduceat(d, heads) != np.maximum.reduceat(d, heads)
    out = np.empty(len(h), bool)
    out[order] = np.repeat(several, np.diff(np.r_[heads, len(h)]))
    return out


def gathered(data, starts, lengths):
    """Bytes of the given stretches, joined and padded, and where each begins."""
    begins = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    index = np.arange(total) + np.repeat(starts - begins, lengths)
    return np.frombuffer(data, np.uint8)[index].tobytes() + bytes(16), begins


def window_runs(hashes, wanted, doc_of):
    """(first, count) of runs of wanted windows with one anchor and one document."""
    cut = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc_of[1:] != doc_of[:-1]) | ~wanted[:-1]]
    first = np.flatnonzero(cut & wanted)
    place = np.flatnonzero(cut | ~wanted)
    after = np.r_[place, len(hashes)][np.searchsorted(place, first, "right")]
    return first, after - first


def sorted_windows(data, starts, counts, docs, length):
    """(keys, smallest document) of the different windows of some runs, sorted, and
    which of them each window is.

    A run's text is its ``counts`` windows and ``length - 1`` bytes more. The texts
    are joined; their suffix array and common prefixes tell equal windows.
    """
    text, begins = gathered(data, starts, counts + length - 1)
    n = len(text) - 16
    window = spread(begins, counts)
    ok = np.zeros(n, bool)
    ok[window] = True
    owner = np.zeros(n, np.int64)
    owner[window] = np.repeat(docs, counts)
    at, label = classes(text, n, ok, length)
    heads = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
    least = np.minimum.reduceat(owner[at], heads)
    of = np.empty(n, np.int64)
    of[at] = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(at)]))
    return window_keys(text, at[heads], length), least, of[window]


def window_keys(data, at, length):
    big = words_at(data, ">")
    return np.stack([big[at + k] for k in _offsets(length)], axis=1)


def late_windows(data, starts, counts, docs, length, piece_bytes=2 << 20):
    """Mask over the windows of the runs: a document with a smaller id holds it.

    Runs of equal text stand for one another, with their smallest document. A text
    whose anchor no other text has shares no window with another; the others are
    sorted in pieces, whose tables are merged by binary search.
    """
    sizes = counts + length - 1
    place = {}
    text_of = np.array([place.setdefault(data[a:b], len(place)) for a, b in zip(starts.tolist(), (starts + sizes).tolist())])
    least = np.full(len(place), _LAST)
    np.minimum.at(least, text_of, docs)
    own = np.empty(len(place), np.int64)
    own[text_of[::-1]] = np.arange(len(text_of))[::-1]
    text, begins = gathered(data, starts[own], sizes[own])
    text += bytes(length)
    counted = counts[own]
    first = np.cumsum(counted) - counted
    smallest = np.repeat(least, counted)
    hashes = anchors(text, length)[begins]
    open_ = np.flatnonzero(repeated(hashes, np.arange(len(hashes))))
    if len(open_):
        piece = np.cumsum(sizes[own[open_]]) // piece_bytes
        cuts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
        pieces = [open_[a:b] for a, b in zip(cuts, [*cuts[1:], len(open_)])]
        sorted_ = [sorted_windows(text, begins[p], counted[p], least[p], length) for p in pieces]
        tables = [(keys, found) for keys, found, _ in sorted_]
        while len(tables) > 1:
            tables = [merge(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
        keys, found = tables[0]
        for p, (mine, _, of) in zip(pieces, sorted_):
            known = found if len(pieces) == 1 else found[search(keys, mine)]
            smallest[spread(first[p], counted[p])] = known[of]
    return smallest[spread(first[text_of], counts)] < np.repeat(docs, counts)


def _offsets(length):
    """Where to read 8-byte words that cover ``length`` bytes."""
    return [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])


def search(table, keys):
    """Where each key is, or would be put, in the sorted rows: binary search."""
    low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(table), np.int64)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        less = np.zeros(len(keys), bool)
        same = open_.copy()
        for k in range(keys.shape[1]):
            here = table[np.minimum(middle, len(table) - 1), k]
            less |= same & (here < keys[:, k])
            same &= here == keys[:, k]
        low = np.where(open_ & less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    return low


def merge(a, b):
    """Union of two sorted (keys, smallest document) tables, by binary search."""
    if len(b[0]) > len(a[0]):
        a, b = b, a
    if not len(b[0]):
        return a
    at = search(a[0], b[0])
    same = (at < len(a[0])) & (a[0][np.minimum(at, len(a[0]) - 1)] == b[0]).all(axis=1)
    least = a[1].copy()
    least[at[same]] = np.minimum(least[at[same]], b[1][same])
    new = ~same
    return np.insert(a[0], at[new], b[0][new], axis=0), np.insert(least, at[new], b[1][new])


def packed(columns):
    """Columns of whole numbers as one blob: differences, bytes of equal weight side
    by side, compressed."""
    table = np.stack([np.diff(np.asarray(c, np.int64), prepend=0) for c in columns]).astype("<i8")
    n = table.shape[1]
    planes = np.ascontiguousarray(table.view(np.uint8).reshape(len(columns), n, 8).transpose(0, 2, 1))
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(columns), n]).tobytes() + planes.tobytes())


def unpacked(blob):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k, n = np.frombuffer(raw[:16], np.int64)
    planes = np.frombuffer(raw[16:], np.uint8).reshape(k, 8, n).transpose(0, 2, 1)
    return np.cumsum(np.ascontiguousarray(planes).view("<i8").reshape(k, n), axis=1)


def runs_of_windows(mask, of):
    """(first, count) of the runs of a mask that stay within one value of ``of``."""
    cut = np.r_[True, of[1:] != of[:-1]]
    first = np.flatnonzero(mask & (cut | ~np.r_[False, mask[:-1]]))
    ends = np.flatnonzero(mask & np.r_[cut[1:] | ~mask[1:], True])
    return first, ends - first + 1


def spread(first, count):
    """Every position of the runs."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


class Shard:
    """Texts sorted together: their bytes and where each window's anchor is."""

    def __init__(self, ids, sizes, body, length):
        self.ids, sizes = np.asarray(ids, np.int64), np.asarray(sizes, np.int64)
        self.data = zstandard.ZstdDecompressor().decompress(body) + bytes(length + 16)
        n = int(sizes.sum())
        self.begins = np.cumsum(sizes) - sizes
        self.doc_of = np.repeat(np.arange(len(sizes)), sizes)
        self.whole = np.arange(n) + length <= np.repeat(self.begins + sizes, sizes)
        self.hashes = anchors(self.data, length)[:n] if n else np.empty(0, np.uint64)
        self.first, self.count = window_runs(self.hashes, self.whole, self.doc_of) if n else (np.empty(0, np.int64),) * 2
        values = np.sort(self.hashes[self.first])
        self.anchors = values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


_TEXTS = "shard string, ids array<bigint>, sizes array<bigint>, body binary"


def _shards(shard_bytes):
    """Rows of texts, ``shard_bytes`` at a time (or one longer text)."""

    def row(held):
        body = zstandard.ZstdCompressor(level=3).compress(b"".join(t for _, t in held))
        ids = pa.array([[d for d, _ in held]], pa.list_(pa.int64()))
        sizes = pa.array([[len(t) for _, t in held]], pa.list_(pa.int64()))
        name = pa.array([uuid.uuid4().hex])
        return pa.RecordBatch.from_arrays([name, ids, sizes, pa.array([body])], ["shard", "ids", "sizes", "body"])

    def shards(batches):
        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                data = (text.as_py() or "").encode()
                held.append((doc_id.as_py(), data))
                size += len(data)
                if size >= shard_bytes:
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)

    return shards


def _ids(values):
    return [_LAST if d is None else d for d in values]


def _anchor_rows(length, bits):
    """Per shard and leading bits: the next 40 bits of its different anchors."""

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = Shard(_ids(row["ids"]), row["sizes"], row["body"], length).anchors
                part = (own >> np.uint64(64 - bits)).astype(np.int64)
                rest = ((own << np.uint64(bits)) >> np.uint64(24)).astype(np.int64)
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
                blobs = [packed([rest[a:b]]) for a, b in zip(cuts, [*cuts[1:], len(part)])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cuts] if blobs else [], pa.int32()), pa.array([row["shard"]] * len(blobs), pa.string()), pa.array(blobs, pa.binary())],
                    ["part", "shard", "anchors"],
                )

    return rows


def _shared_anchors(table):
    """Per shard, a bit for each of its anchors: another shard has it too."""
    lists = [unpacked(x.as_py())[0] for x in table["anchors"]]
    values = np.concatenate(lists)
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    shared = np.empty(len(values), bool)
    shared[order] = np.r_[False, same] | np.r_[same, False]
    ends = np.cumsum([len(x) for x in lists])
    bits = [np.packbits(shared[e - len(x) : e]).tobytes() for x, e in zip(lists, ends)]
    return pa.Table.from_arrays([table["shard"], table["part"], pa.array(bits, pa.binary())], ["shard", "part", "shared"])


_RUNS = "bucket int, shard string, head binary, body binary"


def _window_rows(length, bits, buckets):
    """Per shard: the spans found within it, and blobs of the windows that neither
    repeat an earlier document of the shard nor have an anchor of their own."""

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(_ids(row["ids"]), row["sizes"], row["body"], length)
                if not len(shard.first):
                    continue
                part = (shard.anchors >> np.uint64(64 - bits)).astype(np.int64)
                shared = np.zeros(len(part), bool)
                for x in row["found"] or ():
                    a, b = np.searchsorted(part, [x["part"], x["part"] + 1])
                    shared[a:b] = np.unpackbits(np.frombuffer(x["shared"], np.uint8))[: b - a].astype(bool)
                held, first, count, of = [], shard.first, shard.count, shard.doc_of
                late = np.zeros(len(shard.hashes), bool)
                some = repeated(shard.hashes[first], shard.ids[of[first]])
                if some.any():
                    a, c = first[some], count[some]
                    late[spread(a, c)] = late_windows(shard.data, a, c, shard.ids[of[a]], length)
                    a, c = runs_of_windows(late, of)
                    held.append((row["shard"], packed([of[a], a - shard.begins[of[a]], c]), None, len(late) % buckets))
                go = shared[np.searchsorted(shard.anchors, shard.hashes[first])]
                wanted = np.zeros(len(late), bool)
                wanted[spread(first[go], count[go])] = True
                wanted &= ~late
                first, count = window_runs(shard.hashes, wanted, of)
                bucket = (shard.hashes[first] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                first, count, bucket = first[order], count[order], bucket[order]
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
                squeeze = zstandard.ZstdCompressor(level=3)
                for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
                    s, c = first[a:b], count[a:b]
                    text, _ = gathered(shard.data, s, c + length - 1)
                    head = packed([shard.ids[of[s]], of[s], s - shard.begins[of[s]], c])
                    held.append((row["shard"], head, squeeze.compress(text[:-16]), int(bucket[a])))
                kinds = ((3, pa.int32()), (0, pa.string()), (1, pa.binary()), (2, pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in held], t) for i, t in kinds], ["bucket", "shard", "head", "body"]
                )

    return rows


_SPANS = "shard string, doc long, start long, count long"


def _spans(shards, docs, starts, counts):
    numbers = [pa.array(x, pa.int64()) for x in (docs, starts, counts)]
    return pa.Table.from_arrays([pa.array(shards, pa.string()), *numbers], ["shard", "doc", "start", "count"])


def _across(length):
    """Spans of one bucket."""

    def across(blobs):
        out, runs, names, bodies = [], [], [], []
        expand = zstandard.ZstdDecompressor()
        for shard, head, body in zip(blobs["shard"], blobs["head"], blobs["body"]):
            columns = unpacked(head.as_py())
            if body.as_py() is None:
                out.append(_spans([shard.as_py()] * columns.shape[1], *columns))
            else:
                runs.append(columns)
                names += [shard.as_py()] * columns.shape[1]
                bodies.append(expand.decompress(body.as_py()))
        if runs:
            ids, docs, starts, counts = np.concatenate(runs, axis=1)
            sizes = counts + length - 1
            begins = np.cumsum(sizes) - sizes
            data = b"".join(bodies) + bytes(16)
            at, run = spread(begins, counts), np.repeat(np.arange(len(counts)), counts)
            late = late_windows(data, begins, counts, ids, length)
            s, c = runs_of_windows(late, run)
            first = starts[run[s]] + at[s] - begins[run[s]]
            out.append(_spans([names[i] for i in run[s]], docs[run[s]], first, c))
        return pa.concat_tables(out)

    return across


def _remove(length):
    def remove(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        for batch in batches:
            for row in batch.to_pylist():
                data = zstandard.ZstdDecompressor().decompress(row["body"])
                spans = {}
                for blob in row["spans"] or ():
                    for doc, start, count in zip(blob["doc"], blob["start"], blob["count"]):
                        spans.setdefault(doc, []).append((start, start + count + length - 1))
                rows, begin = [], 0
                for i, (doc_id, size) in enumerate(zip(row["ids"], row["sizes"])):
                    text = data[begin : begin + size]
                    begin += size
                    kept, end, removed, n = [], 0, 0, 0
                    for a, b in sorted(spans.get(i, ())):
                        if a > end or not n:
                            kept.append(text[end:a])
                            n, removed, end = n + 1, removed + b - a, b
                        elif b > end:
                            removed, end = removed + b - end, b
                    kept.append(text[end:])
                    out = b"".join(kept)
                    rows.append((doc_id, size, removed, n, hashlib.sha256(out).hexdigest(), out))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return remove


def remove_repeats(docs, length=50, with_kept=False, shard_bytes=5 << 19, bucket_bytes=4 << 20):
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    Each byte of a text that lies in a string of ``length`` bytes that a document
    with a smaller id holds too is removed; the texts are judged as given.
    ``with_kept`` adds the bytes that stay.

    Texts are written as shards of ``shard_bytes``. Shards first tell which of
    their anchors (a hash that equal windows share) other shards have. A shard's
    suffix array then finds what repeats within it, and only windows without an
    earlier document there, and with a shared anchor, go on to the bucket of their
    anchor: a passage of a third of all documents leaves each shard once. In a
    bucket the windows are sorted in pieces and merged by binary search. Shards
    and buckets are of bounded size and their number grows with the texts.

    A null text is empty; texts shorter than ``length`` lose nothing. Rows that
    share an id are one document and lose nothing to one another; a null id counts
    as later than all others. An empty table gives an empty result; other columns
    are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shards = written(texts.mapInArrow(_shards(shard_bytes), _TEXTS), "shards")
    total = shards.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(3, (total // (16 << 20)).bit_length())
    buckets = max(8, int(total // bucket_bytes))
    found = (
        shards.mapInArrow(_anchor_rows(length, bits), "part int, shard string, anchors binary")
        .groupBy("part")
        .applyInArrow(_shared_anchors, "shard string, part int, shared binary")
        .groupBy("shard")
        .agg(F.collect_list(F.struct("part", "shared")).alias("found"))
    )
    spans = (
        shards.join(found, "shard", "left")
        .mapInArrow(_window_rows(length, bits, buckets), _RUNS)
        .groupBy("bucket")
        .applyInArrow(_across(length), _SPANS)
        .groupBy("shard")
        .agg(F.collect_list(F.struct("doc", "start", "count")).alias("spans"))
    )
    columns = [F.transform("spans", lambda x: x[n]).alias(n) for n in ("doc", "start", "count")]
    gathered_spans = spans.select("shard", F.array(F.struct(*columns)).alias("spans"))
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = shards.join(gathered_spans, "shard", "left").mapInArrow(_remove(length), kinds)
    return out if with_kept else out.drop("kept")
