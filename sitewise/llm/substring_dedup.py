"""Substring removal by level-wise doubling of repeated word windows."""

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import functions as F

from sitewise.llm.common import ship, written
from sitewise.llm.suffix_dedup import packed, repeated, unpacked

#: Stands for a null id: later than every other document.
_LAST = np.iinfo(np.int64).max
#: Parts of a level's rows that are no hashes: the windows still open.
_OPEN = -1


def levels(length, least=32):
    """Window lengths up to ``length``, each at most twice the one before."""
    out = [length]
    while out[0] > least:
        out.insert(0, -(-out[0] // 2))
    return out


def doubled(values, length, to):
    """Hashes of windows of ``to`` items from those of windows of ``length``: of the
    windows at the start, and of those that end where the longer one ends."""
    shift = to - length
    a, b = values[: max(0, len(values) - shift)], values[shift:]
    out = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def window_hashes(values, length):
    """Hashes of all windows of ``length`` items, built by doubling."""
    reach = 1
    while reach < length:
        to = min(2 * reach, length)
        values, reach = doubled(values, reach, to), to
    return values


def smallest(values, span):
    """Smallest of each ``span`` neighbours."""
    reach = 1
    while 2 * reach <= span:
        values = np.minimum(values[: len(values) - reach], values[reach:])
        reach *= 2
    rest = span - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def padded(values, n, filler):
    return np.concatenate([values, np.full(n - len(values), filler, values.dtype)])


class Shard:
    """Texts of one row as word codes: which document each word is of, two hashes of
    it, and how many words follow in its document, itself included."""

    def __init__(self, row):
        expand = zstandard.ZstdDecompressor().decompress
        self.ids = np.array([_LAST if d is None else d for d in row["ids"]], np.int64)
        self.sizes = np.asarray(row["sizes"], np.int64)
        self.words = expand(row["words"]).split(b" ")
        self.codes = np.frombuffer(expand(row["codes"]), "<i4")
        n = len(self.codes)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.doc_of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.left = np.repeat(self.begins + self.sizes, self.sizes) - np.arange(n)

    def lanes(self):
        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in self.words]), "<u8").reshape(-1, 2)
        return digests[self.codes, 0], digests[self.codes, 1]

    def whole(self, length):
        """Windows of ``length`` words that end in their document."""
        return self.left >= length


def _each(batch):
    """The rows of a batch, one held at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def grown(open_, length, to):
    """Windows of ``to`` words whose first and last ``length`` words are open."""
    shift = to - length
    return padded(open_[: max(0, len(open_) - shift)] & open_[shift:], len(open_), False) if shift else open_


_TEXTS = "shard string, ids array<bigint>, sizes array<bigint>, words binary, codes binary"


class _Codes(dict):
    def __missing__(self, word):
        code = self[word] = len(self)
        return code


def _shards(shard_bytes):
    """Rows of texts, ``shard_bytes`` at a time (or one longer text)."""

    def row(held):
        codes, place, sizes = [], _Codes(), []
        for _, text in held:
            # bytes.split cuts at the blanks and at tab to carriage return only
            words = text.split()
            sizes.append(len(words))
            codes.append(np.fromiter(map(place.__getitem__, words), "<i4", len(words)))
        squeeze = zstandard.ZstdCompressor(level=3).compress
        blobs = [squeeze(b" ".join(place)), squeeze(np.concatenate(codes).tobytes())]
        numbers = [pa.array([x], pa.list_(pa.int64())) for x in ([d for d, _ in held], sizes)]
        columns = [pa.array([uuid.uuid4().hex]), *numbers, *[pa.array([b], pa.binary()) for b in blobs]]
        return pa.RecordBatch.from_arrays(columns, ["shard", "ids", "sizes", "words", "codes"])

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


def sought(shard, open_, length, to):
    """(windows of ``to`` words still open, their anchor each, the different anchors).

    The anchor is the smallest hash of a window of ``length`` words inside: equal
    windows have equal ones, and neighbours mostly the same.
    """
    wider = grown(open_, length, to) & shard.whole(to)
    n = len(wider)
    if not wider.any():
        return wider, np.zeros(n, np.uint64), np.empty(0, np.uint64)
    hashes = window_hashes(shard.lanes()[0], length)
    found = padded(smallest(hashes, to - length + 1), n, np.uint64(0))
    # a smallest hash is small: mixed, its leading bits are even again
    found = found * np.uint64(0x9E3779B97F4A7C15)
    found ^= found >> np.uint64(32)
    found *= np.uint64(0x94D049BB133111EB)
    return wider, found, np.unique(found[wider])


def judged(shard, open_, length):
    """(positions, entry of each, two hashes and smallest document per entry) of the
    open windows of ``length`` words; an entry is one different window."""
    at = np.flatnonzero(open_)
    if not len(at):
        return at, at, [np.empty(0, np.uint64)] * 2, np.empty(0, np.int64)
    first, second = (window_hashes(lane, length)[at] for lane in shard.lanes())
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
    entry = np.empty(len(at), np.int64)
    entry[order] = np.cumsum(new) - 1
    least = np.full(int(new.sum()), _LAST)
    np.minimum.at(least, entry, shard.ids[shard.doc_of[at]])
    return at, entry, [first[new], second[new]], least


def _parts(values, bits):
    """Leading bits, and where each value of them begins and ends in sorted values."""
    part = (values >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
    return part[cuts], cuts, np.r_[cuts[1:], len(part)].astype(np.int64)


_LEVEL = "shard string, part int, blob binary"


def _rows(shard, parts, blobs, open_):
    out = [(shard, int(p), b) for p, b in zip(parts, blobs)]
    out.append((shard, _OPEN, zstandard.ZstdCompressor(level=3).compress(np.packbits(open_).tobytes())))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary()))], ["shard", "part", "blob"])


def _held(blob, n):
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8))[:n].astype(bool)


def _answers(found, parts, begins, ends, n, fields):
    """Bits that came back for the entries of a shard, one mask per field."""
    out = [np.zeros(n, bool) for _ in fields]
    bounds = {int(p): (a, b) for p, a, b in zip(parts, begins, ends)}
    for x in found or ():
        a, b = bounds[x["part"]]
        for mask, field in zip(out, fields):
            mask[a:b] = np.unpackbits(np.frombuffer(x[field], np.uint8))[: b - a].astype(bool)
    return out


class Step:
    """What a shard knows before a level: its open windows and the last answers.

    ``chain`` are the lengths of the levels and ``target`` the one that decides.
    Below it a level asks whether anchors are shared; from it on, whether windows
    are, and whether an earlier document has them.
    """

    def __init__(self, chain, target, bits):
        self.chain, self.target, self.bits = chain, target, bits

    def asked(self, shard, open_, k):
        """Parts and blobs of hashes that ask about the open windows of level ``k``."""
        length = self.chain[k]
        if length < self.target:
            values = sought(shard, open_, length, self.chain[k + 1])[2]
            parts, begins, ends = _parts(values, self.bits)
            rest = ((values << np.uint64(self.bits)) >> np.uint64(24)).astype(np.int64)
            return parts, [packed([rest[a:b]]) for a, b in zip(begins, ends)]
        _, _, (first, second), least = judged(shard, open_, length)
        parts, begins, ends = _parts(first, self.bits)
        columns = first.view(np.int64), (second >> np.uint64(32)).view(np.int64), least
        return parts, [packed([c[a:b] for c in columns]) for a, b in zip(begins, ends)]

    def kept(self, shard, open_, k, found):
        """(open windows of level ``k + 1``, windows of level ``k`` that an earlier
        document holds or None) by the answers to level ``k``."""
        length = self.chain[k]
        if length < self.target:
            wider, anchor, values = sought(shard, open_, length, self.chain[k + 1])
            (shared,) = _answers(found, *_parts(values, self.bits), len(values), ("shared",))
            at = np.flatnonzero(wider)
            entry = np.searchsorted(values, anchor[at])
            wider[at] = shared[entry] | repeated(anchor[at], shard.ids[shard.doc_of[at]])
            return wider, None
        at, entry, (first, _), least = judged(shard, open_, length)
        shared, earlier = _answers(found, *_parts(first, self.bits), len(first), ("shared", "earlier"))
        ids = shard.ids[shard.doc_of[at]]
        several = np.zeros(len(least), bool)
        several[entry[ids != least[entry]]] = True
        late, again = np.zeros(len(open_), bool), np.zeros(len(open_), bool)
        late[at] = earlier[entry] | (ids > least[entry])
        again[at] = (shared | several)[entry]
        return grown(again, length, 2 * length) & shard.whole(2 * length), late


def _level(step, k):
    """Rows of level ``k``: hashes to exchange, and the windows they are of."""

    def level(batches):
        for batch in batches:
            for row in _each(batch):
                shard = Shard(row)
                if k:
                    before = _held(row["blob"], len(shard.codes))
                    open_, _ = step.kept(shard, before, k - 1, row["found"])
                else:
                    open_ = shard.whole(step.chain[0])
                parts, blobs = step.asked(shard, open_, k)
                if len(parts):
                    yield _rows(row["shard"], parts, blobs, open_)

    return level


def _shared(table):
    """Per shard and part a bit for each of its anchors: another shard has it too."""
    lists = [unpacked(x.as_py())[0] for x in table["blob"]]
    values = np.concatenate(lists)
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    shared = np.empty(len(values), bool)
    shared[order] = np.r_[False, same] | np.r_[same, False]
    return _bits(table, [len(x) for x in lists], {"shared": shared})


def _earlier(table):
    """Per shard and part the bits of its windows: another shard has it too, and with
    a smaller document."""
    lists = [unpacked(x.as_py()) for x in table["blob"]]
    first, second, least = np.concatenate(lists, axis=1)
    order = np.lexsort((second, first))
    new = np.r_[True, (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])]
    heads = np.flatnonzero(new)
    sizes = np.diff(np.r_[heads, len(order)])
    smallest_ = np.repeat(np.minimum.reduceat(least[order], heads), sizes)
    shared, earlier = np.empty(len(order), bool), np.empty(len(order), bool)
    shared[order] = np.repeat(sizes > 1, sizes)
    earlier[order] = smallest_ < least[order]
    return _bits(table, [x.shape[1] for x in lists], {"shared": shared, "earlier": earlier})


def _bits(table, sizes, masks):
    ends = np.cumsum(sizes)
    columns = {"shard": table["shard"], "part": table["part"]}
    for name, mask in masks.items():
        columns[name] = pa.array([np.packbits(mask[e - n : e]).tobytes() for e, n in zip(ends, sizes)], pa.binary())
    return pa.table(columns)


_REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string, longest long, kept string"


def covered(starts, length):
    """Words that a window of ``length`` words from one of the ``starts`` covers."""
    marks = np.zeros(len(starts) + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + length, -1)
    return np.cumsum(marks)[:-1] > 0


def _remove(step, k):
    """Rows of the documents, by the answers to the level that decides."""

    def remove(batches):
        names = [f.split(" ")[0] for f in _REMOVED.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for row in _each(batch):
                shard = Shard(row)
                n = len(shard.codes)
                gone, long_ = np.zeros(n, bool), np.zeros(len(shard.sizes), np.int64)
                if row["blob"] is not None:
                    _, late = step.kept(shard, _held(row["blob"], n), k, row["found"])
                    gone = covered(late, step.target)
                    long_[shard.doc_of[late]] = step.target
                for x in row["longer"] or ():
                    long_[x["doc"]] = max(long_[x["doc"]], x["length"])
                out = []
                for i, (a, size) in enumerate(zip(shard.begins.tolist(), shard.sizes.tolist())):
                    stay = shard.codes[a : a + size][~gone[a : a + size]]
                    text = b" ".join([shard.words[c] for c in stay.tolist()])
                    out.append((row["ids"][i], size, size - len(stay), hashlib.sha256(text).hexdigest(), int(long_[i]), text.decode()))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names)

    return remove


def _longer(step, k):
    """(shard, doc, length) of the documents with a window of level ``k`` that an
    earlier document holds."""

    def longer(batches):
        for batch in batches:
            for row in _each(batch):
                shard = Shard(row)
                _, late = step.kept(shard, _held(row["blob"], len(shard.codes)), k, row["found"])
                docs = np.unique(shard.doc_of[late])
                columns = [pa.array([row["shard"]] * len(docs), pa.string()), pa.array(docs, pa.int32()), pa.array([step.chain[k]] * len(docs), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "doc", "length"])

    return longer


def remove_repeated_windows(docs, length=50, shard_bytes=4 << 20, part_words=4 << 20, longest=False, with_kept=False):
    """doc_id, n_words, n_removed and kept_sha256 of every row.

    A word is removed if a window of ``length`` words covers it whose word sequence
    also starts in a document with a smaller id; windows are judged on the input.
    ``with_kept`` adds the words that stay.

    Level by level: only windows that stand in two documents at one length are
    extended to twice that length, until none is left open or ``length`` is reached:
    longer windows are covered by those of ``length`` words inside them and remove
    nothing more. ``longest`` goes on, to twice ``length`` and so forth until none is
    left, and adds the column ``longest``: the longest of these windows that an earlier
    document holds, 0 if none. The first levels halve ``length`` down to 32 words at
    most; there, a window of the next length stays open
    if its anchor, the smallest hash of a window of this length inside, stands in
    another document too, so that runs of windows ask once. From ``length`` on every
    open window asks by itself, with 96 bits.

    Texts are written as shards of ``shard_bytes``, which hold their words as codes. A
    level is one exchange: each shard asks once for each different hash, whatever its
    number of copies there, hashes are dealt by their leading bits to parts of
    about ``part_words`` words of the input, and a bit comes back for each. The
    hashes below ``length`` (40 bits and the part) may keep a window open for
    nothing, which later levels mend.

    A null or empty text has no words; texts of fewer than ``length`` words lose
    none. Rows that share an id are one document and lose nothing to one another; a
    null id counts as later than all others. An empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shards = written(texts.mapInArrow(_shards(shard_bytes), _TEXTS), "texts")
    sizes = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    words, most = shards.agg(F.sum(sizes), F.max(F.array_max("sizes"))).first()
    bits = max(3, ((words or 0) // part_words).bit_length())
    chain = levels(length)
    decides = len(chain) - 1
    while longest and 2 * chain[-1] <= (most or 0):
        chain.append(2 * chain[-1])
    step, asked, found, last, more = Step(chain, length, bits), None, None, None, None
    for k, size in enumerate(chain):
        rows = shards
        if k:
            opened = asked.where(F.col("part") == _OPEN).select("shard", "blob")
            rows = shards.join(opened, "shard").join(found, "shard", "left")
        asked = written(rows.mapInArrow(_level(step, k), _LEVEL), f"level-{size}")
        some = asked.where(F.col("part") != _OPEN)
        if some.isEmpty():
            break
        answers = (
            some.groupBy("part").applyInArrow(_shared, "shard string, part int, shared binary")
            if size < length
            else some.groupBy("part").applyInArrow(_earlier, "shard string, part int, shared binary, earlier binary")
        )
        fields = [c for c in answers.columns if c != "shard"]
        found = written(answers.groupBy("shard").agg(F.collect_list(F.struct(*fields)).alias("found")), "answers")
        opened = asked.where(F.col("part") == _OPEN).select("shard", "blob")
        if k == decides:
            last = opened.join(found, "shard", "left")
        elif k > decides:
            new = shards.join(opened, "shard").join(found, "shard", "left").mapInArrow(_longer(step, k), "shard string, doc int, length long")
            more = new if more is None else more.unionAll(new)
    answered = "found array<struct<part:int,shared:binary,earlier:binary>>"
    if last is None:
        last = spark.createDataFrame([], f"shard string, blob binary, {answered}")
    rows = shards.join(last, "shard", "left")
    if more is None:
        rows = rows.withColumn("longer", F.lit(None).cast("array<struct<doc:int,length:bigint>>"))
    else:
        rows = rows.join(more.groupBy("shard").agg(F.collect_list(F.struct("doc", "length")).alias("longer")), "shard", "left")
    out = rows.mapInArrow(_remove(step, decides), _REMOVED)
    return out.drop(*([] if longest else ["longest"]), *([] if with_kept else ["kept"]))
