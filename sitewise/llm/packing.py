"""Packing: documents into token sequences, best-fit decreasing."""

import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from sitewise.llm.common import ship, tidy, written

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
_CACHED_WORDS = 500_000
_ENCODERS = {}


class WordEncoder:
    """Token ids of a text, as little-endian unsigned 32-bit bytes.

    For tokenizers that drop white space and lower their input: no token spans a
    space, so a text is the sequence of its space-free chunks and a chunk seen
    before needs no second encoding. The caches are emptied when they are full. Plain
    Latin words go to the model directly; every other chunk to the whole tokenizer.
    """

    def __init__(self, path):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = iter(range(256, 512))
        self.letters = {b: chr(b if b in kept else next(shown)) for b in range(256)}
        self.cache, self.words = _Chunks(self.chunk), {}

    def chunk(self, text):
        plain = _PLAIN.fullmatch(text)
        if plain is None:
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        word = plain[1].lower()
        ids = self.words.get(word)
        if ids is None:
            shown = word.encode().decode("latin1").translate(self.letters)
            ids = self.words[word] = self.packed([x.id for x in self.model.tokenize(shown)])
        return ids + self.cache[plain[2]] if plain[2] else ids

    @staticmethod
    def packed(ids):
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text):
        for held in (self.cache, self.words):
            if len(held) > _CACHED_WORDS:
                held.clear()
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.cache.__getitem__, chunks))


class _Chunks(dict):
    """Ids of the chunks seen; a new one is encoded when it is asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk):
        ids = self[chunk] = self.encode(chunk)
        return ids


def encoder(path):
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
    ]
)


def _cut(path, capacity, end_id, with_ids):
    schema = PIECES.append(pa.field("ids", pa.binary())) if with_ids else PIECES

    @tidy()
    def cut(batches):
        encode = encoder(path).encode
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = encode(text.as_py() or "") + end
                tokens = len(ids) // 4
                for start in range(0, tokens, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    row = (doc_id, start, len(piece) // 4, zlib.crc32(piece), tokens)
                    rows.append((*row, piece) if with_ids else row)
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
                    rows = []
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    return cut


class OpenWindows:
    """Open windows by remaining capacity: a segment tree over the capacities whose
    nodes count the open windows below them, and a stack of windows at each leaf."""

    def __init__(self, capacity):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows = [[] for _ in range(self.leaves)]

    def put(self, room, window):
        self.windows[room].append(window)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take_tightest(self, need):
        """(room, window) with the least room of ``need`` or more, or None."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, self.windows[room].pop()


def best_fit_decreasing(lengths, capacity):
    """(window, offset) per length; lengths must come in falling order."""
    open_windows, placed, windows = OpenWindows(capacity), [], 0
    for length in lengths:
        found = open_windows.take_tightest(length)
        if found is None:
            found, windows = (capacity, windows), windows + 1
        room, window = found
        placed.append((window, capacity - room))
        if room > length:
            open_windows.put(room - length, window)
    return placed


def pack_documents(docs, tokenizer_path, capacity=2048, end_id=1, shard_pieces=50_000, with_ids=False):
    """Pieces of every document with their sequence and place in it.

    docs: (doc_id, text, ...). A document is its token ids and ``end_id``; one
    longer than ``capacity`` is cut into full windows and a rest. The pieces are
    dealt by hash to shards of about ``shard_pieces`` and each shard is packed
    best-fit decreasing, so no task holds more than one shard. A sequence holds at
    most ``capacity`` tokens and its id is unique over all shards.

    A null or empty text is ``end_id`` alone. Repeated rows, repeated or null ids
    are packed once per row; equal lengths go by id and start; an empty table gives
    no pieces; other columns are ignored. ``with_ids`` adds the ids themselves, as
    little-endian unsigned 32-bit bytes.
    """
    spark = docs.sparkSession
    ship(spark)
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    kinds += ", ids binary" if with_ids else ""
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = written(
        narrow.mapInArrow(_cut(tokenizer_path, capacity, end_id, with_ids), kinds), "pieces"
    )
    shards = -(-pieces.count() // shard_pieces) or 1

    def pack(key, pieces):
        pieces = pieces.sort_values(
            ["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True]
        )
        placed = best_fit_decreasing(pieces["length"].tolist(), capacity)
        first = int(key[0]) << 32
        pieces["sequence_id"] = [first + window for window, _ in placed]
        pieces["offset"] = [offset for _, offset in placed]
        return pieces.drop(columns="_shard")

    shard = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards))
    return (
        pieces.withColumn("_shard", shard)
        .groupBy("_shard")
        .applyInPandas(pack, f"{kinds}, sequence_id long, offset long")
    )
