"""Cross-tokenizer alignment: each distinct text is encoded and aligned once."""

import base64
import hashlib
import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from sitewise.llm.common import ship, written
from sitewise.llm.suffix_dedup import spread

#: A blank between two characters that are no white space: both tokenizers end a
#: token before it, so what stands between two of them is encoded by itself.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_LOADED = {}


class Vocabularies:
    """A byte-level tokenizer given by ranks (A) and a piece model (B)."""

    def __init__(self, ranks_path, pattern, pieces_path):
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        size = range(self.b.get_piece_size())
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in size
        ]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        # a decimal id with each of the three signs that may follow it
        marked = lambda n: [b"%d%c" % (i, sign) for sign in b",|;" for i in range(n)]
        self.shown = marked(len(self.a_bytes)) + marked(len(self.b_bytes))


def vocabularies(*key):
    if key not in _LOADED:
        _LOADED[key] = Vocabularies(*key)
    return _LOADED[key]


def _different(values):
    """The different values in order; by sorting, as most of these arrays are runs."""
    values = np.sort(values, kind="stable")
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def _joined(ids):
    """Lists of ids one behind another, and their lengths."""
    return np.fromiter(chain.from_iterable(ids), np.int64), np.array([len(x) for x in ids], np.int64)


def _gives_back(ids, pieces, sizes, given):
    """Whether the tokens of each part give its bytes back.

    Parts of the right length are compared at once; only where that fails one by one.
    """
    flat, n = _joined(ids)
    right = np.bincount(np.repeat(np.arange(len(n)), n), sizes[flat], len(n)) == np.array([len(x) for x in given], np.int64)
    held = np.flatnonzero(right).tolist()
    told = b"".join(map(pieces.__getitem__, flat[np.repeat(right, n)].tolist()))
    if told != b"".join([given[i] for i in held]):
        for i in held:
            right[i] = b"".join(map(pieces.__getitem__, ids[i])) == given[i]
    return right


def aligned(parts, own):
    """Alignment of each part, a blank put before it: (measures, pairs, groups, right).

    measures: n_a, n_b, n_groups and n_links as rows. pairs: the ``a << 32 | b`` of
    the links, part by part. groups: ``a1,a2|b1;a3|b2`` as bytes. A part whose
    tokens don't give its bytes back has ``right`` unset and zeros.

    Byte ends of both sides cut the bytes into stretches; each lies in one token of
    either side, so stretches are the links, and ends on both sides close groups.
    """
    given = [b" " + p.encode() for p in parts]
    ids_a = [own.a.encode_ordinary(" " + p) for p in parts]
    ids_b = own.b.encode(parts, num_threads=1) if parts else []
    right = _gives_back(ids_a, own.a_bytes, own.a_sizes, given) & _gives_back(ids_b, own.b_bytes, own.b_sizes, given)
    held = np.flatnonzero(right)
    measures, groups = np.zeros((4, len(parts)), np.int64), [b""] * len(parts)
    if not len(held):
        return measures, np.empty(0, np.int64), groups, right
    (a, n_a), (b, n_b) = (_joined([x[i] for i in held.tolist()]) for x in (ids_a, ids_b))
    ends_a, ends_b = np.cumsum(own.a_sizes[a]), np.cumsum(own.b_sizes[b])
    ends = np.cumsum([len(given[i]) for i in held.tolist()])
    cuts = _different(np.concatenate([ends_a, ends_b]))
    pairs = a[np.searchsorted(ends_a, cuts)] << 32 | b[np.searchsorted(ends_b, cuts)]
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    n_links = np.bincount(np.searchsorted(ends, cuts), minlength=len(held))
    n_groups = np.bincount(np.searchsorted(ends, common), minlength=len(held))
    measures[:, held] = n_a, n_b, n_groups, n_links
    # tokens in the order shown: the A tokens of a group, then its B tokens
    of_a, of_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    before_b = np.searchsorted(of_b, of_a)
    upto_a = np.searchsorted(of_a, of_b, "right")
    last_a, last_b = np.r_[of_a[1:] != of_a[:-1], True], np.r_[of_b[1:] != of_b[:-1], True]
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + before_b] = a + len(own.a_bytes) * last_a
    order[np.arange(len(b)) + upto_a] = 3 * len(own.a_bytes) + b + 2 * len(own.b_bytes) * last_b
    shown, at = [own.shown[i] for i in order.tolist()], 0
    for i, n in zip(held.tolist(), (n_a + n_b).tolist()):
        groups[i] = b"".join(shown[at : at + n])[:-1]
        at += n
    return measures, pairs, groups, right


class _Places(dict):
    """The number of each part, by first sight."""

    def __missing__(self, part):
        place = self[part] = len(self)
        return place


def _coded(text, places):
    parts = text.split(" ")
    return np.fromiter(map(places.__getitem__, parts), np.int64, len(parts))


def _squeezed(values, kind):
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values, kind).tobytes())


def _expanded(blob, kind):
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind).astype(np.int64)


def shard_row(texts, copies, own):
    """Measures of the texts of a shard and what they are sums of.

    A part that stands in several texts, or often in one, is encoded once. Texts
    with blanks beside other white space are cut at fewer places; one with a part
    that its tokens don't give back is encoded whole, which then decides.
    """
    places = _Places()
    codes = [_coded(t, places) for t in texts]
    loose = np.array([not p or p[0].isspace() or p[-1].isspace() for p in places], bool)
    for i, code in enumerate(codes):
        if len(code) > 1 and loose[code].any():
            codes[i] = np.array([places[p] for p in _SAFE.split(texts[i])], np.int64)
    parts, texts_n = list(places), len(texts)
    used = _different(np.concatenate(codes)) if texts_n else np.empty(0, np.int64)
    codes = [np.searchsorted(used, c) for c in codes]
    measures, pairs, groups, right = aligned([parts[i] for i in used], own)
    wrong = [i for i, code in enumerate(codes) if len(code) > 1 and not right[code].all()]
    if wrong:
        more = aligned([texts[i] for i in wrong], own)
        for k, i in enumerate(wrong):
            codes[i] = np.array([len(groups) + k])
        measures, pairs = np.concatenate([measures, more[0]], axis=1), np.concatenate([pairs, more[1]])
        groups, right = groups + more[2], np.r_[right, more[3]]
    sizes = np.array([len(c) for c in codes], np.int64)
    flat = np.concatenate(codes) if texts_n else np.empty(0, np.int64)
    of = np.repeat(np.arange(texts_n), sizes)
    sums = [np.bincount(of, m[flat], texts_n).astype(np.int64) for m in measures]
    shown = [b";".join([groups[c] for c in code.tolist()]) for code in codes]
    # texts that hold a pair, each counted with its copies
    different, of_pair = np.unique(pairs, return_inverse=True)
    begins = np.cumsum(measures[3]) - measures[3]
    once = _different(of * len(groups) + flat)
    text, part = once // max(len(groups), 1), once % max(len(groups), 1)
    held = np.repeat(text, measures[3][part]) * len(different) + of_pair[spread(begins[part], measures[3][part])]
    held = _different(held)
    weights = np.bincount(held % max(len(different), 1), np.asarray(copies, float)[held // max(len(different), 1)], len(different))
    return {
        "pairs": different,
        "weights": weights.astype(np.int64),
        "sizes": _squeezed(sizes, "<i4"),
        "codes": _squeezed(flat, "<i4"),
        "links": _squeezed(measures[3], "<i4"),
        "of_pair": _squeezed(of_pair, "<i4"),
        **dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums)),
        "groups": shown,
    }


_MEASURES = ("n_a", "n_b", "n_groups", "n_links")
_SHARDS = (
    "shard string, keys array<binary>, "
    + ", ".join(f"{n} array<bigint>" for n in _MEASURES)
    + ", sha array<string>, groups array<string>, pairs array<bigint>, weights array<bigint>, "
    + "sizes binary, codes binary, links binary, of_pair binary"
)


def _shards(paths, shard_bytes, with_groups):
    kinds = [pa.string(), pa.list_(pa.binary())] + [pa.list_(pa.int64())] * 4 + [pa.list_(pa.string())] * 2
    kinds += [pa.list_(pa.int64())] * 2 + [pa.binary()] * 4
    names = [f.strip().split(" ")[0] for f in _SHARDS.split(", ")]

    def row(held):
        keys, texts, copies = zip(*held)
        out = shard_row(texts, copies, vocabularies(*paths))
        out["sha"] = [hashlib.sha256(g).hexdigest() if g else "" for g in out["groups"]]
        out["groups"] = [g.decode() for g in out["groups"]] if with_groups else None
        out |= {"shard": uuid.uuid4().hex, "keys": list(keys)}
        return pa.RecordBatch.from_arrays([pa.array([out[n]], k) for n, k in zip(names, kinds)], names)

    def shards(batches):
        held, size = [], 0
        for batch in batches:
            for key, text, n in zip(batch["key"], batch["text"], batch["n"]):
                text = text.as_py()
                held.append((key.as_py(), text, n.as_py()))
                size += len(text)
                if size >= shard_bytes:
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)

    return shards


def aligned_shards(docs, ranks_path, pattern, pieces_path, shard_bytes=4 << 20, with_groups=False):
    """Distinct texts, shuffled by the whole text, aligned and written as shards of
    about ``shard_bytes``: measures by text, and the pairs of the shard with the
    number of documents that hold them. Copies are counted before the shuffle."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text <> ''")
    texts = texts.groupBy("text").agg(F.count("*").alias("n")).withColumn("key", _key())
    paths = (ranks_path, pattern, pieces_path)
    return written(texts.mapInArrow(_shards(paths, shard_bytes, with_groups), _SHARDS), "aligned")


def _key():
    return F.unhex(F.sha2("text", 256))


def pair_counts(shards):
    """(a, b, n, best): documents that hold A id and B id linked, and whether no
    other B id is linked to the A id in more."""
    # a pair without weight comes from a part of a text that was encoded whole
    each = shards.select(F.explode(F.arrays_zip("pairs", "weights")).alias("x")).where("x.weights > 0")
    counts = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.weights").alias("n"))
    a = F.shiftright("pair", 32)
    counts = written(counts.select(a.alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n"), "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _measured(with_groups):
    names = ["key", *_MEASURES, "n_best", "count_sum", "groups_sha256"] + ["groups"] * with_groups
    kinds = [pa.binary()] + [pa.int64()] * 6 + [pa.string()] * (1 + with_groups)

    def measured(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch[n][i] for n in batch.schema.names}
                pairs = np.asarray(row["pairs"].values) if row["pairs"].as_py() else np.empty(0, np.int64)
                count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
                if row["found"].is_valid:
                    found = row["found"].values
                    at = np.searchsorted(pairs, np.asarray(found.field("pair")))
                    count[at], best[at] = np.asarray(found.field("n")), np.asarray(found.field("best"))
                links, of_pair, sizes, codes = (_expanded(row[n].as_py(), "<i4") for n in ("links", "of_pair", "sizes", "codes"))
                of = np.repeat(np.arange(len(sizes)), sizes)
                part = np.repeat(np.arange(len(links)), links)
                sums = []
                for value in (best, count):
                    by_part = np.zeros(len(links), np.int64)
                    np.add.at(by_part, part, value[of_pair])
                    by_text = np.zeros(len(sizes), np.int64)
                    np.add.at(by_text, of, by_part[codes])
                    sums.append(by_text)
                columns = [row["keys"].values, *(row[n].values for n in _MEASURES), *sums, row["sha"].values]
                columns += [row["groups"].values] * with_groups
                yield pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, np.ndarray) else c for c, k in zip(columns, kinds)], names)

    return measured


def align_tokens(docs, ranks_path, pattern, pieces_path, shard_bytes=4 << 20, with_groups=False):
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    Blank and text are encoded by A (byte-level ranks) and B (pieces, which adds the
    blank). Bytes where tokens of both end close a group; tokens whose bytes overlap
    are linked. A pair of ids counts the rows that hold it linked, copies included;
    ``n_best`` are the links whose count is the highest of their A id and
    ``count_sum`` sums the counts over the links. ``with_groups`` adds the groups
    themselves.

    Texts are shuffled whole and each distinct one is encoded once, with the number
    of its copies as its weight. A shard gets the counts of its own pairs back, by
    a join of one row per shard and pair, so no task holds all pairs. The measures are
    joined to the rows by the SHA-256 of the text.

    Null and empty texts, and texts that either side's tokens don't give back, have
    zeros and an empty digest. Every row counts, repeated ids and null ids too; an
    empty table gives an empty result; other columns are ignored.
    """
    shards = aligned_shards(docs, ranks_path, pattern, pieces_path, shard_bytes, with_groups)
    counts = pair_counts(shards).select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "n", "best")
    wanted = shards.select("shard", F.explode("pairs").alias("pair")).join(counts, "pair")
    found = wanted.groupBy("shard").agg(F.collect_list(F.struct("pair", "n", "best")).alias("found"))
    names = ["key", *_MEASURES, "n_best", "count_sum", "groups_sha256"] + ["groups"] * with_groups
    kinds = "key binary, " + ", ".join(f"{n} long" for n in names[1:7]) + ", groups_sha256 string" + ", groups string" * with_groups
    measures = written(shards.join(found, "shard", "left").mapInArrow(_measured(with_groups), kinds), "measures")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = rows.where("text <> ''").select("doc_id", _key().alias("key")).join(measures, "key", "left").drop("key")
    none = rows.where("coalesce(text, '') = ''").select(
        "doc_id", *[F.lit(0).cast("long").alias(n) for n in names[1:7]], *[F.lit("").alias(n) for n in names[7:]]
    )
    return some.unionAll(none)
