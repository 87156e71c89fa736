"""Alignment, hard negatives and doubling windows against brute force."""

import collections
import hashlib
import math
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
FILES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
LETTERS = list("abcDEF12 '.,\n\t é▁中😀́\x1c　<s>") + ["  ", " 's", "<|endoftext|>", "<s>", " ", " \n "]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def clashing(frame, *names):
    return frame.select("*", *[F.lit("x").alias(n) for n in names]).repartition(3)


@pytest.fixture(scope="module")
def given(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def by_bytes(text, ranks, pieces):
    """(groups, links) of one text, or None where the tokens don't give it back."""
    a = ranks.encode(" " + text, add_special_tokens=False).ids
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = iter(range(256, 512))
    byte = {chr(b if b in kept else next(shown)): b for b in range(256)}
    token_a = [bytes(byte[c] for c in ranks.id_to_token(i)) for i in a]
    b = pieces.encode(text)
    piece = [pieces.id_to_piece(i) for i in b]
    token_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, piece)]
    data = (" " + text).encode()
    if not text or b"".join(token_a) != data or b"".join(token_b) != data:
        return None
    spans = []
    for ids, tokens in ((a, token_a), (b, token_b)):
        at, out = 0, []
        for i, t in zip(ids, tokens):
            out.append((i, at, at + len(t)))
            at += len(t)
        spans.append(out)
    ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    groups, begin = [], 0
    for end in ends:
        groups.append([[str(i) for i, s, e in side if begin <= s and e <= end] for side in spans])
        begin = end
    links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
    return ";".join("|".join(",".join(x) for x in g) for g in groups), links, len(a), len(b), len(groups)


def test_alignment(spark, given):
    import sentencepiece
    import tokenizers

    from sitewise.llm.token_alignment import align_tokens, aligned_shards, pair_counts

    draw = random.Random(3)
    made = ["".join(draw.choices(LETTERS, k=draw.randrange(1, 40))) for _ in range(300)]
    odd = [(None, "no id"), (7, None), (8, ""), (9, " "), (10, "\n"), (8111, "same"), (8111, "same"), (12, "z" * 700), (13, "x " * 900)]
    short = sorted(given, key=lambda r: len(r[1] or ""))[:60]
    rows = short + [(1000 + i, t) for i, t in enumerate(made)] + odd + [(5000 + i, "a copy of many") for i in range(40)]
    ranks = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ranks.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    single = {t: by_bytes(t, ranks, pieces) for t in {t for _, t in rows if t}}
    count = collections.Counter(p for _, t in rows if single.get(t) for p in set(single[t][1]))
    best = collections.defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    want = []
    for doc_id, text in rows:
        found = single.get(text)
        if found is None:
            want.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links, n_a, n_b, n_groups = found
        digest = hashlib.sha256(groups.encode()).hexdigest()
        tops = sum(count[p] == best[p[0]] for p in links)
        want.append((doc_id, n_a, n_b, n_groups, len(links), tops, sum(count[p] for p in links), digest))
    assert sum(not w[-1] for w in want) < 150
    docs = clashing(spark.createDataFrame(rows, SCHEMA), "key", "n", "shard", "pairs")
    got = align_tokens(docs, *FILES, shard_bytes=4000)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    shown = align_tokens(docs, *FILES, with_groups=True).where("doc_id = 8111").select("groups").collect()
    assert [r.groups for r in shown] == [single["same"][0]] * 2
    pairs = {(r.a, r.b): (r.n, r.best) for r in pair_counts(aligned_shards(docs, *FILES)).collect()}
    assert pairs == {p: (n, n == best[p[0]]) for p, n in count.items()}
    assert align_tokens(spark.createDataFrame([], SCHEMA), *FILES).count() == 0


VECTORS = "vec_id long, label long, embedding array<float>"


def mined(rows, scale=256, low=50, high=95):
    """Hard negatives by scoring every row."""
    held = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held[i] = min(held.get(i, (label, v)), (label, v))
    whole = {i: (label, [math.floor(scale * x) for x in v]) for i, (label, v) in held.items()}
    out = []
    for a in (i for i in whole if i % 5 == 0):
        label, v = whole[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in whole.items() if i != a)
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            hard = [s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p]
            out += [(a, positive, n, i, -p, -s) for n, (s, i, _) in enumerate(hard[:3], 1)]
    return out


@pytest.mark.parametrize("dims, spread", [(3, 1), (16, 2), (1, 4)])
def test_hard_negatives(spark, dims, spread):
    from sitewise.llm.hard_negatives import hard_negatives

    draw = random.Random(dims)
    # coarse values tie often; a third of the rows share a label
    rows = [(i, 1 if i % 3 == 0 else draw.randrange(-1, 4), [draw.randrange(-8, 9) / 8 * spread for _ in range(dims)]) for i in range(240)]
    rows += [(500, None, [1.0] * dims), (None, 1, [1.0] * dims), (505, 1, None), (510, 1, [float("nan")] * dims), (515, 1, [None] * dims)]
    rows += [(520, 2, [float("inf")] * dims), (525, 2, []), (530, 2, [1.0]), (7, 3, [1.0] * dims), rows[0], rows[0], (535, 9, [0.0] * dims)]
    frame = clashing(spark.createDataFrame(rows, VECTORS), "rank", "part", "block", "rows", "positives")
    got = hard_negatives(frame, F.col("vec_id") % 5 == 0, shard_rows=11, block=7, blocks_each=2)
    assert sorted(map(tuple, got.collect())) == sorted(mined(rows))
    assert hard_negatives(frame.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives(frame.where("label = 1"), F.col("vec_id") % 5 == 0).count() == 0


def test_hard_negatives_are_exact_beyond_doubles(spark):
    from sitewise.llm.hard_negatives import hard_negatives

    # scores near 2**56 that differ by little
    rows = [(i, i % 2, [float(2**28 - 16 * (i % 7)), float(-16 * i), 2.0**27]) for i in range(60)]
    got = hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 5 == 0, shard_rows=16, scale=1, low=0, high=100)
    assert sorted(map(tuple, got.collect())) == sorted(mined(rows, 1, 0, 100))
    huge = [(i, i % 2, [1e30 + i * 1e29, 1.0]) for i in range(12)]
    top = hard_negatives(spark.createDataFrame(huge, VECTORS), F.col("vec_id") % 5 == 0, low=0, high=100).collect()
    assert all(r.positive_score == 2**63 - 1 for r in top)


def test_threshold_algorithm_stops_early_and_right():
    import numpy as np

    from sitewise.llm.hard_negatives import SortedLists, in_windows, nearest

    draw = np.random.default_rng(5)
    vectors = np.floor(draw.normal(size=(3000, 3)) * 256)
    lists = SortedLists(np.arange(3000), vectors)
    read = []
    for anchor in vectors[:20]:
        exact = vectors @ anchor
        order = np.lexsort((lists.ids, -exact))
        scores, best = nearest(lists, anchor, -1, 5)
        read.append(np.count_nonzero(scores))
        assert best.tolist() == order[:5].tolist()
        top = exact[order[0]]
        _, (found,) = in_windows(lists, anchor, [top], 50, 95, 3)
        assert found.tolist() == [i for i in order if 50 * top <= 100 * exact[i] <= 95 * top][:3]
    assert np.mean(read) < 1500


def removed(rows, length):
    """(doc_id, n_words, n_removed, digest, longest) by a table of all windows."""
    last = 2**63 - 1
    lists = [(last if d is None else d, words(t)) for d, t in rows]
    found, size = [[set(), 0] for _ in rows], length
    while size <= max((len(w) for _, w in lists), default=0):
        least = {}
        for d, w in lists:
            for i in range(len(w) - size + 1):
                key = tuple(w[i : i + size])
                least[key] = min(least.get(key, last), d)
        for (d, w), held in zip(lists, found):
            late = [i for i in range(len(w) - size + 1) if least[tuple(w[i : i + size])] < d]
            if size == length:
                held[0].update(i + k for i in late for k in range(length))
            if late:
                held[1] = size
        size *= 2
    out = []
    for (d, _), (_, w), (gone, long_) in zip(rows, lists, found):
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), long_, kept))
    return out


@pytest.mark.parametrize("length, shard_bytes", [(50, 4 << 20), (50, 3000), (7, 900), (21, 2000)])
def test_repeated_windows(spark, given, length, shard_bytes):
    from sitewise.llm.substring_dedup import remove_repeated_windows

    draw = random.Random(length)
    passage = " ".join(draw.choices("abcdefgh", k=130))
    rows = given[:60] if length == 50 else []
    rows = rows + [(3000 + i, " ".join(draw.choices("xyz", k=draw.randrange(60)))) for i in range(40)]
    rows += [(4000 + i, f"{i} {passage[: 40 + 9 * i]} {i} {passage}") for i in range(12)]
    rows += [(9001, None), (9002, ""), (9003, "  \n\t "), (9004, passage), (9004, passage), (None, passage), (None, passage), (9005, "word " * 400), (9006, "word " * 90)]
    docs = clashing(spark.createDataFrame(rows, SCHEMA), "kept", "shard", "part", "blob", "found", "longest")
    got = remove_repeated_windows(docs, length=length, shard_bytes=shard_bytes, longest=True, with_kept=True)
    want = sorted(removed(rows, length), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    short = remove_repeated_windows(docs, length=length, shard_bytes=shard_bytes)
    assert sorted(map(tuple, short.collect()), key=str) == sorted([r[:4] for r in want], key=str)


def test_repeated_windows_of_nothing(spark):
    from sitewise.llm.substring_dedup import levels, remove_repeated_windows

    assert levels(50) == [25, 50] and levels(9) == [9] and levels(100) == [25, 50, 100]
    empty = spark.createDataFrame([], SCHEMA)
    assert remove_repeated_windows(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], SCHEMA)
    assert [r.n_words for r in remove_repeated_windows(blank).collect()] == [0, 0]


def test_parts_of_the_right_length_are_compared_too():
    import numpy as np

    from sitewise.llm.token_alignment import _different, _gives_back

    pieces, sizes = [b"a", b"b", b"ab"], np.array([1, 1, 2])
    ids, given = [[0, 1], [2], [1, 0], [], [0], [2, 0]], [b"ab", b"ab", b"ab", b"", b"b", b"ab"]
    assert _gives_back(ids, pieces, sizes, given).tolist() == [True, True, False, True, False, False]
    assert _gives_back(ids[:2], pieces, sizes, given[:2]).all() and not len(_gives_back([], pieces, sizes, []))
    assert _different(np.array([3, 1, 3, 2, 1])).tolist() == [1, 2, 3] and not len(_different(np.empty(0, np.int64)))
