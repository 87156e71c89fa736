"""Operators against brute force on small tables with odd rows."""

import array
import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
ODD = [(9001, None), (9002, ""), (9003, "   \n\t "), (9004, "word " * 3000), (9004, "word " * 3000), (None, "an odd row")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame(rows + ODD, SCHEMA)
    clash = ("score", "spans", "n_words", "kept", "start", "length", "node", "bucket", "shard", "item", "clean_text")
    return frame.select("*", *[F.lit("x").alias(c) for c in clash]).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_counts(spark, docs, rows, empty):
    from sitewise.llm.quality_rules import quality_rules

    got = {(r.doc_id, r.n_words): r for r in quality_rules(docs).collect()}
    for doc_id, text in rows + ODD:
        w = words(text)
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        r = got[doc_id, len(w)]
        assert r.word_chars == sum(map(len, w)) and r.n_repeat_words == len(again)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality_rules(empty).count() == 0


def test_toxicity_learns_and_takes_odd_rows(spark, docs, empty):
    from sitewise.llm.toxicity import score_toxicity, train

    every = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = train(every, labels)
    scored = score_toxicity(every, model)
    out = scored.join(labels, "doc_id").where("held_out").select("score", "toxic").collect()
    pairs = [(t.score, o.score) for t in out if t.toxic for o in out if not o.toxic]
    assert sum(a > b for a, b in pairs) / len(pairs) > 0.7
    odd = score_toxicity(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in odd)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in odd if r.doc_id is not None)
    assert score_toxicity(empty, model).count() == 0
    assert score_toxicity(empty, train(empty, labels.limit(0))).count() == 0


def test_warc_round_trip(spark, empty):
    from sitewise.llm.common import shared_folder
    from sitewise.llm.warc import archive_and_read, read_records, write_archives

    data = [(1, "http://a/", "same"), (2, "http://b/\n", "same"), (3, None, None), (4, "http://d", ""), (5, "x", "é"), (2, "http://b/\n", "same")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(2)
    folder = shared_folder(spark, "test")
    index = write_archives(pages, folder)
    got = sorted(map(tuple, read_records(index, folder, with_payload=True).collect()), key=str)
    holder = {"same": 2, "": 4, "é": 5}
    want = []
    for page, _, html in data:
        payload = (html or "").encode()
        held = holder[html or ""] == page
        want.append((page, len(payload), "response" if held else "revisit", None if held else holder[html or ""], payload if held else None))
    assert sorted([(r[0], r[1], r[3], r[4], None if r[5] is None else bytes(r[5])) for r in got], key=str) == sorted(want, key=str)
    one = index.where("page_id = 5").first()
    with open(one.file, "rb") as f:
        assert gzip.decompress(f.read()[one.offset : one.offset + one.length]).startswith(b"WARC/1.1\r\n")
    assert read_records(index.where("page_id = 5"), folder).count() == 1
    long = [(i, "u", f"{i} " * 1_500_000, "x", 1) for i in (1, 2)] + [(3, None, f"{1} " * 1_500_000, "x", 1)]
    long = spark.createDataFrame(long, "page_id long, url string, html string, file string, offset long")
    read = archive_and_read(long)
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in read.collect()) == [(1, 3_000_000, "revisit", 3), (2, 3_000_000, "response", None), (3, 3_000_000, "response", None)]
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert archive_and_read(none).count() == 0
    many = spark.range(3000).selectExpr("id as page_id", "'u' as url", "repeat(sha2(string(id), 256), 3) as html").repartition(4)
    held = write_archives(many, shared_folder(spark, "many"))
    read = read_records(held, folder, chunk_bytes=1 << 12, task_bytes=1 << 15)
    assert read.rdd.getNumPartitions() == held.agg(F.sum("length")).first()[0] // (1 << 15) > 8
    assert [r.page_id for r in read.orderBy("page_id").collect()] == list(range(3000))
    assert write_archives(none, shared_folder(spark, "none")).count() == 0


@pytest.mark.parametrize("rule", ["start", "majority"])
def test_token_counts(spark, docs, rows, empty, rule):
    from sitewise.llm.token_counts import encoding, token_counts

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    own, sizes = encoding(path, pattern)
    got = collections.defaultdict(dict)
    for r in token_counts(docs, path, pattern, rule=rule).where("doc_id < 9004").collect():
        got[r.doc_id][r.section] = r
    for doc_id, text in (rows + ODD)[:60] + ODD[:3]:
        if doc_id is None:
            continue
        ends, at = [], 0
        for line in (text or "").split("\n"):
            at += len(line.encode()) + 1
            ends.append(at)
        count, at = collections.Counter(), 0
        for i in own.encode_ordinary(text or ""):
            share = collections.Counter(next(s for s, e in enumerate(ends) if b < e) for b in range(at, at + int(sizes[i])))
            home = min(share) if rule == "start" else min(share, key=lambda s: (-share[s], s))
            count[home] += 1
            at += int(sizes[i])
        assert {s: r.n_tokens for s, r in got[doc_id].items() if r.n_tokens} == dict(count)
        assert all(r.doc_tokens == sum(count.values()) for r in got[doc_id].values())
    assert token_counts(empty, path, pattern).count() == 0


def leaks(docs_, items, threshold=0.8):
    out = {}
    grams = lambda t: [tuple(w[i : i + 5]) for w in [words((t or "").lower())] for i in range(len(w) - 4)]
    own = {i: grams(t) for i, t in items}
    for doc_id, text in docs_:
        g = grams(text)
        for item, want in own.items():
            if not want or not set(want) & set(g):
                continue
            for s in range(max(1, len(g) - len(want) + 1)):
                a, b = collections.Counter(g[s : s + len(want)]), collections.Counter(want)
                both = sum((a & b).values())
                j = both / (sum(a.values()) + len(want) - both)
                if j >= threshold:
                    out[doc_id, item] = max(out.get((doc_id, item), (0, 0)), (j, -s))
    return {k: (j, -s) for k, (j, s) in out.items()}


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_decontamination(spark, docs, rows, empty, broadcast):
    from sitewise.llm.decontamination import find_leaks

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, None), (901, "too few words"), (902, "word " * 20), (903, "word " * 20)]
    passage = words(items[3][1])
    near = passage[:]
    near[0] = "changed"
    extra = [(8001, " ".join(near)), (8002, "before " + " ".join(passage).upper() + " after"), (8003, " ".join(passage[:-3]))]
    frame = docs.unionByName(spark.createDataFrame(extra, SCHEMA), allowMissingColumns=True)
    got = find_leaks(frame, spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=broadcast).collect()
    want = leaks([r for r in rows + ODD + extra if r[0] is not None], items)
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in got} == {k: (round(j, 9), s) for k, (j, s) in want.items()}
    assert len(got) == len(want) and (8002, items[3][0]) in want
    assert find_leaks(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_simhash_of_long_arrays(spark):
    from sitewise.llm.decontamination import simhash

    draw = random.Random(9)
    arrays = [[], [-1], [draw.getrandbits(63) for _ in range(101)], [-1] * 32_767, [-1] * 32_768]
    arrays += [[-1] * 40_000 + [5] * 39_999 + [draw.getrandbits(64) - (1 << 63) for _ in range(21)]]
    want = []
    for values in arrays:
        held = np.array(values, np.int64).view(np.uint64)
        bits = [2 * int(((held >> np.uint64(k)) & np.uint64(1)).sum()) > len(values) for k in range(64)]
        want.append(int(np.array(sum(b << k for k, b in enumerate(bits)), np.uint64).view(np.int64)))
    frame = spark.createDataFrame(list(enumerate(arrays)), "i int, h array<bigint>")
    assert [r.s for r in frame.select("i", simhash(F.col("h")).alias("s")).orderBy("i").collect()] == want


@pytest.mark.parametrize("block", [1000, 2])
def test_jaccard_join(spark, docs, rows, empty, block):
    from sitewise.llm.minhash_forest import jaccard_join

    every = [r for r in rows + ODD if r[0] is not None]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (words((t or "").lower()) for _, t in every)]
    first, links = list(range(len(every))), [0] * len(every)

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                links[i], links[j] = links[i] + 1, links[j] + 1
                first[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(every):
        least[root(i)] = min(least.get(root(i), d), d)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(docs, block=block).where("doc_id is not null").collect())
    assert got == sorted((d, least[root(i)], links[i]) for i, (d, _) in enumerate(every))
    assert jaccard_join(empty).count() == 0


def _near_copies(n, seed=4):
    draw = random.Random(seed)
    base = [f"w{draw.randint(0, 10**9)}" for _ in range(400)]
    out = []
    for i in range(n):
        own = base[:]
        own[draw.randrange(400)] = f"own{i}"
        out.append((i, " ".join(own)))
    return out


def test_jaccard_groups_do_not_grow_with_the_component(spark, monkeypatch):
    from sitewise.llm import minhash_forest

    verify = minhash_forest._verify

    def bounded(threshold):
        inner = verify(threshold)

        def check(table):
            assert table.num_rows <= 120, table.num_rows
            return inner(table)

        return check

    monkeypatch.setattr(minhash_forest, "_verify", bounded)
    frame = spark.createDataFrame(_near_copies(400), SCHEMA).repartition(3)
    got = minhash_forest.jaccard_join(frame, block=20, bundle_members=40).collect()
    assert len(got) == 400 and {(r.class_id, r.n_links) for r in got} == {(0, 399)}


def test_shared_passages_do_not_chain_candidates(spark):
    from sitewise.llm import minhash_forest as forest
    from sitewise.llm.shingles import connected, shingle_set

    draw = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"t{draw.randint(0, 10**9)}" for _ in range(60)]) for _ in range(150)]
    texts += [t + " more" for t in texts[:40]]  # pairs far over the threshold, each far from the hub
    length = forest.prefix_length(0.8, 16, 0.9995)
    rows = []
    for i, text in enumerate(texts):
        keys, signature = forest.prefixes(shingle_set(text), 16, length)
        rows.append((f"{i:04d}", keys.tolist(), bytearray(signature)))
    nodes = spark.createDataFrame(rows, "node string, keys array<bigint>, signature binary")
    for block in (1000, 15):
        label = {r.node: r.label for r in connected(forest.candidate_links(nodes, 16, length, 0.8, block)).collect()}
        assert all(label[f"{i:04d}"] == label[f"{150 + i:04d}"] for i in range(40))
        assert max(collections.Counter(label.values()).values()) < 20


def test_suffix_dedup(spark, docs, rows, empty):
    from sitewise.llm.suffix_dedup import remove_repeats

    draw = random.Random(5)
    more = [(7000 + i, "".join(draw.choice("ab\0") for _ in range(draw.randint(0, 300)))) for i in range(40)]
    more += [(7100 + i, "x" * draw.randint(0, 200)) for i in range(10)]
    every = [(10**9 if d is None else d, (t or "").encode()) for d, t in rows + ODD + more]
    least = {}
    for d, b in sorted(every):
        for i in range(len(b) - 49):
            least.setdefault(b[i : i + 50], d)
    want = []
    for d, b in every:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        n = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want.append((d, len(b), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    frame = docs.unionByName(spark.createDataFrame(more, SCHEMA), allowMissingColumns=True).repartition(5)
    out = remove_repeats(frame, shard_bytes=60_000, bucket_bytes=50_000).collect()
    assert sorted((10**9 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == sorted(want)
    assert remove_repeats(empty).count() == 0


def test_merge_by_binary_search():
    import numpy as np
    from sitewise.llm.suffix_dedup import merge

    draw = np.random.default_rng(3)
    tables = []
    for _ in range(2):
        keys = np.unique(draw.integers(0, 6, (80, 3)).astype(np.uint64), axis=0)
        tables.append((keys, draw.integers(0, 99, len(keys))))
    want = {}
    for keys, least in tables:
        for k, d in zip(map(tuple, keys), least):
            want[k] = min(want.get(k, 99), d)
    keys, least = merge(*tables)
    assert [*map(tuple, keys)] == sorted(want) and [*least] == [want[k] for k in sorted(want)]


def plain_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        luhn = sum(d if i % 2 == 0 else (2 * d) % 10 + (2 * d) // 10 for i, d in enumerate(digits))
        if 16 <= len(digits) <= 19 and luhn % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_pii_base_spans():
    from sitewise.llm.pii import base_spans

    draw = random.Random(1)
    for letters in ("a1.@-+ (", "0123456789. -+()", "ab@.c"):
        for _ in range(5000):
            text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))
            assert base_spans(text) == plain_spans(text)


def term(word):
    from sitewise.llm.pii import _hash

    return _hash(word)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_pii_terms(spark, docs, rows, empty, broadcast):
    from sitewise.llm.pii import find_pii, revealing_terms

    told = [(6000 + i, f"row{i} zorblatt writes to boss@corp.example.com from desk{i} and the rest") for i in range(6)]
    alone = [(6050, "nobody saw zorblatt, nor the desk")]
    more = [(6100 + i, f"the plain row and nothing {i}") for i in range(60)]
    frame = docs.unionByName(spark.createDataFrame(told + alone + more, SCHEMA), allowMissingColumns=True)
    terms = revealing_terms(frame)
    found = {r.term for r in terms.collect()}
    # beside the same words each time, "writes" was seen in one place only
    assert term("zorblatt") in found and not found & {term(w) for w in ("the", "writes", "nothing")}
    out = {(r.doc_id, r.n_email): r for r in find_pii(frame, terms, broadcast_rows=broadcast).collect()}
    for doc_id, text in rows + ODD + told:
        base = plain_spans(text or "")
        r = out[doc_id, sum(k == "email" for k, _, _ in base)]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
    assert "zorblatt" not in out[6000, 1].clean_text and "boss@" not in out[6000, 1].clean_text
    assert out[6050, 0].spans == "term:11:19" and out[6050, 0].clean_text == "nobody saw , nor the desk"
    assert find_pii(empty).count() == 0


def disclosed(texts, least=0.5, prior=2.0):
    """The rule recomputed: {(entity, term): disclosure}."""
    from sitewise.llm.pii import class_key, entity_key

    together, places = collections.defaultdict(set), collections.defaultdict(set)
    size, total = collections.Counter(), 0
    for text in texts:
        spans = plain_spans(text or "")
        bare = [m for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "") if not any(a < m.end() and m.start() < b for _, a, b in spans)]
        terms = [m[0].strip(".,;:!?\"'()[]{}").lower() for m in bare]
        terms = [t if len(t) > 1 else "" for t in terms]
        first = {}
        for i, t in enumerate(terms):
            if t:
                first.setdefault(t, (terms[i - 1] if i else "", terms[i + 1] if i + 1 < len(terms) else ""))
        entities = {class_key(k) for k, _, _ in spans} | {entity_key(k, text[a:b]) for k, a, b in spans}
        n_words = len(set(words(text)))
        total += n_words
        for t, place in first.items():
            places[t].add(place)
            for e in entities:
                together[e, t].add(place)
        for e in entities:
            size[e] += n_words
    out = {}
    for (e, t), seen in together.items():
        k, n, rate = len(seen), len(places[t]), min(size[e] / total, 0.999)
        share = (k + prior * rate) / (n + prior)
        apart = (n - k) * math.log((n - k) / (n * (1 - rate))) if n > k else 0
        if share >= least and k / n > rate and k * math.log(k / (n * rate)) + apart > math.log(max(2, len(together))):
            out[e, t] = share
    return out


@pytest.mark.parametrize("copies", [1, 12])
def test_pii_disclosure_equals_the_rule_at_two_sizes(spark, copies):
    from sitewise.llm.pii import revealing_terms

    draw = random.Random(copies)
    common = ["".join(draw.choices("aeiourst", k=draw.randrange(2, 6))) for _ in range(300)]
    people = [(f"Name{i}", f"n{i}@corp.example.com") for i in range(15 * copies)]
    texts = []
    for i in range(250 * copies):
        words_ = draw.choices(common, k=draw.randrange(5, 60)) + [f"rare{draw.randrange(800 * copies)}"]
        if i % 5 == 0:
            name, mail = draw.choice(people)
            words_ += [name + ",", mail] if draw.random() < 0.8 else [name]
        if i % 17 == 0:
            words_ += ["call", f"+1 (555) {draw.randrange(10**6, 10**7)}"]
        draw.shuffle(words_)
        texts += [" ".join(words_)] * (1 + 3 * (i % 40 == 0))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + ODD, SCHEMA)
    want = {(e, term(t)): round(x, 9) for (e, t), x in disclosed(texts + [t for _, t in ODD]).items()}
    assert want and {(r.entity, r.term): round(r.disclosure, 9) for r in revealing_terms(frame).collect()} == want
    reached = {t for _, t in disclosed(texts)}
    assert any(t.startswith("name") for t in reached) and not any(t.startswith("rare") for t in reached)


def test_pii_leaves_clean_documents_alone(spark):
    from sitewise.llm.pii import find_pii

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = find_pii(docs.select("doc_id", "text")).select("text", "clean_text", "base_sha256").collect()
    none = hashlib.sha256(b"").hexdigest()
    clean = [r for r in out if r.base_sha256 == none]
    assert sum(r.text != r.clean_text for r in clean) <= 0.02 * len(clean)


def test_url_filters(spark):
    from datetime import date

    from sitewise.llm.url_filters import filter_urls

    day = lambda n: date(2024, 1, n)
    entries = [("a.com", day(3), 1, True), ("a.com", day(5), 2, False), ("a.com", day(5), 1, True), ("x.a.com/p", day(1), 1, True), (None, day(1), 1, True)]
    captures = [(1, "http://A.com/q", day(n)) for n in (2, 3, 4, 5, 9)] + [(2, "https://x.a.com/p/z?k", day(4)), (3, None, day(4)), (4, "nothing", day(4)), (2, "http://a.com", None)]
    out = filter_urls(
        spark.createDataFrame(captures, "page_id long, url string, fetch_date date"),
        spark.createDataFrame(entries, "pattern string, entry_date date, seq long, listed boolean"),
    ).collect()
    hits = {(r.page_id, r.fetch_date): (r.matched_pattern, r.listed_since) for r in out if r.blocked}
    assert hits == {(1, day(3)): ("a.com", day(3)), (1, day(4)): ("a.com", day(3)), (2, day(4)): ("x.a.com/p", day(1))}
    assert len(out) == len(captures)
    kinds = "page_id long, url string, fetch_date date, pattern string, spans string", "pattern string, entry_date date, seq long, listed boolean, url string"
    one, none = spark.createDataFrame([(1, "http://a.com/q", day(4), "p", "s")] * 2, kinds[0]), spark.createDataFrame([], kinds[1])
    assert [(r.page_id, r.blocked, r.matched_pattern) for r in filter_urls(one, none).collect()] == [(1, False, None)] * 2
    tied = spark.createDataFrame([("a.com", day(3), 1, False, "u"), ("a.com", day(3), 1, True, "u")], kinds[1])
    assert [r.listed_since for r in filter_urls(one, tied).collect()] == [day(3)] * 2
    assert filter_urls(one.limit(0), tied).count() == 0


def test_hot_host_is_split(spark):
    from sitewise.llm.url_filters import filter_urls

    captures = spark.range(40_000, numPartitions=8).selectExpr("id as page_id", "if(id % 20 = 0, concat('http://h', id, '.com/'), 'http://hot.com/') as url", "date'2024-01-05' as fetch_date")
    entries = spark.range(2000).selectExpr("if(id = 0, 'hot.com', concat('h', id * 20, '.com')) as pattern", "date'2024-01-02' as entry_date", "id as seq", "true as listed")
    small = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "adaptive.advisoryPartitionSizeInBytes": "16k"}
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(f"spark.sql.{k}", v)
        out = filter_urls(captures, entries)
        assert out.where("not blocked").select("page_id").collect() == [(0,)]
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)


def test_packing(spark, docs, rows, empty):
    from sitewise.llm.packing import pack_documents
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    capacity = 256
    odd = [(5000, "áb É́"), (5001, "<|endoftext|> x"), (5002, "don't it's İstanbul ΣΑΣ"), (5003, "日本語 text, ok...")]
    frame = docs.select("doc_id", "text").unionAll(spark.createDataFrame(odd, SCHEMA))
    out = pack_documents(frame, path, capacity=capacity, shard_pieces=100).collect()
    want = collections.Counter()
    for doc_id, text in rows + ODD + odd:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), capacity):
            piece = array.array("I", ids[a : a + capacity]).tobytes()
            want[doc_id, a, len(piece) // 4, zlib.crc32(piece), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert pack_documents(empty, path).count() == 0


def test_best_fit_is_tightest():
    from sitewise.llm.packing import best_fit_decreasing

    draw = random.Random(2)
    lengths = sorted((draw.randint(1, 64) for _ in range(400)), reverse=True)
    room, want = [], []
    for n in lengths:
        fits = [r for r in room if r >= n]
        if fits:
            want.append(64 - min(fits))
            room[room.index(min(fits))] -= n
        else:
            want.append(0)
            room.append(64 - n)
    assert [offset for _, offset in best_fit_decreasing(lengths, 64)] == want


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        assert kept.count() >= 0.8 * docs.count()
        docs = kept
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() > 0.7 * spark.read.parquet(f"{SF}/documents.parquet").count()


def test_anchors_are_dealt_evenly():
    from sitewise.llm.suffix_dedup import anchors

    data = random.Random(5).randbytes(400_000)
    found = np.unique(anchors(data + bytes(66), 50)[:400_000])
    shares = np.bincount((found >> np.uint64(59)).astype(int), minlength=32) / len(found)
    assert shares.max() < 1.5 / 32 and shares.min() > 0.5 / 32
    twice = anchors(data[:500] + data[:500] + bytes(66), 50)
    assert (twice[:450] == twice[500:950]).all()
