"""The stages of the pipeline row by row, with repeated and null ids."""

import collections
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

SCHEMA = "doc_id long, text string"


def prose(draw, n, vocabulary=6000):
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def changed(text, place):
    words = text.split(" ")
    return " ".join([*words[:place], "other", *words[place + 1 :]])


def frame(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    clash = ("_row", "class_id", "n_links", "start_word", "n_email", "score")
    return docs.select("*", *[F.lit("x").alias(c) for c in clash]).repartition(3)


def kept(stage, spark, rows, folder=None):
    docs = frame(spark, rows)
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    return collections.Counter((r.doc_id, r.text) for r in out.collect())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    draw = random.Random(8)
    items = [(i, prose(draw, 25)) for i in range(20)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(i, i % 3 == 0) for i in range(600)], "doc_id long, bad boolean").select(
        "doc_id", F.col("bad").cast("int").alias("toxic")
    ).write.parquet(f"{top}/labels.parquet")
    return top, items


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_one_row_of_each_class_stays(spark):
    draw = random.Random(4)
    a, b, c, d = (prose(draw, 80) for _ in range(4))
    rows = [(5, a), (3, changed(a, 10)), (3, changed(a, 60)), (3, b), (7, changed(b, 40)), (7, c), (None, changed(a, 30))]
    rows += [(None, prose(draw, 50)), (8, d), (8, d), (None, d), (9, ""), (10, None), (11, " \n"), (12, "few words"), (13, "Few  words")]
    rows += [(None, "only copies without id here"), (None, "only copies without id here")]
    rows += [(100 + i, changed(changed(c, i), 79 - i)) for i in range(6)]
    different = sorted({*rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets = [shingles(t) for _, t in different]
    label = [*range(len(different))]
    for _ in different:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and len(x & y) >= 0.8 * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
    out = kept(P.drop_near_copies, spark, rows)
    assert set(out.values()) == {1} and set(out) <= set(different)
    classes = collections.Counter(label[different.index(r)] for r in out)
    assert classes == collections.Counter({*label})
    for r in out:
        assert r[0] == different[label[different.index(r)]][0]
    assert (7, c) in out and (7, changed(b, 40)) not in out and (None, changed(a, 30)) not in out
    assert kept(P.drop_near_copies, spark, []) == {}


def test_leaks_go_row_by_row(spark, folder):
    top, items = folder
    draw = random.Random(9)
    hold = lambda i: f"{prose(draw, 30)} {items[i][1]} {prose(draw, 9)}"
    leaks = [(1, hold(0)), (None, hold(1)), (2, hold(2).upper()), (3, changed(items[3][1], 0)), (4, hold(4)), (4, hold(4))]
    clean = [(2, prose(draw, 90)), (None, prose(draw, 40)), (5, ""), (6, None), (7, "few words"), (8, items[5][1][:40])]
    clean += [(9, prose(draw, 60))] * 2
    assert kept(P.drop_leaks, spark, leaks + clean, top) == collections.Counter(clean)
    assert kept(P.drop_leaks, spark, [], top) == {}


def test_toxic_rows_go(spark, folder):
    top, _ = folder
    draw = random.Random(10)
    made = lambda: "".join(draw.choice("aeiourstlnmd") for _ in range(8))
    plain, foul = [made() for _ in range(900)], [made() for _ in range(40)]

    def text(toxic):
        return " ".join(draw.choice(foul if toxic and draw.random() < 0.5 else plain) for _ in range(60))

    known = [(i, text(i % 3 == 0)) for i in range(600)]
    new = [(700 + i, text(i % 2 == 0)) for i in range(40)] + [(None, text(True)), (None, text(False))]
    new += [(900, text(True)), (900, text(False)), (901, ""), (902, None)] + [(903, text(False))] * 2
    out = kept(P.drop_toxic, spark, known + new, top)
    toxic = {t for i, t in known if i % 3 == 0} | {t for i, t in new[:40] if i % 2 == 0} | {new[40][1], new[42][1]}
    rows = collections.Counter(known + new)
    assert out == collections.Counter({r: n for r, n in rows.items() if r[1] not in toxic})
    assert kept(P.drop_toxic, spark, [], top) == {}


def test_personal_data_goes_and_rows_stay(spark):
    from sitewise.llm.pii import base_spans

    draw = random.Random(11)
    clean = [(1, prose(draw, 40)), (1, prose(draw, 30)), (None, prose(draw, 30)), (2, "")] + [(3, "twice the same")] * 2
    held = [(4, "mail a.b@c.example.org now"), (None, "from 10.0.0.1 on"), (4, "call +1 (555) 010-9999 or x@y.org")]
    out = P.clean_pii(spark, frame(spark, clean + held + [(5, None)]), None).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(i for i, _ in clean + held + [(5, None)])
    assert collections.Counter((r.doc_id, r.text) for r in out) >= collections.Counter(clean + [(5, "")])
    assert all(not base_spans(r.text) and r.n_chars == len(r.text) and r._row == "x" for r in out)
    assert {r.text for r in out if "<" in r.text} == {"mail <email> now", "from <ip> on", "call <phone> or <email>"}
    assert kept(P.clean_pii, spark, []) == {}


def test_every_token_is_packed_once(spark):
    from tokenizers import Tokenizer

    draw = random.Random(12)
    rows = [(i, prose(draw, draw.randrange(1, 400))) for i in range(60)] + [(7, prose(draw, 5)), (None, "no id"), (90, ""), (91, None)]
    rows += [(92, prose(draw, 6000))] * 2
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    want = collections.Counter()
    for doc_id, text in rows:
        want[doc_id] += len(encode(text or "", add_special_tokens=False).ids) + 1
    out = P.pack(spark, frame(spark, rows), None).collect()
    got, filled = collections.Counter(), collections.Counter()
    for r in out:
        got[r.doc_id] += r.length
        filled[r.sequence_id] += r.length
    assert got == want and max(filled.values()) <= 2048
    assert P.pack(spark, frame(spark, []), None).count() == 0
