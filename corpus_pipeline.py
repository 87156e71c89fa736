"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of ``documents``.
"""

import public_tokenizers
from pyspark.sql import functions as F

from sitewise.llm.common import table, written
from sitewise.llm.decontamination import find_leaks
from sitewise.llm.minhash_forest import jaccard_join
from sitewise.llm.packing import pack_documents
from sitewise.llm.pii import find_pii
from sitewise.llm.toxicity import score_toxicity, train


def _rows(docs):
    """``docs`` with a key of each row, and the name of the key: ids may be repeated or
    null, so rows are told apart by a 64-bit hash of id and text."""
    name = "_row"
    while name in docs.columns:
        name = "_" + name
    return docs.withColumn(name, F.xxhash64("doc_id", "text")), name


def _apart(docs):
    """``docs`` whose other columns than id and text have names that nothing else uses."""
    own = ("doc_id", "text")
    return docs.toDF(*[c if c in own else f"_column_{i}" for i, c in enumerate(docs.columns)])


def drop_toxic(spark, docs, sf_dir):
    """Documents that the compression distance doesn't call toxic. Rows are judged by
    their text alone: null and empty texts, null and repeated ids alike."""
    rows = _apart(docs)
    model = train(docs, table(spark, sf_dir, "labels"))
    kept = score_toxicity(rows, model).where("predicted = 0")
    return kept.select(*rows.columns).toDF(*docs.columns)


def drop_near_copies(spark, docs, sf_dir):
    """The row with the smallest id of each class of near copies, once; a null id is
    larger than any. Rows equal in id and text are one; other rows of a repeated id are
    judged each by its text. Texts without words are copies of nothing."""
    rows, key = _rows(docs)
    classes = jaccard_join(rows.select(F.col(key).alias("doc_id"), "text"))
    classes = classes.select(F.col("doc_id").alias(key), "class_id").distinct()
    ids = rows.select(key, "doc_id").distinct().join(classes, key)
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("least")
    first = ids.groupBy("class_id").agg(least).select(f"least.{key}")
    kept = rows.join(first, key, "left_semi").dropDuplicates([key, "doc_id"])
    return kept.select(*docs.columns)


def drop_leaks(spark, docs, sf_dir):
    """Rows that hold no passage of the benchmark, each judged by its text: null and
    repeated ids alike. Null and empty texts stay, and so does all where the benchmark
    is empty."""
    rows, key = _rows(docs)
    texts = rows.select(F.col(key).alias("doc_id"), "text")
    leaks = find_leaks(texts, table(spark, sf_dir, "benchmark"))
    leaks = leaks.select(F.col("doc_id").alias(key)).distinct()
    return rows.join(leaks, key, "left_anti").select(*docs.columns)


def clean_pii(spark, docs, sf_dir):
    """Every row, with personal data and what discloses it replaced; a null text is
    empty then."""
    rows = _apart(docs)
    found = find_pii(rows)
    clean = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return found.select(*[clean.get(c, F.col(r)).alias(c) for r, c in zip(rows.columns, docs.columns)])


def pack(spark, docs, sf_dir):
    """Pieces of the documents in sequences of at most 2048 tokens; a null or empty
    text is its closing token, and repeated rows are packed each."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", clean_pii),
    ("packing", pack),
]

#: Compression, MinHash and tokenizers aren't SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
