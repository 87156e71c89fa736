"""Registered queries of the operators: whole tables in, whole results out."""

import public_tokenizers
from pyspark.sql import functions as F

from sitewise.llm import checks
from sitewise.llm.common import table
from sitewise.llm.decontamination import find_leaks
from sitewise.llm.hard_negatives import hard_negatives
from sitewise.llm.minhash_forest import jaccard_join
from sitewise.llm.packing import pack_documents
from sitewise.llm.pii import find_pii
from sitewise.llm.quality_rules import quality_rules
from sitewise.llm.substring_dedup import remove_repeated_windows
from sitewise.llm.suffix_dedup import remove_repeats
from sitewise.llm.token_alignment import align_tokens
from sitewise.llm.token_counts import token_counts
from sitewise.llm.toxicity import score_toxicity, train
from sitewise.llm.url_filters import filter_urls, url_keys
from sitewise.llm.warc import archive_and_read

QUERIES = {}
CHECKS = {}


def query(name, sql=None):
    def register(plan):
        QUERIES[name] = plan
        if sql is not None:
            CHECKS[name] = sql
        return plan

    return register


@query("op1_toxicity")
def op1_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, table(spark, folder, "labels"))
    return score_toxicity(docs, model).drop("text")


@query("op2_warc", checks.WARC)
def op2_warc(spark, folder):
    return archive_and_read(table(spark, folder, "pages"))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, folder):
    return remove_repeats(table(spark, folder, "documents"))


@query("op4_token_counts")
def op4_token_counts(spark, folder):
    """Tokens of every line of every document."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


@query("op5_quality_rules", checks.QUALITY_RULES)
def op5_quality_rules(spark, folder):
    return quality_rules(table(spark, folder, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query("op6_decontamination", checks.DECONTAMINATION)
def op6_decontamination(spark, folder):
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_jaccard_join")
def op7_jaccard_join(spark, folder):
    return jaccard_join(table(spark, folder, "documents"))


@query("op8_pii")
def op8_pii(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return find_pii(docs).drop("text", "clean_text")


@query("op9_url_filters", checks.URL_FILTERS)
def op9_url_filters(spark, folder):
    """Captures: every page, fetched on a day of January 2024 set by its id. List:
    the events log; an event about a page lists or unlists one of its patterns."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    day = (F.col("page_id") * 7 % 30).cast("int")
    captures = pages.withColumn("fetch_date", F.date_add(F.lit("2024-01-01").cast("date"), day))
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    keys = url_keys(F.col("url"))
    entries = events.join(pages, events.user_id == pages.page_id).select(
        F.when(F.col("event_type").isin("purchase", "view"), keys["prefix"])
        .when(F.col("event_type").isin("error", "click"), keys["host"])
        .otherwise(keys["domain"])
        .alias("pattern"),
        F.to_date("ts").alias("entry_date"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", F.col("value") >= 60)
        .otherwise(F.col("event_type").isin("purchase", "error"))
        .alias("listed"),
    )
    return filter_urls(captures, entries)


@query("op10_packing")
def op10_packing(spark, folder):
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(table(spark, folder, "documents"), tokenizer)


@query("op11_token_alignment")
def op11_token_alignment(spark, folder):
    files = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
    return align_tokens(table(spark, folder, "documents"), *files)


@query("op12_hard_negatives", checks.HARD_NEGATIVES)
def op12_hard_negatives(spark, folder):
    """Anchors: every fiftieth id. Every seventh id carries the next label."""
    vectors = table(spark, folder, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", noisy), anchors=F.col("vec_id") % 50 == 0)


@query("op13_substring_dedup", checks.SUBSTRING_DEDUP)
def op13_substring_dedup(spark, folder):
    return remove_repeated_windows(table(spark, folder, "documents"))
