"""Quality rules: a threshold table compiled into one native projection."""

from pyspark.sql import functions as F

from sitewise.llm.common import let, words_of

#: Common words of English, German, French and Spanish.
STOP_WORDS = (
    "the and of to a in is that it for on with as are was be this by at from or an not "
    "der die das und ist ein eine zu den mit von für auf nicht sich im dem des "
    "le la les de des du et un une est que qui dans pour sur pas en au par "
    "el los las y es por con para una del se lo como no al su"
).split()
SYMBOLS = "#*$%&|<>"

#: name -> (numerator, denominator, smallest, largest). A ratio with an empty
#: denominator is 0; None sets no bound. One is added to the stop words, so that
#: a text of under 50 words, which may hold none by chance, doesn't fail for it.
RULES = {
    "mean_word_length": ("word_chars", "n_words", 2.0, 14.0),
    "symbols_per_word": ("n_symbols", "n_words", None, 0.3),
    "stop_word_share": ("n_stop_words_and_one", "n_words", 0.02, None),
    "duplicate_line_share": ("n_dup_lines", "n_lines", None, 0.6),
    "ellipsis_line_share": ("n_ellipsis_lines", "n_lines", None, 0.3),
    "bullet_line_share": ("n_bullet_lines", "n_lines", None, 0.9),
}


def _repeated_words(words, size):
    """Words inside windows of ``size`` words that the array holds twice or more.

    Windows are compared by 64-bit hash. Only texts with a repeated window pay
    for the sort; every step is linear or a sort, so long texts stay cheap.
    """

    def hashes(w):
        grams = F.transform(
            F.sequence(F.lit(0), F.size(w) - size),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]),
        )
        return F.when(F.size(w) >= size, grams).otherwise(F.array().cast("array<bigint>"))

    def positions(pairs):
        last = F.size(pairs) - 1
        twice = F.filter(
            pairs,
            lambda x, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == x["h"]))
            | ((i < last) & (F.get(pairs, i + 1)["h"] == x["h"])),
        )
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(starts):
        reach = F.transform(
            starts,
            lambda x, i: F.least(F.lit(size), F.coalesce(F.get(starts, i + 1) - x, F.lit(size))),
        )
        return F.aggregate(reach, F.lit(0).cast("bigint"), lambda a, b: a + b)

    def count(grams):
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        long_way = let(let(pairs, positions), covered)
        none = F.size(F.array_distinct(grams)) == F.size(grams)
        return F.when(none, F.lit(0).cast("bigint")).otherwise(long_way)

    return let(let(words, hashes), count)


def without(text, characters):
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def measures(text, repeat_window=5):
    """Struct of counts of a text column; null and empty texts count 0."""
    text = F.coalesce(text, F.lit(""))
    stops = [*STOP_WORDS, *[x.capitalize() for x in STOP_WORDS]]

    def of_words(w):
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            (F.size(F.filter(w, lambda x: x.isin(stops))) + 1).cast("bigint").alias("n_stop_words_and_one"),
            _repeated_words(w, repeat_window).alias("n_repeat_words"),
        )

    def of_lines(lines):
        return F.struct(
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("bigint").alias("n_ellipsis_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("bigint").alias("n_bullet_lines"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return [
        let(words_of(text), of_words).alias("_words"),
        let(lines, of_lines).alias("_lines"),
        F.length(without(text, " \t\n\x0b\x0c\r")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("bigint").alias("n_symbols"),
    ]


def compile_rules(rules):
    """One Boolean column per rule, true where the rule fails."""
    out = {}
    for name, (top, bottom, least, most) in rules.items():
        ratio = F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))
        fails = F.lit(False)
        if least is not None:
            fails = fails | (ratio < least)
        if most is not None:
            fails = fails | (ratio > most)
        out[name] = fails
    return out


def quality_rules(docs, rules=None, min_words=10, max_repeat_percent=20):
    """doc_id, counts, ``base_failed``, ``failed_rules`` and ``kept`` per row.

    One projection over ``docs(doc_id, text, ...)``, no shuffle and no user
    function. Each row is judged alone, so repeated rows, ties and null ids give
    one result each; a null or empty text has 0 words and fails; an empty table
    gives an empty result; other columns of ``docs`` are ignored.
    """
    rules = RULES if rules is None else rules
    counted = docs.select("doc_id", *measures(F.col("text"))).select(
        "doc_id", "_words.*", "_lines.*", "word_chars", "n_symbols"
    )
    base = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    fails = compile_rules(rules)
    names = F.array(*[F.when(f, F.lit(n)) for n, f in fails.items()]) if fails else F.array().cast("array<string>")
    judged = counted.select(
        "*", base.alias("base_failed"), F.array_compact(names).alias("failed_rules")
    )
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
