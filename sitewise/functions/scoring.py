"""URL value score and its explanation."""

from functools import reduce
from operator import add

from pyspark.sql import functions as F

from sitewise import dims
from sitewise.functions.urls import is_same_domain, path


def _rule(points, reason):
    return F.struct(F.lit(points).alias("points"), F.lit(reason).alias("reason"))


def _first_match(text, rules):
    """First matching rule; one combined look rules most paths out early."""
    chain = None
    for pattern, points, reason in rules:
        hit = text.rlike(pattern)
        rule = _rule(points, reason)
        chain = F.when(hit, rule) if chain is None else chain.when(hit, rule)
    anything = "|".join(f"(?:{pattern})" for pattern, _, _ in rules)
    return F.when(text.rlike(anything), chain)


def _every_match(text, rules):
    anything = "|".join(f"(?:{pattern})" for pattern, _, _ in rules)
    found = F.array_compact(
        F.array(*[F.when(text.rlike(p), _rule(n, why)) for p, n, why in rules])
    )
    return F.when(text.rlike(anything), found).otherwise(
        F.array().cast("array<struct<points:int,reason:string>>")
    )


def with_url_score(
    df,
    url="url",
    base_url=None,
    valuable_paths=dims.VALUABLE_PATHS,
    excluded_paths=dims.EXCLUDED_PATHS,
):
    """Add ``score`` and ``reason``.

    The path is taken once, the rules are matched once into a narrow struct, and
    the points and the text are both read from that struct.
    """
    link = F.col(url)
    foreign = F.lit(False)
    if base_url is not None:
        base = F.col(base_url)
        given = F.coalesce(base, F.lit("")) != ""
        foreign = given & ~is_same_domain(link, base)
    valuable = F.array(*[F.lit(w) for w in dims.words_of(valuable_paths)])
    excluded = F.array(*[F.lit(w) for w in dims.words_of(excluded_paths)])
    p = F.col("_path")
    parts = df.withColumn("_path", F.lower(path(F.lower(link)))).withColumn(
        "_rules",
        F.struct(
            foreign.alias("foreign"),
            F.get(F.filter(valuable, lambda w: p.contains(w)), F.lit(0)).alias("word"),
            F.filter(excluded, lambda w: p.contains(w)).alias("excluded"),
            _first_match(p, dims.HIGH_VALUE_PATTERNS).alias("high"),
            _every_match(p, dims.LOW_VALUE_PATTERNS).alias("low"),
            (F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))).alias("depth"),
            F.length(link).alias("size"),
        ),
    )
    r = F.col("_rules")
    points = [
        F.when(r["word"].isNotNull(), 10).otherwise(0),
        F.size(r["excluded"]) * -10,
        F.coalesce(r["high"]["points"], F.lit(0)),
        F.aggregate(r["low"], F.lit(0), lambda total, rule: total + rule["points"]),
        F.when(r["depth"] > 4, -2).when(r["depth"] <= 2, 2).otherwise(0),
        F.when(r["size"] > 150, -3).when(r["size"] < 50, 1).otherwise(0),
        F.when(p.isin(dims.HOMEPAGE_PATHS), 5).otherwise(0),
    ]
    reasons = F.array_compact(
        F.concat(
            F.array(F.concat(F.lit("contains_"), r["word"])),
            F.transform(r["excluded"], lambda w: F.concat(F.lit("excluded_"), w)),
            F.array(r["high"]["reason"]),
            F.transform(r["low"], lambda rule: rule["reason"]),
            F.array(
                F.when(r["depth"] > 4, "deep_url").when(r["depth"] <= 2, "shallow_url"),
                F.when(r["size"] > 150, "very_long_url").when(
                    r["size"] < 50, "short_url"
                ),
                F.when(p.isin(dims.HOMEPAGE_PATHS), "homepage"),
            ),
        )
    )
    text = F.when(F.size(reasons) > 0, F.array_join(reasons, ", ")).otherwise(
        "no_special_markers"
    )
    return (
        parts.withColumn("score", F.when(r["foreign"], -100).otherwise(reduce(add, points)))
        .withColumn("reason", F.when(r["foreign"], "different_domain").otherwise(text))
        .drop("_path", "_rules")
    )
