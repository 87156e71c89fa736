"""Error-code lookups and the per-report error summary over array columns.

The catalogue has a fixed 19 rows, so the lookups over code arrays are literal
maps; table-shaped lookups are broadcast joins in ``operators.errors``.
"""

from pyspark.sql import functions as F

from sitewise import dims


def _literal_map(pairs):
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def _catalog(position):
    return _literal_map([(row[0], row[position]) for row in dims.ERROR_CATALOG])


def category_of(code):
    return F.try_element_at(_catalog(2), code)


def action_of(code):
    return F.try_element_at(_catalog(3), code)


def severity_of(code):
    """Severity name; unknown codes count as medium."""
    return F.coalesce(F.try_element_at(_catalog(4), code), F.lit("medium"))


def priority_of(code):
    ranks = _literal_map([(name, rank) for name, rank, _ in dims.SEVERITIES])
    return F.try_element_at(ranks, severity_of(code))


def error_text(code, include_action=True):
    """Message plus guidance for a code, 'Unknown error: <code>' otherwise."""
    guidance = {action: text for action, _, text, _ in dims.ACTION_GUIDANCE}
    texts = [
        (c, f"{message} {guidance[action]}." if include_action else message)
        for c, message, _, action, _ in dims.ERROR_CATALOG
    ]
    return F.coalesce(
        F.try_element_at(_literal_map(texts), code),
        F.concat(F.lit("Unknown error: "), code),
    )


def categories(codes):
    """map<category, codes>: unknown codes dropped, duplicates kept, first-seen order."""
    names = F.array_distinct(F.array_compact(F.transform(codes, category_of)))
    return F.map_from_entries(
        F.transform(
            names,
            lambda name: F.struct(
                name, F.filter(codes, lambda code: category_of(code) == name)
            ),
        )
    )


def user_message(codes):
    """One sentence for the user; payment before rate limit before the rest."""
    seen = F.map_keys(categories(codes))
    return (
        F.when(_any_of(codes, dims.PAYMENT_CODES), dims.PAYMENT_MESSAGE)
        .when(_any_of(codes, dims.RATE_LIMIT_CODES), dims.RATE_LIMIT_MESSAGE)
        .when(F.array_contains(seen, "server_error"), dims.SERVER_MESSAGE)
        .when(F.array_contains(seen, "configuration"), dims.CONFIGURATION_MESSAGE)
        .otherwise(
            F.concat(
                F.lit(dims.OTHER_AREAS_PREFIX), F.array_join(seen, ", "), F.lit(".")
            )
        )
    )


def _any_of(codes, wanted):
    return F.arrays_overlap(codes, F.array(*[F.lit(c) for c in wanted]))


def error_summary(codes):
    """Summary struct of one report's ordered codes; null arrays count as empty.

    A report holds at most one discovery code and one code per kept URL, so the
    array is short by construction.
    """
    codes = F.coalesce(codes, F.array().cast("array<string>"))
    some = F.size(codes) > 0
    worst = F.array_max(F.transform(codes, priority_of))
    rank_names = _literal_map([(rank, name) for name, rank, _ in dims.SEVERITIES])
    actions = F.array_sort(
        F.array_distinct(F.array_compact(F.transform(codes, action_of)))
    )
    return F.struct(
        some.alias("has_errors"),
        F.when(some, F.size(codes)).alias("total_errors"),
        F.when(some, codes).alias("error_codes"),
        F.when(some, categories(codes)).alias("categories"),
        F.when(some, _any_of(codes, dims.PAYMENT_CODES)).alias("has_payment_issues"),
        F.when(some, F.filter(codes, lambda c: c.isin(dims.PAYMENT_CODES))).alias(
            "payment_errors"
        ),
        F.when(some, _any_of(codes, dims.RATE_LIMIT_CODES)).alias(
            "has_rate_limit_issues"
        ),
        F.when(some, F.filter(codes, lambda c: c.isin(dims.RATE_LIMIT_CODES))).alias(
            "rate_limit_errors"
        ),
        F.when(some, F.try_element_at(rank_names, worst)).alias("max_severity"),
        F.when(some, worst).alias("max_priority"),
        F.when(some, actions).alias("recommended_actions"),
        F.when(some, user_message(codes)).alias("user_message"),
    )
