"""DuckDB SQL with the rows of the registered queries."""

from sitewise.llm.quality_rules import RULES, STOP_WORDS


def _rule_sql():
    fails = []
    for top, bottom, least, most in RULES.values():
        ratio = f"(CASE WHEN {bottom} > 0 THEN {top}::DOUBLE / {bottom} ELSE 0.0 END)"
        if least is not None:
            fails.append(f"{ratio} < {least}")
        if most is not None:
            fails.append(f"{ratio} > {most}")
    return " OR ".join(fails)


QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 3, 1))) AS i, ws FROM w),
s AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS gram FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM s),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
      FROM r, (SELECT unnest(range(0, 5)) AS k) WHERE n > 1 GROUP BY doc_id),
c AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             1 + len(list_filter(ws, lambda x: x IN ({", ".join(repr(y) for x in STOP_WORDS for y in (x, x.capitalize()))}))) AS n_stop_words_and_one,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis_lines,
             len(list_filter(ls, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS n_bullet_lines
      FROM w),
j AS (SELECT c.*, coalesce(p.n_repeat_words, 0)::BIGINT AS n_repeat_words FROM c LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({_rule_sql()}) AS kept
FROM b
"""

URL_FILTERS = r"""
WITH parts AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id * 7 % 30)::INT AS fetch_date,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1) AS rest FROM pages),
hosts AS (SELECT *, nullif(lower(regexp_extract(rest, '^(?:[^/@]*@)?([^/:@]*)', 1)), '') AS host,
                 regexp_extract(rest, '^[^/]*/([^/]+)', 1) AS segment FROM parts),
keyed AS (SELECT page_id, url, fetch_date, CASE WHEN segment <> '' THEN host || '/' || segment END AS prefix,
                 host, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain FROM hosts),
entries AS (
  SELECT CASE WHEN event_type IN ('purchase', 'view') THEN prefix
              WHEN event_type IN ('error', 'click') THEN host ELSE domain END AS pattern,
         ts::DATE AS entry_date, event_id AS seq,
         CASE WHEN event_type = 'signup' THEN value >= 60 ELSE event_type IN ('purchase', 'error') END AS listed
  FROM events JOIN keyed ON user_id = page_id),
daily AS (SELECT pattern, entry_date, arg_max(listed, seq) AS listed FROM entries
          WHERE pattern IS NOT NULL AND listed IS NOT NULL GROUP BY ALL),
spans AS (SELECT pattern, listed, entry_date AS valid_from,
                 lead(entry_date) OVER (PARTITION BY pattern ORDER BY entry_date) AS valid_to FROM daily),
hits AS (
  SELECT page_id, level, pattern, valid_from FROM (
    SELECT page_id, fetch_date, 1 AS level, prefix AS key FROM keyed
    UNION ALL SELECT page_id, fetch_date, 2, host FROM keyed
    UNION ALL SELECT page_id, fetch_date, 3, domain FROM keyed)
  JOIN spans ON key = pattern AND listed AND valid_from <= fetch_date
            AND (valid_to IS NULL OR fetch_date < valid_to)),
best AS (SELECT page_id, arg_min(pattern, level) AS pattern, arg_min(valid_from, level) AS since FROM hits GROUP BY page_id)
SELECT k.page_id, url, fetch_date, pattern IS NOT NULL AS blocked, pattern AS matched_pattern, since AS listed_since
FROM keyed k LEFT JOIN best b ON k.page_id = b.page_id
"""

# The base-32 form of a SHA-1: each of its 32 digits is 5 of the 160 bits.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, h, unhex(sha1(h))::BIT::VARCHAR AS bits FROM p),
b AS (SELECT page_id, n, h,
        list_aggregate(list_transform(range(0, 32), lambda i:
          substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + list_sum(list_transform(range(0, 5), lambda k:
              substr(bits, (5 * i + k + 1)::INT, 1)::INT * (16 >> k::INT)))::INT, 1)), 'string_agg', '') AS digest,
        max(page_id) OVER (PARTITION BY h) AS holder FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM b
"""

# Every window of an item's length around a shared shingle, compared exactly.
DECONTAMINATION = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
dp AS (SELECT doc_id, len(ws) - 4 AS n, ws, unnest(range(0, greatest(len(ws) - 4, 0))) AS p FROM dw),
ip AS (SELECT item_id, len(ws) - 4 AS n, ws, unnest(range(0, greatest(len(ws) - 4, 0))) AS p FROM iw),
dg AS (SELECT doc_id, n, p, list_slice(ws, p + 1, p + 5) AS g FROM dp),
ig AS (SELECT item_id, n, list_slice(ws, p + 1, p + 5) AS g, count(*) AS c FROM ip GROUP BY ALL),
hits AS (SELECT doc_id, item_id, dg.n AS dn, ig.n AS m, dg.p FROM dg JOIN ig USING (g)),
st AS (SELECT DISTINCT doc_id, item_id, m, greatest(dn - m, 0) AS last,
         unnest(range(least(greatest(p - m + 1, 0), greatest(dn - m, 0)), least(p, greatest(dn - m, 0)) + 1)) AS s FROM hits),
wg AS (SELECT st.doc_id, st.item_id, st.m, st.s, dg.g, count(*) AS c FROM st JOIN dg
       ON dg.doc_id = st.doc_id AND dg.p >= st.s AND dg.p < st.s + st.m GROUP BY ALL),
ov AS (SELECT wg.doc_id, wg.item_id, wg.m, wg.s, sum(wg.c) AS size, sum(least(wg.c, coalesce(ig.c, 0))) AS both_
       FROM wg LEFT JOIN ig ON ig.item_id = wg.item_id AND ig.g = wg.g GROUP BY ALL),
j AS (SELECT doc_id, item_id, s, both_::DOUBLE / (size + m - both_)::DOUBLE AS similarity FROM ov)
SELECT doc_id, item_id, max(similarity) AS similarity,
       (-arg_max(-s, (similarity, -s)))::BIGINT AS start_word
FROM j WHERE similarity >= 0.8 GROUP BY ALL
"""

HARD_NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same,
             list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM e a JOIN e r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

# Windows of 50 words that an earlier document holds, word by word.
SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 49, 0))) AS p FROM d),
h AS (SELECT doc_id, p, md5_number(array_to_string(list_slice(ws, p + 1, p + 50), ' ')) AS h FROM p),
m AS (SELECT doc_id, p FROM h QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id),
g AS (SELECT DISTINCT doc_id, p + k AS i FROM m, (SELECT unnest(range(0, 50)) AS k)),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM d),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept, count(*) AS n FROM w ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
