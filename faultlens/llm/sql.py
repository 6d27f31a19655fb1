"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from faultlens.llm.quality import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             regexp_extract_all(lower(translate(t, '.,;:', '')), '[^\x20\x09-\x0D]+') AS plain,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM w)),
rep AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g),
cov AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM rep WHERE k > 1) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
             len(list_filter(plain, lambda x: x IN ({_STOP}))) AS n_stop
      FROM w LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words
        AND word_chars / n_words::DOUBLE BETWEEN 2.5 AND 12.0 AND n_symbols / n_words::DOUBLE <= 0.2
        AND n_stop / n_words::DOUBLE >= 0.1 AND n_dup_lines / greatest(n_lines, 1)::DOUBLE <= 0.4) AS kept
FROM m
"""

EXACT_DEDUP = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents),
r AS (SELECT doc_id, s, first_value(doc_id) OVER (PARTITION BY s ORDER BY length(t) DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY s) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM r
"""

LINE_DEDUP = r"""
WITH l AS (SELECT doc_id, i, lines[i] AS line
           FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
                 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
k AS (SELECT doc_id, i, line,
             translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT doc_id, i, line, (keep IS NOT NULL AND keep <> doc_id) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html,
    row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS place,
    first(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS first_id
  FROM pages)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(sha1(html), (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first_id END AS refers_to
FROM p
"""

COLLOCATIONS = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, (len(w) - k + 2)::BIGINT), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, range(1, 5) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE f >= 30 AND k >= 2),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:cut], ' ')
    JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (
  SELECT lang, a AS longer, unnest(list_transform(range(1, (k - s + 2)::BIGINT), lambda i: array_to_string(w[i:i + s - 1], ' '))) AS phrase
  FROM c, range(2, 4) t(s) WHERE s < k),
held AS (SELECT lang, phrase, max(longer) AS longer FROM inner_ GROUP BY ALL),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN held USING (lang, phrase)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
"""
