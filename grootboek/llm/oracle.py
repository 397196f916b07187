"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

#: Base32 of a SHA-1: 32 groups of 5 bits, each read from two neighbouring hexadecimal digits.
ORACLE["op8_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, strlen(body) AS payload_bytes, hex,
    array_to_string([
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
        ((position(substr(hex, CAST(5 * i // 4 + 1 AS INT), 1) IN '0123456789abcdef') - 1) * 16
          + position(substr(hex || '0', CAST(5 * i // 4 + 2 AS INT), 1) IN '0123456789abcdef') - 1)
        >> CAST(3 - (5 * i) % 4 AS INT)) & 31), 1) for i in range(32)], '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = min(page_id) OVER w THEN NULL ELSE min(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY hex)
"""

ORACLE["op9_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS words
  FROM documents
), totals AS (SELECT count(*) AS n, sum(len(words)) / count(*) AS mean FROM d
), w AS (SELECT r, doc_id, len(words) AS dl, unnest(words) AS word FROM d
), tf AS (SELECT r, doc_id, dl, word, count(*) AS tf FROM w GROUP BY ALL
), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word
), gain AS (
  SELECT r, doc_id, word,
    floor(10000 * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (1.2 + 1)
      / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))) AS gain
  FROM tf JOIN df USING (word), totals
), q AS (SELECT doc_id AS query, word, tf AS times FROM tf WHERE doc_id % 50 = 0
), s AS (
  SELECT query, r, doc_id, CAST(sum(times * gain) AS BIGINT) AS score FROM q JOIN gain USING (word) GROUP BY ALL
), ranked AS (
  SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM s WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""

ORACLE["op11_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), w AS (SELECT r, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS of_lang FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), n AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
), langs AS (
  SELECT lang, count(term) AS v, coalesce(sum(of_lang), 0) AS whole
  FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang
), sized AS (
  SELECT lang, source, v, whole, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) JOIN langs USING (lang) GROUP BY ALL
), p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
    CAST(1 + (1000000000 * (coalesce(n, 0) + 2)) // CAST(total + 2 * v AS BIGINT) AS BIGINT) AS p,
    CAST(1 + (1000000000 * (of_lang + 2)) // CAST(whole + 2 * v AS BIGINT) AS BIGINT) AS of_all
  FROM sized JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS BIGINT) AS value
  FROM sized a JOIN sized b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), over AS (
  SELECT lang, source, term AS item, (p - of_all) * (p - of_all) // (p + of_all) AS value FROM p WHERE n > 0 AND p > of_all
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
    CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank
  FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value,
    CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT)
  FROM over
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLE["op12_max_sketch"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), totals AS (
  SELECT count(*) AS n_all, CAST(sum(len(terms)) AS BIGINT) AS l_all FROM d WHERE len(terms) > 0
), w AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d
), tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM w SEMI JOIN q USING (term) GROUP BY ALL
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals
), scores AS (
  SELECT item_id, r, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_all) // l_all)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN weight USING (term), totals GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank,
    doc_id, score
  FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""
