"""DuckDB SQL for the queries that SQL can express."""

ORACLES = {
    "op1_url_filters": r"""
WITH rules(verdict, host, path) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
  ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
p AS (SELECT row_number() OVER () AS r, page_id,
  translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*(/[^?#]*)', 1, 's') AS path FROM pages),
m AS (SELECT p.*, rules.host || rules.path AS rule, rules.verdict AS v,
  row_number() OVER (PARTITION BY r ORDER BY length(rules.host || rules.path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host))
    AND starts_with(p.path, rules.path))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
""",
    "op6_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
g2 AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c >= 2),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g2) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
l2 AS (SELECT r, line, regexp_replace(line, '[\x20\x09-\x0D]', '', 'g') AS bare FROM l),
l3 AS (SELECT r, line, length(line) AS n,
  (NOT regexp_matches(regexp_replace(line, '[\x20\x09-\x0D]+$', ''),
     '[.!?…。！？:;]["''”’»)\]]*$|["''”’»)\]]$')
   OR 10 * length(regexp_replace(line, '[^#*$%&|<>!]', '', 'g')) > length(bare)
   OR length(regexp_replace(line, '[^|»›•→]', '', 'g')) >= 2
   OR regexp_matches(line, '(?i)lorem ipsum|\bcookies?\b|javascript|terms of (use|service)|privacy policy|all rights reserved|sign (in|up)|log ?in\b|subscribe|newsletter|click here|read more|share this|skip to content')) AS fails
  FROM l2 WHERE bare <> ''),
la AS (SELECT r, count(*) - count(DISTINCT line) AS dup, sum(n) AS total, coalesce(sum(n) FILTER (WHERE fails), 0) AS lost
  FROM l3 GROUP BY r),
f AS (SELECT doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(la.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(la.total, 0) AS BIGINT) AS n_line_chars, CAST(coalesce(la.lost, 0) AS BIGINT) AS n_lost_chars
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN la USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT n_lost_chars > 0.3::DOUBLE * n_line_chars AS kept
FROM f
""",
}
