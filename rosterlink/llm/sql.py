"""SQL for DuckDB of the queries that SQL can express."""

URL_FILTER = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), hosts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path
  FROM parts
), rules(verdict, rule, rule_host, rule_path) AS (
  VALUES ('allow', 'com/', 'com', '/'),
         ('block', 'example.com/en/', 'example.com', '/en/'),
         ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
         ('block', 'net/es/', 'net', '/es/'),
         ('block', 'net/fr/', 'net', '/fr/')
), best AS (
  SELECT page_id, host, path, max_by(rule, length(rule)) AS rule,
         max_by(verdict, length(rule)) AS verdict
  FROM hosts LEFT JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
"""

QUALITY_RULES = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), spots AS (
  SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i:
           {'i': i, 'gram': words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]})) AS spot
  FROM base
), windows AS (
  SELECT doc_id, spot.i AS i, count(*) OVER (PARTITION BY doc_id, spot.gram) AS n FROM spots
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM windows, (SELECT unnest(range(3)) AS k) WHERE n > 1 GROUP BY doc_id
), measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(words, lambda w: w = upper(w) AND w <> lower(w))) AS n_upper_words
  FROM base LEFT JOIN repeats USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.1::DOUBLE * n_words
            OR n_dup_lines > 0.5::DOUBLE * n_lines
            OR n_upper_words > 0.3::DOUBLE * n_words) AS kept
FROM judged
"""

LATTICE_HASHING = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS id, vec_id AS root FROM embeddings
  UNION SELECT b, root FROM reach JOIN links ON id = a
), roots AS (
  SELECT id, min(root) AS component_id FROM reach GROUP BY id
), degrees AS (
  SELECT a AS id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN roots ON vec_id = roots.id LEFT JOIN degrees ON vec_id = degrees.id
"""

BOTTOM_K = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM split
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS id, doc_id AS root FROM documents
  UNION SELECT b, root FROM reach JOIN both_ways ON id = a
), roots AS (
  SELECT id, min(root) AS component_id FROM reach GROUP BY id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id,
       d.doc_id = component_id AS kept
FROM documents d JOIN roots ON d.doc_id = roots.id LEFT JOIN sizes ON d.doc_id = sizes.doc_id
"""

# Every string of 100 bytes by itself, in hexadecimal digits.
REPEATED_SPANS = """
WITH h AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS nr, octet_length(encode(coalesce(text, ''))) AS n,
         hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (
  SELECT nr, p, md5_number(substr(x, 2 * p + 1, 200)) AS w
  FROM (SELECT nr, x, unnest(range(0, n - 99)) AS p FROM h WHERE n >= 100)),
r AS (
  SELECT nr, p FROM (SELECT nr, p, row_number() OVER (PARTITION BY w ORDER BY nr, p) AS nth FROM s) WHERE nth > 1),
i AS (
  SELECT nr, p, CASE WHEN p <= lag(p) OVER (PARTITION BY nr ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT nr, p, sum(new) OVER (PARTITION BY nr ORDER BY p) AS run FROM i),
runs AS (SELECT nr, min(p) AS a, max(p) + 100 AS z FROM g GROUP BY nr, run),
pieces AS (
  SELECT nr, coalesce(lag(z) OVER (PARTITION BY nr ORDER BY a), 0) AS f, a AS t FROM runs
  UNION ALL SELECT nr, max(z), NULL FROM runs GROUP BY nr),
kept AS (
  SELECT nr, string_agg(substr(x, 2 * f + 1, 2 * (coalesce(t, n) - f)), '' ORDER BY f) AS k
  FROM pieces JOIN h USING (nr) GROUP BY nr),
cut AS (SELECT nr, sum(z - a) AS gone, count(*) AS spans FROM runs GROUP BY nr)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM h LEFT JOIN kept USING (nr) LEFT JOIN cut USING (nr)
"""

SQL = {
    "op1_url_filter": URL_FILTER,
    "op2_quality_rules": QUALITY_RULES,
    "op3_lattice_hashing": LATTICE_HASHING,
    "op4_bottom_k": BOTTOM_K,
    "op12_repeated_spans": REPEATED_SPANS,
}
