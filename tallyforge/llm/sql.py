"""DuckDB statements for the training-data queries that SQL can express on whole tables."""

OP6 = r"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS mark, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_rows FROM docs GROUP BY source
), weighed AS (
  SELECT source, source_size, source_rows, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM src
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source ASC NULLS LAST) AS k FROM weighed
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM ordered
), chosen AS (
  SELECT arg_min(level, k) AS level FROM levels WHERE 3 * source_size >= level * weight
), goals AS (
  SELECT source, source_size, source_rows, least((3 * source_size)::DOUBLE, coalesce(chosen.level * weight, 'inf'::DOUBLE)) AS target FROM levels, chosen
), ratios AS (
  SELECT *, floor(coalesce(target / nullif(source_size, 0), 0)) AS whole, coalesce(target / nullif(source_size, 0), 0) - floor(coalesce(target / nullif(source_size, 0), 0)) AS p FROM goals
), ranked AS (
  SELECT d.doc_id, d.source, d.size, r.source_size, r.target, r.whole, r.p, r.target - r.whole * r.source_size AS rest,
    coalesce(least(greatest((d.size * r.source_rows)::DOUBLE / nullif(r.source_size, 0), 0.5::DOUBLE), 2.0::DOUBLE), 1.0::DOUBLE) AS tilt,
    (('0x' || substr(md5('11:' || coalesce(d.doc_id::VARCHAR, '-') || ':' || d.size::VARCHAR || ':' || d.mark), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM docs d JOIN ratios r ON d.source IS NOT DISTINCT FROM r.source
), placed AS (
  SELECT *, CASE WHEN p > 0 THEN ((u / (1 - u)) / ((p / (1 - p)) * tilt)) / (1 + (u / (1 - u)) / ((p / (1 - p)) * tilt)) ELSE 1 END AS q FROM ranked
), summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST((whole + CASE WHEN p > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM summed
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, {_WORDS} AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM places
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 5 * c >= 4 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), classes AS (
  SELECT a, min(b) AS class_id FROM reach GROUP BY a
), counted AS (
  SELECT l.a, count(*) AS n_links, count(DISTINCT y.text) FILTER (WHERE y.text <> x.text) AS n_text_links FROM links l JOIN d x ON x.doc_id = l.a JOIN d y ON y.doc_id = l.b GROUP BY l.a
)
SELECT d.doc_id, classes.class_id, coalesce(n_links, 0) AS n_links, coalesce(n_text_links, 0) AS n_text_links
FROM d JOIN classes ON classes.a = d.doc_id LEFT JOIN counted ON counted.a = d.doc_id
"""

OP4 = f"""
WITH d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark
), item_places AS (
  SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM item_places
), sizes AS (
  SELECT DISTINCT n FROM windows
), doc_places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n
), hits AS (
  SELECT p.doc_id, p.i, p.n, v.item FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM doc_places) p JOIN windows v ON v.n = p.n AND v.x = p.x
), covered AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS word FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items, sha256(coalesce(f.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
"""
