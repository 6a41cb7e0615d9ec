"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op9_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len(s) AS n, array_to_string(s, ' ') AS s
  FROM (SELECT item_id, w[i:i + 12] AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0))),
spot AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT spot.doc_id, spot.i, spot.n, win.item_id FROM spot JOIN win ON spot.s = win.s AND spot.n = win.n),
per AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS items
  FROM hit GROUP BY doc_id),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN words USING (doc_id)
"""

SQL["op2_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.q, b.q) DESC, b.vec_id)::INTEGER AS rank
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
WHERE rank <= 5
"""

SQL["op13_importance_resampling"] = r"""
WITH bits AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
texts AS (SELECT doc_id, 's' AS side, text FROM documents UNION ALL SELECT NULL, 't', text FROM benchmark),
words AS (
  SELECT row_number() OVER () AS k, doc_id, side,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM texts),
grams AS (
  SELECT k, side, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT k, side, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)),
counted AS (SELECT k, side, g, count(*) AS c FROM grams GROUP BY ALL),
bucket AS (
  SELECT g, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(h), 2),
      lambda p: ((instr('0123456789ABCDEF', h[p + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[p + 2]) - 1)::BIGINT)),
    lambda r, b: xor(r >> 8, tab[(xor(r, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM grams)), bits),
sums AS (
  SELECT b, coalesce(sum(c) FILTER (WHERE side = 's'), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (WHERE side = 't'), 0)::DOUBLE AS t
  FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN (counted JOIN bucket USING (g)) ON bucket = b GROUP BY b),
gain AS (
  SELECT b, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM sums),
weight AS (SELECT k, sum(c * gain)::BIGINT AS weight, sum(c)::BIGINT AS n FROM counted JOIN bucket USING (g) JOIN gain ON bucket = b GROUP BY k),
score AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weight USING (k) WHERE side = 's'),
place AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (WHERE n_words >= 20) OVER () AS n FROM score)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 5 * n // 100 THEN r END AS rank FROM place
"""
