"""Plain SQL with the results of those queries that SQL can express."""

_WHITE = r"' ' || chr(9) || chr(10) || chr(13)"

SQL = {
    "p1_found": f"""
WITH rules AS (
  SELECT collection, min(max_chars) AS max_chars FROM split_profiles WHERE max_chars >= 1 GROUP BY collection
), docs AS (
  SELECT DISTINCT d.doc_id, d.text, coalesce(r.max_chars, (SELECT max_chars FROM rules WHERE collection = 'default')) AS m
  FROM documents d LEFT JOIN rules r ON d.collection = r.collection
), big AS (
  SELECT doc_id, m, text, regexp_replace(text, '\\n[ \\t\\r]*(\\n[ \\t\\r]*)+', chr(1), 'g') AS paras,
    regexp_replace(regexp_replace(replace(text, chr(10), chr(1)), '([.!?])[ \\t\\r]+', '\\1' || chr(1), 'g'), '([。！？])', '\\1' || chr(1), 'g') AS sents
  FROM docs WHERE length(text) > m
), longest AS (
  SELECT doc_id, m,
    list_max(list_transform(string_split(paras, chr(1)), lambda x: length(trim(x, {_WHITE})))) AS paragraph,
    list_max(list_transform(string_split(text, chr(10)), lambda x: length(trim(x, {_WHITE})))) AS line,
    list_max(list_transform(string_split(sents, chr(1)), lambda x: length(trim(x, {_WHITE})))) AS sentence,
    list_max(list_transform(regexp_split_to_array(sents, '[ \\t\\r' || chr(1) || ']+'), lambda x: length(x))) AS word
  FROM big
)
SELECT doc_id, CASE WHEN paragraph <= m THEN 'paragraph' WHEN line <= m THEN 'line' WHEN sentence <= m THEN 'sentence'
  WHEN word <= m THEN 'word' ELSE 'character' END AS finest_cut
FROM longest""",
    "p5_found": """
WITH last AS (
  SELECT query_id, max(struct_pack(c := created_at, l := coalesce(latency_ms, -1), k := collection)) AS r
  FROM query_results WHERE query_id IS NOT NULL AND created_at IS NOT NULL AND NOT isnan(created_at) GROUP BY query_id
), valid AS (
  SELECT r.k AS collection, r.l AS latency_ms,
    CAST(date_trunc('week', DATE '1970-01-01' + CAST(floor(r.c / 86400) AS INTEGER)) AS DATE) AS week
  FROM last WHERE NOT isnan(r.l) AND r.l >= 0
), counted AS (
  SELECT v.collection, v.week, t.quantile_name, t.quantile, count(*) AS n, count(*) FILTER (v.latency_ms <= t.limit_ms) AS below
  FROM valid v, latency_targets t GROUP BY ALL
)
SELECT collection, strftime(week, '%Y-%m-%d') AS week_start, quantile_name FROM counted
WHERE n >= 20 AND below < ceil(round(quantile * n, 9))""",
    "p3_found": """
WITH u AS (
  SELECT chunk_id, any_value(CAST(dense_vector AS DOUBLE[])) AS v FROM chunk_records
  WHERE dense_vector IS NOT NULL AND len(dense_vector) = 64 AND chunk_id IS NOT NULL
    AND len(list_filter(dense_vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(dense_vector, lambda x: x <> 0)) > 0
  GROUP BY chunk_id
), s AS (
  SELECT a.chunk_id AS x, b.chunk_id AS y, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.chunk_id <> b.chunk_id
), r AS (
  SELECT x, y, c, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS place FROM s WHERE c >= 0.9
)
SELECT DISTINCT least(x, y) AS chunk_id_a, greatest(x, y) AS chunk_id_b FROM r WHERE place <= 10""",
    "p4_found": r"""
WITH spaced AS (
  SELECT DISTINCT chunk_id, text, regexp_replace(regexp_replace(lower(text), '([\x{4E00}-\x{9FFF}])', ' \1 ', 'g'), '[^\p{L}\p{N}]+', ' ', 'g') AS s
  FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL
), words AS (
  SELECT chunk_id, text, list_filter(string_split(s, ' '), lambda x: x <> '') AS w FROM spaced
), runs AS (
  SELECT DISTINCT text, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS run
  FROM words WHERE len(w) >= 60
), sizes AS (
  SELECT text, count(*) AS n FROM runs GROUP BY text
), common AS (
  SELECT a.text AS x, b.text AS y, count(*) AS c FROM runs a JOIN runs b ON a.run = b.run AND a.text <= b.text GROUP BY ALL
), alike AS (
  SELECT x, y FROM common JOIN sizes p ON p.text = x JOIN sizes q ON q.text = y WHERE c >= 0.5 * (p.n + q.n - c)
)
SELECT DISTINCT least(a.chunk_id, b.chunk_id) AS chunk_id_a, greatest(a.chunk_id, b.chunk_id) AS chunk_id_b
FROM alike JOIN words a ON a.text = x JOIN words b ON b.text = y WHERE a.chunk_id <> b.chunk_id""",
}
_PAIRS = SQL["p4_found"].replace("WITH spaced", "WITH RECURSIVE spaced").replace("SELECT DISTINCT least(", ", pairs AS (SELECT DISTINCT least(") + ")"
SQL["p4_groups"] = f"""{_PAIRS}, edges AS (SELECT chunk_id_a AS x, chunk_id_b AS y FROM pairs UNION SELECT chunk_id_b, chunk_id_a FROM pairs),
reached AS (SELECT x, x AS y FROM edges UNION SELECT r.x, e.y FROM reached r JOIN edges e ON e.x = r.y)
SELECT r.x AS chunk_id, min(r.y) AS group_id, any_value(n.links) AS links FROM reached r JOIN (SELECT x, count(*) AS links FROM edges GROUP BY x) n ON n.x = r.x GROUP BY r.x"""
SQL["p1_covered"] = f"""{SQL["p1_found"][: SQL["p1_found"].index("), big AS")]})
SELECT DISTINCT doc_id, length(text) AS n_chars, 0 AS gaps, 0 AS too_long, 0 AS other_text FROM docs WHERE length(text) > m"""
