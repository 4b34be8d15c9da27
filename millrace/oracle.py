"""SQL with the results of the core queries."""

from .functions.text import INDEX_STOP_WORDS, TAG_STOP_WORDS

#: The week that the metrics look at (epoch seconds).
START, END = 1515369600.0, 1515974400.0


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_CHUNKS = """c AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC, text) AS rn FROM chunks) WHERE rn = 1
)"""


def _terms(text: str) -> str:
    runs = f"regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9]+|[一-鿿]+')"
    cjk = "list_concat(string_split(r, ''), list_transform(range(1, length(r)), lambda i: substring(r, i, 2)))"
    terms = f"flatten(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '^[一-鿿]') THEN {cjk} ELSE [lower(r)] END))"
    return f"list_filter({terms}, lambda t: NOT regexp_matches(t, '^[0-9]+$') AND length(t) >= 1 AND NOT list_contains({_list(INDEX_STOP_WORDS)}, t))"


def _index(where: str = "TRUE") -> str:
    return f"""{_CHUNKS}, tok AS (
  SELECT collection, chunk_id, {_terms('text')} AS tokens FROM c WHERE {where}
), len AS (SELECT collection, chunk_id, len(tokens) AS dl FROM tok),
post AS (SELECT collection, term, chunk_id, any_value(dl) AS dl, count(*) AS tf FROM (SELECT collection, chunk_id, len(tokens) AS dl, unnest(tokens) AS term FROM tok) GROUP BY ALL),
corpus AS (SELECT collection, count(*) AS n_docs, sum(dl) / count(*) AS avgdl FROM len GROUP BY collection),
terms AS (SELECT p.collection, term, count(*) AS df, ln((any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM post p JOIN corpus USING (collection) GROUP BY ALL)"""


_IDX = _index().replace("SELECT collection, term, chunk_id, any_value(dl) AS dl, count(*) AS tf FROM (", "SELECT collection, term, chunk_id, dl, count(*) AS tf FROM (")
_PART = "t.idf * CASE WHEN avgdl > 0 THEN p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / avgdl)) ELSE p.tf * 2.5 / (p.tf + 1.5) END"
_ASKED = "asked AS (SELECT collection, query_text, min(query_id) AS query_id FROM query_results WHERE query_text IS NOT NULL GROUP BY ALL)"


def _sparse(asked: str, k: int, name: str = "sparse") -> str:
    return f"""{name}_q AS (SELECT query_id, collection, term, count(*) AS qtf FROM (SELECT query_id, collection, unnest({_terms('query_text')}) AS term FROM {asked}) GROUP BY ALL),
{name}_s AS (
  SELECT query_id, chunk_id, round(sum({_PART} * q.qtf), 8) AS score
  FROM {name}_q q JOIN post p ON p.collection = q.collection AND p.term = q.term JOIN terms t ON t.collection = q.collection AND t.term = q.term JOIN corpus o ON o.collection = q.collection
  GROUP BY ALL HAVING round(sum({_PART} * q.qtf), 8) > 0
), {name} AS (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, score, 'sparse' AS source FROM {name}_s
  QUALIFY rank <= {k}
)"""


_FIFTIETH = "CAST('0x' || substring(md5(chunk_id), 1, 8) AS BIGINT) % 50 = 0"
_VECTORS = f"""v AS (
  SELECT chunk_id, any_value(collection) AS collection, any_value(CAST(dense_vector AS DOUBLE[])) AS dense_vector FROM chunk_records
  WHERE dense_vector IS NOT NULL AND len(dense_vector) = 64 AND len(list_filter(dense_vector, lambda x: x IS NULL OR isnan(x))) = 0 GROUP BY chunk_id
), vq AS (SELECT chunk_id AS query_id, collection, dense_vector AS query_vector FROM v WHERE {_FIFTIETH})"""


def _dense(k: int, distance: str) -> str:
    return f"""dense_s AS (SELECT query_id, chunk_id, round({distance}, 8) + 0.0 AS distance FROM v JOIN vq USING (collection)), dense AS (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank, greatest(0.0, 1 - distance) AS score, 'dense' AS source, distance
  FROM dense_s QUALIFY rank <= {k}
)"""


_L2 = "list_sum(list_transform(list_zip(dense_vector, query_vector), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_COS = "CASE WHEN list_dot_product(dense_vector, dense_vector) > 0 AND list_dot_product(query_vector, query_vector) > 0 THEN 1 - list_dot_product(dense_vector, query_vector) / (sqrt(list_dot_product(dense_vector, dense_vector)) * sqrt(list_dot_product(query_vector, query_vector))) END"
_LEGS = f"""{_IDX}, {_VECTORS}, firsts AS (SELECT chunk_id AS query_id, collection, text AS query_text FROM c WHERE {_FIFTIETH}),
{_sparse('firsts', 20)}, {_dense(20, _L2)}"""
_FUSED = f"""{_LEGS}, fused_s AS (
  SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM (SELECT query_id, chunk_id, rank FROM sparse UNION ALL SELECT query_id, chunk_id, rank FROM dense) GROUP BY ALL
), fused AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, score, 'fusion' AS source FROM fused_s)"""
_HYBRID = f"""{_FUSED}, two AS (SELECT query_id FROM sparse INTERSECT SELECT query_id FROM dense), every AS (
  SELECT * FROM fused WHERE query_id IN (SELECT query_id FROM two)
  UNION ALL SELECT query_id, chunk_id, rank, score, source FROM sparse WHERE query_id NOT IN (SELECT query_id FROM two)
  UNION ALL SELECT query_id, chunk_id, rank, score, source FROM dense WHERE query_id NOT IN (SELECT query_id FROM two)
)"""
_PICK = "SELECT query_id, chunk_id, rank, score, source FROM"
_PATH = "coalesce(nullif(metadata['source_path'], ''), nullif(metadata['source'], ''), '(no source)')"
_TRIM = r"regexp_replace({}, '^[\s\x{{85}}\p{{Z}}]+|[\s\x{{85}}\p{{Z}}]+$', '', 'g')"
_STRIPPED = _TRIM.format("text")
_EXCERPT = f"CASE WHEN length({_STRIPPED}) <= 200 THEN {_STRIPPED} ELSE regexp_replace(substring({_STRIPPED}, 1, 199), '[\\s\\x{{85}}\\p{{Z}}]+$', '') || '…' END"
_CITED = f"""{_IDX}, {_ASKED}, {_sparse('asked', 5)}, cited AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS number, chunk_id, rank, score, source, {_PATH} AS cited,
    coalesce(try_cast(nullif(metadata['page_num'], '') AS INTEGER), try_cast(nullif(metadata['page'], '') AS INTEGER)) AS page, {_EXCERPT} AS excerpt
  FROM sparse JOIN c USING (chunk_id)
)"""
_TASKS = "t AS (SELECT DISTINCT * FROM tasks)"
_DECODED = """d AS (
  SELECT query_id, collection, created_at, source, coalesce(latency_ms, 0.0) AS latency_ms, coalesce(CAST(result_json->>'n_chunks' AS INTEGER), 0) AS n_chunks,
    coalesce(result_json->>'error', '') = '' AS succeeded, coalesce(CAST(result_json->>'degraded' AS BOOLEAN), FALSE) AS degraded, CAST(result_json->'degraded_reasons' AS VARCHAR[]) AS reasons
  FROM query_results WHERE json_valid(result_json)
)"""
_VALID = _DECODED.replace("WHERE json_valid(result_json)", "WHERE json_valid(result_json) AND NOT isnan(coalesce(latency_ms, 0))")
_RATE = "round_even(({}) * 100.0::DOUBLE / nullif({}, 0), 1)"
_EVENTS = "e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY occurred_at, operation NULLS FIRST, token_count NULLS FIRST) AS rn FROM embedding_usage_events WHERE id IS NOT NULL) WHERE rn = 1)"

SQL = {
    "tokenize_terms": f"WITH {_CHUNKS} SELECT chunk_id, {_terms('text')} AS tokens FROM c",
    "term_freq": f"WITH {_IDX} SELECT chunk_id, term, tf FROM post",
    "term_statistics": f"WITH {_IDX} SELECT collection, term, df, round(idf, 6) AS idf FROM terms",
    "corpus_stats": f"WITH {_IDX} SELECT collection, n_docs, round(avgdl, 6) AS avgdl FROM corpus",
    "sparse_vectors": f"""WITH {_index().replace('tok AS (', 'tok AS MATERIALIZED (').replace('post AS (', 'post AS MATERIALIZED (').replace('terms AS (', 'terms AS MATERIALIZED (')}, w AS (
  SELECT p.collection, p.chunk_id, p.term, round({_PART}, 6) AS weight FROM post p JOIN terms t ON t.collection = p.collection AND t.term = p.term JOIN corpus o ON o.collection = p.collection)
SELECT l.chunk_id, count(w.term) AS n_terms, coalesce(CAST(sum(CAST(round(weight * 1e6) AS BIGINT)) AS BIGINT), 0) AS millionths, min(w.term) AS first_term, coalesce(arg_max(w.weight, w.term), 0) AS last_weight FROM len l LEFT JOIN w ON w.chunk_id = l.chunk_id AND w.collection = l.collection GROUP BY l.chunk_id""",
    "bm25_topk": f"WITH {_IDX}, {_ASKED}, {_sparse('asked', 10)} {_PICK} sparse",
    "index_remove": f"WITH {_IDX.replace('FROM c WHERE TRUE', 'FROM c WHERE chunk_index <> 0')} SELECT collection, term, df, round(idf, 6) AS idf FROM terms",
    "index_add": f"WITH {_IDX} SELECT collection, term, df, round(idf, 6) AS idf FROM terms",
    "index_saved": f"WITH {_IDX} SELECT collection, term, df, round(idf, 6) AS idf FROM terms",
    "dense_topk": f"WITH {_VECTORS}, {_dense(10, _L2)} SELECT query_id, chunk_id, rank, score, source, distance FROM dense",
    "dense_topk_cosine": f"WITH {_VECTORS}, {_dense(10, _COS).replace('ORDER BY distance,', 'ORDER BY distance NULLS FIRST,')} SELECT query_id, chunk_id, rank, score, source, distance FROM dense",
    "rrf_fusion": f"WITH {_FUSED} {_PICK} fused",
    "hybrid_search": f"WITH {_HYBRID} {_PICK} every WHERE rank <= 10",
    "hybrid_postfilter": f"""WITH {_HYBRID}, ok AS (SELECT chunk_id FROM c WHERE metadata['doc_type'] = 'md'),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS n FROM every WHERE chunk_id IN (SELECT chunk_id FROM ok)) {_PICK} kept WHERE n <= 10""",
    "leg_counts": f"""WITH {_HYBRID}, h AS (SELECT query_id FROM every WHERE rank <= 10), q AS (SELECT query_id FROM sparse UNION SELECT query_id FROM dense),
n AS (SELECT query_id, (SELECT count(*) FROM sparse s WHERE s.query_id = q.query_id) AS sparse_count, (SELECT count(*) FROM dense x WHERE x.query_id = q.query_id) AS dense_count, (SELECT count(*) FROM h WHERE h.query_id = q.query_id) AS fused_count FROM q)
SELECT *, sparse_count = 0 OR dense_count = 0 AS degraded FROM n""",
    "lexical_rerank": f"""WITH {_IDX}, {_ASKED}, {_sparse('asked', 10)}, scored AS (
  SELECT s.*, coalesce(len(list_intersect(list_distinct({_terms('a.query_text')}), list_distinct({_terms('c.text')})))::DOUBLE / nullif(len(list_distinct({_terms('a.query_text')})), 0), 0) AS new
  FROM sparse s JOIN asked a USING (query_id) JOIN c USING (chunk_id)
)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank > 5, CASE WHEN rank <= 5 THEN new END DESC NULLS LAST, rank) - 1 AS rank,
  round(CASE WHEN rank <= 5 THEN new ELSE score END, 8) AS score, CASE WHEN rank <= 5 THEN 'rerank' ELSE source END AS source FROM scored""",
    "citations": f"WITH {_CITED} SELECT query_id, number, chunk_id, rank, score, source, cited, page, excerpt FROM cited",
    "markdown_references": f"WITH {_CITED} SELECT query_id, string_agg('[' || number || '] ' || cited || ' (score: ' || CAST(floor(score * 10000 + 0.5) / 10000 AS DECIMAL(20, 4)) || ')', chr(10) ORDER BY number) AS body FROM cited GROUP BY query_id",
    "chunk_ids": f"""WITH {_CHUNKS} SELECT chunk_id, source_ref || '_' || format('{{:04d}}', chunk_index) || '_' || substring(sha256(text), 1, 8) AS computed,
  substring(sha256(concat_ws('|', metadata['source_path'], chunk_index, substring(sha256(text), 1, 8))), 1, 16) AS record_id FROM c""",
    "marker_filter": r"SELECT doc_id, coalesce(regexp_matches(text, '(?i)^\s*doc_id\s*:\s*\S+\s*$'), FALSE) AS marker FROM documents",
    "filter_tokens": f"""WITH {_ASKED} SELECT query_id, 'last' AS collection, 1 + CAST(len(list_distinct(list_transform(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*:.+$')), lambda x: string_split(x, ':')[1]))) AS INTEGER) AS n,
  array_to_string(list_concat(list_filter(w, lambda x: NOT regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*:.+$')), ['9x:no']), ' ') AS rest
FROM (SELECT query_id, list_filter(regexp_split_to_array(query_text, '\\s+'), lambda x: x <> '') AS w FROM asked)""",
    "tags_topn": f"""WITH {_CHUNKS}, w AS (
  SELECT chunk_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_\\-]+|[一-鿿]+'), lambda x: lower(x)), lambda x: length(x) >= 2 AND NOT list_contains({_list(TAG_STOP_WORDS)}, x)) AS l FROM c
), u AS (SELECT chunk_id, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM w), n AS (SELECT chunk_id, term, count(*) AS n, min(pos) AS place FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, place) AS r FROM n)
SELECT chunk_id, list(term ORDER BY r) AS tags FROM r WHERE r <= 5 GROUP BY chunk_id""",
    "fixed_length_chunks": """WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 101, 0) + 1, 900)) AS start_offset FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(start_offset // 900 AS INTEGER) AS piece_no, CAST(start_offset AS INTEGER) AS start_offset, substring(text, start_offset + 1, 1000) AS text FROM s""",
    "unit_vectors": f"""WITH {_VECTORS} SELECT chunk_id, round(sqrt(list_dot_product(dense_vector, dense_vector)), 4) AS norm, round(dense_vector[1] / sqrt(list_dot_product(dense_vector, dense_vector)), 5) AS first
FROM v WHERE len(list_filter(dense_vector, lambda x: x <> 0)) > 0""",
    "safe_names": f"""WITH {_TASKS} SELECT DISTINCT source_path, regexp_extract(source_path, '([^/]*)$', 1) AS name, 'uploads/' || coalesce(nullif(collection_id, ''), 'default') || '/' || regexp_extract(source_path, '([^/]*)$', 1) AS path FROM t""",
    "upserted_results": """SELECT query_id, collection, created_at, source FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, recorded_at DESC, collection, source) AS rn FROM query_results WHERE query_id IS NOT NULL) WHERE rn = 1""",
    "usage_insert_ignore": f"WITH {_EVENTS} SELECT id, occurred_at, operation, token_count FROM e",
    "integrity_skip": f"WITH {_TASKS} SELECT collection, doc_hash AS file_hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.status = 'succeeded' AND t.collection_id = d.collection AND t.document_id = d.doc_hash)",
    "list_documents": """WITH n AS (SELECT collection, metadata['source_path'] AS source_path, count(DISTINCT chunk_id) AS n FROM chunks GROUP BY ALL)
SELECT doc_id, d.collection, d.source_path, coalesce(n, 0) AS n_chunks FROM documents d LEFT JOIN n ON n.collection = d.collection AND n.source_path = d.source_path""",
    "collection_stats": """SELECT o.collection, count(DISTINCT chunk_id) AS chunks, count(DISTINCT source_ref) AS documents FROM collections o LEFT JOIN chunks c ON c.collection = o.collection GROUP BY o.collection""",
    "delete_cascade": f"""WITH {_CHUNKS}, x AS (SELECT collection, source_path, doc_hash FROM documents WHERE doc_type IS NULL), h AS (
  SELECT DISTINCT chunk_id, c.collection, doc_hash FROM c JOIN x ON c.collection = x.collection AND (c.metadata['source_path'] = x.source_path OR c.source_ref = x.doc_hash))
SELECT collection, doc_hash, count(*) AS deleted FROM h GROUP BY ALL""",
    "latest_task": f"""WITH {_TASKS} SELECT collection_id, source_path, task_id, status FROM (
  SELECT *, row_number() OVER (PARTITION BY collection_id, source_path ORDER BY created_at DESC, attempt DESC, updated_at DESC, task_id, status) AS rn FROM t) WHERE rn = 1""",
    "merged_collections": """SELECT coalesce(a.name, b.name) AS name, coalesce(a.n, 0) AS rows, CASE WHEN a.name IS NOT NULL AND b.name IS NOT NULL THEN 'both' WHEN a.name IS NOT NULL THEN 'index' ELSE 'store' END AS source
FROM (SELECT collection AS name, count(*) AS n FROM chunks GROUP BY collection) a FULL JOIN (SELECT DISTINCT collection AS name FROM split_profiles) b ON a.name = b.name""",
    "query_metrics": f"""WITH {_VALID} SELECT collection, count(*) AS queries, {_RATE.format('count(*) FILTER (succeeded AND n_chunks > 0 AND NOT degraded)', 'count(*)')} AS effective_rate,
  {_RATE.format('count(*) FILTER (succeeded AND n_chunks = 0)', 'count(*)')} AS no_result_rate, {_RATE.format('count(*) FILTER (degraded)', 'count(*)')} AS degraded_rate, quantile_disc(latency_ms, 0.95) AS p95_ms FROM d GROUP BY collection""",
    "kb_attention": f"""WITH {_VALID} SELECT collection, count(*) AS queries, quantile_disc(latency_ms, 0.95) AS p95_ms, quantile_disc(latency_ms, 0.95) > 2000 AS attention FROM d GROUP BY collection
ORDER BY attention DESC, p95_ms DESC, queries DESC, collection LIMIT 5""",
    "ingestion_metrics": f"""WITH {_TASKS} SELECT collection_id, count(*) AS tasks, {_RATE.format("count(*) FILTER (status = 'succeeded')", "count(*) FILTER (status IN ('succeeded', 'failed', 'cancelled'))")} AS success_rate,
  count(*) FILTER (status IN ('failed', 'cancelled')) AS failed FROM t GROUP BY collection_id""",
    "trend_buckets": f"""WITH {_VALID}, b AS (SELECT CAST(least(6, greatest(0, floor((created_at - {START}) / (({END} - {START}) / 7)))) AS INTEGER) AS bucket, latency_ms, succeeded AND n_chunks > 0 AND NOT degraded AS ok FROM d WHERE created_at >= {START} AND created_at < {END})
SELECT CAST(r.range AS INTEGER) AS bucket, count(b.bucket) AS queries, {_RATE.format('count(*) FILTER (ok)', 'count(b.bucket)')} AS effective_rate, quantile_disc(latency_ms, 0.95) AS p95_ms FROM range(7) r LEFT JOIN b ON b.bucket = r.range GROUP BY r.range""",
    "usage_summary": f"""WITH {_EVENTS} SELECT coalesce(CAST(sum(token_count) AS BIGINT), 0) AS total, coalesce(CAST(sum(token_count) FILTER (operation = 'query') AS BIGINT), 0) AS query, coalesce(CAST(sum(token_count) FILTER (operation = 'ingestion') AS BIGINT), 0) AS ingestion
FROM e WHERE occurred_at >= {START} AND occurred_at < {END} AND operation IN ('query', 'ingestion')""",
    "period_over_period": f"""SELECT collection, count(*) FILTER (created_at >= {END - 604800} AND created_at < {END}) AS now, count(*) FILTER (created_at >= {END - 1209600} AND created_at < {END - 604800}) AS before
FROM query_results WHERE created_at >= {END - 1209600} AND created_at < {END} GROUP BY collection""",
    "degraded_reasons": f"WITH {_DECODED} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM d) GROUP BY reason",
    "time_range_scan": f"SELECT query_id, created_at FROM query_results WHERE created_at >= {START} AND created_at < {END} AND source = 'mcp'",
    "cursor_page": "SELECT collection FROM collections ORDER BY collection LIMIT 20 OFFSET 20",
    "worst_status": f"""WITH {_TASKS} SELECT collection_id, arg_max(CASE WHEN status = 'failed' THEN 'down' WHEN status IN ('cancelled', 'skipped') THEN 'degraded' ELSE 'ok' END,
  CASE WHEN status = 'failed' THEN 3 WHEN status IN ('cancelled', 'skipped') THEN 2 ELSE 1 END) AS worst FROM t GROUP BY collection_id""",
    "batch_admission": f"""WITH {_TASKS}, f AS (
  SELECT row_number() OVER (PARTITION BY collection_id ORDER BY created_at, task_id, updated_at, status) AS file_no, collection_id AS collection, filename, length(source_path) * 1000000 AS size, document_id AS h FROM t
), g AS (SELECT *, CASE WHEN lower(regexp_extract(filename, '(\\.[^.]*)$', 1)) NOT IN ('.md', '.markdown', '.pdf') THEN 'UNSUPPORTED_FILE_TYPE' WHEN size > 33000000 THEN 'FILE_TOO_LARGE' END AS first FROM f),
k AS (SELECT *, coalesce(first, CASE WHEN row_number() OVER (PARTITION BY collection, filename, first IS NULL ORDER BY file_no) > 1 THEN 'DUPLICATE_FILENAME' END) AS code FROM g)
SELECT collection, CASE WHEN code IS NOT NULL THEN 'rejected' WHEN EXISTS (SELECT 1 FROM t WHERE t.status = 'succeeded' AND attempt > 0 AND t.collection_id = k.collection AND t.document_id = k.h) THEN 'skipped' ELSE 'accepted' END AS status, code, count(*) AS n
FROM k GROUP BY ALL""",
    "access_filter": """SELECT key_id, count(*) AS documents FROM documents d JOIN (SELECT DISTINCT api_key_id AS key_id, collection FROM query_results WHERE api_key_id IS NOT NULL) g ON g.collection = d.collection GROUP BY key_id""",
    "eval_batch": f"""WITH {_IDX}, {_ASKED}, {_sparse('asked', 10)}, qc AS (SELECT query_id, collection, unnest(list_distinct(regexp_extract_all(query_text, '[A-Z]{{2}}-[0-9]+'))) AS code FROM asked),
cc AS (SELECT chunk_id, collection, unnest(list_distinct(regexp_extract_all(text, '[A-Z]{{2}}-[0-9]+'))) AS code FROM c),
g AS (SELECT DISTINCT query_id, chunk_id FROM qc JOIN cc USING (collection, code)),
n AS (SELECT query_id, count(*) AS golden FROM g GROUP BY query_id), e AS (SELECT s.query_id, count(*) AS n, count(g.chunk_id) AS hits, min(CASE WHEN g.chunk_id IS NOT NULL THEN rank END) AS first FROM sparse s LEFT JOIN g ON g.query_id = s.query_id AND g.chunk_id = s.chunk_id GROUP BY s.query_id)
SELECT coalesce(e.query_id, n.query_id) AS query_id, CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_rate, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(hits::DOUBLE / e.n, 0), 6) AS precision, round(coalesce(hits::DOUBLE / golden, 0), 6) AS recall
FROM e FULL JOIN n ON n.query_id = e.query_id""",
    "image_filter": """WITH i AS (SELECT l_orderkey AS doc, l_linenumber AS seq, l_quantity * 4 AS w, l_quantity * 2 AS h, l_partkey % 3 AS sha FROM lineitem),
s AS (SELECT *, w < 40 OR h < 40 OR w * h / 500000.0::DOUBLE < 0.005 AS small FROM i)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN small THEN 'size' WHEN row_number() OVER (PARTITION BY doc, sha, small ORDER BY seq) > 1 THEN 'duplicate' END AS reason FROM s) GROUP BY reason""",
    "stage_elapsed": """SELECT user_id AS trace_id, event_type AS stage, round(arg_max(epoch_us(ts) / 1e6, (ts, event_id)) - arg_min(epoch_us(ts) / 1e6, (ts, event_id)), 6) AS elapsed FROM events GROUP BY ALL""",
    "set_operations": """WITH a AS (SELECT DISTINCT document_id AS h FROM tasks WHERE document_id IS NOT NULL), b AS (SELECT DISTINCT source_ref AS h FROM chunks WHERE source_ref IS NOT NULL)
SELECT 'tasks' AS part, count(*) AS n FROM (SELECT h FROM a EXCEPT SELECT h FROM b) UNION ALL SELECT 'chunks', count(*) FROM (SELECT h FROM b EXCEPT SELECT h FROM a) UNION ALL SELECT 'both', count(*) FROM (SELECT h FROM a INTERSECT SELECT h FROM b)""",
    "tumbling_events": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}

_WS = r"[\s\x0b\x{85}\p{Z}]"


def _cut(text: str, most: int) -> str:
    return f"CASE WHEN length({text}) <= {most} THEN {text} ELSE regexp_replace(substring({text}, 1, {most - 1}), '{_WS}+$', '') || '…' END"


_BARE = f"lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')"
#: Title, summary and tags: sentences end after a mark and white space, and at line ends.
SQL["enriched_chunks"] = f"""{SQL['tags_topn'][: SQL['tags_topn'].index('SELECT chunk_id, list(term ORDER BY r) AS tags')].rstrip()}, tg AS (SELECT chunk_id, list(term ORDER BY r) AS tags FROM r WHERE r <= 5 GROUP BY chunk_id),
s AS (SELECT chunk_id, list_filter(list_transform(string_split(text, chr(10)), {_BARE}), lambda x: x <> '')[1] AS title,
  array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?。！？]){_WS}+', '\\1' || chr(1), 'g'), '\\n{_WS}*', chr(1), 'g'), chr(1)), {_BARE}), lambda x: x <> '')[1:2], ' ') AS summary FROM c)
SELECT s.chunk_id, coalesce({_cut('title', 80)}, '') AS title, coalesce({_cut('summary', 200)}, '') AS summary, coalesce(tags, []) AS tags FROM s LEFT JOIN tg ON tg.chunk_id = s.chunk_id"""

_DIGIT, _WORDLIKE = r"\p{Nd}", r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
_SIDE = r"[ \t\r\f\x0b\x{85}\p{Z}]"  # white space within a line
_FENCE = r"(?s)```[A-Za-z0-9_+-]*\n.*?```"
_NOISE = [
    (r"(?s)<!--.*?-->", ""),
    (r"!\[[^\n]*?\]\([^)]*\)", ""),
    (rf"(?m)^{_WS}*[-*_]{{3,}}{_WS}*$", ""),
    (rf"(?mi)^{_WS}*(?:[-–—]{_WS}*{_DIGIT}+{_WS}*[-–—]|{_DIGIT}+|Page{_WS}+{_DIGIT}+(?:{_WS}+of{_WS}+{_DIGIT}+)?){_WS}*$", ""),
    (rf"(?m)^[A-Z][{_WORDLIKE} \-,&|]{{2,80}}$", ""),
    (r"(?m)[ \t]+$", ""),
    (r"[ \t]+", " "),
    (rf"(?m)^{_SIDE}+|{_SIDE}+$", ""),
    (r"\n{3,}", "\n\n"),
]
_CLEANED = f"regexp_replace(text, '{_FENCE}', chr(1), 'g')"
for _pattern, _to in _NOISE:
    _CLEANED = f"regexp_replace({_CLEANED}, '{_pattern}', '{_to}', 'g')"
#: The rules of noise one after the other; fenced code is put back at the end.
SQL["refined_texts"] = f"""WITH {_CHUNKS}, p AS (SELECT chunk_id, text, string_split({_CLEANED}, chr(1)) AS parts, regexp_extract_all(text, '{_FENCE}') AS kept, text IS NULL OR {_TRIM.format('text')} = '' AS blank FROM c),
j AS (SELECT *, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(kept[i], '')), '') AS whole FROM p)
SELECT chunk_id, CASE WHEN blank THEN 'skipped' ELSE 'rule' END AS refined_by, CASE WHEN blank THEN text ELSE {_TRIM.format('whole')} END AS text FROM j"""
