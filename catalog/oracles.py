"""The registered queries in DuckDB SQL, written from the semantics and not from the
Spark code. Expressions shared by several queries are kept as common table expressions."""

_W = r"[\pL\pN_]"
_NW = r"[^\pL\pN_]"
_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"

_LISTINGS = """listings AS (
  SELECT doc_id, split_part(text, chr(10), 1) AS title, lang AS company, '' AS location,
         'https://example.org/' || CAST(n_chars AS VARCHAR) AS url, source, text AS description,
         CAST(substr(source, 4) AS INTEGER) AS src_rank, doc_id AS src_pos
  FROM documents)"""

_KEY = "left(sha1(lower(title) || '|' || lower(company) || '|' || url), 16)"

_FIRSTS = f"""{_LISTINGS},
keyed AS (SELECT *, {_KEY} AS job_id FROM listings),
firsts AS (SELECT * FROM keyed
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY src_rank, src_pos) = 1)"""

_LEXICON = """lexicon(ord, phrase, weight) AS (VALUES
  (0, 'the and', 8), (1, 'und das', 5), (2, 'De La', 6), (3, 'of the', 7), (4, 'of the and', 9))"""


def _scored(source: str, key: str, text: str = "title || ' ' || description || ' ' || company") -> str:
    """CTEs ending in ``scored``: ``source`` with blocked, score and keywords."""
    return f"""{_LEXICON},
judged AS (SELECT *, contains(lower(title), 'eaux') OR contains(lower(title), 'reher') AS blocked,
                  lower({text}) AS search_text FROM {source}),
hits AS (SELECT j.{key}, CAST(sum(weight) AS INTEGER) AS score, string_agg(phrase, ', ' ORDER BY ord) AS keywords
  FROM judged j JOIN lexicon l
    ON CASE WHEN NOT blocked AND contains(search_text, lower(phrase))
       THEN regexp_matches(search_text, '(^|{_NW})' || lower(phrase) || '({_NW}|$)') ELSE false END
  GROUP BY 1),
scored AS (SELECT j.*, coalesce(h.score, 0) AS score,
    CASE WHEN blocked THEN '[BLOCKED: title match]' ELSE coalesce(h.keywords, '') END AS keywords
  FROM judged j LEFT JOIN hits h USING ({key}))"""


def _floored(names: str) -> str:
    """CTE ``floored`` on top of ``scored``; ``names`` selects lower-cased target names."""
    return f"""floored AS (SELECT * EXCLUDE (score, keywords), is_target,
    CASE WHEN is_target AND score = 0 THEN 1 ELSE score END AS score,
    CASE WHEN is_target AND score = 0 THEN '[' || company || ' target]' ELSE keywords END AS keywords
  FROM (SELECT *, coalesce(lower(company) IN ({names}), false) AS is_target FROM scored))"""


_TIER = """CASE WHEN score >= 20 THEN 'Excellent Match' WHEN score >= 10 THEN 'Strong Match'
  WHEN score >= 5 THEN 'Good Match' ELSE 'Target Company' END"""
_COLOUR = "CASE WHEN score >= 20 THEN 65280 WHEN score >= 10 THEN 16753920 WHEN score >= 5 THEN 3447003 ELSE 9807270 END"

_ALL_SCORED = f"WITH {_LISTINGS}, {_scored('listings', 'doc_id')}"
_JOBS = f"""{_FIRSTS}, {_scored('firsts', 'job_id')}, {_floored("'fr'")},
jobs AS (SELECT *, DATE '2026-01-01' + src_rank AS seen_at FROM floored)"""

_SNIPPET = "CASE WHEN length({c}) > 300 THEN left({c}, 300) || '…' ELSE {c} END"

_NO_TAGS = f"regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g')"

# Documents as board pages: an endpoint per source and block of 1024 ids.
_PAGES = f"""{_LISTINGS},
paged AS (SELECT *, source || '-' || CAST(doc_id // 1024 AS VARCHAR) AS token,
    CAST((doc_id // 1024) * 20 + src_rank AS INTEGER) AS page_ord,
    row_number() OVER (PARTITION BY source, doc_id // 1024 ORDER BY doc_id) - 1 AS place
  FROM listings)"""

_WWR = """SELECT p_name AS title, CASE WHEN p_size > 40 THEN 'Unknown' ELSE p_brand END AS company,
    'Remote' AS location, 'https://example.org/part/' || CAST(p_partkey AS VARCHAR) AS url,
    'WeWorkRemotely' AS source, p_type || '  of the and' AS description FROM part"""

_AVIXA = """SELECT c_name AS title,
    CASE WHEN c_acctbal > 6000 THEN c_name WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'other' END AS company,
    '' AS location, 'https://example.org/customer/' || CAST(c_custkey AS VARCHAR) AS url,
    'AVIXA' AS source, c_mktsegment AS description FROM customer"""

_REMOTEOK = """SELECT title, source AS company, CASE WHEN company = 'es' THEN 'Remote' ELSE company END AS location,
    url, 'RemoteOK' AS source, trim(description) AS description FROM listings"""

# Everything one run over all payloads collects, with its arrival order.
_COLLECTED = f"""{_PAGES},
collected AS (
  SELECT title, source AS company, CASE WHEN company = 'es' THEN 'Remote' ELSE company END AS location, url,
         'RemoteOK' AS source, description, 'remoteok' AS kind, 0 AS rnk, page_ord AS endpoint_ord, place + 1 AS place
  FROM paged
  UNION ALL
  SELECT title, company, location, url, source, description, 'wwr', 1, CAST(p_partkey // 1024 AS INTEGER),
         row_number() OVER (PARTITION BY p_partkey // 1024 ORDER BY p_partkey) - 1
  FROM (SELECT * FROM ({_WWR}) POSITIONAL JOIN (SELECT p_partkey FROM part))
  UNION ALL
  SELECT title, company, location, url, source, description, 'avixa', 2, CAST(c_custkey // 1024 AS INTEGER),
         row_number() OVER (PARTITION BY c_custkey // 1024 ORDER BY c_custkey) - 1
  FROM (SELECT * FROM ({_AVIXA}) POSITIONAL JOIN (SELECT c_custkey FROM customer))
  UNION ALL
  SELECT title, 'Company ' || source, company, url, 'Greenhouse/' || token, description,
         'greenhouse', 3, page_ord * 4, place FROM paged
  UNION ALL
  SELECT title, 'Company ' || source, company, url, 'Lever/' || token, title || '  ' || description,
         'lever', 3, page_ord * 4 + 1, place FROM paged
  UNION ALL
  SELECT title, 'Company ' || source, CASE WHEN company = 'en' THEN 'Remote' ELSE company END,
         'https://jobs.ashbyhq.com/' || token || '/' || CAST(doc_id AS VARCHAR), 'Ashby/' || token, '',
         'ashby', 3, page_ord * 4 + 2, place FROM paged)"""

_RUN = f"""{_COLLECTED},
keyed AS (SELECT *, {_KEY} AS job_id FROM collected),
firsts AS (SELECT * FROM keyed
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY rnk, endpoint_ord, place) = 1),
{_scored('firsts', 'job_id')},
{_floored("SELECT 'company ' || lower(source) FROM documents")}"""

_CUSTOMERS = """customers AS (
  SELECT CAST(c_custkey AS INTEGER) AS ord, c_name AS name, lower(c_name) AS token, c_acctbal AS b, c_mktsegment AS segment,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'lever' WHEN 'FURNITURE' THEN 'ashby'
      WHEN 'HOUSEHOLD' THEN 'workday' ELSE 'greenhouse' END AS ats
  FROM customer),
routed AS (
  SELECT *, CASE WHEN ats = 'workday' THEN 'unsupported_kind'
      WHEN b < 0 THEN 'not_found'
      WHEN b >= 1000 AND b < 2000 AND ats = 'ashby' THEN 'not_found'
      WHEN b < 2000 THEN 'http_error'
      WHEN b > 9000 THEN 'unparseable_body' END AS reason,
    CASE WHEN ats = 'workday' THEN name WHEN b < 0 THEN '404' WHEN b < 1000 THEN '500' WHEN b < 2000 THEN '403' END AS detail
  FROM customers)"""

_ERRORS = f"""{_CUSTOMERS},
messages AS (SELECT CASE WHEN reason = 'unsupported_kind' THEN 'roster' ELSE ats END AS kind, reason, count(*) AS n
  FROM routed WHERE reason <> 'not_found' GROUP BY 1, 2),
texts AS (SELECT kind || ' failed: ' || reason || ' (' || CAST(n AS VARCHAR) || ')' AS message,
  row_number() OVER (ORDER BY kind, reason) AS i FROM messages)"""

_PROBES = """probes AS (
  SELECT CAST(d.doc_id AS INTEGER) AS ord, source AS name, 'd' || CAST(d.doc_id AS VARCHAR) AS token,
    CASE lang WHEN 'en' THEN 'greenhouse' WHEN 'fr' THEN 'ashby' WHEN 'de' THEN 'lever' ELSE 'workday' END AS ats,
    (SELECT count(*) FROM (SELECT unnest(string_split(text, chr(10))) AS line)
      WHERE regexp_matches(line, '(?i)the|und|de')) AS n,
    coalesce(toxic = 1, false) AS gone, coalesce(quality = 0, false) AS poor
  FROM documents d LEFT JOIN labels USING (doc_id)),
classified AS (
  SELECT ord, name, ats, token,
    CASE WHEN gone THEN 'HTTP_ERR' WHEN poor AND ats <> 'ashby' THEN 'ERR' WHEN n > 0 THEN 'OK' ELSE 'EMPTY' END AS status,
    CASE WHEN gone THEN '404' WHEN poor AND ats <> 'ashby' THEN 'invalid JSON' ELSE CAST(n AS VARCHAR) END AS detail
  FROM probes WHERE ats <> 'workday')"""

ORACLES = {
    "strip_html": f"""
        SELECT page_id, text, CAST(length(text) AS INTEGER) AS chars
        FROM (SELECT page_id, {_NO_TAGS} AS text FROM pages)""",
    "text_functions": f"""
        SELECT conv_id, turn, role AS company, md5(text) AS title_md5,
               md5(lower(role || '  ' || text)) AS search_md5, {_SNIPPET.format(c='text')} AS snippet,
               CAST(least(length(text), 2000) AS INTEGER) AS kept,
               CASE WHEN role = 'user' THEN 'none' ELSE role END AS role_or_none
        FROM conversations""",
    "job_key": f"WITH {_LISTINGS} SELECT doc_id, {_KEY} AS job_id FROM listings",
    "dedup_first_wins": f"WITH {_FIRSTS} SELECT job_id, doc_id, source, title FROM firsts",
    "blocklist_filter": f"""WITH {_LISTINGS}
        SELECT doc_id, contains(lower(title), 'eaux') OR contains(lower(title), 'reher') AS blocked FROM listings""",
    "score_phrases": f"{_ALL_SCORED} SELECT doc_id, score, keywords FROM scored",
    "score_phrases_joined": f"{_ALL_SCORED} SELECT doc_id, score, keywords FROM scored",
    "score_long_lexicon": f"""WITH
        vocabulary AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '{_NW}+')) AS phrase FROM benchmark),
        lexicon AS (SELECT phrase, length(phrase) AS ord, least(length(phrase), 10) AS weight FROM vocabulary WHERE phrase <> ''),
        {_LISTINGS},
        words AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(
            lower(title || ' ' || description || ' ' || company), '{_NW}+')) AS phrase FROM listings),
        hits AS (SELECT doc_id, CAST(sum(weight) AS INTEGER) AS score, string_agg(phrase, ', ' ORDER BY ord, phrase) AS keywords
            FROM words JOIN lexicon USING (phrase) GROUP BY 1)
        SELECT doc_id, coalesce(score, 0) AS score, coalesce(keywords, '') AS keywords
        FROM listings LEFT JOIN hits USING (doc_id)""",
    "score_phrases_shuffled": f"{_ALL_SCORED} SELECT doc_id, score, keywords FROM scored",
    "score_shared_words": f"""WITH
        tokens AS (SELECT unnest(regexp_split_to_array(lower(text), '{_NW}+')) AS w FROM benchmark),
        top AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) - 1 AS r FROM tokens WHERE w <> '' GROUP BY w QUALIFY r < 30),
        lexicon AS (SELECT a.r * 30 + b.r AS ord, a.w || ' ' || b.w AS phrase FROM top a, top b),
        {_LISTINGS},
        texts AS (SELECT doc_id, lower(title || ' ' || description || ' ' || company) AS t FROM listings),
        spaced AS (SELECT doc_id, unnest(string_split(t, ' ')) AS piece, generate_subscripts(string_split(t, ' '), 1) AS i FROM texts),
        pairs AS (SELECT DISTINCT a.doc_id, regexp_extract(a.piece, '({_W}+)$', 1) || ' ' || regexp_extract(b.piece, '^({_W}+)', 1) AS phrase
          FROM spaced a JOIN spaced b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
        hits AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS score, string_agg(phrase, ', ' ORDER BY ord) AS keywords
          FROM pairs JOIN lexicon USING (phrase) GROUP BY 1)
        SELECT doc_id, coalesce(score, 0) AS score, coalesce(keywords, '') AS keywords FROM listings LEFT JOIN hits USING (doc_id)""",
    "score_target_floor": f"""{_ALL_SCORED}, {_floored("'fr'")}
        SELECT doc_id, blocked, is_target, score, keywords FROM floored""",
    "target_listings": "SELECT doc_id, lang AS company FROM documents WHERE lower(lang) = 'fr'",
    "tier_label": f"{_ALL_SCORED} SELECT doc_id, score, {_TIER} AS tier, {_COLOUR} AS colour FROM scored",
    "threshold_filter": f"WITH {_JOBS} SELECT job_id, score FROM jobs WHERE score >= 5",
    "pending_alerts": f"""WITH {_JOBS},
        delivered AS (SELECT job_id FROM keyed JOIN labels USING (doc_id) WHERE quality = 1)
        SELECT CAST(row_number() OVER (ORDER BY score, seen_at, job_id) AS BIGINT) AS seq, job_id, score,
               {_TIER} AS tier, keywords, title
        FROM jobs WHERE score >= 5 AND job_id NOT IN (SELECT job_id FROM delivered)""",
    "new_only": f"""WITH {_FIRSTS}
        SELECT job_id, doc_id FROM firsts
        WHERE job_id NOT IN (SELECT job_id FROM keyed JOIN labels USING (doc_id))""",
    "board_roundtrip_greenhouse": f"""WITH {_PAGES}
        SELECT token, title, 'Company ' || source AS company, company AS location, url,
               'Greenhouse/' || token AS source, trim(description) AS description FROM paged""",
    "board_roundtrip_lever": f"""WITH {_PAGES}
        SELECT token, title, 'Company ' || source AS company, company AS location, url,
               'Lever/' || token AS source, trim(title || ' ' || trim(description)) AS description FROM paged""",
    "board_roundtrip_ashby": f"""WITH {_PAGES}
        SELECT token, title, 'Company ' || source AS company,
               CASE WHEN company = 'en' THEN 'Remote' ELSE company END AS location,
               'https://jobs.ashbyhq.com/' || token || '/' || CAST(doc_id AS VARCHAR) AS url,
               'Ashby/' || token AS source, '' AS description FROM paged""",
    "feed_remoteok": f"WITH {_LISTINGS} {_REMOTEOK}",
    "feed_title_split": _WWR,
    "feed_fallbacks": _AVIXA,
    "source_union_counts": f"""WITH {_COLLECTED}
        SELECT 2 AS level, kind AS source_kind, CAST(endpoint_ord AS VARCHAR) AS endpoint_ord, count(*) AS listings FROM collected GROUP BY kind, endpoint_ord
        UNION ALL SELECT 1, kind, NULL, count(*) FROM collected GROUP BY kind
        UNION ALL SELECT 0, NULL, NULL, count(*) FROM collected""",
    "source_union_subset": f"""WITH {_COLLECTED}
        SELECT kind AS source_kind, endpoint_ord, place AS src_pos, title FROM collected
        WHERE kind IN ('greenhouse', 'lever', 'ashby')""",
    "roster_dedup": """
        SELECT CAST(c_custkey AS INTEGER) AS ord, c_name AS name, c_mktsegment AS ats, n_name AS token
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        QUALIFY row_number() OVER (PARTITION BY c_mktsegment, n_name ORDER BY c_custkey) = 1""",
    "roster_routing": f"""WITH {_CUSTOMERS}
        SELECT ats AS source_kind, token, reason, detail,
               CASE WHEN reason IS NULL THEN segment END AS title, CASE WHEN reason IS NULL THEN name END AS company,
               CASE WHEN reason IS NULL THEN CASE WHEN ats = 'ashby' THEN 'https://jobs.ashbyhq.com/' || token || '/1'
                 ELSE 'https://example.org/' || token END END AS url
        FROM routed""",
    "run_errors": f"""WITH {_ERRORS}
        SELECT CAST(count(*) AS INTEGER) AS n, string_agg(message, '; ' ORDER BY i) AS errors,
               string_agg(message, chr(10) ORDER BY i) FILTER (WHERE i <= 3) AS first_errors FROM texts""",
    "zero_yield": """
        SELECT CAST(c_custkey AS INTEGER) AS ord,
               c_name || ' (' || c_mktsegment || '/' || CAST(c_custkey AS VARCHAR) || ')' AS label
        FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
    "health_audit": f"WITH {_PROBES} SELECT ord, name, ats, token, status, detail FROM classified",
    "health_tally": f"""WITH {_PROBES}
        SELECT CASE status WHEN 'OK' THEN 'ok' WHEN 'EMPTY' THEN 'empty' ELSE 'broken' END AS bucket,
               count(*) AS endpoints FROM classified GROUP BY 1""",
    "health_repair": f"""WITH {_PROBES}
        SELECT ord, name, ats, token, status, detail,
          CASE ats WHEN 'greenhouse' THEN 'https://boards.greenhouse.io/' WHEN 'ashby' THEN 'https://jobs.ashbyhq.com/'
            ELSE 'https://jobs.lever.co/' END || token AS suggested_url
        FROM classified WHERE status IN ('HTTP_ERR', 'ERR')""",
    "health_unsupported": f"""WITH {_PROBES}
        SELECT ats AS source_kind, token, 'unsupported_kind' AS reason, name AS detail FROM probes WHERE ats = 'workday'""",
    "alert_payload": f"""WITH {_JOBS}
        SELECT job_id, title, url, {_COLOUR} AS color, company, 'Not listed' AS location,
               CAST(score AS VARCHAR) || ' — ' || {_TIER} AS score, source,
               CASE WHEN keywords = '' THEN 'none' ELSE keywords END AS keywords,
               {_SNIPPET.format(c='description')} AS description,
               '2026-01-01T00:00:00+00:00' AS stamp, 'Score' AS third_field
        FROM jobs""",
    "stored_listings": f"""WITH {_RUN}
        SELECT job_id, title, company, location, url, source, score, blocked, is_target, keywords,
               CAST(least(length(trim(description)), 2000) AS INTEGER) AS kept,
               md5(left(trim(description), 2000)) AS description_md5 FROM floored""",
    "outbox_rows": f"""WITH {_RUN}
        SELECT CAST(row_number() OVER (ORDER BY score, job_id) AS BIGINT) AS seq, job_id, score, 'dry' AS mode, title
        FROM floored WHERE score >= 5""",
    "blocklist_long": f"""WITH {_LISTINGS},
        patterns AS (SELECT DISTINCT p FROM (SELECT unnest(regexp_split_to_array(lower(text), '{_NW}+')) AS p FROM benchmark)
          WHERE length(p) >= 7),
        hit AS (SELECT DISTINCT doc_id FROM listings JOIN patterns ON contains(lower(title), p))
        SELECT doc_id, doc_id IN (SELECT doc_id FROM hit) AS blocked FROM listings""",
    "blocklist_pieces": f"""WITH {_LISTINGS},
        items AS (SELECT lower(text) AS t FROM benchmark),
        patterns AS (SELECT DISTINCT substr(t, i, 5) AS p FROM (SELECT t, unnest(range(1, length(t) - 3)) AS i FROM items)),
        titles AS (SELECT DISTINCT lower(title) AS title FROM listings),
        hit AS (SELECT DISTINCT title FROM titles JOIN patterns ON contains(title, p))
        SELECT doc_id, lower(title) IN (SELECT title FROM hit) AS blocked FROM listings""",
    "source_registered": f"""WITH
        lines AS (SELECT CAST(doc_id AS VARCHAR) AS token, unnest(string_split(text, chr(10))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) - 1 AS src_pos FROM documents)
        SELECT 'plain' AS source_kind, 'Plain' AS source, token AS company, token || '#' || CAST(src_pos AS VARCHAR) AS url,
               md5(line) AS title_md5, src_pos FROM lines WHERE line <> ''
        UNION ALL SELECT 'wwr', source, company, url, md5(title), src_pos
        FROM (SELECT * FROM ({_WWR}) POSITIONAL JOIN (SELECT row_number() OVER (PARTITION BY p_partkey // 1024 ORDER BY p_partkey) - 1 AS src_pos, p_partkey FROM part ORDER BY p_partkey))""",
    "feed_files": """
        SELECT CASE WHEN p_size < 50 THEN p_name END AS title, CASE WHEN p_size < 50 THEN p_brand END AS company,
               CASE WHEN p_size < 50 THEN 'https://example.org/part/' || CAST(p_partkey AS VARCHAR) END AS url,
               CASE WHEN p_size < 50 THEN p_type END AS description, CASE WHEN p_size = 50 THEN 'bad_item' END AS reason,
               CASE WHEN p_size = 50 THEN '<item><title>' || p_name || '</item>' END AS raw
        FROM part""",
    "store_bootstrap": """
        SELECT what, CASE WHEN what IN ('runs', 'clocks') THEN 1 ELSE (SELECT count(*) FROM part) END AS n
        FROM (VALUES ('jobs'), ('deliveries'), ('outbox'), ('runs'), ('clocks')) AS t(what)""",
    "store_packed": f"""WITH {_COLLECTED},
        batches(kind, b) AS (VALUES ('remoteok', 1), ('greenhouse', 2), ('lever', 3), ('wwr', 4)),
        keyed AS (SELECT *, {_KEY} AS job_id FROM collected JOIN batches USING (kind)),
        firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY b, endpoint_ord, place) = 1),
        {_scored('firsts', 'job_id')},
        {_floored("SELECT 'company ' || lower(source) FROM documents")}
        SELECT 'wwr' AS run_id, CAST(row_number() OVER (ORDER BY score, job_id) AS BIGINT) AS seq, job_id, score, kind AS found_by
        FROM floored WHERE score >= 5""",
    "stream_live": f"""WITH wwr AS (SELECT title, company, url FROM ({_WWR}))
        SELECT {_KEY} AS job_id, CAST(1 AS BIGINT) AS sent, CAST(1 AS BIGINT) AS delivered FROM wwr""",
    "store_replay": f"""WITH {_COLLECTED},
        keyed AS (SELECT *, {_KEY} AS job_id FROM collected WHERE kind = 'remoteok'),
        firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY rnk, endpoint_ord, place) = 1),
        {_scored('firsts', 'job_id')},
        {_floored("SELECT 'company ' || lower(source) FROM documents")}
        SELECT 'b1' AS run_id, CAST(row_number() OVER (ORDER BY score, job_id) AS BIGINT) AS seq, job_id, score,
               true AS ok, 'b1' AS delivered_by
        FROM floored WHERE score >= 5""",
    "run_zero_yield": f"""WITH {_PAGES},
        pages AS (SELECT DISTINCT source, token, page_ord FROM paged)
        SELECT CAST(page_ord * 4 + k AS INTEGER) AS ord, 'Company ' || source || ' (' || ats || '/' || token || ')' AS label
        FROM pages, (VALUES (1, 'lever'), (2, 'ashby')) AS kinds(k, ats)""",
    "run_source_counts": f"""WITH {_COLLECTED}
        SELECT CAST(2 - grouping(kind) - grouping(endpoint_ord) AS INTEGER) AS level, kind AS source_kind,
               CAST(endpoint_ord AS VARCHAR) AS endpoint_ord, count(*) AS listings
        FROM collected GROUP BY ROLLUP (kind, endpoint_ord)""",
    "quarantine_rows": f"""WITH {_CUSTOMERS},
        bodies AS (SELECT *, 'https://example.org/' || token AS link FROM routed WHERE reason IS NOT NULL)
        SELECT ats AS source_kind, token, ord AS endpoint_ord, reason, detail,
          CASE WHEN reason = 'unparseable_body' THEN CASE ats
            WHEN 'greenhouse' THEN '{{"jobs":[{{"title":"' || segment || '","absolute_url":"' || left(link || '"}}]}}', length(link) + 1)
            WHEN 'lever' THEN '[{{"text":"' || segment || '","hostedUrl":"' || link
            ELSE '{{"data":{{"jobBoard":{{"jobPostings":[{{"id":"1","title":"' || segment || '"}}]' END END AS raw
        FROM bodies""",
    "stream_scored_long_lexicon": f"""WITH
        vocabulary AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '{_NW}+')) AS phrase FROM benchmark),
        lexicon AS (SELECT phrase, least(length(phrase), 10) AS weight FROM vocabulary WHERE phrase <> ''),
        {_COLLECTED},
        numbered AS (SELECT *, {_KEY} AS job_id, row_number() OVER () AS row_id FROM collected WHERE kind = 'remoteok'),
        words AS (SELECT DISTINCT row_id, unnest(regexp_split_to_array(
            lower(title || ' ' || description || ' ' || company), '{_NW}+')) AS phrase FROM numbered),
        sums AS (SELECT row_id, CAST(sum(weight) AS INTEGER) AS total FROM words JOIN lexicon USING (phrase) GROUP BY 1),
        judged AS (SELECT *, lower(company) IN (SELECT 'company ' || lower(source) FROM documents) AS target
          FROM numbered LEFT JOIN sums USING (row_id))
        SELECT job_id, source, CAST(endpoint_ord AS INTEGER) AS endpoint_ord, place AS src_pos,
               CASE WHEN target AND coalesce(total, 0) = 0 THEN 1 ELSE coalesce(total, 0) END AS score
        FROM judged""",
    "run_summary": f"""WITH {_RUN}
        SELECT '2026-01-01T00:00:00+00:00' AS started,
               CAST((SELECT count(*) FROM collected) AS VARCHAR) AS found,
               CAST(count(*) AS VARCHAR) AS new,
               CAST(count(*) FILTER (WHERE score >= 5) AS VARCHAR) AS alerted,
               'roster failed: unsupported_kind (' || CAST((SELECT count(DISTINCT token) FROM paged) AS VARCHAR) || ')' AS errors,
               '16739125' AS color
        FROM floored""",
    "stream_first_seen": f"WITH {_COLLECTED} SELECT DISTINCT {_KEY} AS job_id, url FROM collected",
    "stream_scored": f"""WITH {_COLLECTED},
        numbered AS (SELECT *, {_KEY} AS job_id, row_number() OVER () AS row_id FROM collected),
        {_scored('numbered', 'row_id')},
        {_floored("SELECT 'company ' || lower(source) FROM documents")}
        SELECT job_id, source, place AS src_pos, score FROM floored""",
}
