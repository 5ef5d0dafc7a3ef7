"""DuckDB SQL equivalents of the registered queries (the correctness oracle)."""

from __future__ import annotations

from .oracle_fixtures import EVENT_TIER, EVENT_USER, ISSUES_FX, LOGS_FX, PAIR_DIST, SEARCH_DIST, USERS_FX, with_

ORACLE: dict[str, str] = {}

_TOPK = """topk AS (
  SELECT query_id, pk, distance FROM pair_dist
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, pk) <= {k})"""

_RESCALED = """rescaled AS (
  SELECT query_id, pk,
    CASE WHEN max(distance) OVER (PARTITION BY query_id) = 0 THEN 100.0
      ELSE floor((max(distance) OVER (PARTITION BY query_id) - distance)
                 / max(distance) OVER (PARTITION BY query_id) * 100.0 * 100.0 + 0.5) / 100.0
    END AS similarity
  FROM topk)"""

_MATCHES = """matches AS (
  SELECT r.query_id, i.id, i.title, r.similarity, i.issue_url AS url
  FROM rescaled r JOIN issues_fx i ON r.pk = i.id
  WHERE i.state = 'closed' AND r.similarity > {t})"""

_MATCHES_CTES = (ISSUES_FX, SEARCH_DIST, _TOPK.format(k=100), _RESCALED, _MATCHES.format(t="30.0"))
_SERVICE_CTES = (ISSUES_FX, SEARCH_DIST, _TOPK.format(k=100), _RESCALED, _MATCHES.format(t="90.0"))

ORACLE["knn_l2"] = with_(PAIR_DIST) + """
SELECT query_id, pk, distance,
  row_number() OVER (PARTITION BY query_id ORDER BY distance, pk) AS rank
FROM pair_dist
QUALIFY rank <= 100"""

ORACLE["similar_issues"] = with_(*_MATCHES_CTES) + "SELECT * FROM matches"

ORACLE["similar_issues_scoped"] = with_(ISSUES_FX, SEARCH_DIST, _TOPK.format(k=100), _RESCALED) + """
SELECT r.query_id, i.id, i.title, r.similarity, i.issue_url AS url
FROM rescaled r
LEFT JOIN issues_fx q ON q.id = r.query_id
JOIN issues_fx i ON r.pk = i.id
WHERE i.state = 'closed' AND r.similarity > 30.0
  AND (coalesce(q.repo_owner, '') = '' OR q.repo_owner = i.repo_owner)
  AND (coalesce(q.repo_name, '') = '' OR q.repo_name = i.repo_name)"""

ORACLE["match_lines"] = with_(*_MATCHES_CTES) + """
SELECT query_id, id,
  concat('- ', title, ' (#', CAST(id AS VARCHAR), ') - ', printf('%.2f%%', similarity),
         ' - (', url, ')') AS line
FROM matches"""

ORACLE["unmatched_queries"] = with_(*_SERVICE_CTES) + """
SELECT e.vec_id AS query_id FROM embeddings e
WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.query_id = e.vec_id)"""

ORACLE["search_activity"] = with_(*_SERVICE_CTES) + """
SELECT e.vec_id AS query_id, CAST(count(m.query_id) AS BIGINT) AS n_hits,
  CASE WHEN count(m.query_id) > 0 THEN 200 ELSE 204 END AS response_code,
  CASE WHEN count(m.query_id) > 0 THEN 'Found ' || CAST(count(m.query_id) AS VARCHAR) || ' similar issues'
    ELSE 'No similar issues found' END AS description
FROM embeddings e LEFT JOIN matches m ON m.query_id = e.vec_id
GROUP BY e.vec_id"""

# --------------------------------------------------------------- activity
_LABEL = """CASE response_code WHEN 200 THEN 'Success' WHEN 204 THEN 'No Data Returned'
  WHEN 404 THEN 'Failure' ELSE CAST(response_code AS VARCHAR) END"""

ORACLE["requests_by_user_date"] = with_(LOGS_FX) + """
SELECT username, CAST(timestamp AS DATE) AS date, count(*) AS count
FROM logs_fx GROUP BY 1, 2"""

ORACLE["status_counts"] = with_(LOGS_FX) + f"""
SELECT status, count(*) AS count FROM (SELECT {_LABEL} AS status FROM logs_fx)
WHERE status IN ('Success', 'No Data Returned', 'Failure') GROUP BY status"""

ORACLE["endpoint_counts"] = with_(LOGS_FX) + """
SELECT api_endpoint, count(*) AS count FROM logs_fx GROUP BY api_endpoint"""

ORACLE["call_metrics"] = with_(LOGS_FX) + """,
c AS (
  SELECT
    count(*) FILTER (WHERE CAST(timestamp AS DATE) = DATE '2024-01-30') AS calls_today,
    count(*) FILTER (WHERE CAST(timestamp AS DATE) = DATE '2024-01-29') AS calls_yesterday,
    count(*) FILTER (WHERE CAST(timestamp AS DATE) = DATE '2024-01-28') AS calls_day_before,
    count(*) FILTER (WHERE CAST(timestamp AS DATE) > DATE '2024-01-23'
                       AND CAST(timestamp AS DATE) <= DATE '2024-01-30') AS calls_last_week
  FROM logs_fx),
t AS (SELECT *, floor((40 * calls_last_week + 7) / 14) AS tw10 FROM c)
SELECT calls_today, calls_yesterday, calls_day_before,
  calls_today - calls_yesterday AS delta_today,
  calls_yesterday - calls_day_before AS delta_yesterday,
  calls_last_week,
  floor((200 * calls_last_week + 7) / 14) / 100.0 AS avg_last_week,
  tw10 / 10.0 AS two_week_avg,
  floor((2 * (70 * tw10 - 100 * calls_last_week) + 7) / 14) / 100.0 AS delta_avg
FROM t""".replace("WITH logs_fx", "WITH logs_fx", 1)

ORACLE["activity_visible"] = with_(LOGS_FX, USERS_FX) + """
SELECT l.username AS viewer, l.id, l.username, l.api_endpoint, l.response_code, l.timestamp
FROM logs_fx l WHERE l.username IN (SELECT username FROM users_fx)
UNION ALL
SELECT 'admin' AS viewer, id, username, api_endpoint, response_code, timestamp FROM logs_fx"""

# ------------------------------------------------------------ quota/users
_ALLOW = """CASE {s} WHEN 'Free - (0$)' THEN 10 WHEN 'Gold - (50$)' THEN 15
  WHEN 'Platinum - (100$)' THEN 20 END"""


def _metering_sql(with_topups: bool) -> str:
    where = "" if with_topups else "WHERE event_type <> 'purchase'"
    return with_(USERS_FX) + f""",
ev AS (
  SELECT event_id, {EVENT_USER} AS username, ts, event_type = 'purchase' AS is_topup,
    CASE WHEN event_type = 'purchase' THEN {EVENT_TIER} END AS bought
  FROM events {where}),
j AS (SELECT ev.*, date_trunc('week', ts) AS period, u.service AS tier0, u.calls_remaining
      FROM ev LEFT JOIN users_fx u USING (username)),
-- the tier before each event is the last one bought, else the user's own
f AS (SELECT *, coalesce(last_value(bought IGNORE NULLS) OVER (PARTITION BY username ORDER BY ts, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), tier0) AS tier,
        row_number() OVER (PARTITION BY username, period ORDER BY ts, event_id) = 1 AS opens
      FROM j WHERE tier0 IS NOT NULL),
-- an event that opens a period with a known tier resets the balance
r AS (SELECT *, CASE WHEN opens THEN {_ALLOW.format(s="tier")} END AS reset FROM f),
g AS (SELECT *, count(reset) OVER w AS grp,
        last_value(CASE WHEN reset IS NOT NULL THEN period END IGNORE NULLS) OVER w AS period_start,
        CAST(coalesce(last_value(reset IGNORE NULLS) OVER w, calls_remaining) AS BIGINT) AS start,
        CAST(CASE WHEN is_topup THEN coalesce({_ALLOW.format(s="bought")}, 0) ELSE -1 END AS BIGINT) AS delta
      FROM r WINDOW w AS (PARTITION BY username ORDER BY ts, event_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT *, CAST(start + sum(delta) OVER w AS BIGINT) AS s_now FROM g
      WINDOW w AS (PARTITION BY username, grp ORDER BY ts, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT *, least(0, start, min(s_now) OVER w) AS m_now FROM s
      WINDOW w AS (PARTITION BY username, grp ORDER BY ts, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT *, coalesce(lag(m_now) OVER (PARTITION BY username, grp ORDER BY ts, event_id),
                         least(0, start)) AS m_prev FROM m)
SELECT event_id, username, CASE WHEN is_topup THEN 'topup' ELSE 'call' END AS kind, period_start,
  CASE WHEN NOT is_topup AND m_now < m_prev THEN 403 ELSE 200 END AS response_code,
  CAST(s_now - m_now AS BIGINT) AS balance
FROM p
UNION ALL
SELECT event_id, username, CASE WHEN is_topup THEN 'topup' ELSE 'call' END AS kind,
  NULL AS period_start, 404 AS response_code, NULL AS balance
FROM j WHERE tier0 IS NULL"""


ORACLE["quota_metering"] = _metering_sql(False)
ORACLE["quota_topup"] = _metering_sql(True)

ORACLE["quota_reset"] = with_(USERS_FX) + f"""
SELECT username, service,
  CAST(coalesce({_ALLOW.format(s="service")}, calls_remaining) AS INTEGER) AS calls_remaining
FROM users_fx"""

ORACLE["remaining_calls"] = with_(USERS_FX) + """
SELECT a.username, u.calls_remaining,
  CASE WHEN u.calls_remaining > 5 THEN 'ok' WHEN u.calls_remaining IS NOT NULL THEN 'low' END AS balance_flag
FROM (SELECT DISTINCT concat('u', CAST(user_id AS VARCHAR)) AS username FROM events) a
LEFT JOIN users_fx u USING (username)"""

_SIGNUPS_FX = """signups_fx AS (
  SELECT CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat('u', CAST(CASE WHEN c_custkey % 11 = 1
      THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR)) END AS username,
    CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE replace(c_name, '#', '') END AS password,
    CAST(c_custkey * 1000000007 AS VARCHAR) AS credit_card,
    CASE c_custkey % 3 WHEN 0 THEN 'Free - (0$)' WHEN 1 THEN 'Gold - (50$)'
      ELSE 'Platinum - (100$)' END AS service,
    c_custkey AS ordinal
  FROM customer)"""

_ERRORS = """list_filter([
    CASE WHEN coalesce(username, '') = '' THEN 'Username is required.' END,
    CASE WHEN NOT regexp_matches(coalesce(password, ''), '^[a-zA-Z0-9]{8,}$')
      THEN 'Password must be at least 8 characters long and can only contain alphanumeric characters.' END,
    CASE WHEN NOT regexp_matches(coalesce(credit_card, ''), '^[0-9]{12}$')
      THEN 'Credit card number must be 12 digits long and can only contain numeric characters.' END],
  lambda x: x IS NOT NULL)"""

ORACLE["signup_validation"] = with_(_SIGNUPS_FX) + f"""
SELECT ordinal, username, CAST(len(e) AS BIGINT) AS n_errors, array_to_string(e, '; ') AS errors
FROM (SELECT *, {_ERRORS} AS e FROM signups_fx)"""

ORACLE["user_signup"] = with_(USERS_FX, _SIGNUPS_FX) + f""",
existing AS (
  SELECT username FROM users_fx
  WHERE username IN (SELECT concat('u', CAST(user_id AS VARCHAR)) FROM events)),
f AS (
  SELECT *, ordinal = min(ordinal) FILTER (WHERE valid) OVER (PARTITION BY username) AS first
  FROM (SELECT *, len({_ERRORS}) = 0 AS valid FROM signups_fx))
SELECT ordinal, username,
  CASE WHEN NOT valid THEN 422
    WHEN username IN (SELECT username FROM existing) OR NOT first THEN 400 ELSE 200 END AS response_code
FROM f"""

_UPGRADES = f"""upgrades AS (
  SELECT event_id, {EVENT_USER} AS username, ts, {EVENT_TIER} AS service
  FROM events WHERE event_type = 'purchase'),
upgrade_out AS (
  SELECT up.event_id, up.username, up.ts,
    CASE WHEN u.username IS NOT NULL THEN 200 ELSE 404 END AS response_code,
    CASE WHEN u.username IS NOT NULL THEN up.service END AS service,
    CASE WHEN u.username IS NOT NULL THEN CAST(u.calls_remaining + sum(coalesce(CASE up.service
        WHEN 'Free - (0$)' THEN 10 WHEN 'Gold - (50$)' THEN 15 WHEN 'Platinum - (100$)' THEN 20 END, 0))
      OVER (PARTITION BY up.username ORDER BY up.ts, up.event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) END AS calls_remaining
  FROM upgrades up LEFT JOIN users_fx u USING (username)),
upgrade_desc AS (
  SELECT *, CASE WHEN response_code = 200 THEN 'Subscription updated: service=' || service
      || ', calls_remaining=' || CAST(calls_remaining AS VARCHAR) ELSE 'User not found' END AS description
  FROM upgrade_out)"""

ORACLE["user_update"] = with_(USERS_FX, _UPGRADES) + """
SELECT event_id, username, response_code, service, calls_remaining, description FROM upgrade_desc"""

_PASSWORDS = f"""passwords AS (
  SELECT event_id, {EVENT_USER} AS username, ts, concat('pw', CAST(event_id AS VARCHAR)) AS password
  FROM events WHERE event_type = 'signup')"""

ORACLE["password_update"] = with_(USERS_FX, _PASSWORDS) + """
SELECT event_id, username, CASE WHEN u.username IS NULL THEN 404 ELSE 200 END AS response_code,
  CASE WHEN u.username IS NULL THEN 'User not found.' ELSE 'Password updated successfully.' END AS description
FROM passwords LEFT JOIN (SELECT username FROM users_fx) u USING (username)"""

ORACLE["users_after_updates"] = with_(USERS_FX, _UPGRADES, _PASSWORDS) + """,
lu AS (SELECT username, service, calls_remaining FROM upgrade_out WHERE response_code = 200
       QUALIFY row_number() OVER (PARTITION BY username ORDER BY ts DESC, event_id DESC) = 1),
lp AS (SELECT username, password FROM passwords
       QUALIFY row_number() OVER (PARTITION BY username ORDER BY ts DESC, event_id DESC) = 1)
SELECT u.username, coalesce(lu.service, u.service) AS service,
  CAST(coalesce(lu.calls_remaining, u.calls_remaining) AS BIGINT) AS calls_remaining,
  CASE WHEN lp.password IS NULL THEN u.password ELSE sha256(concat('triagekit-salt:', u.username, lp.password)) END AS password
FROM users_fx u LEFT JOIN lu ON lu.username = u.username LEFT JOIN lp ON lp.username = u.username"""

ORACLE["activity_append"] = with_(USERS_FX, LOGS_FX, _UPGRADES) + """
SELECT (SELECT max(id) FROM logs_fx) + row_number() OVER (ORDER BY ts, event_id) AS id,
  username, 'PUT' AS request_type, 'update_subscription' AS api_endpoint,
  CAST(response_code AS INTEGER) AS response_code, description, ts AS timestamp
FROM upgrade_desc"""

ORACLE["mask_sensitive"] = with_(USERS_FX) + """
SELECT username, sha256(concat('triagekit-salt:', username, password)) AS password, service FROM users_fx"""

# ------------------------------------------------------------ text, links
_PAGES_TEXT = """pages_text AS (
  SELECT page_id, url, html, concat('see ', url, ' and ', html, ' end') AS text,
    concat('<p><img width="3" src="', url, '"><img alt="no-src">', '<img src="">', '<img src="', url,
           '#2" data-x="1" src="second"></p>', html, '<img src="open"') AS body
  FROM pages)"""
_IMG_TAG = '<img[^>]*?src="([^">]+)"[^>]*>'

ORACLE["strip_urls"] = with_(_PAGES_TEXT) + """
SELECT page_id, regexp_replace(text, 'https?://[!$-_a-z]+', '', 'g') AS text FROM pages_text"""

ORACLE["rewrite_images"] = with_(_PAGES_TEXT) + f"""
SELECT page_id, regexp_replace(coalesce(body, ''), '{_IMG_TAG}',
  '<img src="\\1" style="width:auto;height:auto;max-width:100%;" />', 'g') AS body
FROM pages_text"""

ORACLE["image_urls"] = with_(_PAGES_TEXT) + f""",
l AS (SELECT page_id, regexp_extract_all(coalesce(body, ''), '{_IMG_TAG}', 1) AS urls FROM pages_text)
SELECT page_id, CAST(generate_subscripts(urls, 1) - 1 AS BIGINT) AS pos, unnest(urls) AS image_url
FROM l"""

_LINKS = """links AS (
  SELECT concat('d', CAST(doc_id AS VARCHAR)) AS link_id,
    concat('https://github.com/', source, '/', lang) AS link FROM documents
  UNION ALL
  SELECT concat('p', CAST(page_id AS VARCHAR)) AS link_id, url AS link FROM pages),
parsed AS (
  SELECT link_id,
    nullif(regexp_extract(link, '^https://github\\.com/([^/]+)/([^/?#]+)', 1), '') AS repo_owner,
    nullif(regexp_extract(link, '^https://github\\.com/([^/]+)/([^/?#]+)', 2), '') AS repo_name
  FROM links)"""

ORACLE["repo_link_parse"] = with_(_LINKS) + "SELECT link_id, repo_owner, repo_name FROM parsed"

ORACLE["repo_register"] = with_(_LINKS) + """,
req AS (SELECT DISTINCT repo_owner, repo_name FROM parsed
        WHERE repo_owner IS NOT NULL AND repo_name IS NOT NULL),
reg AS (SELECT DISTINCT source AS repo_owner, lang AS repo_name FROM documents
        WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT r.repo_owner, r.repo_name,
  CASE WHEN g.repo_owner IS NULL THEN 'inserted' ELSE 'exists' END AS outcome
FROM req r LEFT JOIN reg g ON r.repo_owner = g.repo_owner AND r.repo_name = g.repo_name"""

# ----------------------------------------------------------------- issues
ORACLE["issue_lookup"] = with_(ISSUES_FX) + """
SELECT l.doc_id AS id, i.issue_url, i.title
FROM labels l LEFT JOIN issues_fx i ON i.id = l.doc_id AND i.state = 'closed' AND l.doc_id % 5 <> 2"""

ORACLE["open_issues_page"] = with_(ISSUES_FX) + """
SELECT * FROM (
  SELECT repo_owner, repo_name, id, title, issue_url,
    row_number() OVER (PARTITION BY repo_owner, repo_name ORDER BY id DESC) AS rank
  FROM issues_fx WHERE state = 'open')
WHERE rank > 10 AND rank <= 20"""

ORACLE["repo_pairs"] = with_(ISSUES_FX) + "SELECT DISTINCT repo_owner, repo_name FROM issues_fx"

ORACLE["owner_repos"] = with_(ISSUES_FX) + """
SELECT repo_owner, string_agg(repo_name, ', ' ORDER BY repo_name) AS repos
FROM (SELECT DISTINCT repo_owner, repo_name FROM issues_fx) GROUP BY repo_owner"""

ORACLE["high_water"] = with_(ISSUES_FX) + """
SELECT repo_owner, repo_name, max(updated_at) AS high_water,
  strftime(max(updated_at) + INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%SZ') AS since
FROM issues_fx GROUP BY repo_owner, repo_name"""

# ---------------------------------------------------------------- quality
_DQ_EXTRACT = """dq AS (
  SELECT id AS "ID", issue_url AS "ISSUE_URL", repo_owner AS "REPO_OWNER", repo_name AS "REPO_NAME",
    issue_number AS "ISSUE_NUMBER", created_by AS "CREATED_BY", title AS "TITLE", body AS "BODY",
    state AS "STATE", updated_at AS "UPDATED_AT"
  FROM issues_fx)"""

ORACLE["dq_extract"] = with_(ISSUES_FX, _DQ_EXTRACT) + "SELECT * FROM dq"


def _unique_sql(table: str, col: str, full: bool) -> str:
    head = "'expect_column_values_to_be_unique' AS expectation_type, " if full else ""
    tail = ", NULL::VARCHAR AS observed" if full else ""
    return f"""SELECT {head}'{col}' AS "column", coalesce(sum(n) FILTER (WHERE n > 1), 0) = 0 AS success,
  (SELECT count(*) FROM {table}) AS element_count,
  CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS unexpected_count{tail}
FROM (SELECT CAST("{col}" AS VARCHAR) AS v, count(*) AS n FROM {table}
      WHERE "{col}" IS NOT NULL GROUP BY v)"""


def _not_null_sql(table: str, col: str, full: bool) -> str:
    head = "'expect_column_values_to_not_be_null' AS expectation_type, " if full else ""
    tail = ", NULL::VARCHAR AS observed" if full else ""
    return f"""SELECT {head}'{col}' AS "column", count(*) FILTER (WHERE "{col}" IS NULL) = 0 AS success,
  count(*) AS element_count, count(*) FILTER (WHERE "{col}" IS NULL) AS unexpected_count{tail}
FROM {table}"""


_NN_COLS = ["ID", "ISSUE_URL", "REPO_OWNER", "REPO_NAME", "ISSUE_NUMBER", "CREATED_BY",
            "TITLE", "STATE", "UPDATED_AT"]

ORACLE["dq_suite"] = with_(ISSUES_FX, _DQ_EXTRACT) + "\nUNION ALL\n".join([
    """SELECT 'expect_table_row_count_to_be_between' AS expectation_type, NULL::VARCHAR AS "column",
  count(*) BETWEEN 1 AND 10000 AS success, count(*) AS element_count,
  NULL::BIGINT AS unexpected_count, CAST(count(*) AS VARCHAR) AS observed FROM dq""",
    """SELECT 'expect_table_columns_to_match_set', NULL, true, NULL, NULL,
  'BODY, CREATED_BY, ID, ISSUE_NUMBER, ISSUE_URL, REPO_NAME, REPO_OWNER, STATE, TITLE, UPDATED_AT'""",
] + [_unique_sql("dq", c, True) for c in ["ID", "ISSUE_URL"]]
  + [_not_null_sql("dq", c, True) for c in _NN_COLS])

ORACLE["dq_unique"] = with_(ISSUES_FX, _DQ_EXTRACT) + "\nUNION ALL\n".join(
    _unique_sql("dq", c, False) for c in ["ID", "ISSUE_URL", "TITLE", "BODY"])

ORACLE["dq_not_null"] = with_(ISSUES_FX) + """,
lab AS (SELECT doc_id AS issue_id, 'x' AS labels FROM labels),
t AS (SELECT i.*, lab.labels FROM issues_fx i LEFT JOIN lab ON i.id = lab.issue_id)
""" + "\nUNION ALL\n".join(_not_null_sql("t", c, False)
                           for c in ["id", "issue_url", "title", "body", "labels"])

# ------------------------------------------------------- tokens, embedding
_TOKS = """toks AS (
  SELECT doc_id, regexp_extract_all(lower(regexp_replace(coalesce(text, ''), 'https?://[!$-_a-z]+', '', 'g')),
    '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N} \\t\\n\\x0B\\f\\r]', 0) AS t
  FROM documents),
tok_rows AS (
  SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos, unnest(t) AS token, len(t) AS n
  FROM toks)"""

_BAG = """bag AS (
  SELECT doc_id, pos // 512 AS chunk_no, least(512, n - (pos // 512) * 512) AS n_tokens,
    CAST(ceil(n / 512.0) AS BIGINT) AS n_chunks,
    CAST(('0x' || substr(md5(token), 1, 4))::INTEGER % 64 AS BIGINT) AS bucket
  FROM tok_rows),
weights AS (
  SELECT doc_id, chunk_no, n_chunks, bucket, CAST(count(*) * 1000000 // n_tokens AS BIGINT) AS weight
  FROM bag GROUP BY doc_id, chunk_no, n_tokens, n_chunks, bucket),
pooled AS (
  SELECT doc_id, bucket, n_chunks, CAST(sum(weight) // n_chunks AS BIGINT) AS value
  FROM weights GROUP BY doc_id, bucket, n_chunks)"""

ORACLE["tokenize"] = with_(_TOKS) + """
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens FROM toks"""

ORACLE["vocab_encode"] = with_(_TOKS) + """,
vocab AS (SELECT token, dense_rank() OVER (ORDER BY token) AS token_id FROM (SELECT DISTINCT token FROM tok_rows))
SELECT r.doc_id, r.pos, CAST(v.token_id AS BIGINT) AS token_id FROM tok_rows r JOIN vocab v USING (token)"""

ORACLE["chunk_tokens"] = with_(_TOKS) + """,
c AS (SELECT doc_id, len(t) AS n FROM toks WHERE len(t) > 0)
SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(least(512, n - chunk_no * 512) AS BIGINT) AS n_tokens
FROM (SELECT doc_id, n, unnest(range(0, CAST(ceil(n / 512.0) AS BIGINT))) AS chunk_no FROM c)"""

ORACLE["embed_bag"] = with_(_TOKS, _BAG) + """
SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, bucket, weight FROM weights"""

ORACLE["chunk_mean_pool"] = with_(_TOKS, _BAG) + "SELECT doc_id, bucket, value FROM pooled"

ORACLE["issue_embeddings"] = with_(_TOKS, _BAG) + """,
dims AS (SELECT unnest(range(0, 64)) AS bucket),
nch AS (SELECT DISTINCT doc_id, n_chunks FROM pooled)
SELECT d.doc_id AS id, CAST(coalesce(n.n_chunks, 0) AS BIGINT) AS n_chunks,
  string_agg(CAST(coalesce(p.value, 0) AS VARCHAR), ',' ORDER BY g.bucket) AS vector
FROM documents d CROSS JOIN dims g
LEFT JOIN pooled p ON p.doc_id = d.doc_id AND p.bucket = g.bucket
LEFT JOIN nch n ON n.doc_id = d.doc_id
GROUP BY d.doc_id, n.n_chunks"""

# ------------------------------------------------------- ingest, comments
_COMMENTS = """com AS (
  SELECT conv_id AS id, 'comment ' || CAST(turn AS VARCHAR) AS comment_key, text AS body
  FROM conversations WHERE conv_id IN (SELECT doc_id FROM documents)),
lab AS (
  SELECT doc_id AS id, string_agg(name, ', ' ORDER BY name) AS labels FROM (
    SELECT doc_id, 'quality:' || CAST(quality AS VARCHAR) AS name FROM labels
    UNION ALL SELECT doc_id, 'toxic:' || CAST(toxic AS VARCHAR) FROM labels) GROUP BY doc_id)"""

ORACLE["issue_flatten"] = with_(ISSUES_FX, _COMMENTS) + """
SELECT i.id, i.issue_url, i.repo_owner, i.repo_name, i.issue_number, i.created_by, i.title, i.body,
  CAST((SELECT count(DISTINCT comment_key) FROM com WHERE com.id = i.id) AS BIGINT) AS n_comments,
  CASE WHEN i.id % 7 = 3 THEN 0 ELSE i.id % 3 END AS n_reactions,
  CASE WHEN i.id % 7 = 3 OR i.id % 3 = 0 THEN '[]' ELSE '[' || array_to_string(list_transform(range(1, i.id % 3 + 1),
    lambda n: '{"id":' || CAST(i.id * 10 + n AS VARCHAR) || ',"user_login":"user' || CAST(n AS VARCHAR) || '","user_id":'
      || CAST(n AS VARCHAR) || ',"content":"' || CASE WHEN n = 1 THEN '+1' ELSE 'heart' END
      || '","created_at":"2024-01-02T03:04:05Z"}'), ',') || ']' END AS reactions_json,
  i.created_by AS assignees, coalesce(l.labels, '') AS labels,
  CASE WHEN i.id % 5 <> 0 THEN 'v' || CAST(i.id % 5 AS VARCHAR) ELSE 'None' END AS milestone,
  i.state, i.updated_at,
  'https://api.github.com/repos/' || i.repo_owner || '/' || i.repo_name || '/issues' AS endpoint
FROM issues_fx i LEFT JOIN lab l ON l.id = i.id"""

ORACLE["comments_map"] = with_(_COMMENTS) + "SELECT id, comment_key, body FROM com"
ORACLE["comments_json"] = ORACLE["comments_map"]

ORACLE["labels_joined"] = with_(ISSUES_FX, _COMMENTS) + """
SELECT i.id, coalesce(l.labels, '') AS labels FROM issues_fx i LEFT JOIN lab l ON l.id = i.id"""

ORACLE["open_issues_comments"] = with_(ISSUES_FX) + """
SELECT i.id, i.title, c.turn AS comment_id, c.text AS body
FROM issues_fx i LEFT JOIN conversations c ON c.conv_id = i.id WHERE i.state = 'open'"""

_INCREMENTAL = """landed AS (
  SELECT i.id, c.turn, 'turn ' || CAST(c.turn AS VARCHAR) || ': ' || split_part(c.text, chr(10), 1) AS title,
    c.text AS body, CASE WHEN c.role = 'user' THEN 'open' ELSE 'closed' END AS state,
    i.updated_at + to_days(CAST(c.turn AS INTEGER)) AS updated_at, i.repo_owner, i.repo_name
  FROM conversations c JOIN issues_fx i ON c.conv_id = i.id),
hw AS (SELECT repo_owner, repo_name, max(updated_at) + INTERVAL 1 SECOND AS since
       FROM issues_fx GROUP BY 1, 2),
sel AS (
  SELECT l.* FROM landed l LEFT JOIN hw USING (repo_owner, repo_name)
  WHERE l.body IS NOT NULL AND l.body <> '' AND (hw.since IS NULL OR l.updated_at >= hw.since))"""

ORACLE["ingest_incremental"] = with_(ISSUES_FX, _INCREMENTAL) + """
SELECT id, turn, title, state, updated_at FROM sel"""

ORACLE["issue_upsert"] = with_(ISSUES_FX, _INCREMENTAL) + """,
last AS (SELECT * FROM sel QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, turn DESC) = 1)
SELECT id, title, state, updated_at FROM issues_fx WHERE id NOT IN (SELECT id FROM last)
UNION ALL SELECT id, title, state, updated_at FROM last"""

# ---------------------------------------------------------- vector index
ORACLE["ivf_assign"] = """
WITH ex AS (SELECT label, generate_subscripts(embedding, 1) AS j, unnest(embedding) AS x FROM embeddings),
cent AS (SELECT label AS cell, j, avg(x::DOUBLE) AS x FROM ex GROUP BY label, j),
centv AS (SELECT cell, list(x ORDER BY j) AS c FROM cent GROUP BY cell),
d AS (SELECT e.vec_id AS pk, c.cell,
        list_sum(list_transform(list_zip(e.embedding, c.c),
          lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))) AS dist
      FROM embeddings e, centv c)
SELECT pk, CAST(cell AS INTEGER) AS cell FROM d
QUALIFY row_number() OVER (PARTITION BY pk ORDER BY dist, cell) = 1"""

_REEMBED = """reembed AS (SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT conv_id FROM conversations))"""

ORACLE["vectors_existing"] = with_(_REEMBED) + """
SELECT vec_id AS pk FROM embeddings WHERE vec_id IN (SELECT id FROM reembed)"""

ORACLE["vector_upsert"] = with_(_REEMBED, _TOKS, _BAG) + """,
fweights AS (SELECT doc_id, chunk_no, n_chunks, bucket, count(*) / n_tokens::DOUBLE AS w
             FROM bag GROUP BY doc_id, chunk_no, n_tokens, n_chunks, bucket),
fpooled AS (SELECT doc_id, bucket, CAST(sum(w) / any_value(n_chunks) AS FLOAT) AS v FROM fweights GROUP BY doc_id, bucket),
vec AS (SELECT id, list(coalesce(v, 0::FLOAT) ORDER BY g.b) AS v
        FROM reembed CROSS JOIN (SELECT unnest(range(0, 64)) AS b) g
        LEFT JOIN fpooled f ON f.doc_id = id AND f.bucket = g.b GROUP BY id),
merged AS (
  SELECT vec_id AS pk, 'target' AS origin, embedding AS v FROM embeddings WHERE vec_id NOT IN (SELECT id FROM reembed)
  UNION ALL SELECT id, 'batch', v FROM vec)
SELECT pk, origin, CAST(len(v) AS BIGINT) AS dim,
  array_to_string(list_transform(v, lambda x: CAST(floor(x::DOUBLE * 1e4 + 0.5) AS BIGINT)), ',') AS values
FROM merged"""

# ---------------------------------------------------------------- prompts
ORACLE["prompts_rendered"] = with_(*_SERVICE_CTES) + """
SELECT e.vec_id AS query_id,
  'What is a possible solution to the following GitHub issue? Please provide a very detailed and instructive solution, or if there are no questions to answer in the issue, suggest some potential solutions or explain why a solution may not be feasible. If you are unsure, please provide any insights or suggestions that may be helpful in resolving the issue. Thank you for your contribution!.' || chr(10) || chr(10) || ' Github Issue:' || coalesce(i.body, '') || chr(10) || chr(10) AS prompt
FROM embeddings e JOIN issues_fx i ON i.id = e.vec_id
WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.query_id = e.vec_id)"""

# ------------------------------------------------- scalable search paths
ORACLE["knn_l2_cells"] = ORACLE["knn_l2"]
ORACLE["knn_l2_two_pass"] = ORACLE["knn_l2"]

ORACLE["summary_prompts"] = with_(ISSUES_FX) + """
SELECT id,
  'Please analyze the following GitHub issue body and provide a detailed summary of the problem. Please note that we are only looking for a summary and not a solution or any additional information. Thank you. ONLY SUMMARY.' || chr(10) || chr(10) || 'Issue Body: ' || coalesce(body, '') || chr(10) || chr(10) AS prompt
FROM issues_fx WHERE state = 'open'"""


# ------------------------------------------------ stored index, dead letters
ORACLE["knn_l2_index"] = ORACLE["knn_l2"]
ORACLE["ivf_index"] = "SELECT count(*) AS n_vectors, CAST(0 AS BIGINT) AS n_misplaced FROM embeddings"

ORACLE["fetch_dead_letter"] = with_(ISSUES_FX) + """,
c AS (SELECT conv_id AS id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT i.id, i.title, CASE WHEN i.id % 10 = 4 OR i.id % 13 = 5 THEN 'dead letter' ELSE 'kept' END AS outcome,
  coalesce(c.n, 0) AS n_comments, CASE WHEN i.id % 7 = 3 THEN 0 ELSE i.id % 3 END AS n_reactions
FROM issues_fx i LEFT JOIN c USING (id) WHERE i.state = 'open'"""

ORACLE["landed_dead_letter"] = """
SELECT doc_id AS id, CASE WHEN doc_id % 17 = 3 THEN 'yesterday' END AS updated_at
FROM documents WHERE doc_id % 17 IN (3, 4)"""

ORACLE["child_endpoints"] = "SELECT doc_id AS id, " + ", ".join(
    f"'https://api.github.com/repos/' || source || '/' || lang || '/issues/' || CAST(doc_id AS VARCHAR) || '/{k}' AS {k}"
    for k in ("comments", "reactions")) + " FROM documents"

ORACLE["dq_suite_absent"] = """
SELECT 'expect_column_values_to_be_unique' AS expectation_type, 'ID' AS "column",
  count(*) = count(DISTINCT doc_id) AS success FROM documents
UNION ALL SELECT 'expect_column_values_to_not_be_null', 'ID', count(*) = count(doc_id) FROM documents
UNION ALL SELECT 'expect_column_values_to_be_unique', 'ASSIGNEE', false
UNION ALL SELECT 'expect_column_values_to_not_be_null', 'ASSIGNEE', false"""

ORACLE["dq_csv_batch"] = "SELECT expectation_type, \"column\", success, element_count, unexpected_count FROM (" + \
    ORACLE["dq_suite"] + ")"

ORACLE["chunk_token_ids"] = with_(_TOKS) + """,
vocab AS (SELECT token, dense_rank() OVER (ORDER BY token) AS token_id FROM (SELECT DISTINCT token FROM tok_rows))
SELECT r.doc_id, r.pos // 512 AS chunk_no, string_agg(CAST(v.token_id AS VARCHAR), ' ' ORDER BY r.pos) AS token_ids
FROM tok_rows r JOIN vocab v USING (token) GROUP BY r.doc_id, r.pos // 512"""


# --------------------------------------------------------------- streams
ORACLE["stream_ingest"] = with_(ISSUES_FX) + """,
landed AS (
  SELECT i.id, c.turn, 'turn ' || CAST(c.turn AS VARCHAR) || ': ' || split_part(c.text, chr(10), 1) AS title,
    c.text AS body, CASE WHEN c.role = 'user' THEN 'open' ELSE 'closed' END AS state, (i.id + c.turn) % 17 AS odd,
    i.updated_at + to_days(CAST(c.turn // 2 AS INTEGER)) AS updated_at, i.repo_owner, i.repo_name
  FROM conversations c JOIN issues_fx i ON c.conv_id = i.id),
hw AS (SELECT repo_owner, repo_name, max(updated_at) + INTERVAL 1 SECOND AS since FROM issues_fx GROUP BY 1, 2),
last AS (
  SELECT l.id, l.title, l.state, l.updated_at FROM landed l JOIN hw USING (repo_owner, repo_name)
  WHERE odd NOT IN (3, 4) AND l.body IS NOT NULL AND l.body <> '' AND l.updated_at >= hw.since
  QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY l.updated_at DESC, l.turn DESC) = 1)
SELECT 'table' AS outcome, id, title, state, updated_at, CAST(NULL AS VARCHAR) AS landed_time
FROM issues_fx WHERE id NOT IN (SELECT id FROM last)
UNION ALL SELECT 'table', id, title, state, updated_at, NULL FROM last
UNION ALL SELECT 'unreadable time', id, title, state, NULL, CASE WHEN odd = 3 THEN 'yesterday' END
FROM landed WHERE odd IN (3, 4)"""

ORACLE["stream_requests_by_user_date"] = ORACLE["requests_by_user_date"]

ORACLE["model_embeddings"] = with_(_TOKS) + """,
vocab AS (SELECT token, dense_rank() OVER (ORDER BY token) AS token_id FROM (SELECT DISTINCT token FROM tok_rows)),
chunk AS (
  SELECT r.doc_id, r.pos // 512 AS chunk_no, j, sum((v.token_id * 31 + j * 17 + 7) % 97) * 1000 // count(*) AS x
  FROM tok_rows r JOIN vocab v USING (token), (SELECT unnest(range(16)) AS j) GROUP BY ALL),
pooled AS (SELECT doc_id, j, count(*) AS n, sum(x) // count(*) AS x FROM chunk GROUP BY doc_id, j)
SELECT d.doc_id, CAST(coalesce(max(p.n), 0) AS BIGINT) AS n_chunks,
  string_agg(CAST(CAST(coalesce(p.x, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY g.j) AS vector
FROM documents d CROSS JOIN (SELECT unnest(range(16)) AS j) g LEFT JOIN pooled p ON p.doc_id = d.doc_id AND p.j = g.j
GROUP BY d.doc_id"""

ORACLE["stream_metering"] = "SELECT event_id, username, kind, response_code, balance FROM (" + ORACLE["quota_topup"] + ")"

# ---------------------------------------------------- completion, publication
ORACLE["completions"] = "WITH p AS (" + ORACLE["summary_prompts"] + """),
n AS (SELECT id, prompt, length(prompt) AS n FROM p)
SELECT id, CASE WHEN n % 13 <> 5 THEN trim('echo of ' || n || ': ' || left(prompt, 8)) END AS reply,
  CASE WHEN n % 13 = 5 THEN 502 ELSE 200 END AS response_code,
  CASE WHEN n % 13 = 5 THEN 'RuntimeError: no reply to ' || n || ' characters'
    ELSE 'Generated summary for issue' END AS description
FROM n"""

ORACLE["published_reports"] = """
SELECT 'validations/2024/kind=' || CASE WHEN "column" IS NULL THEN 'table' ELSE 'column' END
  || '/expectation_type=' || expectation_type AS folder, "column", success, true AS every_file_once
FROM (""" + ORACLE["dq_suite"] + ")"

ORACLE["quality_store"] = """SELECT expectation_type, "column", success, element_count, unexpected_count,
  '20240102-000000' AS run_name FROM (""" + ORACLE["dq_suite"] + ")"

ORACLE["activity_records"] = with_(LOGS_FX) + "SELECT * FROM logs_fx"

ORACLE["application_tables"] = with_(_SIGNUPS_FX) + """,
ok AS (
  SELECT * FROM signups_fx
  WHERE username <> '' AND regexp_full_match(password, '[a-zA-Z0-9]{8,}') AND regexp_full_match(credit_card, '[0-9]{12}')
  QUALIFY row_number() OVER (PARTITION BY username ORDER BY ordinal) = 1)
SELECT username, service, CASE service WHEN 'Free - (0$)' THEN 10 WHEN 'Gold - (50$)' THEN 15 ELSE 20 END AS calls_remaining,
  sha256('salt:' || password) AS password
FROM ok"""

ORACLE["call_metrics_empty"] = ORACLE["call_metrics"].replace("FROM logs_fx)", "FROM logs_fx WHERE username IS NULL)")

ORACLE["comments_json_text"] = with_(ISSUES_FX, _COMMENTS) + """
SELECT i.id, '{' || coalesce(string_agg(to_json(comment_key) || ':' || to_json(com.body), ','
    ORDER BY CAST(split_part(comment_key, ' ', 2) AS BIGINT)), '') || '}' AS comments_json
FROM issues_fx i LEFT JOIN com ON com.id = i.id GROUP BY i.id"""
