"""DuckDB forms of the fixture adapters (see triagekit.sources.fixtures)."""

ISSUES_FX = """issues_fx AS (
  SELECT doc_id AS id,
    concat('https://github.com/', source, '/', lang, '/issues/', CAST(doc_id AS VARCHAR)) AS issue_url,
    source AS repo_owner, lang AS repo_name, doc_id AS issue_number,
    concat('user', CAST(doc_id % 37 AS VARCHAR)) AS created_by,
    split_part(text, chr(10), 1) AS title, text AS body,
    CASE WHEN doc_id % 3 = 0 THEN 'open' ELSE 'closed' END AS state,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS updated_at
  FROM documents)"""

LOGS_FX = """logs_fx AS (
  SELECT event_id AS id, concat('u', CAST(user_id AS VARCHAR)) AS username, 'POST' AS request_type,
    CASE event_type WHEN 'click' THEN 'get_similar_issues' WHEN 'view' THEN 'get_github_solutions'
      WHEN 'signup' THEN 'get_issue_summary' WHEN 'purchase' THEN 'update_subscription'
      ELSE 'get_possible_solution' END AS api_endpoint,
    CASE WHEN event_id % 10 = 0 THEN 404 WHEN event_id % 10 IN (1, 2) THEN 204
      WHEN event_id % 10 = 3 THEN 403 ELSE 200 END AS response_code,
    ts AS timestamp
  FROM events)"""

USERS_FX = """users_fx AS (
  SELECT concat('u', CAST(c_custkey AS VARCHAR)) AS username, c_name AS password,
    CASE c_custkey % 4 WHEN 0 THEN 'Free - (0$)' WHEN 1 THEN 'Gold - (50$)'
      WHEN 2 THEN 'Platinum - (100$)' ELSE 'Other' END AS service,
    CAST(c_custkey % 12 AS INTEGER) AS calls_remaining
  FROM customer)"""

# User of an event (some names have no user) and the tier a purchase buys.
EVENT_USER = "concat(CASE WHEN event_id % 50 = 7 THEN 'ghost' ELSE 'u' END, CAST(user_id AS VARCHAR))"
EVENT_TIER = """CASE event_id % 3 WHEN 0 THEN 'Free - (0$)' WHEN 1 THEN 'Gold - (50$)'
      ELSE 'Platinum - (100$)' END"""

# Squared L2 of every (query, vector) pair, folded over dims in double.
PAIR_DIST = """pair_dist AS (
  SELECT q.vec_id AS query_id, v.vec_id AS pk,
    list_sum(list_transform(list_zip(q.embedding, v.embedding),
      lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS distance
  FROM embeddings q, embeddings v)"""

# The same for the search fixture: queries outside the corpus, a near variant of each vector.
SEARCH_DIST = """corpus AS (
  SELECT vec_id * 2 AS pk, embedding AS v FROM embeddings
  UNION ALL SELECT vec_id * 2 + 1, list_transform(embedding, lambda x: x::FLOAT * 1.125::FLOAT) FROM embeddings),
batch AS (
  SELECT vec_id AS query_id, CASE WHEN vec_id % 4 = 0 THEN list_reverse(embedding)
    ELSE list_transform(embedding, lambda x: x::FLOAT * 1.0625::FLOAT) END AS e
  FROM embeddings),
pair_dist AS (
  SELECT q.query_id, c.pk, list_sum(list_transform(list_zip(q.e, c.v),
      lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS distance
  FROM batch q, corpus c)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
