"""Similar-issue search: top-k hits → rescaled similarity → closed issues.

Composite operators C1/C2 of the survey:
``knn_l2 → rescale (window max per query) → threshold → join closed issues``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import maybe_broadcast
from .knn import knn_l2

# Fixed values of the search service.
DEFAULT_TOP_K = 999
DEFAULT_THRESHOLD = 90.0
NO_MATCH_TEXT = "No similar issues found"


def round_half_up(x: Column, digits: int) -> Column:
    """Round half up on the binary value; identical in every IEEE engine."""
    scale = float(10 ** digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def rescale_similarity(hits: DataFrame, query_id_col: str = "query_id") -> DataFrame:
    """Similarity relative to the farthest hit of the same query, in percent.

    ``round((max - d) / max * 100, 2)``; the farthest hit scores 0.  When all
    hits of a query are at distance 0 every hit scores 100 (the service
    would divide by zero there).
    """
    m = F.max("distance").over(Window.partitionBy(query_id_col))
    sim = F.when(m == 0, F.lit(100.0)).otherwise(
        round_half_up((m - F.col("distance")) / m * F.lit(100.0), 2))
    return hits.withColumn("similarity", sim)


def _join_closed(hits: DataFrame, issues: DataFrame, scoped: bool) -> DataFrame:
    closed = issues.where(F.col("state") == "closed").select(
        F.col("id"), F.col("title"), F.col("issue_url").alias("url"),
        F.col("repo_owner").alias("_owner"), F.col("repo_name").alias("_repo"))
    h = hits
    cond = h["pk"] == closed["id"]
    if scoped:
        # None / "" mean "no filter" for owner and repo.
        own = F.coalesce(h["owner"], F.lit(""))
        rep = F.coalesce(h["repo"], F.lit(""))
        cond = cond & ((own == "") | (own == closed["_owner"])) & \
            ((rep == "") | (rep == closed["_repo"]))
    return h.join(closed, cond, "inner")


def similar_issues(vectors: DataFrame, queries: DataFrame, issues: DataFrame, *,
                   k: int = DEFAULT_TOP_K, threshold: float = DEFAULT_THRESHOLD,
                   scoped: bool = False, squared: bool = True, **knn_kw) -> DataFrame:
    """Closed issues similar to each query: ``(query_id, id, title, similarity, url)``.

    ``queries`` has ``query_id, embedding`` and, when ``scoped``, nullable
    ``owner, repo``.  As in the service, the scope is applied after the
    global top-k and the threshold.
    """
    hits = knn_l2(vectors, queries.select("query_id", "embedding"), k, squared=squared, **knn_kw)
    hits = rescale_similarity(hits).where(F.col("similarity") > F.lit(float(threshold)))
    if scoped:
        hits = hits.join(queries.select("query_id", "owner", "repo"), "query_id")
    # Hits measured to be small are broadcast, so the issue table is scanned but
    # never shuffled (AQE could only switch after shuffling it); beyond the bound
    # both sides shuffle on id.  The search itself runs once, for the checkpoint.
    hits = maybe_broadcast(hits, materialize=True)
    out = _join_closed(hits, issues, scoped)
    return out.select("query_id", "id", "title", "similarity", "url")


def match_lines(matches: DataFrame) -> DataFrame:
    """Display line per match: ``- title (#id) - 12.34% - (url)``."""
    return matches.select(
        "query_id", "id",
        F.concat(F.lit("- "), F.col("title"), F.lit(" (#"), F.col("id").cast("string"),
                 F.lit(") - "), F.format_string("%.2f%%", F.col("similarity")),
                 F.lit(" - ("), F.col("url"), F.lit(")")).alias("line"))


def unmatched_queries(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """Queries without any closed match: they fall through to the solver."""
    return queries.join(matches.select("query_id").distinct(), "query_id", "left_anti")


def search_activity(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """One activity-log outcome per query: 200 with a hit count, else 204."""
    counts = matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    q = queries.select("query_id").join(counts, "query_id", "left")
    n = F.coalesce(F.col("n_hits"), F.lit(0)).cast("bigint")
    return q.select(
        "query_id",
        n.alias("n_hits"),
        F.when(n > 0, F.lit(200)).otherwise(F.lit(204)).alias("response_code"),
        F.when(n > 0, F.format_string("Found %d similar issues", n))
         .otherwise(F.lit(NO_MATCH_TEXT)).alias("description"))
