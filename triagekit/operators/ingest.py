"""Issue ingestion: landed documents → flat issue rows, incrementally.

Replaces the per-issue N+1 fetch and row-at-a-time MERGE of an API-driven
loader with set operations: one scan of the landed pages, one join with
the per-repo high-water marks, grouped comment/reaction tables, one upsert.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import issues_endpoint
from ..schemas import RAW_ISSUE
from ..session import maybe_broadcast
from .issues import high_water, merge_high_water  # noqa: F401

# Fixed values.
COMMENT_KEY_PREFIX = "comment "
NO_MILESTONE = "None"


def read_landed_issues(spark, path: str) -> DataFrame:
    """Landed REST pages (JSON lines, one issue per record), fixed schema."""
    return spark.read.schema(RAW_ISSUE).json(path)


def parse_iso(ts: Column) -> Column:
    """ISO-8601 text (``Z`` or an offset, optional fraction) → UTC timestamp_ntz.

    ``try_cast`` gives null for malformed text instead of failing the job
    under ANSI mode; the session time zone is UTC, so the instant is kept.
    """
    return ts.try_cast("timestamp").cast("timestamp_ntz")


def has_body(body: Column) -> Column:
    """Python truthiness of a text: not null and not empty."""
    return body.isNotNull() & (body != "")


def comments_map(comments: Column) -> Column:
    """array<struct<id, body>> → map "comment <id>" → body; duplicate id: last wins."""
    entries = F.transform(comments, lambda c: F.struct(
        F.concat(F.lit(COMMENT_KEY_PREFIX), c["id"].cast("string")).alias("key"),
        c["body"].alias("value")))
    return F.map_from_entries(entries)


def flatten_reactions(reactions: Column) -> Column:
    return F.transform(reactions, lambda r: F.struct(
        r["id"].alias("id"), r["user"]["login"].alias("user_login"), r["user"]["id"].alias("user_id"),
        r["content"].alias("content"), r["created_at"].alias("created_at")))


def flatten_issues(raw: DataFrame, *carried: str) -> DataFrame:
    """Nested issue documents → the 15-column ISSUES row (narrow, no shuffle), plus ``carried``."""
    return raw.select(
        *carried,
        F.col("id"), F.col("html_url").alias("issue_url"), "repo_owner", "repo_name",
        F.col("number").alias("issue_number"), F.col("user.login").alias("created_by"),
        "title", "body",
        comments_map(F.coalesce(F.col("comments"), F.array())).alias("comments"),
        flatten_reactions(F.coalesce(F.col("reactions"), F.array())).alias("reactions"),
        F.array_join(F.transform(F.coalesce(F.col("assignees"), F.array()), lambda a: a["login"]), ", ").alias("assignees"),
        F.array_join(F.transform(F.coalesce(F.col("labels"), F.array()), lambda x: x["name"]), ", ").alias("labels"),
        F.coalesce(F.col("milestone.title"), F.lit(NO_MILESTONE)).alias("milestone"),
        "state", parse_iso(F.col("updated_at")).alias("updated_at"))


def group_children(children: DataFrame, parent_col: str, order_col: str,
                   fields: list[str], name: str) -> DataFrame:
    """Child rows → (parent, array of structs ordered by ``order_col``)."""
    s = F.struct(F.col(order_col).alias("_o"), *[F.col(f) for f in fields])
    arr = F.array_sort(F.collect_list(s))
    return children.groupBy(parent_col).agg(
        F.transform(arr, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))


def attach_children(issues: DataFrame, comments: DataFrame, reactions: DataFrame | None = None,
                    fetch_status: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Attach grouped comments/reactions; drop issues whose fetch failed.

    ``comments``: (issue_id, id, body); ``reactions``: (issue_id, id, user,
    content, created_at); ``fetch_status``: (issue_id, comments_ok,
    reactions_ok).  Issues without children get empty arrays (an empty
    fetch is a success).  Returns ``(kept, dead_letter)``.
    """
    c = group_children(comments, "issue_id", "id", ["id", "body"], "comments")
    out = issues.join(c, F.col("id") == F.col("issue_id"), "left").drop("issue_id")
    out = out.withColumn("comments", F.coalesce("comments", F.array().cast(
        "array<struct<id:bigint,body:string>>")))
    if reactions is not None:
        r = group_children(reactions, "issue_id", "id", ["id", "user", "content", "created_at"], "reactions")
        out = out.join(r, F.col("id") == F.col("issue_id"), "left").drop("issue_id")
        out = out.withColumn("reactions", F.coalesce("reactions", F.array().cast(r.schema["reactions"].dataType)))
    if fetch_status is None:
        return out, out.limit(0)
    st = fetch_status.select(F.col("issue_id").alias("_sid"),
                             (F.col("comments_ok") & F.col("reactions_ok")).alias("_ok"))
    j = out.join(st, F.col("id") == F.col("_sid"), "left")
    ok = F.coalesce(F.col("_ok"), F.lit(True))
    return j.where(ok).drop("_sid", "_ok"), j.where(~ok).drop("_sid", "_ok")


def select_incremental(target: DataFrame | None, landed: DataFrame,
                       marks: DataFrame | None = None) -> DataFrame:
    """Landed issue rows updated at or after their repo's high-water + 1 s.

    Repos without a high-water mark take every row.  Rows need a body and a readable time
    (:func:`unparsed_rows` names those without one).
    ``marks`` (from :func:`merge_high_water`) avoids scanning the target.
    """
    hw = (marks if marks is not None else high_water(target)).select(
        F.col("repo_owner").alias("_o"), F.col("repo_name").alias("_r"),
        (F.col("high_water") + F.expr("INTERVAL 1 SECOND")).alias("_since"))
    # One row per repo: broadcast when the repo count is proven small.
    j = landed.join(maybe_broadcast(hw, materialize=True), (F.col("repo_owner") == F.col("_o"))
                    & (F.col("repo_name") == F.col("_r")), "left")
    keep = has_body(F.col("body")) & F.col("updated_at").isNotNull() & (
        F.col("_since").isNull() | (F.col("updated_at") >= F.col("_since")))
    return j.where(keep).drop("_o", "_r", "_since")


def unparsed_rows(landed_raw: DataFrame) -> DataFrame:
    """Landed documents that incremental selection cannot place, as a dead letter: those
    whose ``updated_at`` is missing or no ISO-8601 time."""
    return landed_raw.where(parse_iso(F.col("updated_at")).isNull())


def endpoint_of(df: DataFrame) -> DataFrame:
    return df.withColumn("endpoint", issues_endpoint(F.col("repo_owner"), F.col("repo_name")))


def incremental_upsert(target: DataFrame, landed_raw: DataFrame,
                       marks: DataFrame | None = None) -> DataFrame:
    """C5: landed documents → flat rows → only rows newer than their repo's
    high-water mark → last-wins merge into the target (new table state).  A column
    ``ordinal`` of the landed documents (arrival order) decides between versions with
    the same time.  Documents without a readable time are not merged; they are the
    dead letter of :func:`unparsed_rows`.

    Pass the maintained ``marks`` table to skip the scan of the target for
    its high-water marks; roll it forward afterwards with
    ``merge_high_water(marks, fresh_rows)``.
    """
    from .upsert import dedupe_last_wins, merge_by_key
    keep = [c for c in target.columns if c != "ordinal"]
    ordinal = F.col("ordinal") if "ordinal" in landed_raw.columns else F.lit(0).cast("long")
    flat = flatten_issues(landed_raw.withColumn("ordinal", ordinal), "ordinal").select(*keep, "ordinal")
    fresh = select_incremental(target, flat, marks)
    # Versions with the same time: the later arrival, then the larger row.
    rest = F.xxhash64(*[F.col(c).cast("string") for c in ("title", "body", "state") if c in keep])
    fresh = fresh.withColumn("_tie", rest)
    last = dedupe_last_wins(fresh, ["id"], ["updated_at", "ordinal", "_tie"]).select(*keep)
    return merge_by_key(target, last, ["id"])
