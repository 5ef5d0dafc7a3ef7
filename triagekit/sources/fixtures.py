"""Adapters that present the driver tables in the engine's data model.

Every adapter is a projection (plus at most a join) over a whole driver
table, so it scales with the table and Catalyst prunes unused columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Fixed values of the application's data model.
TIER_FREE = "Free - (0$)"
TIER_GOLD = "Gold - (50$)"
TIER_PLATINUM = "Platinum - (100$)"


def _minutes_after_epoch_base(n: Column) -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), n.cast("int"), F.lit(0))


def issues_fx(spark: SparkSession, base: str) -> DataFrame:
    """ISSUES table built over ``documents`` (one issue per document)."""
    d = read_table(spark, base, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("https://github.com/"), "source", F.lit("/"), "lang",
                 F.lit("/issues/"), F.col("doc_id").cast("string")).alias("issue_url"),
        F.col("source").alias("repo_owner"),
        F.col("lang").alias("repo_name"),
        F.col("doc_id").alias("issue_number"),
        F.concat(F.lit("user"), (F.col("doc_id") % 37).cast("string")).alias("created_by"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        F.when(F.col("doc_id") % 3 == 0, "open").otherwise("closed").alias("state"),
        _minutes_after_epoch_base(F.col("doc_id")).alias("updated_at"),
    )


def logs_fx(spark: SparkSession, base: str) -> DataFrame:
    """Activity LOGS built over ``events``."""
    e = read_table(spark, base, "events")
    et = F.col("event_type")
    endpoint = (F.when(et == "click", "get_similar_issues")
                .when(et == "view", "get_github_solutions")
                .when(et == "signup", "get_issue_summary")
                .when(et == "purchase", "update_subscription")
                .otherwise("get_possible_solution"))
    m = F.col("event_id") % 10
    code = (F.when(m == 0, 404).when(m.isin(1, 2), 204).when(m == 3, 403).otherwise(200))
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"),
        F.lit("POST").alias("request_type"),
        endpoint.alias("api_endpoint"),
        code.alias("response_code"),
        F.col("ts").alias("timestamp"),
    )


def users_fx(spark: SparkSession, base: str) -> DataFrame:
    """APP_USERS built over ``customer``."""
    c = read_table(spark, base, "customer")
    m = F.col("c_custkey") % 4
    service = (F.when(m == 0, TIER_FREE).when(m == 1, TIER_GOLD)
               .when(m == 2, TIER_PLATINUM).otherwise("Other"))
    return c.select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("username"),
        F.col("c_name").alias("password"),
        service.alias("service"),
        (F.col("c_custkey") % 12).cast("int").alias("calls_remaining"),
    )


def vectors_fx(spark: SparkSession, base: str) -> DataFrame:
    """Vector collection (pk = issue id) over ``embeddings``."""
    return read_table(spark, base, "embeddings").select(
        F.col("vec_id").alias("pk"), F.col("embedding").alias("embeddings"))


def query_vectors_fx(spark: SparkSession, base: str) -> DataFrame:
    """Search batch: every stored issue searched for its similar issues."""
    return read_table(spark, base, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("embedding"))


def search_vectors_fx(spark: SparkSession, base: str) -> DataFrame:
    """Search corpus: each stored vector under an even id and, under the next odd id, a
    near variant of it (scaled, exact in single precision)."""
    e = read_table(spark, base, "embeddings")
    scaled = F.transform("embedding", lambda x: x * F.lit(1.125).cast("float"))
    return e.select(F.explode(F.array(
        F.struct((F.col("vec_id") * 2).alias("pk"), F.col("embedding").alias("embeddings")),
        F.struct((F.col("vec_id") * 2 + 1).alias("pk"), scaled.alias("embeddings")))).alias("v")).select("v.*")


def search_queries_fx(spark: SparkSession, base: str) -> DataFrame:
    """Search batch: vectors that are in no corpus, between a vector and its variant;
    every fourth is a vector read backwards, near to none."""
    between = F.transform("embedding", lambda x: x * F.lit(1.0625).cast("float"))
    return read_table(spark, base, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.when(F.col("vec_id") % 4 == 0, F.reverse("embedding")).otherwise(between).alias("embedding"))


def comments_fx(spark: SparkSession, base: str) -> DataFrame:
    """Issue comments over ``conversations`` (issue id, comment id, body)."""
    return read_table(spark, base, "conversations").select(
        F.col("conv_id").alias("issue_id"), F.col("turn").alias("comment_id"),
        F.col("text").alias("body"))


def label_names_fx(spark: SparkSession, base: str) -> DataFrame:
    """Issue labels over ``labels``: one row per (issue, label name)."""
    lab = read_table(spark, base, "labels")
    return lab.select(
        F.col("doc_id").alias("issue_id"),
        F.explode(F.array(
            F.concat(F.lit("quality:"), F.col("quality").cast("string")),
            F.concat(F.lit("toxic:"), F.col("toxic").cast("string")))).alias("name"))


def signups_fx(spark: SparkSession, base: str) -> DataFrame:
    """Sign-up form submissions over ``customer`` (one form per customer)."""
    c = read_table(spark, base, "customer")
    k = F.col("c_custkey")
    tier = F.when(k % 3 == 0, TIER_FREE).when(k % 3 == 1, TIER_GOLD).otherwise(TIER_PLATINUM)
    return c.select(
        # Two forms for some names: of those the first is often invalid.
        F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(
            F.lit("u"), F.when(k % 11 == 1, k - 1).otherwise(k).cast("string"))).alias("username"),
        F.when(k % 5 == 0, F.col("c_name")).otherwise(F.regexp_replace("c_name", "#", "")).alias("password"),
        (k * F.lit(1000000007)).cast("string").alias("credit_card"),
        tier.alias("service"),
        k.alias("ordinal"))


def _event_user() -> Column:
    """User of an event; some names have no user (404 outcomes)."""
    return F.concat(F.when(F.col("event_id") % 50 == 7, F.lit("ghost")).otherwise(F.lit("u")),
                    F.col("user_id").cast("string"))


def _event_tier() -> Column:
    m = F.col("event_id") % 3
    return F.when(m == 0, TIER_FREE).when(m == 1, TIER_GOLD).otherwise(TIER_PLATINUM)


def metered_events_fx(spark: SparkSession, base: str, with_topups: bool) -> DataFrame:
    """API calls (every non-purchase event) and, optionally, purchases as top-ups."""
    e = read_table(spark, base, "events")
    if not with_topups:
        e = e.where(F.col("event_type") != "purchase")
    topup = F.col("event_type") == "purchase"
    return e.select("event_id", _event_user().alias("username"), "ts",
                    F.when(topup, "topup").otherwise("call").alias("kind"),
                    F.when(topup, _event_tier()).alias("service"))


def upgrades_fx(spark: SparkSession, base: str) -> DataFrame:
    """Subscription upgrades: each purchase event picks a tier."""
    e = read_table(spark, base, "events").where(F.col("event_type") == "purchase")
    return e.select("event_id", _event_user().alias("username"), "ts", _event_tier().alias("service"))


def password_changes_fx(spark: SparkSession, base: str) -> DataFrame:
    """Password changes: each signup event sets a new password."""
    e = read_table(spark, base, "events").where(F.col("event_type") == "signup")
    return e.select("event_id", _event_user().alias("username"), "ts",
                    F.concat(F.lit("pw"), F.col("event_id").cast("string")).alias("password"))


def active_usernames_fx(spark: SparkSession, base: str) -> DataFrame:
    """Users seen in the activity stream."""
    return read_table(spark, base, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username")).distinct()


def raw_issues_fx(spark: SparkSession, base: str) -> DataFrame:
    """Landed issue documents (nested, as the REST API serves them)."""
    issues = issues_fx(spark, base)
    com = comments_fx(spark, base).groupBy("issue_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("comment_id").alias("id"),
                                             F.col("body")))).alias("comments"))
    lab = label_names_fx(spark, base).groupBy("issue_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("name")))).alias("labels"))
    j = (issues.join(com, issues["id"] == com["issue_id"], "left").drop("issue_id")
         .join(lab, issues["id"] == lab["issue_id"], "left").drop("issue_id"))
    ms = F.col("id") % 5
    return j.select(
        "id", F.col("issue_number").alias("number"), F.col("issue_url").alias("html_url"),
        "repo_owner", "repo_name", "title", "body", "state",
        F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
        F.struct(F.col("created_by").alias("login")).alias("user"),
        F.array(F.struct(F.col("created_by").alias("login"))).alias("assignees"),
        F.coalesce("labels", F.array().cast("array<struct<name:string>>")).alias("labels"),
        F.when(ms != 0, F.struct(F.concat(F.lit("v"), ms.cast("string")).alias("title"))).alias("milestone"),
        F.coalesce("comments", F.array().cast("array<struct<id:bigint,body:string>>")).alias("comments"),
        # Reactions: one per label value of the issue's number, none for every third, null for some.
        F.when(F.col("id") % 7 == 3, F.lit(None)).otherwise(F.transform(
            F.when(F.col("id") % 3 == 0, F.array().cast("array<int>")).otherwise(
                F.sequence(F.lit(1), (F.col("id") % 3).cast("int"))),
            lambda n: F.struct(
                (F.col("id") * 10 + n).alias("id"),
                F.struct(F.concat(F.lit("user"), n.cast("string")).alias("login"), n.cast("long").alias("id")).alias("user"),
                F.when(n == 1, "+1").otherwise("heart").alias("content"),
                F.lit("2024-01-02T03:04:05Z").alias("created_at")))).alias("reactions"))


def landed_updates_fx(spark: SparkSession, base: str) -> DataFrame:
    """New versions of issues landed by the daily pull: one per conversation turn."""
    c = read_table(spark, base, "conversations")
    i = issues_fx(spark, base)
    j = c.join(i, c["conv_id"] == i["id"])
    return j.select(
        "id", "issue_url", "repo_owner", "repo_name", "issue_number", "created_by",
        F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit(": "),
                 F.substring_index("text", "\n", 1)).alias("title"),
        F.col("text").alias("body"),
        F.when(F.col("role") == "user", "open").otherwise("closed").alias("state"),
        (F.col("updated_at") + F.make_dt_interval(F.col("turn").cast("int"))).alias("updated_at"),
        "turn")


def landed_documents_fx(spark: SparkSession, base: str) -> DataFrame:
    """Landed documents with their arrival number: new versions of issues, two of each time
    and some with a time that cannot be read."""
    u = landed_updates_fx(spark, base).join(
        issues_fx(spark, base).select("id", F.col("updated_at").alias("_before")), "id")
    odd = (F.col("id") + F.col("turn")) % 17
    time = F.date_format(F.col("_before") + F.make_dt_interval(F.floor(F.col("turn") / 2).cast("int")),
                         "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return u.select(
        "id", F.col("issue_number").alias("number"), F.col("issue_url").alias("html_url"), "repo_owner", "repo_name",
        "title", "body", "state",
        F.when(odd == 3, "yesterday").when(odd == 4, F.lit(None)).otherwise(time).alias("updated_at"),
        F.col("turn").cast("long").alias("ordinal"))
