"""Schemas of the engine's tables (issue tracker data model)."""

from pyspark.sql import types as T

ISSUE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("issue_url", T.StringType()),
    T.StructField("repo_owner", T.StringType()),
    T.StructField("repo_name", T.StringType()),
    T.StructField("issue_number", T.LongType()),
    T.StructField("created_by", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("comments", T.MapType(T.StringType(), T.StringType())),
    T.StructField("reactions", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("user_login", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("created_at", T.StringType()),
    ]))),
    T.StructField("assignees", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("milestone", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

# Landed issue document as served by the tracker's REST API.
RAW_ISSUE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("number", T.LongType()),
    T.StructField("html_url", T.StringType()),
    T.StructField("repo_owner", T.StringType()),
    T.StructField("repo_name", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("user", T.StructType([T.StructField("login", T.StringType())])),
    T.StructField("assignees", T.ArrayType(T.StructType([T.StructField("login", T.StringType())]))),
    T.StructField("labels", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
    T.StructField("milestone", T.StructType([T.StructField("title", T.StringType())])),
    T.StructField("comments", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("body", T.StringType())]))),
    T.StructField("reactions", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("user", T.StructType([T.StructField("login", T.StringType()),
                                            T.StructField("id", T.LongType())])),
        T.StructField("content", T.StringType()),
        T.StructField("created_at", T.StringType()),
    ]))),
])

REPO = T.StructType([
    T.StructField("repo_owner", T.StringType()),
    T.StructField("repo_name", T.StringType()),
])

APP_USER = T.StructType([
    T.StructField("username", T.StringType(), False),
    T.StructField("password", T.StringType()),
    T.StructField("credit_card", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("calls_remaining", T.IntegerType()),
])

ACTIVITY = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("username", T.StringType(), False),
    T.StructField("request_type", T.StringType(), False),
    T.StructField("api_endpoint", T.StringType(), False),
    T.StructField("response_code", T.IntegerType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
])

VECTOR = T.StructType([
    T.StructField("pk", T.LongType(), False),
    T.StructField("embeddings", T.ArrayType(T.FloatType())),
])

# The ten columns the quality extract projects and the suite expects.
DQ_COLUMNS = ["id", "issue_url", "repo_owner", "repo_name", "issue_number",
              "created_by", "title", "body", "state", "updated_at"]
