"""Activity log: visibility, append, and usage analytics (one scan each)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import maybe_broadcast
from .indexing import with_sequential_index

# Response code labels shown on the usage dashboard.
STATUS_LABELS = {200: "Success", 204: "No Data Returned", 404: "Failure"}


def status_label(code: Column) -> Column:
    """200 Success, 204 No Data Returned, 404 Failure, any other code as text."""
    expr = F.when(F.lit(False), F.lit(None))
    for k, v in STATUS_LABELS.items():
        expr = expr.when(code == k, F.lit(v))
    return expr.otherwise(code.cast("string"))


def requests_by_user_date(logs: DataFrame) -> DataFrame:
    """Requests per (user, calendar date)."""
    return (logs.groupBy("username", F.to_date("timestamp").alias("date"))
            .agg(F.count(F.lit(1)).alias("count")))


def status_counts(logs: DataFrame) -> DataFrame:
    """Requests per status label, restricted to the three charted labels."""
    lab = status_label(F.col("response_code"))
    return (logs.select(lab.alias("status"))
            .where(F.col("status").isin(*STATUS_LABELS.values()))
            .groupBy("status").agg(F.count(F.lit(1)).alias("count")))


def endpoint_counts(logs: DataFrame) -> DataFrame:
    """Requests per API endpoint."""
    return logs.groupBy("api_endpoint").agg(F.count(F.lit(1)).alias("count"))


def _round_sevenths(num: Column, digits: int) -> Column:
    """round(num / 7, digits) half up, in exact integer arithmetic."""
    scale = 10 ** digits
    return F.floor((F.lit(2 * scale) * num + F.lit(7)) / F.lit(14)) / F.lit(float(scale))


def call_metrics(logs: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Dashboard metrics for ``as_of`` in one pass over the last seven days.

    Today / yesterday / day-before counts and deltas, the week (as_of-7d,
    as_of], its daily mean (2 dp), the 'two-week' figure round(2*mean, 1)
    and its delta round(two_week - mean, 2).  Empty input gives zeros.
    """
    as_of = F.lit(str(as_of)).cast("date")
    d = F.to_date("timestamp")
    # Only the last week matters: the range filter reaches the parquet scan.
    recent = logs.where((F.col("timestamp") >= F.date_sub(as_of, 7).cast("timestamp_ntz"))
                        & (F.col("timestamp") < F.date_add(as_of, 1).cast("timestamp_ntz")))

    def n_on(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")

    agg = recent.agg(
        n_on(d == as_of).alias("calls_today"),
        n_on(d == F.date_sub(as_of, 1)).alias("calls_yesterday"),
        n_on(d == F.date_sub(as_of, 2)).alias("calls_day_before"),
        n_on((d > F.date_sub(as_of, 7)) & (d <= as_of)).alias("calls_last_week"))
    week = F.col("calls_last_week")
    two_week_x10 = F.floor((F.lit(40) * week + F.lit(7)) / F.lit(14))
    # two_week - week/7, scaled by 100: (70 * two_week_x10 - 100 * week) / 7
    delta_num = F.lit(70) * two_week_x10 - F.lit(100) * week
    return agg.select(
        "calls_today", "calls_yesterday", "calls_day_before",
        (F.col("calls_today") - F.col("calls_yesterday")).alias("delta_today"),
        (F.col("calls_yesterday") - F.col("calls_day_before")).alias("delta_yesterday"),
        "calls_last_week",
        _round_sevenths(week, 2).alias("avg_last_week"),
        (two_week_x10 / F.lit(10.0)).alias("two_week_avg"),
        (F.floor((F.lit(2) * delta_num + F.lit(7)) / F.lit(14)) / F.lit(100.0)).alias("delta_avg"))


def visible_activity(logs: DataFrame, viewers: DataFrame, admins: list[str] = ()) -> DataFrame:
    """Rows each viewer may see: admins see every row, others their own.

    ``viewers`` (column ``viewer``) is matched to owners by an equi-join;
    each admin name adds one full copy of the log (the admin view), in place
    of the admin's own rows; all copies come from one scan.
    """
    admins = list(dict.fromkeys(admins))
    v = viewers.select(F.col("viewer").alias("username")).distinct()
    if admins:
        v = v.where(~F.col("username").isin(admins))
    v = maybe_broadcast(v)
    own = logs.join(v, "username")  # the log is never shuffled for the viewers
    out = own.withColumn("viewer", F.col("username"))
    if admins:
        out = out.unionByName(logs.withColumn("viewer", F.explode(F.array(*[F.lit(a) for a in admins]))))
    return out


# Full microsecond precision (the JSON default keeps milliseconds only).
JSON_TIME_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
                     "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def activity_json(logs: DataFrame) -> DataFrame:
    """Activity rows as JSON records (one compact object per row)."""
    return logs.select(F.to_json(F.struct(*[F.col(c) for c in logs.columns]),
                                 JSON_TIME_OPTIONS).alias("record"))


def activity_from_json(records: DataFrame, schema) -> DataFrame:
    """Parse JSON activity records back into typed columns."""
    return records.select(F.from_json("record", schema, JSON_TIME_OPTIONS).alias("r")).select("r.*")


def append_activity(logs: DataFrame, new_rows: DataFrame) -> DataFrame:
    """New log rows with ids continuing the log's sequence, time defaulted to now.

    ``new_rows`` needs ``username, request_type, api_endpoint,
    response_code (text or int), description`` and optional ``timestamp``,
    ``ordinal`` (arrival order).  Returns only the appended rows.
    """
    # Scalar subquery: the current max id, evaluated once and inlined.
    base = logs.select(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    if "timestamp" not in new_rows.columns:
        new_rows = new_rows.withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
    if "ordinal" not in new_rows.columns:
        new_rows = new_rows.withColumn("ordinal", F.monotonically_increasing_id())
    rows = new_rows.withColumn(
        "timestamp", F.coalesce(F.col("timestamp"), F.localtimestamp()))
    rows = with_sequential_index(rows, ["timestamp", "ordinal"], name="_seq", start=1)
    return rows.select(
        (base + F.col("_seq")).alias("id"),
        "username", "request_type", "api_endpoint",
        F.col("response_code").cast("int").alias("response_code"),
        "description", "timestamp")
