"""Call metering per subscription tier: served / denied calls and balances.

Semantics of the service: a call is served and costs one unit while the
balance is positive; otherwise it is denied (403) and costs nothing.  The
periodic reset *sets* the balance to the allowance of the tier in force; a tier
the reset does not know keeps its balance across periods.  A top-up (upgrade)
sets the tier bought and adds its amount, so later resets follow that tier.
Unknown users get 404 and are not metered.

The balance is a clipped running sum.  With S the unclipped running sum
(start + top-ups - calls) and M = min(0, running min of S), a call is denied
exactly when M drops, and balance = S - M.  Both running aggregates are
computed as a two-level prefix scan: per (group, time chunk, part) windows of a
bounded number of rows, then per-group offsets over one summary row per part.  A
user with a huge share of the traffic, even inside one second, is therefore spread
over many tasks instead of one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import maybe_broadcast
from ..sources.fixtures import TIER_FREE, TIER_GOLD, TIER_PLATINUM
from .indexing import CHUNK_ROWS, split_chunks

# Allowance per tier (reset level and upgrade amount).
TIER_ALLOWANCE = {TIER_FREE: 10, TIER_GOLD: 15, TIER_PLATINUM: 20}
LOW_BALANCE_LIMIT = 5


def tier_allowance(service: Column) -> Column:
    """Allowance of a tier, null for tiers the reset does not know."""
    expr = F.when(F.lit(False), F.lit(None).cast("int"))
    for k, v in TIER_ALLOWANCE.items():
        expr = expr.when(service == k, F.lit(v))
    return expr


def reset_allowance(users: DataFrame) -> DataFrame:
    """Periodic reset: known tiers get their allowance, others keep theirs."""
    return users.withColumn(
        "calls_remaining",
        F.coalesce(tier_allowance(F.col("service")), F.col("calls_remaining")).cast("int"))


def topup_amount(service: Column) -> Column:
    """Amount an upgrade to ``service`` adds (0 for other services)."""
    return F.coalesce(tier_allowance(service), F.lit(0))


def low_balance_flag(remaining: Column) -> Column:
    """``ok`` above the limit, else ``low``; null where there is no balance (no such user)."""
    return F.when(remaining > LOW_BALANCE_LIMIT, "ok").when(remaining.isNotNull(), "low")


def meter_calls(events: DataFrame, users: DataFrame, *, period: str = "hour",
                chunk_seconds: int = 3600, max_rows: int = CHUNK_ROWS) -> DataFrame:
    """Meter a stream of calls and top-ups against the users' tiers.

    ``events``: ``event_id, username, ts, kind`` with kind ``call`` or
    ``topup``, and for top-ups ``service``, the tier bought.  ``users``:
    ``username, service, calls_remaining``.  ``period``: reset unit for
    ``date_trunc`` (``hour`` in the service).
    Returns one row per event: ``event_id, username, kind, period_start,
    response_code, balance`` (balance after the event; null for 404;
    ``period_start`` is the period whose reset the balance counts from, null
    before any reset).
    """
    u = users.select("username", F.col("service").alias("_tier0"),
                     F.col("calls_remaining").cast("long").alias("_init"), F.lit(True).alias("_found"))
    bought = F.col("service") if "service" in events.columns else F.lit(None).cast("string")
    ev = events.select("event_id", "username", "ts", "kind",
                       F.when(F.col("kind") == "topup", bought).alias("_bought"))
    ev = ev.join(maybe_broadcast(u), "username", "left")  # events never shuffled for it
    # Names without a user, null ones included, never reach the windows.
    missing = ev.where(F.col("_found").isNull()).select(
        "event_id", "username", "kind", F.lit(None).cast("timestamp_ntz").alias("period_start"),
        F.lit(404).alias("response_code"), F.lit(None).cast("long").alias("balance"))
    ev = ev.where(F.col("_found").isNotNull()).withColumn(
        "_period", F.date_trunc(period, "ts").cast("timestamp_ntz"))

    # Tier in force when each period begins: one row per (user, period), so the
    # windows below see periods, not events.
    per = ev.groupBy("username", "_period").agg(
        F.first("_tier0").alias("_tier0"), F.first("_init").alias("_init"),
        F.max(F.when(F.col("kind") == "topup", F.struct("ts", "event_id", "_bought"))).alias("_last"))
    w_user = Window.partitionBy("username").orderBy("_period")
    before = F.last("_last", ignorenulls=True).over(w_user.rowsBetween(Window.unboundedPreceding, -1))
    per = per.withColumn("_before", before).withColumn(
        "_allow", tier_allowance(F.when(F.col("_before").isNotNull(), F.col("_before._bought")).otherwise(F.col("_tier0"))))
    upto = w_user.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reset = F.last(F.when(F.col("_allow").isNotNull(), F.struct("_period", "_allow")), ignorenulls=True).over(upto)
    per = per.withColumn("_reset", reset).select(
        "username", "_period", F.col("_reset._period").alias("period_start"),
        F.coalesce(F.col("_reset._allow").cast("long"), F.col("_init"), F.lit(0).cast("long")).alias("_start"))
    ev = ev.join(per, ["username", "_period"]).withColumns({
        # Non-null group keys: plain equality in the offset join below then
        # matches the window's hash partitioning, so the event rows are not
        # shuffled again.  Events before any reset share one sentinel period.
        "_pk": F.coalesce("period_start", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")),
        "_delta": F.when(F.col("kind") == "topup", topup_amount(F.col("_bought")))
                   .otherwise(F.lit(-1)).cast("long"),
    })
    # Group = everything one reset (or the first balance) covers.
    grp = ["username", "_pk"]
    order = ["ts", "event_id"]
    chunk = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(chunk_seconds * 1_000_000))
    ev = split_chunks(ev, grp, order, chunk, max_rows)
    key = [*grp, "_chunk", "_part"]
    w_chunk = (Window.partitionBy(*key).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ev.withColumn("_ls", F.sum("_delta").over(w_chunk))
    local = local.withColumn("_lm", F.min("_ls").over(w_chunk))
    local = local.withColumn("_prev_lm", F.lag("_lm").over(
        Window.partitionBy(*key).orderBy(*order)))
    # One summary row per part, then exclusive prefixes over parts.
    summ = local.groupBy(*key).agg(
        F.sum("_delta").alias("_tot"), F.min("_ls").alias("_cmin"),
        F.first("_start").alias("_s0"))
    w_grp = Window.partitionBy(*grp).orderBy("_chunk", "_part").rowsBetween(
        Window.unboundedPreceding, -1)
    summ = summ.withColumn("_off", F.col("_s0") + F.coalesce(F.sum("_tot").over(w_grp), F.lit(0)))
    # running min of S over all earlier parts: min(offset_p + part_min_p)
    summ = summ.withColumn("_pmin", F.min(F.col("_off") + F.col("_cmin")).over(w_grp))
    j = local.join(summ.select(*key, "_off", "_pmin"), key)
    # least() skips nulls: a missing earlier-chunk minimum simply drops out.
    s_now = F.col("_off") + F.col("_ls")
    min_now = F.least(F.col("_start"), F.col("_pmin"), F.col("_off") + F.col("_lm"))
    min_prev = F.least(F.col("_start"), F.col("_pmin"), F.col("_off") + F.col("_prev_lm"))
    zero = F.lit(0).cast("long")
    m_now = F.least(zero, min_now)
    m_prev = F.least(zero, min_prev)
    code = F.when((F.col("kind") == "call") & (m_now < m_prev), F.lit(403)).otherwise(F.lit(200))
    done = j.select("event_id", "username", "kind", "period_start", code.alias("response_code"),
                    (s_now - m_now).alias("balance"))
    return done.unionByName(missing)
