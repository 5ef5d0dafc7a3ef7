"""Application users: sign-up validation and insert, updates, masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import maybe_broadcast
from .indexing import CHUNK_ROWS, running_sum
from .quota import topup_amount

# Sign-up form rules and their messages.
PASSWORD_PATTERN = r"^[a-zA-Z0-9]{8,}$"
CARD_PATTERN = r"^[0-9]{12}$"
MSG_USERNAME = "Username is required."
MSG_PASSWORD = ("Password must be at least 8 characters long and can only contain "
                "alphanumeric characters.")
MSG_CARD = "Credit card number must be 12 digits long and can only contain numeric characters."
MSG_USER_NOT_FOUND = "User not found"
MSG_PASSWORD_UPDATED = "Password updated successfully."


def signup_errors(username: Column, password: Column, card: Column) -> Column:
    """All validation errors of a sign-up form, in form order (empty if valid)."""
    checks = F.array(
        F.when(F.coalesce(username, F.lit("")) == "", F.lit(MSG_USERNAME)),
        F.when(~F.coalesce(password, F.lit("")).rlike(PASSWORD_PATTERN), F.lit(MSG_PASSWORD)),
        F.when(~F.coalesce(card, F.lit("")).rlike(CARD_PATTERN), F.lit(MSG_CARD)))
    return F.filter(checks, lambda x: x.isNotNull())


def validate_signups(forms: DataFrame) -> DataFrame:
    """Adds ``errors`` (array) and ``valid`` to sign-up forms."""
    errs = signup_errors(F.col("username"), F.col("password"), F.col("credit_card"))
    return forms.withColumn("errors", errs).withColumn("valid", F.size("errors") == 0)


def mask_sensitive(users: DataFrame, salt: str | Column, columns=("password", "credit_card")) -> DataFrame:
    """Replace sensitive columns by salted SHA-256 digests (one-way).

    ``salt`` is one text for all rows, or a column with a salt per row.
    """
    out = users
    salt = F.lit(salt) if isinstance(salt, str) else salt
    for c in columns:
        if c in users.columns:
            out = out.withColumn(c, F.sha2(F.concat(salt, F.col(c)), 256))
    return out


def signup(users: DataFrame, forms: DataFrame) -> DataFrame:
    """Sign-up outcomes: 200 inserted, 400 username taken, 422 invalid form.

    Only absent usernames are inserted (anti join); within one batch the
    first valid form per username (by ``ordinal``) wins.  Returns the forms
    with ``errors, valid, response_code``; :func:`inserted_users` gives the
    masked rows to append.
    """
    f = validate_signups(forms)
    # One row per username (first valid ordinal, already registered?) by aggregation,
    # then a single join back: a username repeated in a third of the batch is
    # combined map-side and split by AQE in the join, never windowed whole.
    per_name = f.where("valid").groupBy("username").agg(F.min("ordinal").alias("_first_ord"))
    # Existence: the (small) set of submitted names filters the user table
    # through a semi join, instead of shuffling every registered user.
    exists = (users.select("username")
              .join(maybe_broadcast(per_name.select("username")), "username", "left_semi")
              .distinct().withColumn("_exists", F.lit(True)))
    per_name = per_name.join(exists, "username", "left")
    f = f.join(per_name, "username", "left")
    code = (F.when(~F.col("valid"), F.lit(422))
            .when(F.col("_exists").isNotNull() | (F.col("ordinal") != F.col("_first_ord")), F.lit(400))
            .otherwise(F.lit(200)))
    return f.withColumn("response_code", code).drop("_first_ord", "_exists")


def inserted_users(outcomes: DataFrame, salt: str | Column) -> DataFrame:
    """Rows to append to APP_USERS for the inserted forms (masked)."""
    new = outcomes.where(F.col("response_code") == 200).select(
        "username", "password", "credit_card", "service",
        topup_amount(F.col("service")).cast("int").alias("calls_remaining"))
    return mask_sensitive(new, salt)


def update_passwords(users: DataFrame, updates: DataFrame) -> DataFrame:
    """Outcome per password change (``event_id, username, ts, password``): 200, or 404
    for a name without a user."""
    u = users.select("username", F.lit(True).alias("_found"))
    j = updates.join(maybe_broadcast(u), "username", "left")
    ok = F.col("_found").isNotNull()
    return j.select("event_id", "username", F.when(ok, 200).otherwise(404).alias("response_code"),
                    F.when(ok, F.lit(MSG_PASSWORD_UPDATED)).otherwise(F.lit(MSG_USER_NOT_FOUND + ".")).alias("description"))


def users_after_updates(users: DataFrame, upgrades: DataFrame, passwords: DataFrame,
                        salt: str | Column) -> DataFrame:
    """The user table after all upgrades and password changes.

    Per user one aggregate row (combined map-side): the last tier bought and the sum
    of the amounts, the last password (masked).  Updates of unknown names change
    nothing; users without updates stay as they are.
    """
    order = F.struct("ts", "event_id")
    up = upgrades.groupBy("username").agg(F.max_by("service", order).alias("_service"),
                                          F.sum(topup_amount(F.col("service"))).alias("_added"))
    pw = mask_sensitive(passwords, salt, ["password"]).groupBy("username").agg(
        F.max_by("password", order).alias("_password"))
    j = users.join(up, "username", "left").join(pw, "username", "left")
    new = {"service": F.coalesce("_service", "service"), "password": F.coalesce("_password", "password"),
           "calls_remaining": F.when(F.col("_added").isNull(), F.col("calls_remaining").cast("long")).otherwise(
               F.coalesce(F.col("calls_remaining"), F.lit(0)) + F.col("_added"))}
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in users.columns])


def update_subscriptions(users: DataFrame, updates: DataFrame, max_rows: int = CHUNK_ROWS) -> DataFrame:
    """Apply subscription upgrades in order; unknown users give 404.

    ``updates``: ``event_id, username, ts, service``.  Each upgrade sets the
    service and adds its amount to the balance.  Returns one row per update
    (``event_id, username, ts, response_code, service, calls_remaining,
    description``) with the state after it and the activity description.
    """
    u = users.select("username", F.col("service").alias("_old_service"),
                     F.col("calls_remaining").cast("long").alias("_init"))
    j = updates.join(maybe_broadcast(u.withColumn("_found", F.lit(True))), "username", "left")
    # Names without a user, null ones included, never reach the scan.
    missing = j.where(F.col("_found").isNull())
    j = j.where("_found").withColumn("_amt", topup_amount(F.col("service")).cast("long"))
    # Running sum per user as a two-level scan over hourly chunks, split by rows where one
    # hour of a user holds too many.
    j = running_sum(j, ["username"], ["ts", "event_id"], "_amt",
                    F.date_trunc("hour", F.col("ts").cast("timestamp")), name="_added", max_rows=max_rows)
    remaining = F.coalesce(F.col("_init"), F.lit(0)) + F.col("_added")
    desc = F.format_string("Subscription updated: service=%s, calls_remaining=%d", F.col("service"), remaining)
    done = j.select("event_id", "username", "ts", F.lit(200).alias("response_code"), "service",
                    remaining.alias("calls_remaining"), desc.alias("description"))
    return done.unionByName(missing.select(
        "event_id", "username", "ts", F.lit(404).alias("response_code"), F.lit(None).cast("string").alias("service"),
        F.lit(None).cast("long").alias("calls_remaining"), F.lit(MSG_USER_NOT_FOUND).alias("description")))
