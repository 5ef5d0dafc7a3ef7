"""Structured Streaming forms of the scheduled jobs.

T1  incremental issue ingest: landed JSON pages → flatten → upsert into the hash
    buckets a micro-batch touches, documents that cannot be placed → dead letter; one
    manifest commits both (foreachBatch, idempotent per epoch).
T2  requests per user and day: event-time windows with a watermark, kept in a table by
    their updates.
T3  quota metering: state per bucket of users (balances, tiers, pending events by slices
    of event time) with a timer a slice; inside a slice the clipped running balances are
    evaluated in closed form with numpy, not row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ingest import flatten_issues, parse_iso, select_incremental
from ..operators.issues import high_water, merge_high_water
from ..operators.upsert import dedupe_last_wins, merge_by_key
from ..operators.quota import TIER_ALLOWANCE
from ..schemas import RAW_ISSUE
from ..session import cut_lineage, ship_package


# ----------------------------------------------------------------- T1
#: Hash buckets of a stream-maintained table; a micro-batch rewrites those it touches.
BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """Complete versions in a folder, oldest first."""
    fs, path = _fs(spark, folder)
    if not fs.exists(path):
        return []
    names = sorted(st.getPath().getName() for st in fs.listStatus(path)
                   if st.isDirectory() and st.getPath().getName().startswith("v"))
    return [n for n in names if fs.exists(_fs(spark, f"{folder}/{n}/_SUCCESS")[1])]


def latest_version(spark: SparkSession, root: str) -> str | None:
    """Newest committed version of the table; its manifest is the commit."""
    found = _versions(spark, f"{root.rstrip('/')}/manifest")
    return found[-1] if found else None


def _manifest(spark: SparkSession, root: str, version: str | None) -> dict[int, str]:
    """Bucket -> version that holds it: at most ``BUCKETS`` rows."""
    if version is None:
        return {}
    rows = spark.read.parquet(f"{root.rstrip('/')}/manifest/{version}").collect()
    return {r["bucket"]: r["version"] for r in rows}


def read_snapshot(spark: SparkSession, root: str, buckets: list[int] | None = None) -> DataFrame | None:
    """The committed table (or some of its buckets); None if there is nothing yet."""
    m = _manifest(spark, root, latest_version(spark, root))
    paths = [f"{root.rstrip('/')}/data/{v}/bucket={b}" for b, v in sorted(m.items())
             if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None


def read_marks(spark: SparkSession, root: str) -> DataFrame | None:
    version = latest_version(spark, root)
    return spark.read.parquet(f"{root.rstrip('/')}/marks/{version}") if version else None


#: A document that was not merged: why, what it says of itself, and itself as JSON text.
DEAD_LETTER = T.StructType([
    T.StructField("epoch", T.LongType()), T.StructField("reason", T.StringType()), T.StructField("id", T.LongType()),
    T.StructField("repo_owner", T.StringType()), T.StructField("repo_name", T.StringType()),
    T.StructField("updated_at", T.StringType()), T.StructField("document", T.StringType())])
CORRUPT = "_corrupt_record"
#: Landed pages may carry their arrival number; lines that are no JSON object are kept as text.
LANDED = T.StructType([*RAW_ISSUE.fields, T.StructField("ordinal", T.LongType()), T.StructField(CORRUPT, T.StringType())])


def dead_letter(batch: DataFrame, epoch_id: int = 0) -> DataFrame:
    """Documents that cannot be merged, with the reason (see ``DEAD_LETTER``): lines that
    are no JSON object, documents without an id, and those without a readable time."""
    text = F.col(CORRUPT) if CORRUPT in batch.columns else F.lit(None).cast("string")
    reason = (F.when(text.isNotNull(), "malformed document").when(F.col("id").isNull(), "no id")
              .when(parse_iso(F.col("updated_at")).isNull(), "unreadable time"))
    own = [c for c in batch.columns if c not in (CORRUPT, "_arrival")]
    return batch.select(
        F.lit(epoch_id).cast("long").alias("epoch"), reason.alias("reason"), "id", "repo_owner", "repo_name", "updated_at",
        F.coalesce(text, F.to_json(F.struct(*own))).alias("document")).where(F.col("reason").isNotNull())


def read_dead_letter(spark: SparkSession, root: str) -> DataFrame:
    """Dead letters of all committed epochs (those of an epoch that failed half way are
    replaced when it runs again)."""
    root, last = root.rstrip("/"), latest_version(spark, root)
    names = [n for n in _versions(spark, f"{root}/dead") if last is not None and n <= last]
    if not names:
        return spark.createDataFrame([], DEAD_LETTER)
    return spark.read.schema(DEAD_LETTER).parquet(*[f"{root}/dead/{n}" for n in names])


def prune_versions(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete what none of the newest ``keep`` manifests refers to; dead letters stay."""
    root = root.rstrip("/")
    kept = _versions(spark, f"{root}/manifest")[-keep:]
    used = {v for k in kept for v in _manifest(spark, root, k).values()}
    for folder, live in (("data", used), ("marks", set(kept)), ("manifest", set(kept))):
        fs, path = _fs(spark, f"{root}/{folder}")
        if not fs.exists(path):
            continue
        for st in fs.listStatus(path):
            name = st.getPath().getName()
            if st.isDirectory() and name.startswith("v") and name not in live and kept and name < kept[-1]:
                fs.delete(st.getPath(), True)


def _with_arrival(batch: DataFrame) -> DataFrame:
    """``_arrival``: the landed number if the pages carry one, then when the file landed,
    its name, and the place in it (a row's number grows along its part of a file)."""
    have = [F.coalesce("ordinal", F.lit(-1).cast("long"))] if "ordinal" in batch.columns else []
    have += [F.col(c) for c in ("_landed", "_file", "_block") if c in batch.columns]
    row = F.monotonically_increasing_id()
    return batch.withColumn("_arrival", F.struct(*have, row.alias("_row"))).drop("_landed", "_file", "_block")


def upsert_batch_into_snapshots(root: str, initial: DataFrame | None = None, buckets: int = BUCKETS):
    """foreachBatch body: merge the micro-batch into the buckets its ids fall in, and keep
    what cannot be merged as dead letters.

    A version ``v{epoch}`` writes the dead letters, the touched buckets, the per-repo
    high-water marks and, last, the manifest that names the version of every bucket: it
    commits table and dead letters together, and a replayed epoch finds it and does
    nothing.  Buckets without fresh rows are neither read nor written, and marks roll
    forward from the fresh rows alone.  Of versions of one issue with the same time the
    later arrival wins.
    """
    root = root.rstrip("/")

    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        name = f"v{epoch_id + 1:09d}"
        if name in _versions(spark, f"{root}/manifest"):
            return
        last = latest_version(spark, root)
        known = _manifest(spark, root, last)
        marks = read_marks(spark, root)
        if last is None and initial is not None:
            marks = cut_lineage(high_water(initial))
        batch = _with_arrival(batch)
        dead_letter(batch, epoch_id).write.mode("overwrite").parquet(f"{root}/dead/{name}")
        if CORRUPT in batch.columns:
            batch = batch.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
        flat = flatten_issues(batch.where(F.col("id").isNotNull()), "_arrival")
        columns = initial.columns if initial is not None else [c for c in flat.columns if c != "_arrival"]
        fresh = select_incremental(None, flat.select(*columns, "_arrival"), marks if marks is not None else
                                   high_water(flat.limit(0)))
        fresh = cut_lineage(dedupe_last_wins(fresh, ["id"], ["updated_at", "_arrival"]).drop("_arrival"))
        bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
        # At most ``buckets`` numbers.
        touched = [r[0] for r in fresh.select(bucket).distinct().collect()]
        if last is None and initial is not None:
            current, touched = initial, list(range(buckets))
        else:
            current = read_snapshot(spark, root, touched) if touched else None
        written = []
        if touched:
            merged = fresh if current is None else merge_by_key(current.select(*columns), fresh, ["id"])
            (merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite")
             .partitionBy("bucket").parquet(f"{root}/data/{name}"))
            fs, _ = _fs(spark, root)
            written = [b for b in touched if fs.exists(_fs(spark, f"{root}/data/{name}/bucket={b}")[1])]
        merge_high_water(marks, fresh).write.mode("overwrite").parquet(f"{root}/marks/{name}")
        rows = sorted({**known, **{b: name for b in written}}.items())
        spark.createDataFrame(rows, "bucket int, version string").coalesce(1).write.mode("overwrite").parquet(
            f"{root}/manifest/{name}")
        prune_versions(spark, root)

    return run


def landed_stream(spark: SparkSession, landed_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """Landed JSON pages as a stream, with where each document stood."""
    src = spark.readStream.schema(LANDED).option("columnNameOfCorruptRecord", CORRUPT)
    if files_per_batch:
        src = src.option("maxFilesPerTrigger", files_per_batch)
    return src.json(landed_dir).select(
        "*", F.col("_metadata.file_modification_time").alias("_landed"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"))


def stream_ingest(spark: SparkSession, landed_dir: str, snapshot_root: str, checkpoint: str,
                  initial: DataFrame | None = None, files_per_batch: int | None = None):
    """Start T1 with ``availableNow``: process everything landed, then stop."""
    src = landed_stream(spark, landed_dir, files_per_batch)
    return (src.writeStream.foreachBatch(upsert_batch_into_snapshots(snapshot_root, initial))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# ----------------------------------------------------------------- T2
def requests_per_user_day(logs_stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Windowed count per (user, day); a day is emitted once the watermark passes it."""
    # Watermarks need TIMESTAMP; the log's wall-clock time is UTC (session zone).
    ev = logs_stream.withColumn("_et", F.col("timestamp").cast("timestamp"))
    return (ev.withWatermark("_et", lateness)
            .groupBy(F.window("_et", "1 day").alias("w"), "username")
            .agg(F.count(F.lit(1)).alias("count"))
            .select("username", F.to_date(F.col("w.start")).alias("date"), "count"))


def append_sink(stream: DataFrame, path: str, checkpoint: str):
    """Run a streaming frame to completion into a Parquet folder (exactly once)."""
    q = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(path))
    q.awaitTermination()
    return q


def updates_sink(stream: DataFrame, root: str, checkpoint: str):
    """Run a streaming aggregate to completion, keeping what each micro-batch changed.

    One folder an epoch, overwritten when the epoch runs again; nothing reaches the driver.
    :func:`read_updates` gives the newest state of every key.
    """
    root = root.rstrip("/")

    def run(batch: DataFrame, epoch_id: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch_id).cast("long")).write.mode("overwrite").parquet(f"{root}/v{epoch_id + 1:09d}")

    q = (stream.writeStream.foreachBatch(run).outputMode("update").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def read_updates(spark: SparkSession, root: str, key: list[str]) -> DataFrame:
    """The newest row of every key among the epochs' updates."""
    names = _versions(spark, root.rstrip("/"))
    rows = spark.read.parquet(*[f"{root.rstrip('/')}/{n}" for n in names])
    return dedupe_last_wins(rows, key, ["_epoch"]).drop("_epoch")


# ----------------------------------------------------------------- T3
METER_OUT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("username", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("period_start", T.TimestampNTZType()),
    T.StructField("response_code", T.IntegerType()), T.StructField("balance", T.LongType())])

_DAY_US = 86_400_000_000
_PERIOD_US = {"hour": 3_600_000_000, "day": _DAY_US}
_NO_TIME = np.iinfo(np.int64).min


def _period_start_us(us: np.ndarray, period: str) -> np.ndarray:
    us = np.where(us == _NO_TIME, us // 1000, us)  # far below every time, and no overflow
    if period == "week":  # from Monday; day 0 was a Thursday
        day = us // _DAY_US
        return (day - (day + 3) % 7) * _DAY_US
    return us - us % _PERIOD_US[period]


def memory_sink(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Run a streaming frame to completion into an in-memory table (tests, smoke)."""
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


# ------------------------------------------------- T3, event-time ordered
#: Event time of one slice of a bucket's pending events: what a task holds at once.
SLICE_US = 60_000_000
#: Buckets that users are dealt into by name; a stream's number stays as long as its checkpoint.
METER_BUCKETS = 1024
_BUCKET = T.StructType([T.StructField("parts", T.LongType()), T.StructField("users", T.BinaryType())])
_PART = T.StructType([T.StructField("slice", T.LongType()), T.StructField("part", T.LongType())])
_PENDING = T.StructType([T.StructField("events", T.BinaryType())])
_USERS = pa.schema([("username", pa.string()), ("period", pa.int64()), ("reset", pa.int64()), ("balance", pa.int64()),
                    ("service", pa.string())])
_EVENTS = pa.schema([("event_id", pa.int64()), ("username", pa.string()), ("us", pa.int64()), ("kind", pa.string()),
                     ("service", pa.string()), ("found", pa.bool_())])


def _to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _meter_ordered(user: np.ndarray, us: np.ndarray, topup: np.ndarray, service: list, states: list[list], period: str):
    """Meter events ordered by user and time from ``states`` (period, reset, balance,
    service of each user), which it moves on.  Calls of one user between two top-ups or
    resets are one segment."""
    allow = dict(TIER_ALLOWANCE)
    periods = _period_start_us(us, period)
    cut = np.ones(len(us) + 1, bool)
    cut[1:-1] = (np.diff(user) != 0) | (np.diff(periods) != 0) | topup[1:] | topup[:-1]
    edges = np.flatnonzero(cut)
    lows, length = edges[:-1], np.diff(edges)
    before, reset = np.empty(len(lows), np.int64), np.empty(len(lows), np.int64)
    for i, (lo, n, u, p, bought) in enumerate(zip(lows.tolist(), length.tolist(), user[lows].tolist(),
                                                  periods[lows].tolist(), topup[lows].tolist(), strict=True)):
        state = states[u]
        if state[0] != p:
            state[0] = p
            if state[3] in allow:  # the reset sets the allowance of the tier in force
                state[2], state[1] = allow[state[3]], p
        b = max(state[2] or 0, 0)
        if bought:
            state[3] = service[lo]
            b += allow.get(state[3], 0)
        before[i], reset[i] = b, -1 if state[1] is None else state[1]
        state[2] = b if bought else max(b - n, 0)
    call = np.where(topup, 0, np.arange(len(us)) - np.repeat(lows, length) + 1)  # number in its segment
    before = np.repeat(before, length)
    return np.where(call > before, 403, 200).astype(np.int32), np.maximum(before - call, 0), np.repeat(reset, length)


class Meter(StatefulProcessor):
    """Metering of one bucket of users.  Events wait in slices of event time, each with a
    timer at its end; when the watermark passes a slice, its events are metered in order,
    and the slice is forgotten.  A task holds one Arrow batch of input or one slice of a
    bucket at a time, however many events a micro-batch or the allowed lateness holds.  The
    state of a bucket is the balance and tier of its users and the slices that the watermark
    has not passed, in parts as they arrived; so calls to the state, which cost far more than
    the metering, are as many as buckets and slices, not as users."""

    def __init__(self, period: str, slice_us: int = SLICE_US):
        self.period, self.slice_us = period, slice_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", _BUCKET)
        self.pending = handle.getMapState("pending", _PART, _PENDING)

    def _read(self) -> tuple[int, dict[str, list]]:
        """(parts so far, name -> [period, reset, balance, service]) of the bucket."""
        if not self.bucket.exists():
            return 0, {}
        parts, users = self.bucket.get()
        name, *columns = (c.to_pylist() for c in _from_bytes(users).columns)
        return parts, dict(zip(name, map(list, zip(*columns, strict=True)), strict=True))

    def _write(self, parts: int, users: dict[str, list]) -> None:
        columns = [list(users), *([u[i] for u in users.values()] for i in range(4))]
        self.bucket.update((parts, _to_bytes(pa.table([pa.array(c, f.type) for c, f in zip(columns, _USERS, strict=True)],
                                                      schema=_USERS))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts, users = self._read()
        for pdf in rows:
            if not len(pdf):
                continue
            # A user as the static table has it, once; of a name without a user nothing is kept.
            known = pdf[pdf["found"].notna()].drop_duplicates("username")
            for name, tier, balance in zip(known["username"], known["tier0"], known["balance0"], strict=True):
                if name not in users:
                    users[name] = [None, None, None if pd.isna(balance) else int(balance), None if pd.isna(tier) else tier]
            us = pd.to_datetime(pdf["ts"]).to_numpy().astype("datetime64[us]").astype("int64")
            events = pa.Table.from_pandas(pdf.assign(us=us, found=pdf["username"].isin(users.keys())), schema=_EVENTS,
                                          preserve_index=False).replace_schema_metadata()
            number = us // self.slice_us
            for k in np.unique(number).tolist():
                self.handle.registerTimer(-(-((k + 1) * self.slice_us) // 1000))
                self.pending.updateValue((k, parts), (_to_bytes(events.filter(pa.array(number == k))),))
                parts += 1
        self._write(parts, users)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due: dict[int, list[int]] = {}
        for k, part in self.pending.keys():
            if (k + 1) * self.slice_us <= passed:
                due.setdefault(k, []).append(part)
        if not due:
            return
        parts, users = self._read()
        for k in sorted(due):  # timers fire in order; a slice is never overtaken
            held = pa.concat_tables([_from_bytes(self.pending.getValue((k, part))[0]) for part in sorted(due[k])])
            yield self._metered(held.to_pandas(), users)
            for part in due[k]:
                self.pending.removeKey((k, part))
        self._write(parts, users)

    def _metered(self, ev: pd.DataFrame, users: dict[str, list]) -> pd.DataFrame:
        out = ev[["event_id", "username", "kind"]].assign(period_start=pd.NaT, response_code=404, balance=None)
        own = ev[ev["found"]]
        code, names = pd.factorize(own["username"])
        us = own["us"].to_numpy()
        order = np.lexsort((own["event_id"].to_numpy(), us, code))  # stable: as they arrived
        service = [None if pd.isna(x) else x for x in own["service"].to_numpy()[order]]
        codes, balance, start = _meter_ordered(code[order], us[order], (own["kind"] == "topup").to_numpy()[order], service,
                                               [users[n] for n in names], self.period)
        start = pd.Series(pd.to_datetime(np.where(start >= 0, start, 0), unit="us")).where(start >= 0, pd.NaT)
        metered = own.iloc[order][["event_id", "username", "kind"]].reset_index(drop=True).assign(
            period_start=start, response_code=codes, balance=balance)
        other = out[~ev["found"]]
        return metered if not len(other) else other if not len(own) else pd.concat(
            [metered.astype({"balance": "object"}), other], ignore_index=True)

    def close(self) -> None:
        pass


def meter_stream_event_time(events_stream: DataFrame, users: DataFrame, period: str = "hour",
                            lateness: str = "1 hour", slice_us: int = SLICE_US,
                            buckets: int = METER_BUCKETS) -> DataFrame:
    """Streaming metering in event-time order (T3 with late data).

    Users are dealt into ``buckets`` by name, a state each; the number must stay the same
    as long as the stream's checkpoint.  Events wait there until the watermark (max event
    time minus ``lateness``) passes their slice, then are metered in (ts, event_id) order, so
    every emitted result equals the batch metering whatever the arrival
    order within ``lateness``.  Events later than that are dropped by the
    watermark; the newest ``lateness`` of the stream stays pending.  Kept per
    user are the balance and the tier in force (later resets need them) and what
    is pending; names without a user keep nothing.
    """
    ship_package(events_stream.sparkSession)  # workers import this module
    # (The frames that a processor gets lose names that begin with an underscore.)
    u = users.select("username", F.col("service").alias("tier0"),
                     F.col("calls_remaining").cast("long").alias("balance0"), F.lit(True).alias("found"))
    ev = events_stream if "service" in events_stream.columns else events_stream.withColumn(
        "service", F.lit(None).cast("string"))
    j = (ev.select("username", "event_id", "ts", "kind", "service").join(u, "username", "left")
         .withColumn("bucket", F.pmod(F.xxhash64("username"), F.lit(buckets)).cast("int"))
         .withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", lateness))
    return j.groupBy("bucket").transformWithStateInPandas(
        Meter(period, slice_us), METER_OUT, "append", "EventTime")
