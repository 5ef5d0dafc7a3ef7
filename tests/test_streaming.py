"""Streams give the batch results (T1–T3)."""

import os

from pyspark.sql import functions as F

from triagekit.operators import activity, quota
from triagekit.operators.ingest import flatten_issues
from triagekit.sources import fixtures as fx
from triagekit.streaming import jobs
from conftest import SF_SMALL


def test_stream_requests_per_user_day(spark, tmp_dir):
    logs = fx.logs_fx(spark, SF_SMALL)
    src = os.path.join(tmp_dir, "logs")
    logs.write.parquet(src)
    stream = spark.readStream.schema(logs.schema).parquet(src)
    want = sorted(tuple(r) for r in activity.requests_by_user_date(logs).collect())
    # complete mode: every window, equal to the batch aggregate
    jobs.memory_sink(jobs.requests_per_user_day(stream), "t2_all", os.path.join(tmp_dir, "ck1"),
                     mode="complete")
    got = sorted(tuple(r) for r in spark.sql("SELECT username, date, count FROM t2_all").collect())
    assert got == want
    # append mode: only windows closed by the watermark are emitted, each final
    jobs.memory_sink(jobs.requests_per_user_day(stream), "t2_app", os.path.join(tmp_dir, "ck2"))
    app = sorted(tuple(r) for r in spark.sql("SELECT username, date, count FROM t2_app").collect())
    assert app and set(app) <= set(want)


def test_stream_ingest_equals_batch(spark, tmp_dir):
    raw = fx.raw_issues_fx(spark, SF_SMALL)
    landed = os.path.join(tmp_dir, "landed")
    raw.write.json(landed)
    root, ck = os.path.join(tmp_dir, "issues"), os.path.join(tmp_dir, "ck")
    q = jobs.stream_ingest(spark, landed, root, ck)
    q.awaitTermination()
    latest = jobs.latest_version(spark, root)
    got = jobs.read_snapshot(spark, root)
    want = flatten_issues(raw)
    assert got.columns == want.columns  # all 15 columns, comments map and reactions kept
    key = lambda r: r["id"]
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    # replaying the same files is a no-op: no new snapshot
    q2 = jobs.stream_ingest(spark, landed, root, ck)
    q2.awaitTermination()
    assert jobs.latest_version(spark, root) == latest


def test_stream_ingest_keeps_newer_rows(spark, tmp_dir):
    """A replay of older versions must not overwrite newer stored rows."""
    raw = fx.raw_issues_fx(spark, SF_SMALL)
    newer = raw.withColumn("title", F.lit("new")).withColumn("updated_at", F.lit("2030-01-01T00:00:00Z"))
    landed = os.path.join(tmp_dir, "landed")
    newer.write.json(os.path.join(landed, "b1"))
    root, ck = os.path.join(tmp_dir, "issues"), os.path.join(tmp_dir, "ck")
    src = os.path.join(landed, "*")
    jobs.stream_ingest(spark, src, root, ck).awaitTermination()
    raw.write.json(os.path.join(landed, "b2"))  # stale versions arrive later
    jobs.stream_ingest(spark, src, root, ck).awaitTermination()
    got = jobs.read_snapshot(spark, root)
    assert got.count() == raw.count()
    assert {r["title"] for r in got.select("title").distinct().collect()} == {"new"}


def test_stream_counts_with_late_data(spark, tmp_dir):
    """Files arrive out of event-time order (each spans the whole month)."""
    logs = fx.logs_fx(spark, SF_SMALL)
    src = os.path.join(tmp_dir, "logs")
    for b in range(3):  # a shuffled copy: later files carry older events
        logs.where(F.col("id") % 3 == b).write.parquet(os.path.join(src, f"f{b}"))
    stream = (spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1)
              .parquet(os.path.join(src, "*")))
    jobs.memory_sink(jobs.requests_per_user_day(stream), "t2_late", os.path.join(tmp_dir, "ck"),
                     mode="complete")
    got = sorted(tuple(r) for r in spark.sql("SELECT username, date, count FROM t2_late").collect())
    assert got == sorted(tuple(r) for r in activity.requests_by_user_date(logs).collect())


def test_stream_metering_event_time_with_late_arrivals(spark, tmp_dir):
    """Events arrive up to a day late; emitted results equal the batch metering."""
    ev = fx.metered_events_fx(spark, SF_SMALL, True)
    users = fx.users_fx(spark, SF_SMALL)
    day = F.dayofmonth("ts")
    # arrival batch: 3-day windows, odd events delayed by one day (late data)
    arrive = ((day + (F.col("event_id") % 2)) / 3).cast("int")
    src = os.path.join(tmp_dir, "events")
    staged = ev.withColumn("_a", arrive)
    for a in sorted(r[0] for r in staged.select("_a").distinct().collect()):
        staged.where(F.col("_a") == a).drop("_a").write.parquet(os.path.join(src, f"a{a:03d}"))
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
              .parquet(os.path.join(src, "*")))
    out = jobs.meter_stream_event_time(stream, users, period="week", lateness="2 days")
    jobs.memory_sink(out, "t3_et", os.path.join(tmp_dir, "ck"))
    got = {r["event_id"]: (r["response_code"], r["balance"]) for r in spark.sql("SELECT * FROM t3_et").collect()}
    want = {r["event_id"]: (r["response_code"], r["balance"])
            for r in quota.meter_calls(ev, users, period="week").collect()}
    assert len(got) > 0.7 * len(want)  # the newest ~2 days stay pending
    assert all(want[k] == v for k, v in got.items())


def test_stream_ingest_maintains_marks(spark, tmp_dir):
    raw = fx.raw_issues_fx(spark, SF_SMALL)
    landed = os.path.join(tmp_dir, "landed")
    raw.where("id < 100").write.json(os.path.join(landed, "b1"))
    root, ck = os.path.join(tmp_dir, "issues"), os.path.join(tmp_dir, "ck")
    src = os.path.join(landed, "*")
    jobs.stream_ingest(spark, src, root, ck).awaitTermination()
    raw.where("id >= 100").write.json(os.path.join(landed, "b2"))
    jobs.stream_ingest(spark, src, root, ck).awaitTermination()
    snap = jobs.read_snapshot(spark, root)
    marks = jobs.read_marks(spark, root)
    from triagekit.operators.issues import high_water
    assert snap.count() == raw.count()
    assert sorted(tuple(r) for r in marks.collect()) == sorted(tuple(r) for r in high_water(snap).collect())


def test_stream_upsert_rewrites_touched_buckets_only(spark, tmp_dir):
    raw = fx.raw_issues_fx(spark, SF_SMALL)
    root = os.path.join(tmp_dir, "issues")
    run = jobs.upsert_batch_into_snapshots(root)
    run(raw, 0)
    before = jobs._manifest(spark, root, jobs.latest_version(spark, root))
    later = raw.where("id in (3, 8)").withColumn("updated_at", F.lit("2030-01-01T00:00:00Z")).withColumn("title", F.lit("new"))
    run(later, 1)
    after = jobs._manifest(spark, root, jobs.latest_version(spark, root))
    touched = {r[0] for r in spark.sql("select pmod(xxhash64(id), 64) from values (3L), (8L) t(id)").collect()}
    assert {b for b in after if after[b] != before.get(b)} == touched
    snap = {r["id"]: r["title"] for r in jobs.read_snapshot(spark, root).collect()}
    assert snap[3] == snap[8] == "new" and len(snap) == raw.count()
    run(later, 1)  # replay: nothing changes
    assert jobs._manifest(spark, root, jobs.latest_version(spark, root)) == after


def test_stream_ingest_side_output_and_ties(spark, tmp_dir):
    """What cannot be merged ends in the dead letter; of one time the later arrival wins;
    both are committed together."""
    import json
    landed = os.path.join(tmp_dir, "landed")
    root, ck = os.path.join(tmp_dir, "issues"), os.path.join(tmp_dir, "ck")

    def land(name, rows):
        os.makedirs(landed, exist_ok=True)
        with open(os.path.join(landed, name), "w") as f:
            f.write("\n".join(r if isinstance(r, str) else json.dumps(
                {"repo_owner": "o", "repo_name": "r", "body": "b", "state": "open", **r}) for r in rows) + "\n")

    day = "2024-01-0{}T00:00:00Z".format
    land("a.json", [{"id": 1, "title": "first", "updated_at": day(1)}, {"id": 1, "title": "second", "updated_at": day(1)},
                    {"id": 2, "title": "x", "updated_at": "soon"}, {"id": 5, "title": "five", "updated_at": day(2), "ordinal": 9},
                    {"id": 5, "title": "earlier", "updated_at": day(2), "ordinal": 3}, "{not json", {"title": "no id"}])
    jobs.stream_ingest(spark, landed, root, ck).awaitTermination()
    table = {r["id"]: r["title"] for r in jobs.read_snapshot(spark, root).collect()}
    assert table == {1: "second", 5: "five"}
    dead = sorted((r["reason"], r["id"] or 0, r["epoch"]) for r in jobs.read_dead_letter(spark, root).collect())
    assert dead == [("malformed document", 0, 0), ("no id", 0, 0), ("unreadable time", 2, 0)]
    assert "{not json" in {r["document"] for r in jobs.read_dead_letter(spark, root).collect()}
    # Marks exist now: still nothing vanishes, and an epoch of dead letters alone commits too.
    land("b.json", [{"id": 3, "title": "y", "updated_at": None}])
    jobs.stream_ingest(spark, landed, root, ck).awaitTermination()
    assert {r["id"]: r["title"] for r in jobs.read_snapshot(spark, root).collect()} == table
    assert [(r["id"], r["epoch"]) for r in jobs.read_dead_letter(spark, root).where("epoch = 1").collect()] == [(3, 1)]
    # An epoch that ended before its manifest counts for nothing and runs again whole.
    run = jobs.upsert_batch_into_snapshots(root)
    batch = spark.read.schema(jobs.LANDED).json(os.path.join(landed, "b.json"))
    jobs.dead_letter(batch.unionByName(batch), 2).write.parquet(f"{root}/dead/v000000003")
    assert jobs.read_dead_letter(spark, root).count() == 4
    run(batch, 2)
    assert jobs.read_dead_letter(spark, root).where("epoch = 2").count() == 1


def test_updates_sink_replays_an_epoch(spark, tmp_dir):
    logs = fx.logs_fx(spark, SF_SMALL)
    src, root = os.path.join(tmp_dir, "logs"), os.path.join(tmp_dir, "counts")
    for b in range(3):
        logs.where(F.col("id") % 3 == b).write.parquet(os.path.join(src, f"f{b}"))
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
    jobs.updates_sink(jobs.requests_per_user_day(stream, "40 days"), root, os.path.join(tmp_dir, "ck"))
    want = sorted(tuple(r) for r in activity.requests_by_user_date(logs).collect())
    got = jobs.read_updates(spark, root, ["username", "date"])
    assert sorted(tuple(r) for r in got.collect()) == want


def test_stream_metering_of_a_hot_user(spark, tmp_dir):
    """One user holds a third of the events, many in one minute, arriving in any order:
    the stream gives the batch result, and state holds only what is pending."""
    import datetime as dt
    rows = []
    for i in range(900):
        hot = i % 3 == 0
        ts = dt.datetime(2024, 1, 1, i // 150, (7 if hot else i % 60), 0, i * 1000)
        rows.append((i, "hot" if hot else f"u{i % 40}" if i % 50 else "ghost", ts,
                     "topup" if i % 90 == 0 else "call", "Platinum - (100$)" if i % 90 == 0 else None))
    rows.append((5000, "late", dt.datetime(2024, 1, 9), "call", None))  # moves the watermark
    ev = spark.createDataFrame(rows, "event_id long, username string, ts timestamp_ntz, kind string, service string")
    users = spark.createDataFrame([("hot", "Free - (0$)", 4), *[(f"u{i}", "Gold - (50$)", 0) for i in range(40)]],
                                  "username string, service string, calls_remaining int")
    src = os.path.join(tmp_dir, "events")
    for b in range(3):  # each file spans the whole time
        ev.where((F.col("event_id") * 7 % 3 == b) & (F.col("event_id") < 5000)).coalesce(1).write.parquet(os.path.join(src, f"a{b}"))
    ev.where("event_id = 5000").coalesce(1).write.parquet(os.path.join(src, "b"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
    out = jobs.meter_stream_event_time(stream, users, lateness="1 day")
    q = jobs.memory_sink(out, "t3_hot", os.path.join(tmp_dir, "ck"))
    got = {r["event_id"]: (r["response_code"], r["balance"], r["period_start"]) for r in spark.sql("SELECT * FROM t3_hot").collect()}
    want = {r["event_id"]: (r["response_code"], r["balance"], r["period_start"]) for r in quota.meter_calls(ev, users).collect()}
    want.pop(5000)  # newer than the watermark: pending
    assert got == want
    state = spark.read.format("statestore").option("path", os.path.join(tmp_dir, "ck")).option(
        "stateVarName", "pending").load()
    assert state.count() == 1  # the one slice that is pending


def test_stream_metering_holds_users_by_bucket(spark, tmp_dir):
    """State is kept per bucket of users, not per user: events of many users, of names
    without a user and without a name, in two arrivals, give the batch result."""
    import datetime as dt
    tiers = ["Free - (0$)", "Gold - (50$)", "Platinum - (100$)", "Other", None]
    rows = [(i, None if i % 97 == 0 else f"ghost{i % 7}" if i % 31 == 0 else f"u{i % 150}",
             dt.datetime(2024, 1, 1 + i * 13 % 20, i % 24), "topup" if i % 5 == 0 else "call",
             tiers[i % 3] if i % 5 == 0 else None) for i in range(1500)]
    end = (5000, "end", dt.datetime(2025, 1, 1), "call", None)  # moves the watermark
    schema = "event_id long, username string, ts timestamp_ntz, kind string, service string"
    ev = spark.createDataFrame(rows, schema)
    users = spark.createDataFrame([(f"u{i}", tiers[i % 5], i % 4 if i % 9 else None) for i in range(150)],
                                  "username string, service string, calls_remaining int")
    src = os.path.join(tmp_dir, "events")
    for b in range(2):
        ev.where(F.col("event_id") % 2 == b).coalesce(1).write.parquet(os.path.join(src, f"a{b}"))
    spark.createDataFrame([end], schema).coalesce(1).write.parquet(os.path.join(src, "b"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
    out = jobs.meter_stream_event_time(stream, users, period="week", lateness="60 days", slice_us=86_400_000_000, buckets=4)
    jobs.memory_sink(out, "t3_buckets", os.path.join(tmp_dir, "ck"))
    columns = ["event_id", "username", "kind", "period_start", "response_code", "balance"]
    key = lambda r: r["event_id"]
    got = sorted(spark.table("t3_buckets").select(columns).collect(), key=key)
    want = sorted(quota.meter_calls(ev, users, period="week").select(columns).collect(), key=key)
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    state = spark.read.format("statestore").option("path", os.path.join(tmp_dir, "ck")).option("stateVarName", "bucket").load()
    assert 0 < state.count() <= 4
