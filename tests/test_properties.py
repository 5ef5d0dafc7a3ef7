"""Property tests (hypothesis) for the closed forms the operators rely on."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from triagekit.operators import quota, upsert
from triagekit.operators.embed import chunk_sizes

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def _step(start, kinds, topup):
    bal, out = start, []
    for k in kinds:
        if k == "topup":
            bal += topup
            out.append((200, bal))
        elif bal > 0:
            bal -= 1
            out.append((200, bal))
        else:
            out.append((403, bal))
    return out


@SETTINGS
@given(kinds=st.lists(st.sampled_from(["call", "call", "call", "topup"]), min_size=1, max_size=60),
       service=st.sampled_from(["Free - (0$)", "Gold - (50$)", "Other"]),
       init=st.integers(min_value=0, max_value=12),
       chunk=st.sampled_from([60, 600, 3600]))
def test_clipped_balance_matches_simulation(spark, kinds, service, init, chunk):
    t0 = dt.datetime(2024, 1, 1, 10)
    ev = spark.createDataFrame(
        [(i, "u", t0 + dt.timedelta(seconds=37 * i), k, service if k == "topup" else None)
         for i, k in enumerate(kinds)],
        "event_id long, username string, ts timestamp_ntz, kind string, service string")
    us = spark.createDataFrame([("u", service, init)], "username string, service string, calls_remaining int")
    got = [(r["response_code"], r["balance"]) for r in
           quota.meter_calls(ev, us, period="day", chunk_seconds=chunk).orderBy("event_id").collect()]
    tier = quota.TIER_ALLOWANCE.get(service)
    want = _step(tier if tier is not None else init, kinds, tier or 0)
    assert got == want
    assert all(b >= 0 for _, b in got)


@SETTINGS
@given(ns=st.lists(st.integers(min_value=0, max_value=1600), min_size=1, max_size=6))
def test_chunk_lengths_sum_to_token_count(spark, ns):
    docs = spark.createDataFrame([(i, " ".join(["t"] * n)) for i, n in enumerate(ns)],
                                 "doc_id long, text string")
    got = {}
    for r in chunk_sizes(docs).collect():
        got.setdefault(r["id"], []).append(r["n_tokens"])
    for i, n in enumerate(ns):
        assert sum(got.get(i, [])) == n
        assert all(0 < c <= 512 for c in got.get(i, []))


@SETTINGS
@given(target=st.lists(st.tuples(st.integers(0, 20), st.integers(0, 5)), max_size=15),
       batch=st.lists(st.tuples(st.integers(0, 20), st.integers(0, 5)), max_size=15))
def test_upsert_idempotent_and_keyed(spark, target, batch):
    schema = "id long, v long"
    t = spark.createDataFrame(list({k: (k, v) for k, v in target}.values()), schema)
    b = spark.createDataFrame(batch, schema)
    once = upsert.merge_by_key(t, b, ["id"], order=["v"])
    twice = upsert.merge_by_key(once, b, ["id"], order=["v"])
    a = sorted(tuple(r) for r in once.collect())
    assert a == sorted(tuple(r) for r in twice.collect())
    ids = [r[0] for r in a]
    assert len(ids) == len(set(ids)) == len({k for k, _ in target} | {k for k, _ in batch})
    for k in {k for k, _ in batch}:
        assert dict(a)[k] == max(v for kk, v in batch if kk == k)
