"""The reference's own example-based cases, on its literal fixtures, set-based."""


from triagekit.operators import ingest, issues


def test_open_issues_with_comments(spark):
    # two open issues; comment fetch gives empty lists
    iss = spark.createDataFrame([(1, "Issue 1", "open"), (2, "Issue 2", "open")],
                                "id long, title string, state string")
    none = spark.createDataFrame([], "issue_id long, id long, body string")
    kept, dead = ingest.attach_children(iss, none)
    got = sorted((r["id"], r["comments"]) for r in kept.collect())
    assert got == [(1, []), (2, [])] and dead.count() == 0


def test_open_issues_error_gives_empty(spark):
    # a failed listing (404 / 401) is an empty source: no rows, no error
    empty = spark.createDataFrame([], "id long, repo_owner string, repo_name string, title string, "
                                      "issue_url string, state string")
    assert issues.open_issues_page(empty, page=1).count() == 0


def test_distinct_pairs_and_empty(spark):
    rows = [("owner1", "repo1"), ("owner2", "repo2"), ("owner3", "repo3"), ("owner1", "repo1")]
    df = spark.createDataFrame(rows, "repo_owner string, repo_name string")
    assert sorted(tuple(r) for r in issues.repo_pairs(df).collect()) == sorted(set(rows))
    assert issues.repo_pairs(df.limit(0)).count() == 0


def test_issue_comments_success_and_failure(spark):
    iss = spark.createDataFrame([(10,), (11,)], "id long")
    com = spark.createDataFrame([(10, 1, "Test comment 1"), (10, 2, "Test comment 2")],
                                "issue_id long, id long, body string")
    st = spark.createDataFrame([(11, False, True)], "issue_id long, comments_ok boolean, reactions_ok boolean")
    kept, dead = ingest.attach_children(iss, com, fetch_status=st)
    got = {r["id"]: [(c["id"], c["body"]) for c in r["comments"]] for r in kept.collect()}
    assert got == {10: [(1, "Test comment 1"), (2, "Test comment 2")]}
    assert [r["id"] for r in dead.collect()] == [11]


def test_issue_id_lookup_cases(spark):
    ids = [1647155662, 1669196666, 1665279685]
    iss = spark.createDataFrame(
        [(i, f"https://github.com/o{n}/r{n}/issues/{n}", f"title {n}", f"o{n}", f"r{n}", "closed")
         for n, i in enumerate(ids)],
        "id long, issue_url string, title string, repo_owner string, repo_name string, state string")
    lk = spark.createDataFrame([(i, None, None) for i in ids] + [(9999, None, None)],
                               "id long, owner string, repo string")
    got = {r["id"]: (r["issue_url"], r["title"]) for r in issues.lookup_closed(iss, lk).collect()}
    for n, i in enumerate(ids):
        assert got[i] == (f"https://github.com/o{n}/r{n}/issues/{n}", f"title {n}")
    assert got[9999] == (None, None)
    scoped = spark.createDataFrame([(ids[0], "o0", "r0"), (ids[0], "o1", None)],
                                   "id long, owner string, repo string")
    res = sorted((r["owner"], r["title"]) for r in issues.lookup_closed(iss, scoped).collect())
    assert res == [("o0", "title 0"), ("o1", None)]
