"""Registry of named queries: key -> fn(spark, tables_dir) -> DataFrame.

Each entry wires an operator of :mod:`triagekit.operators` to the fixture
adapters over the whole driver tables.  Parameters are fixed here once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vocabulary
from ..session import checkpoint_dir, maybe_broadcast
from ..sources import fixtures as fx
from ..sources.tables import read_table

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}

# Fixture parameters (FIXTURES.md): k below the corpus size so the cut
# matters, threshold 30 so results are not only self-matches.
KNN_K = 100
SEARCH_K = 100  # below the corpus at every scale, so the cut is in force
SEARCH_THRESHOLD = 30.0
# The service's own threshold, used by the search-else-solve flow.
SERVICE_THRESHOLD = 90.0


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- vectors
@register("knn_l2")
def q_knn_l2(spark, base):
    from ..operators.knn import knn_l2
    hits = knn_l2(fx.vectors_fx(spark, base), fx.query_vectors_fx(spark, base), KNN_K)
    return hits.select("query_id", "pk", "distance", F.col("rank").cast("bigint").alias("rank"))


def _scoped_queries(spark, base):
    q = fx.search_queries_fx(spark, base)
    scope = fx.issues_fx(spark, base).select(
        F.col("id").alias("query_id"), F.col("repo_owner").alias("owner"),
        F.col("repo_name").alias("repo"))
    return q.join(scope, "query_id", "left")


def _matches(spark, base, scoped=False, threshold=SEARCH_THRESHOLD):
    from ..operators.similarity import similar_issues
    q = _scoped_queries(spark, base) if scoped else fx.search_queries_fx(spark, base)
    return similar_issues(fx.search_vectors_fx(spark, base), q, fx.issues_fx(spark, base),
                          k=SEARCH_K, threshold=threshold, scoped=scoped)


@register("similar_issues")
def q_similar_issues(spark, base):
    return _matches(spark, base)


@register("similar_issues_scoped")
def q_similar_issues_scoped(spark, base):
    return _matches(spark, base, scoped=True)


@register("match_lines")
def q_match_lines(spark, base):
    from ..operators.similarity import match_lines
    return match_lines(_matches(spark, base))


@register("unmatched_queries")
def q_unmatched_queries(spark, base):
    from ..operators.similarity import unmatched_queries
    return unmatched_queries(fx.search_queries_fx(spark, base).select("query_id"),
                             _matches(spark, base, threshold=SERVICE_THRESHOLD))


@register("search_activity")
def q_search_activity(spark, base):
    from ..operators.similarity import search_activity
    return search_activity(fx.search_queries_fx(spark, base),
                           _matches(spark, base, threshold=SERVICE_THRESHOLD))


# --------------------------------------------------------------- activity
AS_OF = "2024-01-30"
ADMINS = ["admin"]
MASK_SALT = "triagekit-salt"


@register("requests_by_user_date")
def q_requests_by_user_date(spark, base):
    from ..operators.activity import requests_by_user_date
    return requests_by_user_date(fx.logs_fx(spark, base))


@register("status_counts")
def q_status_counts(spark, base):
    from ..operators.activity import status_counts
    return status_counts(fx.logs_fx(spark, base))


@register("endpoint_counts")
def q_endpoint_counts(spark, base):
    from ..operators.activity import endpoint_counts
    return endpoint_counts(fx.logs_fx(spark, base))


@register("call_metrics")
def q_call_metrics(spark, base):
    from ..operators.activity import call_metrics
    return call_metrics(fx.logs_fx(spark, base), AS_OF)


@register("activity_visible")
def q_activity_visible(spark, base):
    from ..operators.activity import visible_activity
    viewers = fx.users_fx(spark, base).select(F.col("username").alias("viewer"))
    logs = fx.logs_fx(spark, base).select("id", "username", "api_endpoint", "response_code", "timestamp")
    return visible_activity(logs, viewers, ADMINS)


def _upgrade_outcomes(spark, base):
    from ..operators.users import update_subscriptions
    return update_subscriptions(fx.users_fx(spark, base), fx.upgrades_fx(spark, base))


@register("activity_append")
def q_activity_append(spark, base):
    from ..operators.activity import append_activity
    rows = _upgrade_outcomes(spark, base).select(
        "username", F.lit("PUT").alias("request_type"),
        F.lit("update_subscription").alias("api_endpoint"),
        F.col("response_code").cast("string").alias("response_code"),
        "description", F.col("ts").alias("timestamp"), F.col("event_id").alias("ordinal"))
    return append_activity(fx.logs_fx(spark, base), rows)


# ------------------------------------------------------------ quota/users
@register("quota_metering")
def q_quota_metering(spark, base):
    from ..operators.quota import meter_calls
    return meter_calls(fx.metered_events_fx(spark, base, False), fx.users_fx(spark, base),
                       period="week")


@register("quota_topup")
def q_quota_topup(spark, base):
    from ..operators.quota import meter_calls
    return meter_calls(fx.metered_events_fx(spark, base, True), fx.users_fx(spark, base),
                       period="week")


@register("quota_reset")
def q_quota_reset(spark, base):
    from ..operators.quota import reset_allowance
    return reset_allowance(fx.users_fx(spark, base)).select("username", "service", "calls_remaining")


@register("remaining_calls")
def q_remaining_calls(spark, base):
    from ..operators.quota import low_balance_flag
    users = fx.users_fx(spark, base).select("username", "calls_remaining")
    r = fx.active_usernames_fx(spark, base).join(users, "username", "left")
    return r.select("username", "calls_remaining",
                    low_balance_flag(F.col("calls_remaining")).alias("balance_flag"))


@register("signup_validation")
def q_signup_validation(spark, base):
    from ..operators.users import validate_signups
    v = validate_signups(fx.signups_fx(spark, base))
    return v.select("ordinal", "username", F.size("errors").cast("bigint").alias("n_errors"),
                    F.array_join("errors", "; ").alias("errors"))


@register("user_signup")
def q_user_signup(spark, base):
    from ..operators.users import signup
    existing = fx.users_fx(spark, base).join(fx.active_usernames_fx(spark, base), "username", "left_semi")
    out = signup(existing, fx.signups_fx(spark, base))
    return out.select("ordinal", "username", "response_code")


@register("user_update")
def q_user_update(spark, base):
    return _upgrade_outcomes(spark, base).drop("ts")


@register("password_update")
def q_password_update(spark, base):
    from ..operators.users import update_passwords
    return update_passwords(fx.users_fx(spark, base), fx.password_changes_fx(spark, base))


@register("users_after_updates")
def q_users_after_updates(spark, base):
    """The user table after all upgrades and password changes."""
    from ..operators.users import users_after_updates
    return users_after_updates(fx.users_fx(spark, base), fx.upgrades_fx(spark, base),
                               fx.password_changes_fx(spark, base), _row_salt())


def _row_salt():
    """A salt per row: a deployment's own text and the user's name."""
    return F.concat(F.lit(MASK_SALT + ":"), F.col("username"))


@register("mask_sensitive")
def q_mask_sensitive(spark, base):
    from ..operators.users import mask_sensitive
    return mask_sensitive(fx.users_fx(spark, base), _row_salt()).select("username", "password", "service")


# ------------------------------------------------------------ text, links
def _pages_text(spark, base):
    p = read_table(spark, base, "pages")
    return p.select(
        "page_id", "url", "html",
        F.concat(F.lit("see "), F.col("url"), F.lit(" and "), F.col("html"), F.lit(" end")).alias("text"),
        F.concat(F.lit('<p><img width="3" src="'), F.col("url"), F.lit('"><img alt="no-src">'),
                 F.lit('<img src="">'), F.lit('<img src="'), F.col("url"),
                 F.lit('#2" data-x="1" src="second"></p>'), F.col("html"), F.lit('<img src="open"')).alias("body"))


@register("strip_urls")
def q_strip_urls(spark, base):
    from ..functions.text import strip_urls
    return _pages_text(spark, base).select("page_id", strip_urls("text").alias("text"))


@register("rewrite_images")
def q_rewrite_images(spark, base):
    from ..functions.text import rewrite_images
    return _pages_text(spark, base).select("page_id", rewrite_images("body").alias("body"))


@register("image_urls")
def q_image_urls(spark, base):
    from ..functions.text import image_urls
    return _pages_text(spark, base).select(
        "page_id", F.posexplode(image_urls("body")).alias("pos", "image_url")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "image_url")


def _links(spark, base):
    d = read_table(spark, base, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("link_id"),
        F.concat(F.lit("https://github.com/"), "source", F.lit("/"), "lang").alias("link"))
    p = read_table(spark, base, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("link_id"),
        F.col("url").alias("link"))
    return d.unionByName(p)


@register("repo_link_parse")
def q_repo_link_parse(spark, base):
    from ..functions.text import repo_name_from_link, repo_owner_from_link
    return _links(spark, base).select(
        "link_id", repo_owner_from_link("link").alias("repo_owner"),
        repo_name_from_link("link").alias("repo_name"))


@register("repo_register")
def q_repo_register(spark, base):
    from ..functions.text import repo_name_from_link, repo_owner_from_link
    from ..operators.upsert import register_repos
    req = _links(spark, base).select(repo_owner_from_link("link").alias("repo_owner"),
                                     repo_name_from_link("link").alias("repo_name"))
    docs = read_table(spark, base, "documents")
    labelled = docs.join(read_table(spark, base, "labels").select("doc_id"), "doc_id", "left_semi")
    registry = labelled.select(F.col("source").alias("repo_owner"), F.col("lang").alias("repo_name"))
    ins, present = register_repos(registry, req)
    return (ins.withColumn("outcome", F.lit("inserted"))
            .unionByName(present.withColumn("outcome", F.lit("exists"))))


# ----------------------------------------------------------------- issues
@register("issue_lookup")
def q_issue_lookup(spark, base):
    from ..operators.issues import lookup_closed
    # Scoped to the right owner and repository, to the right and the wrong owner, to the
    # empty name (no scope), and not at all.
    m = F.col("id") % 5
    scope = fx.issues_fx(spark, base).select("id", "repo_owner", "repo_name")
    lookups = read_table(spark, base, "labels").select(F.col("doc_id").alias("id")).join(scope, "id", "left").select(
        "id", F.when(m <= 1, F.col("repo_owner")).when(m == 2, "nobody").when(m == 3, "").alias("owner"),
        F.when(m == 0, F.col("repo_name")).when(m == 3, "").alias("repo"))
    return lookup_closed(fx.issues_fx(spark, base), lookups).select("id", "issue_url", "title")


@register("open_issues_page")
def q_open_issues_page(spark, base):
    from ..operators.issues import open_issues_page
    return open_issues_page(fx.issues_fx(spark, base), page=2).withColumn(
        "rank", F.col("rank").cast("bigint"))


@register("repo_pairs")
def q_repo_pairs(spark, base):
    from ..operators.issues import repo_pairs
    return repo_pairs(fx.issues_fx(spark, base))


@register("owner_repos")
def q_owner_repos(spark, base):
    from ..operators.issues import owner_repos
    return owner_repos(fx.issues_fx(spark, base)).select(
        "repo_owner", F.array_join("repos", ", ").alias("repos"))


@register("high_water")
def q_high_water(spark, base):
    from ..operators.issues import high_water
    return high_water(fx.issues_fx(spark, base))


# ---------------------------------------------------------------- quality
@register("dq_extract")
def q_dq_extract(spark, base):
    from ..operators.quality import dq_extract
    return dq_extract(fx.issues_fx(spark, base))


@register("dq_suite")
def q_dq_suite(spark, base):
    from ..operators.quality import dq_extract, run_suite
    return run_suite(dq_extract(fx.issues_fx(spark, base)))


DQ_UNIQUE_COLUMNS = ["ID", "ISSUE_URL", "TITLE", "BODY"]


@register("dq_unique")
def q_dq_unique(spark, base):
    from ..operators.quality import dq_extract, unique_results
    return unique_results(dq_extract(fx.issues_fx(spark, base)), DQ_UNIQUE_COLUMNS).select(
        "column", "success", "element_count", "unexpected_count")


@register("dq_not_null")
def q_dq_not_null(spark, base):
    """Not-null over the issue columns after the left join to label names."""
    from ..operators.quality import not_null_results
    labels = fx.label_names_fx(spark, base).groupBy("issue_id").agg(
        F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("labels"))
    t = fx.issues_fx(spark, base).join(labels, F.col("id") == F.col("issue_id"), "left")
    return not_null_results(t, ["id", "issue_url", "title", "body", "labels"]).select(
        "column", "success", "element_count", "unexpected_count")


# ------------------------------------------------------- tokens, embedding
EMBED_DIM = 64


@register("tokenize")
def q_tokenize(spark, base):
    from ..functions.tokens import clean_tokens
    from ..session import spread
    d = spread(read_table(spark, base, "documents").select("doc_id", "text")).select(
        "doc_id", clean_tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"),
                    F.array_join("t", " ").alias("tokens"))


def _encoded(spark, base):
    arrays = vocabulary.token_arrays(read_table(spark, base, "documents"))
    return vocabulary.encode_arrays(arrays, vocabulary.build_vocabulary(arrays))


@register("vocab_encode")
def q_vocab_encode(spark, base):
    enc = vocabulary.encoded_rows(_encoded(spark, base))
    return enc.select(F.col("id").alias("doc_id"), F.col("pos").cast("bigint").alias("pos"), "token_id")


@register("chunk_tokens")
def q_chunk_tokens(spark, base):
    from ..operators.embed import chunk_sizes
    c = chunk_sizes(read_table(spark, base, "documents"))
    return c.select(F.col("id").alias("doc_id"), F.col("chunk_no").cast("bigint").alias("chunk_no"),
                    "n_tokens")


@register("embed_bag")
def q_embed_bag(spark, base):
    from ..operators.embed import chunk_bag_weights
    w = chunk_bag_weights(read_table(spark, base, "documents"), EMBED_DIM, fixed_point=True)
    return w.select(F.col("id").alias("doc_id"), F.col("chunk_no").cast("bigint").alias("chunk_no"),
                    F.col("bucket").cast("bigint").alias("bucket"), "weight")


@register("chunk_mean_pool")
def q_chunk_mean_pool(spark, base):
    from ..operators.embed import pooled_rows
    p = pooled_rows(read_table(spark, base, "documents"), EMBED_DIM, fixed_point=True)
    return p.select(F.col("id").alias("doc_id"), F.col("bucket").cast("bigint").alias("bucket"), "value")


MODEL_DIM = 16


@register("model_embeddings")
def q_model_embeddings(spark, base):
    """Documents through a model: tokens, vocabulary ids, chunks, vectors, their mean."""
    from ..operators.embed import document_vectors, linear_model
    v = document_vectors(read_table(spark, base, "documents"), linear_model(MODEL_DIM), MODEL_DIM)
    # The chunk vectors are whole numbers: their sum is exact again.
    mean = F.transform("vector", lambda x: F.floor(F.round(x * F.greatest("n_chunks", F.lit(1))) / F.greatest("n_chunks", F.lit(1))))
    return v.select(F.col("id").alias("doc_id"), "n_chunks", F.array_join(mean, ",").alias("vector"))


@register("issue_embeddings")
def q_issue_embeddings(spark, base):
    from ..operators.embed import issue_embeddings
    e = issue_embeddings(fx.issues_fx(spark, base), EMBED_DIM, id_col="id", text_col="body",
                         fixed_point=True)
    return e.select("id", "n_chunks", F.array_join("vector", ",").alias("vector"))


# ------------------------------------------------------- ingest, comments
def _flat(spark, base):
    from ..operators.ingest import flatten_issues
    return flatten_issues(fx.raw_issues_fx(spark, base))


@register("issue_flatten")
def q_issue_flatten(spark, base):
    from ..operators.ingest import endpoint_of
    f = endpoint_of(_flat(spark, base))
    return f.select("id", "issue_url", "repo_owner", "repo_name", "issue_number", "created_by",
                    "title", "body", F.size("comments").cast("bigint").alias("n_comments"),
                    F.size("reactions").cast("bigint").alias("n_reactions"),
                    F.to_json("reactions").alias("reactions_json"),
                    "assignees", "labels", "milestone", "state", "updated_at", "endpoint")


@register("comments_map")
def q_comments_map(spark, base):
    return _flat(spark, base).select("id", F.explode("comments").alias("comment_key", "body"))


@register("comments_json")
def q_comments_json(spark, base):
    """Comments map encoded as JSON text and decoded back (value round trip)."""
    j = _flat(spark, base).select("id", F.to_json("comments").alias("comments_json"))
    back = j.select("id", F.from_json("comments_json", "map<string,string>").alias("m"))
    return back.select("id", F.explode("m").alias("comment_key", "body"))


@register("labels_joined")
def q_labels_joined(spark, base):
    return _flat(spark, base).select("id", "labels")


@register("open_issues_comments")
def q_open_issues_comments(spark, base):
    from ..operators.ingest import attach_children
    issues = fx.issues_fx(spark, base).where(F.col("state") == "open").select("id", "title")
    com = fx.comments_fx(spark, base).select("issue_id", F.col("comment_id").alias("id"), "body")
    kept, _ = attach_children(issues, com)
    return kept.select("id", "title", F.explode_outer("comments").alias("c")).select(
        "id", "title", F.col("c.id").alias("comment_id"), F.col("c.body").alias("body"))


def _incremental(spark, base):
    from ..operators.ingest import select_incremental
    return select_incremental(fx.issues_fx(spark, base), fx.landed_updates_fx(spark, base))


@register("ingest_incremental")
def q_ingest_incremental(spark, base):
    return _incremental(spark, base).select("id", "turn", "title", "state", "updated_at")


@register("issue_upsert")
def q_issue_upsert(spark, base):
    from ..operators.upsert import merge_by_key
    target = fx.issues_fx(spark, base)
    merged = merge_by_key(target, _incremental(spark, base), ["id"], order=["updated_at", "turn"])
    return merged.select("id", "title", "state", "updated_at")


# ---------------------------------------------------------- vector index
@register("ivf_assign")
def q_ivf_assign(spark, base):
    from ..operators.ivf import assign_cells, label_centroids
    emb = read_table(spark, base, "embeddings").select(
        F.col("vec_id").alias("pk"), F.col("embedding").alias("embeddings"), "label")
    return assign_cells(emb, label_centroids(emb, "label")).select("pk", "cell")


def _reembedded_ids(spark, base):
    c = read_table(spark, base, "conversations").select(F.col("conv_id").alias("id"))
    return fx.issues_fx(spark, base).join(c, "id", "left_semi")


@register("vectors_existing")
def q_vectors_existing(spark, base):
    batch = _reembedded_ids(spark, base).select(F.col("id").alias("pk"))
    return fx.vectors_fx(spark, base).join(batch, "pk", "left_semi").select("pk")


@register("vector_upsert")
def q_vector_upsert(spark, base):
    from ..operators.embed import issue_embeddings
    from ..operators.upsert import merge_by_key
    docs = _reembedded_ids(spark, base)
    new = issue_embeddings(docs, EMBED_DIM, id_col="id", text_col="body").select(
        F.col("id").alias("pk"), F.col("vector").cast("array<float>").alias("embeddings"))
    target = fx.vectors_fx(spark, base)
    merged = merge_by_key(target.withColumn("origin", F.lit("target")),
                          new.withColumn("origin", F.lit("batch")), ["pk"])
    value = F.transform("embeddings", lambda x: F.floor(x.cast("double") * 1e4 + 0.5).cast("bigint"))
    return merged.select("pk", "origin", F.size("embeddings").cast("bigint").alias("dim"),
                         F.array_join(value, ",").alias("values"))


# ---------------------------------------------------------------- prompts
@register("prompts_rendered")
def q_prompts_rendered(spark, base):
    from ..operators.prompts import solution_prompt
    from ..operators.similarity import unmatched_queries
    q = fx.search_queries_fx(spark, base).select("query_id")
    un = unmatched_queries(q, _matches(spark, base, threshold=SERVICE_THRESHOLD))
    un = maybe_broadcast(un, materialize=True)  # so that bodies are scanned, not shuffled
    body = fx.issues_fx(spark, base).select(F.col("id").alias("query_id"), "body")
    return un.join(body, "query_id").select("query_id", solution_prompt(F.col("body")).alias("prompt"))


# ------------------------------------------------- scalable search paths
@register("knn_l2_cells")
def q_knn_l2_cells(spark, base):
    """Exact top-k through IVF cells (the path for batches too big to broadcast)."""
    from ..operators.ivf import knn_l2_cells, label_centroids
    emb = read_table(spark, base, "embeddings").select(
        F.col("vec_id").alias("pk"), F.col("embedding").alias("embeddings"), "label")
    hits = knn_l2_cells(emb.select("pk", "embeddings"), fx.query_vectors_fx(spark, base), KNN_K,
                        centroids=label_centroids(emb, "label"))
    return hits.select("query_id", "pk", "distance", F.col("rank").cast("bigint").alias("rank"))


@register("knn_l2_two_pass")
def q_knn_l2_two_pass(spark, base):
    """Exact top-k with the bounded two-pass candidate exchange forced on."""
    from ..operators.knn import knn_l2
    hits = knn_l2(fx.vectors_fx(spark, base), fx.query_vectors_fx(spark, base), KNN_K,
                  max_candidate_rows=0)
    return hits.select("query_id", "pk", "distance", F.col("rank").cast("bigint").alias("rank"))


def _scratch(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stored_index(spark, base):
    from ..operators.ivf import create_index
    path = _scratch(spark, "ivf")
    create_index(fx.vectors_fx(spark, base), path, nlist=16)
    return path


@register("ivf_index")
def q_ivf_index(spark, base):
    """A stored index (trained cells): its vectors, and those not in their nearest cell."""
    from ..operators.ivf import misplaced
    return misplaced(spark, _stored_index(spark, base))


@register("knn_l2_index")
def q_knn_l2_index(spark, base):
    """Exact top-k from a stored index read back."""
    from ..operators.ivf import search_index
    hits = search_index(spark, _stored_index(spark, base), fx.query_vectors_fx(spark, base), KNN_K)
    return hits.select("query_id", "pk", "distance", F.col("rank").cast("bigint").alias("rank"))


@register("fetch_dead_letter")
def q_fetch_dead_letter(spark, base):
    """Open issues whose comment or reaction fetch failed, and what the others carry."""
    from ..operators.ingest import attach_children
    issues = fx.issues_fx(spark, base).where(F.col("state") == "open").select("id", "title")
    com = fx.comments_fx(spark, base).select("issue_id", F.col("comment_id").alias("id"), "body")
    rea = fx.raw_issues_fx(spark, base).select(F.col("id").alias("issue_id"), F.explode("reactions").alias("r")).select(
        "issue_id", F.col("r.id").alias("id"), F.col("r.user.login").alias("user"), F.col("r.content").alias("content"),
        F.col("r.created_at").alias("created_at"))
    status = fx.issues_fx(spark, base).select(F.col("id").alias("issue_id"), (F.col("id") % 10 != 4).alias("comments_ok"),
                                              (F.col("id") % 13 != 5).alias("reactions_ok"))
    kept, dead = attach_children(issues, com, rea, status)

    def rows(df, outcome):
        return df.select("id", "title", F.lit(outcome).alias("outcome"), F.size("comments").cast("bigint").alias("n_comments"),
                         F.size("reactions").cast("bigint").alias("n_reactions"))
    return rows(kept, "kept").unionByName(rows(dead, "dead letter"))


@register("landed_dead_letter")
def q_landed_dead_letter(spark, base):
    """Landed documents whose update time cannot be read."""
    from ..operators.ingest import unparsed_rows
    raw = fx.raw_issues_fx(spark, base)
    raw = raw.withColumn("updated_at", F.when(F.col("id") % 17 == 3, "yesterday").when(
        F.col("id") % 17 == 4, None).otherwise(F.col("updated_at")))
    return unparsed_rows(raw).select("id", "updated_at")


@register("child_endpoints")
def q_child_endpoints(spark, base):
    from ..functions.text import children_endpoint
    i = fx.issues_fx(spark, base)
    return i.select("id", *[children_endpoint("repo_owner", "repo_name", "issue_number", k).alias(k)
                            for k in ("comments", "reactions")])


@register("dq_suite_absent")
def q_dq_suite_absent(spark, base):
    """A suite that names columns the table does not have: those expectations fail."""
    from ..operators.quality import dq_extract, run_suite
    suite = [{"expectation_type": t, "kwargs": {"column": c}} for c in ("ID", "ASSIGNEE") for t in (
        "expect_column_values_to_be_unique", "expect_column_values_to_not_be_null")]
    return run_suite(dq_extract(fx.issues_fx(spark, base)), suite).select("expectation_type", "column", "success")


@register("dq_csv_batch")
def q_dq_csv_batch(spark, base):
    """The suite over the newest of two CSV batches (the older one is empty)."""
    from ..operators.quality import dq_extract, run_suite
    from ..sources.files import read_latest_csv_batch, write_csv_extract
    root = _scratch(spark, "extract")
    ext = dq_extract(fx.issues_fx(spark, base))
    write_csv_extract(ext.limit(0), f"{root}/20240101")
    write_csv_extract(ext, f"{root}/20240102")
    return run_suite(read_latest_csv_batch(spark, root, ext.schema)).select(
        "expectation_type", "column", "success", "element_count", "unexpected_count")


@register("chunk_token_ids")
def q_chunk_token_ids(spark, base):
    """Token-id chunks as a model takes them: (document, chunk, ids)."""
    c = vocabulary.chunk_token_ids(_encoded(spark, base))
    return c.select(F.col("id").alias("doc_id"), F.col("chunk_no").cast("bigint").alias("chunk_no"),
                    F.array_join("token_ids", " ").alias("token_ids"))


@register("summary_prompts")
def q_summary_prompts(spark, base):
    from ..operators.prompts import summary_prompt
    iss = fx.issues_fx(spark, base).where(F.col("state") == "open")
    return iss.select("id", summary_prompt(F.col("body")).alias("prompt"))


# --------------------------------------------------------------- streams
@register("stream_ingest")
def q_stream_ingest(spark, base):
    """Landed documents streamed into the issue table: the table after it, and the
    documents that could not be merged."""
    from ..streaming import jobs
    landed, root = _scratch(spark, "landed"), _scratch(spark, "issues")
    fx.landed_documents_fx(spark, base).write.json(landed)
    jobs.stream_ingest(spark, landed, root, _scratch(spark, "stream"), initial=fx.issues_fx(spark, base)).awaitTermination()
    none = F.lit(None)
    table = jobs.read_snapshot(spark, root).select(
        F.lit("table").alias("outcome"), "id", "title", "state", "updated_at", none.cast("string").alias("landed_time"))
    dead = jobs.read_dead_letter(spark, root).select(
        F.col("reason").alias("outcome"), "id", F.get_json_object("document", "$.title").alias("title"),
        F.get_json_object("document", "$.state").alias("state"), none.cast("timestamp_ntz").alias("updated_at"),
        F.col("updated_at").alias("landed_time"))
    return table.unionByName(dead)


@register("stream_requests_by_user_date")
def q_stream_requests_by_user_date(spark, base):
    """Requests per user and day from a stream whose events arrive up to a day late."""
    from ..streaming import jobs
    logs = fx.logs_fx(spark, base).select("username", "timestamp", "id")
    src, root = _scratch(spark, "logs"), _scratch(spark, "counts")
    # Arrival: weeks of event time, every other event a day later.
    week = F.floor((F.unix_micros(F.col("timestamp").cast("timestamp")) / 86_400_000_000 + F.col("id") % 2) / 7)
    logs.withColumn("arrived", week.cast("int")).write.partitionBy("arrived").parquet(src)
    parts = spark.read.parquet(src).select("arrived").distinct().count()
    stream = spark.readStream.schema(logs.schema).option(
        "maxFilesPerTrigger", max(1, parts)).parquet(f"{src}/arrived=*")
    jobs.updates_sink(jobs.requests_per_user_day(stream, "30 days"), root, _scratch(spark, "stream"))
    return jobs.read_updates(spark, root, ["username", "date"])


@register("stream_metering")
def q_stream_metering(spark, base):
    """Calls and top-ups metered as a stream; a last event far ahead lets all others pass."""
    from ..streaming import jobs
    ev, src, out = fx.metered_events_fx(spark, base, True), _scratch(spark, "events"), _scratch(spark, "metered")
    ev.write.parquet(f"{src}/1")
    last = ev.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("username"),
                              F.lit("2100-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), "kind", "service")
    last.write.parquet(f"{src}/2")
    files = len(spark.read.parquet(f"{src}/1").inputFiles())
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", files).parquet(f"{src}/*")
    # As in the batch key: weekly periods.  Late by up to the whole stream, as one file may hold it.
    users = fx.users_fx(spark, base)
    metered = jobs.meter_stream_event_time(stream, users, period="week", lateness="60 days",
                                           slice_us=30 * 86_400_000_000, buckets=max(64, users.count() // 2000))
    jobs.append_sink(metered, out, _scratch(spark, "stream"))
    return spark.read.schema(jobs.METER_OUT).parquet(out).select(
        "event_id", "username", "kind", "response_code", "balance")


# ---------------------------------------------------- completion, publication
class EchoClient:
    """A completion client with planted failures: a prompt whose length is 3 modulo 11
    fails once, one whose length is 5 modulo 13 always."""

    def __init__(self):
        self.asked = set()  # failed once and not yet asked again

    def __call__(self, texts):
        for t in texts:
            if len(t) % 13 == 5 or (len(t) % 11 == 3 and t not in self.asked):
                if len(t) % 13 != 5:
                    self.asked.add(t)
                raise RuntimeError(f"no reply to {len(t)} characters")
        self.asked.difference_update(texts)
        return [f"  echo of {len(t)}: {t[:8]}\n" for t in texts]


@register("completions")
def q_completions(spark, base):
    """Summaries of open issues by a client that fails now and then, and their log rows."""
    from ..operators.prompts import complete, completion_activity, summary_prompt
    iss = fx.issues_fx(spark, base).where(F.col("state") == "open")
    done = complete(iss.select("id", summary_prompt(F.col("body")).alias("prompt")), EchoClient)
    return completion_activity(done, "get_issue_summary", "Generated summary for issue").select(
        "id", "reply", "response_code", "description")


@register("published_reports")
def q_published_reports(spark, base):
    """The suite's reports below nested folders, published twice; what the target holds."""
    from ..operators.quality import dq_extract, run_suite
    from ..sources.files import publish_tree, stored_files
    site, target = _scratch(spark, "site"), _scratch(spark, "published")
    results = run_suite(dq_extract(fx.issues_fx(spark, base)))
    kinds = results.withColumn("kind", F.when(F.col("column").isNull(), "table").otherwise("column"))
    kinds.write.partitionBy("kind", "expectation_type").json(f"{site}/validations/2024")
    for _ in range(2):
        n = publish_tree(spark, site, target).count()
    back = spark.read.option("recursiveFileLookup", True).schema("column string, success boolean").json(target)
    place = F.regexp_extract(F.col("_metadata.file_path"), "/(validations/.*)/[^/]*$", 1)
    found = back.select(place.alias("folder"), "column", "success")
    return found.withColumn("every_file_once", F.lit(n == stored_files(spark, target)))


@register("quality_store")
def q_quality_store(spark, base):
    """Two runs appended to the result store, one of them read back."""
    import datetime as dt

    from ..operators.quality import dq_extract, read_results, run_suite, store_results, with_run_name
    path, ext = _scratch(spark, "results"), dq_extract(fx.issues_fx(spark, base))
    for day, part in ((1, ext.limit(0)), (2, ext)):
        store_results(with_run_name(run_suite(part), dt.datetime(2024, 1, day)), path)
    return read_results(spark, path, "20240102-000000").select(
        "expectation_type", "column", "success", "element_count", "unexpected_count", "run_name")


@register("activity_records")
def q_activity_records(spark, base):
    """The activity log written as JSON records and parsed back with its schema."""
    from ..operators.activity import activity_from_json, activity_json
    logs, path = fx.logs_fx(spark, base), _scratch(spark, "records")
    activity_json(logs).write.text(path)
    return activity_from_json(spark.read.text(path).withColumnRenamed("value", "record"), logs.schema)


@register("application_tables")
def q_application_tables(spark, base):
    """The user table made if absent, new users appended, made again: nothing is lost."""
    from ..operators.users import inserted_users, signup
    from ..schemas import APP_USER
    from ..sources.files import append_rows, ensure_table
    path = _scratch(spark, "users")
    ensure_table(spark, path, APP_USER)
    forms = fx.signups_fx(spark, base)
    new = inserted_users(signup(fx.users_fx(spark, base).limit(0), forms), "salt:")
    append_rows(new.select(*APP_USER.names), path)
    return ensure_table(spark, path, APP_USER).select("username", "service", "calls_remaining", "password")


@register("call_metrics_empty")
def q_call_metrics_empty(spark, base):
    """Metrics of a log without rows: one row of zeros."""
    from ..operators.activity import call_metrics
    return call_metrics(fx.logs_fx(spark, base).where(F.col("username").isNull()), AS_OF)


@register("comments_json_text")
def q_comments_json_text(spark, base):
    """The JSON text that is stored for an issue's comments."""
    return _flat(spark, base).select("id", F.to_json("comments").alias("comments_json"))
