"""Similar-issue search for a batch of texts, else a solution prompt.

    spark-submit examples/search.py ISSUES_DIR VECTORS_DIR QUERIES_DIR OUT_DIR

QUERIES_DIR holds Parquet rows (query_id, text[, owner, repo]).  Texts are
embedded with the same bag model as the stored vectors; matches above the
service threshold go to OUT_DIR/matches, the rest get a prompt in
OUT_DIR/prompts and every query an activity outcome in OUT_DIR/activity.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from triagekit.operators import embed, prompts, similarity  # noqa: E402
from triagekit.session import get_session  # noqa: E402

EMBED_DIM = 64


def search(spark, issues_dir: str, vectors_dir: str, queries_dir: str, out: str,
           threshold: float = similarity.DEFAULT_THRESHOLD) -> dict:
    q = spark.read.parquet(queries_dir)
    qv = embed.issue_embeddings(q, EMBED_DIM, id_col="query_id", text_col="text").select(
        F.col("id").alias("query_id"), F.col("vector").cast("array<float>").alias("embedding"))
    scoped = "owner" in q.columns
    if scoped:
        qv = qv.join(q.select("query_id", "owner", "repo"), "query_id")
    m = similarity.similar_issues(spark.read.parquet(vectors_dir), qv, spark.read.parquet(issues_dir),
                                  threshold=threshold, scoped=scoped)
    m.write.parquet(f"{out}/matches")
    matches = spark.read.parquet(f"{out}/matches")
    un = similarity.unmatched_queries(q.select("query_id", "text"), matches)
    un.select("query_id", prompts.solution_prompt(F.col("text")).alias("prompt")).write.parquet(f"{out}/prompts")
    similarity.search_activity(q.select("query_id"), matches).write.parquet(f"{out}/activity")
    return {"matches": matches.count(), "prompts": spark.read.parquet(f"{out}/prompts").count()}


if __name__ == "__main__":
    print(search(get_session(inputs=sys.argv[1:4]), *sys.argv[1:5]))
