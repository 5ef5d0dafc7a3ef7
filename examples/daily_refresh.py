"""Daily refresh: landed issue pages → new issue snapshot, vectors, quality report.

    spark-submit examples/daily_refresh.py ISSUES_DIR LANDED_DIR VECTORS_DIR OUT_DIR [RUN]

Inputs are the current issue snapshot (Parquet), the landed JSON pages of
the day, and the current vector snapshot (pk, embeddings).  New versions
are written under OUT_DIR/RUN/{issues,vectors,quality}; inputs are never
overwritten.  ``spark.checkpoint.dir`` must name a shared folder on a
cluster.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from triagekit.operators import embed, ingest, issues, quality, upsert  # noqa: E402
from triagekit.session import get_session  # noqa: E402

EMBED_DIM = 64


def refresh(spark, issues_dir: str, landed_dir: str, vectors_dir: str, out: str) -> dict:
    current = spark.read.parquet(issues_dir)
    landed = ingest.read_landed_issues(spark, landed_dir)
    # Simplest form: marks from the current snapshot.  A deployment keeps the
    # marks table between runs and rolls it with issues.merge_high_water, so
    # the daily run never scans the whole table for them.
    marks = issues.high_water(current)
    flat = ingest.flatten_issues(landed).select(*current.columns)
    fresh = ingest.select_incremental(current, flat, marks)
    new_issues = upsert.merge_by_key(current, fresh, ["id"], order=["updated_at"])
    upsert.write_snapshot(new_issues, f"{out}/issues")

    # Re-embed only the issues that changed, then upsert their vectors.
    changed = spark.read.parquet(f"{out}/issues").join(
        fresh.select("id").distinct(), "id", "left_semi")
    vecs = embed.issue_embeddings(changed, EMBED_DIM, id_col="id", text_col="body").select(
        F.col("id").alias("pk"), F.col("vector").cast("array<float>").alias("embeddings"))
    upsert.write_snapshot(upsert.merge_by_key(spark.read.parquet(vectors_dir), vecs, ["pk"]),
                          f"{out}/vectors")

    report = quality.with_run_name(quality.run_suite(quality.dq_extract(spark.read.parquet(f"{out}/issues"))))
    quality.store_results(report, f"{out}/quality")
    return {"fresh": fresh.count(), "issues": spark.read.parquet(f"{out}/issues").count(),
            "vectors": spark.read.parquet(f"{out}/vectors").count()}


if __name__ == "__main__":
    issues_dir, landed_dir, vectors_dir, out_dir = sys.argv[1:5]
    run = sys.argv[5] if len(sys.argv) > 5 else "run"
    print(refresh(get_session(inputs=[issues_dir, landed_dir, vectors_dir]), issues_dir, landed_dir, vectors_dir, f"{out_dir}/{run}"))
