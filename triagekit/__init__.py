"""triagekit: issue-tracker analytics as Spark jobs.

Ingest, upsert, text cleaning, token/embedding, exact nearest-neighbour
search, data-quality checks, usage analytics and quota metering, all
declared with the DataFrame API so Catalyst plans them.
"""

__version__ = "0.1.0"
