"""postlens: post analytics as Spark jobs.

Extract posts from saved pages, type and clean them, check their quality,
fingerprint batches, append only new rows to a date-partitioned Parquet store,
label topics through a rule table or a model hook, and answer dashboard
questions (tag trends, pivots, series, top topics, term counts, drill-down)
in batch and with Structured Streaming.
"""

__version__ = "0.1.0"
