"""jobsluice: job-posting analytics as Spark jobs.

Landed job-board payloads are normalised to one posting row shape, classified
by column rules, resolved into roles, kept as state across runs and served as a
deduplicated, freshness-windowed feed.
"""
