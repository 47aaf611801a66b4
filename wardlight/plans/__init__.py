"""Named queries, the snapshot job, and their binding to the test tables."""
