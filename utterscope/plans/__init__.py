"""Named queries, the adapter they run on, and the report."""
