"""Incremental forms of the batch jobs (the reference itself has no streams)."""
