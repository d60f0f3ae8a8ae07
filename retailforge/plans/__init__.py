"""Composite pipelines (126-133) and the query registry behind ``__spark_entry__``."""
