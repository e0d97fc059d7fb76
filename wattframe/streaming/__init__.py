"""Incremental variants of the landing ingest and the hourly means."""
