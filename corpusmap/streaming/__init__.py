"""Structured Streaming jobs: file-source ingest and embedding with foreachBatch."""
