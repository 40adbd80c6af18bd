"""Readers: Parquet tables, and manifests as JSON, JSON lines and CSV."""
