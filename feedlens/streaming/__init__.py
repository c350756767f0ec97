"""Structured Streaming jobs of the ingest pipeline."""
