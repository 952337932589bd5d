"""Structured Streaming versions of the ingestion operators."""
