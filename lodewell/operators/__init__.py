"""Relational, retrieval and graph operators."""
